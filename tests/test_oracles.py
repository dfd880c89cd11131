"""Every query against its SQL on the same tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from grafwerk import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() >= 0


def test_known_label_counts(spark):
    """Exact, ambiguous and unresolved edges by tier at the second size."""
    from grafwerk.plans.store import build

    g = build(spark, "/root/testdata/sf0.01")
    got = {(r["resolution"], r["tier"]): r["n"] for r in g.edges.groupBy("resolution", "tier").count().withColumnRenamed("count", "n").collect()}
    assert got == {("exact", "file"): 1924, ("exact", "import"): 4662, ("exact", "repo"): 4393, ("exact", "global"): 10078, ("ambiguous", "import"): 730, ("ambiguous", "repo"): 196, ("ambiguous", "global"): 32247, ("unresolved", None): 5770}


def test_invariants(spark, sf):
    from grafwerk.operators import lookup
    from grafwerk.plans.store import build

    g = build(spark, sf)
    assert g.edges.count() == g.raw_edges.count()
    assert g.edges.where("(resolution = 'exact') <> (target_id is not null)").count() == 0
    name = catalog.name_of(g)
    precise = {r["edge_id"] for r in lookup.callers(g, name, limit=10**6).collect()}
    assert precise <= {r["edge_id"] for r in lookup.callers(g, name, True, limit=10**6).collect()}
