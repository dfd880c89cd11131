"""Breadth-first traversals, set at a time: a frontier joins the edges, what has been met
before is removed by an anti join, and each level is checkpointed so that plans stay flat.

The distinct edges of a graph are made once, laid out by the end they are followed from. A
frontier that was counted and found small is broadcast, so that a level reads the edges
where they lie; a larger one is joined by its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.operators.lookup import STRUCTURAL, located, test_method
from grafwerk.plans.store import checkpoint, cut_once, sliced
from grafwerk.sources.views import Graph

#: Rows up to which a counted frontier is broadcast; above, frontiers are stored packed.
SMALL = 50_000
#: Hops whose sources' closure is made together, and seeds that are traversed together.
HOPS, SEEDS = 1_000_000, 200_000


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, limit: int | None = None) -> DataFrame:
    """seed, node, parent, depth of everything reachable from seeds (node) over edges
    (from_id, to_id), each node once per seed at its least depth; seeds have depth 0. A seed
    that has reached more than ``limit`` nodes goes no further than that level."""
    seen = frontier = seeds.select(F.col("node").alias("seed"), "node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")).distinct()
    n = SMALL + 1
    for depth in range(1, max_depth + 1):
        ahead = frontier.select("seed", F.col("node").alias("from_id"))
        step = edges.join(F.broadcast(ahead) if n <= SMALL else ahead, "from_id").groupBy("seed", F.col("to_id").alias("node")).agg(F.min("from_id").alias("parent"))
        frontier = checkpoint(step.join(seen, ["seed", "node"], "left_anti").select("seed", "node", "parent", F.lit(depth).alias("depth")), packed=n > SMALL)
        if not (n := frontier.count()):
            break
        seen = seen.unionByName(frontier)
        if limit is not None and depth < max_depth:
            over = seen.where("depth > 0").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("seed")
            frontier = frontier.join(over, "seed", "left_anti")
    return seen


def call_pairs(edges: DataFrame, kinds: tuple[str, ...] = STRUCTURAL, a: str = "target_id", b: str = "source_id") -> DataFrame:
    """Distinct pairs (from_id, to_id) of the resolved edges of these kinds."""
    known = edges.where(F.col("target_id").isNotNull() & F.col("kind").isin(*kinds))
    return known.select(F.col(a).alias("from_id"), F.col(b).alias("to_id")).distinct()


def _calls(graph: Graph, service: bool, backward: bool) -> DataFrame:
    kinds = STRUCTURAL + (("http_call", "service_call") if service else ())
    a, b = ("target_id", "source_id") if backward else ("source_id", "target_id")

    def made() -> DataFrame:
        return call_pairs(graph.edges, kinds, a, b).repartition("from_id")

    return cut_once(graph.edges, f"calls {service} {backward}", made)


def impacted(graph: Graph, name: str, max_depth: int = 10, service: bool = False) -> DataFrame:
    """node, depth of the symbols that a change of ``name`` reaches through callers; direct
    callers have depth 0, symbols of the name itself are left out."""
    seeds = graph.symbols.where(F.col("name") == name).select(F.col("id").alias("node"))
    met = reach(_calls(graph, service, True), seeds, max_depth).where("depth > 0").groupBy("node").agg((F.min("depth") - 1).alias("depth"))
    return met.join(seeds, "node", "left_anti")


def _labelled(graph: Graph, nodes: DataFrame) -> DataFrame:
    return nodes.join(located(graph).withColumnRenamed("id", "node"), "node").withColumn("test", test_method(F.col("path"), F.col("name"), F.col("qualified_name")))


def impact(graph: Graph, name: str, max_depth: int = 10, limit: int = 500, service: bool = False) -> DataFrame:
    """``impacted`` with names, how each shows to be a test, and whether the limit cut the list."""
    met = impacted(graph, name, max_depth, service)
    cut = met.agg((F.count("*") > limit).alias("truncated"))
    return _labelled(graph, met.orderBy("depth", "node").limit(limit)).crossJoin(F.broadcast(cut)).select("node", "name", "path", "depth", "test", "truncated")


def impact_histogram(graph: Graph, name: str, max_depth: int = 10) -> DataFrame:
    return _labelled(graph, impacted(graph, name, max_depth)).groupBy("depth").agg(F.count("*").alias("symbols"), F.count_if(F.col("test") != "").alias("tests"))


def cycles(graph: Graph, length: int = 3) -> DataFrame:
    """Rings of at most ``length`` calls, each once, by its smallest member first."""
    e = _calls(graph, False, False).where("from_id <> to_id")
    paths = e.where("from_id < to_id").select(F.array("from_id", "to_id").alias("ring"))
    found = None
    for n in range(2, length + 1):
        last = paths.select("ring", F.element_at("ring", -1).alias("from_id"))
        closed = last.join(e, "from_id").where(F.col("to_id") == F.col("ring")[0]).select("ring")
        found = closed if found is None else found.unionByName(closed)
        if n < length:
            paths = last.join(e, "from_id").where((F.col("to_id") > F.col("ring")[0]) & ~F.array_contains("ring", F.col("to_id"))).select(F.concat("ring", F.array("to_id")).alias("ring"))
    return found.distinct().select(F.array_join(F.transform("ring", lambda x: x.cast("string")), ">").alias("ring"), F.size("ring").alias("length"))


def flow(graph: Graph, name: str, max_depth: int = 8) -> DataFrame:
    """What ``name`` leads to through calls: least depth, parent, number of distinct callees
    (more than one: a branch, none: a leaf) and the last two folders of the path."""
    seeds = graph.symbols.where(F.col("name") == name).select(F.col("id").alias("node"))
    e = _calls(graph, False, False)
    met = reach(e, seeds, max_depth).groupBy("node").agg(F.min(F.struct("depth", "parent")).alias("x")).select("node", "x.depth", "x.parent")
    out = e.groupBy(F.col("from_id").alias("node")).agg(F.count("to_id").alias("callees"))
    place = located(graph).select(F.col("id").alias("node"), "name", F.array_join(F.slice(F.split("path", "/"), -3, 2), "/").alias("module"))
    return met.join(out, "node", "left").join(place, "node").select("node", "name", "depth", "parent", F.coalesce("callees", F.lit(0)).alias("callees"), "module")


def hops(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """source_id, target_name, target_id (smallest), next: the edges of each source by the name
    they lead to, and the symbol that they go on from: the target, or the one symbol that an
    unresolved target name can mean."""
    unique = symbols.groupBy(F.col("name").alias("target_name")).agg(F.count("*").alias("n"), F.min("id").alias("only")).where("n = 1").select("target_name", "only")
    names = symbols.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"))
    first = edges.join(names, "target_id", "left").select("source_id", F.coalesce("t_name", "target_name").alias("target_name"), "target_id")
    first = first.groupBy("source_id", "target_name").agg(F.min("target_id").alias("target_id"))
    return checkpoint(first.join(unique, "target_name", "left").select("source_id", "target_name", "target_id", F.coalesce("target_id", "only").alias("next")))


def closure_of(hop: DataFrame, max_depth: int = 3, sources: DataFrame | None = None) -> DataFrame:
    """source_id, target_name, target_id, distance over hops, of all or of some sources
    (source_id). Level n + 1 extends level n by the hops of what it leads on to; levels are made
    for some of the sources after others, so that what one exchanges is gone before the next."""
    own = hop if sources is None else hop.join(sources, "source_id", "left_semi")
    found = own.select("source_id", "target_name", "target_id", F.lit(1).alias("distance"))
    step = hop.select(F.col("source_id").alias("next"), "target_name", "target_id", F.col("next").alias("then"))
    n = max(1, min(16, -(-own.count() // HOPS)))
    for k in range(n):
        level = own if n == 1 else own.where(F.pmod(F.xxhash64("source_id"), F.lit(n)) == k)
        for d in range(2, max_depth + 1):
            level = checkpoint(level.select("source_id", "next").where("next is not null").distinct().join(step, "next").groupBy("source_id", "target_name").agg(F.min("target_id").alias("target_id"), F.min("then").alias("next")))
            found = found.unionByName(level.select("source_id", "target_name", "target_id", F.lit(d).alias("distance")))
    return found


def closure(graph: Graph, max_depth: int = 3) -> DataFrame:
    """``closure_of`` all edges of a graph."""
    return closure_of(hops(graph.edges, graph.symbols), max_depth)


#: Kinds of symbols that the dataflow index has; levels; symbols a list has at most.
INDEXED, INDEX_DEPTH, INDEX_LIMIT = ("function", "method", "class", "interface", "enum"), 5, 500


def dataflow_of(calls: DataFrame, seeds: DataFrame, place: DataFrame, max_depth: int = INDEX_DEPTH, limit: int = INDEX_LIMIT) -> DataFrame:
    """For every seed (node) how many symbols a change reaches over calls, at most ``limit``,
    and repositories up to the level that passed the limit. One traversal for all seeds of a slice."""
    n = F.count("*")

    def made(part, _) -> DataFrame:
        met = reach(calls, part(seeds), max_depth, limit).where("depth > 0 and seed <> node")
        return met.join(place, "node").groupBy(F.col("seed").alias("symbol_id")).agg(F.least(n, F.lit(limit)).alias("within"), F.count_distinct("repo_id").alias("repos"), (n > limit).alias("truncated"))

    return sliced(seeds, ["node"], made, SEEDS)


def placed(graph: Graph) -> DataFrame:
    return located(graph).select(F.col("id").alias("node"), "repo_id")


def dataflow_index(graph: Graph, kinds: tuple[str, ...] = INDEXED, max_depth: int = INDEX_DEPTH, limit: int = INDEX_LIMIT) -> DataFrame:
    """``dataflow_of`` all symbols of these kinds."""
    seeds = graph.symbols.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("node"))
    return dataflow_of(_calls(graph, False, True), seeds, placed(graph), max_depth, limit)


def dataflow_lookup(graph: Graph, name: str) -> DataFrame:
    """The rows of the graph's dataflow index, made at the first look-up, for a name."""
    index = cut_once(graph.edges, "dataflow", lambda: dataflow_index(graph))
    return index.join(graph.symbols.where(F.col("name") == name).select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")


def ambiguous_dispatch(graph: Graph, most: int = 50) -> DataFrame:
    """Names that edges could not decide between: how many names of callers use them, and the
    first ``most`` of those."""
    who = graph.symbols.select(F.col("id").alias("source_id"), F.col("name").alias("caller"))
    hits = checkpoint(graph.edges.where("resolution = 'ambiguous'").join(who, "source_id").select("target_name", "caller").distinct())
    order = Window.partitionBy("target_name").orderBy("caller")
    first = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).groupBy("target_name").agg(F.array_join(F.array_sort(F.collect_list("caller")), ",").alias("callers"))
    return hits.groupBy("target_name").agg(F.count("*").alias("n")).join(first, "target_name")


def symbol_subgraph(graph: Graph, symbol_id: int, fan: int = 30) -> DataFrame:
    """Edges around one symbol, at most ``fan`` each way, for drawing."""
    known = graph.edges.where("target_id is not null").select("id", "source_id", "target_id", "kind")
    into = known.where(F.col("target_id") == symbol_id).orderBy("id").limit(fan)
    return into.unionByName(known.where((F.col("source_id") == symbol_id) & (F.col("target_id") != symbol_id)).orderBy("id").limit(fan))
