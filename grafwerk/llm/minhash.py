"""MinHash near-dedup: one permutation hashing, optimal densification, stars of buckets.

A text is the set of its distinct word shingles. One pass over the set hashes each shingle
once, into one of ``BANDS * ROWS`` bins, and keeps the least of every bin. An empty bin takes
the value of the first bin that is not empty in an order of its own, alike for all texts,
which leaves every bin an unbiased and evenly spread sample (optimal densification). ``ROWS``
bins make a band and each band puts the text into a bucket; two texts of similarity 0.8 share
none of the 40 buckets with a chance of 1.2e-7.

A bucket proposes a star: an edge from each member to its smallest one, so candidates are at
most texts times bands however many texts meet, and texts that meet in any bucket are in one
component of the stars, a zone. Within a zone the full sets decide, and all of it: a zone of
at most ``PART`` bytes of sets is one task's; a larger one is cut into classes of sizes (sets
at 0.8 are of one class or of neighbouring ones) and these by hash into parts, and each pair of
parts is a task. A task counts intersections exactly, by products of incidence matrices where
there are many sets, and returns a spanning forest of its links, never pairs. Components of
the links are the groups; so no link between texts that share a bucket is lost, whichever text
the star had in its middle.

Equal texts are one node from the beginning. Sets are compared as 64-bit hashes of shingles:
two of a text's or pair's N shingles are taken for one with a chance of about N^2 / 2^65.

Defined results: null text is empty; texts without words have no shingles and are linked with
nothing, not even with each other; null ids are in their group but never its name unless all
are null; rows that repeat an id are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.shared import checkpoint, join_spread, lean, text_of
from grafwerk.llm.simhash import components, node, shingles, unite

WORDS, SHARED, OF = 4, 80, 100
BANDS, ROWS, SEED = 40, 5, 42
#: Bytes of sets above which a zone is cut, and of a part; texts compared one by one; rows and
#: columns of an incidence matrix; rows of a table of parts that may be broadcast.
PART, FEW, BLOCK, WIDTH, SMALL = 8 << 20, 12, 256, 16_384, 100_000


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def orders(bins: int, seed: int = SEED) -> np.ndarray:
    """For each bin the order in which it asks the others, from a fixed seed."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def sketch(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The densified least hash of every bin."""
    h = _mixed(found + np.uint64(0x9E3779B97F4A7C15))
    bins = len(order)
    at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    least = np.full(bins, np.iinfo(np.uint64).max)
    np.minimum.at(least, at.astype(np.int64), h)
    held = np.zeros(bins, bool)
    held[at.astype(np.int64)] = True
    empty = np.flatnonzero(~held)
    if len(empty):
        asked = order[empty]
        least[empty] = least[asked[np.arange(len(empty)), held[asked].argmax(1)]]
    return least


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band's bucket."""
    parts = least.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(parts.shape[1]):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)


def sketched(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node (hash of the text), n (size of its set) and keys (of its buckets)."""
    order = orders(bands * rows)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, node long, n long, keys array<long>"

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column(2)]
            keys = [band_keys(sketch(s, order), bands).tolist() if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "n", "keys"])

    return docs.select(F.col(id_col).alias("id"), node(text_col).alias("node"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def stars(nodes: DataFrame) -> DataFrame:
    """Distinct edges (u, v) from the members of a bucket to its smallest one."""
    posts = nodes.select("node", F.explode("keys").alias("key"))
    middle = posts.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("key", "v")
    return posts.join(middle, "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, exact below 2 ** 24."""
    vocabulary = np.unique(np.concatenate(left))

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        of, h = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[at] == h
        order = np.argsort(at[known], kind="stable")
        return of[known][order], at[known][order]

    (i, x), (j, y) = cells(left), cells(right)
    found = np.zeros((len(left), len(right)))
    for start in range(0, len(vocabulary), WIDTH):
        a, b = np.searchsorted(x, [start, start + WIDTH]), np.searchsorted(y, [start, start + WIDTH])
        if a[0] == a[1] or b[0] == b[1]:
            continue
        used = np.unique(y[b[0] : b[1]])
        both = [np.zeros((len(s), len(used)), np.float32) for s in (left, right)]
        for m, of, at in ((both[0], i[a[0] : a[1]], x[a[0] : a[1]]), (both[1], j[b[0] : b[1]], y[b[0] : b[1]])):
            place = np.minimum(np.searchsorted(used, at), len(used) - 1)
            hit = used[place] == at
            m[of[hit], place[hit]] = 1
        found += both[0] @ both[1].T
    return found


def exact_links(left: list[np.ndarray], right: list[np.ndarray] | None = None, shared: int = SHARED, of: int = OF) -> np.ndarray:
    """Labels (the smallest position in left, then right) of what links join: pairs within
    left, or between left and right."""
    own = right is None
    sets = left if own else left + right
    size, label = np.array([len(s) for s in sets], np.int64), np.arange(len(sets))
    first, second = np.arange(len(left)), np.arange(len(left)) if own else np.arange(len(left), len(sets))
    if len(first) * len(second) <= FEW * FEW:
        for a in first.tolist():
            for b in second.tolist():
                if (a < b) and of * min(size[a], size[b]) >= shared * max(size[a], size[b]) and label[a] != label[b]:
                    k = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if of * k >= shared * (size[a] + size[b] - k):
                        label = unite(label, np.array([a]), np.array([b]))
        return label
    first, second = first[np.argsort(size[first], kind="stable")], second[np.argsort(size[second], kind="stable")]
    for s in range(0, len(first), BLOCK):
        rows = first[s : s + BLOCK]
        for t in range(s if own else 0, len(second), BLOCK):
            columns = second[t : t + BLOCK]
            if of * size[rows[-1]] < shared * size[columns[0]] or of * size[columns[-1]] < shared * size[rows[0]]:
                continue
            k = intersections([sets[r] for r in rows], [sets[c] for c in columns])
            i, j = np.nonzero(of * k >= shared * (size[rows][:, None] + size[columns][None, :] - k))
            label = unite(label, rows[i], columns[j])
    return label


def size_class(size: F.Column, shared: int = SHARED, of: int = OF) -> F.Column:
    """Sets of which one has at least shared of ``of`` as many members are of one or of
    neighbouring classes."""
    return F.floor(F.log(size.cast("double")) / float(np.log(of / min(shared, of - 1))) - 1e-9).cast("int")


def links(held: DataFrame, shared: int = SHARED, of: int = OF, part: int = PART) -> DataFrame:
    """A spanning forest (u, v) of the links within zones of ``held`` (node, zone, n, held)."""
    rows = held.withColumn("class", size_class(F.col("n"), shared, of))
    sizes = checkpoint(rows.groupBy("zone", "class").agg(F.sum(F.col("n") * 8).alias("bytes")))
    large = sizes.groupBy("zone").agg(F.sum("bytes").alias("all")).where(F.col("all") > part).select("zone")
    own = checkpoint(sizes.join(large, "zone").select("zone", "class", F.ceil(F.col("bytes") / part).cast("int").alias("parts")))
    n = own.count()
    if n:
        beside = lambda step, name: own.select("zone", (F.col("class") - step).alias("class"), F.col("parts").alias(name))
        own = checkpoint(own.join(beside(1, "up"), ["zone", "class"], "left").join(beside(-1, "down"), ["zone", "class"], "left"))
        rows = rows.join(F.broadcast(own) if n <= SMALL else own, ["zone", "class"], "left")
        part_of = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        rows = rows.withColumn("part", part_of)
        task = lambda a, x, b, y, is_left: F.struct(a.alias("a"), x.alias("x"), b.alias("b"), y.alias("y"), F.lit(is_left).alias("is_left") if isinstance(is_left, bool) else is_left.alias("is_left"))
        c, p = F.col("class"), F.col("part")
        every = lambda count: F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        within = F.transform(every("parts"), lambda o: task(c, F.least(p, o), c, F.greatest(p, o), p <= o))
        up = F.transform(every("up"), lambda o: task(c, p, c + 1, o, True))
        down = F.transform(every("down"), lambda o: task(c - 1, o, c, p, False))
        zero = F.lit(0)
        alone = F.array(task(zero, zero, zero, zero, True))
        rows = rows.withColumn("t", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(F.concat(within, up, down)))).select("zone", "t.*", "node", "held")
    else:
        zero = F.lit(0)
        rows = rows.select("zone", zero.alias("a"), zero.alias("x"), zero.alias("b"), zero.alias("y"), F.lit(True).alias("is_left"), "node", "held")

    def joined(key: tuple, groups: dict[bool, dict[int, np.ndarray]]) -> pa.RecordBatch | None:
        left, right = groups[True], groups[False]
        own = key[1:3] == key[3:5]
        if (len(left) < 2 if own else not left or not right):
            return None
        label = exact_links(list(left.values()), None if own else list(right.values()), shared, of)
        nodes = np.array([*left, *right], np.int64)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[label[at]])], names=["u", "v"])

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups = None, {True: {}, False: {}}
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("zone", "a", "x", "b", "y"))))
            for name, is_left, who, found in zip(names, batch.column("is_left").to_pylist(), batch.column("node").to_pylist(), batch.column("held")):
                if name != key:
                    if key is not None and (made := joined(key, groups)) is not None:
                        yield made
                    key, groups = name, {True: {}, False: {}}
                if who not in groups[is_left]:  # copies of a text that several tasks read
                    groups[is_left][who] = np.frombuffer(found.as_py(), np.uint64)
        if key is not None and (made := joined(key, groups)) is not None:
            yield made

    keys = ["zone", "a", "x", "b", "y"]
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (32 << 20) + 1)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, shared: int = SHARED, of: int = OF, bands: int = BANDS, rows: int = ROWS, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable) and kept."""
    found = checkpoint(sketched(docs, words, bands, rows, id_col, text_col))
    nodes = found.where("n > 0").groupBy("node").agg(F.first("keys").alias("keys"))
    zones = components(stars(nodes))
    zones = checkpoint(zones.union(zones.select("root", "root").distinct()).toDF("node", "zone"))

    @lean
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, who in enumerate(batch.column(0).to_pylist()):
                if who not in seen:
                    seen.add(who)
                    new.append(i)
            some = batch.take(pa.array(new, pa.int64()))
            made = [shingles(x.as_py(), words) for x in some.column(2)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "zone", "n", "held"])

    texts = docs.select(node(text_col).alias("node"), text_of(text_col).alias("text")).join(zones, "node").select("node", "zone", "text")
    held = checkpoint(texts.mapInArrow(sets, "node long, zone long, n long, held binary"))
    linked = components(links(held, shared, of, part))
    linked = checkpoint(linked.union(linked.select("root", "root").distinct()).toDF("node", "root"))
    firsts = found.where("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    firsts = checkpoint(firsts.join(linked, "node", "left"))
    members = firsts.where("root is not null")
    named = join_spread(members, members.groupBy("root").agg(F.min("first").alias("name"), F.count("*").alias("n")), ["root"], "node")
    names = named.select("node", "name", F.col("copies").alias("n")).unionByName(firsts.where("root is null").select("node", F.col("first").alias("name"), F.col("copies").alias("n")))
    back = join_spread(found.where("n > 0").select("id", "node", F.col("n").alias("n_shingles")), names, ["node"], "id").select("id", "n_shingles", F.col("name").alias("component_id"))
    every = back.unionByName(found.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
    return every.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
