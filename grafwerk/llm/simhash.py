"""SimHash near-dedup by a binary trie self-join.

Fingerprints of word shingles that differ in at most ``budget`` bits are linked and linked
ones grouped. Equal fingerprints are one trie leaf with one smallest id, so copies never
become pairs.

The join descends two trie nodes at once, adds a differing bit where it follows unequal
branches and gives a node pair up once the budget is exceeded. To spread it, the fingerprint
is rotated so that each of ``budget + 1`` blocks of bits comes first once: a linked pair
agrees in at least one block, so in that rotation it meets in the node pair (cell, cell)
below the block with no bit spent, and every cell is a task's work. A cell of more than
``CELL`` fingerprints is split into parts by hash, and each pair of parts is a task with its
own two tries. A task returns a spanning forest of what it links, never all pairs.
Components come from alternating large-star and small-star rounds, checkpointed each, until
so few edges are left that one task can unite them.

``near_duplicates`` links 64-bit fingerprints exactly by their bits. ``near_copies`` links
texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: its
fingerprints have 256 bits, the same join finds fingerprints within ``WIDE_BUDGET`` bits,
and the whole shingle sets decide. About 39 bits differ at 0.8, too many for blocks that
agree for sure; so the rotations are draws of bits whose first ones make the cell, enough of
them that a pair at 0.8 misses every cell with a chance below ``MISS``. A task gives the
spanning forest of what meets in its cells; the components are zones, within which all sets
are compared by the tasks of ``minhash.links``, so no pair that met is lost to nearer ones.
The cells hold about ``CROWD`` texts whatever their number n, which takes rotations in
proportion to n ** 0.23 (24 at fifty thousand texts, 400 at 100 million).

Defined results: a text without words has fingerprint zero and is linked like any other
(``near_copies``: near the others without words); null text is empty; null ids are in their
group but never its name unless all are null; rows that repeat an id are rows of their own.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafwerk.llm.shared import checkpoint, join_spread, lean, text_of

WORDS, SEED, BUDGET = 4, 42, 4
#: Fingerprints of a cell above which it is split; pairs of leaves compared at once.
CELL, LEAF, CHUNK = 32_768, 24, 1 << 20
#: Rows of a task, which hold it in memory at about 100 bytes each; edges that one task unites.
TASK_ROWS, LOCAL = 1_000_000, 1 << 20
#: Near copies: words of a shingle, least similarity, bits that may differ, of all and of the
#: first 64 of a draw; chance that no cell has a pair at that similarity; texts of a cell.
WIDE_WORDS, SIMILAR, WIDE_BUDGET, KEY_BUDGET, MISS, CROWD = 5, 0.8, 54, 21, 0.001, 64
WIDE = 256


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half the XXH64 of the shingles; zero without words."""
    w = text.encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    counts, n = np.zeros(64, np.int64), len(w) - k + 1
    for at in range(0, n, 1 << 16):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at + k - 1 : min(n, at + (1 << 16)) + k - 1].tolist())]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``fp`` (the fingerprint's 64 bits as a signed long)."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp long"

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or "", words, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def trie_links(left: np.ndarray, right: np.ndarray, pairs: list[tuple[int, int, int, int]], budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in left, in right) of fingerprints that differ in at most budget bits.

    left and right hold sorted uint64; pairs are the node pairs to begin with, as ranges
    (from, to, from, to). For a self-join both arrays are the same object: a node paired
    with itself then gives each link once. Node pairs of one depth are handled side by side.
    """
    same = left is right
    if not pairs:
        return
    stack = [(63, np.array(pairs, np.int64), np.zeros(len(pairs), np.int64))]
    while stack:
        bit, nodes, spent = stack.pop()
        if len(nodes) > CHUNK // 8:
            half = len(nodes) // 2
            stack += [(bit, nodes[:half], spent[:half]), (bit, nodes[half:], spent[half:])]
            continue
        a0, a1, b0, b1 = nodes.T
        small = ((a1 - a0 <= LEAF) & (b1 - b0 <= LEAF)) | (bit < 0)
        yield from _leaves(left, right, nodes[small], same, budget)
        nodes, spent = nodes[~small], spent[~small]
        if not len(nodes):
            continue
        a0, a1, b0, b1 = nodes.T
        cut_a, cut_b = _split(left, a0, a1, bit), _split(right, b0, b1, bit)
        itself = same & (a0 == b0) & (a1 == b1)
        children = [
            (np.stack([a0, cut_a, b0, cut_b], 1), spent, np.ones(len(nodes), bool)),
            (np.stack([cut_a, a1, cut_b, b1], 1), spent, np.ones(len(nodes), bool)),
            (np.stack([a0, cut_a, cut_b, b1], 1), spent + 1, np.ones(len(nodes), bool)),
            (np.stack([cut_a, a1, b0, cut_b], 1), spent + 1, ~itself),
        ]
        below = np.concatenate([c[0] for c in children])
        cost = np.concatenate([c[1] for c in children])
        live = np.concatenate([c[2] for c in children]) & (cost <= budget) & (below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2])
        if live.any():
            stack.append((bit - 1, below[live], cost[live]))


def _split(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: int) -> np.ndarray:
    """First position in each range with this bit set; a node's higher bits are alike."""
    mask = np.uint64((1 << (63 - bit)) - 1) << np.uint64(bit + 1) if bit < 63 else np.uint64(0)
    low, high = start.copy(), end.copy()
    flag = np.uint64(1 << bit)
    wanted = (values[start] & mask) | flag
    for _ in range(int((end - start).max()).bit_length()):
        middle = (low + high) >> 1
        open_ = low < high
        less = values[np.minimum(middle, len(values) - 1)] < wanted
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def _leaves(left: np.ndarray, right: np.ndarray, nodes: np.ndarray, same: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    for at in np.split(np.arange(len(nodes)), np.searchsorted(np.cumsum(sizes), np.arange(CHUNK, sizes.sum(), CHUNK))) if len(nodes) else []:
        a0, _, b0, b1 = nodes[at].T
        n = sizes[at]
        which = np.repeat(np.arange(len(at)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (b1 - b0)[which]
        i, j = a0[which] + k // width, b0[which] + k % width
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if same:
            near &= i < j
        yield i[near], j[near]


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of positions i and j into labels (each position's smallest, fully compressed)."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (further := label[label])).any():
            label = further


def _split_cells(rows: DataFrame, cell: int) -> DataFrame:
    """rows (turn, cell, fp, ...) with their tasks: parts i and j, and whether it is of part i."""
    full = rows.groupBy("turn", "cell").count().where(F.col("count") > cell).select("turn", "cell", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    named = [c for c in rows.columns if c not in ("turn", "cell")]
    rows = rows.join(full, ["turn", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(*named, "turn", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("is_i"))


def _cells(first: DataFrame, budget: int, cell: int) -> DataFrame:
    """The rows of ``first`` (fp, first) once for each rotation, with their cell and task."""
    blocks = budget + 1
    width = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    at = [sum(width[:k]) for k in range(blocks)]
    turns = F.array(*[F.struct(F.lit(at[k]).alias("turn"), F.shiftrightunsigned(F.shiftleft("fp", at[k]) if at[k] else F.col("fp"), 64 - width[k]).alias("cell")) for k in range(blocks)])
    return _split_cells(first.select("fp", "first", F.explode(turns).alias("t")).select("fp", "first", "t.turn", "t.cell"), cell)


def _join_cells(col: dict[str, np.ndarray], keyed: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of rows that meet in a task's cells within budget by their keys, and
    the order in which positions are meant first."""
    order = np.lexsort([keyed, ~col["is_i"], col["j"], col["i"], col["cell"], col["turn"]])
    tasks = np.stack([col[c].astype(np.int64)[order] for c in ("turn", "cell", "i", "j")])
    keyed, is_i = keyed[order], col["is_i"][order]
    edges = np.concatenate([[0], np.flatnonzero((np.diff(tasks) != 0).any(0)) + 1, [len(keyed)]])
    own = tasks[2, edges[:-1]] == tasks[3, edges[:-1]]
    whole = [(a, b, a, b) for a, b, one in zip(edges[:-1].tolist(), edges[1:].tolist(), own.tolist()) if one and b - a > 1]
    for i, j in trie_links(keyed, keyed, whole, budget):
        yield order[i], order[j]
    for a, b in zip(edges[:-1][~own].tolist(), edges[1:][~own].tolist()):
        middle = a + int(is_i[a:b].sum())
        if a < middle < b:
            for i, j in trie_links(keyed[a:middle], keyed[middle:b], [(0, middle - a, 0, b - middle)], budget):
                yield order[i + a], order[j + middle]


def _read(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    """A task's rows; None where it has none, as then there is not even a schema."""
    got = [b for b in batches if len(b)]
    return pa.Table.from_batches(got) if got else None


def links(first: DataFrame, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """A spanning forest (u, v) of the distinct fingerprints ``fp`` within budget of each
    other, with the ``first`` of both ends, if there is such a column."""
    first = first if "first" in first.columns else first.select("fp", F.col("fp").alias("first"))
    kind = first.schema["first"].dataType.simpleString()

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _read(batches)) is None:
            return
        col = {c: table.column(c).to_numpy() for c in ("fp", "turn", "cell", "i", "j", "is_i")}
        fps, turn = col["fp"].view(np.uint64), col["turn"].astype(np.uint64)
        rotated = (fps << turn) | np.where(turn > 0, fps >> ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
        label = np.arange(len(fps))
        for i, j in _join_cells(col, rotated, budget):
            label = unite(label, i, j)
        u = np.flatnonzero(label != np.arange(len(fps)))
        names, fp = table.column("first").combine_chunks(), table.column("fp").combine_chunks()
        for at in range(0, len(u), 1 << 16):
            x = pa.array(u[at : at + (1 << 16)])
            y = pa.array(label[u[at : at + (1 << 16)]])
            yield pa.RecordBatch.from_arrays([fp.take(x), fp.take(y), names.take(x), names.take(y)], names=["u", "v", "first_u", "first_v"])

    parts = max(int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")), first.count() * (budget + 1) // TASK_ROWS + 1)
    return _cells(first, budget, cell).repartition(parts, "turn", "cell", "i", "j").mapInArrow(run, f"u long, v long, first_u {kind}, first_v {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of all nodes with an edge (u, v) but the roots.

    Star rounds shrink the graph until LOCAL edges are left, which one task unites.
    """
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now["n"] <= LOCAL:
            return united(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = checkpoint(small.distinct())


def united(edges: DataFrame) -> DataFrame:
    """``components`` of at most LOCAL edges, in one task. Nodes are numbers, or structs that
    order by their fields."""
    kind = edges.schema["u"].dataType
    fields = kind.names if isinstance(kind, T.StructType) else [""]
    at = lambda end, f: F.col(f"{end}.{f}" if f else end)
    types = [(kind[f].dataType if f else kind).simpleString() for f in fields]
    schema = ", ".join(f"{end}{i} {t}" for end in ("node", "root") for i, t in enumerate(types))

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _read(batches)) is None:
            return
        both = [pa.chunked_array([*table.column(f"u{i}").chunks, *table.column(f"v{i}").chunks]).combine_chunks() for i in range(len(fields))]
        keys = []
        for column in both:  # nulls sort as the least value; a field before tells them apart
            plain = pa.compute.fill_null(column, "" if pa.types.is_string(column.type) else False if pa.types.is_boolean(column.type) else 0)
            keys.append(plain.to_numpy(zero_copy_only=False))
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        label = unite(np.arange(int(new.sum())), rank[: len(table)], rank[len(table) :])
        place = order[new]  # a row of each node
        nodes = np.flatnonzero(label != np.arange(len(label)))
        columns = [c.take(pa.array(place[x])) for x in (nodes, label[nodes]) for c in both]
        names = [f"{end}{i}" for end in ("node", "root") for i in range(len(fields))]
        yield from pa.Table.from_arrays(columns, names=names).to_batches(1 << 16)

    flat = edges.select(*(at(end, f).alias(f"{end}{i}") for end in ("u", "v") for i, f in enumerate(fields)))
    found = flat.coalesce(1).mapInArrow(run, schema)
    whole = lambda end: F.struct(*(F.col(f"{end}{i}").alias(f) for i, f in enumerate(fields))) if fields != [""] else F.col(f"{end}0")
    return checkpoint(found.select(whole("node").alias("node"), whole("root").alias("root")))


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, budget: int = BUDGET, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id, the smallest id reachable.

    Nodes order by id, those without last, so a component's root bears its name and no row
    has to travel to its root's task.
    """
    prints = checkpoint(fingerprints(docs, words, seed, id_col, text_col))
    first = checkpoint(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")))
    end = lambda x: F.struct(F.col(f"first_{x}").isNull().alias("unnamed"), F.col(f"first_{x}").alias("first"), F.col(x).alias("fp")).alias(x)
    linked = components(links(first, budget, cell).select(end("u"), end("v"))).select(F.col("node.fp").alias("fp"), F.col("root.first").alias("name"), F.lit(True).alias("linked"))
    names = first.join(linked, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("name")).otherwise(F.col("first")).alias("component_id"))
    return join_spread(prints, names, ["fp"], id_col).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies: wide fingerprints, whole shingle sets decide ---------------------------


def shingles(text: str, words: int = WIDE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (A-Z lower-cased, ASCII white space)."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h, k = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), min(words, len(w))
    n = len(w) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WIDE bits as uint64 words: set in over half the hashes of the shingles, each hashed
    to as many words."""
    counts = np.zeros(WIDE, np.int64)
    seeds = (np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(found), 255 * 32):  # 255 ones fit a byte
        h = found[at : at + 255 * 32, None] + seeds
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):
            counts += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(found)).view(np.uint64)


def draws(rotations: int) -> np.ndarray:
    """The 64 bits that lead in each rotation, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(WIDE)[:64] for _ in range(rotations)])


def _lead(plain: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen 64 bits of each row of bits, as one number."""
    return np.ascontiguousarray(np.packbits(plain[:, chosen], axis=1)).view(">u8").astype(np.uint64).ravel()


def rotations(n: int, similar: float = SIMILAR) -> tuple[int, int]:
    """Bits of a cell and number of rotations for n texts: a bit of two texts differs with
    the chance of the angle between their shingle vectors."""
    bits = min(32, max(2, math.ceil(math.log2(max(n, 1) / CROWD))))
    alike = (1 - math.acos(2 * similar / (1 + similar)) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-alike))


def node(text_col: str = "text") -> Column:
    return F.xxhash64(text_of(text_col))


def wide_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """node and words (array of longs) of every distinct text."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(shingles(x.as_py())).view(np.int64).tolist() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "words"])

    made = docs.select(node(text_col).alias("node"), text_of(text_col).alias("text")).mapInArrow(run, "node long, words array<long>")
    return made.groupBy("node").agg(F.first("words").alias("words"))


def _wide_cells(prints: DataFrame, bits: int, turns: int) -> DataFrame:
    """(fp, words) once for each rotation, with its cell."""
    lead = draws(turns)

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                plain = np.unpackbits(batch.column("words").flatten().to_numpy().view(np.uint8).reshape(len(batch), WIDE // 8), axis=1)
                for turn in range(turns):
                    key = _lead(plain, lead[turn])
                    cell = (key >> np.uint64(64 - bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("words"), pa.array(np.full(len(batch), turn, np.int32)), pa.array(cell)], names=["fp", "words", "turn", "cell"])

    return prints.select("node", "words").mapInArrow(run, "fp long, words array<long>, turn int, cell long")


def meetings(prints: DataFrame, bits: int, turns: int, cell: int = CELL) -> DataFrame:
    """A spanning forest (u, v) in each task of all texts that meet in a cell within
    WIDE_BUDGET bits; none is left out for others that are nearer."""
    lead = draws(turns)

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _read(batches)) is None:
            return
        col = {c: table.column(c).to_numpy() for c in ("fp", "turn", "cell", "i", "j", "is_i")}
        words = table.column("words").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), WIDE // 64)
        key = np.zeros(len(words), np.uint64)
        for turn in np.unique(col["turn"]).tolist():
            for at in np.array_split(rows := np.flatnonzero(col["turn"] == turn), len(rows) // 65_536 + 1):
                key[at] = _lead(np.unpackbits(words[at].view(np.uint8), axis=1), lead[turn])
        node, place = np.unique(col["fp"], return_inverse=True)
        label = np.arange(len(node))
        for i, j in _join_cells(col, key, KEY_BUDGET):
            apart = label[place[i]] != label[place[j]]
            i, j = i[apart], j[apart]
            far = np.zeros(len(i), np.int64)
            for w in range(WIDE // 64):
                far += np.bitwise_count(words[i, w] ^ words[j, w])
            near = far <= WIDE_BUDGET
            label = unite(label, place[i[near]], place[j[near]])
        u = np.flatnonzero(label != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[label[u]])], names=["u", "v"])

    spread = _split_cells(_wide_cells(prints, bits, turns), cell)
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() * turns // TASK_ROWS + 1)
    return spread.repartition(parts, "turn", "cell", "i", "j").mapInArrow(run, "u long, v long").distinct()


def _sets(docs: DataFrame, zones: DataFrame, text_col: str) -> DataFrame:
    """node, zone, n and held: the shingle set of every text of a zone, once. A text without
    words has a member that stands for that."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s if len(s) else np.zeros(1, np.uint64) for s in (shingles(x.as_py()) for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "zone", "n", "held"])

    texts = docs.select(node(text_col).alias("node"), text_of(text_col).alias("text")).join(zones, "node").dropDuplicates(["node"])
    return texts.select("node", "zone", "text").mapInArrow(run, "node long, zone long, n long, held binary")


def near_copies(docs: DataFrame, similar: float = SIMILAR, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, node (hash of the text) and component_id, the smallest id reachable through
    texts whose five-word shingle sets are similar.

    Texts that meet in cells make zones, and within a zone all whole sets are compared.
    """
    from grafwerk.llm import minhash

    prints = checkpoint(wide_fingerprints(docs, text_col))
    zones = components(meetings(prints, *rotations(prints.count(), similar), cell))
    zones = zones.union(zones.select("root", "root").distinct()).toDF("node", "zone")
    least = Fraction(str(similar))
    roots = components(minhash.links(checkpoint(_sets(docs, zones, text_col)), 100 * least.numerator, 100 * least.denominator))
    roots = checkpoint(roots.union(roots.select("root", "root").distinct()))
    named = docs.select(id_col, node(text_col).alias("node"))
    firsts = named.groupBy("node").agg(F.min(id_col).alias("first"), F.count("*").alias("n")).join(roots, "node", "left").select("node", "first", "n", "root")
    alone, linked = firsts.where("root is null").select("node", "first", "n"), firsts.where("root is not null")
    # the members of a large group look up its name, and copies that of their text, in many places
    name = linked.groupBy("root").agg(F.min("first").alias("name"), F.count("*").alias("n"))
    found = join_spread(linked.select("root", "node", F.col("n").alias("copies")), name, ["root"], "node").select("node", "name", "copies")
    return join_spread(named, alone.union(found).toDF("node", "component_id", "n"), ["node"], id_col).select(id_col, "node", "component_id")
