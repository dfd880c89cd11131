"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

Every word is hashed by XXH3, every window by two polynomials of its words' hashes. A task
first settles the windows that repeat among its own documents: all but those of the
smallest id are repeats whatever else exists, so a passage that a third of all documents
hold leaves a task once. The rest is sent by hash, packed into one byte string per task and
target (hash, document, position; about ten bytes a window), and there a window is a repeat
if a smaller id has it too. Repeats return to their document, overlapping ones merge into
maximal intervals, and the words outside stay. A target is the windows of ``TARGET`` bytes
of text; beyond ``MOST_PARTS`` targets a partition holds several and settles one at a time.

Windows match by a 64-bit hash within the target that the second hash chose, and words by
64 bits. With n windows, p targets and m different words about n^2 / (2^65 p) windows match
by chance and m^2 / 2^65 words: 0.00001 in the check's larger table, two windows of 3e13 at
100 TB with twelve million targets.

Defined results: null text has no words; fewer words than a window lose none; rows that
repeat a doc_id are one document to each other (none is the smaller) and each gets its own
result; rows with a null doc_id are compared with none and lose nothing. Extra columns pass
through, those that clash with added names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.shared import fresh, lean

#: Words of a window.
WINDOW = 13
#: Bytes hashed at once; windows settled at once; bytes of text whose windows go to a target;
#: partitions at most.
SLICE, SCOPE, TARGET, MOST_PARTS = 1 << 21, 1 << 19, 8 << 20, 20_000
_STEP, _STEP2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where the words of a byte array begin."""
    word = np.zeros(len(data) + 1, bool)
    word[1:] = ~_SPACE[data]
    return np.flatnonzero(word[1:] & ~word[:-1])


def word_hashes(data: np.ndarray) -> np.ndarray:
    """XXH3 of each word; bytes.split cuts at the same white space."""
    words = data.tobytes().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, window: int, step: int = _STEP) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of every run of ``window`` hashed words."""
    n = len(words) - window + 1
    h = words[:n].copy()
    for k in range(1, window):
        h = h * np.uint64(step) + words[k : k + n]
    return _mix(h)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of like significance side by side, which compress where the high ones are zero."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplane(raw: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    part = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(part.T).view(kind).reshape(n), at + n * size


def _pack(ids: np.ndarray, signs: np.ndarray, row: np.ndarray, position: np.ndarray, hashes: np.ndarray | None = None) -> bytes:
    """Places, or windows of one target, in (row, position) order; ids and signs by row."""
    rows, first, count = np.unique(row, return_index=True, return_counts=True)
    gap = np.diff(position, prepend=0)
    gap[first] = position[first]
    parts = [np.array([len(rows), len(row)], "<i8").tobytes(), _planes(ids[rows].astype("<i8")), _planes(signs[rows].astype("<i8")), _planes(count.astype("<i4")), _planes(gap.astype("<i4"))]
    return b"".join(parts if hashes is None else [*parts, hashes.tobytes()])


def _unpack(raw: bytes, hashed: bool = True) -> tuple[np.ndarray, ...]:
    rows, n = np.frombuffer(raw, "<i8", 2).tolist()
    ids, at = _unplane(raw, 16, rows, "<i8")
    signs, at = _unplane(raw, at, rows, "<i8")
    count, at = _unplane(raw, at, rows, "<i4")
    gap, at = _unplane(raw, at, n, "<i4")
    first = np.cumsum(count) - count
    position = np.cumsum(gap)
    position -= np.repeat(position[first] - gap[first], count)
    places = np.repeat(ids, count), np.repeat(signs, count), position
    return (*places, np.frombuffer(raw, "<u8", n, at)) if hashed else places


def _by_document(ids: np.ndarray, signs: np.ndarray, position: np.ndarray, n_targets: int) -> Iterator[tuple[int, bytes]]:
    """Places packed for the target that their document's id chooses."""
    home = (_mix(ids.astype(np.uint64)) % np.uint64(n_targets)).astype(np.int64)
    order = np.lexsort([position, signs, ids, home])
    home, ids, signs, position = home[order], ids[order], signs[order], position[order]
    row = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]) | (signs[1:] != signs[:-1])]))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    edges = np.flatnonzero(np.diff(home, prepend=-1)).tolist()
    for a, b in zip(edges, [*edges[1:], len(home)]):
        yield int(home[a]), _pack(ids[first], signs[first], row[a:b], position[a:b])


_SCHEMA, _NAMES = "target int, settled boolean, payload binary", ["target", "settled", "payload"]


def _sent(rows: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64]), (pa.int32(), pa.bool_(), pa.binary()))], names=_NAMES)


def _settle(ids: np.ndarray, signs: np.ndarray, row: np.ndarray, position: np.ndarray, hashes: np.ndarray, targets: np.ndarray, n_targets: int) -> Iterator[pa.RecordBatch]:
    """Repeats inside the scope as rows of their document, the rest packed by target."""
    order = np.lexsort([ids[row], hashes])
    h, doc = hashes[order], ids[row][order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    smallest = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
    repeat = np.zeros(len(row), bool)
    repeat[order] = doc > smallest
    out = [(home, True, raw) for home, raw in _by_document(ids[row[repeat]], signs[row[repeat]], position[repeat], n_targets)] if repeat.any() else []
    kept = np.flatnonzero(~repeat)
    kept = kept[np.argsort(targets[kept], kind="stable")]
    edges = np.flatnonzero(np.diff(targets[kept], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(kept)]):
        w = kept[a:b]
        out.append((int(targets[w[0]]), False, _pack(ids, signs, row[w], position[w], hashes[w])))
    yield from _sent(out)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes, and where each value begins and the last ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = texts.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each, so that no word spans two; where each begins."""
    out = np.full(len(data) + len(at) - 1, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = data
    return out, at + np.arange(len(at))


def removals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sign, starts (packed): the first words of every window that a smaller id has too."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("sign"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_targets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TARGET + 1)
    parts = min(n_targets, MOST_PARTS)

    def dealt(sent: DataFrame) -> DataFrame:
        """Targets together; in turn, where a partition has several."""
        sent = sent.repartitionById(parts, (F.col("target") % parts).cast("int"))
        return sent if parts == n_targets else sent.sortWithinPartitions("target")

    @lean
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = n_rows = 0
        for batch in batches:
            whole, at = _text_bytes(batch.column(2))
            ids, signs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at[1:] // SLICE)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):  # a few MB at a time
                if a == b:
                    continue
                data, begin = _spaced(whole[at[a] : at[b]], at[a : b + 1] - at[a])
                starts = word_starts(data)
                if len(starts) >= window:
                    words = word_hashes(data)
                    row = np.searchsorted(begin, starts, "right") - 1
                    n = len(words) - window + 1
                    inside = row[:n] == row[window - 1 :]
                    position = np.arange(len(words)) - np.searchsorted(row, row)
                    held.append((ids[a:b], signs[a:b], row[:n][inside] + n_rows, position[:n][inside], window_hashes(words, window)[inside], (window_hashes(words, window, _STEP2)[inside] % np.uint64(n_targets)).astype(np.int32)))
                else:
                    held.append((ids[a:b], signs[a:b], *(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int32))))
                n_held, n_rows = n_held + len(held[-1][2]), n_rows + b - a
                if n_held >= SCOPE:
                    yield from _settle(*map(np.concatenate, zip(*held)), n_targets)
                    held, n_held, n_rows = [], 0, 0
        if n_held:
            yield from _settle(*map(np.concatenate, zip(*held)), n_targets)

    def repeats(packed: list[pa.Scalar]) -> Iterator[pa.RecordBatch]:
        """Places of the windows of one target that a smaller id has too, by document."""
        ids, signs, position, hashes = map(np.concatenate, zip(*[_unpack(x.as_py()) for x in packed]))
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        del hashes
        again = np.concatenate([[False], h[1:] == h[:-1]])
        again[:-1] |= again[1:]
        order, h = order[again], h[again]  # hashes that occur more than once
        if not len(order):
            return
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(ids[order], begin), np.diff(np.append(begin, len(order))))
        order = order[ids[order] > smallest]
        for home, raw in _by_document(ids[order], signs[order], position[order], n_targets) if len(order) else ():
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([raw], pa.binary())], names=["target", "payload"])

    @lean
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            settled = batch.filter(batch.column("settled"))
            if len(settled):
                yield settled.select(["target", "payload"])
            open_ = batch.filter(pa.compute.invert(batch.column("settled")))
            for target, payload in zip(open_.column("target").to_pylist(), open_.column("payload")):
                if target != at and held:
                    yield from repeats(held)
                    held = []
                at = target
                held.append(payload)
        if held:
            yield from repeats(held)

    def merged(packed: list[pa.Scalar]) -> Iterator[pa.RecordBatch]:
        """One row per document of one target."""
        i, s, p = map(np.concatenate, zip(*[_unpack(x.as_py(), False) for x in packed]))
        order = np.lexsort([p, s, i])
        i, s, p = i[order], s[order], p[order].astype("<i4")
        edge = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1])]))
        to = np.append(edge[1:], len(p))
        for a in range(0, len(edge), 1024):
            part = slice(a, a + 1024)
            yield pa.RecordBatch.from_arrays([pa.array(i[edge[part]]), pa.array(s[edge[part]]), pa.array([p[x:y].tobytes() for x, y in zip(edge[part], to[part])], pa.binary())], names=["id", "sign", "starts"])

    @lean
    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for target, payload in zip(batch.column("target").to_pylist(), batch.column("payload")):
                if target != at and held:
                    yield from merged(held)
                    held = []
                at = target
                held.append(payload)
        if held:
            yield from merged(held)

    met = dealt(rows.mapInArrow(send, _SCHEMA)).mapInArrow(meet, "target int, payload binary")
    return dealt(met).mapInArrow(gather, "id long, sign long, starts binary")


def dedup_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``text_col`` replaced by the words that stay, joined by blanks,
    n_words and n_removed (words)."""
    found = removals(docs, window, id_col, text_col)
    added = ("n_words", "n_removed")
    rest = [c for c in docs.columns if c not in added and c != text_col]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole, mark, sign, places = fresh(docs, "whole", "mark", "sign", "places")
    left = docs.select(*rest, text.alias(whole), F.col(id_col).cast("long").alias(mark), F.xxhash64(text).alias(sign))
    found = found.select(F.col("id").alias(mark), F.col("sign").alias(sign), F.col("starts").alias(places))
    joined = left.join(found, [mark, sign], "left").select(*rest, whole, places)

    @lean
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, packed in zip(batch.column(len(rest)), batch.column(len(rest) + 1)):
                words = text.as_py().encode().split()
                n_words.append(len(words))
                if packed.is_valid:
                    starts = np.frombuffer(packed.as_py(), "<i4")
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    n_removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(rest))), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*rest, text_col, *added])

    return joined.mapInArrow(cut, f"{fields}, `{text_col}` string, n_words long, n_removed long")
