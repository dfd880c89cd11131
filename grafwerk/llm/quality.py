"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts in the tasks; the trees are fitted on the driver from
a bounded sample of labelled rows (at most ``SAMPLE``, by a hash of the id), with features
cut into ``BINS`` quantile bins and gradients summed by bin, then flattened into arrays that
numpy walks for all documents of a batch and all trees at once. Only the text is looked at.

Defined results: a null text is an empty one, which has all-zero statistics and a score like
any other; without labels, or with one label only, every score is the labels' mean (0.5
without any); null ids are scored, are not held out and never trained on; of rows that
repeat an id in the labels the smaller label counts, of documents that do so the smallest
statistics. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.shared import checkpoint, lean, sampled

#: Labelled rows to fit on at most; bins of a feature; trees, their depth, step and penalty.
SAMPLE, BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 20_000, 64, 80, 4, 0.15, 1.0, 20
FEATURES = ("log_chars", "log_words", "word_length", "upper", "digit", "blank", "line_break", "stop", "mark", "symbol", "pipe", "shout", "beyond_ascii", "distinct_words", "distinct_lines", "words_per_line", "repeats", "log_long_word")


def _kinds() -> np.ndarray:
    """Kind of each byte, the column of FEATURES that counts it (0: none)."""
    kind = np.zeros(256, np.int64)
    for name, chars in {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line_break": b"\n\r", "stop": b".,;:", "mark": b"\"'()-?/", "symbol": b"#$%&*+<=>@[\\]^_`{}~", "pipe": b"|", "shout": b"!"}.items():
        kind[list(chars)] = FEATURES.index(name)
    kind[0xC0:] = FEATURES.index("beyond_ascii")
    return kind


_KIND = _kinds().astype(np.uint8)


def statistics(text: str) -> list[float]:
    """The FEATURES of one whole text."""
    out = [0.0] * len(FEATURES)
    raw = text.encode()
    if not raw:
        return out
    counts = np.zeros(len(FEATURES), np.int64)
    for at in range(0, len(raw), 1 << 20):
        counts += np.bincount(_KIND[np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - at), at)], minlength=len(FEATURES))
    n = len(text)
    for i in range(FEATURES.index("upper"), FEATURES.index("beyond_ascii") + 1):
        out[i] = counts[i] / n
    words, lines = raw.split(), raw.split(b"\n")
    w = max(len(words), 1)
    own = {
        "log_chars": math.log1p(n),
        "log_words": math.log1p(len(words)),
        "word_length": n / w,
        "distinct_words": len(set(words)) / w,
        "distinct_lines": len(set(lines)) / len(lines),
        "words_per_line": len(words) / len(lines),
        "repeats": sum(map(bytes.__eq__, words, words[1:])) / w,
        "log_long_word": math.log1p(max(map(len, words), default=0)),
    }
    for k, v in own.items():
        out[FEATURES.index(k)] = v
    return out


@dataclass(frozen=True)
class Trees:
    """Flattened trees: node i sends a row left if feature[i] <= cut[i]; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(rows), self.base)
        if len(self.roots) and len(rows):
            node = np.tile(self.roots, (len(rows), 1))
            line = np.arange(len(rows))[:, None]
            for _ in range(DEPTH):
                node = np.where(rows[line, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node].sum(1)
        return 1 / (1 + np.exp(-total))


def fit_trees(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Logistic boosting with second-order leaves on binned features."""
    mean = labels.mean() if len(labels) else 0.5
    empty = np.zeros(0, np.int64)
    if not len(labels) or not 0 < mean < 1:
        return Trees(empty, empty.astype(float), empty, empty, empty.astype(float), empty, float(np.clip(math.log(max(mean, 1e-9) / max(1 - mean, 1e-9)), -20, 20)))
    base = math.log(mean / (1 - mean))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], 1)
    score = np.full(len(rows), base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for x, v in ((feature, 0), (cut, 0.0), (value, 0.0)):
            x.append(v)
        left.append(len(left))
        right.append(len(right))
        return len(left) - 1

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = labels - p, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(len(rows)))]
        for depth in range(DEPTH + 1):
            below = []
            for at, members in level:
                g, h = grad[members], hess[members]
                best, where = 1e-6, None
                if depth < DEPTH and len(members) >= 2 * LEAST:
                    whole = g.sum() ** 2 / (h.sum() + RIDGE)
                    for f in range(binned.shape[1]):
                        b = binned[members, f]
                        gl, hl = np.cumsum(np.bincount(b, g, BINS))[:-1], np.cumsum(np.bincount(b, h, BINS))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                        gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - whole
                        gain[(nl < LEAST) | (len(members) - nl < LEAST)] = 0
                        i = int(gain[: len(cuts[f])].argmax()) if len(cuts[f]) else 0
                        if len(cuts[f]) and gain[i] > best:
                            best, where = gain[i], (f, i)
                if where is None:
                    value[at] = RATE * g.sum() / (h.sum() + RIDGE)
                    score[members] += value[at]
                    continue
                f, i = where
                feature[at], cut[at] = f, float(cuts[f][i])
                left[at], right[at] = node(), node()
                goes = binned[members, f] <= i
                below += [(left[at], members[goes]), (right[at], members[~goes])]
            level = below
    return Trees(*(np.array(x) for x in (feature, cut, left, right, value, roots)), base)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and features of every whole text."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(x.as_py() or "") for x in batch.column(1)], pa.list_(pa.float64()))], names=["id", "features"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on at most ``sample`` labelled rows that are not held out; broadcasts only these."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k"))
    known = known.groupBy("k").agg(F.min("y").alias("y"))
    n = known.count()
    chosen = checkpoint(known if n <= sample else sampled(known, n, int(0.97 * sample), "k"))  # a share that stays below
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")
    pairs = document_statistics(rows, "k", "t").join(F.broadcast(chosen.withColumnRenamed("k", "id")), "id")
    once = pairs.groupBy("id").agg(F.min(F.struct("features", "y")).alias("row")).select("id", "row.*")
    found = once.toPandas().sort_values("id", kind="stable")[:sample]
    return fit_trees(np.array(found["features"].tolist(), float).reshape(len(found), len(FEATURES)), found["y"].to_numpy(float))


def score_documents(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score; one pass without a shuffle. The trees are a few thousand numbers."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_py() or "") for x in batch.column(1)], float).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(rows))], names=["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_documents(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns as they were."""
    trees = fit(docs, labels, sample)
    names = docs.columns
    at = names.index("text")

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_py() or "") for x in batch.column(at)], float).reshape(len(batch), len(FEATURES))
            yield batch.filter(pa.array(trees.score(rows) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
