"""Byte-level BPE as a streaming transducer with a bounded lookahead.

Encoding never needs a whole text. Text is cut into pre-tokens while it streams by,
and a pre-token that is itself longer than the window is encoded piecewise:
``sufficient_lookahead`` derives from the merge list how many bytes after a token
boundary can still influence it, so every token that ends that far before the end of
the buffer is final and leaves the encoder at once.

Why the bound holds. Run the merges in rank order over a buffer and over the buffer
with more bytes after it. Both runs agree left of some frontier, at first the buffer's
end. Rule ``(a, b)`` moves the frontier left, by ``len(a)``, only if the token left of
it is ``a`` in both runs and the token right of it is ``b`` in one of them. After an
earlier move by rule ``(a', b')`` the token right of the frontier starts with ``a'`` on
its left spine. The largest travel is therefore the heaviest chain of rules in rank
order in which each rule's right part has the previous rule's left part on its left
spine, which one pass over the merges finds.

Decoding feeds token bytes through an incremental UTF-8 state machine; a character that
spans tokens or chunks comes out whole, an invalid sequence as U+FFFD.

Defined results: a null text is an empty one (no tokens, empty text); special strings
inside a text become their ids; columns other than the id and the text are ignored, so
extra columns cannot clash; repeated rows and null ids yield one row each.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from grafwerk.llm.shared import lean

#: The pre-token pattern and white space of the byte-level scheme.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def quick_token(letter: str, number: str, space: str) -> re.Pattern:
    """PRE_TOKEN for the standard library's faster engine, with these characters of each kind."""
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def of_category(first: str) -> str:
    """Ranges of the characters up to U+FFFF whose category begins with a letter."""
    own = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == first]
    starts = [c for a, c in zip([-2, *own], own) if c != a + 1]
    ends = [c for c, b in zip(own, [*own[1:], -2]) if b != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


#: Characters encoded at once; pre-tokens kept in a generation of the cache.
FEED, CACHE = 1 << 20, 300_000
_NEVER, _NONE = 1 << 60, np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes beyond a token boundary that can still move it; see the module's proof.

    Raises ValueError for a list in which a rule's part is made by a later rule, as rank
    order and stage order would then differ.
    """
    left: dict[bytes, bytes] = {}
    heaviest: dict[bytes, int] = {}
    most = 0
    for a, b in merges:
        if any(len(x) > 1 and x not in left for x in (a, b)):
            raise ValueError("a merge uses a token that no earlier merge makes")
        reach, x = 0, b
        while x:
            reach = max(reach, heaviest.get(x, 0))
            x = left.get(x, b"")
        heaviest[a] = max(heaviest.get(a, 0), len(a) + reach)
        most = max(most, heaviest[a])
        left.setdefault(a + b, a)
    return most


class Vocabulary:
    """Merges, ids and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"] if all(c in alphabet for c in t)}
        ids = {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        merges = [(raw[a], raw[b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.lookahead = sufficient_lookahead(merges)
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.rank = {ids[a] * self.size + ids[b]: r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [ids[a + b] for a, b in merges]
        self.token = [b""] * self.size
        for t, i in ids.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.digits = [str(i) for i in range(self.size)]
        self.byte_table, self.made_table = np.array(self.byte_ids, np.int32), np.array([*self.made, 0], np.int32)
        self.tables = self._pair_tables()

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: lowest rank first, leftmost among equals."""
        if len(piece) > 96:
            return self._merge_long(piece)
        ids, size, rank, made = [self.byte_ids[b] for b in piece], self.size, self.rank.get, self.made
        ranks = [rank(a * size + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == _NEVER:
                break
            i = ranks.index(r)
            new = ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + new, _NEVER)
            if i < len(ranks):
                ranks[i] = rank(new * size + ids[i + 1], _NEVER)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """``merge`` over a linked list and a heap, for windows of long pre-tokens."""
        n, size, rank = len(piece), self.size, self.rank.get
        ids: list[int] = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1], _NEVER)) < _NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank(ids[x] * size + ids[y], _NEVER)) < _NEVER:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


    def _pair_tables(self) -> list[tuple[np.ndarray, np.ndarray, np.uint64, np.uint64]]:
        """Hash tables without collisions inside each: pair keys, ranks, factor, shift."""
        keys = np.fromiter(self.rank.keys(), np.uint64, len(self.rank))
        ranks = np.fromiter(self.rank.values(), np.int32, len(self.rank))
        tables, bits, factor = [], 18, 0x9E3779B97F4A7C15
        while len(keys):
            at = (keys * np.uint64(factor)) >> np.uint64(64 - bits)
            held, held_ranks = np.full(1 << bits, np.iinfo(np.uint64).max), np.full(1 << bits, _NONE, np.int32)
            _, first = np.unique(at, return_index=True)
            held[at[first]], held_ranks[at[first]] = keys[first], ranks[first]
            tables.append((held, held_ranks, np.uint64(factor), np.uint64(64 - bits)))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, factor, bits = keys[rest], ranks[rest], (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1, 15
        return tables

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) * np.uint64(self.size) + b.astype(np.uint64)
        out = np.full(keys.shape, _NONE, np.int32)
        for held, ranks, factor, shift in self.tables:
            at = (keys * factor) >> shift
            np.minimum(out, np.where(held[at] == keys, ranks[at], _NONE), out=out)
        out[(a < 0) | (b < 0)] = _NONE
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of many pre-tokens; those of like length merge side by side."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        lower = 0
        for upper in (6, 9, 12, 16, 24, 40, 72):
            for at in np.array_split(rows := np.flatnonzero((lengths > lower) & (lengths <= upper)), len(rows) // 20_000 + 1):
                if len(at):
                    ids, n = self._merge_block([words[i] for i in at], lengths[at], upper)
                    for i, row, k in zip(at.tolist(), ids, (4 * n).tolist()):
                        out[i] = row.tobytes()[:k]
            lower = upper
        for i in np.flatnonzero(lengths > lower).tolist():
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        return out

    def _merge_block(self, words: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.byte_table[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)].reshape(-1, width)
        column = np.arange(width)
        ids[column >= n[:, None]] = -1
        done, ended = ids, n.copy()
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        while True:
            best = ranks.argmin(1)
            lowest = ranks[np.arange(len(ranks)), best]
            if not (go := lowest < _NONE).all():
                done[live[~go]] = ids[~go]
                live, ids, ranks, best, lowest = live[go], ids[go], ranks[go], best[go], lowest[go]
            if not len(live):
                return done.astype("<u4"), ended
            row = np.arange(len(live))
            ids = np.where(column > best[:, None], np.pad(ids[:, 1:], ((0, 0), (0, 1)), constant_values=-1), ids)
            ids[row, best] = new = self.made_table[lowest]
            ranks = np.where(column[:-1] > best[:, None], np.pad(ranks[:, 1:], ((0, 0), (0, 1)), constant_values=_NONE), ranks)
            ended[live] -= 1
            after = ids[row, np.minimum(best + 1, width - 1)]
            right = self._ranks(new, np.where(best + 1 < width, after, -1))
            inside = best < width - 1
            ranks[row[inside], best[inside]] = right[inside]
            some = best > 0
            ranks[row[some], best[some] - 1] = self._ranks(ids[row[some], best[some] - 1], new[some])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Cutter:
    """Streaming text to pre-tokens, with less than FEED plus one window of text held.

    ``push`` returns the pre-tokens that no further text can change. Of a pre-token longer
    than the window, the ids that the lookahead proves final come out as bytes instead.
    """

    _exact = regex.compile(PRE_TOKEN)
    _ascii = quick_token("A-Za-z", "0-9", "\\t-\\r ")
    _plane = quick_token(of_category("L"), of_category("N"), SPACE)
    _beyond = re.compile("[\U00010000-\U0010ffff]")
    _kinds = tuple(regex.compile(k) for k in (r"\p{L}+", r"\p{N}+", rf"[^{SPACE}\p{{L}}\p{{N}}]+"))
    _blanks = regex.compile(rf"[{SPACE}]+")

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.window = vocab, max(4 * vocab.lookahead, 1024)
        self._special = re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        self._text, self._open, self._kind = "", b"", None

    def _find(self, text: str) -> list[str]:
        kind = self._ascii if text.isascii() else self._exact if self._beyond.search(text) else self._plane
        return kind.findall(text)

    def push(self, text: str, last: bool = False) -> list[str | bytes]:
        out: list[str | bytes] = []
        text, self._text = self._text + text, ""
        if self._special:
            at = 0
            for found in self._special.finditer(text):
                out += self._segment(text[at : found.start()], True)
                out.append(found[0])
                at = found.end()
            text = text[at:]
        keep = 0 if last else max((k for s in self.vocab.special for k in range(1, len(s)) if text.endswith(s[:k])), default=0)
        out += self._segment(text[: len(text) - keep], last)
        self._text += text[len(text) - keep :]
        return out

    def _segment(self, text: str, last: bool) -> list[str | bytes]:
        """Text up to a special string or the end (last), or to the end of what has come."""
        out: list[str | bytes] = []
        if self._kind is not None:
            run = self._kind.match(text)
            more, text = (run[0], text[run.end() :]) if run else ("", text)
            if self._kind is self._blanks and more and (text or not last):
                more, text = more[:-1], more[-1] + text  # the last blank may belong to what follows
                if len(text) == 1 and not last:
                    out.append(self._grow(more.encode()))
                    self._text = text
                    return out
            out.append(self._grow(more.encode()))
            if not text and not last:
                return out
            out.append(np.array(self.vocab.merge(self._open), "<u4").tobytes())
            self._open, self._kind = b"", None
        parts = self._find(text)
        if not last:  # the last may go on, and it decides how white space before it is cut
            held = [parts.pop()] if parts else []
            while parts and (parts[-1].isspace() or parts[-1][-1] == "'"):
                held.append(parts.pop())
            self._text = "".join(reversed(held))
            body = self._text[self._text[:1] == " " and len(self._text) > 1 :]
            if len(body) > self.window and (kind := next((k for k in self._kinds if k.fullmatch(body)), None)):
                self._kind = kind
                parts.append(self._grow(self._text.encode()))
                self._text = ""
            elif len(self._text) > self.window and self._blanks.fullmatch(self._text):
                self._kind = self._blanks
                parts.append(self._grow(self._text[:-1].encode()))
                self._text = self._text[-1]
        return out + parts

    def _grow(self, more: bytes) -> bytes:
        """Ids of the open pre-token that end a lookahead or more before what has come."""
        self._open += more
        out: list[int] = []
        token, size = self.vocab.token, 16 * self.window
        while len(self._open) > self.window:
            buffer, end = self._open[:size], 0
            for i in self.vocab.merge(buffer):
                if end + len(token[i]) > len(buffer) - self.vocab.lookahead:
                    break
                out.append(i)
                end += len(token[i])
            self._open = self._open[end:]
        return np.array(out, "<u4").tobytes()


class Encoder:
    """Texts to ids: one ``Cutter`` per text, and the ids of pre-tokens seen before kept
    in two generations of bounded size; unseen ones are merged together, vectorised."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self._new: dict[str | bytes, bytes] = {}
        self._old: dict[str | bytes, bytes] = {}
        self._fixed = {s: i.to_bytes(4, "little") for s, i in vocab.special.items()}

    def _resolve(self, lists: list[list[str | bytes]]) -> list[bytes]:
        unseen = set(chain.from_iterable(lists)).difference(self._new)
        for w in [w for w in unseen if w in self._old or type(w) is bytes or w in self._fixed]:
            self._new[w] = w if type(w) is bytes else self._old.get(w) or self._fixed[w]
            unseen.discard(w)
        words = list(unseen)
        self._new.update(zip(words, self.vocab.merge_many([w.encode() for w in words])))
        out = [b"".join(map(self._new.__getitem__, x)) for x in lists]
        if len(self._new) > CACHE:
            self._old = {k: v for k, v in self._new.items() if len(k) <= 64}
            self._new = {}
        return out

    def batch(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(position of the text, ids, whether they are its last), in order.

        Texts are taken together up to FEED characters, longer ones in parts of FEED.
        """
        lists: list[list[str | bytes]] = []
        marks: list[tuple[int, bool]] = []
        held = 0
        for n, text in enumerate(texts):
            cutter = Cutter(self.vocab)
            for at in range(0, max(len(text), 1), FEED):
                last = at + FEED >= len(text)
                lists.append(cutter.push(text[at : at + FEED], last))
                marks.append((n, last))
                held += min(FEED, len(text) - at)
                if held >= FEED:
                    for (k, end), ids in zip(marks, self._resolve(lists)):
                        yield k, np.frombuffer(ids, "<u4"), end
                    lists, marks, held = [], [], 0
        for (k, end), ids in zip(marks, self._resolve(lists)):
            yield k, np.frombuffer(ids, "<u4"), end

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(x.tolist() for _, x, _ in self.batch([text])))


class Decoder:
    """Streaming ids to text: token bytes drive an incremental UTF-8 state machine."""

    def __init__(self, vocab: Vocabulary) -> None:
        self._bytes = vocab.token.__getitem__
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int], last: bool = False) -> str:
        return self._state.decode(b"".join(map(self._bytes, ids)), last)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file, with its cache."""
    return Encoder(vocabulary(path))


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns id_col, ``ids`` (array<int>, if keep_ids), ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by commas) and ``decoded_sha256``. One pass, no shuffle; a task
    holds one Arrow batch and one text's ids.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ("ids array<int>, " if keep_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        digits = enc.vocab.digits.__getitem__
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            ids_hash, text_hash, n, kept, dec = hashlib.sha256(), hashlib.sha256(), 0, [], Decoder(enc.vocab)
            for _, part, last in enc.batch(x.as_py() or "" for x in batch.column(1)):
                ids = part.tolist()
                ids_hash.update(("," * (n > 0 and len(ids) > 0) + ",".join(map(digits, ids))).encode())
                text_hash.update(dec.push(ids, last).encode())
                n += len(ids)
                if keep_ids:
                    kept.append(part)
                if last:
                    for c, v in zip(cols, (np.concatenate(kept) if kept else None, n, ids_hash.hexdigest(), text_hash.hexdigest())):
                        c.append(v)
                    ids_hash, text_hash, n, kept, dec = hashlib.sha256(), hashlib.sha256(), 0, [], Decoder(enc.vocab)
            kept_col = [pa.array(cols[0], pa.list_(pa.int32()))] if keep_ids else []
            names = ["id", *["ids"] * keep_ids, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept_col, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(tokens: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of every array of ids (null: empty)."""
    schema = f"id {tokens.schema[id_col].dataType.simpleString()}, text string"

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            texts = [Decoder(vocab).push(x.as_py() or [], True) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
