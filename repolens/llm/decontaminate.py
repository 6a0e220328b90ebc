"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to FEATURES; document frequencies are counted over all documents. The latent space comes from a randomised singular value decomposition of the TF-IDF rows of all passages, of the documents and of the benchmark. The hashed words are written once; a distributed pass over them sums sparse rows times a random matrix of signs; only this sketch, of bounded size, reaches the driver.
All windows of all documents (WINDOW words, half overlapping) are projected, and compared with every benchmark passage, in blocks, by cosine: the latent product over the window's full TF-IDF norm, held against what the passage itself keeps in the latent space. For what passes, the cosine of the TF-IDF rows themselves is computed (SHARED), unless the rare words that a window and a passage share, and the weight of all the window's other words, show that it's less. What is swamped by its surroundings (items much shorter than a window, rare words around them) comes from an index of each item's rarest words: so many that a place which passes the verification has one of them, and so many more that it has several. So the pairs found are those that the verification accepts at any window. Each candidate is verified by the longest common subsequence of the item's words with the words around the window, and by an answer check: half of the item's last words must be there too.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, lean

WORD = re.compile(r"[^\W_]+")
FEATURES = 1 << 17
WINDOW, BLOCK = 32, 16
RANK = 64
#: Columns of the sketch that the space is fitted by, as a multiple of its rank; columns that a passage counts in; features that are summed together.
SKETCH, SIGNS, PART = 2, 2, 2048
#: A window is a candidate if its cosine is at least this part of the passage's own.
COSINE = 0.45
#: Least cosine of the TF-IDF rows.
SHARED = 0.3
#: Part of an item's words that must be a common subsequence; part of the answer's.
SUBSEQUENCE, ANSWER = 0.7, 0.5
#: Tasks that sum what fits the space, and benchmark items that a task holds at a time: of more, each block takes a pass over the documents.
FIT_TASKS, ITEMS_AT_ONCE = 16, 4000
#: Benchmark passages and windows compared at a time, words projected at a time (at least one text).
QUERIES, WINDOWS, TOGETHER = 1024, 1024, 150_000
#: A word is rare if it's in at most this part of the passages compared at a time, or in two of them. What a bound in single precision may lack.
RARE, SLACK = 1 / 128, 1 - 1e-4
#: Of an item's rarest words so many more must occur than the one that the verification leaves no choice about; occurrences counted at a time (at least one item's).
MORE, OCCURRENCES = 4, 1 << 20
#: Characters of the texts, and of the words whose running sums are held, at a time (at least one text, one word): what a worker holds besides its tables, and the size of a row of hashed words.
PIECE = 1 << 18
#: Bytes of a row group of hashed words, which a task that reads them holds whole.
GROUP_BYTES = 4 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


#: An odd multiplier, and its inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def word_characters() -> np.ndarray:
    """Whether each code point is part of words, as in WORD."""
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalnum() for c in range(sys.maxunicode + 1)])


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of INVERSE, modulo 2^64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, m, np.uint64))]) for m in (BASE, INVERSE))


def word_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words of texts, in order, and the number of words of each text.

    A word's hash is a difference of two running sums over the characters, so no word is made as a string. Long texts are cut between words.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "replace"), np.uint32)
    inside = word_characters()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    feature, at = np.zeros(len(starts), np.int32), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
        a, b = starts[at], ends[to - 1]
        up, down = powers(max(PIECE, 1 << int(b - a).bit_length()))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((codes[a:b] + np.uint64(1)) * up[: b - a], out=total[1:])
        h = (total[ends[at:to] - a] - total[starts[at:to] - a]) * down[starts[at:to] - a]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        feature[at:to] = h >> np.uint64(64 - FEATURES.bit_length() + 1)
        at = to
    last = np.cumsum([len(t) + 1 for t in low])
    return feature, np.bincount(np.searchsorted(last, starts), minlength=len(texts))


def passage_spans(n: int) -> list[tuple[int, int]]:
    """Windows over n words: WINDOW long, starting at every BLOCK; a shorter text is one."""
    return [(k, min(n, k + WINDOW)) for k in range(0, max(1, n - BLOCK), BLOCK)]


def lcs(query: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the query."""
    at: dict[str, int] = {}
    for k, w in enumerate(query):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(query)) - 1
    v = full
    for w in words:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(query) - v.bit_count()


def portions(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """word_features of some texts at a time, in order."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size > PIECE:
            yield word_features(some)
            some, size = [], 0
    if some:
        yield word_features(some)


def blocks_of(f: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words in rows of BLOCK, each text from a new row, and a last row of padding (feature FEATURES); the rows before each text, the text of each row, and the two rows of each window. A window is a row and the next one of the same text; a text of one row has that and the padding."""
    count = -(-size // BLOCK)
    base = np.cumsum(count) - count
    blocks = int(count.sum())
    padded = np.full((blocks + 1) * BLOCK, FEATURES, np.int32)
    padded[np.repeat(base * BLOCK - (np.cumsum(size) - size), size) + np.arange(len(f))] = f
    text = np.repeat(np.arange(len(size)), count)
    begin = np.flatnonzero(np.append(text[1:] == text[:-1], False) | (count[text] == 1))
    then = np.where(count[text[begin]] == 1, blocks, begin + 1)
    return padded.reshape(-1, BLOCK), base, text, begin, then


def hashed(docs: DataFrame, text_col: str, tmp: Scratch, name: str) -> DataFrame:
    """The features of all texts, written once for the passes that need no text: a row for each portion (f, k: features and sizes as bytes; n, passages: their numbers), and one for each task with the documents that each feature occurs in (at, df)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("decontaminate", dict)
        df = np.zeros(FEATURES, np.int64)
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, types)], names)
        names, types = ["f", "k", "n", "passages", "at", "df"], [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for f, k in portions(batch.column("t").to_pylist()):
                for own in np.split(f, np.cumsum(k)[:-1]):
                    df[own] += 1  # a feature that repeats counts once
                count = -(-k // BLOCK)
                yield row(f.tobytes(), k.astype(np.int32).tobytes(), k.size, int(np.maximum(count - 1, count > 0).sum()), None, None)
        there = np.flatnonzero(df)
        yield row(None, None, 0, 0, there.tobytes(), df[there].tobytes())

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(work, "f binary, k binary, n long, passages long, at binary, df binary")
    return tmp.save(rows, name, **{"parquet.block.size": str(GROUP_BYTES), "parquet.enable.dictionary": "false"})


def document_frequency(features: DataFrame) -> np.ndarray:
    """Documents that each feature occurs in, over all documents. At most FEATURES rows reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("df").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(at, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["f", "n"])

    got = features.where("df is not null").select("at", "df").mapInArrow(rows, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES, np.int64)
    df[got.column("f").to_numpy()] = got.column("n").to_numpy()
    return df


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sketch(into: np.ndarray, padded: np.ndarray, begin: np.ndarray, then: np.ndarray, idf: np.ndarray, seed: int, weight: float) -> None:
    """Add the passages' rows times a sparse matrix of signs to into (size, FEATURES + 1). The SIGNS columns of a passage, and their signs, depend on its words alone. Passages are sorted by column, so that a column's part of the table stays in the processor's cache."""
    size, flat = len(into), into.reshape(-1)
    at = np.multiply.accumulate(np.full(2 * BLOCK, BASE, np.uint64))
    half = lambda m: ((padded.astype(np.uint64) + np.uint64(1)) * m).sum(1)
    h = mixed(half(at[:BLOCK])[begin] + half(at[BLOCK:])[then] + np.uint64(seed))
    w = idf[padded]
    norm = np.square(w).sum(1)
    scale = np.sqrt(weight / (SIGNS * (norm[begin] + norm[then]))).astype(np.float32)
    for _ in range(SIGNS):
        h = mixed(h + np.uint64(BASE))
        column = ((h >> np.uint64(33)) % np.uint64(size)).astype(np.int64)
        order = np.argsort(column, kind="stable")
        rows = np.stack([begin[order], then[order]], axis=1)
        signed = np.where(h & np.uint64(1), scale, -scale)[order]
        np.add.at(flat, (padded[rows] + (column[order] * (FEATURES + 1))[:, None, None]).reshape(-1), (w[rows] * signed[:, None, None]).reshape(-1))


def projected(padded: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of a table's rows over the words of each row of padded."""
    v = np.zeros((len(padded), table.shape[1]), np.float32)
    for column in padded.T:
        v += table[column]
    return v


def fit_latent_space(docs: DataFrame, items: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """(FEATURES, rank) right singular vectors of the TF-IDF rows of all passages of the documents and of the benchmark (both as hashed() writes them), by a randomised sketch of SKETCH * rank columns, whose own singular vectors are theirs, nearly. Each row has length 1, by the norm that the search uses; benchmark passages weigh so that they make up half the sum of squares."""
    size = SKETCH * rank
    idf = np.append(idf, np.float32(0))
    number = [int(x.agg(F.sum("passages")).first()[0] or 0) for x in (docs, items)]
    rows = docs.where("f is not null").select(F.lit(1.0).alias("weight"), "f", "k").unionByName(items.where("f is not null").select(F.lit(number[0] / number[1] if all(number) else 1.0).alias("weight"), "f", "k"))

    def packed(part: int, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The columns of a part that aren't zero, as half-precision parts of the greatest number: the sketch is random, and needs no more digits."""
        at = np.flatnonzero(z.any(0))
        if len(at):
            most = float(np.abs(z).max())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(at + part).astype(np.int32).tobytes()], pa.binary()), pa.array([most]), pa.array([(z[:, at].T / np.float32(most)).astype(np.float16).tobytes()], pa.binary())], ["part", "at", "most", "v"])

    def unpacked(at: bytes, most: float, v: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(at, np.int32), np.frombuffer(v, np.float16).reshape(-1, size).astype(np.float32) * np.float32(most)

    def sketched(batches):
        held("decontaminate", dict)
        z = np.zeros((size, FEATURES + 1), np.float32)
        for batch in batches:
            for weight, f, k in zip(*(batch.column(c).to_pylist() for c in ("weight", "f", "k"))):
                f, k = np.frombuffer(f, np.int32), np.frombuffer(k, np.int32).astype(np.int64)
                ends, at = np.cumsum(k), 0
                while at < len(k):
                    before = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
                    padded, _, _, begin, then = blocks_of(f[before : ends[to - 1]], k[at:to])
                    sketch(z, padded, begin, then, idf, seed, weight)
                    at = to
        for part in range(0, FEATURES, PART):
            yield from packed(part, z[:, part : min(part + PART, FEATURES)])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "most", "v"))):
                at, v = unpacked(*row)
                total.setdefault(part, np.zeros((size, PART), np.float32))[:, at - part] += v.T
        for part, z in total.items():
            yield from packed(part, z)

    schema = "part int, at binary, most double, v binary"
    # A table of FEATURES * size for each core is shuffled (34 MB), and one reaches the driver, whatever the size of documents and benchmark.
    parts = rows.coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism)).mapInArrow(sketched, schema).repartition(FIT_TASKS, "part").mapInArrow(summed, schema).toArrow()
    parts = list(zip(*(parts.column(c) for c in ("at", "most", "v"))))
    gram = np.zeros((size, size))
    for row in parts:
        v = unpacked(*(x.as_py() for x in row))[1].astype(np.float64)
        gram += v.T @ v
    values, vectors = (x[..., ::-1] for x in np.linalg.eigh(gram))
    kept = np.flatnonzero(values[:rank] > 1e-7 * max(values[0], 1e-30))
    turn = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    out = np.zeros((FEATURES, rank), np.float32)
    for row in parts:
        at, v = unpacked(*(x.as_py() for x in row))
        out[at, : len(kept)] = v @ turn
    return out


@dataclass
class Matcher:
    """Finds benchmark items in texts. items: (id, words)."""

    items: list[tuple[object, list[str]]]
    latent: np.ndarray  # idf-weighted rows
    idf2: np.ndarray

    def __post_init__(self):
        # The last row stands for the padding of blocks.
        self.latent = np.concatenate([self.latent, np.zeros((1, self.latent.shape[1]), np.float32)]).astype(np.float32)
        self.idf2 = np.append(self.idf2, 0).astype(np.float32)
        rows, owner = [], []
        for k, (_, words) in enumerate(self.items):
            for a, b in passage_spans(len(words)):
                rows.append(word_features([" ".join(words[a:b])])[0])
                owner.append(k)
        q = np.array([self.latent[f].sum(0) for f in rows], np.float32).reshape(len(rows), self.latent.shape[1])
        kept = np.linalg.norm(q, axis=1)
        full = np.sqrt([self.idf2[f].sum() for f in rows])
        # latent product / (window's norm * passage's latent norm) >= COSINE * (passage's latent norm / its norm)
        self.queries = (q / np.maximum(kept[:, None] ** 2 / np.maximum(full, 1e-9)[:, None], 1e-9)).astype(np.float32)
        self.owner, self.full = np.array(owner, np.int64), full.astype(np.float32)
        #: Of each block of passages: feature -> column (0: in none of them), and which passage has which; of rare words, feature -> number and place of the passages that follow; of the others, feature -> weight.
        self.has = []
        for k in range(0, len(rows), QUERIES):
            some = rows[k : k + QUERIES]
            column = np.zeros(FEATURES + 1, np.int32)
            there = np.unique(np.concatenate(some))
            column[there] = 1 + np.arange(len(there))
            has = np.zeros((len(some), len(there) + 1), bool)
            for j, f in enumerate(some):
                has[j, column[f]] = True
            many = has.sum(0) > max(2, RARE * len(some))
            _, passages = np.nonzero(has.T & ~many[:, None])
            number = np.where(many, 0, has.sum(0))
            self.has.append((column, has, number[column], (np.cumsum(number) - number)[column], passages, np.where(many[column], self.idf2, np.float32(0))))
        self.sets = [set(w) for _, w in self.items]
        # Of an item's distinct words the rarest, one more than may be missing: features -> items. Fewer features than words (shared ones) lower what a place must have.
        self.features, self.least, self.keys = [], [], {}
        #: Features of the rarest MORE and these, which of them are keys, their items, and how many must stand around a key.
        more: list[tuple[int, bool, int]] = []
        self.around = np.ones(len(self.items), np.int64)
        for k, own in enumerate(self.sets):
            f = word_features([" ".join(sorted(own))])[0]
            need = math.ceil(SUBSEQUENCE * len(own) - 1e-9)
            ordered = f[np.lexsort((f, -self.idf2[f]))]
            rarest = set(ordered[: len(own) - need + 1].tolist())
            for x in rarest:
                self.keys.setdefault(x, []).append(k)
            self.around[k] += min(MORE, need - 1)
            more += [(x, x in rarest, k) for x in sorted(set(ordered[: len(own) - need + int(self.around[k])].tolist()))]
            self.features.append(set(f.tolist()))
            self.least.append(need - (len(own) - len(self.features[-1])))
        self.more = tuple(np.array(x, t) for x, t in zip(zip(*more), (np.int64, bool, np.int64))) if more else (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        self.is_more = np.zeros(FEATURES, bool)
        self.is_more[self.more[0]] = True

    def places(self, f: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, position) of each occurrence of an item's key that has enough of the item's rarest words around it. A place that passes the verification has: of its item's rarest words no more may be missing than the keys without one."""
        at = np.flatnonzero(self.is_more[f])
        if not len(at):
            return
        at = at[np.argsort(f[at], kind="stable")]
        feature, key, item = self.more
        first = np.searchsorted(f[at], feature)
        number = np.searchsorted(f[at], feature, "right") - first
        there = np.flatnonzero(number)
        owner, ends = item[there], np.cumsum(size)
        length = np.array([len(words) for _, words in self.items])
        total, a = np.cumsum(number[there]), 0
        while a < len(there):
            # Whole items, in their order
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + OCCURRENCES, "right"))
            if b < len(there):
                b = int(np.searchsorted(owner, owner[b]))
            if b <= a:
                b = int(np.searchsorted(owner, owner[a], "right"))
            some, n = there[a:b], number[there[a:b]]
            position = at[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            k = np.repeat(item[some], n)
            order = np.sort(k * len(f) + position)
            of_key = np.repeat(key[some], n)
            position, k = position[of_key], k[of_key]
            text = np.searchsorted(ends, position, "right")
            reach = WINDOW + 2 * length[k]
            low, high = np.maximum(ends[text] - size[text], position - reach), np.minimum(ends[text], position + reach + 1)
            enough = np.searchsorted(order, k * len(f) + high) - np.searchsorted(order, k * len(f) + low) >= self.around[k]
            yield from zip(text[enough].tolist(), k[enough].tolist(), position[enough].tolist())
            a = b

    def may_hold(self, item: int, near: np.ndarray) -> bool:
        """Whether the features of so many words that verify() looks at are the item's."""
        return len(self.features[item].intersection(near.tolist())) >= self.least[item]

    def by_rarest(self, f: np.ndarray, size: np.ndarray, first_text: int) -> Iterator[tuple[int, int, int, None]]:
        """(text, item, first word of the window, None) of each window around which enough of the item's words may stand."""
        ends = np.cumsum(size)
        for d, k, p in self.places(f, size):
            n = int(size[d])
            begin = int(ends[d]) - n
            # Windows that begin in (p - reach, p + length] have the word in what verify() looks at.
            length = len(self.items[k][1])
            reach = WINDOW + length
            if self.may_hold(k, f[max(begin, p - reach - length) : min(begin + n, p + reach + length + 1)]):
                own = p - begin
                first = max(0, -(-(own - reach + 1) // BLOCK) * BLOCK)
                for start in range(first, min(own + length + 1, max(1, n - BLOCK)), BLOCK):
                    yield first_text + d, k, start, None

    def cosine(self, item: int, words: list[str], start: int) -> float:
        """The greatest latent cosine of a window with the item's passages, as a part of the passage's own."""
        f = word_features([" ".join(words[start : start + WINDOW])])[0]
        norm = max(float(np.sqrt(self.idf2[f].sum())), 1e-9)
        return max(0.0, float((self.queries[self.owner == item] @ self.latent[f].sum(0)).max()) / norm)

    def candidates(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, float | None]]:
        """(text, item, first word of the window, cosine as a part of the passage's own, or None if the item's rarest words led there)."""
        if not len(self.owner):
            return
        done = 0
        for f, size in portions(texts):
            at = 0
            ends = np.cumsum(size)
            while at < len(size):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
                yield from self._candidates(f[before : ends[to - 1]], size[at:to], done + at)
                yield from self.by_rarest(f[before : ends[to - 1]], size[at:to], done + at)
                at = to
            done += len(size)

    def _candidates(self, f: np.ndarray, size: np.ndarray, first_text: int) -> Iterator[tuple[int, int, int, float]]:
        if not len(f):
            return
        padded, base, text, begin, then = blocks_of(f, size)
        before = np.cumsum(size) - size
        v, norm = projected(padded, self.latent), self.idf2[padded].sum(1)
        v, norm = v[begin] + v[then], np.sqrt(norm[begin] + norm[then])
        for k in range(0, len(self.queries), QUERIES):
            column, has, number, place, passages, others = self.has[k // QUERIES]
            queries, full = np.ascontiguousarray(self.queries[k : k + QUERIES].T), self.full[k : k + QUERIES]
            for j in range(0, len(v), WINDOWS):
                cos, own = v[j : j + WINDOWS] @ queries, norm[j : j + WINDOWS]
                least = COSINE * np.maximum(own, np.float32(1e-9))
                words = np.concatenate([padded[begin[j : j + WINDOWS]], padded[then[j : j + WINDOWS]]], axis=1)
                # Pairs that share rare words, with their weight there; what all other words of a window weigh bounds what they add. Where these alone may be enough, every passage is held against that.
                at = np.flatnonzero(number[words])
                hit = words.reshape(-1)[at]
                n = number[hit]
                pair = np.repeat(at // words.shape[1] * len(full), n) + passages[np.repeat(place[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                near = cos.reshape(-1)[pair] >= least[pair // len(full)]
                pair, which = np.unique(pair[near], return_inverse=True)
                rare = np.bincount(which, np.repeat(self.idf2[hit], n)[near], len(pair))
                other = others[words].sum(1)
                pair = pair[rare + other[pair // len(full)] >= SLACK * SHARED * own[pair // len(full)] * full[pair % len(full)]]
                strong = np.flatnonzero(other >= SLACK * SHARED * own * full.min())
                w, q = np.nonzero((cos[strong] >= least[strong, None]) & (other[strong, None] >= SLACK * SHARED * own[strong, None] * full))
                pair = np.union1d(pair, strong[w] * len(full) + q)
                for g in range(0, len(pair), 65536):
                    x, y = np.divmod(pair[g : g + 65536], len(full))
                    shared = (has[y[:, None], column[words[x]]] * self.idf2[words[x]]).sum(1)
                    good = np.flatnonzero(shared >= SHARED * own[x] * full[y])
                    for x, y in zip(x[good].tolist(), y[good].tolist()):
                        b = int(begin[j + x])
                        d, item = int(text[b]), int(self.owner[k + y])
                        start, length = (b - int(base[d])) * BLOCK, len(self.items[item][1])
                        if self.may_hold(item, f[before[d] + max(0, start - length) : before[d] + min(int(size[d]), start + WINDOW + length)]):
                            yield first_text + d, item, start, float(cos[x, y] / own[x])

    def verify(self, item: int, words: list[str], start: int) -> tuple[float, float] | None:
        """Part of the item's words in a common subsequence with the words around a window, and part of its answer's."""
        query = self.items[item][1]
        near = words[max(0, start - len(query)) : start + WINDOW + len(query)]
        if len(self.sets[item].intersection(near)) < SUBSEQUENCE * len(self.sets[item]) - 1e-9:
            return None
        part = lcs(query, near) / len(query)
        answer = query[-max(1, min(len(query), max(3, len(query) // 5))) :]
        said = lcs(answer, near) / len(answer)
        return (part, said) if part >= SUBSEQUENCE and said >= ANSWER else None

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, cosine, subsequence, answer) of each item found in each text: the window of the largest cosine that holds, of latent candidates first."""
        by: dict[tuple[int, int], list[tuple[float, int]]] = {}
        others: dict[tuple[int, int], set[int]] = {}
        for d, item, start, cos in self.candidates(texts):
            places = by.setdefault((d, item), [])
            if cos is None:
                others.setdefault((d, item), set()).add(start)
            else:
                places.append((-cos, start))
        last, words = -1, []
        for (d, item), places in sorted(by.items()):
            if d != last:
                last, words = d, words_of(texts[d])
            for cos, start in sorted(places):
                if found := self.verify(item, words, start):
                    yield d, item, min(1.0, -cos), *found
                    break
            else:
                holds = [(self.cosine(item, words, start), -start, found) for start in others.get((d, item), ()) if (found := self.verify(item, words, start))]
                if holds:
                    cos, _, found = max(holds)
                    yield d, item, min(1.0, cos), *found


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK) -> DataFrame:
    """Pairs of documents and benchmark items that occur in them, whole or reworded: id_col, item_col, cosine, subsequence, answer.

    The benchmark is a stated query set. It is counted first; ITEMS_AT_ONCE items at a time, dealt by a hash, are held on the driver and in each worker, and documents are never shuffled. Null or empty texts and items match nothing; an item given twice with one id is found once for each different text, and equal rows once. Rows that repeat a document are each reported; a null doc_id is reported as null. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    lean(spark)
    given = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).distinct()
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, `{item_col}` {dict(benchmark.dtypes)[item_col]}, cosine double, subsequence double, answer double"
    number = given.count()
    if not number:
        return spark.createDataFrame([], schema)
    with Scratch(spark, "latent") as tmp:
        features = hashed(docs, text_col, tmp, "documents")
        n = int(features.agg(F.sum("n")).first()[0] or 0)
        idf = np.log((n + 1) / (document_frequency(features) + 0.5)).clip(0.01).astype(np.float32)
        latent = fit_latent_space(features, hashed(benchmark, item_text_col, tmp, "benchmark"), idf, rank)
    latent *= idf[:, None]
    item_type = benchmark.select(item_col).limit(0).toArrow().schema.field(0).type

    def search_for(items: list[tuple[object, list[str]]]) -> DataFrame:
        # FEATURES * rank * 4 bytes, 33 MB at any size of the corpus, and ITEMS_AT_ONCE items.
        matcher = spark.sparkContext.broadcast(Matcher(items, latent, idf * idf))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held("decontaminate", dict)
            own = matcher.value
            for batch in batches:
                ids, texts = batch.column("id"), batch.column("t").to_pylist()
                found = list(own.find(texts))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([own.items[f[1]][0] for f in found], item_type), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))], [id_col, item_col, "cosine", "subsequence", "answer"])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(search, schema)

    blocks, out = -(-number // ITEMS_AT_ONCE), spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = given if blocks == 1 else given.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        items = sorted(((r["i"], words_of(r["t"])) for r in rows.collect()), key=lambda x: (str(x[0]), x[1]))
        if items := [x for x in items if x[1]]:
            out = search_for(items) if blocks == 1 else out.unionByName(search_for(items))
    return out
