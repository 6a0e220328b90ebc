"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed word embedding, the mean of its hashed character n-gram embeddings, and the largest first component among these. The first components start as log-odds of the labels, the others at random; all are trained. A window of WINDOW words runs through one GRU in each direction; attention pools the states of both, and a logistic unit scores the pool. Windows overlap by half and cover the whole text. A document's score is that of its highest window, both in training (where the highest window of each labelled document is learned from) and afterwards.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import held, prepare
from .langid import held_out

WORD = re.compile(r"[^\W\d_]+")
WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 16
DIM, HIDDEN, ATTENTION = 4, 8, 8
#: Most labelled documents of each class, in expectation, that are learned from.
TRAIN_POSITIVE, TRAIN_NEGATIVE = 1500, 3500
#: Most characters of the texts that are learned from; the rows that lie beyond it, in the order of a hash of the id, are left out.
TRAIN_CHARACTERS = 16_000_000
#: Texts with a word of more letters than this are scored as others are, but not learned from.
TRAIN_WORD = 10_000
#: Windows that run through the network at a time, words whose projected inputs a worker keeps, and letters that are spelled at a time (of a longer word: read at a time).
TOGETHER, CACHE, LETTERS = 4096, 100_000, 200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its row, and where its n-grams begin in the third array: the rows of the n-grams of three to five letters of all words with their bounds, GRAM_ROWS where a word ends before."""
    row = np.array([zlib.crc32(w.encode("utf-8", "replace")) % WORD_ROWS for w in words], np.int64)
    marked = [f"<{w}>" for w in words]
    ends = np.cumsum(np.array([len(m) for m in marked], np.int64))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return row, starts * 3, gram_rows("".join(marked), np.repeat(ends, ends - starts)).ravel()


def gram_rows(text: str, end: np.ndarray | None = None) -> np.ndarray:
    """(letters, 3) rows of the n-grams of three to five letters that begin at each letter, GRAM_ROWS where they would reach beyond its end (of the text, if not given)."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    left = (len(codes) if end is None else end) - np.arange(len(codes))
    codes = np.concatenate([codes, np.zeros(5, np.uint32)])
    grams = np.full((len(left), 3), GRAM_ROWS, np.int32)
    h = codes[: len(left)]
    for k in range(1, 5):
        h = h * np.uint32(0x01000193) ^ codes[k : len(left) + k]
        if k >= 2:
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D + 2 * k)
            grams[:, k - 2] = np.where(left > k, (mixed ^ mixed >> np.uint32(13)) % np.uint32(GRAM_ROWS), GRAM_ROWS)
    return grams


def portions(words: list[str], letters: int = LETTERS) -> Iterator[list[str]]:
    """Words in order, some at a time: so many that they hold about the given number of letters, one at least."""
    some, size = [], 0
    for w in words:
        if some and size + len(w) > letters:
            yield some
            some, size = [], 0
        some.append(w)
        size += len(w) + 2
    if some:
        yield some


def spell_many(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spell() of many words, some at a time."""
    parts, at = [], 0
    for some in portions(words):
        row, starts, grams = spell(some)
        parts.append((row, starts + at, grams))
        at += len(grams)
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else spell(words)


def window_starts(n: int) -> range:
    """Starts of windows over n words: each word is in a window, all but the ends in two."""
    return range(0, max(1, n - STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_odds(in_pos: np.ndarray, in_neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-odds of presence, shrunk where a feature occurs in few documents; one document says nothing."""
    raw = np.log((in_pos + 0.5) / (n_pos + 1)) - np.log((in_neg + 0.5) / (n_neg + 1))
    seen = in_pos + in_neg
    return (np.clip(raw, -4, 4) * (np.maximum(0, seen - 1) / (seen + 4.0))).astype(np.float32)


@dataclass
class Network:
    word: np.ndarray  # (WORD_ROWS, DIM)
    gram: np.ndarray  # (GRAM_ROWS, DIM)
    w: np.ndarray  # (2 directions, 2 * DIM + 1, 3 * HIDDEN)
    b: np.ndarray  # (2, 3 * HIDDEN)
    u: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    wa: np.ndarray  # (2 * HIDDEN, ATTENTION)
    va: np.ndarray  # (ATTENTION,)
    out: np.ndarray  # (2 * HIDDEN + 1,)

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        r = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        return Network(r(WORD_ROWS, DIM) / 30, r(GRAM_ROWS, DIM) / 30, r(2, 2 * DIM + 1, 3 * HIDDEN), np.zeros((2, 3 * HIDDEN), np.float32), r(2, HIDDEN, 3 * HIDDEN), r(2 * HIDDEN, ATTENTION), r(ATTENTION), r(2 * HIDDEN + 1))

    def inputs(self, spelled: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, the number of each one's n-grams, and the largest first component's row."""
        row, starts, grams = spelled
        x = np.zeros((len(row), 2 * DIM + 1), np.float32)
        if not len(row):
            return x, row, row
        there = grams < GRAM_ROWS
        own = np.concatenate([self.gram, np.zeros((1, DIM), np.float32)])[grams]
        count = np.add.reduceat(there, starts)
        lead = np.where(there, own[:, 0], np.float32(-9))
        x[:, :DIM], x[:, DIM : 2 * DIM], x[:, 2 * DIM] = self.word[row], np.add.reduceat(own, starts, axis=0) / count[:, None], np.maximum.reduceat(lead, starts)
        word = np.repeat(np.arange(len(row)), np.diff(np.append(starts, len(grams))))
        hits = np.flatnonzero(lead == x[word, 2 * DIM])
        return x, count, grams[hits[np.searchsorted(word[hits], np.arange(len(row)))]]

    def inputs_of(self, words: list[str]) -> np.ndarray:
        """Input vectors of words of any length: a word of more than LETTERS letters is read in pieces that share four, so that each n-gram is in a piece, and those that two pieces share are counted once."""
        out = [np.zeros((0, 2 * DIM + 1), np.float32)]
        for some in portions(words):
            out.append(self.inputs(spell(some))[0] if len(some[0]) <= LETTERS else self._long(some[0])[None])
        return np.concatenate(out)

    def _long(self, word: str) -> np.ndarray:
        marked, own = f"<{word}>", np.concatenate([self.gram, np.zeros((1, DIM), np.float32)])
        total, count, most = np.zeros(DIM), 0, np.float32(-9)
        for k in range(0, len(marked), LETTERS):
            grams = gram_rows(marked[k : k + LETTERS + 4])[:LETTERS]
            there = grams < GRAM_ROWS
            total += own[grams].sum((0, 1), dtype=np.float64)
            count += int(there.sum())
            most = max(most, np.where(there, own[:, 0][grams], np.float32(-9)).max())
        return np.concatenate([self.word[zlib.crc32(word.encode("utf-8", "replace")) % WORD_ROWS], total / count, [most]]).astype(np.float32)

    def all_inputs(self, spelled: tuple[np.ndarray, np.ndarray, np.ndarray], step: int = 20_000) -> np.ndarray:
        """Input vectors of many words, some at a time."""
        row, starts, grams = spelled
        ends = np.append(starts, len(grams))
        cut = [(row[k : k + step], starts[k : k + step] - starts[k], grams[starts[k] : ends[min(k + step, len(row))]]) for k in range(0, len(row), step)]
        return np.concatenate([self.inputs(c)[0] for c in cut]) if cut else np.zeros((0, 2 * DIM + 1), np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of each word, and a row of zeros at the end for the padding."""
        p = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
        for k in range(2):
            p[k, :-1] = x @ self.w[k]
            p[k, :-1] += self.b[k]
        return p

    def forward(self, p: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows. ids: (windows, WINDOW) rows of p, -1 after a window's end."""
        n, steps = ids.shape
        real = ids >= 0
        ragged = not real.all()
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        kept, columns = {}, np.ascontiguousarray(ids.T)
        for k in range(2):
            h, u = np.zeros((n, HIDDEN), np.float32), self.u[k]
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                x = p[k][columns[t]]
                s = h @ u
                zr = x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]
                zr *= np.float32(0.5)
                np.tanh(zr, out=zr)
                zr += 1
                zr *= np.float32(0.5)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = r * s[:, 2 * HIDDEN :]
                c += x[:, 2 * HIDDEN :]
                np.tanh(c, out=c)
                new = h - c
                new *= z
                new += c
                if keep:
                    kept[k, t] = (h, z, r, c, s[:, 2 * HIDDEN :])
                h = np.where(real[:, t, None], new, h) if ragged else new
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        a = np.tanh(states.reshape(-1, 2 * HIDDEN) @ self.wa)
        e = np.where(real.T, (a @ self.va).reshape(steps, n), np.float32(-1e9))
        e = np.exp(e - e.max(0)) * real.T
        alpha = e / np.maximum(e.sum(0), np.float32(1e-9))
        pool = np.einsum("tn,tnh->nh", alpha, states)
        logits = pool @ self.out[:-1] + self.out[-1]
        return (logits, (kept, states.transpose(1, 0, 2), a.reshape(steps, n, -1).transpose(1, 0, 2), alpha.T, pool, real)) if keep else logits

    def logits(self, p: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Logits of many windows, whole ones apart from those that a text's end cuts."""
        out, whole = np.zeros(len(windows), np.float32), windows[:, -1] >= 0
        for some in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for k in range(0, len(some), TOGETHER):
                out[some[k : k + TOGETHER]] = self.forward(p, windows[some[k : k + TOGETHER]])
        return out

    def gradients(self, p: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the dense parts, and of the words' inputs."""
        logits, (kept, states, a, alpha, pool, real) = self.forward(p, ids, keep=True)
        prob = sigmoid(logits)
        g = ((prob - y) / len(y)).astype(np.float32)
        d = {"out": np.append(g @ pool, g.sum())}
        d_pool = g[:, None] * self.out[:-1]
        d_states = alpha[:, :, None] * d_pool[:, None, :]
        d_alpha = (states @ d_pool[:, :, None])[:, :, 0]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
        d["va"] = np.einsum("nt,nta->a", d_e, a)
        d_a = d_e[:, :, None] * self.va * (1 - a * a)
        d["wa"] = np.einsum("nth,nta->ha", states, d_a)
        d_states += d_a @ self.wa.T
        d_p, d["u"] = np.zeros_like(p), np.zeros_like(self.u)
        steps = ids.shape[1]
        for k in range(2):
            u, dh = self.u[k], np.zeros((len(ids), HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if k == 0 else range(steps):
                h, z, r, c, s = kept[k, t]
                dh = dh + d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                live = real[:, t, None]
                dn = dh * live
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * s * r * (1 - r)
                d_s = np.concatenate([dz, dr, dc * r], 1)
                d["u"][k] += h.T @ d_s
                np.add.at(d_p[k], ids[:, t], np.concatenate([dz, dr, dc], 1))
                dh = dh * ~live + dn * z + d_s @ u.T
        d_p = d_p[:, :-1]
        d["w"], d["b"] = np.einsum("nd,knh->kdh", x, d_p), d_p.sum(1)
        loss = -np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))
        return float(loss), d, np.einsum("knh,kdh->nd", d_p, self.w)


def windows_of(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of a document's word rows, padded with -1."""
    starts = np.array(window_starts(len(ids)))
    padded = np.concatenate([ids, np.full(WINDOW, -1, ids.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)]


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        m, v = self.m.setdefault(name, np.zeros_like(value)), self.v.setdefault(name, np.zeros_like(value))
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-6)


def train(texts: list[str], labels: list[int], seed: int = 5, epochs: int = 8, batch: int = 256, steps: int = 240) -> Network | None:
    """At least epochs passes, and at least steps steps, in smaller batches if there are few documents. None if one of the classes is missing. A fifth of the documents calibrates the last bias, so that 0.5 parts the classes best there."""
    rng, y = np.random.default_rng(seed), np.array(labels)
    if len(set(labels)) < 2:
        return None
    net, number = Network.fresh(rng), {}
    docs = []
    for t in texts:
        cut = words_of(t)
        docs.append(np.array([number.setdefault(w, len(number)) for w in cut] if max(map(len, cut), default=0) <= TRAIN_WORD else [], np.int32))
    keep = [k for k, d in enumerate(docs) if len(d)]
    docs, y = [docs[k] for k in keep], y[keep]
    if len(set(y.tolist())) < 2:
        return None
    check = rng.random(len(docs)) < 0.2
    words = list(number)
    spelled = spell_many(words)
    size = np.diff(np.append(spelled[1], len(spelled[2])))
    seen = {c: (np.zeros(WORD_ROWS), np.zeros(GRAM_ROWS)) for c in (0, 1)}
    for d, c in zip(docs, y.tolist()):
        own = np.unique(d)
        seen[c][0][np.unique(spelled[0][own])] += 1
        grams = np.unique(spelled[2][np.repeat(spelled[1][own] - np.cumsum(size[own]) + size[own], size[own]) + np.arange(size[own].sum())])
        seen[c][1][grams[grams < GRAM_ROWS]] += 1
    n1 = int(y.sum())
    net.word[:, 0], net.gram[:, 0] = (log_odds(seen[1][k], seen[0][k], n1, len(y) - n1) for k in (0, 1))
    counts = [len(window_starts(len(d))) for d in docs]
    of, windows = np.repeat(np.arange(len(docs)), counts), np.empty((sum(counts), WINDOW), np.int32)
    at = 0
    for d, n in zip(docs, counts):
        windows[at : at + n] = windows_of(d)
        at += n
    first = np.searchsorted(of, np.arange(len(docs)))
    # Embeddings are learned slowly, and more so from few documents, which they would learn by heart.
    adam, slow = Adam(0.01), Adam(0.003 * min(1.0, len(docs) / 4000))
    batch = max(32, min(batch, len(docs) // 16))
    epochs = max(epochs, -(-steps * batch // (2 * len(docs))))

    def top() -> tuple[np.ndarray, np.ndarray]:
        logits = net.logits(net.project(net.all_inputs(spelled)), windows)
        best = np.maximum.reduceat(logits, first)
        order = np.lexsort((-logits, of))
        return order[first], best

    for epoch in range(epochs):
        if epoch == 0:  # before the network tells windows apart, the largest log-odds do
            x = net.all_inputs(spelled)
            strength = np.append(np.maximum(x[:, 0], x[:, 2 * DIM]), -9)[windows].max(1)
            chosen = np.lexsort((-strength, of))[first]
        else:
            chosen, _ = top()
        other = first + (rng.random(len(docs)) * np.diff(np.append(first, len(of)))).astype(np.int64)
        pick = np.concatenate([chosen, other[y == 0]])
        target = np.concatenate([y, np.zeros(int((y == 0).sum()))])
        train_on = ~check[of[pick]]
        pick, target = pick[train_on], target[train_on]
        weight = np.where(target == 1)[0]
        if len(weight) and len(weight) * 3 < len(target):  # positives are repeated to a third of what is learned from
            more = rng.choice(weight, len(target) // 3 - len(weight) + 1)
            pick, target = np.concatenate([pick, pick[more]]), np.concatenate([target, target[more]])
        order = rng.permutation(len(pick))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            ids = windows[pick[some]]
            used = np.unique(ids[ids >= 0])
            local = np.searchsorted(used, ids)
            local[ids < 0] = -1
            part = spell([words[w] for w in used])
            x, count, lead = net.inputs(part)
            adam.t = slow.t = adam.t + 1
            _, d, d_x = net.gradients(net.project(x), x, local, target[some])
            for name, grad in d.items():
                adam.step(name, getattr(net, name), grad)
            at, back = np.unique(part[0], return_inverse=True)
            grad = np.zeros((len(at), DIM), np.float32)
            np.add.at(grad, back, d_x[:, :DIM])
            slow.step("word", net.word, grad, at)
            there = part[2] < GRAM_ROWS
            sizes = np.diff(np.append(part[1], len(part[2])))
            at, back = np.unique(part[2][there], return_inverse=True)
            grad = np.zeros((len(at), DIM), np.float32)
            np.add.at(grad, back, np.repeat(d_x[:, DIM : 2 * DIM] / count[:, None], sizes, axis=0)[there])
            np.add.at(grad[:, 0], np.searchsorted(at, lead), d_x[:, 2 * DIM])
            slow.step("gram", net.gram, grad, at)
    _, best = top()
    on = check if 0 < y[check].sum() < check.sum() else np.ones(len(y), bool)
    cuts = np.sort(best[on])
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    right = [((best[on] >= c) == y[on]).mean() for c in cuts]
    good = cuts[np.flatnonzero(np.array(right) >= max(right) - 1e-9)]
    net.out[-1] -= np.float32((good.min() + good.max()) / 2)
    return net


class Scorer:
    """Scores texts; keeps the projected inputs of words."""

    def __init__(self, net: Network):
        self.net, self.number = net, {}
        self.p = np.zeros((2, 1, 3 * HIDDEN), np.float32)  # doubled when full; the last row stays zero

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > CACHE:
            self.number, self.p = {}, self.p[:, -1:]
        cut, number = [words_of(t) for t in texts], self.number
        fresh = list(set().union(*cut) - number.keys()) if cut else []
        if fresh:
            old, new = len(number), len(number) + len(fresh)
            number.update(zip(fresh, range(old, new)))
            if new >= self.p.shape[1]:
                self.p = np.concatenate([self.p[:, :old], np.zeros((2, new + 1, 3 * HIDDEN), np.float32)], axis=1)
            self.p[:, old:new] = self.net.project(self.net.inputs_of(fresh))[:, :-1]
        docs = [windows_of(np.fromiter(map(number.__getitem__, words), np.int32, len(words))) for words in cut if words]
        out = np.zeros(len(texts))
        if docs:
            windows = np.concatenate(docs)
            logits = self.net.logits(self.p, windows)
            first = np.cumsum([0] + [len(d) for d in docs[:-1]])
            out[[k for k, words in enumerate(cut) if words]] = sigmoid(np.maximum.reduceat(logits, first).astype(np.float64))
        return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_positive: int = TRAIN_POSITIVE, train_negative: int = TRAIN_NEGATIVE, train_characters: int = TRAIN_CHARACTERS, seed: int = 5) -> Network | None:
    """Train on labelled texts outside the held-out fold. Of more labels than train_positive and train_negative, samples by a hash of the id that have so many in expectation; whole texts of these reach the driver, train_characters in all at most. Labels other than 0 and 1, ids labelled both ways, and null ids or texts are left out; a repeated label counts once."""
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select(id_col, "y")
    counts = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda c, most: int(1_000_000 * min(1, most / max(1, counts.get(c, 0))))
    labels = labels.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.when(F.col("y") == 1, share(1, train_positive)).otherwise(share(0, train_negative)))
    # At most some thousands of ids after the sample; their texts' lengths come first.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(labels.select(F.col(id_col).alias("_id"), "y")), "_id")
    lengths = sorted(((r["h"], r["_id"], r["n"]) for r in texts.select("_id", F.xxhash64("_id").alias("h"), F.char_length("t").alias("n")).collect()), key=lambda r: (r[0], r[2]))
    left_out, total = set(), 0
    for _, i, n in lengths:
        if total + n > train_characters:
            left_out.add(i)
        else:
            total += n
    if left_out:
        texts = texts.where(~F.col("_id").isin(*left_out))
    rows = texts.collect()
    rows.sort(key=lambda r: (str(r["_id"]), r["t"]))
    return train([r["t"] for r in rows], [int(r["y"]) for r in rows], seed)


def with_toxicity(docs: DataFrame, net: Network | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text; null texts and texts without letters have 0, as has everything if there was nothing to learn from. Texts are scored a few million characters at a time."""
    prepare(docs.sparkSession)
    key = ("toxicity", uuid.uuid4().hex)

    @pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if net is None:
            return pd.Series(np.zeros(len(texts)))
        scorer = held(key, lambda: Scorer(net))
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size > 1_000_000:
                out.append(scorer.scores(some))
                some, size = [], 0
        return pd.Series(np.concatenate([*out, scorer.scores(some)]))

    return docs.withColumn(score_col, score(F.col(text_col)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_positive: int = TRAIN_POSITIVE, train_negative: int = TRAIN_NEGATIVE) -> DataFrame:
    """Learn from labels, then score every whole text: id_col, held_out, score, predicted (1 if score >= 0.5).

    Null and empty texts score 0. Equal texts score equal. A null id is in the held-out fold. An empty table gives an empty result; without labels of both classes every score is 0. Other columns are not read.
    """
    net = learn(docs, labels, id_col, text_col, label_col, train_positive, train_negative)
    out = with_toxicity(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), net, "t", "score")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
