"""BPE encoding by speculation and verification, for tokenizer files with word ends (</w>).

A text is normalised and cut into words as its file says. A new word is first proposed by greedy longest match. A sequence of tokens is what merging gives if each token is (alone, its own merging) and each adjacent pair is (merging the two tokens' text gives the two tokens): merges never cross a boundary that none of its two sides would cross. The pairs of all new words of a batch are tested at once against sorted arrays of known pairs; a pair not seen before is merged once. Only words with a failing token or pair are merged exactly as a whole. Encoded words are kept, about CACHE at most, as are verified pairs, PAIRS at most.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import held, prepare

CACHE = 250_000
PAIRS = 1_000_000
#: Characters of texts that are encoded together, at least one text.
TOGETHER = 1_000_000
#: Letters up to which a scan for the least pair is faster than a heap.
SCANNED = 48
END = "</w>"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Characters about which all versions of Unicode agree; texts with others are cut by the tokenizers library's own normaliser and splitter.
PLAIN = regex.compile(r"[\x00-\u024f\u0400-\u045f\u2010-\u2027\u20ac\u2122]*")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


LETTERS = byte_letters()


class WordBpe:
    """Encoder and decoder of one tokenizer file, equal to the tokenizers library with add_special_tokens=False, no truncation and no padding; decode as with skip_special_tokens=False."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] is not None:
            raise ValueError(f"{path} isn't a BPE with word ends and without a decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.token = [names.get(i, "") for i in range(max(names) + 1)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        at = self.vocab
        #: A pair of ids, as one number: its rank, and the id that it merges to.
        self.rank = {at[a] << 20 | at[b]: (k, at[a + b]) for k, (a, b) in enumerate(pairs) if a + b in at}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest = max(map(len, self.vocab)) + len(END)
        #: Length of the longest inner token that begins with three letters.
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            if len(t) > 2 and not t.endswith(END):
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        self.path = path
        self.cache: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers
        self.sound: dict[int, bool] = {}
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.merged = 0

    @cached_property
    def library(self):
        """Loaded when a text needs it, as it takes tens of MB."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def letters(word: str) -> str:
        return word if word.isascii() and word.isalnum() else "".join([LETTERS[b] for b in word.encode("utf-8", "surrogatepass")])

    def units(self, word: str) -> list[int]:
        return self.split_token(self.letters(word) + END)

    def split_token(self, token: str) -> list[int]:
        """Ids of a token's letters; the last carries the word's end."""
        if token.endswith(END) and len(token) > len(END):
            letters = list(token[: -len(END)])
            letters[-1] += END
        else:
            letters = list(token)
        return [self.vocab[x] for x in letters if x in self.vocab]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: again and again the leftmost pair of least rank. Long sequences go by a heap, so that time grows as n log n."""
        if len(ids) > SCANNED:
            return self.merge_long(ids)
        rank, none = self.rank, (1 << 60, -1)
        todo = [rank.get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while todo:
            best = min(todo)
            if best is none:
                break
            k = todo.index(best)
            ids[k : k + 2] = [best[1]]
            del todo[k]
            if k:
                todo[k - 1] = rank.get(ids[k - 1] << 20 | best[1], none)
            if k < len(todo):
                todo[k] = rank.get(best[1] << 20 | ids[k + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of rank and place, as one number, over a doubly linked list; entries that a merge has outdated are passed over."""
        n, at = len(ids), self.rank.get
        ids, before, after = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [found[0] << 40 | k for k, (a, b) in enumerate(zip(ids, ids[1:])) if (found := at(a << 20 | b))]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            best = pop(heap)
            k = best & (1 << 40) - 1
            j = after[k]
            if ids[k] < 0 or j >= n or not (found := at(ids[k] << 20 | ids[j])) or found[0] != best >> 40:
                continue
            new, ids[j], j = found[1], -1, after[j]
            ids[k], after[k] = new, j
            if j < n:
                before[j] = k
                if found := at(new << 20 | ids[j]):
                    push(heap, found[0] << 40 | k)
            if (i := before[k]) >= 0 and (found := at(ids[i] << 20 | new)):
                push(heap, found[0] << 40 | i)
        return [i for i in ids if i >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match, from the left; the last token carries the word's end."""
        text, vocab = self.letters(word), self.vocab
        out, k, n = [], 0, len(text)
        while k < n:
            i = vocab.get(text[k:] + END) if n - k <= self.longest else None
            if i is not None:
                out.append(i)
                break
            for j in range(min(n - 1, k + self.reach.get(text[k : k + 3], 2)), k, -1):
                i = vocab.get(text[k:j])
                if i is not None:
                    out.append(i)
                    k = j
                    break
            else:
                return []
        return out

    def is_sound(self, i: int) -> bool:
        if i not in self.sound:
            self.sound[i] = self.merge(self.split_token(self.token[i])) == [i]
        return self.sound[i]

    def verify(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stays as it is when merged together."""
        codes = left.astype(np.int64) << 32 | right
        unique, back = np.unique(codes, return_inverse=True)
        if len(self.pairs) > PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        at = np.minimum(np.searchsorted(self.pairs, unique), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == unique if len(self.pairs) else np.zeros(len(unique), bool)
        fresh = unique[~known]
        if len(fresh):
            fits = []
            for c in fresh.tolist():
                a, b = c >> 32, c & 0xFFFFFFFF
                fits.append(self.merge(self.split_token(self.token[a]) + self.split_token(self.token[b])) == [a, b])
            to = np.searchsorted(self.pairs, fresh)
            self.pairs, self.fits = np.insert(self.pairs, to, fresh), np.insert(self.fits, to, fits)
            at = np.searchsorted(self.pairs, unique)
        return self.fits[at][back]

    def learn(self, words: set[str]) -> None:
        """Encode new words: propose, verify all pairs at once, merge those that fail."""
        words = list(words)
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) for p in proposed], np.int64)
        flat = np.array([i for p in proposed for i in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = sizes == 0
        if len(flat):
            sound = {i: self.is_sound(i) for i in np.unique(flat).tolist()}
            bad[owner[[not sound[i] for i in flat.tolist()]]] = True
            inner = owner[1:] == owner[:-1]
            bad[owner[1:][inner][~self.verify(flat[:-1][inner], flat[1:][inner])]] = True
        for w, p, wrong in zip(words, proposed, bad.tolist()):
            if wrong:
                self.merged += 1
                p = self.merge(self.units(w))
            self.cache[w] = struct.pack(f"<{len(p)}I", *p)

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            return WORD.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        cut = self.library.pre_tokenizer.pre_tokenize_str(text)
        back = {c: b for b, c in enumerate(LETTERS)}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in cut]

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """Of each text: the number of ids, the ids as little-endian unsigned 32-bit integers, the decoded text."""
        out, at = [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size < TOGETHER):
                size += len(texts[to])
                to += 1
            out += self._encode(texts[at:to])
            at = to
        return out

    def _encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        cut = [[(piece, None) if k % 2 else (piece, self.words(piece)) for k, piece in enumerate(self.cut.split(t) if self.cut else [t]) if piece] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        words = set().union(*(w for pieces in cut for _, w in pieces if w))
        if fresh := words - self.cache.keys():
            self.learn(fresh)
        out, cache = [], self.cache
        for pieces in cut:
            parts = []
            for piece, words in pieces:
                if words is None:
                    parts.append(struct.pack("<I", self.special[piece]))
                else:
                    parts += [cache[w] for w in words]
            ids = b"".join(parts)
            out.append((len(ids) // 4, ids, self.decode(ids)))
        return out

    def decode(self, ids: bytes) -> str:
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def load(path: str) -> WordBpe:
    return held(("bpe", path), lambda: WordBpe(path))


def bpe_udf(path: str, with_tokens: bool = False):
    """text -> struct(n_tokens, ids_sha256, decoded_sha256), and with_tokens also ids (binary) and decoded."""
    from pyspark.sql.types import BinaryType

    more = [StructField("ids", BinaryType()), StructField("decoded", StringType())] if with_tokens else []
    kind = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), *more])

    @pandas_udf(kind)
    def encode(text: pd.Series) -> pd.DataFrame:
        coder, rows = load(path), []
        for n, ids, decoded in coder.encode([t or "" for t in text]):
            rows.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(), *((ids, decoded) if with_tokens else ())))
        return pd.DataFrame(rows, columns=kind.names)

    return encode


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = False) -> DataFrame:
    """Encode and decode whole texts: id_col, n_tokens, ids_sha256, decoded_sha256 (with_tokens: also ids, as binary, and decoded).

    Null texts count as empty: no ids, an empty decoded text. Nothing is shuffled; a row depends on its text alone, so repeated rows, null ids and ties need no rule. An empty table gives an empty result. Other columns are not read. path is read on each executor.
    """
    prepare(docs.sparkSession)
    return docs.select(id_col, bpe_udf(path, with_tokens)(F.col(text_col)).alias("b")).select(id_col, "b.*")
