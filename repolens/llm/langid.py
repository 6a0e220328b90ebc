"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is bound as the product of its letters' vectors, the first rotated by two places, the second by one. A text is the sum (bundle) of its trigrams' vectors; a language's prototype is the sum over its training texts. The predicted language is that whose prototype has the largest cosine with the text's bundle.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import held, prepare

DIMS = 4096
#: Bound trigrams and letters that a worker keeps, as bytes: 64 MB and 16 MB; rows that are summed at a time.
KEPT, LETTERS_KEPT, TOGETHER = 16_384, 4096, 1024
UNKNOWN = "und"
#: Most labelled rows of each language, in expectation, that prototypes are learned from.
TRAIN_ROWS = 5000
#: Tasks that sum the bundles of these rows.
TRAIN_TASKS = 16


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def trigrams(text: str | None) -> np.ndarray:
    """Trigrams of a whole text in lower case, three code points of 21 bits each. Runs of other characters than letters count as one space (0); a text without letters has none."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.where(letters()[codes], codes, 0)
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


class Bundler:
    """Each letter's vector comes from its code point and the seed, so letters of all scripts have vectors of their own, alike everywhere."""

    def __init__(self, dims: int = DIMS, seed: int = 7):
        if dims % 8:
            raise ValueError("the number of dimensions must be a multiple of eight")
        self.dims, self.seed = dims, seed
        self.letter: dict[int, np.ndarray] = {}
        #: Trigrams that are kept, sorted, and the row of each in bound.
        self.codes, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: A byte for each place, 1 where the vector is +1, in numbers of eight; grows by doubling.
        self.bound = np.zeros((0, dims // 8), np.uint64)

    def vector(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) >= LETTERS_KEPT:
                self.letter.clear()
            self.letter[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], np.int8), self.dims)
        return self.letter[code]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dims), np.int8)
        for place, turn in ((42, 2), (21, 1), (0, 0)):
            part, back = np.unique(codes >> place & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self.vector(c), turn) for c in part.tolist()])[back]
        return (out > 0).view(np.uint64)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of bound trigrams (distinct, KEPT at most) in self.bound."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        if not known.all():
            if len(self.codes) + int((~known).sum()) > KEPT:
                self.codes, self.row, self.bound, known = self.codes[:0], self.row[:0], self.bound[:0], np.zeros(len(codes), bool)
            fresh = codes[~known]
            rows = len(self.codes) + np.arange(len(fresh))
            if rows[-1] >= len(self.bound):
                self.bound = np.concatenate([self.bound, np.empty((max(len(self.bound), len(fresh), 64), self.dims // 8), np.uint64)])
            for k in range(0, len(fresh), TOGETHER):
                self.bound[rows[k : k + TOGETHER]] = self.bind(fresh[k : k + TOGETHER])
            to = np.searchsorted(self.codes, fresh)
            self.codes, self.row = np.insert(self.codes, to, fresh), np.insert(self.row, to, rows)
            at = np.searchsorted(self.codes, codes)
        return self.row[at]

    def bundle(self, text: str | None) -> np.ndarray:
        """Sum of a text's bound trigrams. Eight places are added at a time, as bytes of one number, 255 rows at most, so that no byte overflows; repeats go by the binary digits of their counts."""
        codes, counts = np.unique(trigrams(text), return_counts=True)
        plus = np.zeros(self.dims, np.int64)
        step = min(TOGETHER, KEPT)
        for k in range(0, len(codes), step):
            rows, some = self.rows(codes[k : k + step]), counts[k : k + step]
            for digit in range(int(some.max()).bit_length()):
                there = rows[some >> digit & 1 == 1]
                for j in range(0, len(there), 255):
                    plus += np.add.reduce(self.bound[there[j : j + 255]], axis=0).view(np.uint8).astype(np.int64) << digit
        return (2 * plus - counts.sum()).astype(np.float32)


def bundler(dims: int, seed: int) -> Bundler:
    return held(("langid", dims, seed), lambda: Bundler(dims, seed))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """The fold that isn't learned from: crc32 of the id as text is divisible by folds. A null id counts as an empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS, dims: int = DIMS, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototypes from the rows outside the held-out fold whose text and language aren't null; of a language with more than train_rows of these, a sample by a hash of the id that has train_rows in expectation. So a rare language is learned as well as a common one. Few tasks sum the bundles of what is sampled; one vector per language reaches the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)).alias("at"))
    many = {r["lang"]: int(1_000_000 * train_rows / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > train_rows).collect()}
    if many:
        share = F.map_from_arrays(F.array(*map(F.lit, many)), F.array(*map(F.lit, many.values())))
        rows = rows.where(F.col("at") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1_000_000)))
    rows = rows.select("text", "lang").repartition(TRAIN_TASKS)

    def sums(batches):
        own, total = bundler(dims, seed), {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                total[lang] = total.get(lang, 0) + own.bundle(text).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "bundle"])

    parts = rows.mapInArrow(sums, "lang string, bundle array<long>")
    found: dict[str, np.ndarray] = {}
    for r in parts.select("lang", F.posexplode("bundle").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["lang"], np.zeros(dims))[r["k"]] = r["x"]
    return dict(sorted(found.items()))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, dims: int = DIMS, seed: int = 7) -> DataFrame:
    """Predict the language of every whole text: id_col, held_out, lang_pred, score (the cosine, 0 if negative).

    Texts that are null or have no letter, and all texts if there is nothing to learn from, get und with score 0. Equal cosines go to the language that sorts first. Rows are scored one by one, so repeated rows get equal results; a null id is in the held-out fold. An empty table gives an empty result. Other columns are not read.
    """
    prepare(docs.sparkSession)
    prototypes = learn_prototypes(docs, text_col, lang_col, id_col, train_rows, dims, seed)
    names = list(prototypes)
    matrix = np.array([p / (np.linalg.norm(p) or 1) for p in prototypes.values()], np.float32).reshape(-1, dims)

    @pandas_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        own, out = bundler(dims, seed), []
        for text in texts:
            v = own.bundle(text)
            norm = float(np.linalg.norm(v))
            if not norm or not names:
                # A bundle of zeros from letters whose trigrams cancel has no direction: the first language, score 0.
                out.append((names[0] if names and len(trigrams(text)) else UNKNOWN, 0.0))
            else:
                cosines = matrix @ v / norm
                k = int(np.argmax(cosines))
                out.append((names[k], float(min(1.0, max(0.0, cosines[k])))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("p")).select(id_col, "held_out", "p.*")
