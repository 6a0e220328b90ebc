"""Importance resampling towards a target: hashed n-gram features of documents and of a target text, counted by an external sort, and the documents whose features the target favours drawn by Gumbel top-k.

Streams: tasks turn texts into the bucket of each feature and write these as packed uint16 streams, a row per block of about BLOCK features, with the offset at which each document begins. A document's buckets stand together, so no step needs to bring them together.
Counts: each block is sorted and run-length encoded; what is shuffled are a task's sums by bucket. The counts of all buckets (BUCKETS of them) are the only thing that the driver sees.
Gains: blocks are read again, buckets are replaced by their gains, and np.add.reduceat sums them between offsets.
Draw: scores are sorted by range partitions; a row's rank is its place in its partition and the rows in partitions before it, so no task sees more than its range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import numbered
from .common import Scratch, held, prepare

#: Buckets of features; a bucket fits 16 bits.
BUCKETS = 10_000
#: Longest run of words that makes a feature.
RUN = 3
#: A block ends with the document in which it reaches so many features (512 KB).
BLOCK = 1 << 18
#: Files of streams are written in small row groups, as a writer holds one in memory; a block is no word that a dictionary would be of use for.
STREAM_FILES = {"parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Documents with fewer words aren't drawn; of the others PERCENT are.
LEAST_WORDS, PERCENT = 20, 5

#: Bytes that may stand in a word: digits, letters (A-Z become a-z), and all of characters beyond ASCII; others part words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

STREAMS = "ids array<bigint>, words array<bigint>, offsets array<bigint>, stream binary"
STREAMS_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("stream", pa.binary())])


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, in lists from pieces of about PIECE bytes, so that a very long text isn't held as words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        part = text[at:end].translate(FOLD)
        while end < len(text) and not part.endswith(b" "):  # a word goes on
            more = text[end : end + PIECE].translate(FOLD)
            stop = more.find(b" ")
            part += more if stop < 0 else more[: stop + 1]
            end += len(more) if stop < 0 else stop + 1
        yield part.split()
        at = end


def buckets(text: bytes) -> tuple[int, list[np.ndarray]]:
    """Number of words, and the buckets of all runs of 1 to RUN words. The CRC of a longer run goes on from that of the run before its last word."""
    n, found, before = 0, [], [0] * (RUN - 1)  # before[k]: CRC of the last k + 1 words
    for words in pieces(text):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        crcs = list(map(crc32, words))
        found.append(np.fromiter(crcs, np.uint32, len(crcs)))
        for k in range(1, RUN):
            shorter = [before[k - 1], *crcs[:-1]]
            before[k - 1] = crcs[-1]
            crcs = list(map(crc32, spaced, shorter))
            whole = crcs[max(0, k - n) :]  # the first words of the text have no k words before them
            found.append(np.fromiter(whole, np.uint32, len(whole)))
        n += len(words)
    return n, [(x % BUCKETS).astype("<u2") for x in found]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, words, offsets, parts, size = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"ids": ids, "words": words, "offsets": offsets, "stream": b"".join(p.tobytes() for p in parts)}], schema=STREAMS_ARROW)

    held(None, lambda: None)
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            n, got = buckets(text.as_py() or b"")
            ids.append(key.as_py())
            words.append(n)
            offsets.append(size)
            parts += got
            size += sum(map(len, got))
            if size >= BLOCK or len(ids) >= BLOCK >> 2:
                yield block()
                ids, words, offsets, parts, size = [], [], [], [], 0
    if ids:
        yield block()


def bucket_streams(docs: DataFrame, id_col: str | None, text_col: str = "text") -> DataFrame:
    """Blocks (ids, words, offsets, stream) of a table's texts."""
    prepare(docs.sparkSession, 200)
    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(key, F.col(text_col).cast("binary")).mapInArrow(_streams, STREAMS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stream in batch.column(0):
            found = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
            if len(found):
                starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(found[starts].astype(np.int32)), pa.array(np.diff(np.r_[starts, len(found)]).astype(np.int64))], names=["bucket", "n"])


def counts(streams: DataFrame) -> np.ndarray:
    """Features in each bucket: sorted and run-length encoded by block, then summed."""
    runs = streams.select("stream").mapInArrow(_runs, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for r in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: a thousand times the logarithm of how much likelier the target has it, each count one larger."""
    most, wanted = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * most / ((float(s) + 1) * wanted))) for s, t in zip(source, target, strict=True)], np.int64)


def weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, words, n_features and weight of each document of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, stream in zip(*batch.columns, strict=True):
                gathered = gain[np.frombuffer(stream.as_buffer(), "<u2")]
                starts = offsets.values.to_numpy()
                sizes = np.diff(np.r_[starts, len(gathered)])
                total = np.zeros(len(starts), np.int64)
                full = sizes > 0  # reduceat gives an empty range its next element
                if full.any():
                    total[full] = np.add.reduceat(gathered, starts[full])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(total)], names=["doc_id", "words", "n_features", "weight"])

    return streams.mapInArrow(run, "doc_id bigint, words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int) -> Column:
    """A thousand times a Gumbel variate, rounded down, that depends on the key and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Draw documents towards the distribution of a target's texts.

    Returns a row per input row: id_col, n_features, weight, score, rank (all long). Of the N documents with at least least_words words, floor(percent * N / 100) have a rank; others' is null.

    Null and empty texts have no words, weight 0 and no rank. Texts without word characters likewise. Null ids draw with an empty key and stand behind others of equal score. Rows that repeat id and text have equal scores and stand next to each other, in no order that tells them apart. An empty table gives an empty result; an empty target leaves all counts of it 0. Other columns are not read. A text is read whole; its stream must fit a binary value, so texts of up to 700 MB can be held.
    """
    with Scratch(docs.sparkSession, "resampling") as tmp:
        streams = tmp.save(bucket_streams(docs, id_col, text_col), "streams", **STREAM_FILES)
        gain = gains(counts(streams), counts(bucket_streams(target, None, target_col)))
        score = F.col("weight") + gumbel(F.col("doc_id"), seed)
        scored = tmp.save(weights(streams, gain).withColumn("score", score), "scored", keep=True)
        long_enough = scored.where(F.col("words") >= least_words)
        drawn = percent * long_enough.count() // 100
        placed = numbered(long_enough, tmp, [F.desc("score"), F.asc_nulls_last("doc_id")], "ranked")
    sorted_rows = placed.withColumn("rank", F.when(F.col("idx") < drawn, F.col("idx") + 1)).drop("idx")
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return sorted_rows.unionByName(rest).select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")


#: CRC-32 of a text s in DuckDB: the table t of all bytes' remainders, and a fold over the text's UTF-8 bytes in hexadecimal.
CRC_TABLE = "SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)"
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(s)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


def oracle(docs: str = "documents", target: str = "benchmark", seed: int = 42) -> str:
    """The same for DuckDB, over documents with identifiers."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = f"unnest(flatten(list_transform(range(1, {RUN + 1}), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')))))"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM {docs}),
        f AS MATERIALIZED (SELECT r, {runs} AS s FROM d),
        g AS MATERIALIZED (SELECT {runs} AS s FROM (SELECT {words} AS w FROM {target})),
        crc AS MATERIALIZED ({CRC_TABLE}),
        hashed AS MATERIALIZED (SELECT s, {CRC} % {BUCKETS} AS b FROM (SELECT s FROM f UNION SELECT s FROM g), crc),
        fb AS MATERIALIZED (SELECT r, b FROM f JOIN hashed USING (s)),
        n AS (SELECT b, sum(s) AS s, sum(t) AS t FROM (SELECT b, 1 AS s, 0 AS t FROM fb UNION ALL SELECT b, 0, 1 FROM g JOIN hashed USING (s)) GROUP BY b),
        gain AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS gain FROM n),
        weight AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM fb JOIN gain USING (b) GROUP BY r),
        scored AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (r)),
        placed AS (SELECT *, words >= {LEAST_WORDS} AS fit, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= {LEAST_WORDS}) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
    """
