"""Exact duplicates by a log-structured merge index, in DataFrame operations only.

Level 0: each input partition is a memtable that flushes one run: (digest, identifier), sorted by digest.
Compaction: the runs are merged by digest; of each digest that is there several times an entry stays, with the surviving identifier and the count (level 1). Other digests need none.
Filter: the entries' digests set bits in bitmaps, sized from the number of entries. A text whose bit isn't set has no entry and is alone.
Lookup: the texts that pass (hits; false ones cost time, never correctness) are verified by their bytes: grouped by digest and whole text, with partial aggregation before the shuffle, so a group of any size leaves a row per task. The rows of a digest with one text take identifier and count from its entry.
Digests that cover several texts are told apart by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: A bitmap of the filter has 32,768 bits (4 KB); the filter has at least BITS_EACH bits per entry, in a power of two of bitmaps, MOST_BITMAPS (64 MB) at most: beyond 33 million entries it lets more false hits through.
BITMAP_BITS, BITS_EACH, MOST_BITMAPS = 32_768, 16, 16_384


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def bitmaps_for(entries: int) -> int:
    """Bitmaps of the filter for so many entries."""
    n = 1
    while n * BITMAP_BITS < entries * BITS_EACH and n < MOST_BITMAPS:
        n *= 2
    return n


def _bucket(digest: Column, bitmaps: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit("bucket")), F.lit(bitmaps)).cast("int")


def _bit(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit("bit")), F.lit(BITMAP_BITS)).cast("int")


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def build_filter(repeated: DataFrame, bitmaps: int) -> DataFrame:
    """Bitmaps (b, bits) of the digests d of an index's entries."""
    return repeated.groupBy(_bucket(F.col("d"), bitmaps).alias("b")).agg(F.bitmap_construct_agg(_bit(F.col("d"))).alias("bits"))


def probe(rows: DataFrame, bits: DataFrame, bitmaps: int) -> DataFrame:
    """The rows whose digest d may be in the index. The filter, MOST_BITMAPS * 4 KB at most, goes to every task."""
    found = rows.withColumn("b", _bucket(F.col("d"), bitmaps)).join(F.broadcast(bits), "b")
    return found.where(_is_set(F.col("bits"), _bit(F.col("d")))).drop("b", "bits")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest=sha256) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z.

    Returns a row per input row: id_col, keep_id, group_size, kept, text_sha256.
    keep: "max" or "min", the identifier of a group that stays.

    Null texts count as empty. Null ids never win over others; a group of null ids only has a null keep_id, and its rows are kept. Repeated rows of one id and text count in group_size and are all kept if their id is: they are the row that stays, written several times. An empty table gives an empty result. Other columns are not read. digest may be any function from text to binary; texts that share a digest are told apart.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    rows = rows.withColumn("d", digest(F.col("t"))).withColumn("h", F.col("d") if digest is sha256 else sha256(F.col("t")))
    told_by = F.unhex(F.sha2(F.col("t").cast("binary"), 512))
    with Scratch(docs.sparkSession, "exact") as tmp:
        runs = tmp.save(rows.select("id", "d", "h").sortWithinPartitions("d"), "runs", keep=True)
        level1 = tmp.save(runs.groupBy("d").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").sortWithinPartitions("d"), "level1", keep=True)
        bitmaps = bitmaps_for(level1.count())
        hits = probe(rows, build_filter(level1, bitmaps), bitmaps)
        verified = tmp.save(hits.groupBy("d", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).select("d", told_by.alias("told"), "keep_id", "n"), "verified", keep=True)
        clash = tmp.save(verified.groupBy("d").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("d"), "clash", keep=True)
        if clash.isEmpty():
            out = runs.join(level1, "d", "left")
        else:
            out = runs.join(clash, "d", "left_anti").join(level1, "d", "left").select("id", "h", "keep_id", "n")
            told = rows.withColumn("told", told_by).join(clash, "d", "left_semi").join(verified, ["d", "told"], "left")
            out = out.unionByName(told.select("id", "h", "keep_id", "n"))
    keeper = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keeper.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keeper).alias("kept"), F.lower(F.hex("h")).alias("text_sha256"))
