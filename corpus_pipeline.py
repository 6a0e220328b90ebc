"""The corpus pipeline: documents -> toxicity -> exact copies -> near copies -> benchmark passages -> tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last return the columns of documents. Decisions are by row: a row is named by its doc_id and a hash of its text, so of rows that repeat a doc_id with other texts each is decided on its own. Rows with a null doc_id are never taken for copies or contaminated ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm.bpe import encode_documents
from repolens.llm.common import Scratch, drop_ids, lean, table
from repolens.llm.decontaminate import find_contamination
from repolens.llm.exact_dedup import exact_duplicates
from repolens.llm.queries import tokenizer_path
from repolens.llm.simhash import near_duplicates
from repolens.llm.toxicity import learn, with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The network learns from the labels of docs."""
    lean(spark)
    net = learn(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs, net, score_col="_toxicity").where("_toxicity < 0.5").drop("_toxicity")


#: Name of a row: null if its doc_id is, as operators let such rows win over no others.
ROW = "_row"


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text"))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; of rows that repeat both, one."""
    lean(spark)
    rows = named(docs)
    with Scratch(spark, "exact_rows") as tmp:
        found = exact_duplicates(rows, ROW)
        found = tmp.save(found.where(F.col(ROW).isNotNull() & (F.col("group_size") > 1)).groupBy(ROW).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "found", keep=True)
    out = drop_ids(rows, found.where("not kept"), ROW)
    again = found.where("kept and n > 1").select(ROW)
    if again.isEmpty():
        return out.drop(ROW)
    one = out.join(again, ROW, "left_semi").groupBy(ROW).agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*")
    return drop_ids(out, again, ROW).drop(ROW).unionByName(one)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints within 4 bits, or a five-word Jaccard similarity of at least 0.8) the document with the smallest doc_id stays."""
    lean(spark)
    rows = named(docs)
    return drop_ids(rows, near_duplicates(rows, ROW, similar=True).where(F.col(ROW) != F.col("component_id")), ROW).drop(ROW)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    lean(spark)
    rows = named(docs)
    with Scratch(spark, "contaminated") as tmp:
        found = tmp.save(find_contamination(rows, table(spark, sf_dir, "benchmark"), ROW).select(ROW).distinct(), "ids", keep=True)
    return drop_ids(rows, found, ROW).drop(ROW)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of what is left."""
    lean(spark)
    return encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", simhash_near_dedup), ("benchmark decontamination", decontamination), ("BPE", bpe)]

#: SQL can't express the network, fingerprints, latent search and BPE; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as tmp:
        before = None
        for k, (_, stage) in enumerate(STAGES):
            docs = tmp.save(stage(spark, docs, sf_dir), f"stage{k}", keep=k == len(STAGES) - 1)
            if before is not None:
                tmp.drop(f"stage{before}")
            before = k
    return docs
