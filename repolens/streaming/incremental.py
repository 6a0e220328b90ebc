"""Incremental ingestion as a stream of files: an extension, as ingestion otherwise runs once per call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as X
from ..sources.ingest import describe, without_binary, without_empty, without_generated_headers, without_generated_names
from ..sources.store import insert

FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def file_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(root)


def source_rows(files: DataFrame, root: str, project: str) -> DataFrame:
    """The filters and columns of ingestion on a stream; a path that was seen within the watermark's day is dropped."""
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = files.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["path"])
    rows = rows.select(X.relative_path(F.lit(root.rstrip("/")), path).alias("filepath"), X.basename(path).alias("filename"), "content")
    rows = without_generated_names(without_binary(rows.withColumn("fileExtension", X.extension(F.col("filename")))))
    rows = without_empty(without_generated_headers(describe(rows)))
    return rows.select(F.lit(project).alias("projectName"), "filename", "filepath", "fileExtension", "canonicalType", "linesCount", "isCode", "content")


def start(rows: DataFrame, table: str, checkpoint: str, rejects: str | None = None, once: bool = False) -> StreamingQuery:
    """Append each micro-batch's new paths to the table; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(table).select("projectName", "filepath")
            batch = batch.join(known, ["projectName", "filepath"], "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        insert(batch, table, rejects)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
