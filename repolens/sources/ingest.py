"""Scans of source trees and text files, and the filters of ingestion."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import vocab as V
from .tree import read_contents, read_tree


def scan(spark: SparkSession, roots: str | Sequence[str], content: bool = True) -> DataFrame:
    """Files below one or several roots, without ignored folders and names and without dot files: sourceRoot, path, filepath (below the root), filename, size, and content if it is wanted. Ignored folders aren't entered; partitions have about as many bytes each."""
    files = read_tree(spark, [roots] if isinstance(roots, str) else list(roots))
    return read_contents(files) if content else files


def largest_first(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Files by size, largest first; with a number of partitions, dealt so that each gets some of each size."""
    return files.orderBy(F.desc("size"), "filepath") if partitions is None else files.repartition(partitions, F.xxhash64("filepath")).sortWithinPartitions(F.desc("size"))


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole trimmed texts of files named requirement<number>.prompt in any case."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), X.js_trim(F.col("value")).alias("prompt"))
    return files.where(F.col("filename").rlike(r"(?i)^requirement\d+\.prompt$")).orderBy("filename")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines, trimmed, without blank ones and comments."""
    lines = spark.read.text(path).select(X.js_trim(F.col("value")).alias("question"))
    return lines.where("question <> '' and not startswith(question, '#')")


def without_binary(files: DataFrame, ext: str = "fileExtension") -> DataFrame:
    return files.where(~F.lower(ext).isin(*V.BINARY_EXTENSIONS))


def without_generated_names(files: DataFrame, name: str = "filename") -> DataFrame:
    suffixes = "|".join(re.escape(s) for s in (*V.MINIFIED_SUFFIXES, *V.GENERATED_SUFFIXES))
    return files.where(~F.lower(name).rlike(f"({suffixes})$"))


def without_generated_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Files without a marker in their first characters."""
    head = F.substring(content, 1, V.MARKER_CHARS)
    found = F.lit(False)
    for marker in V.GENERATED_MARKERS:
        found = found | F.contains(head, F.lit(marker))
    return files.where(~found)


def without_empty(files: DataFrame, content: str = "content") -> DataFrame:
    return files.where(X.js_trim(F.col(content)) != "")


def describe(files: DataFrame) -> DataFrame:
    """Extension, type, code flag, lines and content (as text) of scanned files."""
    out = files.withColumn("content", F.col("content").cast("string")).withColumn("fileExtension", X.extension(F.col("filename")))
    return out.withColumn("canonicalType", X.canonical_type(F.col("filename"), F.col("fileExtension"))).withColumn("isCode", X.is_code(F.col("fileExtension"))).withColumn("linesCount", X.count_lines(F.col("content")))


def new_files(files: DataFrame, known: DataFrame, key: str = "filepath") -> DataFrame:
    """Files that aren't known yet, by path; files that changed count as known."""
    return files.join(known.select(key).distinct(), key, "left_anti").select(*files.columns)


def ingest(spark: SparkSession, roots: str | Sequence[str], project: str, known: DataFrame | None = None) -> DataFrame:
    """Rows for the sources table; names are filtered before contents are read."""
    files = scan(spark, roots, content=False)
    files = without_generated_names(without_binary(files.withColumn("fileExtension", X.extension(F.col("filename")))))
    if known is not None:
        files = new_files(files, known.where(F.col("projectName") == project))
    rows = without_empty(without_generated_headers(describe(read_contents(files))))
    return rows.select(F.lit(project).alias("projectName"), "filename", "filepath", "fileExtension", "canonicalType", "linesCount", "isCode", "content")
