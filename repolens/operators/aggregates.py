"""Statistics over source files. Nested arrays are exploded where they lie; only groups' keys and counts are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import vocab as V
from .select import of_project


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def file_line_stats(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Number of code files and of their lines; zeros if there are none."""
    return of_project(sources, project).where("isCode").agg(F.count(F.lit(1)).alias("fileCount"), _sum(F.col("linesCount")).alias("linesOfCode"))


def extension_stats(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Code files and lines by extension, most files first."""
    out = of_project(sources, project).where("isCode").groupBy("fileExtension").agg(F.count(F.lit(1)).alias("files"), _sum(F.col("linesCount")).alias("lines"))
    return out.orderBy(F.desc("files"), F.desc("lines"), "fileExtension")


def zipped(items: str, *fields: str) -> Column:
    """An array of structs with some fields of a nested array; scans then read these fields alone, which explode() of whole structs would not ensure."""
    return F.arrays_zip(*(F.col(f"{items}.{f}").alias(f) for f in fields))


def functions(sources: DataFrame, project: str | None, *fields: str) -> DataFrame:
    """A row per public function that has a complexity, with some of its fields."""
    rows = of_project(sources, project).select("filepath", F.coalesce("summary.namespace", "filepath").alias("namespace"), F.explode(zipped("summary.publicFunctions", "cyclomaticComplexity", *fields)).alias("f"))
    return rows.where(F.col("f.cyclomaticComplexity").isNotNull())


def top_complex_functions(sources: DataFrame, project: str | None = None, limit: int = V.TOP_FUNCTIONS) -> DataFrame:
    """The functions of the largest complexity; ties by name and file."""
    f = functions(sources, project, "name", "linesOfCode", "codeSmells").select(
        F.concat("namespace", F.lit("::"), "f.name").alias("functionName"), F.col("filepath").alias("filePath"), F.col("f.cyclomaticComplexity").alias("complexity"),
        F.coalesce("f.linesOfCode", F.lit(0.0)).alias("linesOfCode"), F.coalesce("f.codeSmells", F.array().cast("array<string>")).alias("codeSmells"),
    )
    return f.orderBy(F.desc("complexity"), "functionName", "filePath").limit(limit)


def code_smells(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Smells of functions and of files: distinct (smell, file) pairs of each level are added up as occurrences; a file counts once in affectedFiles."""
    rows = of_project(sources, project)
    of_functions = rows.select("filepath", F.explode("summary.publicFunctions.codeSmells").alias("s")).select("filepath", F.explode("s").alias("smellType"), F.lit(0).alias("level"))
    of_files = rows.select("filepath", F.explode("summary.codeQualityMetrics.fileSmells").alias("smellType"), F.lit(1).alias("level"))
    levels = F.max(F.when(F.col("level") == 0, 1).otherwise(0)) + F.max(F.col("level"))
    pairs = of_functions.unionByName(of_files).groupBy("smellType", "filepath").agg(levels.alias("levels"))
    return pairs.groupBy("smellType").agg(F.sum("levels").alias("occurrences"), F.count(F.lit(1)).alias("affectedFiles")).orderBy(F.desc("occurrences"), "smellType")


def code_quality(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Functions, averages (half-even to two places) and counts above thresholds; zeros if there are none."""
    cc, loc = F.col("f.cyclomaticComplexity"), F.coalesce("f.linesOfCode", F.lit(0.0))
    n = F.count(F.lit(1))
    mean = lambda c: F.coalesce(F.bround(F.sum(c) / n, 2), F.lit(0.0))
    return functions(sources, project, "linesOfCode").agg(
        n.alias("totalFunctions"), mean(cc).alias("averageComplexity"), F.count_if(cc > V.HIGH_COMPLEXITY).alias("highComplexityCount"), F.count_if(cc > V.VERY_HIGH_COMPLEXITY).alias("veryHighComplexityCount"),
        mean(loc).alias("averageFunctionLength"), F.count_if(loc > V.LONG_FUNCTION_LINES).alias("longFunctionCount"),
    )


def database_statistics(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Stored procedures (functions included) and triggers, in one pass."""
    size = lambda c: F.coalesce(F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))), F.lit(0))
    return of_project(sources, project).agg(size("summary.storedProcedures.name").alias("totalProcedures"), size("summary.triggers.name").alias("totalTriggers"))


def project_stats(sources: DataFrame) -> DataFrame:
    """Files, lines (of all files), extensions and summaries of each project. Extensions are reduced with the counts before the shuffle."""
    out = sources.groupBy("projectName").agg(
        F.count(F.lit(1)).alias("fileCount"), _sum(F.col("linesCount")).alias("linesOfCode"), F.sort_array(F.collect_set("fileExtension")).alias("fileExtensions"), F.count("summary").alias("summarizedFileCount")
    )
    return out.withColumn("hasSummaries", F.col("summarizedFileCount") > 0).withColumn("summarizedPct", X.percentage(F.col("summarizedFileCount"), F.col("fileCount"))).orderBy("projectName")


def project_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("projects"), _sum(F.col("fileCount")).alias("fileCount"), _sum(F.col("linesOfCode")).alias("linesOfCode"))


def status_counts(statuses: DataFrame, column: str = "status", vocabulary: tuple[str, ...] = V.LLM_STATUSES, total_of: tuple[str, ...] = ("SUCCESS", "FAILURE")) -> DataFrame:
    """Calls by status, zeros included, and a TOTAL of the final ones."""
    spark = statuses.sparkSession
    counts = statuses.where(F.col(column).isin(*vocabulary)).groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(s,) for s in vocabulary], "status string")
    full = known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = counts.where(F.col("status").isin(*total_of)).agg(F.lit("TOTAL").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    return full.unionByName(total)


def duplicate_keys(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that several owners have, and which."""
    out = rows.select(key, owner).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(owner)).alias("owners"))
    return out.where("n > 1")
