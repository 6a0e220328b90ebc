"""Tables of Parquet files, partitioned by project."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..schemas import SOURCES, empty
from . import constraints
from .constraints import Constraints
from .keyed import KeyIndex


def create(spark: SparkSession, path: str, ddl: str = SOURCES, key: str = "projectName", required: Sequence[str] | None = None, vocabularies: Mapping[str, Sequence] | None = None) -> Constraints:
    """An empty table with its constraints beside it; of a table that is there, the constraints are changed (constraints.put). Without any given, those of valid_source() where the columns are a source's."""
    schema = empty(spark, ddl).schema
    if required is None and vocabularies is None and set(REQUIRED) <= set(schema.names):
        required, vocabularies = REQUIRED, {"canonicalType": V.CANONICAL_TYPES} if "canonicalType" in schema.names else {}
    empty(spark, ddl).write.mode("ignore").partitionBy(key).parquet(path)
    return constraints.put(spark, path, Constraints(schema, key, list(required or ()), {c: list(v) for c, v in (vocabularies or {}).items()}))


def read(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    return (spark.read.schema(ddl) if ddl else spark.read).parquet(path)


def valid_source() -> Column:
    """Required fields are there, and the type is a known one."""
    present = constraints.all_of([F.col(c).isNotNull() for c in REQUIRED])
    return present & (F.col("canonicalType").isNull() | F.col("canonicalType").isin(*V.CANONICAL_TYPES))


#: Fields of a source file that mustn't be null.
REQUIRED = ("projectName", "filename", "filepath", "fileExtension")


def split_valid(rows: DataFrame, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that hold, and the others."""
    flag = F.coalesce(valid if valid is not None else valid_source(), F.lit(False))
    return rows.where(flag), rows.where(~flag)


def _split(rows: DataFrame, path: str, valid: Column | None) -> tuple[DataFrame, DataFrame]:
    """By the condition that is given, else by the table's constraints, else as source files."""
    kept = constraints.read(rows.sparkSession, path) if valid is None else None
    return constraints.split(rows, kept) if kept else split_valid(rows, valid)


def insert(rows: DataFrame, path: str, rejects: str | None = None, valid: Column | None = None, key: str = "projectName") -> None:
    """Append valid rows; the others go to a table of their own, with what they don't meet, or are dropped. rows are evaluated once for each table."""
    good, bad = _split(rows, path, valid)
    good.write.mode("append").partitionBy(key).parquet(path)
    if rejects:
        bad.write.mode("append").parquet(rejects)


def unseen(rows: DataFrame, old: DataFrame, unique: Sequence[str]) -> DataFrame:
    """rows whose values of the unique columns are in no row of old, one of each. Only the unique columns of old are read."""
    return rows.dropDuplicates(list(unique)).join(old.select(*unique), list(unique), "left_anti").select(*rows.columns)


def insert_new(rows: DataFrame, path: str, unique: Sequence[str] = ("projectName", "filepath"), rejects: str | None = None, valid: Column | None = None, key: str = "projectName", index: KeyIndex | None = None) -> None:
    """insert() without what is there already: of rows that repeat the unique columns, within rows or in the table, the first written stays. A failed batch can so be written again whole. With an index of the table's keys the table isn't read; all inserts must then go through the index."""
    good, bad = _split(rows, path, valid)
    if index is not None:
        index.insert_new(good, lambda new: new.write.mode("append").partitionBy(key).parquet(path))
        if rejects:
            bad.write.mode("append").parquet(rejects)
        return
    old = read(rows.sparkSession, path, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))
    unseen(good, old, unique).write.mode("append").partitionBy(key).parquet(path)
    if rejects:
        bad.write.mode("append").parquet(rejects)


def upserted(old: DataFrame, new: DataFrame, key: str = "projectName", fields: Iterable[str] | None = None) -> DataFrame:
    """old with the fields of new that aren't null, and new rows added. One row per key in new."""
    fields = list(fields if fields is not None else (c for c in new.columns if c != key))
    renamed = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    out = old.join(renamed, key, "full_outer")
    return out.select(*(c if c == key else F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns))


def updated(old: DataFrame, new: DataFrame, key: str = "projectName") -> DataFrame:
    """The same, without new rows."""
    return upserted(old, new.join(old.select(key).distinct(), key, "left_semi"), key)


def without_project(rows: DataFrame, project: str) -> DataFrame:
    return rows.where(~F.col("projectName").eqNullSafe(project))


def delete_project(spark: SparkSession, project: str, *paths: str) -> None:
    """Delete a project's folder of each table; other projects' files aren't touched."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/projectName={project}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def replace_projects(rows: DataFrame, path: str, key: str = "projectName") -> None:
    """Overwrite the projects that occur in rows, and no others. Rows that don't meet the table's constraints are an error, as the projects would lose them."""
    kept = constraints.read(rows.sparkSession, path)
    if kept:
        rows, bad = constraints.split(rows, kept)
        if first := bad.first():
            raise constraints.BrokenTable(", ".join(first["broken"]))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
