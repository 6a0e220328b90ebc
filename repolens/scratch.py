"""Tables in the folder that the driver and all executors share, so that lineage ends at files that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset and the executor runs in the driver (tests on one machine), a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = tempfile.mkdtemp(prefix="repolens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables of an operator. Used as a context manager: on exit, tables that weren't made with keep=True are deleted. Kept ones, which lazy results read, are deleted when the application's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def claim(self, name: str, keep: bool = False) -> str:
        """A path that is deleted like a table of this name."""
        path = f"{self.root}/{name}"
        self.made[path] = keep
        return path

    def save(self, df: DataFrame, name: str, keep: bool = False, **options) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        self.made[path] = keep
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
            self.made.pop(f"{self.root}/{name}", None)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if not any(self.made.values()):
            self._delete(self.root)
            return
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        for path, keep in self.made.items():
            if not keep:
                self._delete(path)


def numbered(rows: DataFrame, tmp: Scratch, order: list[Column], name: str, column: str = "idx") -> DataFrame:
    """rows, written in an order, with their place in it: 0, 1, 2, ... over the whole table.

    Range partitions are sorted and written with each row's place in its partition; the number of rows in the partitions before it, a row per partition, is added when the table is read. So no task sees more than its range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = tmp.save(spread.withColumn("_place", F.monotonically_increasing_id()), name, keep=True)
    part, before, total = F.shiftrightunsigned("_place", 33), [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row per partition
        before.append((r["part"], total))
        total += r["n"]
    starts = rows.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    place = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(column, place).drop("_part", "_before", "_place")
