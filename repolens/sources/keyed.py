"""An index of the keys of a table, bucketed and sorted by key, for inserts that skip what is there already.

A table that is bucketed by its keys is joined without being shuffled: a batch is dealt to the buckets, and each task sorts and reads one bucket of keys. Parquet's bloom filters let a look-up of a few keys skip the files that don't hold them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import meta

BUCKETS = 200


class KeyIndex:
    """Keys of a table at path, kept at path + "-keys". The values of the unique columns make one key, a JSON array, so that a column which is the same in a whole batch doesn't drop out of the join and its bucketing with it."""

    def __init__(self, spark: SparkSession, path: str, unique: Sequence[str] = ("projectName", "filepath"), buckets: int = BUCKETS):
        self.spark, self.path, self.unique = spark, path, list(unique)
        self.folder = f"{path.rstrip('/')}-keys"
        note = f"{self.folder}/_index.json"
        had = meta.read_json(spark, note)
        if had is None:
            had = {"buckets": buckets, "unique": self.unique}
            meta.write_json(spark, note, had)
        elif had["unique"] != self.unique:
            raise ValueError(f"the index is of {', '.join(had['unique'])}")
        self.buckets = had["buckets"]
        # The catalogue of a session may forget tables; their files tell what is in them.
        self.name = f"keys_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (key string) USING parquet OPTIONS (`parquet.bloom.filter.enabled#key` true) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")

    def keys(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def key(self) -> Column:
        """The key of a row; null if one of the columns is."""
        values = [F.col(c).cast("string") for c in self.unique]
        some = reduce(lambda a, b: a & b, (v.isNotNull() for v in values))
        return F.when(some, F.to_json(F.array(*values)))

    def unseen(self, rows: DataFrame) -> DataFrame:
        """rows whose keys aren't in the index, one of each key. Null keys are never in it, and all stay."""
        keyed = rows.withColumn("_key", self.key())
        # Dealt to the index's buckets once, for repeats within the rows and for the join.
        mine = keyed.where("_key is not null").repartition(self.buckets, "_key").dropDuplicates(["_key"])
        known = self.keys().withColumnRenamed("key", "_key").hint("merge")
        return mine.join(known, "_key", "left_anti").select(*rows.columns).unionByName(keyed.where("_key is null").select(*rows.columns))

    def add(self, rows: DataFrame) -> None:
        keys = rows.select(self.key().alias("key")).where("key is not null")
        keys.repartition(self.buckets, "key").sortWithinPartitions("key").write.insertInto(self.name)

    def has(self, *key: object) -> bool:
        """Whether a key is in the index. Only its bucket is read, of that only files whose filters may hold it."""
        wanted = self.spark.createDataFrame([key], ", ".join(f"`{c}` string" for c in self.unique)).select(self.key()).first()[0]
        return not self.keys().where(F.col("key") == wanted).isEmpty()

    def insert_new(self, rows: DataFrame, write: Callable[[DataFrame], None]) -> None:
        """write(rows) with what isn't there yet, and remember its keys. The new rows are found once, and kept until both are done. A batch that fails in between leaves a mark; the next one then takes the table's own keys into the index first."""
        mark = f"{self.folder}/_inserting"
        if meta.exists(self.spark, mark):
            self.repair()
        with Scratch(self.spark, "new_rows") as tmp:
            new = tmp.save(self.unseen(rows), "rows")
            meta.write_json(self.spark, mark, True)
            write(new)
            self.add(new)
        meta.delete(self.spark, mark)

    def repair(self) -> None:
        """Add the keys of rows of the table that the index doesn't have."""
        if meta.exists(self.spark, self.path):
            self.add(self.unseen(self.spark.read.parquet(self.path).select(*self.unique)))
        meta.delete(self.spark, f"{self.folder}/_inserting")
