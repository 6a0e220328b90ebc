"""What a table demands of its rows, kept beside it: schema, required fields and vocabularies, by version.

Every writer of store.py reads them and splits rows by them. A change makes a new version; one that rows of the table don't meet is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import meta

FILE = "_table.json"


class BrokenTable(ValueError):
    """A change that the rows of a table don't meet, or a table without constraints where some are needed."""


@dataclass
class Constraints:
    """required: fields that mustn't be null; vocabularies: the values that a field that isn't null may have. A field is a path: a.b is b of a struct, a[].b is b of each element of an array. What a null struct or array would hold isn't demanded."""

    schema: T.StructType
    key: str = "projectName"
    required: list[str] = field(default_factory=list)
    vocabularies: dict[str, list] = field(default_factory=dict)
    version: int = 1

    def as_json(self) -> dict:
        return {"schema": self.schema.jsonValue(), "key": self.key, "required": self.required, "vocabularies": self.vocabularies, "version": self.version}

    @staticmethod
    def of_json(data: Mapping) -> Constraints:
        return Constraints(T.StructType.fromJson(data["schema"]), data["key"], list(data["required"]), dict(data["vocabularies"]), data["version"])

    def broken(self) -> Column:
        """The demands that a row doesn't meet, as texts."""
        checks = [F.when(~_holds(path, lambda c: c.isNotNull()), f"{path} is missing") for path in self.required]
        checks += [F.when(~_holds(path, lambda c, v=values: c.isNull() | c.isin(*v)), f"{path} is unknown") for path, values in self.vocabularies.items()]
        return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def _holds(path: str, test: Callable[[Column], Column], of: Column | None = None) -> Column:
    """Whether a test holds for all values that a path leads to."""
    name, _, rest = path.partition(".")
    many, name = name.endswith("[]"), name.removesuffix("[]")
    here = F.col(f"`{name}`") if of is None else of[name]
    inner = (lambda c: c.isNull() | _holds(rest, test, c)) if rest else test
    if many:
        return F.coalesce(F.forall(here, lambda x: F.coalesce(inner(x), F.lit(False))), F.lit(True))
    return F.coalesce(inner(here), F.lit(False))


def read(spark: SparkSession, path: str) -> Constraints | None:
    data = meta.read_json(spark, f"{path}/{FILE}")
    return Constraints.of_json(data) if data else None


def put(spark: SparkSession, path: str, wanted: Constraints) -> Constraints:
    """Make constraints those of a table: version 1 of a new one, the next version where they differ from what it has. Columns may be added, not dropped or changed in type, and rows that are there must meet the new demands."""
    old = read(spark, path)
    if old is None:
        wanted.version = 1
    else:
        if {**old.as_json(), "version": 0} == {**wanted.as_json(), "version": 0}:
            return old
        kinds = {f.name: f.dataType for f in wanted.schema}
        if old.key != wanted.key or any(kinds.get(f.name) != f.dataType for f in old.schema):
            raise BrokenTable("columns can only be added")
        rows = spark.read.schema(wanted.schema).parquet(path)
        first = rows.select(wanted.broken().alias("broken")).where(F.size("broken") > 0).first()
        if first:
            raise BrokenTable(f"rows of the table don't meet version {old.version + 1}: {', '.join(first['broken'])}")
        wanted.version = old.version + 1
    meta.write_json(spark, f"{path}/{FILE}", wanted.as_json())
    return wanted


def split(rows: DataFrame, wanted: Constraints) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the demands, in the table's columns; and others, with what they don't meet as broken. A column that rows lack is null; one that the table lacks is an error, as it would be lost."""
    extra = [c for c in rows.columns if c not in wanted.schema.names]
    if extra:
        raise BrokenTable(f"the table has no column {', '.join(extra)}")
    kinds = dict(zip(rows.columns, rows.schema, strict=True))
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema if f.name not in kinds]
    whole = rows.select("*", *lacking).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.schema)).withColumn("broken", wanted.broken())
    return whole.where(F.size("broken") == 0).drop("broken"), whole.where(F.size("broken") > 0)


def all_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))
