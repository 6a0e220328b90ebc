"""Repair and coercion as Columns. Texts that the JVM parses, and that fit the schema if there is one, don't reach Python."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructField, StructType

from ...session import ship
from .driver import parse_and_validate
from .names import FARTHEST, SHORTEST_END, SHORTEST_FUZZY, SHORTEST_MIDDLE

RESULT = StructType([StructField("json", StringType()), StructField("repairs", ArrayType(StringType())), StructField("steps", ArrayType(StringType())), StructField("mutated", BooleanType()), StructField("error", StringType())])
TYPES = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.string()]


def _json(data: object) -> str:
    """JSON of parsed data; numbers that it can't hold become null."""
    try:
        return json.dumps(data, ensure_ascii=False, allow_nan=False)
    except ValueError:
        plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else None if isinstance(x, float) and not math.isfinite(x) else x
        return json.dumps(plain(data), ensure_ascii=False)


def _udf(schema: DataType | None):
    @arrow_udf(RESULT)
    def repair(texts: pa.Array) -> pa.Array:
        """Texts that are equal within a batch are repaired once."""
        done: dict[str | None, int] = {None: 0}
        rows: list[tuple] = [(None, None, None, None, None)]
        at = []
        for text in texts.to_pylist():
            k = done.get(text)
            if k is None:
                k = done[text] = len(rows)
                r = parse_and_validate(text, schema)
                rows.append((_json(r.data) if r.ok else None, r.repairs, r.steps, r.significant or any(s not in ("structure: fences",) for s in r.steps), r.error))
            at.append(k)
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], RESULT.names).take(pa.array(at, pa.int32()))

    return repair


def one_value(text: Column) -> Column:
    """Whether a text is one whole JSON object or array. The JVM's parser stops after the first value, so the text stands in an object whose last property must be reached, and in an array that must have one element. What follows a first value can pass for the rest of an object, or for the rest of an array, but not for both. Each parse is tried only on what the test before it lets through, as the parser's failures are dear."""
    framed = F.rlike(text, F.lit(r"^\s*[{\[]")) & F.rlike(text, F.lit(r"[}\]]\s*$"))
    last = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"text":'), text, F.lit(',"_end_of_text":true}'))), "$._end_of_text", "boolean")
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get(alone, "$[0]", "variant").isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()
    return F.coalesce(F.when(framed, F.when(last, single)), F.lit(False))


def fits(value: Column, schema: DataType) -> Column:
    """Whether a variant fits a schema as it is, by the rules of coerce.invalid. Where the JVM can't tell, it says no."""
    kind = F.schema_of_variant(value)
    if isinstance(schema, StructType):
        good = kind.startswith("OBJECT<")
        for f in schema.fields:
            if '"' in f.name or "\\" in f.name:
                return F.lit(False)
            field = F.try_variant_get(value, f'$["{f.name}"]', "variant")
            good = good & F.when(field.isNull(), F.lit(f.nullable)).otherwise(fits(field, f.dataType))
    elif isinstance(schema, ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        good = kind.startswith("ARRAY<") & F.forall(items, lambda x: fits(x, schema.elementType))
    elif isinstance(schema, BooleanType):
        good = kind == "BOOLEAN"
    elif isinstance(schema, NumericType):
        good = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    elif isinstance(schema, StringType):
        good = kind == "STRING"
    else:
        good = value.isNotNull()
    return F.coalesce(good, F.lit(False))


def repaired(df: DataFrame, text: str, out: str = "repaired", schema: DataType | None = None) -> DataFrame:
    """df with struct(json, repairs, steps, mutated, error) of a text column. Texts that are whole JSON, and fit the schema if there is one, are passed on as they are. A null text is an error."""
    ship(df.sparkSession)
    c = F.col(text)
    good = one_value(c)
    if schema is not None:
        good = F.when(good, fits(F.try_parse_json(c), schema)).otherwise(False)
    fine = F.struct(c.alias("json"), F.array().cast("array<string>").alias("repairs"), F.array().cast("array<string>").alias("steps"), F.lit(False).alias("mutated"), F.lit(None).cast("string").alias("error"))
    marked = df.withColumn("_whole", good)
    rest = _udf(schema)(F.when(~F.col("_whole"), F.coalesce(c, F.lit(""))))
    return marked.withColumn(out, F.when(F.col("_whole"), fine).otherwise(rest)).drop("_whole")


def parsed(df: DataFrame, text: str, schema: DataType, out: str = "parsed") -> DataFrame:
    """df with the parsed struct or array of a text column, and its error."""
    got = repaired(df, text, "_repaired", schema)
    return got.withColumn(out, F.from_json("_repaired.json", schema)).withColumn(f"{out}_error", F.col("_repaired.error")).drop("_repaired")


# Transforms that need no Python.


def number_column(c: Column) -> Column:
    """A number in a text: the whole, else a leading one, else the first one."""
    t = F.trim(c)
    part = lambda p: F.regexp_extract(t, p, 1).try_cast("double")
    return F.coalesce(t.try_cast("double"), part(r"^[~≈]?\s*(-?\d+(?:\.\d+)?)"), part(r"\b(-?\d+(?:\.\d+)?)\b"))


def list_column(c: Column) -> Column:
    """Items of a bulleted, numbered, separated or lined list; an empty array for prose."""
    t = F.trim(c)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    without = lambda mark: F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, f"^{mark}\\s+", ""))), lambda x: x != "")
    bullet, numbered = "[-*•◦▪▸►▹‣⁃○●◆◇■□→➤➢]", "\\d+[.)]"
    items = F.filter(F.transform(F.split(t, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    mean = lambda a: F.aggregate(F.transform(a, lambda x: F.char_length(x)), F.lit(0), lambda s, x: s + x) / F.size(a)
    prose = t.rlike(r"\.\s+[A-Z]") | t.endswith(".")
    some = F.exists(lines, lambda x: x.rlike(f"^{bullet}\\s+"))
    numbers = F.exists(lines, lambda x: x.rlike(f"^{numbered}\\s+"))
    listed = F.from_json(F.when(t.startswith("["), F.when(F.try_parse_json(t).isNotNull(), t).otherwise(F.replace(t, F.lit("'"), F.lit('"')))), "array<string>")
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.when(t == "", none),
        listed,
        F.when(some, without(bullet)),
        F.when(numbers, without(numbered)),
        F.when((F.regexp_count(t, F.lit("[,;]")) >= 2) & ~prose & (F.size(items) >= 2) & (mean(items) < 50), items),
        F.when((F.size(lines) >= 2) & (mean(lines) < 60), lines),
        none,
    )


def nearest_name(fragment: Column, known: list[str]) -> Column:
    """The known property that a fragment stands for: equal, else the shortest that it begins, else that it ends, else equal or begun without separators, else the shortest that holds it, else the nearest by edit distance. Case doesn't count; null if none fits."""
    if not known:
        return F.lit(None).cast("string")
    f, plain = F.lower(fragment), F.regexp_replace(F.lower(fragment), "[^a-z0-9]", "")
    n = F.char_length(fragment)
    ranked, place = [], lambda tier, a, b: F.struct(F.lit(tier).alias("tier"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    for name in known:
        low, bare = F.lit(name.lower()), F.lit("".join(c for c in name.lower() if c.isalnum()))
        size, middle, distance, zero = F.lit(len(name)), F.position(f, low), F.levenshtein(f, low), F.lit(0)
        rank = (
            F.when(f == low, place(0, zero, zero))
            .when((n >= SHORTEST_END) & F.startswith(low, f), place(1, size, zero))
            .when((n >= SHORTEST_END) & F.endswith(low, f), place(2, size, zero))
            .when((n >= SHORTEST_END) & (plain == bare), place(3, zero, zero))
            .when((n >= SHORTEST_END) & (plain != "") & F.startswith(bare, plain), place(4, size, zero))
            .when((n >= SHORTEST_MIDDLE) & (middle > 1), place(5, size, middle))
            .when((n >= SHORTEST_FUZZY) & (distance <= F.least(F.lit(FARTHEST), F.greatest(F.lit(1), F.floor(n / 3)))), place(6, distance, zero))
        )
        ranked.append(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.lit(name).alias("name"))))
    return F.when(n > 0, F.array_min(F.array_compact(F.array(*ranked)))["name"])
