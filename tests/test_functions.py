from datetime import datetime

import pytest
from pyspark.sql import functions as F

from repolens.functions import scalars as X
from repolens.functions import vocab as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1), ("\n\n", 2)])
def test_count_lines(spark, text, n):
    assert one(spark, X.count_lines(F.lit(text))) == n


@pytest.mark.parametrize("name,ext", [("a.tar.GZ", "gz"), (".env", ""), ("Dockerfile", ""), ("x.Java", "java"), ("a.", "")])
def test_extension(spark, name, ext):
    assert one(spark, X.extension(F.lit(name))) == ext


@pytest.mark.parametrize("path,depth,module", [("src/a/b.ts", 2, "src/a"), ("src\\a\\b.ts", 2, "src/a"), ("a.ts", 2, None), ("/src//a.ts", 2, "src/a.ts")])
def test_module_of_path(spark, path, depth, module):
    assert one(spark, X.module_of_path(F.lit(path), depth)) == module


@pytest.mark.parametrize("ref,module", [("./c.ts", "src/a"), ("../x/y.ts", "src/x"), ("../../../q/r.ts", "../q"), ("com.acme.util.X", "com.acme"), ("one", None), ("lib/x/y", "lib/x"), ("a.b", "a.b")])
def test_module_of_reference(spark, ref, module):
    assert one(spark, X.module_of_reference(F.lit(ref), F.lit("src/a/b.ts"), 2)) == module


@pytest.mark.parametrize("n,most,level", [(70, 100, "Very High"), (69, 100, "High"), (40, 100, "High"), (20, 100, "Medium"), (19, 100, "Low"), (5, 0, "Low"), (5, -1, "Low")])
def test_coupling_level(spark, n, most, level):
    assert one(spark, X.coupling_level(F.lit(n), F.lit(most))) == level


@pytest.mark.parametrize("n,level", [(21, "Very High"), (20, "High"), (10, "Moderate"), (5, "Low")])
def test_debt_level(spark, n, level):
    assert one(spark, X.debt_level(F.lit(n))) == level


@pytest.mark.parametrize("text,kind", [("cron: 0 2", "cron"), ("crontab entry", "cron"), ("Task Scheduler", "task-scheduler"), ("schedule: x", "scheduled"), ("systemd timer", "systemd-timer"), ("  ", "unknown"), ("startup, x", "startup"), ("my thing: x", "my thing")])
def test_trigger_type(spark, text, kind):
    assert one(spark, X.trigger_type(F.lit(text))) == kind


def test_texts(spark):
    assert one(spark, X.title_case(F.lit("camelCaseURL name"))) == "Camel Case URL Name"
    assert one(spark, X.js_trim(F.lit(" ﻿\t a b  \n"))) == "a b"
    assert one(spark, X.summary_bullet(F.lit("x"), F.lit(None).cast("string"), F.lit("i"))) == "* x: undefined i"
    assert one(spark, X.code_block(F.lit("ts"), F.lit("c"))) == "```ts\nc\n```\n\n"
    assert one(spark, X.code_block_with_path(F.lit("p"), F.lit(" c\n"))) == "\n``` p\nc\n```\n"
    assert one(spark, X.join_lines(F.array(F.lit("a"), F.lit("b")), ";", "-")) == "-a;-b"
    assert one(spark, X.mermaid_node(F.lit("_A b--C_"), F.lit(3))) == "a_b_c_3"
    assert one(spark, X.relative_path(F.lit("/r/"), F.lit("/r/a/b"))) == "a/b"
    assert one(spark, X.file_timestamp(F.lit(datetime(2025, 1, 2, 3, 4, 5)))) == "2025-01-02T03-04-05-000Z"
    assert one(spark, X.table_cell(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("url,out", [("postgres://u:p@h:1/x", "postgres://REDACTED:REDACTED@h:1/x"), ("http://h/a@b", "http://h/a@b"), ("nonsense", V.REDACTED_URL), ("http://u@h", "http://REDACTED:REDACTED@h")])
def test_redact_url(spark, url, out):
    assert one(spark, X.redact_url(F.lit(url))) == out


def test_enums(spark):
    assert one(spark, X.normalise_enum(F.lit("jpa"), V.DATABASE_MECHANISMS)) == "JPA"
    assert one(spark, X.normalise_enum(F.lit("x"), V.DATABASE_MECHANISMS)) == "INVALID"
    assert one(spark, X.normalise_enum(F.lit(None).cast("string"), V.DATABASE_MECHANISMS)) is None
    assert one(spark, X.normalise_enums(F.array(F.lit("read"), F.lit(None), F.lit("q")), V.OPERATION_TYPES)) == ["READ", "INVALID"]


def test_vocabularies():
    assert len(V.BINARY_EXTENSIONS) == 64 and len(V.CANONICAL_TYPES) == 26 and len(V.LLM_STATUSES) == 7
    assert {t for t, _, _ in V.EXTENSION_TYPES} | set(V.FILENAME_TYPES.values()) <= set(V.CANONICAL_TYPES)


def test_percentage_and_average(spark):
    assert one(spark, X.percentage(F.lit(1), F.lit(8))) == 13 and one(spark, X.percentage(F.lit(0), F.lit(0))) == 0
    assert one(spark, X.average(F.lit(3), F.lit(0))) == 0.0
