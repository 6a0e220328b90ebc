"""Prompts as Column expressions."""

from pyspark.sql import functions as F

from repolens.operators import prompts as PR


def test_prompts(spark):
    kinds = {"java": PR.Kind("a class", ["Its name"], {"a": 1}, fenced=True), "sql": PR.Kind("statements", ["Tables"])}
    rows = spark.createDataFrame([("java", "class A {}"), ("sql", None), ("odd", "x"), (None, "y")], "t string, c string")
    got = [r[0] for r in rows.select(PR.source_prompt(kinds, F.col("t"), F.col("c"))).collect()]
    assert got[0].endswith('{"a": 1}\n\nCODE:\n```\nclass A {}\n```') and "* Its name" in got[0]
    assert got[1].endswith("CODE:\n") and got[2] is None and got[3] is None
    assert all(r[0].endswith("CODE:\n" + c) for r, c in zip(rows.where("c in ('x', 'y')").select(PR.source_prompt(kinds, F.col("t"), F.col("c"), "sql")).collect(), "xy"))


def test_partial_insights_say_so(spark):
    kind = PR.Kind("summaries", ["Names"], {}, PR.FILE_SUMMARIES, note="Own note.")
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "c string, p boolean")
    got = [r[0] for r in rows.select(PR.insight_prompt(kind, F.col("c"), F.col("p"))).collect()]
    assert ["part of many more file summaries" in g for g in got] == [True, False, False]
    assert ["Own note." in g for g in got] == [False, True, True]
