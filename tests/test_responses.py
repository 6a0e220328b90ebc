import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from repolens.functions.jsonrepair import columns
from repolens.functions.jsonrepair.coerce import invalid
from repolens.functions.jsonrepair.driver import parse
from repolens.operators import batching, completion, nearest, responses, retrieval
from repolens.operators.completion import Candidate, Response
from repolens.plans.json_forms import FORMS
from repolens.sources import store

SCHEMA = StructType([StructField("k", LongType(), False)])


@pytest.mark.parametrize("kind,broken,whole", FORMS, ids=[f[0] for f in FORMS])
def test_forms_of_damage(kind, broken, whole):
    got = parse(broken.replace("%d", "7"))
    assert got.error is None and got.data == json.loads(whole.replace("%d", "7"))


@pytest.mark.parametrize("text", ['{"a": ' * 2000 + "1" + "}" * 2000, '{"a": ' * 2000 + "1" + "}" * 1999, "[" * 3000 + "]" * 2999])
def test_deep_texts(text):
    got, depth = parse(text), 0
    assert got.error is None
    data = got.data
    while isinstance(data, dict | list) and data:
        data, depth = (data["a"] if isinstance(data, dict) else data[0]), depth + 1
    assert depth >= 1999


def test_texts_that_go_on_after_the_first_value_are_repaired(spark):
    texts = ['{"a": 1}}}', '{"a": 1} and more', '{"a": 1}{"b": 2}', '[1]]', '{"a": 1}, {"b": 2}', ' {"a": 1}\n']
    got = [r["repaired"] for r in columns.repaired(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string"), "t").orderBy("id").collect()]
    assert all(r["error"] is None and json.loads(r["json"]) for r in got)
    assert [r["mutated"] for r in got] == [True] * 5 + [False]


WHOLE = ['{"k": 1}', ' {"k": 1.5, "more": [null]}\n', '{"k": 1e3, "x": {"k": "text"}}']
#: Texts whose first value is followed by what could pass for the rest of an object or an array, and others that aren't JSON as they stand.
NOT_WHOLE = ['{"k": 1},"b": {"c": 2}', '[1, 2],"x":3', '{"k": 1},"_end_of_text":true}', '[1],"_end_of_text":true} and more', '{"k": 1}, {"k": 2}', '{"k": 1}] and more', '[1], [2', '{"k": 1}}', '{"k": 1', "", "no JSON", '"text"', "3"]
#: JSON that doesn't fit the schema as it is.
UNFIT = ['{"k": "1"}', '{"k": null}', '{"l": 1}', "[1, 2]", '{"k": true}']


def reached(monkeypatch, spark, texts, schema=None):
    """The texts that Python gets to see."""

    def mark(_):
        @F.pandas_udf(columns.RESULT)
        def python(x: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([(t, None, None, None, None if t is None else "python") for t in x], columns=columns.RESULT.names)

        return python

    monkeypatch.setattr(columns, "_udf", mark)
    got = columns.repaired(spark.createDataFrame([(t,) for t in texts], "t string"), "t", schema=schema)
    return [r["t"] for r in got.where("repaired.error = 'python'").collect()]


def test_whole_texts_stay_in_the_jvm(spark, monkeypatch):
    texts = [*WHOLE, *UNFIT, *NOT_WHOLE]
    assert sorted(reached(monkeypatch, spark, texts)) == sorted(NOT_WHOLE)
    assert sorted(reached(monkeypatch, spark, texts, SCHEMA)) == sorted([*UNFIT, *NOT_WHOLE])


def test_what_passes_is_json(spark):
    got = columns.repaired(spark.createDataFrame([(t,) for t in [*WHOLE, *NOT_WHOLE, '{"k": 1e999, x: [1e999, 2]}']], "t string"), "t").collect()
    for r in got:
        assert r["repaired"]["error"] or json.loads(r["repaired"]["json"], parse_constant=lambda c: pytest.fail(c)) is not None
    assert {r["t"]: r["repaired"]["mutated"] for r in got if not r["repaired"]["error"]}['{"k": 1},"b": {"c": 2}']


NESTED = StructType([StructField("name", StringType(), False), StructField("items", ArrayType(StructType([StructField("n", DoubleType(), False), StructField("on", BooleanType())]))), StructField("tags", ArrayType(StringType()))])


def test_the_jvm_accepts_what_python_does(spark, monkeypatch):
    """Every text that the JVM lets through fits the schema by Python's check, and every one that fits is let through."""
    texts = ['{"name": "a"}', '{"name": "a", "items": []}', '{"name": "a", "items": [{"n": 1}, {"n": 2.5, "on": true}], "tags": ["x", ""]}', '{"name": "", "tags": [], "other": {"n": []}}']
    wrong = ['{"name": 1}', "{}", '{"name": "a", "items": [{"on": true}]}', '{"name": "a", "items": {"n": 1}}', '{"name": "a", "items": [{"n": 1, "on": 0}]}', '{"name": "a", "tags": ["x", 1]}', '{"name": "a", "tags": ["x", null]}', '{"name": "a", "items": null}', '[{"name": "a"}]']
    assert all(invalid(json.loads(t), NESTED) is None for t in texts) and all(invalid(json.loads(t), NESTED) for t in wrong)
    assert sorted(reached(monkeypatch, spark, [*texts, *wrong], NESTED)) == sorted(wrong)


def test_gate():
    assert responses.gate("some text").data == "some text"
    for blank in ("", " \n\t", " ﻿"):
        assert not responses.gate(blank).ok
    for odd in (None, 3, {"k": 1}):
        with pytest.raises(responses.BadContent):
            responses.gate(odd)
    with pytest.raises(responses.BadConfiguration):
        responses.gate("x", responses.TEXT, SCHEMA)
    with pytest.raises(responses.BadConfiguration):
        responses.gate("{}", responses.JSON)
    with pytest.raises(responses.BadConfiguration):
        responses.accepting(responses.JSON)
    whole = lambda x: responses.gate(x, responses.JSON, SCHEMA)
    assert whole('{"k": 1}').data == {"k": 1} and whole("{k: 1,}").data == {"k": 1}
    assert whole({"k": 1}).ok and whole({"k": 1}).steps == ["pre-parsed object"]
    assert not whole(None).ok and not whole("no JSON").ok and not whole("").ok and not whole({"l": 1}).ok


def test_gate_of_columns(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, " \n "), (4, "")], "id int, content string")
    assert {r["id"]: r["status"] for r in responses.gated(rows, "content").collect()} == {1: "COMPLETED", 2: "INVALID", 3: "INVALID", 4: "INVALID"}
    rows = spark.createDataFrame([(1, '{"k": 1}'), (2, None), (3, "no"), (4, "{k: 2"), (5, '{"l": 3}')], "id int, content string")
    got = {r["id"]: (r["status"], r["generated"] and r["generated"]["k"], r["error"] is None) for r in responses.gated(rows, "content", responses.JSON, SCHEMA).collect()}
    assert got == {1: ("COMPLETED", 1, True), 2: ("INVALID", None, False), 3: ("INVALID", None, False), 4: ("COMPLETED", 2, True), 5: ("INVALID", None, False)}


def run(*said):
    left, events = list(said), []

    def model(prompt, name):
        now = left.pop(0)
        if isinstance(now, Exception):
            raise now
        return now

    return completion.attempt(model, "p", "m", events, sleep=lambda s: None), events, len(left)


def test_retries():
    late = Response("COMPLETED", "late")
    assert run(OSError(), late) == (late, [], 0)
    assert run(Response("OVERLOADED"), OSError(), late) == (late, ["OVERLOAD_RETRY"], 0)
    assert run(Response("OVERLOADED"), OSError(), OSError()) == (Response("OVERLOADED"), ["OVERLOAD_RETRY"], 0)
    assert run(OSError(), OSError(), OSError()) == (None, [], 0)
    assert run(TypeError(), late) == (None, [], 1)


def test_answers_that_fail_the_gate_are_retried():
    said = [Response("COMPLETED", "  "), Response("COMPLETED", "no JSON"), Response("COMPLETED", '{"k": 3}')]
    check = responses.accepting(responses.JSON, SCHEMA)
    out = completion.complete(lambda p, n: said.pop(0), "p", [Candidate("a")], sleep=lambda s: None, check=check)
    assert (out.text, out.events) == ('{"k": 3}', ["HOPEFUL_RETRY", "HOPEFUL_RETRY", "SUCCESS"])


def test_writing_a_batch_again_adds_nothing(spark, tmp_path):
    at = f"{tmp_path}/table"
    rows = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("p", "b", 3), ("q", "a", 4), ("q", None, 5)], "projectName string, filepath string, x int")
    rows.limit(0).write.partitionBy("projectName").parquet(at)
    good, bad = F.col("filepath").isNotNull(), f"{tmp_path}/bad"
    for _ in range(2):
        store.insert_new(rows, at, valid=good, rejects=bad)
    store.insert_new(rows.withColumn("filepath", F.lit("c")), at, valid=good)
    got = sorted((r["projectName"], r["filepath"]) for r in store.read(spark, at).collect())
    assert got == [("p", "a"), ("p", "b"), ("p", "c"), ("q", "a"), ("q", "c")]
    assert spark.read.parquet(bad).count() == 2


def test_batches_of_texts_that_share_a_place(spark):
    rows = [("g", 0, "x" * 30)] * 3 + [("g", 1, "y" * 30), ("h", 0, "z"), (None, 0, "n"), ("g", 2, None)]
    got = batching.token_batches(spark.createDataFrame(rows, "g string, o int, t string"), "g", ["o"], "t", 20, 1.0, 1.0 * 3)
    by = sorted(((r["g"] or "", r["batch"], r["item"], r["text"]) for r in got.collect()))
    assert by == [("", 0, 0, "n"), ("g", 0, 0, "x" * 30), ("g", 0, 1, "x" * 30), ("g", 1, 0, "x" * 30), ("g", 1, 1, "y" * 30), ("h", 0, 0, "z")]


def test_queries_in_blocks(spark, monkeypatch):
    rows = spark.range(50).select(F.col("id").alias("k"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"))
    wanted = lambda: sorted(map(tuple, nearest.nearest_of_many(rows, rows.where("k % 5 = 0").select(F.col("k").alias("q"), "v"), "v", "k", "q", 3).collect()))
    whole = wanted()
    monkeypatch.setattr(nearest, "QUERIES_AT_ONCE", 3)
    assert wanted() == whole and len(whole) == 30
