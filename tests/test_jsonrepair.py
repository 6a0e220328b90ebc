import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.functions.jsonrepair import coerce, columns
from repolens.functions.jsonrepair.driver import parse, parse_and_validate, validate_object

CASES = [
    ('{"a": 1}', {"a": 1}),
    ("```json\n{\"a\": 1}\n```", {"a": 1}),
    ("Sure! Here it is:\n{\"a\": 1}\nHope that helps {x}", {"a": 1}),
    ('{"a": 1}{"a": 1}', {"a": 1}),
    ('{"a": 1, // c\n "b": "http://x", /* d */ }', {"a": 1, "b": "http://x"}),
    ("{“a”: “b”, 'c': 'd'}", {"a": "b", "c": "d"}),
    ('{"a": "x\ny", "b": "it\\\'s \\d"}', {"a": "x\ny", "b": "it's \\d"}),
    ('{\\"a\\": \\"b\\"}', {"a": "b"}),
    ('{"a": [1, 2,], "b": 3,}', {"a": [1, 2], "b": 3}),
    ('{"a": "x"\n "b": ["y" "z"]}', {"a": "x", "b": ["y", "z"]}),
    ('{"m": [{"n": "t", "p": [{"q": "r", "s": "u"], "v": "w"}]}', {"m": [{"n": "t", "p": [{"q": "r", "s": "u"}], "v": "w"}]}),
    ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}),
    ('{"a": "cut off', {"a": "cut off"}),
    ('{"a": "say "hi" now", "b": 1}', {"a": 'say "hi" now', "b": 1}),
    ('{"a": "one\n"b": 2}', {"a": "one", "b": 2}),
    ('{a: 1, b: true, c: None, d: undefined, e: _3}', {"a": 1, "b": True, "c": None, "d": None, "e": 3}),
    ('{name": "x", "b: "y", "c" 3, "d" = 4}', {"name": "x", "b": "y", "c": 3, "d": 4}),
    ('{y"name": "x"}', {"name": "x"}),
    ('{"name":sem": "x", "t":aus: "y"}', {"name": "x", "t": "y"}),
    ('{"purpose": "purpose": "x"}', {"purpose": "x"}),
    ('{: "x"}', {"name": "x"}),
    ('{"a": "x" + "y" + Z.q, "b": K.p + "c", "d": P + Q}', {"a": "xy", "b": "c", "d": ""}),
    ('{"a": 1, * "b": 2, • "c": 3, - "d": 4}', {"a": 1, "b": 2, "c": 3, "d": 4}),
    ('{"a": 1,\nrunning on a machine "b": 2}', {"a": 1, "b": 2}),
    ('{"r": ["com.A", com.B", ar"com.C", com.D], "e": [ONE, TWO]}', {"r": ["com.A", "com.B", "com.C", "com.D"], "e": ["ONE", "TWO"]}),
    ('{"r": ["a", "b", "next": ["c"]}', {"r": ["a", "b"], "next": ["c"]}),
    ('{"f": [{"n": 1}, "n": 2, "m": 3}]}', {"f": [{"n": 1}, {"n": 2, "m": 3}]}),
    ('{"a": 1, "extra_thoughts": "hm", b: 2}', {"a": 1, "b": 2}),
    ('{"a": <|eos|> 1, <y_bin_3> "b": 2}', {"a": 1, "b": 2}),
    ('{"a": 1, ..., "b": [1, ...]}', {"a": 1, "b": [1]}),
    ('{"a": , "b": 1, "c": }', {"a": None, "b": 1, "c": None}),
    ('{"a": 1}\nI hope this is {what you need', {"a": 1}),
    ('"{\\"a\\": 1}"', {"a": 1}),
    ('[{"a": 1} {"a": 2}]', [{"a": 1}, {"a": 2}]),
    ('{"a": 1},\nstray "b": 2,\n"c": 3\n}', {"a": 1, "b": 2, "c": 3}),
    ('{"r": ["com.acme.lib.util.A", libs.lib.util.B", "com.acme.lib.util.C"]}', {"r": ["com.acme.lib.util.A", "com.acme.lib.util.B", "com.acme.lib.util.C"]}),
    ('{"a": "caf\\u00e9 \\ud83d\\ude00",}', {"a": "café 😀"}),
]


@pytest.mark.parametrize("text,data", CASES)
def test_repair(text, data):
    got = parse(text)
    assert got.ok and got.data == data
    try:
        json.loads(text)
        strictly = isinstance(json.loads(text), dict | list)
    except ValueError:
        strictly = False
    assert bool(got.repairs or got.steps) != strictly


@pytest.mark.parametrize("text", [None, "", "  ", "no json", "{", "}{", "[" * 5000])
def test_hopeless(text):
    got = parse(text)
    assert not got.ok and got.error.startswith("PARSE") or got.data in ({}, []) or isinstance(got.data, list)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.text("ab \n\"'\\{}[]:,é", max_size=12), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc", min_size=1, max_size=5), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(json_values.filter(lambda x: isinstance(x, dict | list)))
def test_valid_json_stays(value):
    got = parse(json.dumps(value))
    assert got.data == value and not got.repairs and not got.steps


@settings(max_examples=200, deadline=None)
@given(st.text("{}[]\":,ab1 \n\\'/*#<>.", max_size=60))
def test_any_text_ends(text):
    parse(text)


def test_time_is_linear():
    assert parse('{"a": [' + '"x" y, ' * 20_000).ok
    assert parse('{"a": "' + "b \" c " * 5000 + '"}').ok




def schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_transforms(spark):
    kind = schema(spark, "name string, n int, tags array<string>, items array<struct<a:int,b:int,c:int,d:int>>, fields string")
    assert coerce.drop_incomplete_items({"items": [{"a": 1, "b": 1, "c": 1, "d": 1}, {"a": 1}]}, kind) == {"items": [{"a": 1, "b": 1, "c": 1, "d": 1}]}
    assert coerce.drop_incomplete_items([{"a": 1, "b": 1}, {"a": 1}], kind) == [{"a": 1, "b": 1}, {"a": 1}]
    assert coerce.strings_to_arrays({"tags": "a, b; c", "name": "a, b; c"}, kind) == {"tags": ["a", "b", "c"], "name": "a, b; c"}
    assert coerce.null_fields_to_text({"name": "x", "fields": None}, kind) == {"name": "x", "fields": ""}
    assert coerce.drop_nulls({"a": None, "b": [{"c": None}]}, kind) == {"b": [{}]}
    assert coerce.strip_underscores({"name_": 1, "n_": 2, "n": 3, "q__": 4}, kind) == {"name": 1, "n_": 2, "n": 3, "q_": 4}
    assert coerce.texts_to_numbers({"N": "~150 items", "name": "7"}, kind) == {"N": 150, "name": "7"}
    assert coerce.unwrap_schema({"type": "object", "properties": {"name": {"type": "string", "description": "x"}}, "required": ["name"]}, kind) == {"name": "x"}


@pytest.mark.parametrize("text,items", [("", []), ('["a", "b"]', ["a", "b"]), ("['a', 'b']", ["a", "b"]), ("- a\n- b", ["a", "b"]), ("1. a\n2) b", ["a", "b"]), ("a, b; c", ["a", "b", "c"]), ("a\nb", ["a", "b"]), ("One, two, and three. Then four.", []), ("a, b", [])])
def test_split_list(spark, text, items):
    assert coerce.split_list(text) == items
    assert spark.range(1).select(columns.list_column(F.lit(text)).alias("x")).first()["x"] == items


@pytest.mark.parametrize("text,x", [("12", 12), (" -1.5 ", -1.5), ("~150 items", 150), ("about 7 of", 7), ("none", None), ("1e3", 1000)])
def test_number_in(spark, text, x):
    assert coerce.number_in(text) == x
    assert spark.range(1).select(columns.number_column(F.lit(text)).alias("x")).first()["x"] == x


def test_validation(spark):
    kind = schema(spark, "name string not null, n double, tags array<string>")
    assert parse_and_validate('{"name": "x", "n": 1, "more": 2}', kind).steps == []
    got = parse_and_validate('{"name": "x", "n": "12 units", "tags": "- a\\n- b", "z": null}', kind)
    assert got.ok and got.data == {"name": "x", "n": 12, "tags": ["a", "b"]} and "texts to numbers" in got.steps
    assert parse_and_validate('{"n": 1}', kind).error == "VALIDATION: $.name: missing"
    assert validate_object({"name": "x", "n": "3"}, kind).data["n"] == 3


def test_columns(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{a: 2,}"), (3, None), (4, "no"), (5, '```\n{"a": 5}\n```')], "i int, t string")
    got = {r["i"]: r["repaired"] for r in columns.repaired(rows, "t").collect()}
    assert (got[1]["json"], got[1]["mutated"], got[1]["repairs"]) == ('{"a": 1}', False, [])
    assert got[2]["mutated"] and json.loads(got[2]["json"]) == {"a": 2}
    assert got[3]["json"] is None and got[3]["error"].startswith("PARSE") and got[4]["error"].startswith("PARSE")
    assert not got[5]["mutated"] and got[5]["repairs"]
    kind = schema(spark, "a int, b array<string>")
    data = {r["i"]: (r["parsed"], r["parsed_error"]) for r in columns.parsed(rows, "t", kind).collect()}
    assert data[2][0]["a"] == 2 and data[2][1] is None and data[4][0] is None


@pytest.mark.parametrize("fragment,name", [("NAME", "name"), ("pur", "purpose"), ("ame", "name"), ("user_id", "userId"), ("user_i", "userId"), ("Refere", "internalReferences"), ("pupose", "purpose"), ("x", None), ("zzzzzz", None), ("", None)])
def test_nearest_name(spark, fragment, name):
    known = ["name", "nameOfLongerKind", "purpose", "userId", "internalReferences", "externalReferencesList"]
    assert spark.range(1).select(columns.nearest_name(F.lit(fragment), known).alias("x")).first()["x"] == name
    assert spark.range(1).select(columns.nearest_name(F.lit("a"), []).alias("x")).first()["x"] is None


def test_equal_texts_of_a_batch_are_repaired_once(monkeypatch):
    """a batch costs by its different texts; nulls and errors keep their places."""
    seen = []
    monkeypatch.setattr(columns, "parse_and_validate", lambda text, schema: (seen.append(text), parse_and_validate(text, schema))[1])
    texts = [None, "{'a': 1", "no data", '{"b": 2,}'] * 50 + ["{a: 3}"]
    got = columns._udf(None).func(pa.array(texts)).to_pylist()
    assert sorted(seen) == sorted({t for t in texts if t is not None})
    json_of = {None: None, "{'a': 1": '{"a": 1}', "no data": None, '{"b": 2,}': '{"b": 2}', "{a: 3}": '{"a": 3}'}
    assert [r["json"] for r in got] == [json_of[t] for t in texts]
    assert [r["error"] for r in got[:4]] == [None, None, "PARSE: no JSON", None] and got[0]["repairs"] is None and got[1]["repairs"] and got[1]["mutated"]


def test_a_schema_is_walked_once(monkeypatch):
    """the names of a schema aren't gathered anew for each answer."""
    from repolens.functions.jsonrepair import coerce

    walks = []
    real = coerce._walk
    monkeypatch.setattr(coerce, "_walk", lambda kind, depth=0: (walks.append(depth), real(kind, depth))[1])
    schemas = [T.StructType([T.StructField(n, T.LongType(), False)]) for n in "kj"]
    for schema in schemas + schemas[:1]:
        before = walks.count(0)
        name = schema.fields[0].name
        for k in range(50):
            got = parse_and_validate('{"%s": "about %d"}' % (name, k), schema)
            assert got.ok and got.data == {name: k}
        assert walks.count(0) == before + 1
