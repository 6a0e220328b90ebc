"""Names of properties that lost a part, against a search through all names."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from repolens.functions.jsonrepair import columns
from repolens.functions.jsonrepair.driver import parse_and_validate
from repolens.functions.jsonrepair.names import NameIndex

KNOWN = ["name", "purpose", "publicFunctions", "publicConstants", "internalReferences", "externalReferences", "database_name", "codeSmells", "description", "Name2"]


def test_the_index_finds_what_a_search_finds(spark):
    rng = random.Random(4)
    fragments = [*KNOWN, "", "x", "NAME", "na", "tion", "function", "databaseName", "database-na", "Referen", "purpse", "discription", "codeSmels", "zzzzzz", "nam", "ferenc"]
    for name in KNOWN * 12:
        a, b = sorted(rng.sample(range(len(name) + 1), 2))
        damaged = list(name[a:b])
        for _ in range(rng.randrange(3)):
            if damaged:
                damaged[rng.randrange(len(damaged))] = rng.choice("aexyz_")
        fragments.append("".join(damaged))
    got = spark.createDataFrame([(f,) for f in fragments], "f string").select("f", columns.nearest_name(F.col("f"), KNOWN).alias("n")).collect()
    index = NameIndex(KNOWN)
    for r in got:
        found = index.find(r["f"])
        assert (found[0] if found else None) == r["n"], r["f"]


@pytest.mark.parametrize("key,how", [("PURPOSE", "same"), ("publicF", "beginning"), ("Smells", "end"), ("databasename", "other separators"), ("licFunct", "middle"), ("desciption", "spelling")])
def test_kinds(key, how):
    assert NameIndex(KNOWN).find(key)[1] == how


SCHEMA = StructType([StructField("name", StringType(), False), StructField("parts", ArrayType(StructType([StructField("kind", StringType()), StructField("count", LongType(), False)])))])


@pytest.mark.parametrize("text,data", [
    ('{nam: "a", par: [{ki: "x", cont: 1}]', {"name": "a", "parts": [{"kind": "x", "count": 1}]}),
    ('{"Name": "a"}', {"name": "a"}),  # JSON, but it doesn't fit
    ('{"name": "a", "nam": "b", x: [1', {"name": "a", "nam": "b", "x": [1]}),  # the field is there
    ('{"name": "a", "prts": "c", "other": 1,', {"name": "a", "parts": "c", "other": 1}),
    ('{"name": "a", "names": ["b"]}', {"name": "a", "names": ["b"]}),
    ('{"name": "a", "parts": [{"count": 1, "kinds": 5,}]}', {"name": "a", "parts": [{"count": 1, "kinds": 5}]}),
])
def test_names_are_restored_where_fields_are_missing(text, data):
    got = parse_and_validate(text, SCHEMA)
    if data.get("parts") == "c":
        data = {**data, "parts": []}
        assert got.data["name"] == "a" and "prts" not in got.data
    else:
        assert got.data == data and got.error is None
