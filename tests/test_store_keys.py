"""Constraints that are kept with tables, and the index of keys."""

import re

import pytest
from pyspark.sql import functions as F

from repolens import schemas
from repolens.sources import constraints, meta, store
from repolens.sources.keyed import KeyIndex

DDL = "projectName string, filepath string, kind string, parts array<struct<name: string, kind: string>>"


def rows(spark, *data):
    return spark.createDataFrame(data, DDL)


def test_constraints_are_kept_and_enforced(spark, tmp_path):
    at, bad = f"{tmp_path}/t", f"{tmp_path}/bad"
    made = store.create(spark, at, DDL, required=["filepath", "parts[].name"], vocabularies={"kind": ["a", "b"], "parts[].kind": ["x"]})
    assert made.version == 1 and constraints.read(spark, at).as_json() == made.as_json()
    good = [("p", "1", "a", [("n", "x")]), ("p", "2", None, None), ("q", "3", "b", [("n", None), ("m", "x")])]
    wrong = {"filepath": ("p", None, "a", None), "kind": ("p", "4", "c", None), "parts[].name": ("p", "5", "a", [("n", "x"), (None, "x")]), "parts[].kind": ("p", "6", "a", [("n", "y")])}
    store.insert(rows(spark, *good, *wrong.values()), at, bad)
    assert sorted(r["filepath"] for r in store.read(spark, at).collect()) == ["1", "2", "3"]
    told = {r["filepath"]: r["broken"] for r in spark.read.parquet(bad).collect()}
    assert told == {None: ["filepath is missing"], "4": ["kind is unknown"], "5": ["parts[].name is missing"], "6": ["parts[].kind is unknown"]}
    # All writers: none takes a row that the table refuses.
    store.insert_new(rows(spark, *wrong.values(), ("p", "7", "a", None)), at, rejects=bad)
    assert store.read(spark, at).count() == 4 and spark.read.parquet(bad).count() == 8
    with pytest.raises(constraints.BrokenTable, match="kind is unknown"):
        store.replace_projects(rows(spark, ("p", "8", "c", None)), at)
    store.replace_projects(rows(spark, ("p", "8", "a", None)), at)
    assert sorted(r["filepath"] for r in store.read(spark, at).collect()) == ["3", "8"]
    with pytest.raises(constraints.BrokenTable, match="no column odd"):
        store.insert(rows(spark, *good).withColumn("odd", F.lit(1)), at)
    store.insert(rows(spark, ("p", "9", "a", None)).drop("parts"), at)
    assert store.read(spark, at, DDL).where("filepath = '9' and parts is null").count() == 1


def test_versions(spark, tmp_path):
    at = f"{tmp_path}/t"
    wanted = {"required": ["filepath"], "vocabularies": {"kind": ["a"]}}
    assert [store.create(spark, at, DDL, **wanted).version for _ in range(2)] == [1, 1]
    store.insert(rows(spark, ("p", "1", "a", None)), at)
    wanted["vocabularies"]["kind"] = ["a", "b"]
    assert store.create(spark, at, DDL, **wanted).version == 2
    assert store.create(spark, at, DDL + ", more int", **wanted).version == 3
    assert store.read(spark, at, DDL + ", more int").first()["more"] is None
    for change, said in (((DDL, wanted), "only be added"), ((DDL.replace("kind string, parts", "kind int, parts") + ", more int", wanted), "only be added"), ((DDL + ", more int", {"required": ["more"], "vocabularies": {}}), "more is missing"), ((DDL + ", more int", {"required": [], "vocabularies": {"kind": ["b"]}}), "kind is unknown")):
        with pytest.raises(constraints.BrokenTable, match=said):
            store.create(spark, at, change[0], **change[1])
    assert constraints.read(spark, at).version == 3
    # Tables of sources have theirs without being asked.
    assert store.create(spark, f"{tmp_path}/s", schemas.SOURCES).required == list(store.REQUIRED)


def test_files_beside_tables(spark, tmp_path):
    at = f"{tmp_path}/x/_a.json"
    assert meta.read_json(spark, at) is None and not meta.exists(spark, at)
    meta.write_json(spark, at, {"ü": [1, None]})
    assert meta.read_json(spark, at) == {"ü": [1, None]}
    meta.delete(spark, at)
    assert not meta.exists(spark, at)


KEYED = "projectName string, filepath string, x int"


def keyed(spark, *data):
    return spark.createDataFrame(data, KEYED)


def test_batches_equal_one_insert(spark, tmp_path):
    data = [("p", f"f{i % 40}", i) for i in range(200)] + [("q", None, 1), ("q", None, 2)]
    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    store.insert_new(keyed(spark, *data), whole, valid=F.lit(True), index=KeyIndex(spark, whole, buckets=4))
    for k in range(4):
        store.insert_new(keyed(spark, *data[k * 50 : k * 50 + 50], *data[:5]), parts, valid=F.lit(True), index=KeyIndex(spark, parts))
    store.insert_new(keyed(spark, *data[200:]), parts, valid=F.lit(True), index=KeyIndex(spark, parts))
    keys = lambda at: sorted((r["projectName"], r["filepath"] or "") for r in store.read(spark, at).collect())
    assert keys(whole) == keys(parts) and len(keys(whole)) == 42
    index = KeyIndex(spark, whole)
    assert index.buckets == 4 and index.has("p", "f7") and not index.has("p", "f77") and index.keys().count() == 40
    with pytest.raises(ValueError, match="the index is of"):
        KeyIndex(spark, whole, ("filepath",))


def test_the_index_is_not_shuffled(spark, tmp_path):
    at = f"{tmp_path}/t"
    index = KeyIndex(spark, at, buckets=4)
    index.add(spark.range(1000).selectExpr("'p' as projectName", "concat('f', id) as filepath"))
    # A session that doesn't know the table finds it by its files.
    spark.sql(f"DROP TABLE {index.name}")
    index = KeyIndex(spark, at)
    new = spark.range(500, 1500).selectExpr("'p' as projectName", "concat('f', id) as filepath", "id as x")
    df = index.unseen(new)
    assert df.count() == 500
    text = df._jdf.queryExecution().executedPlan().toString()
    join = text[text.index("SortMergeJoin") :].split("Project [p AS")[0]
    known = join[join.rindex("Sort [") :]
    assert "Exchange" not in known and "Bucketed: true" in known, text
    where = index.keys().where(F.col("key") == '["p","f3"]')
    assert re.search(r"PushedFilters: \[.*EqualTo\(key", where._jdf.queryExecution().executedPlan().toString())


def test_a_batch_that_fails_half_way(spark, tmp_path):
    at = f"{tmp_path}/t"
    index = KeyIndex(spark, at, buckets=4)
    data = keyed(spark, ("p", "a", 1), ("p", "b", 2))

    def write(new):
        new.write.mode("append").partitionBy("projectName").parquet(at)

    def fails(new):
        write(new)
        raise OSError("after the rows, before the keys")

    with pytest.raises(OSError):
        index.insert_new(data, fails)
    for _ in range(2):
        index.insert_new(keyed(spark, ("p", "a", 1), ("p", "b", 2), ("p", "c", 3)), write)
    assert sorted(r["filepath"] for r in spark.read.parquet(at).collect()) == ["a", "b", "c"] and index.keys().count() == 3
