"""Searches by many vectors, exact and by an index, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from repolens.operators import nearest, vector_index


def vectors(n, width, seed, kinds=20):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(kinds)]
    return [[x + rng.gauss(0, 0.3) for x in centres[rng.randrange(kinds)]] for _ in range(n)]


def plain(rows, query, k):
    near = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(v, query, strict=True))), key) for key, v in rows if v is not None and len(v) == len(query) and all(x is not None and math.isfinite(x) for x in v)]
    return sorted(near, key=lambda x: (x[0], x[1] is not None, x[1] or ""))[:k]


@pytest.mark.parametrize("at_once", [2048, 3])
def test_nearest_of_many(spark, monkeypatch, at_once):
    monkeypatch.setattr(nearest, "QUERIES_AT_ONCE", at_once)
    monkeypatch.setattr(nearest, "ROWS_AT_ONCE", 16)
    v = vectors(150, 5, 1)
    rows = [(f"k{i:03}", x) for i, x in enumerate(v)]
    rows += [(f"copy{i:02}", v[0]) for i in range(60)] + [(None, v[3])]  # ties, far more than are asked for
    rows += [("null", None), ("holds null", [None] * 5), ("nan", [float("nan")] * 5), ("short", [0.0, 1.0]), ("far", [1e9] * 5), ("far too", [1e9] * 4 + [1e9 + 1])]
    queries = [(f"q{i}", x) for i, x in enumerate([*v[:7], [0.0] * 5, [1e9] * 5, [0.0, 1.0]])] + [("none", None)]
    df = spark.createDataFrame(rows, "name string, v array<double>").repartition(4)
    got = nearest.nearest_of_many(df, spark.createDataFrame(queries, "query string, v array<double>"), "v", "name", "query", 6).collect()
    for q, x in queries:
        mine = sorted((r["rank"], r["distance"], r["name"]) for r in got if r["query"] == q)
        want = plain(rows, x, 6) if x is not None else []
        assert [m[2] for m in mine] == [key for _, key in want] and [m[1] for m in mine] == pytest.approx([d for d, _ in want])
    assert nearest.nearest_of_many(df, spark.createDataFrame(queries[-1:], "query string, v array<double>"), "v", "name", "query").count() == 0


def test_index(spark, tmp_path):
    v = vectors(4000, 16, 2)
    rows = [(f"k{i}", x, "p" if i % 3 else "q") for i, x in enumerate(v)] + [(f"hot{i}", [0.5] * 16, "p") for i in range(2000)] + [("null", None, "p"), ("nan", [float("nan")] * 16, "p"), ("short", [1.0], "p")]
    df = spark.createDataFrame(rows, "filepath string, contentVector array<float>, projectName string").repartition(4)
    path = str(tmp_path / "index")
    vector_index.build(df, path, columns=("projectName",))
    index = spark.read.parquet(f"{path}/rows")
    assert index.count() == 6000 and index.select("key").distinct().count() == 6000
    asked = df.where("filepath like 'k%' and int(substr(filepath, 2)) % 50 = 0").select(F.col("filepath").alias("query"), "contentVector")
    exact = {(r["query"], r["filepath"]) for r in nearest.nearest_of_many(df.where("projectName = 'p'"), asked, "contentVector", "filepath", "query").collect()}
    found = vector_index.search(spark, path, asked, where="projectName = 'p'").collect()
    got = {(r["query"], r["key"]) for r in found}
    assert len(got) == len(found) == len(exact) == 480 and len(got & exact) >= 0.9 * 480
    # All cells and all rows as candidates: exact.
    whole = vector_index.search(spark, path, asked, probes=10**6, candidates=10**6, where="projectName = 'p'").collect()
    assert {(r["query"], r["key"]) for r in whole} == exact
    # Cells that no query probes aren't read.
    one = vector_index.search(spark, path, asked.limit(1), probes=2)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().executedPlan().toString()
    assert vector_index.search(spark, path, asked.limit(0)).count() == 0


def test_few_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0, 2.0, 4.0])], "filepath string, contentVector array<double>")
    vector_index.build(df, str(tmp_path / "i"))
    got = vector_index.search(spark, str(tmp_path / "i"), df.select(F.col("filepath").alias("query"), "contentVector"), k=2).collect()
    assert sorted((r["query"], r["rank"], r["key"], r["distance"]) for r in got) == [("a", 1, "a", 0.0), ("a", 2, "b", 1.0), ("b", 1, "b", 0.0), ("b", 2, "a", 1.0)]
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build(df.limit(0), str(tmp_path / "j"))
