"""Batches and merged results of groups that no task holds whole."""

import random
import time

import pytest
from pyspark.sql import functions as F

from repolens.operators import batching


def plain(rows, most, cut):
    """Next-fit by a loop: {(group, batch, item): text}."""
    out, now = {}, None
    for g, _, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        n = min(len(t), most)
        if now is None or now[0] != g:
            now = [g, 0, 0, 0]
        elif now[3] + n > most and now[2]:
            now[1:] = now[1] + 1, 0, 0
        out[now[0], now[1], now[2]] = t[:cut]
        now[2:] = now[2] + 1, now[3] + n
    return out


@pytest.mark.parametrize("sizes,blocks", [([1, 2, 3], [1, 10_000]), ([0], [7]), ([0, 0, 0, 7, 30], [2, 50]), ([10, 20, 21], [7]), ([5], [50]), ([0, 1], [3])])
def test_batches_equal_a_loop(spark, sizes, blocks):
    rng = random.Random(str(sizes))
    rows = [(rng.choice(["a", "a", "a", "b", None, f"g{rng.randrange(9)}"]), rng.randrange(60), rng.choice(["x" * rng.choice(sizes), "y" * rng.choice(sizes)])) for _ in range(250)] + [("a", 1, None), ("z", 0, "")]
    most = batching.most_chars(20 * 1.0, 1.0)
    want = plain(rows, most, 20)
    df = spark.createDataFrame(rows, "g string, o int, t string").repartition(7)
    for block in blocks:
        got = {(r["g"], r["batch"], r["item"]): r["text"] for r in batching.token_batches(df, "g", ["o"], "t", 20, 1.0, 1.0, block_rows=block).collect()}
        assert got == want


def test_no_batches_of_no_rows(spark):
    assert batching.token_batches(spark.createDataFrame([], "g string, o int, t string"), "g", ["o"], "t", 20).count() == 0


def test_limits():
    for limit, per in ((70.0, 3.6), (0.7 * 100, 3.6), (64.0, 4.0), (1 / 3, 3.0), (89_600.0, 3.6)):
        most = batching.most_chars(limit, per)
        assert most / per <= limit < (most + 1) / per


def test_a_group_of_a_million_texts(spark):
    """Each text fills a batch; four times as many take at most about six times as long."""
    took = []
    for n in (250_000, 1_000_000):
        df = spark.range(n).select(F.lit("g").alias("g"), "id", F.lit("x" * 8).alias("t"))
        began = time.time()
        got = batching.token_batches(df, "g", ["id"], "t", 10, 1.0, 1.0).agg(F.count(F.lit(1)), F.max("batch"), F.max("item"), F.sum(F.col("batch").cast("long"))).first()
        took.append(time.time() - began)
        assert tuple(got) == (n, n - 1, 0, n * (n - 1) // 2)
    assert took[1] < 6 * took[0] + 5


def test_combined_elements(spark, monkeypatch):
    rows = [("g", 2, ["c", None]), ("g", 1, ["b", "a", "b"]), ("g", 3, None), (None, 1, ["n"]), ("e", 1, []), ("x", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, l array<string>")
    for most in (200_000, 1):
        monkeypatch.setattr(batching, "BROADCAST_GROUPS", most)
        got = {(r["g"], r["position"]): r["element"] for r in batching.combined_elements(df, "g", "o", "l").collect()}
        assert got == {("g", 0): "b", ("g", 1): "a", ("g", 2): "b", ("g", 3): "c", ("g", 4): None, (None, 0): "n"}
        assert {r["g"]: r["l"] for r in batching.combine_arrays(df, "g", "o", "l").collect()} == {"g": ["b", "a", "b", "c", None], None: ["n"], "e": []}
    texts = spark.createDataFrame([("g", 2, "b"), ("g", 1, ""), ("g", 0, None), ("g", 3, "a"), ("h", 1, "")], "g string, o int, t string")
    assert [tuple(r) for r in batching.combined_texts(texts, "g", "o", "t").orderBy("position").collect()] == [("g", 0, "b"), ("g", 1, "a")]
    many = spark.range(300_000).select(F.lit("g").alias("g"), "id", F.array(F.col("id"), -F.col("id")).alias("l"))
    assert batching.combined_elements(many, "g", "id", "l").agg(F.count(F.lit(1)), F.max("position"), F.max(F.abs(F.col("position") - F.abs("element") * 2))).first()[:] == (600_000, 599_999, 1)
