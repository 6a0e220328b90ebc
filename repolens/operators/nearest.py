"""Nearest rows of many queries, as products of blocks of rows and queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..session import ship

#: Queries that a task holds at a time, and rows that are multiplied with them at a time: some MB of each, and of their product.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 2048, 1024


def whole_vector(vector: Column) -> Column:
    """The vector isn't null, and all its components are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def query_matrix(queries: DataFrame, query_key: str, vector: str, width: int | None = None) -> Iterator[tuple[pa.ChunkedArray, int, np.ndarray]]:
    """Blocks of queries of one length: keys, length and vectors. A stated set, that is read block by block by the driver; queries without a whole vector have no result."""
    some = queries.select(F.col(query_key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(whole_vector(F.col("v")))
    if width is not None:
        some = some.where(F.size("v") == width)
    lengths = [r["n"] for r in some.select(F.size("v").alias("n")).distinct().collect()]
    for n in lengths:
        mine = some.where(F.size("v") == n)
        blocks = max(1, -(-mine.count() // QUERIES_AT_ONCE))
        for b in range(blocks):
            found = mine.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()
            if found.num_rows:
                yield found.column("key"), n, found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, n)


def exact_distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, their terms added one after the other."""
    apart = vectors - query
    return np.sqrt(np.cumsum(apart * apart, axis=1)[:, -1]) if vectors.shape[1] else np.zeros(len(vectors))


class Best:
    """The n best rows of each query in a task, by an approximate measure; kept with their vectors."""

    def __init__(self, n: int):
        self.n, self.held = n, {}

    def offer(self, query: int, near: np.ndarray, rows: np.ndarray, keys: pa.Array, vectors: np.ndarray) -> None:
        """Rows (numbers of keys and vectors) whose measure is near."""
        most = self.held[query][0].max() if query in self.held and len(self.held[query][0]) >= self.n else np.inf
        good = np.flatnonzero(near < most) if np.isfinite(most) else np.arange(len(near))
        if not len(good):
            return
        if len(good) > self.n:
            good = good[np.argpartition(near[good], self.n - 1)[: self.n]]
        mine = near[good], keys.take(pa.array(rows[good])).to_pylist(), vectors[rows[good]]
        if query in self.held:
            old = self.held[query]
            mine = np.r_[old[0], mine[0]], old[1] + mine[1], np.vstack([old[2], mine[2]])
            if len(mine[0]) > self.n:
                keep = np.argpartition(mine[0], self.n - 1)[: self.n]
                mine = mine[0][keep], [mine[1][i] for i in keep], mine[2][keep]
        self.held[query] = mine

    def exact(self, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """The k nearest of each query's rows by exact distance: query, distance, key."""
        for query, (_, keys, vectors) in self.held.items():
            distance = exact_distances(vectors, queries[query])
            order = sorted(range(len(keys)), key=lambda i: (distance[i], keys[i] is not None, keys[i]))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(order), pa.int64()), pa.array(distance[order]), pa.array([keys[i] for i in order])], names=["_q", "distance", "key"])


def merged(found: DataFrame, keys: pa.ChunkedArray, query_key: str, k: int) -> DataFrame:
    """The k best of what tasks found for each query: query_key, rank, distance, key."""
    spark = found.sparkSession
    names = spark.createDataFrame(pa.table({"_q": pa.array(range(len(keys)), pa.int64()), query_key: keys}))
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "_q").select(query_key, "rank", "distance", "key")


def nearest_of_many(rows: DataFrame, queries: DataFrame, vector: str, key: str, query_key: str, k: int = V.SEARCH_RESULTS) -> DataFrame:
    """For each query (query_key, vector) its k nearest rows, exactly, ties by key: query_key, rank, distance, key.

    Queries are a stated set that is counted; blocks of QUERIES_AT_ONCE go to all tasks, each a pass over the rows. A task multiplies blocks of rows with its queries, and computes the distances of those that may be among the k nearest exactly, so rounding in the product decides nothing. What is shuffled are k rows per query and task. Vectors that are null, not finite or of another length than the query have no distance.
    """
    spark = rows.sparkSession
    ship(spark)
    some = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(whole_vector(F.col("v")))
    kind, out = dict(some.dtypes)["key"], None
    for keys, n, matrix in query_matrix(queries, query_key, vector):
        shared = spark.sparkContext.broadcast(matrix)
        part = merged(some.where(F.size("v") == n).mapInArrow(_product(shared, k), f"_q bigint, distance double, key {kind}"), keys, query_key, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = merged(spark.createDataFrame([], f"_q bigint, distance double, key {kind}"), queries.select(query_key).limit(0).toArrow().column(0), query_key, k)
    return out.withColumnRenamed("key", key)


def _product(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        lengths = (queries * queries).sum(1)
        best: dict[int, list[tuple[float, object]]] = {}
        bound = np.full(len(queries), np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, queries.shape[1])
                own = (rows * rows).sum(1)
                squares = own[:, None] + lengths[None, :] - 2.0 * rows @ queries.T
                # The product rounds; what it may be off by is far below this.
                slack = 1e-10 * (own[:, None] + lengths[None, :]) + 1e-300
                if part.num_rows > k:
                    limit = np.minimum(bound, np.partition(squares + slack, k - 1, axis=0)[k - 1])
                else:
                    limit = bound
                at_row, at_query = np.nonzero(squares - slack <= limit[None, :])
                order = np.argsort(at_query, kind="stable")
                at_row, at_query = at_row[order], at_query[order]
                keys = part.column(0)
                for q, chosen in zip(*_runs(at_query, at_row), strict=True):
                    distance = exact_distances(rows[chosen], queries[q])
                    new = list(zip(distance.tolist(), keys.take(pa.array(chosen)).to_pylist(), strict=True))
                    best[q] = sorted([*best.get(q, ()), *new], key=_place)[:k]
                    if len(best[q]) == k:
                        bound[q] = best[q][-1][0] ** 2 * (1 + 1e-12)
        for q, rows in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.int64()), pa.array([d for d, _ in rows]), pa.array([x for _, x in rows])], names=["_q", "distance", "key"])

    return run


def _place(x: tuple) -> tuple:
    """Order by distance, then key, nulls first."""
    return x[0], x[1] is not None, x[1]


def _runs(values: np.ndarray, of: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct sorted values, and the parts of another array that belong to each."""
    if not len(values):
        return [], []
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts].tolist(), np.split(of, starts[1:])
