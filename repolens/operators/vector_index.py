"""An inverted file of k-means cells with residual product quantisation, kept as a table.

build() learns the cells and codebooks from a bounded sample, gives every vector its cell and code, and writes them partitioned by cell. search() reads only the cells that the queries probe: a task adds up the distances of its rows' codes from tables, takes the best candidates of each query, and computes their exact distances at once, as their vectors stand beside the codes. So what is merged are a few exact results per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..session import ship
from .nearest import Best, merged, query_matrix, whole_vector

#: Vectors that the model is fitted on, in expectation; rounds of k-means; entries of a codebook, and components that share one.
SAMPLE, ROUNDS, ENTRIES, SHARE = 50_000, 10, 256, 4
#: Cells: about the square root of the number of vectors, at most so many.
MOST_CELLS = 4096
#: Rows that go to one file of a cell; a cell of more rows has more files.
FILE_ROWS = 1_000_000
#: How many cells queries probe is set when the index is built: so many of the sample's vectors are searched in the sample, and RECALL of their nearest rows must lie in the probed cells.
TRIALS, RECALL = 400, 0.96


@dataclass
class Model:
    """Centres of the cells, and for each group of components a codebook of residuals. bounds: where the groups begin and end; probes: cells that a query needs."""

    centres: np.ndarray
    books: list[np.ndarray]
    bounds: list[int]
    probes: int = 1

    def cells(self, vectors: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        return np.argsort(_squares(vectors, self.centres), axis=1, kind="stable")[:, :n]

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        parts = [_squares(residuals[:, a:b], book).argmin(axis=1) for (a, b), book in zip(pairwise(self.bounds), self.books, strict=True)]
        return np.stack(parts, axis=1).astype(np.uint8)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T


def _kmeans(data: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = data[rng.choice(len(data), min(k, len(data)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = _squares(data, centres).argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, data)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, cells: int, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    centres = _kmeans(sample, cells, rng)
    residuals = sample - centres[_squares(sample, centres).argmin(axis=1)]
    width = sample.shape[1]
    bounds = [*range(0, width, SHARE), width]
    model = Model(centres, [_kmeans(residuals[:, a:b], ENTRIES, rng) for a, b in pairwise(bounds)], bounds)
    model.probes = _needed(model, sample, rng)
    return model


def _needed(model: Model, sample: np.ndarray, rng: np.random.Generator) -> int:
    """Cells that hold RECALL of the nearest rows of some of the sample's vectors."""
    n, own = len(model.centres), model.cells(sample)[:, 0]
    trials = sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    near = np.argpartition(_squares(trials, sample), min(V.SEARCH_RESULTS, len(sample) - 1), axis=1)[:, : V.SEARCH_RESULTS + 1]
    order = np.argsort(model.cells(trials, n), axis=1)  # place of each cell in a trial's order
    places = np.sort(np.take_along_axis(order, own[near], axis=1), axis=None)
    return int(places[min(len(places) - 1, int(RECALL * len(places)))]) + 1


def build(rows: DataFrame, path: str, key: str = "filepath", vector: str = "contentVector", columns: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Model:
    """Write an index of a table's vectors to path: cell, key, vector, code, and further columns to filter by; the model beside it.

    Every whole vector of the commonest length is in the index; null ones, ones with null or non-finite components, and ones of other lengths aren't, as they have no distance from a query.
    """
    spark = rows.sparkSession
    ship(spark)
    some = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), *columns).where(whole_vector(F.col("vector")))
    lengths = some.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    if not lengths:
        raise ValueError("no vectors to index")
    width, total = lengths[0]
    some = some.where(F.size("vector") == width)
    share = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30))
    found = some.where(share).select("key", "vector").orderBy("key").toArrow() if total > sample else some.select("key", "vector").orderBy("key").toArrow()
    model = fit(_matrix(found.column("vector"), width), cells or max(1, min(MOST_CELLS, round(total**0.5))), seed)
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1), width)
            cell = m.cells(vectors)[:, 0]
            codes = m.codes(vectors - m.centres[cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "cell", "code"])

    schema = ", ".join(f"`{n}` {t}" for n, t in some.dtypes)
    placed = some.mapInArrow(place, f"{schema}, cell int, code binary")
    # A cell may hold many rows: keys deal them to as many files as all rows need.
    files = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // FILE_ROWS))))
    placed.repartition(F.col("cell"), files).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    books = [(k, row.tolist()) for k, book in enumerate(model.books) for row in book]
    tables = [("probes", -1, [float(model.probes)])] + [("centre", -1, row.tolist()) for row in model.centres] + [("entry", k, row) for k, row in books]
    spark.createDataFrame([(kind, k, n, row) for n, (kind, k, row) in enumerate(tables)], "kind string, part int, pos int, components array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return model


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), width)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("pos").collect()  # MOST_CELLS centres and a codebook per SHARE components
    centres = np.array([r["components"] for r in rows if r["kind"] == "centre"])
    parts = sorted({r["part"] for r in rows if r["kind"] == "entry"})
    books = [np.array([r["components"] for r in rows if r["part"] == k and r["kind"] == "entry"]) for k in parts]
    return Model(centres, books, [0, *np.cumsum([b.shape[1] for b in books]).tolist()], int(next(r["components"][0] for r in rows if r["kind"] == "probes")))


def search(spark: SparkSession, path: str, queries: DataFrame, query_key: str = "query", vector: str = "contentVector", k: int = V.SEARCH_RESULTS, candidates: int = V.SEARCH_CANDIDATES, probes: int | None = None, where: Column | str | None = None) -> DataFrame:
    """For each query (query_key, vector) the k nearest rows among its candidates: query_key, rank, distance, key. The rows are filtered (where) before candidates are chosen.

    A query probes as many cells as the index needed for its recall when it was built, or as many as are asked for. A candidate list of each query holds the nearest rows by code in the cells that it probes, at least; as every task contributes its own, more rows are compared exactly when there are more tasks. Queries are a stated set that is counted, and goes to the tasks in blocks.
    """
    ship(spark)
    model = load(spark, path)
    width, n_cells = model.centres.shape[1], len(model.centres)
    probes = min(n_cells, probes or model.probes)
    index = spark.read.parquet(f"{path}/rows")
    if where is not None:
        index = index.where(where)
    kind = dict(index.dtypes)["key"]
    out = None
    for keys, _, matrix in query_matrix(queries, query_key, vector, width):
        probed = model.cells(matrix, probes)
        used = np.unique(probed)
        by_cell = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in used}
        shared = spark.sparkContext.broadcast((model, matrix, by_cell))
        rows = index.where(F.col("cell").isin([int(c) for c in used])) if len(used) < n_cells else index
        found = rows.select("key", "vector", "code", "cell").mapInArrow(_searching(shared, k, candidates), f"_q bigint, distance double, key {kind}")
        part = merged(found, keys, query_key, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return merged(spark.createDataFrame([], f"_q bigint, distance double, key {kind}"), queries.select(query_key).limit(0).toArrow().column(0), query_key, k)
    return out


def _searching(shared, k: int, candidates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, queries, by_cell = shared.value
        lists = Best(candidates)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(3).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cells), -1)
            vectors = _matrix(batch.column(1), queries.shape[1])
            for cell in np.unique(cells):
                asked, rows = by_cell.get(int(cell), ()), np.flatnonzero(cells == cell)
                for q in asked:
                    apart = queries[q] - model.centres[cell]
                    tables = [_squares(apart[None, a:b], book)[0] for (a, b), book in zip(pairwise(model.bounds), model.books, strict=True)]
                    near = sum(t[codes[rows, i]] for i, t in enumerate(tables))
                    lists.offer(int(q), near, rows, batch.column(0), vectors)
        yield from lists.exact(queries, k)

    return run
