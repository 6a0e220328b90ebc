"""Compression of vectors to codes: a codebook for each of PARTS positions, fitted by Lloyd's rounds over the distinct parts.

Components become integers, vectors are cut into equal parts. Equal parts of a position are one row with a weight, so a part that a third of all vectors share costs a round no more than any other. Each round reads the distinct parts once: tasks assign them to entries and hand on their sums by entry, and the driver sees PARTS * ENTRIES rows of sums. All arithmetic is in integers, so neither order nor partitioning changes a result. At the end codes and errors of the distinct parts are joined back to the vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, held, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums of components travel as sum = high * 2**HALF + low, so that no 64-bit sum overflows.
HALF = 14

Codebooks = list[list[list[int]]]


def most_component(length: int) -> int:
    """Larger components are cut to this, so that the squared distance of two vectors fits 64 bits and a component 32."""
    return min((1 << 28) - 1, math.isqrt((1 << 61) // max(1, length)) // 2)


def integer_parts(vector: Column, length: int) -> Column:
    """Array of PARTS arrays of integers: floor(SCALE * x) of each component."""
    most = most_component(length)
    x = F.transform(vector, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-1e18)), F.lit(1e18))), F.lit(-most)), F.lit(most)).cast("int"))
    x = F.concat(x, F.array_repeat(F.lit(0), F.lit(length) - F.size(vector)))
    n = length // PARTS
    return F.array(*(F.slice(x, p * n + 1, n) for p in range(PARTS)))


def whole(vector: Column) -> Column:
    """The vector isn't null, and none of its components is null or not finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (ties to the lower index), and its squared distance, in 64-bit integers."""
    best, at = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
    for k, entry in enumerate(book):
        apart = parts - entry
        distance = np.einsum("ij,ij->i", apart, apart)
        nearer = distance < best
        best[nearer], at[nearer] = distance[nearer], k
    return at, best


def _batches(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each batch the rows of each position: (position, rows, parts, codes, errors)."""
    held(None, lambda: None)
    for batch in batches:
        positions = batch.column("position").to_numpy()
        for p in np.unique(positions):
            rows = batch.filter(pa.array(positions == p))
            parts = rows.column("part").flatten().to_numpy().astype(np.int64).reshape(rows.num_rows, books[p].shape[1])
            yield p, rows, parts, *nearest_entries(parts, books[p])


def _sums(distinct: DataFrame, books: list[np.ndarray], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Weight, and sums by component, of the parts of each (position, entry) that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, 1 + 2 * width), np.int64)
        for p, rows, parts, codes, _ in _batches(batches, books):
            n = rows.column("weight").to_numpy()[:, None]
            np.add.at(total[p], codes, np.hstack([n, n * (parts >> HALF), n * (parts & ((1 << HALF) - 1))]))
        at = np.argwhere(total[:, :, 0] > 0)
        columns = [*at.T.astype(np.int32), *total[at[:, 0], at[:, 1]].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["position", "entry", "n", *(f"h{i}" for i in range(width)), *(f"l{i}" for i in range(width))]
    sums = distinct.mapInArrow(run, "position int, entry int, " + ", ".join(f"{c} bigint" for c in names[2:]))
    found = sums.groupBy("position", "entry").agg(*(F.sum(c).alias(c) for c in names[2:])).collect()  # at most PARTS * ENTRIES rows
    return {(r["position"], r["entry"]): (r["n"], [(r[f"h{i}"] << HALF) + r[f"l{i}"] for i in range(width)]) for r in found}


def fit(distinct: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after so many rounds of Lloyd over weighted distinct parts (position, part, weight). Entries without parts stay."""
    books = [[list(e) for e in book] for book in books]
    width = len(books[0][0])
    for _ in range(rounds):
        for (p, k), (n, sums) in _sums(distinct, [np.array(b, np.int64).reshape(len(b), width) for b in books], width).items():
            books[p][k] = [s // n for s in sums]  # // rounds down
    return books


def assign(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """position, part, code and error of distinct parts."""
    arrays = [np.array(b, np.int64).reshape(len(b), len(b[0])) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, _, codes, errors in _batches(batches, arrays):
            yield pa.RecordBatch.from_arrays([rows.column("position"), rows.column("part"), pa.array(codes.astype(np.int32)), pa.array(errors)], names=["position", "part", "code", "error"])

    return distinct.mapInArrow(run, "position int, part array<int>, code int, error bigint")


def codebooks_sha256(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the errors of equal labels summed; nulls are a label of their own. Few labels (counted first) go to every task, so that no row is shuffled by its label; many are joined by a shuffle that adaptive execution can split."""
    most = F.lit((1 << 63) - 1)
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    if sums.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Codes of the vectors of a table.

    Returns a row per kept vector: id_col, code, error, label_error, codebooks_sha256.

    Vectors that are null, or hold a null, a NaN or an infinity, are dropped. Vectors of different lengths, or of a length that the parts don't divide, are filled up with zeros to the smallest multiple of PARTS that holds the longest; empty vectors are so all zeros. Components whose integers are too large for exact distances are cut (most_component: beyond 47,000 for 64 components). Codebooks start from the ENTRIES smallest identifiers; null identifiers stand behind all others, ties are ordered by the vector itself. With fewer vectors than ENTRIES the codebooks are smaller. Rows that are repeated are all kept and weigh as often as they are there. A sum of errors that 64 bits can't hold is given as the largest long. Without any kept vector the result is empty. Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark, 10_000)
    some = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(whole(F.col("v")))
    longest = some.agg(F.max(F.size("v"))).first()[0] or 0
    length = max(PARTS, -(-longest // PARTS) * PARTS)
    with Scratch(spark, "vector_codes") as tmp:
        kept = tmp.save(some.select(F.monotonically_increasing_id().alias("row"), "id", "label", integer_parts(F.col("v"), length).alias("parts")), "kept", keep=True)
        first = kept.orderBy(F.asc_nulls_last("id"), "parts").limit(ENTRIES).select("parts").collect()
        if not first:
            return kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        placed = kept.select("row", F.posexplode("parts").alias("position", "part"))
        distinct = tmp.save(placed.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct")
        books = fit(distinct, [[list(r["parts"][p]) for r in first] for p in range(PARTS)], rounds)
        coded = tmp.save(assign(distinct, books), "coded")
        each = F.sort_array(F.collect_list(F.struct("position", "code")))  # PARTS values
        code = F.array_join(F.transform(each, lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0")), "")
        joined = placed.join(coded, ["position", "part"]).groupBy("row").agg(code.alias("code"), F.sum("error").alias("error"))
        codes = tmp.save(kept.select("row", "id", "label").join(joined, "row").select("id", "label", "code", "error"), "codes", keep=True)
    return with_label_errors(codes).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def oracle(vectors: str = "embeddings", id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> str:
    """The same for DuckDB, over vectors of one length that the parts divide: a round is two common table expressions."""
    floor_mean = "(s - ((s % n) + n) % n) / n"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, {id_col} AS id, {label_col} AS label, list_transform({vector_col}, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM {vectors} WHERE {vector_col} IS NOT NULL AND len(list_filter({vector_col}, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"placed AS MATERIALIZED (SELECT r, id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS part FROM kept, range({PARTS}) t(p))",
        "distinct_parts AS MATERIALIZED (SELECT p, part, count(*) AS w FROM placed GROUP BY p, part)",
        f"first AS (SELECT r, row_number() OVER (ORDER BY id) - 1 AS k FROM kept QUALIFY k < {ENTRIES})",
        "book0 AS MATERIALIZED (SELECT p, k, part AS entry FROM placed JOIN first USING (r))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"near{i} AS MATERIALIZED (SELECT p, part, w, min(struct_pack(d := d, k := k)) AS best FROM (SELECT p, part, w, k, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM distinct_parts JOIN book{i} USING (p)) GROUP BY p, part, w)")
        if i < ROUNDS:
            steps.append(f"mean{i} AS (SELECT p, k, list(CAST({floor_mean} AS BIGINT) ORDER BY j) AS entry FROM (SELECT p, best.k AS k, j, sum(w * part[j + 1]) AS s, sum(w) AS n FROM near{i}, range(1024) t(j) WHERE j < len(part) GROUP BY p, best.k, j) GROUP BY p, k)")
            steps.append(f"book{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.entry, b.entry) AS entry FROM book{i} b LEFT JOIN mean{i} m USING (p, k))")
    steps.append(f"codes AS MATERIALIZED (SELECT r, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM placed JOIN near{ROUNDS} USING (p, part) GROUP BY r)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, k)) AS h FROM book{ROUNDS})")
    return "WITH " + ", ".join(steps) + f" SELECT id AS {id_col}, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (r), digest"
