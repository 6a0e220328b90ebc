"""What the operators of this subpackage share: scratch tables, joins by size, text folding."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir  # noqa: F401  operators take them from here
from ..session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes of one Arrow batch.
BATCH_BYTES = 8 << 20
#: The same, and rows that a Parquet reader holds at once, where executors have little memory beside large tables.
LEAN_BYTES, LEAN_ROWS = 2 << 20, 512
#: Most rows of an id list that drop_ids sends to every executor (8-byte ids: a few MB).
BROADCAST_IDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 1000, in_bytes: int = BATCH_BYTES) -> None:
    """Send the package to executors, and bound what one Arrow batch holds, in rows and in bytes, as texts may be long; smaller settings of the session stay. The bounds aren't taken back, as results are lazy and run under the session's settings of that time."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    own = int(now) if now.lstrip("-").isdigit() else in_bytes + 1
    if own <= 0 or own > in_bytes:
        spark.conf.set(key, f"{in_bytes}b")


def lean(spark: SparkSession) -> None:
    """prepare() with smaller batches, from Parquet too: for steps whose workers hold large tables, and for the pipeline, whose executors keep what direct memory and heap each stage in turn has taken."""
    prepare(spark, in_bytes=LEAN_BYTES)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > LEAN_ROWS:
        spark.conf.set(key, LEAN_ROWS)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does that to ASCII texts, and faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in ids. A short list of ids (at most BROADCAST_IDS, counted first) goes to every executor, so that texts aren't shuffled; a longer one is joined by a shuffle. Rows whose key is null stay."""
    ids = ids.select(key).where(F.col(key).isNotNull())
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_anti")


_held: dict[object, object] = {}
_task: list[int] = []


def give_back() -> None:
    """Return what the C library and Arrow's own pool hold of freed memory: neither sees the other's, and reused workers would keep the most that any task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library gives memory back in its own time


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, for one operator at a time: workers are reused, and the caches of all operators together would outgrow an executor. An operator that keeps nothing calls it to have others' caches dropped. A worker's first call in a task gives freed memory back."""
    task = TaskContext.get()
    now = task.taskAttemptId() if task else -1
    new = key not in _held
    if new:
        _held.clear()
        gc.collect()
    if new or _task != [now]:
        _task[:] = [now]
        give_back()
    if new:
        _held[key] = make()
    return _held[key]
