"""Source trees as a table of files: a Spark data source that prunes while it walks.

The walk lists one folder at a time, several at once, and never enters folders that are ignored or hidden. The files that it finds are dealt to partitions by size, largest first, each to the partition that has the fewest bytes so far. A row names a file; contents are read by read_contents(), after whatever filters stand between.
"""

from __future__ import annotations

import heapq
import json
import posixpath
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import vocab as V
from ..session import ship

#: Bytes of files that a partition has, about; partitions at most; bytes of contents in a batch, or one file; folders listed at once.
PARTITION_BYTES, MOST_PARTITIONS, BATCH_BYTES, LISTERS = 32 << 20, 100_000, 8 << 20, 16
#: What a file costs beside its bytes, as bytes.
OPEN_BYTES = 64 << 10
#: Folders that are nested deeper are taken for a cycle of links.
DEEPEST = 200

SCHEMA = "sourceRoot string, path string, filepath string, filename string, size bigint"


@dataclass
class Files(InputPartition):
    """Files of a partition: (root, path, path below the root, size)."""

    files: list[tuple[str, str, str, int]]


def opened(root: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/") or "/"


def listed(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return store.get_file_info(fs.FileSelector(folder))


def walk(root: str, folders: tuple[str, ...] = V.IGNORED_FOLDERS, prefix: str = V.IGNORED_PREFIX, names: tuple[str, ...] = V.IGNORED_NAMES) -> Iterator[tuple[str, str, str, int]]:
    """(root, path, path below the root, size) of each file below a root that no rule leaves out. A root that is a file or isn't there is an error."""
    store, top = opened(root)

    def entries(folder: str, depth: int) -> tuple[list[tuple[str, int]], list[tuple[str, str, str, int]]]:
        if depth > DEEPEST:
            raise OSError(f"folders are nested too deeply: {folder}")
        inner, files = [], []
        for f in listed(store, folder):
            name = posixpath.basename(f.path)
            if name.startswith("."):
                continue
            if f.type == fs.FileType.Directory:
                if name not in folders:
                    inner.append((f.path, depth + 1))
            elif f.type == fs.FileType.File and not name.startswith(prefix) and name not in names:
                files.append((root, f.path, f.path[len(top) :].lstrip("/"), f.size))
        return inner, files

    with ThreadPoolExecutor(LISTERS) as pool:
        pending = {pool.submit(entries, top, 0)}
        while pending:
            done, pending = wait(pending, return_when="FIRST_COMPLETED")
            for d in done:
                inner, files = d.result()
                pending |= {pool.submit(entries, *x) for x in inner}
                yield from files


def dealt(files: list[tuple[str, str, str, int]], partition_bytes: int = PARTITION_BYTES) -> list[Files]:
    """Partitions of about as many bytes each: the largest files first, each to the partition with the fewest bytes."""
    cost = lambda f: f[3] + OPEN_BYTES
    total = sum(map(cost, files))
    n = min(MOST_PARTITIONS, len(files), max(1, -(-total // partition_bytes)))
    heap, parts = [(0, k) for k in range(n)], [Files([]) for _ in range(n)]
    for f in sorted(files, key=lambda f: (-f[3], f[1])):
        used, k = heap[0]
        heapq.heapreplace(heap, (used + cost(f), k))
        parts[k].files.append(f)
    return parts


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str], partition_bytes: int):
        self.roots, self.partition_bytes = roots, partition_bytes

    def partitions(self) -> list[Files]:
        return dealt([f for root in self.roots for f in walk(root)], self.partition_bytes)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of a tree without files
            return
        root, path, below, size = zip(*partition.files, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(path), pa.array(below), pa.array([posixpath.basename(p) for p in path]), pa.array(size, pa.int64())], names=["sourceRoot", "path", "filepath", "filename", "size"])


class SourceTree(DataSource):
    """Options: roots, a list in JSON; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return TreeReader(json.loads(options["roots"]), int(options.get("partitionbytes", PARTITION_BYTES)))


def read_tree(spark: SparkSession, roots: list[str], partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Files below several roots: sourceRoot, path, filepath (below the root), filename, size. Files of two roots may have the same filepath."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(roots=json.dumps(roots), partitionBytes=partition_bytes).load()


def read_contents(files: DataFrame) -> DataFrame:
    """files with their contents, which are read by the tasks that have the rows. A file that is gone or can't be read by then fails the task."""
    ship(files.sparkSession)
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, fs.FileSystem] = {}
        for batch in batches:
            start, size, contents = 0, 0, []
            roots, paths = batch.column(names.index("sourceRoot")).to_pylist(), batch.column(names.index("path")).to_pylist()
            for k, (root, path) in enumerate(zip(roots, paths, strict=True)):
                if root not in stores:
                    stores[root] = opened(root)[0]
                with stores[root].open_input_file(path) as f:
                    contents.append(f.read())
                size += len(contents[-1])
                if size >= BATCH_BYTES or k + 1 == len(paths):
                    part = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*names, "content"])
                    start, size, contents = k + 1, 0, []

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInArrow(run, f"{schema}, content binary")


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write each row's content to a file below a root; the number of files. A task that runs again writes the same files again."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                at = f"{top}/{name.as_py()}"
                store.create_dir(posixpath.dirname(at), recursive=True)
                with store.open_output_stream(at) as f:
                    f.write(data.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = rows.select(path, rows[content].cast("binary")).mapInArrow(run, "n bigint")
    return sum(r["n"] for r in written.groupBy().sum("n").withColumnRenamed("sum(n)", "n").collect() if r["n"])
