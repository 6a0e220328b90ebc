"""Media columns: texts stored as images in archives, read back by byte ranges, with features of what was read.

A text is stored as an 8-bit grey PNG image, SIDE * SIDE samples wide, in a ZIP archive (stored, as images are compressed). MediaArchive is a Spark data source for folders of such archives. Its writer commits: tasks write archives under names of their own, and only those that a manifest lists, which the driver writes when all tasks are done, can be read. Its reader plans byte ranges from the archives' sizes alone; a task reads the directory of each of its archives, takes the members that begin within its range, and streams them as Arrow batches that are bounded by bytes. A member that can't be read is tried again from its own offset, by a handle of its own; those before and after it are read once.

Archives are opened by pyarrow.fs, so they can lie in any store that it opens.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import Scratch, held, prepare

#: An image row holds a square of SIDE * SIDE samples; texts are filled up to whole squares with FILL.
SIDE, FILL = 24, 255
UNIT = SIDE * SIDE
#: An archive is closed after so many bytes or members.
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 128 << 20, 20_000
#: A task reads members from so many bytes of archives, and hands on batches of so many bytes, or one member.
RANGE_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
#: Further attempts to read a member, and the pause before the first of them, which doubles.
RETRIES, PAUSE_S = 3, 0.2

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest-"


# Images.


def padded(text: bytes) -> bytes:
    """A text and as many FILL bytes as make a positive multiple of UNIT."""
    return text + bytes([FILL]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(text: bytes) -> bytes:
    """A grey PNG image whose samples are the padded text, UNIT to a row; a text chunk has the text's length."""
    samples = np.frombuffer(padded(text), np.uint8).reshape(-1, UNIT)
    rows = np.zeros((len(samples), UNIT + 1), np.uint8)  # each row begins with filter 0, samples as they are
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", UNIT, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> tuple[bytes, int]:
    """Samples of an image of encode(), and the text's length. ValueError if it is no such image, or damaged."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, size, length, data = 8, None, None, []
    while at + 12 <= len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if len(image) < at + 12 + n or struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"damaged chunk at {at}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or length is None or size[0] != UNIT or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("an image of another kind")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and 64 bits that tell which cells of the mean square are lighter than the whole. Sums are integers, so equal payloads have equal features anywhere."""
    samples = np.frombuffer(payload, np.uint8)
    square = samples.reshape(-1, SIDE, SIDE).sum(axis=0, dtype=np.int64)
    cells = square.reshape(8, SIDE // 8, 8, SIDE // 8).sum(axis=(1, 3)).ravel()
    total, n = int(cells.sum()), len(samples)
    squares = int(np.bincount(samples, minlength=256) @ np.arange(256, dtype=np.int64) ** 2)
    deviation = max(0, n * squares - total * total) ** 0.5 / n
    bits = int("".join("1" if c * 64 > total else "0" for c in cells.tolist()), 2)
    return f"{total / n:.4f}:{deviation:.4f}:{bits:016x}"


# The data source.


@dataclass
class Ranges(InputPartition):
    """Byte ranges of archives: (path, start, end)."""

    of: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    """Archives that a task wrote: (name, bytes)."""

    archives: list[tuple[str, int]]


class _Out(io.RawIOBase):
    """A stream that only goes on, as stores have them."""

    def __init__(self, to: pa.NativeFile):
        self.to, self.at = to, 0

    def write(self, data) -> int:
        self.to.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def seek(self, *_):
        raise io.UnsupportedOperation("seek")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _manifests(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if posixpath.basename(f.path).startswith(MANIFEST))


def _listed(store: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """Archives of a folder, as its manifests have them."""
    out = []
    for path in _manifests(store, root):
        with store.open_input_stream(path) as f:
            out += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.keep = options.get("unreadable", "fail") == "keep"

    def partitions(self) -> list[Ranges]:
        """Ranges of about range_bytes, planned from sizes: large archives are cut, small ones share a task."""
        store, root = opened(self.root)
        out, held_bytes = [Ranges([])], 0
        for path, size in _listed(store, root):
            for start in range(0, size, self.range_bytes):
                end = min(size, start + self.range_bytes)
                if held_bytes and held_bytes + end - start > self.range_bytes:
                    out.append(Ranges([]))
                    held_bytes = 0
                out[-1].of.append((path, start, end))
                held_bytes += end - start
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.root)
        rows, size = [], 0
        for path, start, end in partition.of:
            for member in members(store, path, start, end, self.retries):
                content, error = attempt(lambda: content_of(store, path, member), self.retries)
                if error and not self.keep:
                    raise OSError(f"{path} at {member.header_offset}: {error}")
                rows.append((path, member.header_offset, member.filename, content, error))
                size += len(content or b"")
                if size >= self.batch_bytes:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "content", "error"])


def attempt(read: Callable[[], object], retries: int, sleep: Callable[[float], None] = time.sleep) -> tuple[object, str | None]:
    """What read() gives, or the last error after so many further attempts."""
    for k in range(retries + 1):
        try:
            return read(), None
        except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as e:
            error = f"{type(e).__name__}: {e}"
        if k < retries:
            sleep(PAUSE_S * 2**k)
    return None, error


def members(store: fs.FileSystem, path: str, start: int, end: int, retries: int = RETRIES) -> list[zipfile.ZipInfo]:
    """Members that begin in [start, end), by the archive's directory."""

    def read() -> list[zipfile.ZipInfo]:
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            return [m for m in archive.infolist() if start <= m.header_offset < end]

    found, error = attempt(read, retries)
    if error:
        raise OSError(f"directory of {path}: {error}")
    return found


def content_of(store: fs.FileSystem, path: str, member: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, read from its offset and held against its checksum."""
    with store.open_input_file(path) as f:
        f.seek(member.header_offset)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\3\4":
            raise zipfile.BadZipFile("no member begins here")
        f.seek(member.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        content = f.read(member.compress_size)
    if member.compress_type != zipfile.ZIP_STORED:
        raise zipfile.BadZipFile("the member isn't stored")
    if len(content) != member.file_size or zlib.crc32(content) != member.CRC:
        raise zipfile.BadZipFile("the checksum differs")
    return content


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.archive_bytes, self.archive_members = int(options.get("archivebytes", ARCHIVE_BYTES)), int(options.get("archivemembers", ARCHIVE_MEMBERS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Archives of a task's members (name, content). A failed attempt leaves archives that no manifest lists."""
        store, root = opened(self.root)
        store.create_dir(root, recursive=True)
        task, done = uuid.uuid4().hex, []
        items = ((n.as_py(), c.as_py()) for b in iterator for n, c in zip(b.column("name"), b.column("content"), strict=True))
        item = next(items, None)
        while item is not None:
            name = f"part-{task}-{len(done):05d}.zip"
            with store.open_output_stream(f"{root}/{name}") as to:
                out, n = _Out(to), 0
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    while item is not None and out.at < self.archive_bytes and n < self.archive_members:
                        archive.writestr(zipfile.ZipInfo(item[0] or ""), item[1] or b"")
                        n, item = n + 1, next(items, None)
            done.append((name, out.at))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.root)
        store.create_dir(root, recursive=True)
        before = [(m, _listed(store, root)) for m in _manifests(store, root)] if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        for path, _ in before:
            store.delete_file(path)
        for path in {p for _, listed in before for p, _ in listed}:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.root)
        for name, _ in (a for m in messages if m for a in m.archives):
            store.delete_file(f"{root}/{name}")


class MediaArchive(DataSource):
    """Folders of ZIP archives as a table of members: archive, offset, name, content, error.

    Options: path; rangeBytes, batchBytes; retries; unreadable: "fail" (a member that can't be read fails the task) or "keep" (it is a row with null content and an error). Written are name and content; archiveBytes and archiveMembers bound an archive.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset bigint, name string, content binary, error string"

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self._options())

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self._options(), overwrite)


# The operator.

FOUND = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members, in batches of bounded bytes."""
    held(None, lambda: None)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(images, pa.binary())], names=["name", "content"])

    for batch in batches:
        names, images, size = [], [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            names.append(f"{key.as_py() if key.is_valid else ''}.png")
            images.append(encode(text.as_py() or b""))
            size += len(images[-1])
            if size >= BATCH_BYTES:
                yield out()
                names, images, size = [], [], 0
        if names:
            yield out()


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [c.split() for c in FOUND.split(", ")]
    schema = pa.schema([(c, pa.int64() if t == "bigint" else pa.string()) for c, t in columns])
    for batch in batches:
        rows = []
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            image, key = content.as_py(), name.as_py().removesuffix(".png")
            payload, n = decode(image)
            rows.append((int(key) if key else None, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def register(spark) -> None:
    """Make the format media_archive known to a session, and its code to executors."""
    prepare(spark, 200)
    spark.dataSource.register(MediaArchive)


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Add each text of docs, as an image, to the archives of a folder."""
    register(docs.sparkSession)
    images = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(_encoded, "name string, content binary")
    images.write.format("media_archive").mode("append").save(path)


def media_features(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Lengths, digests and a feature of each image in the archives of a folder, from the bytes read back."""
    register(spark)
    return spark.read.format("media_archive").load(path).select("name", "content").mapInArrow(_featured, FOUND).withColumnRenamed("doc_id", id_col)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored losslessly as 8-bit images, and what is computed from the stored bytes.

    Returns a row per input row: id_col, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of the samples read back), media_bytes and media_sha256 (of the stored image), feature.

    Null texts count as empty: an image of UNIT samples that are all FILL. Equal texts have equal values, whatever their identifiers. Null ids stay null, rows that repeat an id or all columns are each stored. An empty table gives an empty result. Other columns are not read. A text is in memory whole, with its image, in the task that has its row; batches of several texts are bounded by bytes. Archives lie in the shared folder, and go when the application ends.
    """
    with Scratch(docs.sparkSession, "media") as tmp:
        path = tmp.claim("archives", keep=True)
        store_media(docs, path, id_col, text_col)
    return media_features(docs.sparkSession, path, id_col)
