"""WARC archives: writing, reading, and resolution of repeated payloads to revisit records.

Archives are written by Spark's text writer: a record is a string, and the two line ends that close a WARC record are the line separator. So the output committer holds, archives appear whole or not at all, and any store that Spark writes to will do. Files are gzipped as a whole and hold at most RECORDS_PER_FILE records. They are read as binary files and parsed as a stream, so only a compressed file and one record are in memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare

RECORDS_PER_FILE = 2000
FILES_PER_TASK = 2
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEADERS = "path string, ord long, id string, uri string, date string, type string, digest string, payload_bytes long, refers_to string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: five hex digits make four letters."""
    word = lambda i: F.conv(F.substring(F.sha1(payload), i * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda w, k: F.substring(F.lit(BASE32), F.shiftright(w, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(word(i), k) for i in range(8) for k in range(4)))


def response_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, date: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20\x7f]+", "%20")
    rows = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), uri.alias("uri"), payload.alias("payload")).withColumn("n", F.octet_length("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{ID_PREFIX}"), F.col("id"), F.lit(">\r\nWARC-Target-URI: "), F.col("uri"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("payload").cast("binary")), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.col("n") + F.octet_length(http)).cast("string"), F.lit(END),
    )
    return rows.select(F.concat(head, http, F.col("payload")).alias("record"))


def write_archives(records: DataFrame, path: str) -> None:
    records.select(F.col("record").cast("string")).write.options(lineSep=END, compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE, **{"zlib.compress.level": "BEST_SPEED"}).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, gzipped as a whole or by record."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends within a record")
        yield head, block


def _page(record_id: str) -> str | None:
    return record_id.strip("<>").removeprefix(ID_PREFIX) or None if record_id else None


def _payload(block: bytes) -> bytes:
    return block.partition(END.encode())[2] if block.startswith(b"HTTP/") else block


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in HEADERS.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in HEADERS.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows = []
            for k, (head, block) in enumerate(parse(content.as_py())):
                kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
                n = int(head.get("x-payload-length", 0))
                if kind == "response":
                    payload = _payload(block)
                    found, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    if digest and digest != found:
                        raise ValueError(f"{head['warc-record-id']}: the payload doesn't have the digest {digest}")
                    digest = found
                rows.append((path.as_py(), k, _page(head["warc-record-id"]), head.get("warc-target-uri"), head.get("warc-date"), kind, digest, n, _page(head.get("warc-refers-to", ""))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives; the digest of a response is computed from its payload and held against its header."""
    return read_files(spark, path).mapInArrow(_headers, HEADERS)


def resolve_revisits(headers: DataFrame, tmp: Scratch, id_type: str = "long", at_least: int = 0) -> DataFrame:
    """headers with the response that each record repeats: first_id, first_uri, first_date. They are null for the first response of a payload, and for records that were revisits before and whose response isn't there: these stay as they are.

    Only headers are shuffled. Groups are reduced to their first record before the shuffle, and written, so that the join back deals large groups out over several tasks.
    """
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").cast(id_type).alias("n"), "path", "ord", "id", "uri", "date")
    response = F.when(F.col("type") == "response", order)
    firsts = headers.where(F.col("payload_bytes") >= at_least).groupBy("digest").agg(F.min(response).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = tmp.save(firsts, "firsts")
    other = (F.col("payload_bytes") >= at_least) & F.col("first").isNotNull() & ~((F.col("first.path") == F.col("path")) & (F.col("first.ord") == F.col("ord")))
    of_first = lambda c: F.when(other, F.coalesce(F.col(f"first.{c}"), F.lit(""))).alias(f"first_{c}")
    return headers.join(firsts, "digest", "left").select(*headers.columns, of_first("id"), of_first("uri"), of_first("date"))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark writes it, and the path in it."""
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(uri)


def opens(path: str) -> bool:
    """Whether tasks can open files of a path by themselves."""
    try:
        store, at = store_of(path)
        return store.get_file_info(at).type != fs.FileType.NotFound
    except (OSError, ValueError, pa.ArrowException):
        return False


def _fresh(head: dict[str, str], block: bytes, first: dict | None, date: str) -> bytes:
    """A record with fresh headers; a revisit of first, if there is one, without its payload."""
    revisit = head["warc-type"] == "revisit"
    size = head.get("x-payload-length", "0") if revisit else len(_payload(block))
    lines = ["WARC/1.1", "WARC-Type: " + ("revisit" if revisit or first else "response"), f"WARC-Record-ID: {head['warc-record-id']}", f"WARC-Target-URI: {head['warc-target-uri']}", f"WARC-Date: {date}", f"WARC-Payload-Digest: {head['warc-payload-digest']}", f"X-Payload-Length: {size}"]
    if first:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{first['first_id']}>", f"WARC-Refers-To-Target-URI: {first['first_uri']}", f"WARC-Refers-To-Date: {first['first_date']}"]
    elif revisit:
        lines += [f"{name}: {head[name.lower()]}" for name in ("WARC-Profile", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date") if name.lower() in head]
    if first and not revisit:
        block = block[: len(block) - len(_payload(block))]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + END.encode() + block


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an archive's path and its resolved headers (and its content, where tasks can't open it) -> fresh records, some MB at a time."""
    for batch in batches:
        contents = batch.column("content") if "content" in batch.schema.names else [None] * batch.num_rows
        for path, content, firsts, date in zip(batch.column("path").to_pylist(), contents, batch.column("firsts"), batch.column("date").to_pylist()):
            if content is None:
                store, at = store_of(path)
                with store.open_input_stream(at, compression=None) as stream:
                    archive = stream.read()
            else:
                archive = content.as_py()
            first = {x["ord"]: x for x in firsts.as_py() if x["first_id"] is not None}
            out, held = [], 0
            for k, (head, block) in enumerate(parse(archive)):
                out.append(_fresh(head, block, first.get(k), date))
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def deduplicate_archives(spark: SparkSession, source: str, target: str, tmp: Scratch, date: str, id_type: str = "long", at_least: int = 0) -> None:
    """Write the archives of source anew to target: of responses with equal payloads of at least at_least bytes all but the first (least id) become revisit records without payload, all with fresh headers.

    Resolved headers go to the tasks by their archive's path, and each task opens its own archives, so no payload is shuffled. Only where Python can't open the store (store_of) do Spark's reader and a join bring the contents.
    """
    headers = tmp.save(read_headers(spark, source), "headers")
    resolved = resolve_revisits(headers, tmp, id_type, at_least)
    # As many tasks as the number of files asks for, so that a task holds a few files at any size of the input.
    tasks = max(1, -(-headers.select("path").distinct().count() // FILES_PER_TASK))
    firsts = resolved.groupBy("path").agg(F.collect_list(F.struct("ord", "first_id", "first_uri", "first_date")).alias("firsts")).withColumn("date", F.lit(date)).repartition(tasks, "path")  # at most RECORDS_PER_FILE in a list
    if not opens(source):
        firsts = read_files(spark, source).repartition(tasks, "path").join(firsts, "path")
    write_archives(firsts.mapInArrow(_rewrite, "record binary"), target)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: int = 0, date: str | None = None) -> DataFrame:
    """Write a response record per page, resolve repeated payloads, write deduplicated archives, and read their headers back.

    Returns a row per page: id_col, payload_bytes, payload_digest, record_type (response or revisit), refers_to (id of the response, for revisits), url.

    A null html is an empty payload, and takes part like any other. A null url is empty; white space in urls becomes %20. Among equal payloads null ids come last, and of rows that repeat the least id one is the response; others refer to its id. An empty table gives an empty result. Other columns are not read.
    """
    spark, id_type = pages.sparkSession, dict(pages.dtypes)[id_col]
    prepare(spark)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    with Scratch(spark, "warc") as tmp:
        source, target = f"{tmp.root}/capture", f"{tmp.root}/archive"
        tmp.made |= {source: False, target: True}
        write_archives(response_records(pages, id_col, url_col, html_col, date), source)
        deduplicate_archives(spark, source, target, tmp, date, id_type, at_least)
    out = read_headers(spark, target)
    return out.select(F.col("id").cast(id_type).alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast(id_type).alias("refers_to"), F.col("uri").alias("url"))
