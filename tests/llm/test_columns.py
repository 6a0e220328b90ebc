"""Media columns, vector codes and resampling against brute force."""

import hashlib
import json
import math
import os
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from repolens.llm import media, resampling, vector_codes
from repolens.llm.common import BATCH_BYTES, prepare

LONG = "x y " * 40_000


def rows_of(df, *order):
    return sorted(map(tuple, df.select(*order).collect()), key=str)


# Media.


def expected_media(key, text):
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    image = media.encode(data)
    return key, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(payload)


def test_media_columns(spark):
    texts = [None, "", "a", "a" * 576, "b" * 577, "ü€𝄞" * 99, LONG, "a", "same", "same", "\x00\xff\n"]
    rows = [(k if k != 2 else None, t, "clash", 1, "c") for k, t in enumerate(texts)] + [(8, "same", "clash", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, content int, error string").repartition(3)
    got = rows_of(media.media_columns(docs), *(c.split()[0] for c in media.FOUND.split(", ")))
    assert got == sorted((expected_media(r[0], r[1]) for r in rows), key=str)
    assert media.media_columns(docs.limit(0)).count() == 0


def test_images():
    rng = random.Random(1)
    for n in (0, 1, 575, 576, 577, 5000):
        data = rng.randbytes(n)
        image = media.encode(data)
        assert media.decode(image) == (media.padded(data), n)
        for at in (3, 20, len(image) // 2, len(image) - 3):
            with pytest.raises((ValueError, zlib.error)):
                media.decode(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :])
        with pytest.raises(ValueError):
            media.decode(image[: len(image) // 2])
    # The image is what any reader of PNG expects: sizes, depth, and rows that begin with a filter.
    assert media.encode(b"abc")[:24].endswith(b"IHDR" + (576).to_bytes(4, "big") + (1).to_bytes(4, "big"))


@pytest.fixture()
def archives(spark, tmp_path):
    path = str(tmp_path / "archives")
    media.register(spark)
    members = spark.range(60).selectExpr("concat('m', id) as name", "cast(repeat(cast(id as string), 500 + cast(id as int) * 7) as binary) as content")
    members.repartition(2).write.format("media_archive").option("archiveBytes", 9000).mode("append").save(path)
    return path


def ranges(path, size):
    reader = media.ArchiveReader({"path": path, "rangebytes": str(size), "batchbytes": "2000"})
    return reader, reader.partitions()


@pytest.mark.parametrize("size", [100, 3000, 10**9])
def test_ranges_cover_each_member_once(archives, size):
    reader, parts = ranges(archives, size)
    seen = [(r["archive"], r["offset"], r["name"], r["content"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(seen) == len(set(seen)) == 60 and {s[2]: s[3] for s in seen} == {f"m{i}": str(i).encode() * (500 + 7 * i) for i in range(60)}
    assert len(parts) == 1 if size == 10**9 else len(parts) > 10
    # Archives are ordinary ZIP files.
    for path in {s[0] for s in seen}:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
    assert all(sum(len(x["content"]) for x in b.to_pylist()[:-1]) < 2000 for p in parts for b in reader.read(p))


def test_members_are_retried_by_offset(archives, monkeypatch):
    reader, parts = ranges(archives, 10**9)
    reads, plain = [], media.content_of
    bad = {}

    def flaky(store, path, member):
        reads.append(member.filename)
        if member.filename == "m7" and reads.count("m7") < 3:
            raise OSError("the connection was lost")
        if bad.get("member") == member.filename:
            raise zipfile.BadZipFile("the checksum differs")
        return plain(store, path, member)

    monkeypatch.setattr(media, "content_of", flaky)
    monkeypatch.setattr(media, "PAUSE_S", 0)
    got = [r for b in reader.read(parts[0]) for r in b.to_pylist()]
    assert len(got) == 60 and reads.count("m7") == 3 and len(reads) == 62 and not any(r["error"] for r in got)
    bad["member"] = "m9"
    with pytest.raises(OSError, match="checksum"):
        list(reader.read(parts[0]))
    reader.keep = True
    got = {r["name"]: r for b in reader.read(parts[0]) for r in b.to_pylist()}
    assert got["m9"]["content"] is None and "checksum" in got["m9"]["error"] and sum(r["content"] is None for r in got.values()) == 1


def test_damage_is_found(archives):
    reader, parts = ranges(archives, 10**9)
    path = parts[0].of[0][0]
    member = media.members(fs.LocalFileSystem(), path, 0, 10**9)[0]
    data = bytearray(open(path, "rb").read())
    data[member.header_offset + 30 + len(member.filename) + 5] ^= 1
    open(path, "wb").write(data)
    reader.retries = 0
    with pytest.raises(OSError, match=f"at {member.header_offset}.*checksum"):
        list(reader.read(parts[0]))


def test_only_committed_archives_are_read(spark, archives):
    stray = os.path.join(archives, "part-of-a-failed-task.zip")
    with zipfile.ZipFile(stray, "w") as z:
        z.writestr("stray", b"1")
    table = lambda: spark.read.format("media_archive").load(archives)  # noqa: E731  a DataFrame keeps the archives that it found
    assert table().count() == 60
    more = spark.sql("select 'n' as name, cast('x' as binary) as content")
    more.write.format("media_archive").mode("append").save(archives)
    assert table().count() == 61
    more.write.format("media_archive").mode("overwrite").save(archives)
    assert [r["name"] for r in table().collect()] == ["n"] and len(os.listdir(archives)) == 3  # with the stray archive
    assert spark.read.format("media_archive").load(archives + "-none").count() == 0
    writer = media.ArchiveWriter({"path": archives}, False)
    writer.abort([media.Written([("part-of-a-failed-task.zip", 1)]), None])
    assert not os.path.exists(stray)


# Vector codes.


def expected_codes(rows):
    """rows: (vec_id, vector, label). Plain Lloyd over all vectors."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = max(8, -(-max(len(r[1]) for r in kept) // 8) * 8)
    most = vector_codes.most_component(width)
    whole = [[max(-most, min(most, math.floor(float(np.float32(x)) * 4096))) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    n = width // 8
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:16]
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(8):
        parts = [tuple(w[p * n : p * n + n]) for w in whole]
        book = [parts[i] for i in first]
        nearest = lambda part: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(6):
            at = [nearest(x)[1] for x in parts]
            for k in set(at):
                mine = [x for x, a in zip(parts, at, strict=True) if a == k]
                book[k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        for i, x in enumerate(parts):
            d, k = nearest(x)
            codes[i] += f"{k:02x}"
            errors[i] += d
        books += book
    sha = hashlib.sha256(",".join(str(x) for e in books for x in e).encode()).hexdigest()
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return [(r[0], c, e, min(by_label[r[2]], (1 << 63) - 1), sha) for r, c, e in zip(kept, codes, errors, strict=True)]


COLUMNS = "vec_id", "code", "error", "label_error", "codebooks_sha256"


def vectors(rng, n, width):
    return [(i, [rng.gauss(0, 0.2) for _ in range(width)], rng.choice([0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "odd", "few", "huge", "none"])
def test_vector_codes(spark, case):
    rng = random.Random(5)
    rows = vectors(rng, 150, 16)
    if case == "odd":
        hot = [0.5] * 16
        rows += [(1000 + i, hot, 3) for i in range(80)] + [(None, hot, 1), (None, [0.1] * 3, None), (7, rows[7][1], 2), (7, rows[8][1], 2)]
        rows += [(2000, None, 1), (2001, [None] * 16, 1), (-5, [float("nan")] * 16, 1), (2003, [float("inf")] + [0.0] * 15, 1), (2004, [], 1), (-6, [0.0] * 17, 1)]
    elif case == "few":
        rows = rows[:3] + rows[:1]
    elif case == "huge":
        rows += [(500 + i, [(-1) ** i * 3e38] * 16, 9) for i in range(40)]
    elif case == "none":
        rows = [(1, None, 1), (2, [float("nan")], 1)]
    table = spark.createDataFrame([(r[0], r[1], r[2], "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row string, part int, code int").repartition(4)
    assert rows_of(vector_codes.compress(table), *COLUMNS) == sorted(expected_codes(rows), key=str)
    if case == "none":
        assert vector_codes.compress(table.limit(0)).columns == list(COLUMNS)


def test_vector_codes_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(6)
    rows = vectors(rng, 300, 16) + [(900 + i, [0.25] * 16, None) for i in range(100)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert rows_of(got, *COLUMNS) == sorted(con.execute(vector_codes.oracle()).fetchall(), key=str)


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_IDS", 2)
    rows = vectors(random.Random(7), 60, 8)
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert rows_of(got, *COLUMNS) == sorted(expected_codes(rows), key=str)


def test_equal_parts_are_one_row(spark):
    rows = [(i, [float(i % 3)] * 16, 0) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_codes.compress(table)
    assert got.select("code").distinct().count() == 3 and got.agg({"error": "sum"}).first()[0] == 0


# Resampling.


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected_draw(docs, target, percent=5):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, text in docs:
        np.add.at(s, features(text), 1)
    for text in target:
        np.add.at(t, features(text), 1)
    total, wanted = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * (total + 10_000) / ((int(a) + 1) * (wanted + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for key, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= 20])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in rows]


DRAWN = "doc_id", "n_features", "weight", "score", "rank"


def corpus(rng):
    vocabulary = [*"abcdefgh", "über", "ÜBER", "Straße", "Mixed", "x1", "3", "naïve", "日本"]
    docs = [(i, rng.choice([" ", ", ", "\n", "--", "\x00"]).join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 19, 20, 21, 60])))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "!?\x00 --"), (903, LONG), (None, "a b c " * 10), (None, "a b c " * 10), (904, "one"), (5, docs[5][1]), (5, docs[5][1])]
    return docs, [" ".join(rng.choices(vocabulary[:6], k=40)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20), (64, 300)])
def test_resampling(spark, monkeypatch, sizes):
    docs, target = corpus(random.Random(2))
    table = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in docs], "doc_id long, text string, weight int, rank string, ids int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for name, size in zip(("PIECE", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(resampling, name, size)
    got = resampling.resample(table, wanted, percent=20)
    assert got.columns == list(DRAWN)
    assert rows_of(got, *DRAWN) == sorted(expected_draw(docs, target, 20), key=str)


def test_words_across_pieces(monkeypatch):
    text = ("Ab  cde!fghij klm " * 50 + "q" * 500 + " end").encode()
    whole = resampling.buckets(text)
    for size in (1, 2, 3, 7, 64, 501):
        monkeypatch.setattr(resampling, "PIECE", size)
        n, found = resampling.buckets(text)
        assert n == whole[0] and sorted(np.concatenate(found)) == sorted(np.concatenate(whole[1])) == sorted(features(text.decode()))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, "w " * 30) for i in range(100)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    got = resampling.resample(some, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len(got) == 100


def test_resampling_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    docs, target = corpus(random.Random(3))
    docs = [d for d in docs if d[0] is not None and "\x00" not in (d[1] or "") and d[0] not in (5, 903)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?)", [(t,) for t in target])
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows_of(got, *DRAWN) == sorted(con.execute(resampling.oracle()).fetchall(), key=str)


def test_batches_are_bounded_by_bytes(spark):
    prepare(spark)
    big = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sizes = big.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n bigint").collect()
    assert len(sizes) > 5 and max(r["n"] for r in sizes) <= BATCH_BYTES + (2 << 20)


def test_queries_are_registered():
    from repolens.llm.queries import ORACLE_SQL, QUERIES

    assert {"op11_media_columns", "op12_vector_codes", "op13_importance_resampling"} <= set(QUERIES)
    assert {"op12_vector_codes", "op13_importance_resampling"} <= set(ORACLE_SQL)
    assert json.dumps(ORACLE_SQL)
