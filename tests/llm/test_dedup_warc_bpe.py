import base64
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repolens.llm import exact_dedup, golay, simhash, warc
from repolens.llm.bpe import WordBpe, encode_documents
from repolens.llm.components import connected_components
from repolens.llm.common import Scratch
from repolens.llm.exact_dedup import exact_duplicates
from repolens.llm.queries import tokenizer_path
from repolens.llm.simhash import fingerprint, near_duplicates
from repolens.llm.warc import archive_pages, parse

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, h string, d string, n long, t string"


def docs(spark, rows):
    """Documents with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None, "s", 1, 0, "h", "d", 0, "t") for i, t in rows], DOCS)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


ROWS = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "abc"), (7, "x" * 100_000), (8, "X" * 100_000), (2, "aBC"), (None, "alone"), (None, "alone")]


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[fold(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    more = {"digest": lambda t: F.when(F.length(t) > 3, F.lit(b"a")).otherwise(F.lit(b"b"))} if weak else {}
    got = exact_duplicates(docs(spark, ROWS), **more).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected_exact(ROWS)
    assert exact_duplicates(docs(spark, []), **more).count() == 0


def test_filter_of_the_index(spark):
    """It is sized from the entries, lets all of them through, and few others."""
    assert exact_dedup.bitmaps_for(0) == exact_dedup.bitmaps_for(2048) == 1 and exact_dedup.bitmaps_for(2049) == 2
    assert exact_dedup.bitmaps_for(10**12) == exact_dedup.MOST_BITMAPS
    rows = spark.range(40_000).select("id", exact_dedup.sha256(F.col("id").cast("string")).alias("d"))
    entries = rows.where("id % 4 = 0")
    n = exact_dedup.bitmaps_for(10_000)
    passed = {r["id"] for r in exact_dedup.probe(rows, exact_dedup.build_filter(entries, n), n).collect()}
    others = sum(1 for i in passed if i % 4)
    assert passed >= set(range(0, 40_000, 4)) and 0 < others < 30_000 / 10


def test_lookup_consults_the_filter(spark, monkeypatch):
    """Only texts that pass the filter are verified; without the filter's rows nothing is."""
    seen, whole = [], exact_dedup.probe

    def counted(rows, bits, bitmaps):
        out = whole(rows, bits, bitmaps)
        seen.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(exact_dedup, "probe", counted)
    rows = [(i, f"text {i}") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(20)]
    got = exact_duplicates(docs(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected_exact(rows)
    assert seen[0][0] == 520 and 40 <= seen[0][1] < 60


def test_golay_covers_two_errors():
    v = np.arange(0, 1 << 23, 4099)
    row, key = golay.near(v)
    sizes = np.bincount(row)
    assert set(sizes.tolist()) == {1, 6}
    keys = np.split(key, np.cumsum(sizes)[:-1])
    for a in range(0, 23, 5):
        for b in range(a, 23):
            other = v ^ (1 << a) ^ ((1 << b) if b > a else 0)
            r, k = golay.near(other)
            for x, y in zip(keys, np.split(k, np.cumsum(np.bincount(r))[:-1])):
                assert set(x.tolist()) & set(y.tolist())


def plain_components(ids, fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = sorted(parent)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [least.get(root(f)) for f in fps]


@pytest.mark.parametrize("block", [4, 2048])
def test_near_duplicates(spark, block):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    base = rng.choices(words, k=250)
    rows = [(0, None), (1, ""), (2, "One"), (3, "one\x0b"), (4, "\xa0"), (None, "one")]
    for i in range(10, 110):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(250)] = rng.choice(words)
        rows.append((i, " ".join(near) if i % 3 else " ".join(rng.choices(words, k=80))))
    rows.append((11, rows[11][1]))
    fps = [fingerprint(t) for _, t in rows]
    got = sorted(map(tuple, near_duplicates(docs(spark, rows), block=block).collect()), key=str)
    want = sorted([(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps))], key=str)
    assert got == want
    assert near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_by_five_words(spark, monkeypatch):
    """Edits that turn more than 4 bits; components equal to brute force over both kinds of links, whatever the order of shingles."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One\x0b"), (4, "one two")]
    for g in range(30):
        base = rng.choices(words, k=rng.choice([8, 40, 100, 300]))
        for _ in range(5 if g else 60):
            near = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((len(rows), " ".join(near)))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (simhash.words_of(t) for _, t in rows)]
    fps = [fingerprint(t) for _, t in rows]
    comp, bits, missed = list(range(len(rows))), 0, 0
    for a in range(len(rows)):
        for b in range(a):
            near = len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) > 0
            bits = (fps[a] ^ fps[b]).bit_count()
            missed += near and bits > 4
            if (near or bits <= 4) and comp[a] != comp[b]:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    assert missed > 100
    for often, block in ((3, simhash.BLOCK), (10**6, 7)):
        monkeypatch.setattr(simhash, "OFTEN", often)
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows), block=block, similar=True).collect()}
        assert got == dict(enumerate(comp))
    assert near_duplicates(docs(spark, []), similar=True).count() == 0


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(5)
    left, apart = 0, 0
    for _ in range(1500):
        n = int(rng.integers(1, 900))
        a = rng.integers(0, 2**64, n, np.uint64)
        b = np.concatenate([a[: n - int(n * rng.uniform(0, 0.25))], rng.integers(0, 2**64, int(n * rng.uniform(0, 0.25)), np.uint64)])
        x, y = (np.frombuffer(simhash.sketch(h), np.uint64) for h in (a, b))
        both = len(np.intersect1d(a, b))
        similar = 5 * both >= 4 * (len(a) + len(b) - both)
        for words in (8, min(len(x), len(y))):
            may = simhash.may_be_similar(simhash.fold_to(x, words), simhash.fold_to(y, words), len(a), len(b))
            assert may or not similar
        left, apart = left + (may and not similar), apart + (not similar)
    assert apart > 500 and left < 0.3 * apart


def test_pairs_of_buckets():
    """All pairs of every bucket that may be similar and have different roots; those of the first pass are among them, fewer than rows in each large bucket."""
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 2**64, 100, np.uint64) for _ in range(4)]
    keys = np.sort(rng.integers(0, 12, 150))
    rows = [np.concatenate([sets[rng.integers(4)][: 100 - cut], rng.integers(0, 2**64, cut, np.uint64)]) for cut in rng.integers(0, 15, 150)]
    z = np.stack([simhash.fold_to(np.frombuffer(simhash.sketch(h), np.uint64), 8) for h in rows])
    n, root, side = np.full(150, 100), rng.integers(0, 40, 150), np.full(150, -1)
    want = {(x, y) for y in range(150) for x in range(y) if keys[x] == keys[y] and root[x] != root[y] and simhash.may_be_similar(z[x], z[y], 100, 100)}
    as_set = lambda found: {(min(x, y), max(x, y)) for x, y in zip(*(v.tolist() for v in found))}
    assert as_set(simhash.bucket_pairs(keys, root, n, z, side, True)) == want
    some = as_set(simhash.bucket_pairs(keys, root, n, z, side, False))
    assert some < want and all(sum(keys[x] == k for x, _ in some) < size for k, size in zip(*np.unique(keys, return_counts=True)) if size > simhash.FEW)


def test_fingerprint_is_spark_xxhash(spark):
    text = "A b c D e"
    hashes = [r[0] & (1 << 64) - 1 for r in spark.sql("select xxhash64(s) from values ('a b c d'), ('b c d e') as t(s)").collect()]
    assert fingerprint(text) == hashes[0] & hashes[1]
    assert fingerprint("A b") == spark.sql("select xxhash64('a b')").first()[0] & (1 << 64) - 1


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id + 1 as u", "id as v").union(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "u long, v long"))
    with Scratch(spark, "t") as tmp:
        got = {r["node"]: r["root"] for r in connected_components(edges, tmp).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_archives(spark):
    html = ["<p>é\r\n\r\nWARC/1.1\r\n</p>", "", None, "b", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "b", "long " * 50_000]
    rows = [(i + 1, f"http://h/{i} x\r\n", h, "id", "x") for i, h in enumerate(html)] + [(4, None, "b", "id", "y"), (None, "u", "b", "id", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string, digest string")
    got = [tuple(r)[:5] for r in archive_pages(pages).collect()]
    want, seen = [], {}
    for i, h in sorted(((r[0], r[2] or "") for r in rows), key=lambda x: (x[0] is None, x[0])):
        first = seen.setdefault(h, i)
        payload = h.encode()
        again = (h, i) in [w[5] for w in want] or first != i
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None, (h, i)))
    assert sorted(got, key=str) == sorted([w[:5] for w in want], key=str)
    assert archive_pages(pages.where("false")).count() == 0
    sized = archive_pages(pages, at_least=2).where("payload_bytes < 2").select("record_type").distinct().collect()
    assert [r[0] for r in sized] == ["response"]


@pytest.mark.parametrize("opened", [True, False])
def test_archives_that_hold_revisits(spark, tmp_path, monkeypatch, opened):
    """A second pass changes nothing but dates; a revisit whose response isn't there stays one, whatever its id; where tasks can't open files, contents are joined."""
    if not opened:
        monkeypatch.setattr(warc, "opens", lambda path: False)
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"text {k % 7}" if k < 30 else None) for k in range(40)], "page_id long, url string, html string")
    at = lambda k: f"file://{tmp_path}/{k}"
    warc.write_archives(warc.response_records(pages, "page_id", "url", "html", "2020-01-01T00:00:00Z"), at(0))
    alone = warc._fresh({"warc-type": "response", "warc-record-id": "<urn:page:-5>", "warc-target-uri": "http://h/x", "warc-payload-digest": "sha1:" + "A" * 32}, b"HTTP/1.1 200 OK\r\n\r\ngone", {"first_id": "99", "first_uri": "http://h/y", "first_date": "2019-01-01T00:00:00Z"}, "2019-01-01T00:00:00Z")
    early = warc._fresh({"warc-type": "response", "warc-record-id": "<urn:page:-9>", "warc-target-uri": "http://h/z", "warc-payload-digest": "sha1:" + base64.b32encode(hashlib.sha1(b"text 3").digest()).decode()}, b"HTTP/1.1 200 OK\r\n\r\ntext 3", {"first_id": "98", "first_uri": "u", "first_date": "d"}, "2019-01-01T00:00:00Z")
    spark.createDataFrame([(alone,), (early,)], "record binary").select(F.col("record").cast("string").alias("record")).write.mode("append").options(lineSep=warc.END, compression="gzip").text(at(0))
    seen = []
    with Scratch(spark, "warc_test") as tmp:
        for k in (0, 1):
            warc.deduplicate_archives(spark, at(k), at(k + 1), tmp, "2021-01-01T00:00:00Z")
            tmp.drop("headers", "firsts")
            seen.append(sorted((r["id"], r["type"], r["digest"], r["payload_bytes"], r["refers_to"]) for r in warc.read_headers(spark, at(k + 1)).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 42
    by = {r[0]: r for r in seen[0]}
    assert by["-5"][1:] == ("revisit", "A" * 32, 4, "99") and by["-9"][1] == "revisit" and by["-9"][3:] == (6, "3")
    assert [by[str(k)][1] for k in (3, 10, 30, 31)] == ["response", "revisit", "response", "revisit"] and by["10"][4] == "3"


def test_parse_rejects_what_is_cut():
    import gzip

    with pytest.raises(ValueError):
        list(parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_bpe_equals_the_library(spark):
    path = tokenizer_path()
    library, rng = Tokenizer.from_file(path), random.Random(1)
    pieces = [w.removesuffix("</w>") for w in library.get_vocab()]
    texts = [None, "", "  ", "<|endoftext|>a<|startoftext|> b <|ENDOFTEXT|>", "ΣΑΣ Σ İI ǅ", "don't I'LL it'Sx", "éa 漢字 한국어 😀🏳️‍🌈", "½²³ ١٢٣ Ⅷ", "x" * 30_000, "\x1c a\x85b\x0bc\xa0d", "ﬁ Å مرحبا हिन्दी 𝔘", "don't"]
    texts += [" ".join(rng.choice(pieces) + rng.choice(pieces) for _ in range(50)) for _ in range(60)]
    texts += ["".join(rng.choices("aeiourstln ", k=400)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, "again"), (None, "none")]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_documents(docs(spark, rows), path).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == want
    assert encode_documents(docs(spark, []), path).count() == 0
    coder = WordBpe(path)
    for n in (47, 48, 49, 200, 3000):  # beyond SCANNED a heap merges
        for word in ("".join(rng.choices("aabcdest", k=n)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)), "ab" * (n // 2)):
            assert np.frombuffer(coder.encode([word])[0][1], "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    for _, ids, decoded in coder.encode([t or "" for t in texts]):
        assert coder.decode(ids) == decoded


def test_long_words_take_little_more_than_linear_time():
    coder, rng = WordBpe(tokenizer_path()), random.Random(3)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    began = time.process_time()
    ids = np.frombuffer(coder.encode([word])[0][1], "<u4").tolist()
    assert time.process_time() - began < 30
    assert ids == Tokenizer.from_file(tokenizer_path()).encode(word, add_special_tokens=False).ids
