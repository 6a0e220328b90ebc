"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The 64 bits are cut into three segments of 22, 21 and 21 bits, each padded with zeros to a vector of the Golay code. If two fingerprints differ in at most 4 bits, sort the segments' errors: the least is 0 or 1, and
  either one segment is equal and another differs in at most 2 bits: key (equal segment, index of the other's codeword or a neighbour's), six orders of two segments,
  or two segments differ in exactly 1 bit: key (first segment, index of the second), three pairs. One bit turns the parity of a segment. So the side that is even in the first brings that segment as it is and the indices of the second's neighbourhood; the odd side brings the first with each of its bits turned and the second's one index.
Each key has 34 bits, so chance meetings stay rare among billions of fingerprints.
So two linked fingerprints share a key for certain; each pair in a bucket is verified by its Hamming distance.

Where a stage asks for it, texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more are linked too. Candidates come from a prefix filter, which is exact: of each set, ordered alike everywhere (shingles that a sample finds often come last), the first fifth and one more are keys, and two such sets share a key. The pairs of a bucket are held against each other by sketches of parities, which tell for certain that most aren't similar; each pair that is left is verified on the whole sets.

Only distinct fingerprints take part. A bucket yields a spanning forest of its links, never all pairs. A bucket of more than BLOCK fingerprints is dealt into blocks; each pair of blocks is a bucket of its own, so that no task gets a whole large bucket, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from . import golay
from .common import Scratch, held, prepare
from .components import connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
BLOCK = 2048
#: Words of a shingle, and least Jaccard similarity (numerator, denominator), of near copies told by their sets of shingles.
WORDS, SIMILAR = 5, (4, 5)
#: Documents, in expectation, that the order of shingles is drawn from; shingles that OFTEN or more of them have come last, COMMON of these at most. The order decides the number of candidates, never what is found.
ORDER_DOCS, OFTEN, COMMON = 4000, 3, 50_000
#: Bits of the sketches that buckets are compared by. In buckets of up to FEW texts all pairs are compared at once.
NARROW, FEW = 512, 4
#: Buckets up to this size are compared by shifted rows, larger ones by a search.
SHIFTED = 12


def hashes(words: list[bytes], width: int, seed: int) -> list[int]:
    """XXH64 of the shingles of width words (repeats included; fewer words: the whole sequence)."""
    joined, last = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    of = xxhash.xxh64_intdigest
    return [of(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist())]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def of_words(words: list[bytes], width: int = 4, seed: int = 42) -> int:
    if not words:
        return 0
    h = hashes(words, width, seed)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        set_bits += np.unpackbits(np.array(h[k : k + 65536], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: A-Z in lower case, words between ASCII white space, shingles of width words (repeats included; fewer words: the whole sequence), XXH64; a bit is 1 if set in over half the shingles. No word, or null: 0."""
    return of_words(words_of(text), width, seed)


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles of WORDS words, sorted."""
    return np.unique(np.array(hashes(words, WORDS, 42) if words else [], np.uint64))


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least hashes of a sorted set by (count among common ones, hash): so many that two sets of Jaccard similarity SIMILAR share one."""
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
    return h[: len(h) - -(-SIMILAR[0] * len(h) // SIMILAR[1]) + 1] if len(h) else h


@pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    held("simhash", dict)
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of each 64-bit fingerprint; keys of different kinds never meet."""
    part = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    one = [golay.index(p).astype(np.int64) for p in part]
    several = [golay.near(p) for p in part]
    rows, keys, kind = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                r, c = several[j]
                rows.append(r)
                keys.append(kind << 56 | part[i][r] << 12 | c)
                kind += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        odd = np.bitwise_count(part[i]) & 1 == 1
        r, c = several[j]
        even = ~odd[r]
        rows.append(r[even])
        keys.append(kind << 56 | part[i][r[even]] << 12 | c[even])
        r = np.repeat(np.flatnonzero(odd), SEGMENTS[i][1])
        turned = part[i][r] ^ np.tile(1 << np.arange(SEGMENTS[i][1]), int(odd.sum()))
        rows.append(r)
        keys.append(kind << 56 | turned << 12 | one[j][r])
        kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def forest(fps: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that join the members of fps (distinct) into their components under Hamming distance <= bits: a search that compares each found member with those not found yet."""
    left, links = fps, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count(left ^ x) <= bits
            if hit.any():
                found = left[hit]
                links += [(int(x), int(y)) for y in found]
                todo.extend(found)
                left = left[~hit]
    return links


def bucket_links(keys: np.ndarray, fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets; rows of a bucket are adjacent."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    small = np.repeat(sizes <= SHIFTED, sizes)
    for k in range(1, min(SHIFTED, len(keys))):
        near = np.flatnonzero((keys[k:] == keys[:-k]) & small[k:])
        if not len(near):
            break
        near = near[np.bitwise_count(fps[near] ^ fps[near + k]) <= bits]
        a.append(fps[near])
        b.append(fps[near + k])
    for s, n in zip(starts[sizes > SHIFTED], sizes[sizes > SHIFTED]):
        links = np.array(forest(np.unique(fps[s : s + n]), bits), np.uint64).reshape(-1, 2)
        a.append(links[:, 0])
        b.append(links[:, 1])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("simhash", dict)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 4096):
            some = fp[at : at + 4096]
            row, key = golay_keys(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row])], ["key", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket that may go on in the next batch waits. A bucket has 2 * BLOCK rows at most, give or take how evenly the hash deals."""
    held("simhash", dict)
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def done(n: int) -> pa.RecordBatch:
        a, b = bucket_links(keys[:n], fps[:n])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            keys = np.concatenate([keys, batch.column("bucket").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if n := int(np.searchsorted(keys, keys[-1])):
                yield done(n)
                keys, fps = keys[n:], fps[n:]
    if len(keys):
        yield done(len(keys))


def link_table(fps: DataFrame, tmp: Scratch, block: int = BLOCK) -> DataFrame:
    """Links (u, v) of distinct fingerprints (column fp, long), enough to join each component."""
    keyed = tmp.save(fps.select("fp").mapInArrow(_with_keys, "key long, fp long"), "keyed")
    sizes = tmp.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    member = tmp.save(keyed.join(sizes.hint("merge"), "key"), "member")  # the same plan at every size
    tmp.drop("keyed", "sizes")
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fp"), blocks)
    met = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = member.select("key", "fp", own.alias("own"), F.explode(met).alias("met"))
    # A block of a large bucket meets every block; (low, high) names the pair. Buckets of one block have the pair (0, 0).
    bucket = F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met"))
    buckets = dealt.select(bucket.alias("bucket"), "fp").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    links = tmp.save(buckets.mapInArrow(_links, "u long, v long").where("u <> v"), "links")
    tmp.drop("member")
    return links


def _set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("simhash", dict)
    for batch in batches:
        sets = [shingles(words_of(t)).view(np.int64) for t in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(sets, pa.list_(pa.int64()))], ["c", "s"])


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that OFTEN or more of about ORDER_DOCS texts have, and in how many."""
    share = min(1.0, ORDER_DOCS / max(1, docs.count()))
    some = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("c")).where(F.pmod("c", F.lit(1_000_000)) < int(1_000_000 * share))
    found = some.mapInArrow(_set, "c long, s array<long>").select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sketch(h: np.ndarray) -> bytes:
    """Parities of a set's hashes, dealt to 4 bits or more for each: a power of two, NARROW at least. Bits that differ between two sets' sketches of equal width are no more than the elements in just one of them. A sketch folds to half its width by XOR of its halves."""
    width = max(NARROW, 1 << (4 * len(h) - 1).bit_length()) if len(h) else NARROW
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold_to(z: np.ndarray, words: int) -> np.ndarray:
    """A sketch in 64-bit words, folded to as many words."""
    return np.bitwise_xor.reduce(z.reshape(-1, words), axis=0)


def may_be_similar(zx: np.ndarray, zy: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """False only where sets of sizes nx and ny surely aren't similar: J >= p/q allows (q - p) / (q + p) of the sizes' sum in the sets' difference, and sizes in the proportion p/q. Sketches are rows of 64-bit words."""
    p, q = SIMILAR
    nx, ny = np.asarray(nx, np.int64), np.asarray(ny, np.int64)
    apart = np.bitwise_count(zx ^ zy).sum(-1, dtype=np.int64)
    return ((q + p) * apart <= (q - p) * (nx + ny)) & (q * np.minimum(nx, ny) >= p * np.maximum(nx, ny))


def bucket_pairs(keys: np.ndarray, root: np.ndarray, n: np.ndarray, z: np.ndarray, side: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows) of a bucket that may be similar and have different roots; rows of a bucket are adjacent.

    If every, all of them (of a pair of blocks, those between the two sides). Else all of a bucket of up to FEW rows; in a larger one the first row that isn't claimed claims, and is paired with, all that may be similar to it, until all are claimed, so that there are fewer pairs than rows.
    """
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= FEW, sizes)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, min(FEW, len(keys))):
        x = np.flatnonzero((keys[k:] == keys[:-k]) & small[k:] & (root[k:] != root[:-k]))
        x = x[may_be_similar(z[x], z[x + k], n[x], n[x + k])]
        a.append(x)
        b.append(x + k)
    for s, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        left = np.arange(s, s + size)
        while len(left) > 1:
            x, left = left[0], left[1:]
            same = root[left] == root[x]
            near = may_be_similar(z[left], z[x], n[left], n[x])
            hit = left[near & ~same & ((side[left] != side[x]) | (side[x] < 0))] if every else left[near & ~same]
            a.append(np.full(len(hit), x))
            b.append(hit)
            if not every:
                left = left[~(near | same)]
    return np.concatenate(a), np.concatenate(b)


def _pairs(every: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket that may go on in the next batch waits."""
        held("simhash", dict)
        kept: list[np.ndarray] = []

        def done(of: list[np.ndarray]) -> pa.RecordBatch:
            keys, c, fp, root, n, side, z = of
            x, y = bucket_pairs(keys, root, n, z, side, every)
            x, y = np.where(c[x] > c[y], y, x), np.where(c[x] > c[y], x, y)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (c[x], c[y], fp[x], fp[y], n[x], n[y])], ["a", "b", "u", "v", "na", "nb"])

        for batch in batches:
            if batch.num_rows:
                now = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "c", "fp", "root", "n", "side")]
                now.append(np.frombuffer(b"".join(batch.column("z").to_pylist()), np.uint64).reshape(-1, NARROW // 64))
                kept = [np.concatenate(two) for two in zip(kept, now)] if kept else now
                if n := int(np.searchsorted(kept[0], kept[0][-1])):
                    yield done([k[:n] for k in kept])
                    kept = [k[n:] for k in kept]
        if kept:
            yield done(kept)

    return of


def candidate_pairs(member: DataFrame, texts: DataFrame, every: bool, tmp: Scratch, name: str, block: int) -> DataFrame:
    """Distinct pairs (a < b: hashes of texts; u, v: fingerprints; na, nb: sizes) from the buckets of member (key, rows in the bucket, c) for texts (c, fp, n, z, root). Large buckets are dealt into blocks, as those of fingerprints are."""
    blocks = F.ceil(F.col("rows") / block)
    own = F.pmod(F.xxhash64("c"), blocks)
    met = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = member.join(texts.select("c", "fp", "n", "z", "root").hint("merge"), "c").select("key", "c", "fp", "root", "n", "z", own.alias("own"), F.explode(met).alias("met"))
    side = F.when(F.col("own") == F.col("met"), -1).otherwise(F.col("own"))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met")).alias("bucket"), "c", "fp", "root", "n", side.cast("long").alias("side"), "z")
    found = dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_pairs(every), "a long, b long, u long, v long, na int, nb int")
    return tmp.save(found.distinct(), f"{name}pairs")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("simhash", dict)
    for batch in batches:
        good = []
        for x, y, nx, ny in zip(*(batch.column(k).to_pylist() for k in ("za", "zb", "na", "nb"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(x), len(y))
            good.append(bool(may_be_similar(fold_to(x, words), fold_to(y, words), nx, ny)))
        yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b", "u", "v"])


def similar_pairs(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, text_col: str, tmp: Scratch, name: str) -> DataFrame:
    """Links (u, v) of the pairs whose sets of shingles are similar: those that whole sketches (c, wide) leave are verified on the sets. Only texts of these are shuffled."""
    wide = lambda k: sketches.select(F.col("c").alias(k), F.col("wide").alias(f"z{k}")).hint("merge")
    pairs = tmp.save(pairs.join(wide("b"), "b").join(wide("a"), "a").mapInArrow(_sketched, "a long, b long, u long, v long"), f"{name}left")
    wanted = tmp.save(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct(), f"{name}wanted")
    texts = docs.select(F.xxhash64(text_col).alias("c"), F.col(text_col).alias("t")).join(wanted, "c", "left_semi").groupBy("c").agg(F.first("t").alias("t"))
    sets = tmp.save(texts.mapInArrow(_set, "c long, s array<long>"), f"{name}sets")
    of = lambda k: sets.select(F.col("c").alias(k), F.col("s").alias(f"s{k}")).hint("merge")
    shared = F.size(F.array_intersect("sa", "sb"))
    good = pairs.join(of("b"), "b").join(of("a"), "a").where(SIMILAR[1] * shared >= SIMILAR[0] * (F.size("sa") + F.size("sb") - shared))
    links = tmp.save(good.select("u", "v").distinct(), f"{name}links")
    tmp.drop(f"{name}left", f"{name}wanted", f"{name}sets")
    return links


def similar_links(featured: DataFrame, links: DataFrame, docs: DataFrame, text_col: str, tmp: Scratch, block: int = BLOCK) -> DataFrame:
    """links, and enough links (u, v) of fingerprints to join all texts that are similar. featured: c (hash of the text), fp, n (size of the set), keys, z and wide (its sketch, folded and whole); rows may repeat.

    First in each large bucket some texts are held against those that may be similar to them, so that a large group costs a pair for each of its texts. Then all pairs of a bucket that may be similar and aren't joined yet are held against each other.
    """
    texts = tmp.save(featured.select("c", "fp", "n", "keys", "z", "wide").dropDuplicates(["c"]), "texts")
    # Keys are unique in a text, and only they and the text's hash are shuffled.
    keyed = texts.select(F.explode("keys").alias("key"), "c")
    buckets = tmp.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
    member = tmp.save(keyed.join(buckets.hint("merge"), "key"), "member")
    tmp.drop("buckets")
    first = candidate_pairs(member, texts.withColumn("root", F.col("fp")), False, tmp, "first", block)
    links = links.unionByName(similar_pairs(first, texts, docs, text_col, tmp, "first"))
    stars = tmp.save(connected_components(links, tmp, "joined").withColumnRenamed("node", "fp"), "joined")
    joined = tmp.save(texts.select("c", "fp", "n", "z").join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "joinedtexts")
    rooted = tmp.save(member.join(joined.select("c", "root").hint("merge"), "c"), "memberroots")
    tmp.drop("member")
    apart = rooted.groupBy("key").agg(F.min("root").alias("f"), F.max("root").alias("g")).where("f <> g").select("key")
    rest = candidate_pairs(rooted.drop("root").join(apart.hint("merge"), "key"), joined, True, tmp, "rest", block).join(first.select("a", "b"), ["a", "b"], "left_anti")
    tmp.drop("memberroots", "joinedtexts")
    links = links.unionByName(similar_pairs(rest, texts, docs, text_col, tmp, "rest"))
    tmp.drop("texts")
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, similar: bool = False) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most 4 bits; if similar, also of those whose sets of five-word shingles have a Jaccard similarity of at least 0.8 (words as for fingerprints; of fewer words the whole sequence is the only shingle; texts without words have none).

    Returns a row per input row: id_col, fingerprint (16 hex digits), component_id (the least id that links reach).

    Null texts count as empty; texts without words have the fingerprint 0 and link like others. Null ids never become a component_id unless all ids of the component are null. Rows that repeat an id are returned as often as they occur. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    with Scratch(spark, "simhash") as tmp:
        if similar:
            common, counts = common_shingles(docs, text_col)

            def with_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held("simhash", dict)
                for batch in batches:
                    fps, sizes, keys, wide, z = [], [], [], [], []
                    for t in batch.column("t").to_pylist():
                        words = words_of(t)
                        h = shingles(words)
                        fps.append(of_words(words))
                        sizes.append(len(h))
                        keys.append(prefix(h, common, counts).view(np.int64))
                        wide.append(sketch(h))
                        z.append(fold_to(np.frombuffer(wide[-1], np.uint64), NARROW // 64).tobytes())
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("c"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(z, pa.binary()), pa.array(wide, pa.binary())], ["id", "c", "fp", "n", "keys", "z", "wide"])

            read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("c"))
            featured = tmp.save(read.mapInArrow(with_prefix, f"id {dict(docs.dtypes)[id_col]}, c long, fp long, n int, keys array<long>, z binary, wide binary"), "featured")
            rows = tmp.save(featured.select("id", "fp"), "rows", keep=True)
        else:
            rows = tmp.save(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")), "rows", keep=True)
        fps = tmp.save(rows.groupBy("fp").agg(F.min("id").alias("least")), "fps", keep=True)
        links = link_table(fps, tmp, block)
        if similar:
            links = similar_links(featured, links, docs, text_col, tmp, block)
        stars = tmp.save(connected_components(links, tmp), "stars")
        rooted = tmp.save(fps.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
        leasts = tmp.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "leasts")
        of_fp = tmp.save(rooted.join(leasts, "root").select("fp", "component_id"), "of_fp", keep=True)
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

