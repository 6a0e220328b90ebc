import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from repolens.llm import decontaminate, toxicity
from repolens.llm.common import BROADCAST_IDS, drop_ids
from repolens.llm.queries import tokenizer_path
from repolens.llm.simhash import fingerprint
from tests.llm.test_dedup_warc_bpe import fold, plain_components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of which some are toxic, copies, near copies or hold a benchmark item."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(1500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(30)) for i in range(12)]
    base, rows, labels = text(400), [], []
    for d in range(400):
        t = text(rng.randint(20, 200))
        if d % 10 == 1:
            t = base.replace(" ", "  ", d)  # the same words in other spacing
        elif d % 10 == 2:
            t = rows[d - 2][1].upper()
        elif d % 10 == 3:
            near = base.split()
            near[d % 400] = "other"
            t = " ".join(near)
        elif d % 10 == 4:
            t += "\n" + items[d % 12][1]
        elif d % 4 == 1:
            t = t.replace(" ", " zozzle ", 1)
        rows.append((d, t, "en", "s", len(t)))
        labels.append((d, 1, int("zozzle" in t)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "none", "en", "s", 4)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline(spark, tables):
    folder, rows, items = tables
    docs = [(r[0], r[1]) for r in rows]
    net = toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = toxicity.Scorer(net).scores([t for _, t in docs])
    toxic = {i for (i, t), s in zip(docs, scores) if s >= 0.5}
    planted = {i for i, t in docs if "zozzle" in (t or "")}
    assert len(toxic & planted) >= 0.9 * len(planted) and len(toxic - planted) < 12
    docs = [d for d in docs if d[0] not in toxic]
    last = {}
    for i, t in docs:
        if i is not None:
            last[fold(t)] = max(i, last.get(fold(t), i))
    docs = [(i, t) for i, t in docs if i is None or last[fold(t)] == i]
    roots = plain_components([i for i, _ in docs], [fingerprint(t) for _, t in docs])
    docs = [d for d, c in zip(docs, roots) if d[0] is None or d[0] == c]
    queries = [decontaminate.words_of(t) for _, t in items]

    def holds(t):
        w = decontaminate.words_of(t)
        near = lambda q: any(decontaminate.lcs(q, w[k : k + 3 * len(q)]) >= 0.7 * len(q) for k in range(0, max(1, len(w)), len(q)))
        return any(near(q) for q in queries)

    docs = [d for d in docs if not holds(d[1])]
    library, want = Tokenizer.from_file(tokenizer_path()), set()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got} == want and len(got) == len(want)
    assert 150 < len(want) < 300


def test_stages_keep_the_columns(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema == spark.read.parquet(f"{folder}/documents.parquet").schema, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "BPE"]


def test_decisions_are_by_row(spark, tables, tmp_path):
    """One doc_id with several texts: each row is decided on its own. Rows that repeat doc_id and text leave one. Null ids stay."""
    folder, _, items = tables
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    long = " ".join(f"word{k}" for k in range(200))
    rows = [(1, "only here", "en", "a", 9), (1, "Same text", "en", "a", 9), (2, "same text", "en", "a", 9), (3, items[3][1], "en", "a", 9), (3, "clean words", "en", "a", 9), (4, long, "en", "a", 9), (5, long + " more", "en", "a", 9), (5, "other words", "en", "a", 9), (6, "twice", "en", "b", 5), (6, "twice", "en", "a", 5), (None, "same text", "en", "a", 9)]
    docs = spark.createDataFrame(rows, schema)
    texts = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)
    left = corpus_pipeline.exact_dedup(spark, docs, folder)
    assert texts(left) == sorted([r[:2] + r[3:4] for r in rows if r[1] != "Same text" and r[3] != "b"], key=str) and left.schema == schema
    left = corpus_pipeline.simhash_near_dedup(spark, docs, folder)
    assert (5, "other words", "a") in texts(left) and (4, long, "a") in texts(left) and (5, long + " more", "a") not in texts(left)
    left = corpus_pipeline.decontamination(spark, docs, folder)
    assert [r[1] for r in rows if (r[0], r[1], r[3]) not in texts(left)] == [items[3][1]]


def test_decontamination_fits_on_all_passages(spark, tables, monkeypatch):
    """What the stage's latent space is fitted on holds each passage of the documents and of the benchmark."""
    folder, _, _ = tables
    docs, items = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    seen, real = [], decontaminate.fit_latent_space

    def fitted(*args):
        seen.append([x.selectExpr("sum(passages)", "sum(length(f)) / 4").first() for x in args[:2]])
        return real(*args)

    monkeypatch.setattr(decontaminate, "fit_latent_space", fitted)
    corpus_pipeline.decontamination(spark, docs, folder)
    words = [[len(decontaminate.words_of(r["text"])) for r in x.collect()] for x in (docs, items)]
    assert [[tuple(r) for r in x] for x in seen] == [[(sum(len(decontaminate.passage_spans(n)) for n in some if n), sum(some)) for some in words]]


def test_decontamination_holds_little_at_a_time(spark, tmp_path, monkeypatch):
    """Rows of hashed words, and batches of them and of texts, stay small, however many texts a task has; all words are in them."""
    texts = [f"{'alpha beta gamma delta ' * 1500}{k}" for k in range(150)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, real = [], decontaminate.fit_latent_space

    def sizes(df):
        return [r["n"] for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()]

    def fitted(docs, *rest):
        seen.append(([r[0] for r in docs.where("f is not null").selectExpr("length(f)").collect()], sizes(docs.select("f"))))
        return real(docs, *rest)

    monkeypatch.setattr(decontaminate, "fit_latent_space", fitted)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    rows, batches = seen[0]
    assert sum(rows) == 4 * sum(len(t.split()) for t in texts)
    assert max(rows) <= 400_000 and max(batches) <= 3 << 20
    assert max(sizes(docs.select("text"))) <= 3 << 20


def test_empty_documents(spark, tables, tmp_path):
    folder, _, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_drop_ids_by_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")
    assert BROADCAST_IDS > 1000
    for most in (0, 10):
        monkeypatch.setattr("repolens.llm.common.BROADCAST_IDS", most)
        assert sorted(r["text"] for r in drop_ids(docs, ids).collect()) == ["a", "c"]
