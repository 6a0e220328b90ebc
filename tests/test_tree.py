"""The scan of source trees: what it enters, what it finds, and how it deals files to tasks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from repolens.sources import ingest, tree


@pytest.fixture()
def root(tmp_path):
    files = {"a.py": 10, "src/b.java": 2000, "src/.hidden/c.py": 1, "src/test-d.py": 1, "src/build/e.py": 1, "node_modules/x/y/z/f.js": 1, ".git/objects/g": 1, "deep/er/and/deeper/h.ts": 300, "deep/node_modules/i.ts": 1, "package-lock.json": 1, ".npmrc": 1, "builder/j.c": 7, "src/empty.py": 0}
    for name, size in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    return str(tmp_path)


KEPT = {"a.py": 10, "src/b.java": 2000, "deep/er/and/deeper/h.ts": 300, "builder/j.c": 7, "src/empty.py": 0}


def test_ignored_folders_are_not_entered(root, monkeypatch):
    seen, plain = [], tree.listed
    monkeypatch.setattr(tree, "listed", lambda store, folder: seen.append(os.path.relpath(folder, root)) or plain(store, folder))
    parts = tree.TreeReader([root], tree.PARTITION_BYTES).partitions()
    assert {f[2]: f[3] for p in parts for f in p.files} == KEPT
    assert sorted(seen) == [".", "builder", "deep", "deep/er", "deep/er/and", "deep/er/and/deeper", "src"]


def test_bytes_are_dealt_evenly():
    rng = random.Random(1)
    files = [("r", f"r/{i}", str(i), int(rng.paretovariate(1.1) * 10_000)) for i in range(5000)]
    parts = tree.dealt(files, 8 << 20)
    loads = [sum(f[3] + tree.OPEN_BYTES for f in p.files) for p in parts]
    assert sorted(f for p in parts for f in p.files) == sorted(files)
    largest = max(f[3] for f in files) + tree.OPEN_BYTES
    assert len(parts) > 10 and max(loads) <= max(largest, 1.05 * sum(loads) / len(loads))
    assert tree.dealt([]) == [] and len(tree.dealt(files[:3])) == 1


def test_scan(spark, root):
    rows = ingest.scan(spark, [root, f"{root}/src"]).collect()
    assert {(r["sourceRoot"], r["filepath"]): (r["size"], r["filename"], len(r["content"])) for r in rows} == {(at, name): (n, name.rpartition("/")[2], n) for at, files in ((root, KEPT), (f"{root}/src", {"b.java": 2000, "empty.py": 0})) for name, n in files.items()}
    assert ingest.scan(spark, f"file://{root}", content=False).columns == ["sourceRoot", "path", "filepath", "filename", "size"]
    with pytest.raises(Exception, match="none"):
        ingest.scan(spark, f"{root}/none").count()
    os.makedirs(f"{root}/void/bin")
    assert ingest.scan(spark, f"{root}/void").count() == 0


def test_contents_come_in_bounded_batches(spark, root, monkeypatch):
    for i in range(30):
        with open(f"{root}/src/big{i}.py", "wb") as f:
            f.write(b"y" * 1000)
    files = tree.read_tree(spark, [root], partition_bytes=1 << 18)
    assert files.rdd.getNumPartitions() > 3
    got = tree.read_contents(files.where("size = 1000")).select("filename", F.length("content").alias("n")).collect()
    assert len(got) == 30 and {r["n"] for r in got} == {1000}
