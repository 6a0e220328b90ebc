import json
import os

import pytest
from pyspark.sql import functions as F

from repolens import schemas
from repolens.operators import aggregates, batching, completion, graphs, nested, providers, retrieval, select
from repolens.operators.completion import Candidate, Response
from repolens.sources import ingest, sinks, store
from repolens.streaming import incremental


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    write(tmp_path, {"src/A.java": "class A {}\n", "src/b.min.js": "x", "node_modules/x/y.js": "x", "README.md": "# r", "src/test-x.py": "x", ".hidden/a.py": "x", "src/.env": "x", "img/a.png": "x", "src/g.go": "// Code generated by y\n", "src/e.py": " \n", "src/long.py": "a\n" * 50})
    return tmp_path


def test_ingest(spark, tree, tmp_path):
    rows = ingest.ingest(spark, str(tree), "p")
    got = {(r["filepath"], r["canonicalType"], r["isCode"], r["linesCount"]) for r in rows.collect()}
    assert got == {("src/A.java", "java", True, 1), ("README.md", "markdown", False, 1), ("src/long.py", "python", True, 50)}
    known = spark.createDataFrame([("p", "README.md"), ("q", "src/A.java")], "projectName string, filepath string")
    assert ingest.ingest(spark, [str(tree)], "p", known).count() == 2
    sizes = [r["size"] for r in ingest.largest_first(ingest.scan(spark, [str(tree / "src"), str(tree / "img")])).select("size").collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_prompts_and_questions(spark, tmp_path):
    write(tmp_path, {"p/requirement1.prompt": " do \n", "p/Requirement22.PROMPT": "x", "p/other.txt": "y", "q.txt": "one?\n\n # no\n#no\n  two? \n"})
    assert [r["prompt"] for r in ingest.read_prompts(spark, str(tmp_path / "p")).collect()] == ["x", "do"]
    assert {r["question"] for r in ingest.read_questions(spark, str(tmp_path / "q.txt")).collect()} == {"one?", "two?"}


def test_store(spark, tree, tmp_path):
    at, bad = str(tmp_path / "output/t"), str(tmp_path / "output/bad")  # in a folder that scans ignore
    store.create(spark, at)
    rows = ingest.ingest(spark, str(tree), "p")
    store.insert(rows.unionByName(rows.withColumn("projectName", F.lit("q"))).unionByName(rows.limit(1).withColumn("canonicalType", F.lit("odd"))), at, bad)
    table = store.read(spark, at, schemas.SOURCES)
    assert table.count() == 6 and spark.read.parquet(bad).count() == 1
    store.delete_project(spark, "p", at)
    assert {r[0] for r in store.read(spark, at, schemas.SOURCES).select("projectName").distinct().collect()} == {"q"}


def test_stream(spark, tree, tmp_path):
    at, check = str(tmp_path / "s"), str(tmp_path / "c")
    for extra in ("", "more.py"):
        if extra:
            write(tree, {"src/more.py": "z"})
        rows = incremental.source_rows(incremental.file_stream(spark, str(tree / "src")), str(tree / "src"), "p")
        incremental.start(rows, at, check, once=True).awaitTermination(120)
    got = sorted(r["filepath"] for r in spark.read.parquet(at).collect())
    assert got == ["A.java", "long.py", "more.py", "test-x.py"]


def sources(spark, rows):
    return spark.createDataFrame([spark_row(r) for r in rows], schemas.SOURCES)


def spark_row(r):
    return {"projectName": "p", "filename": "f", "fileExtension": "ts", "isCode": True, "linesCount": 1} | r


def test_empty_inputs(spark):
    none = schemas.empty(spark, schemas.SOURCES)
    assert aggregates.file_line_stats(none).first().asDict() == {"fileCount": 0, "linesOfCode": 0}
    assert set(aggregates.code_quality(none).first()) == {0, 0.0}
    assert set(aggregates.database_statistics(none).first()) == {0}
    assert aggregates.code_smells(none).count() == 0 and providers.module_coupling(none).count() == 0
    assert tuple(providers.jsp_metrics(none).first())[:5] == (0, 0, 0, 0, 0.0)
    assert providers.complexity_tally(providers.stored_object_list(none)).agg(F.sum("total")).first()[0] == 0
    assert tuple(providers.coupling_stats(none).first()) == (0, 0, 0, 0)


def test_extension_stats(spark):
    rows = sources(spark, [{"linesCount": 100}, {"linesCount": 150}, {"fileExtension": "java", "linesCount": 200}, {"fileExtension": "py", "linesCount": 75}, {"isCode": False, "linesCount": 9}])
    assert [tuple(r) for r in aggregates.extension_stats(rows, "p").collect()] == [("ts", 2, 250), ("java", 1, 200), ("py", 1, 75)]


def test_smells_at_both_levels(spark):
    f = lambda *s: {"name": "f", "codeSmells": list(s)}
    rows = sources(spark, [{"filepath": "a", "summary": {"publicFunctions": [f("GOD CLASS"), f("GOD CLASS", "X"), {"name": "g"}], "codeQualityMetrics": {"fileSmells": ["GOD CLASS"]}}}, {"filepath": "b", "summary": None}])
    assert {tuple(r) for r in aggregates.code_smells(rows).collect()} == {("GOD CLASS", 2, 1), ("X", 1, 1)}


def test_missing_mechanism_is_not_none(spark):
    rows = sources(spark, [{"filepath": p, "summary": {"databaseIntegration": {"mechanism": m}}} for p, m in (("a", "JPA"), ("b", None), ("c", "NONE"))] + [{"filepath": "d", "summary": {}}])
    assert sorted(r["filepath"] for r in select.database_integrations(rows).collect()) == ["a", "b"]


def test_bill_of_materials(spark):
    d = lambda n, g=None, v=None, s=None: {"name": n, "groupId": g, "version": v, "scope": s}
    rows = sources(spark, [{"filepath": "b/pom.xml", "canonicalType": "maven", "summary": {"namespace": "b", "dependencies": [d("x", "g", "1"), d("x", "g", "2", "test"), d("y", "", "")]}}, {"filepath": "a/pom.xml", "canonicalType": "maven", "summary": {"namespace": "a", "dependencies": [d("x", "g", "1")]}}, {"filepath": "c", "canonicalType": "java", "summary": {"dependencies": [d("z")]}}])
    got = [r.asDict() for r in providers.bill_of_materials(rows).collect()]
    assert got == [{"name": "x", "groupId": "g", "versions": ["1", "2"], "hasConflict": True, "scopes": ["test"], "locations": ["a/pom.xml", "b/pom.xml"]}, {"name": "y", "groupId": None, "versions": [], "hasConflict": False, "scopes": [], "locations": ["b/pom.xml"]}]


def test_batches(spark):
    items = spark.createDataFrame([("g", k, "x" * 70) for k in range(8)] + [("h", 0, "y" * 400), ("h", 1, "z" * 10)], "g string, k int, t string")
    got = batching.token_batches(items, "g", ["k"], "t", 100, 0.7, 4.0).collect()
    by = {}
    for r in got:
        by.setdefault((r["g"], r["batch"]), []).append(r["text"])
    assert {k: len(v) for k, v in by.items()} == {("g", 0): 4, ("g", 1): 4, ("h", 0): 1, ("h", 1): 1} and len(by["h", 0][0]) == 280
    parts = spark.createDataFrame([("g", 1, {"a": ["x"], "b": None}), ("g", 2, None), ("g", 3, {"a": ["x", "y"], "b": ["q"]})], "g string, o int, c struct<a:array<string>,b:array<string>>")
    assert batching.combine_objects(parts, "g", "o", "c").first()["c"].asDict() == {"a": ["x", "x", "y"], "b": ["q"]}


CHAIN = [Candidate("one"), Candidate("two", 100)]


def answers(*responses):
    left = list(responses)
    return lambda prompt, name: left.pop(0)


@pytest.mark.parametrize(
    "responses,text,events",
    [
        ([Response("COMPLETED", "a")], "a", ["SUCCESS"]),
        ([Response("OVERLOADED"), Response("INVALID"), Response("COMPLETED", "a")], "a", ["OVERLOAD_RETRY", "HOPEFUL_RETRY", "SUCCESS"]),
        ([Response("OVERLOADED")] * 3 + [Response("COMPLETED", "b")], "b", ["OVERLOAD_RETRY"] * 3 + ["SWITCH", "SUCCESS"]),
        ([Response("ERRORED")], None, ["FAILURE"]),
        ([Response("EXCEEDED"), Response("EXCEEDED", None, 200, 10, 100), Response("COMPLETED", "c")], "c", ["SWITCH", "CROP", "SUCCESS"]),
        ([Response("EXCEEDED"), Response("EXCEEDED")], None, ["SWITCH", "CROP", "FAILURE"]),
    ],
)
def test_fallback(responses, text, events):
    out = completion.complete(answers(*responses), "p" * 100, CHAIN, sleep=lambda s: None)
    assert (out.text, out.events) == (text, events)


def test_candidates_and_crop():
    assert completion.candidates(CHAIN, 1) == CHAIN[1:]
    with pytest.raises(ValueError):
        completion.candidates(CHAIN, 2)
    assert len(completion.crop("x" * 100, Response("EXCEEDED", None, 10, 98, 1000), 100)) == 75
    assert len(completion.crop("x" * 100, Response("EXCEEDED", None, 199, 0, 100), 0)) == 50


def test_map_reduce(spark):
    def model(prompt, name):
        return Response("COMPLETED", None if "bad" in prompt else f"<{prompt.count('item')}>")

    rows = [("a", 0, 0, "item"), ("b", 0, 0, "item"), ("b", 0, 1, "item"), ("b", 1, 0, "item"), ("c", 0, 0, "bad"), ("c", 1, 0, "bad")]
    got = completion.map_reduce(spark.createDataFrame(rows, "g string, batch int, item int, text string"), "g", model, CHAIN, "do")
    assert {(r["g"], r["answer"], r["strategy"]) for r in got.collect()} == {("a", "<1>", "single-pass"), ("b", "<0>", "map-reduce"), ("c", None, "map-reduce")}


def test_retrieval(spark):
    rows = spark.createDataFrame([("p", f"f{k}", "ts", f"c{k}", [float(k), 0.0]) for k in range(9)] + [("p", "short", "ts", "c", [1.0]), ("q", "q", "ts", "c", [0.0, 0.0])], "projectName string, filepath string, fileExtension string, content string, contentVector array<float>")
    assert [r["filepath"] for r in retrieval.nearest(select.of_project(rows, "p"), [2.2, 0], k=3).collect()] == ["f2", "f3", "f1"]
    said = retrieval.answer(rows, "why?", lambda q: [0.0, 0.0], lambda p: str(p.count("```ts")), "p", 2)
    assert said == "2\n\nReferences:\n * f0\n * f1"
    assert retrieval.answer(rows, "why?", lambda q: None, lambda p: "x") == retrieval.NO_ANSWER


def test_graphs(spark):
    nodes = spark.createDataFrame([("g", 0, "a", "A [x]", "rectangle", None), ("g", 1, "b", "B", "circle", "fill:red"), ("g", 2, "a", "A", "rectangle", None)], "graph string, pos int, id string, label string, shape string, style string")
    edges = spark.createDataFrame([("g", 0, "a", "b", "dotted"), ("g", 1, "a", "z", "solid")], "graph string, pos int, source string, target string, kind string")
    assert graphs.repeated_nodes(nodes).first()["id"] == "a"
    assert graphs.dangling_edges(nodes, edges).first()["target"] == "z"
    assert graphs.mermaid(nodes.where("pos < 2"), edges.where("pos = 0")).first()["chart"] == 'flowchart TB\n    a["A #91;x#93;"]\n    b(("B"))\n    a -.-> b\n    style b fill:red'


def test_nested_summaries(spark):
    e = lambda n: {"name": n, "description": n}
    row = {"projectName": "p", "businessProcesses": [{"name": "b", "keyBusinessActivities": [{"activity": "x"}, {"activity": "y"}]}], "boundedContexts": [{"name": "c", "aggregates": [{"name": "a", "repository": e("r"), "entities": [e("e"), e("e")]}]}, {"name": "d", "aggregates": None}], "potentialMicroservices": [{"name": "m", "entities": [{"name": "e", "attributes": None}]}], "inferredArchitecture": [{"internalComponents": [e("i"), {"name": None}], "dependencies": [{"from": "i", "to": "x"}, {"from": "i"}]}]}
    s = spark.createDataFrame([row], schemas.APP_SUMMARIES)
    assert nested.domain_entities(s).count() == 1 and nested.domain_aggregates(s).count() == 1
    assert nested.microservices(s).first()["entities"][0]["attributes"] == []
    assert nested.inferred_architecture(s, "internalComponents").count() == nested.inferred_architecture(s, "dependencies").count() == 1
    assert [r["activity"] for r in nested.business_activities(s).orderBy("pos").collect()] == ["x", "y"]
    got = nested.categories(s).collect()
    assert [r["category"] for r in got] == list(schemas.CATEGORIES) and got[0]["data"] == "[]" and got[0]["label"] == "Technologies"
    assert select.fields_of(s, "p", []).count() == 0 and select.fields_of(s, "p", ["appDescription", "appDescription"]).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], None)], "a int, b array<string>, c string")
    bad = df.select(F.raise_error(F.lit("x")))
    assert list(sinks.write_json({"one": df, "two": bad}, str(tmp_path))) == ["two"]
    assert json.load(open(tmp_path / "one.json")) == [{"a": 1, "b": ["a"]}]
    sinks.write_html({"one": df}, str(tmp_path / "r.html"))
    assert "<td>1<td>[&quot;a&quot;]<td>" in (tmp_path / "r.html").read_text()
    sinks.write_texts(spark.createDataFrame([("n", "t")], "name string, text string"), str(tmp_path / "x"))
    assert os.path.isdir(tmp_path / "x" / "name=n")
    assert sinks.padded_table([{"a": 1, "b": "xx"}], ["a", "b"], {"a": 1}).splitlines() == ["a  b", "-  --", "1  xx", "-  --", "1"]
    models = sinks.model_catalogue(spark, [{"family": "z", "completions": [{"key": "k"}]}, {"family": "a", "embeddings": [{"key": "e"}]}])
    assert [r["family"] for r in models.collect()] == ["a", "z"]
    assert schemas.summary_type(spark, "sql").fieldNames()[2] == "tables"
