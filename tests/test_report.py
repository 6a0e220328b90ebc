import json
import os

import pytest

from repolens import schemas
from repolens.plans import report
from repolens.plans.report import Section


@pytest.fixture(scope="module")
def tables(spark):
    function = {"name": "f", "cyclomaticComplexity": 12.0, "linesOfCode": 60.0, "codeSmells": ["LONG METHOD"]}
    files = [
        {"projectName": "p", "filename": "a.ts", "filepath": "src/a/a.ts", "fileExtension": "ts", "canonicalType": "javascript", "linesCount": 10, "isCode": True, "summary": {"namespace": "a", "publicFunctions": [function], "internalReferences": ["src/b/x.ts"], "databaseIntegration": {"mechanism": "MQL", "operationType": ["READ"], "tablesAccessed": ["t"]}}},
        {"projectName": "p", "filename": "pom.xml", "filepath": "pom.xml", "fileExtension": "xml", "canonicalType": "maven", "linesCount": 5, "isCode": True, "summary": {"dependencies": [{"name": "d", "groupId": "g", "version": "1"}]}},
        {"projectName": "q", "filename": "z.ts", "filepath": "z.ts", "fileExtension": "ts", "isCode": True, "linesCount": 99},
    ]
    summary = {"projectName": "p", "appDescription": "An app", "technologies": [{"name": "x"}], "boundedContexts": [{"name": "c", "aggregates": [{"name": "a", "repository": {"name": "r"}, "entities": [{"name": "e"}]}]}]}
    return spark.createDataFrame(files, schemas.SOURCES), spark.createDataFrame([summary], schemas.APP_SUMMARIES)


def test_report(spark, tables, tmp_path):
    assert report.write_report(*tables, "p", str(tmp_path)) == {}
    read = lambda n: json.load(open(tmp_path / f"{n}.json"))
    assert read("app-stats")[0]["linesOfCode"] == 15 and read("app-stats")[0]["appDescription"] == "An app"
    assert read("code-smells") == [{"smellType": "LONG METHOD", "occurrences": 1, "affectedFiles": 1, "recommendation": "Refactor into smaller, single-purpose methods"}]
    assert read("module-coupling")[0]["toModule"] == "src/b" and read("entities")[0]["entity"] == "e"
    assert [r["category"] for r in read("categories")][0] == "technologies"
    assert os.path.getsize(tmp_path / "report.html") > 1000 and len(os.listdir(tmp_path)) > 25


def test_report_without_summary(tables):
    with pytest.raises(report.NoSummary):
        report.report(*tables, "q")


def test_failing_sections_leave_the_others(tables):
    def broken(sources, summaries):
        raise RuntimeError("no")

    out, failed = report.report(*tables, "p", [Section("bad", broken), report.SECTIONS[1]])
    assert failed == {"bad": "no"} and "file-types" in out


def test_filtered(spark):
    t = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["x"], 2), (None, None, 3)], "m string, o array<string>, n int")
    assert [r["n"] for r in report.filtered(t, {"o": "x"}, [("n", True)]).collect()] == [2, 1]
    assert [r["n"] for r in report.filtered(t, {"m": None}).collect()] == [3]
