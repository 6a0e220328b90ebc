"""What the plans of the queries must and must not hold."""

import os
import re

import pytest

from repolens import schemas
from repolens.operators import aggregates, providers, select
from repolens.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries over texts that are broken, at least in part: the JVM tells which, and only those are repaired in Python.
BROKEN_TEXTS = {"json_fast_path", "json_repair", "json_forms", "response_gate", "restored_names", "coerced_answers"}
#: Queries that read files themselves.
FILES = {"source_tree"}
#: Queries that call models.
CALLS = {"resumed_calls", "model_outcomes", "map_reduced"}
#: Queries whose vectors are multiplied as matrices.
MATRICES = {"vector_search_many", "vector_index_recall"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - BROKEN_TEXTS - FILES - CALLS - MATRICES))
def test_queries_stay_in_the_jvm(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|CartesianProduct|Scan ExistingRDD.*Python", text)


def test_many_vectors_are_not_joined_in_loops(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    text = plan(QUERIES["vector_search_many"](spark, SF))
    assert "MapInArrow" in text and not re.search("NestedLoop|CartesianProduct", text)


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sources"))
    spark.createDataFrame([{"projectName": "p", "filepath": "f", "isCode": True, "linesCount": 1, "summary": {"publicFunctions": [{"name": "f", "cyclomaticComplexity": 1.0}]}}], schemas.SOURCES).write.partitionBy("projectName").mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_scans_read_what_they_need(sources):
    text = plan(aggregates.file_line_stats(sources, "p"))
    assert "PartitionFilters: [isnotnull(projectName" in text and re.search(r"PushedFilters: \[.*EqualTo\(isCode,true\)", text)
    assert re.search(r"ReadSchema: struct<linesCount:bigint,isCode:boolean>", text)
    text = plan(aggregates.code_quality(sources, "p"))
    read = re.search(r"ReadSchema: (\S+)", text)[1]
    assert "cyclomaticComplexity" in read and "linesOfCode" in read and "codeSmells" not in read and "content" not in read
    assert "summary.dependencies" not in plan(select.database_integrations(sources, "p"))


def test_limits_are_local(sources):
    assert "TakeOrderedAndProject" in plan(aggregates.top_complex_functions(sources, "p"))
    assert "TakeOrderedAndProject" in plan(providers.top_scriptlet_files(sources, "p"))


def test_groups_are_reduced_before_the_shuffle(sources):
    for df in (aggregates.extension_stats(sources), providers.ui_frameworks(sources), aggregates.project_stats(sources)):
        assert "partial_" in plan(df)
