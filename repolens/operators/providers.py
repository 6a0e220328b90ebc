"""Data of report sections: coupling, dependencies, jobs, databases and user interfaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import vocab as V
from .aggregates import zipped
from .select import in_values, of_project


def set_of(c: Column | str) -> Column:
    """Sorted set without nulls and empty texts."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sort_array(F.collect_set(F.when(c != "", c)))


def _references(sources: DataFrame, depth: int, project: str | None) -> DataFrame:
    rows = of_project(sources, project).where(F.coalesce(F.size("summary.internalReferences"), F.lit(0)) > 0)
    rows = rows.select(X.module_of_path(F.col("filepath"), depth).alias("fromModule"), "filepath", F.explode("summary.internalReferences").alias("ref")).where("fromModule is not null")
    return rows.select("fromModule", X.module_of_reference(F.col("ref"), F.col("filepath"), depth).alias("toModule"))


def module_coupling(sources: DataFrame, depth: int = 2, project: str | None = None) -> DataFrame:
    """References between modules, and each pair's level against the most frequent one. Pairs are counted before they are shuffled; the maximum is a one-row aggregate of the counts."""
    pairs = _references(sources, depth, project).where("toModule is not null and toModule <> fromModule").groupBy("fromModule", "toModule").agg(F.count(F.lit(1)).alias("referenceCount"))
    most = pairs.agg(F.max("referenceCount").alias("most"))
    out = pairs.join(F.broadcast(most)).select("fromModule", "toModule", "referenceCount", X.coupling_level(F.col("referenceCount"), F.col("most")).alias("couplingLevel"))
    return out.orderBy(F.desc("referenceCount"), F.collate("fromModule", "UNICODE"), F.collate("toModule", "UNICODE"))


def coupling_stats(sources: DataFrame, depth: int = 2, project: str | None = None) -> DataFrame:
    """Pairs, references, the largest count, and distinct modules (those of files whose references all drop out included)."""
    refs = _references(sources, depth, project)
    pairs = refs.where("toModule is not null and toModule <> fromModule").groupBy("fromModule", "toModule").agg(F.count(F.lit(1)).alias("n"))
    ends = refs.select(F.explode(F.array("fromModule", F.when(F.col("toModule") != F.col("fromModule"), F.col("toModule")))).alias("m")).agg(F.count_distinct("m").alias("totalModules"))
    totals = pairs.agg(F.count(F.lit(1)).alias("totalCouplings"), F.coalesce(F.sum("n"), F.lit(0)).alias("totalReferences"), F.coalesce(F.max("n"), F.lit(0)).alias("highestCouplingCount"))
    return totals.join(F.broadcast(ends))  # two aggregates of one row each


def bill_of_materials(sources: DataFrame, project: str | None = None, types: tuple[str, ...] = V.DEPENDENCY_TYPES) -> DataFrame:
    """Dependencies of build files by group and name; versions, scopes, and files in first-seen order (namespace, path, position); conflicts first."""
    rows = of_project(sources, project).where(in_values("canonicalType", types))
    rows = rows.select("filepath", F.col("summary.namespace").alias("ns"), F.posexplode("summary.dependencies").alias("pos", "d"))
    group = F.when(F.col("d.groupId") != "", F.col("d.groupId"))
    order = F.struct("ns", "filepath", "pos")
    rows = rows.select("filepath", order.alias("ord"), F.coalesce(F.concat(group, F.lit(":"), "d.name"), "d.name").alias("key"), F.col("d.name").alias("name"), group.alias("groupId"), F.col("d.version").alias("version"), F.col("d.scope").alias("scope"))
    # A file's places of one dependency are reduced to the first, so that lists hold distinct files.
    files = rows.groupBy("key", "filepath").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"), F.min_by("groupId", "ord").alias("groupId"), set_of("version").alias("versions"), set_of("scope").alias("scopes"))
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    out = files.groupBy("key").agg(
        F.min_by("name", "ord").alias("name"), F.min_by("groupId", "ord").alias("groupId"), union("versions").alias("versions"), union("scopes").alias("scopes"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "filepath"))), lambda x: x["filepath"]).alias("locations"),
    )
    return out.select("name", "groupId", "versions", (F.size("versions") > 1).alias("hasConflict"), "scopes", "locations").orderBy(F.desc("hasConflict"), F.collate("name", "UNICODE"), "groupId")


def bom_totals(bom: DataFrame) -> DataFrame:
    files = bom.select(F.explode("locations").alias("f")).agg(F.count_distinct("f").alias("buildFiles"))
    return bom.agg(F.count(F.lit(1)).alias("totalDependencies"), F.count_if("hasConflict").alias("conflictCount")).join(F.broadcast(files))


def scheduled_jobs(sources: DataFrame, project: str | None = None, types: tuple[str, ...] = V.JOB_TYPES) -> DataFrame:
    rows = of_project(sources, project).where(in_values("canonicalType", types)).select("filepath", F.explode("summary.scheduledJobs").alias("j"))
    return rows.select("filepath", "j.*", X.trigger_type(F.coalesce("j.trigger", F.lit(""))).alias("triggerType"))


def job_summary(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("totalJobs"), F.sort_array(F.collect_set("triggerType")).alias("triggerTypes"), F.sort_array(F.collect_set("filepath")).alias("jobFiles"))


def stored_object_list(sources: DataFrame, project: str | None = None) -> DataFrame:
    """A row per stored procedure, function and trigger; a complexity that isn't known counts as LOW."""
    rows = of_project(sources, project)
    there = {f.name for f in sources.schema["summary"].dataType["triggers"].dataType.elementType.fields}
    fields = ("name", "complexity", "linesOfCode", *(["objectType"] if "objectType" in there else []))
    of = lambda items, kind: rows.select("filepath", F.explode(zipped(items, *fields)).alias("o")).select("filepath", F.col("o.name").alias("name"), kind.alias("objectType"), F.col("o.complexity").alias("complexity"), F.col("o.linesOfCode").alias("linesOfCode"))
    found = of("summary.storedProcedures", F.coalesce("o.objectType", F.lit("PROCEDURE"))).unionByName(of("summary.triggers", F.lit("TRIGGER")))
    return found.withColumn("complexity", F.when(F.upper("complexity").isin(*V.COMPLEXITIES), F.upper("complexity")).otherwise(V.COMPLEXITIES[0]))


def complexity_tally(objects: DataFrame) -> DataFrame:
    """Totals by kind of object, zeros included; INVALID is in the total alone."""
    kinds = objects.sparkSession.createDataFrame([(k,) for k in (*V.STORED_OBJECTS, "TRIGGER")], "objectType string")
    level = lambda c: F.coalesce(F.count_if(F.col("complexity") == c), F.lit(0)).alias(c.lower())
    counts = objects.groupBy("objectType").agg(F.count(F.lit(1)).alias("total"), *map(level, ("LOW", "MEDIUM", "HIGH")))
    return kinds.join(counts, "objectType", "left").fillna(0)


def mechanism_crosstab(sources: DataFrame, project: str | None = None, operations: tuple[str, ...] = V.OPERATION_TYPES) -> DataFrame:
    """Files by database mechanism (UNKNOWN if none is named), in total and by operation, and distinct tables. A file counts once in the total however many operations it has."""
    di = of_project(sources, project).where("summary.databaseIntegration is not null").select("summary.databaseIntegration.*")
    named = F.coalesce(F.when(F.col("mechanism") != "", F.col("mechanism")), F.lit("UNKNOWN"))
    real = [o for o in operations if o != V.INVALID]
    of = lambda o: F.sum(F.when(F.array_contains("operationType", o), F.size(F.filter("operationType", lambda x: x == o))).otherwise(0)).alias(o)
    counts = di.groupBy(named.alias("mechanism")).agg(F.count(F.lit(1)).alias("total"), *map(of, real))
    tables = di.select(named.alias("mechanism"), F.explode("tablesAccessed").alias("t")).groupBy("mechanism").agg(F.count_distinct("t").alias("tables"))
    return counts.join(tables, "mechanism", "left").fillna(0, ["tables"]).orderBy("mechanism")


def ui_frameworks(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Frameworks by name and version (unknown if none), with the files that configure them; files of any type count."""
    rows = of_project(sources, project).where("summary.uiFramework is not null").select("filepath", F.col("summary.uiFramework.name").alias("name"), F.coalesce("summary.uiFramework.version", F.lit(V.UNKNOWN)).alias("version"))
    return rows.groupBy("name", "version").agg(F.sort_array(F.collect_set("filepath")).alias("configFiles")).orderBy(F.collate("name", "UNICODE"), "version")


def _jsp(sources: DataFrame, project: str | None) -> DataFrame:
    return of_project(sources, project).where("summary.jspMetrics is not null").select("filepath", "summary.jspMetrics.*").withColumn("totalBlocks", reduce(Column.__add__, (F.coalesce(c, F.lit(0)) for c in ("scriptletCount", "expressionCount", "declarationCount"))))


def jsp_metrics(sources: DataFrame, project: str | None = None) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = _jsp(sources, project).agg(
        total("scriptletCount").alias("totalScriptlets"), total("expressionCount").alias("totalExpressions"), total("declarationCount").alias("totalDeclarations"),
        F.count_if(F.col("totalBlocks") > V.HIGH_SCRIPTLETS).alias("filesWithHighScriptletCount"), X.average(F.sum("scriptletCount"), F.count(F.lit(1))).alias("averageScriptletsPerFile"),
    )
    return out.withColumn("insight", X.scriptlet_advice(F.col("totalScriptlets"), F.col("averageScriptletsPerFile")))


def top_scriptlet_files(sources: DataFrame, project: str | None = None, limit: int = V.TOP_FILES) -> DataFrame:
    """The files of the most blocks, ties by path."""
    return _jsp(sources, project).where("totalBlocks > 0").select("filepath", "scriptletCount", "expressionCount", "declarationCount", "totalBlocks", X.debt_level(F.col("totalBlocks")).alias("debtLevel")).orderBy(F.desc("totalBlocks"), "filepath").limit(limit)


def tag_libraries(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Files by tag library; in a file the first prefix of a URI counts."""
    rows = of_project(sources, project).select("filepath", F.posexplode("summary.jspMetrics.customTags").alias("pos", "t"))
    first = rows.groupBy("filepath", F.col("t.uri").alias("uri")).agg(F.min_by("t.prefix", "pos").alias("prefix"))
    return first.groupBy("prefix", "uri").agg(F.count(F.lit(1)).alias("usageCount")).withColumn("tagType", X.tag_library_class(F.col("uri"))).orderBy(F.desc("usageCount"), F.collate("prefix", "UNICODE"), "uri")
