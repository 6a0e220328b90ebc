"""A project's report: sections that turn the two tables into DataFrames, and the run that writes them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import vocab as V
from ..operators import aggregates as A
from ..operators import nested as N
from ..operators import providers as P
from ..operators import select as S
from ..operators import windows as W
from ..sources import sinks


@dataclass(frozen=True)
class Section:
    """Named tables of a report. data takes the sources and the project summaries, both of one project; fields are what it reads of the latter."""

    name: str
    data: Callable[[DataFrame, DataFrame], Mapping[str, DataFrame]]
    fields: Sequence[str] = ()


def overview(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    """Statistics of the project beside its description: two tables of one row."""
    stats = A.file_line_stats(sources)
    return {"app-stats": summaries.select("projectName", "appDescription", "llmModels").limit(1).join(F.broadcast(stats), how="left")}


def file_types(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    stats = A.extension_stats(sources)
    return {"file-types": stats, "file-types-chart": W.pie_slices(stats)}


def code_quality(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    smells = A.code_smells(sources).withColumn("recommendation", X.smell_advice(F.col("smellType")))
    return {"code-quality": A.code_quality(sources), "complex-functions": A.top_complex_functions(sources), "code-smells": smells.limit(V.TOP_SMELLS)}


def architecture_analysis(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    pairs = P.module_coupling(sources)
    return {"module-coupling": pairs.withColumn("cssClass", X.level_class(F.col("couplingLevel"), V.COUPLING_CLASSES)), "module-coupling-stats": P.coupling_stats(sources)}


def dependencies(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    bom = P.bill_of_materials(sources)
    return {"bill-of-materials": bom, "bill-of-materials-stats": P.bom_totals(bom)}


def background_processes(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    jobs = P.scheduled_jobs(sources)
    return {"scheduled-jobs": jobs, "scheduled-jobs-summary": P.job_summary(jobs)}


def databases(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    objects = P.stored_object_list(sources)
    return {"db-interactions": S.database_integrations(sources), "db-interactions-matrix": P.mechanism_crosstab(sources), "procs-and-triggers": objects, "procs-and-triggers-stats": P.complexity_tally(objects), "database-stats": A.database_statistics(sources)}


def integrations(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    return {"integration-points": S.integration_points(sources)}


def user_interfaces(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    return {"ui-frameworks": P.ui_frameworks(sources), "jsp-metrics": P.jsp_metrics(sources), "jsp-top-files": P.top_scriptlet_files(sources), "tag-libraries": P.tag_libraries(sources)}


def domain_model(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    return {"bounded-contexts": N.bounded_contexts(summaries).drop("aggregates"), "aggregates": N.domain_aggregates(summaries).drop("repository", "entities"), "entities": N.domain_entities(summaries), "repositories": N.domain_repositories(summaries)}


def microservices(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    return {"microservices": N.microservices(summaries), "microservices-grid": W.service_grid(N.microservices(summaries).select(F.col("projectName").alias("project"), "pos", "name"))}


def inferred_architecture(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    part = lambda p: N.inferred_architecture(summaries, p)
    edges = part("dependencies").select(F.col("from").alias("source"), F.col("to").alias("target"))
    return {"internal-components": part("internalComponents"), "external-dependencies": part("externalDependencies"), "architecture-edges": W.architecture_edges(edges, part("internalComponents"), part("externalDependencies"))}


def business_processes(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    activities = N.business_activities(summaries)
    return {"business-activities": activities, "business-activity-edges": W.activity_edges(activities.select("process", "pos", "activity"))}


def categories(sources: DataFrame, summaries: DataFrame) -> Mapping[str, DataFrame]:
    return {"categories": N.categories(summaries)}


SECTIONS = (
    Section("overview", overview),
    Section("file-types", file_types),
    Section("code-quality", code_quality),
    Section("architecture-analysis", architecture_analysis),
    Section("dependencies", dependencies),
    Section("background-processes", background_processes),
    Section("database", databases),
    Section("integration-points", integrations),
    Section("ui-analysis", user_interfaces),
    Section("domain-model", domain_model, ("boundedContexts",)),
    Section("microservices", microservices, ("potentialMicroservices",)),
    Section("inferred-architecture", inferred_architecture, ("inferredArchitecture",)),
    Section("business-processes", business_processes, ("businessProcesses",)),
    Section("categories", categories, ("technologies", "businessProcesses", "boundedContexts", "potentialMicroservices", "inferredArchitecture")),
)


class NoSummary(ValueError):
    """The project has no summary yet: it has to be captured and summarised first."""


def report(sources: DataFrame, summaries: DataFrame, project: str, sections: Sequence[Section] = SECTIONS) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables of all sections, and errors of sections whose plan fails. Only the fields that sections ask for are read."""
    fields = S.required_fields(*(s.fields for s in sections))
    own = S.fields_of(summaries, project, [f for f in fields if f in summaries.columns])
    if own.isEmpty():
        raise NoSummary(project)
    files, out, failed = S.of_project(sources, project), {}, {}
    for section in sections:
        try:
            out |= section.data(files, own)
        except Exception as e:  # noqa: BLE001  sections fail on their own
            failed[section.name] = str(e)
    return out, failed


def write_report(sources: DataFrame, summaries: DataFrame, project: str, folder: str, sections: Sequence[Section] = SECTIONS) -> dict[str, str]:
    """A JSON file per table and one HTML page; what failed, by name."""
    tables, failed = report(sources, summaries, project, sections)
    failed |= sinks.write_json(tables, folder)
    sinks.write_html({n: t for n, t in tables.items() if n not in failed}, f"{folder}/report.html", project)
    return failed


def filtered(table: DataFrame, where: Mapping[str, object], order: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    """What a click on a cell and on column heads shows: rows with these values, in this order (column, descending)."""
    condition: Column = F.lit(True)
    for column, value in where.items():
        is_array = dict(table.dtypes)[column].startswith("array")
        condition = condition & (F.array_contains(column, value) if is_array else F.col(column).eqNullSafe(F.lit(value)))
    rows = table.where(condition)
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)) if order else rows
