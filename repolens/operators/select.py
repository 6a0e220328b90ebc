"""Filters and projections over source files and project summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_PROJECTION = ("namespace", "purpose", "implementation", "databaseIntegration", "internalReferences", "externalReferences", "publicConstants", "publicFunctions")


def of_project(sources: DataFrame, project: str | None) -> DataFrame:
    return sources if project is None else sources.where(F.col("projectName") == project)


def in_values(column: str, values: Iterable[str]) -> Column:
    """No value means no filter."""
    values = list(values)
    return F.col(column).isin(*values) if values else F.lit(True)


def non_empty(items: str) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def database_integrations(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Files whose database integration has a mechanism other than NONE (a missing mechanism counts), by mechanism and namespace."""
    di = F.col("summary.databaseIntegration")
    rows = of_project(sources, project).where(di.isNotNull() & ~F.col("summary.databaseIntegration.mechanism").eqNullSafe("NONE"))
    return rows.select(F.coalesce("summary.namespace", "filepath").alias("path"), F.col("summary.namespace").alias("namespace"), "filepath", "summary.databaseIntegration.*").orderBy(F.asc_nulls_first("mechanism"), F.asc_nulls_first("namespace"))


def stored_objects(sources: DataFrame, project: str | None = None) -> DataFrame:
    """Files with stored procedures or triggers."""
    rows = of_project(sources, project).where(non_empty("summary.storedProcedures") | non_empty("summary.triggers"))
    return rows.select("filepath", F.col("summary.storedProcedures").alias("storedProcedures"), F.col("summary.triggers").alias("triggers"))


def integration_points(sources: DataFrame, project: str | None = None) -> DataFrame:
    """A row per integration point; the point's own fields take precedence over the file's."""
    rows = of_project(sources, project).where(non_empty("summary.integrationPoints"))
    found = rows.select(F.col("summary.namespace").alias("namespace"), "filepath", F.explode("summary.integrationPoints").alias("p"))
    own = found.select("p.*").columns
    return found.select(*(c for c in ("namespace", "filepath") if c not in own), "p.*").orderBy(F.asc_nulls_first("namespace"))


def summaries_of(sources: DataFrame, column: str, values: Iterable[str], project: str | None = None) -> DataFrame:
    """Summaries of files of some extensions or types (none given: all), by namespace; only the nested fields that are named are read."""
    rows = of_project(sources, project).where(in_values(column, values) & F.col("summary").isNotNull())
    there = {f.name for f in sources.schema["summary"].dataType.fields}
    return rows.select("filepath", *(F.col(f"summary.{f}").alias(f) for f in SUMMARY_PROJECTION if f in there)).orderBy(F.asc_nulls_first("namespace"))


def file_paths(sources: DataFrame, project: str | None = None) -> DataFrame:
    return of_project(sources, project).select("filepath")


def fields_of(summaries: DataFrame, project: str, fields: Iterable[str]) -> DataFrame:
    """Some fields of a project's summary: one row or none."""
    fields = list(dict.fromkeys(fields))
    return of_project(summaries, project).select(*fields).limit(1) if fields else summaries.select(F.lit(1)).where("false")


def required_fields(*sections: Iterable[str], core: Iterable[str] = ("projectName", "appDescription", "llmModels")) -> list[str]:
    """Core fields and those of the sections, each once."""
    return list(dict.fromkeys([*core, *(f for s in sections for f in s)]))
