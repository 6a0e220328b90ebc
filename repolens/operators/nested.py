"""Flattening of a project's nested summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..schemas import CATEGORIES
from .windows import first_seen


def bounded_contexts(summaries: DataFrame) -> DataFrame:
    return summaries.select("projectName", F.posexplode("boundedContexts").alias("ctx", "c")).select("projectName", "ctx", F.col("c.name").alias("context"), F.col("c.description").alias("description"), F.col("c.aggregates").alias("aggregates"))


def domain_aggregates(summaries: DataFrame) -> DataFrame:
    """A row per aggregate: its context, repository and entities. A context without aggregates gives none."""
    rows = bounded_contexts(summaries).select("projectName", "ctx", "context", F.posexplode("aggregates").alias("pos", "a"))
    return rows.select("projectName", "ctx", "context", "pos", F.col("a.name").alias("aggregate"), F.col("a.description").alias("description"), F.col("a.repository").alias("repository"), F.col("a.entities").alias("entities"))


def domain_entities(summaries: DataFrame, within_context: bool = False) -> DataFrame:
    """Entities, the first of each name of a project (or of a context), in page order."""
    rows = domain_aggregates(summaries).select("projectName", "ctx", "context", "pos", "aggregate", F.posexplode("entities").alias("epos", "e"))
    rows = rows.select("projectName", "ctx", "context", "pos", "epos", "aggregate", F.col("e.name").alias("entity"), F.col("e.description").alias("description"))
    return first_seen(rows, "entity", ["ctx", "pos", "epos"], ["projectName", *(["ctx"] if within_context else [])])


def domain_repositories(summaries: DataFrame) -> DataFrame:
    """Repositories of all contexts, the first of each name of a context."""
    rows = domain_aggregates(summaries).where("repository is not null").select("projectName", "ctx", "context", "pos", "aggregate", "repository.*")
    return first_seen(rows, "name", ["ctx", "pos"], ["projectName", "ctx"])


def inferred_architecture(summaries: DataFrame, part: str) -> DataFrame:
    """Rows of internalComponents, externalDependencies or dependencies of the first architecture; those without a name (or end) drop out."""
    first = F.try_element_at("inferredArchitecture", F.lit(1))
    rows = summaries.select("projectName", F.posexplode(first[part]).alias("pos", "x")).select("projectName", "pos", "x.*")
    return rows.where("`from` is not null and `to` is not null" if part == "dependencies" else "name is not null")


def microservices(summaries: DataFrame) -> DataFrame:
    """Services with their entities (attributes default to none), endpoints and operations."""
    rows = summaries.select("projectName", F.posexplode("potentialMicroservices").alias("pos", "s")).select("projectName", "pos", "s.*")
    entities = F.transform(F.coalesce("entities", F.array().cast(dict(rows.dtypes)["entities"])), lambda e: F.struct(e["name"].alias("name"), e["description"].alias("description"), F.coalesce(e["attributes"], F.array().cast("array<string>")).alias("attributes")))
    return rows.withColumn("entities", entities)


def business_activities(summaries: DataFrame) -> DataFrame:
    """A row per activity of each business process, in order."""
    rows = summaries.select("projectName", F.posexplode("businessProcesses").alias("ppos", "p"))
    return rows.select("projectName", "ppos", F.col("p.name").alias("process"), F.posexplode("p.keyBusinessActivities").alias("pos", "a")).select("projectName", "ppos", "process", "pos", "a.*")


def guarded(data: Column, ddl: str) -> Column:
    """Items of a category stored as JSON; what isn't such a list is an empty one."""
    return F.coalesce(F.from_json(data, ddl), F.array().cast(ddl))


def categories(summaries: DataFrame) -> DataFrame:
    """A row per category in fixed order, with its data as JSON; what is missing or no list is an empty one, and still there."""
    there = set(summaries.columns)
    data = lambda c: F.coalesce(F.to_json(c), F.lit("[]")) if c in there else F.lit("[]")
    items = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(c).alias("category"), X.title_case(F.lit(c)).alias("label"), data(c).alias("data")) for k, c in enumerate(CATEGORIES)))
    return summaries.select("projectName", F.inline(items))
