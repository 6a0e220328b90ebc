"""Operators over ordered rows. Windows are partitioned by their group; the two that run over a whole table (pie slices, levels) only ever see aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import vocab as V

RADIUS, CENTRE = 130.0, 150.0


def pie_slices(stats: DataFrame, label: str = "fileExtension", value: str = "files", threshold: float = 3.0) -> DataFrame:
    """Share and angles of each row of extension_stats, from twelve o'clock, largest first."""
    order = Window.orderBy(F.desc(value), F.desc("lines"), label)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, run = F.sum(value).over(whole), F.sum(value).over(upto)
    share = lambda c: F.when(total > 0, c / total).otherwise(0.0)
    out = stats.select(
        F.when(F.coalesce(F.col(label), F.lit("")) == "", V.UNKNOWN).otherwise(F.col(label)).alias("label"), F.col(value).alias("value"), (share(F.col(value)) * 100).alias("percentage"),
        (share(run - F.col(value)) * (2 * math.pi) - math.pi / 2).alias("startAngle"), (share(run) * (2 * math.pi) - math.pi / 2).alias("endAngle"), (F.row_number().over(order) - 1).alias("index"),
    )
    return out.select("*", (F.col("percentage") >= threshold).alias("showLabel"), X.slice_colour(F.col("index")).alias("color"), X.slice_path(F.col("startAngle"), F.col("endAngle"), RADIUS, CENTRE, CENTRE).alias("pathData"))


def first_seen(rows: DataFrame, name: str, order: list[Column | str], within: list[str] | None = None) -> DataFrame:
    """The first row of each name (in each group), by an explicit order. The other columns go through a minimum with their order, which is combined before the shuffle."""
    keys = [*(within or []), name]
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return out.select(*keys, "r.*").select(*rows.columns)


def activity_edges(processes: DataFrame) -> DataFrame:
    """Edges between consecutive activities: (process, pos, activity) -> process, pos, source, target."""
    w = Window.partitionBy("process").orderBy("pos")
    return processes.select("process", "pos", F.col("activity").alias("source"), F.lead("activity").over(w).alias("target")).where("target is not null")


def service_grid(services: DataFrame, per_row: int = 3, group: str = "project", order: str = "pos", name: str = "name") -> DataFrame:
    """Row and column of each service of a group, and hidden edges to the right and down."""
    w = Window.partitionBy(group).orderBy(order)
    at = F.row_number().over(w) - 1
    placed = services.select(group, F.col(name).alias("name"), at.alias("index"), F.floor(at / per_row).cast("int").alias("row"), (at % per_row).alias("col"))
    placed = placed.withColumn("node", X.mermaid_node(F.col("name"), F.col("index")))
    w = Window.partitionBy(group).orderBy("index")
    right = F.when(F.lead("row").over(w) == F.col("row"), F.lead("node").over(w))
    down = F.when(F.col("col") == 0, F.lead("node", per_row).over(w))
    return placed.select("*", right.alias("rightNode"), down.alias("downNode"))


def architecture_edges(edges: DataFrame, internal: DataFrame, external: DataFrame) -> DataFrame:
    """Edges (source, target) both of whose ends are nodes; of nodes of one name the last counts, externals after internals. internal, external: name, pos."""
    node = lambda df, kind, prefix: df.select("name", "pos", F.lit(kind).alias("kind"), X.mermaid_node(F.concat(F.lit(prefix), "name"), F.col("pos")).alias("node"))
    nodes = node(internal, 0, "int_").unionByName(node(external, 1, "ext_")).groupBy("name").agg(F.max_by("node", F.struct("kind", "pos")).alias("node"))
    ends = lambda c: nodes.select(F.col("name").alias(c), F.col("node").alias(f"{c}Node"))
    return edges.join(ends("source"), "source").join(ends("target"), "target").select("source", "target", "sourceNode", "targetNode")


def entity_aggregates(entities: DataFrame, aggregates: DataFrame) -> DataFrame:
    """The first aggregate of an entity's context that names it, else the context's first. entities: context, entity; aggregates: context, pos, aggregate, entities (names)."""
    named = aggregates.select("context", "pos", "aggregate", F.explode("entities").alias("entity")).groupBy("context", "entity").agg(F.min_by("aggregate", "pos").alias("named"))
    firsts = aggregates.groupBy("context").agg(F.min_by("aggregate", "pos").alias("firstAggregate"))
    out = entities.join(named, ["context", "entity"], "left").join(firsts, "context", "left")
    return out.select("context", "entity", F.coalesce("named", "firstAggregate").alias("aggregate"), F.col("named").isNotNull().alias("isNamed"))
