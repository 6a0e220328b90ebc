"""Flowcharts from tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..scratch import Scratch

#: Opening and closing marks of node shapes, and arrows.
SHAPES = {"rectangle": ('["', '"]'), "rounded": ('("', '")'), "stadium": ('(["', '"])'), "circle": ('(("', '"))'), "hexagon": ('{{"', '"}}'), "rhombus": ('{"', '"}')}
ARROWS = {"solid": "-->", "dotted": "-.->", "invisible": "~~~"}


def repeated_nodes(nodes: DataFrame) -> DataFrame:
    """Node ids that occur more than once in a graph (graph, id)."""
    return nodes.groupBy("graph", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (graph, source, target) one of whose ends isn't a node."""
    known = nodes.select("graph", "id").distinct()
    lost = lambda end: edges.join(known.withColumnRenamed("id", end), ["graph", end], "left_anti").select(*edges.columns)
    return lost("source").unionByName(lost("target")).distinct()


def mermaid(nodes: DataFrame, edges: DataFrame, direction: str = "TB") -> DataFrame:
    """One text per graph. nodes: graph, pos, id, label, shape, and optionally style; edges: graph, pos, source, target, kind."""
    mark = lambda k: F.try_element_at(X.literal_map((s, m[k]) for s, m in SHAPES.items()), F.col("shape"))
    line = F.concat(F.lit("    "), "id", mark(0), X.mermaid_label(F.col("label")), mark(1))
    arrow = F.try_element_at(X.literal_map(ARROWS.items()), F.col("kind"))
    rows = nodes.select("graph", F.lit(0).alias("part"), "pos", line.alias("line"))
    rows = rows.unionByName(edges.select("graph", F.lit(1).alias("part"), "pos", F.concat(F.lit("    "), "source", F.lit(" "), arrow, F.lit(" "), "target").alias("line")))
    if "style" in nodes.columns:
        rows = rows.unionByName(nodes.where("style is not null").select("graph", F.lit(2).alias("part"), "pos", F.concat(F.lit("    style "), "id", F.lit(" "), "style").alias("line")))
    lines = F.sort_array(F.collect_list(F.struct("part", "pos", "line")))
    return rows.groupBy("graph").agg(F.concat(F.lit(f"flowchart {direction}\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("chart"))


class BadGraph(ValueError):
    """Repeated ids, edges without ends, or subgraphs whose parents are unknown or themselves."""


def _step(part: int, pos: Column, name: Column) -> Column:
    """A place among what stands in one subgraph: heads, nodes, subgraphs, edges, the end."""
    return F.array(F.struct(F.lit(part).alias("part"), pos.cast("long").alias("pos"), name.cast("string").alias("id")))


HEAD, DIRECTION, NODES, SUBGRAPHS, EDGES, END, STYLES = range(7)


def _named(rows: DataFrame) -> str:
    return ", ".join(str(r[0]) for r in rows.limit(5).collect())


def checked(nodes: DataFrame, edges: DataFrame, subgraphs: DataFrame) -> None:
    """BadGraph for ids that occur more than once in a graph, among nodes and subgraphs, and edges one of whose ends is neither."""
    ids = nodes.select("graph", "id").unionByName(subgraphs.select("graph", "id"))
    for rows, what in ((repeated_nodes(ids).select("id"), "more than once"), (dangling_edges(ids, edges).select(F.concat("source", F.lit(" - "), "target")), "edges without ends")):
        if found := _named(rows):
            raise BadGraph(f"{what}: {found}")


def nested_places(subgraphs: DataFrame, tmp: Scratch) -> DataFrame:
    """subgraphs (graph, pos, id, label, parent, direction, style) with their place: the steps that lead to each from its graph. Children are found from their parents, level by level, until none is left; those that are never found have an unknown parent, or are within themselves."""
    own = _step(SUBGRAPHS, F.col("pos"), F.col("id"))
    level = tmp.save(subgraphs.where("parent is null").withColumn("place", own), "level0")
    found, k = level, 0
    while not level.isEmpty():
        parents, k = level.select("graph", F.col("id").alias("parent"), F.col("place").alias("_above")), k + 1
        level = tmp.save(subgraphs.join(parents, ["graph", "parent"]).withColumn("place", F.concat("_above", own)).select(*found.columns), f"level{k}")
        found = found.unionByName(level)
    found = tmp.save(found, "places", keep=True)
    lost = subgraphs.join(found.select("graph", "id"), ["graph", "id"], "left_anti")
    if not lost.isEmpty():
        orphans = lost.join(subgraphs.select("graph", F.col("id").alias("parent")), ["graph", "parent"], "left_anti").select("id")
        raise BadGraph(f"unknown parents: {_named(orphans)}" if not orphans.isEmpty() else f"within themselves: {_named(lost.select('id'))}")
    return found


def nested_mermaid(nodes: DataFrame, edges: DataFrame, subgraphs: DataFrame, direction: str = "TB") -> DataFrame:
    """One text per graph, with nested subgraphs.

    nodes: graph, pos, id, label, shape, subgraph (null: in none), and optionally style; edges: graph, pos, source, target, kind, and optionally subgraph; subgraphs: graph, pos, id, label, parent (null: in none), direction and style (may be null). Within a subgraph nodes stand first, then its subgraphs, then its edges; lines are indented by depth. BadGraph where the tables don't make graphs.
    """
    spark = nodes.sparkSession
    with Scratch(spark, "graphs") as tmp:
        checked(nodes, edges, subgraphs)
        places = nested_places(subgraphs, tmp)
    inner = places.select("graph", F.col("id").alias("subgraph"), F.col("place").alias("_above"))
    unknown = nodes.where("subgraph is not null").join(inner, ["graph", "subgraph"], "left_anti").select("id")
    if found := _named(unknown):
        raise BadGraph(f"in unknown subgraphs: {found}")
    within = lambda rows, own: rows.join(inner, ["graph", "subgraph"], "left").withColumn("place", F.concat(F.coalesce("_above", F.array().cast("array<struct<part:int,pos:bigint,id:string>>")), own))
    indent = lambda depth: F.repeat(F.lit("    "), depth.cast("int"))
    line = lambda rows, place, depth, text: rows.select("graph", place.alias("place"), F.concat(indent(depth), text).alias("line"))
    mark = lambda k: F.try_element_at(X.literal_map((s, m[k]) for s, m in SHAPES.items()), F.col("shape"))
    place, depth = F.col("place"), F.size("place")
    if "subgraph" not in edges.columns:
        edges = edges.withColumn("subgraph", F.lit(None).cast("string"))
    arrow = F.try_element_at(X.literal_map(ARROWS.items()), F.col("kind"))
    rows = [
        line(places, F.concat(place, _step(HEAD, F.lit(0), F.lit(""))), depth, F.concat(F.lit("subgraph "), "id", F.lit('["'), X.mermaid_label(F.col("label")), F.lit('"]'))),
        line(places.where("direction is not null"), F.concat(place, _step(DIRECTION, F.lit(0), F.lit(""))), depth + 1, F.concat(F.lit("direction "), "direction")),
        line(places, F.concat(place, _step(END, F.lit(0), F.lit(""))), depth, F.lit("end")),
        line(places.where("style is not null"), _step(STYLES, F.lit(0), F.col("id")), F.lit(1), F.concat(F.lit("style "), "id", F.lit(" "), "style")),
        line(within(nodes, _step(NODES, F.col("pos"), F.col("id"))), place, depth, F.concat("id", mark(0), X.mermaid_label(F.col("label")), mark(1))),
        line(within(edges, _step(EDGES, F.col("pos"), F.col("source"))), place, depth, F.concat("source", F.lit(" "), arrow, F.lit(" "), "target")),
    ]
    if "style" in nodes.columns:
        rows.append(line(nodes.where("style is not null"), _step(STYLES, F.lit(0), F.col("id")), F.lit(1), F.concat(F.lit("style "), "id", F.lit(" "), "style")))
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    lines = F.sort_array(F.collect_list(F.struct("place", "line")))
    return whole.groupBy("graph").agg(F.concat(F.lit(f"flowchart {direction}\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("chart"))
