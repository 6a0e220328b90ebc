"""Search by one vector, and retrieval for answers. Searches by many vectors are in nearest.py, those by an index in vector_index.py."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import vocab as V
from .select import of_project

NO_ANSWER = "Unable to answer question because no relevant code was found"


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays in double precision; null if their lengths differ."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)))


def nearest(rows: DataFrame, query: Sequence[float], vector: str = "contentVector", key: str = "filepath", k: int = V.SEARCH_RESULTS) -> DataFrame:
    """The k rows nearest to a vector, exactly: each task keeps its k best, ties by key. The query is a literal, so nothing is joined."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.where(F.col(vector).isNotNull()).withColumn("distance", euclidean(F.col(vector), q)).where("distance is not null").orderBy("distance", key).limit(k)


def markdown_context(files: DataFrame, kind: str = "fileExtension", content: str = "content", order: str = "distance") -> DataFrame:
    """Code blocks of a few files (the results of a search), in order, as one text."""
    blocks = F.sort_array(F.collect_list(F.struct(order, X.code_block(F.col(kind), F.col(content)).alias("block"))))
    return files.agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "").alias("context"))


def answer(sources: DataFrame, question: str, embed: Callable[[str], Sequence[float] | None], complete: Callable[[str], str | None], project: str | None = None, k: int = V.SEARCH_RESULTS) -> str:
    """Answer of an injected model from the files nearest to a question, with their paths; a fixed text where any step has no result."""
    vector = embed(question)
    if not vector:
        return NO_ANSWER
    found = nearest(of_project(sources, project), vector, k=k)
    paths = [r["filepath"] for r in found.select("filepath").collect()]
    if not paths:
        return NO_ANSWER
    said = complete(f"Question: {question}\n\n{markdown_context(found).first()['context']}")
    return NO_ANSWER if not said else said + "\n\nReferences:\n" + "\n".join(f" * {p}" for p in paths)
