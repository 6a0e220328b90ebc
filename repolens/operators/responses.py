"""The gate that a model's answer passes before it counts as completed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.jsonrepair import columns as J
from ..functions.jsonrepair.driver import Result, parse_and_validate, validate_object
from .completion import COMPLETED, INVALID, Response

TEXT, JSON = "TEXT", "JSON"
BLANK = r"^[\s\p{Z}\x{FEFF}]*$"


class BadConfiguration(ValueError):
    """An output format and a schema that don't go together."""


class BadContent(ValueError):
    """An answer of a kind that the format can't be."""


def checked_format(output: str, schema: DataType | None) -> None:
    if output == JSON and schema is None:
        raise BadConfiguration("JSON output needs a schema")
    if output != JSON and schema is not None:
        raise BadConfiguration("a schema needs JSON output")


def gate(content: object, output: str = TEXT, schema: DataType | None = None) -> Result:
    """What an answer holds, or the error that makes it invalid. Text mustn't be blank, and anything but a string is an error of the provider. JSON may come as data, which needs no parsing, or as a string, which is repaired and validated; null is invalid."""
    checked_format(output, schema)
    if output != JSON:
        if not isinstance(content, str):
            raise BadContent(f"text was expected, not {type(content).__name__}")
        return Result(data=content) if content.strip("﻿ \t\r\n").strip() else Result(error="VALIDATION: empty text")
    if content is None:
        return Result(error="VALIDATION: null")
    if not isinstance(content, str):
        out = validate_object(content, schema)
        out.steps.insert(0, "pre-parsed object")
        return out
    return parse_and_validate(content, schema)


def accepting(output: str = TEXT, schema: DataType | None = None) -> Callable[[Response], Response]:
    """A check of responses for completion.attempt: a completed answer that doesn't pass the gate is invalid, and retried as such."""
    checked_format(output, schema)

    def check(response: Response) -> Response:
        if response.status != COMPLETED or gate(response.text, output, schema).ok:
            return response
        return replace(response, status=INVALID)

    return check


def text_status(content: Column) -> Column:
    """COMPLETED, or INVALID for null or blank text."""
    return F.when(content.isNull() | content.rlike(BLANK), INVALID).otherwise(COMPLETED)


def gated(answers: DataFrame, content: str, output: str = TEXT, schema: DataType | None = None) -> DataFrame:
    """answers with status and error; of JSON also generated, the data as a column of the schema's type. Text never leaves the JVM."""
    checked_format(output, schema)
    if output != JSON:
        status = text_status(F.col(content))
        return answers.withColumn("status", status).withColumn("error", F.when(F.col("status") == INVALID, "VALIDATION: empty text"))
    got = J.parsed(answers, content, schema, "generated")
    error = F.when(F.col(content).isNull(), "VALIDATION: null").otherwise(F.col("generated_error"))
    return got.withColumn("error", error).drop("generated_error").withColumn("status", F.when(F.col("error").isNull(), COMPLETED).otherwise(INVALID))
