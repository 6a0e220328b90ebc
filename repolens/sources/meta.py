"""Small files beside tables, through the file system that Spark uses. Their names begin with an underscore, so that Spark takes them for no data."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    store.delete(at, True)


def read_json(spark: SparkSession, path: str) -> object | None:
    """What a file holds; None if it isn't there."""
    at, store = _at(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, data: object) -> None:
    at, store = _at(spark, path)
    stream = store.create(at, True)
    try:
        stream.write(bytearray(json.dumps(data).encode()))
    finally:
        stream.close()
