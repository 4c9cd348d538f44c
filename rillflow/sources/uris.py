"""Readers for the places a data source names: bounded STORAGE, unbounded STREAM.

Every place gives rows of one JSON text, ``value``, with their arrival order.
"""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"numeric": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}

class BadPlace(ValueError):
    pass


def path_of(uri: str) -> str:
    if uri.startswith("hdfs:"):
        if not re.fullmatch(r"hdfs://.+", uri):
            raise BadPlace(f"invalid storage specification: {uri}")
        return uri
    parts = urlparse(uri)
    if parts.scheme != "file":
        raise BadPlace(f"invalid storage specification: {uri}")
    path = uri.removeprefix("file://")
    return "file://" + (path if path.startswith("/") else os.path.join(os.getcwd(), path))


def check_storage(uri: str) -> None:
    if uri != "empty":
        path_of(uri)


def check_stream(uri: str) -> None:
    if uri != "dummy" and not uri.startswith("file:") and not re.fullmatch(r"kafka://[^/]+/[^/]+/[^/]+", uri):
        raise BadPlace(f"invalid stream specification: {uri}")


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, TYPES[k], True) for n, k in columns])


def stored(spark: SparkSession, uri: str) -> DataFrame:
    """(value, _arrival...) of all lines of a place, oldest file first."""
    if uri == "empty":
        return spark.createDataFrame([], "value string, _a1 timestamp, _a2 string, _a3 long")
    lines = spark.read.text(path_of(uri))
    return lines.select("value", F.col("_metadata.file_modification_time").alias("_a1"), F.col("_metadata.file_path").alias("_a2"), F.monotonically_increasing_id().alias("_a3"))


ARRIVAL = ["_a1", "_a2", "_a3"]


def live(spark: SparkSession, uri: str, stamp: str = "event_timestamp") -> DataFrame:
    """Unbounded lines of a place; ``stamp`` names the column of times in ``dummy``."""
    if uri == "dummy":
        three = F.array(*(F.lit(x) for x in dummy_rows(stamp)))
        return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.explode(three).alias("value"))
    if uri.startswith("file:"):
        return spark.readStream.option("latestFirst", "false").text(path_of(uri))
    servers, topic, _group = uri.removeprefix("kafka://").split("/")
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return reader.load().select(F.col("value").cast("string"))


#: Gender, age and time of the rows of ``dummy``.
DUMMY = (("m", 26, "2014-11-21T15:52:21.943321112"), ("f", 24, "2014-11-21T15:52:22"), ("m", 31, "2014-11-21T15:53:21.12345"))


def dummy_rows(stamp: str = "event_timestamp") -> list[str]:
    return [f'{{"gender":"{gender}","age":{age},"{stamp}":"{time}"}}' for gender, age, time in DUMMY]


def infer(spark: SparkSession, uri: str) -> T.StructType:
    """The schema of a stored place, from all its lines; an empty place has no columns."""
    if uri == "empty":
        return T.StructType([])
    found = spark.read.json(path_of(uri)).schema
    return T.StructType([f for f in found if f.name != "_corrupt_record"])


def rows(lines: DataFrame, schema: T.StructType, keep: list[str]) -> DataFrame:
    """Parse JSON lines; lines that are not JSON objects are left out."""
    whole = T.StructType([*schema, T.StructField("_corrupt", T.StringType())])
    read = F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.withColumn("_j", read).where(F.col("_j").isNotNull() & (F.col("_j._corrupt").isNull()))
    return parsed.select(*keep, *(F.col(f"_j.`{f.name}`") for f in schema))
