"""Where a live source keeps its results and its state.

Below one folder of the shared store: ``checkpoint`` (Spark's offsets), ``out`` (rows
that streams gave, by batch) and ``state`` (windows and models as they were after a
batch). A batch that runs again overwrites what it wrote, so rows are given once. The
stored part of a source is batch -1.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.shared import children, erase, exists, read_text, shared_dir, write_text

STORED = -1


class Scratch:
    """Tables that one batch writes and the next one reads; then they are deleted."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.old: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/rillflow-scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.new.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def turn(self, spark: SparkSession) -> None:
        """A batch is over: what the one before it wrote is not needed any more."""
        for path in self.old:
            erase(spark, path)
        self.old, self.new = self.new, []


class Home:
    """The folder of one source; with ``name`` the same one after a restart."""

    def __init__(self, spark: SparkSession, name: str | None, source: str):
        self.spark, self.lasting = spark, name is not None
        self.path = f"{shared_dir(spark)}/rillflow-{name or uuid.uuid4().hex}/{source}"
        self.streams: dict[str, T.StructType] = {}

    def give(self, stream: str, number: int, df: DataFrame) -> None:
        """Write a batch's rows of a stream; columns by place, so any names will do."""
        plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        for f in plain.schema:
            if isinstance(f.dataType, T.NullType):
                plain = plain.withColumn(f.name, plain[f.name].cast("string"))
        plain.write.mode("overwrite").parquet(f"{self.path}/out/{stream}/batch={number}")
        self.streams[stream] = T.StructType([T.StructField(a.name, b.dataType) for a, b in zip(df.schema, plain.schema, strict=True)])

    def table(self, stream: str) -> DataFrame:
        """All rows that a stream has given."""
        schema = self.streams[stream]
        plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
        return self.spark.read.schema(plain).parquet(f"{self.path}/out/{stream}").drop("batch").toDF(*schema.names)

    def folder(self, number: int) -> str:
        return f"{self.path}/state/{number}"

    def save(self, number: int, record: dict) -> None:
        """Close the state of a batch; the two last ones are kept, since a batch may run again."""
        streams = {n: s.jsonValue() for n, s in self.streams.items()}
        write_text(self.spark, f"{self.folder(number)}/state.json", json.dumps({**record, "streams": streams}))
        erase(self.spark, self.folder(number - 2))

    def load(self, number: int) -> dict:
        record = json.loads(read_text(self.spark, f"{self.folder(number)}/state.json"))
        self.streams = {n: T.StructType.fromJson(s) for n, s in record["streams"].items()}
        return record

    def latest(self) -> int | None:
        """The last batch whose state is whole; None if there is none."""
        found = [int(n) for n in children(self.spark, f"{self.path}/state") if exists(self.spark, f"{self.path}/state/{n}/state.json")]
        return max(found, default=None)
