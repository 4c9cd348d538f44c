"""Sliding windows that go on from batch to batch.

State is the number of rows so far and a table of the rows that later windows still
need (fewer than a window's size, or its span of time); the table lies in the shared
folder, can be saved after each batch and loaded by a later process. A count window is given when its last
row arrives, a time window when a later time shows that it is over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate, aggregate
from ..operators.windows import by_count, by_time, numbered, windows_of
from .home import Scratch


class OngoingWindow:
    """One sliding window over all batches of a stream."""

    def __init__(self, aggs: list[Aggregate], size: int, advance: int, kind: str, stamp: str):
        self.aggs, self.kind, self.stamp = aggs, kind, stamp
        scale = 1 if kind == "tuples" else 1000
        self.size, self.advance = size * scale, advance * scale
        self.seen, self.pending, self.given = 0, None, None
        self.scratch = Scratch()

    def save(self, folder: str) -> dict:
        """Write the rows that later windows need; gives the rest of the state."""
        if self.pending is not None:
            self.pending.write.mode("overwrite").parquet(folder)
        return {"seen": self.seen, "given": self.given, "pending": None if self.pending is None else self.pending.schema.jsonValue()}

    def load(self, spark: SparkSession, folder: str, record: dict) -> None:
        self.seen, self.given = record["seen"], record["given"]
        schema = record["pending"]
        self.pending = None if schema is None else spark.read.schema(T.StructType.fromJson(schema)).parquet(folder)

    def push(self, df: DataFrame, order: list[str], ts: Column | None, last: bool = False) -> DataFrame:
        """Take a batch; gives the windows that are complete (with ``last``: all that are left)."""
        inputs = [F.expr(a.column).cast(a.kind).alias(f"_v{i}") for i, a in enumerate(self.aggs)]
        if last and self.pending is None:
            return self._shown(self._whole(df, order, ts, inputs))
        if self.kind == "tuples":
            rows = numbered(df.select(*order, *inputs), order, "_ord").drop(*order)
            rows = rows.withColumn("_ord", F.col("_ord") + self.seen)
        else:
            rows = df.select(F.floor(F.unix_micros(ts) / 1000).alias("_ord"), *inputs).where("_ord is not null")
            if self.given is not None:  # late rows are dropped
                rows = rows.where(F.col("_ord") >= self.given)
        rows = self.scratch.keep(rows if self.pending is None else self.pending.unionByName(rows))
        if self.kind == "tuples":
            end = rows.agg(F.max("_ord")).first()[0]
            self.seen = self.seen if end is None else end + 1
            limit = self.seen
        else:
            end = rows.agg(F.max("_ord")).first()[0]
            limit = None if last else end
        windows = rows.withColumn("_k", F.explode(windows_of(F.col("_ord"), self.size, self.advance)))
        first = 0 if self.given is None else -(-self.given // self.advance)
        windows = windows.where(F.col("_k") >= first)
        if limit is not None:
            windows = windows.where(F.col("_k") * self.advance + self.size <= limit)
            over = max(0, (limit - self.size) // self.advance + 1)
            if over * self.advance > (self.given or 0):
                self.given = over * self.advance
            self.pending = self.scratch.keep(rows.where(F.col("_ord") >= (self.given or 0)))
        windows = windows.withColumn("_pos", F.col("_ord") - F.col("_k") * self.advance).withColumn("_win", F.col("_k") * self.advance).drop("_k")
        return self._shown(aggregate(windows, ["_win"], self.aggs, placed=self.kind == "tuples"))

    def _whole(self, df: DataFrame, order: list[str], ts: Column | None, inputs: list[Column]) -> DataFrame:
        """All windows of a bounded stream in one plan, without state."""
        if self.kind == "tuples":
            rows = by_count(df.select(*order, *inputs), order, self.size, self.advance)
            return aggregate(rows, ["_win"], self.aggs, placed=True).where(F.col("_n") == self.size)
        rows = by_time(df.select(ts.alias("_ts"), *inputs), F.col("_ts"), self.size, self.advance)
        return aggregate(rows, ["_win"], self.aggs)

    def _shown(self, out: DataFrame) -> DataFrame:
        out = out.drop("_n").orderBy("_win")
        if self.kind == "tuples":
            return out.drop("_win")
        start = F.date_format(F.timestamp_millis("_win"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(self.stamp)
        return out.select(start, *(f"`{a.output}`" for a in self.aggs))
