"""Sliding windows over a whole stream, by count or by event time.

Item x (its number, or its time) lies in windows ceil((x - size + 1) / advance) to
floor(x / advance), counted from 0. Windows may overlap, tile or leave gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SAMPLES = 100  # rows for each range that are sampled to find where ranges end


def _bounds(df: DataFrame, order: list[str], n: int) -> list[Column]:
    """Keys that cut the rows into about ``n`` even ranges, from at most ``SAMPLES * n`` rows.

    They only decide how even the ranges are, never a row's number.
    """
    sample = df.select(*order).withColumn("_rand", F.rand(7)).orderBy("_rand").limit(SAMPLES * n).drop("_rand")
    found = sample.orderBy(*(F.col(c).asc_nulls_first() for c in order)).collect()
    cuts = list(dict.fromkeys(tuple(found[i * len(found) // n]) for i in range(1, n))) if found else []
    kinds = [df.schema[c].dataType for c in order]
    return [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(cut, kinds, order, strict=True))) for cut in cuts]


def numbered(df: DataFrame, order: list[str], name: str = "_x", parts: int | None = None) -> DataFrame:
    """Add the number (from 0) of each row in the order of the columns ``order``.

    Rows are cut into ranges of all these columns together, whatever their types, so
    that one file, one time or a batch without times is shared by many tasks. Each task
    numbers its own range, and sums of the ranges' counts (one row for each) give where
    a range starts. Nulls come first; only rows that are equal in all columns of
    ``order`` stay in one range.
    """
    own = [F.col(c).asc_nulls_first() for c in order]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df, order, n)
    key = F.struct(*(F.col(c).alias(c) for c in order))
    where = F.size(F.filter(F.array(*bounds), lambda b: b <= key)) if bounds else F.lit(0)
    rows = df.withColumn("_range", where)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_r2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*own)) - 1)
    rows = rows.join(F.broadcast(starts), F.col("_range") == F.col("_r2"))
    return rows.withColumn(name, (F.col("_start") + F.col("_i")).cast("long")).drop("_range", "_r2", "_start", "_i")


def windows_of(x: Column, size: int, advance: int) -> Column:
    """Array of the numbers of the windows that hold item ``x`` (none for x < 0)."""
    low = F.greatest(F.lit(0), F.ceil((x - (size - 1)) / advance)).cast("long")
    high = F.floor(x / advance).cast("long")
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def by_count(df: DataFrame, order: list[str], size: int, advance: int) -> DataFrame:
    """A row for each item and window: ``_win``, ``_ord`` (number) and ``_pos`` (place in the window)."""
    rows = numbered(df, order, "_ord")
    rows = rows.withColumn("_win", F.explode(windows_of(F.col("_ord"), size, advance)))
    return rows.withColumn("_pos", F.col("_ord") - F.col("_win") * advance)


def by_time(df: DataFrame, ts: Column, size: int, advance: int) -> DataFrame:
    """A row for each item and window of ``size`` ms: ``_win`` (its start in ms), ``_ord`` (ms)."""
    rows = df.withColumn("_ord", F.floor(F.unix_micros(ts) / 1000)).where("_ord is not null")
    rows = rows.withColumn("_win", F.explode(windows_of(F.col("_ord"), size, advance)))
    return rows.withColumn("_win", F.col("_win") * advance)
