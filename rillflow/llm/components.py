"""Connected components of a table of links, by alternating stars.

Each round points all neighbours of a node to its smallest one; the table of links
stays in the shared folder and is never collected. A node with very many links is
reduced by partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``links(u, v)``; the component is its smallest node.

    Links from a node to itself and repeated links change nothing; a link with a
    null end is ignored.
    """
    current = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = materialize(current)
    before = _state(current)
    for _ in range(rounds):
        if not before[0]:
            break
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        state = _state(after)
        discard(current)
        current = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no stable components after {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
