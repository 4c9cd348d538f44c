"""Mixing sources to target weights by a temperature.

A source with share p of all tokens gets weight p**a / sum(p**a). The exponent a
leaves 1 (shares as they are) towards 0 (all alike) if the mixture's entropy must rise
and towards ``HIGHEST`` if it must fall, and is bisected until the entropy is
``entropy`` times the logarithm of the number of sources, or a document is repeated
``repeats`` times, whichever comes first. ``Mixture.stopped_by`` says which: ``entropy``,
``repeats``, or ``reach`` where no exponent meets either (sources of equal size stay as
they are at any exponent). The weights are then realised: a source repeats whole
permutations of its documents, and a last part of one, until its
budget of tokens is used; its stream is cut evenly over all blocks, so that each
block holds all sources at their weights. Everything is DataFrame expressions.

Where no ``budget`` is given it is the smallest that uses every document at least
once. A source's permutation is the order of a hash, numbered in buckets of it, so that
one source with a third of all rows is spread over many tasks. ``apply`` needs of a
source only how many whole permutations it takes and where its last one is cut, so
texts are repeated where they are and never shuffled.

Defined results: a null source is a source of its own; a null or empty text has no
tokens and follows its source's permutation; sources without any token are used
once, in block 0; rows with equal ids (for ``apply``: equal ids and texts) are used
alike, each as often; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

ENTROPY = 0.92
REPEATS = 4.0
HIGHEST = 64.0
BLOCK_TOKENS = 1 << 20
STEPS_A_JOB = 6
ROOM = 2_000


def words_in(text: Column) -> Column:
    """Number of words of a text: what counts as its tokens by default."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass
class Mixture:
    exponent: float
    entropy: float
    budget: float
    stopped_by: str  # entropy, repeats or reach
    sources: DataFrame  # source, documents, tokens, weight, budget


def _at(sources: DataFrame, total: float, exponents: list[float]) -> list:
    """Entropy, largest over smallest repetition, and covering budget, for each exponent."""
    p = F.col("tokens") / F.lit(float(total))
    grid = sources.where("tokens > 0").select(p.alias("p"), F.explode(F.lit(exponents)).alias("a"))
    sums = grid.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.col("a") * F.log("p")).alias("s"), F.max(F.pow("p", 1 - F.col("a"))).alias("least"), F.max(F.pow("p", F.col("a") - 1)).alias("most"))
    return sums.select("a", "z", (F.log("z") - F.col("s") / F.col("z")).alias("entropy"), (F.col("z") * F.col("least")).alias("cover"), "most").collect()  # one row for each exponent


def solve(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, jobs: int = 6) -> Mixture:
    """Bisect the exponent over stored ``sources`` (source, documents, tokens).

    Each job evaluates all midpoints of ``STEPS_A_JOB`` bisections at once.
    """
    total, n = sources.agg(F.sum("tokens"), F.count_if(F.col("tokens") > 0)).first()
    if not total:
        return Mixture(1.0, 0.0, 0.0, "reach", sources.withColumns({"weight": F.lit(0.0), "budget": F.lit(0.0)}))
    goal = entropy * math.log(n)
    natural = _at(sources, total, [1.0])[0]
    rising = natural["entropy"] <= goal

    def spent(row) -> float:
        return float(budget if budget is not None else row["cover"] * total)

    def few_repeats(row) -> bool:
        return row["most"] * spent(row) / total / row["z"] <= repeats * (1 + 1e-9)

    def short_of_goal(row) -> bool:
        return row["entropy"] <= goal + 1e-9 if rising else row["entropy"] >= goal - 1e-9

    near, far = 1.0, 0.0 if rising else HIGHEST
    end = _at(sources, total, [far])[0]
    if not few_repeats(natural):
        far, beyond = near, natural
    elif short_of_goal(end) and few_repeats(end):
        near, beyond = far, None
    else:
        beyond = end
    for _ in range(jobs if far != near else 0):
        width = (far - near) / (1 << STEPS_A_JOB)
        points = {r["a"]: r for r in _at(sources, total, [near + width * i for i in range(1, 1 << STEPS_A_JOB)])}
        for _ in range(STEPS_A_JOB):
            mid = min(points, key=lambda a: abs(a - (near + far) / 2))
            if short_of_goal(points[mid]) and few_repeats(points[mid]):
                near = mid
            else:
                far, beyond = mid, points[mid]
    found = _at(sources, total, [near])[0]
    stopped_by = "reach" if beyond is None else "entropy" if few_repeats(beyond) else "repeats"
    if abs(found["entropy"] - goal) <= 1e-6:
        stopped_by = "entropy"
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(total), F.lit(near)) / F.lit(found["z"])).otherwise(0.0)
    return Mixture(near, found["entropy"], spent(found), stopped_by, sources.withColumn("weight", weight).withColumn("budget", F.col("weight") * spent(found)))


@dataclass
class Plan:
    mixture: Mixture
    sources: DataFrame  # _source, _tokens, weight, budget, whole, epochs
    buckets: int


def planned(rows: DataFrame, entropy: float, repeats: float, budget: float | None) -> Plan:
    """How many permutations each source of stored ``rows(id, source, n_tokens)`` takes, the last one in part."""
    sources = materialize(rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens")))
    mixture = solve(sources, entropy, repeats, budget)
    most = sources.agg(F.max("documents")).first()[0] or 1
    exact = F.col("budget") / F.col("tokens")
    whole = F.when(F.col("tokens") > 0, F.floor(exact + 1e-9)).otherwise(1).cast("int")
    plan = mixture.sources.withColumn("whole", whole)
    plan = plan.withColumn("epochs", F.when((F.col("tokens") > 0) & (exact - F.col("whole") > 1e-9), F.col("whole") + 1).otherwise(F.col("whole")))
    plan = materialize(plan.select(F.col("source").alias("_source"), F.col("tokens").alias("_tokens"), "weight", "budget", "whole", "epochs"))
    return Plan(mixture, plan, max(64, -(-most // ROOM)))


def place(epoch: Column, key: Column, seed: int) -> Column:
    """A document's place in a permutation."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), key)


def bucket_of(h: Column, buckets: int) -> Column:
    return F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * buckets), F.lit(buckets - 1)).cast("int")


def ends(many: DataFrame, buckets: int) -> DataFrame:
    """Add ``_end`` to rows (_source, epoch, _h, n_tokens, _tokens): tokens of its source up to the row and its peers."""
    many = many.withColumn("_b", bucket_of(F.col("_h"), buckets))
    sums = many.groupBy("_source", "epoch", "_b").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy("_source", "epoch").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col("_source").alias("_s2"), F.col("epoch").alias("_e2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_source", "epoch", "_b").orderBy("_h").rangeBetween(Window.unboundedPreceding, 0)
    many = many.withColumn("_in", F.sum("n_tokens").over(own))
    many = many.join(first, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("epoch") == F.col("_e2")) & (F.col("_b") == F.col("_b2")))
    return many.withColumn("_end", F.col("epoch") * F.col("_tokens") + F.col("_first") + F.col("_in"))


USED = "_end <= budget * (1 + 1e-9D) or _tokens = 0"


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, tokens: Column | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Which documents are used, how often and where: (id, source, n_tokens, epoch, weight, block, position, exponent, stopped_by).

    ``position`` orders the rows of a block.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (words_in(F.col("text")) if tokens is None else tokens.cast("long")).alias("n_tokens")))
    plan = planned(rows, entropy, repeats, budget)
    blocks = max(1, -(-int(plan.mixture.budget) // block_tokens))
    many = rows.join(plan.sources, F.col("source").eqNullSafe(F.col("_source"))).where("epochs > 0")
    many = many.withColumn("epoch", F.explode(F.expr("sequence(0, epochs - 1)"))).withColumn("_h", place(F.col("epoch"), F.col("id"), seed))
    used = ends(many, plan.buckets).where(USED)
    at = F.when(F.col("budget") > 0, (F.col("_end") - F.col("n_tokens")) / F.col("budget")).otherwise(0.0)
    used = used.withColumn("block", F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("long"))
    return used.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "n_tokens",
        "epoch",
        "weight",
        "block",
        F.xxhash64(F.lit(seed + 1), "block", "epoch", "id").alias("position"),
        F.lit(plan.mixture.exponent).alias("exponent"),
        F.lit(plan.mixture.stopped_by).alias("stopped_by"),
    )


def apply(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, seed: int = 1) -> DataFrame:
    """The documents of the mixture with all their columns, each as often as ``mix`` uses it.

    A document is repeated once for each whole permutation of its source and once more
    if its place in the last one comes before the source's cut.
    """
    key = F.xxhash64("doc_id", "text")
    rows = materialize(docs.select(key.alias("id"), "source", words_in(F.col("text")).alias("n_tokens")))
    plan = planned(rows, entropy, repeats, budget)
    last = rows.join(plan.sources.where("epochs > whole"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("epoch", F.col("whole"))
    used = ends(last.withColumn("_h", place(F.col("epoch"), F.col("id"), seed)), plan.buckets).where(USED)
    cuts = used.groupBy(F.col("_source").alias("_s3")).agg(F.max("_h").alias("_mix_cut"))
    times = plan.sources.join(cuts, F.col("_source").eqNullSafe(F.col("_s3")), "left").select(F.col("_source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), "_mix_cut")
    times = materialize(times)  # a row for each source: broadcast where its size allows
    discard(rows)
    often = F.col("_mix_whole") + F.coalesce(place(F.col("_mix_whole"), key, seed) <= F.col("_mix_cut"), F.lit(False)).cast("int")
    joined = docs.join(times, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_each", often)
    return joined.where("_mix_each > 0").withColumn("_mix_c", F.explode(F.expr("sequence(1, _mix_each)"))).select(*(docs[c] for c in docs.columns))
