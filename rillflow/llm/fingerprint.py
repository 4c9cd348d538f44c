"""Document fingerprints: every shingle hash below a fixed fraction is kept.

A shingle is five words in a row (all words of a shorter text); its hash is kept
if it lies in the lowest ``1 / scale`` of the 64-bit range. So fingerprints of
texts of any lengths are samples of the same hashes: the union of two is that of
both texts together, and containment is estimated from either side. Everything is
DataFrame expressions.

The string form is ``digest:hash,hash,...`` in hexadecimal, hashes in order, with a
digest of all words; so equal texts have equal fingerprints, and texts too short
for a kept hash still differ.

Defined results: a null text is empty; a text without words has no shingles; two
texts of equal words have likeness 1, two others without kept hashes 0; repeated
rows are fingerprinted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
SCALE = 4


def sketch(docs: DataFrame, text: str, prefix: str, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """Add ``{prefix}_digest`` (long) and ``{prefix}_hashes`` (sorted array of longs)."""
    limit = -(1 << 63) + (1 << 64) // scale
    parts = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D\x20]+"), "")
    docs = docs.withColumn("_w", F.transform(parts, lambda w: F.xxhash64(w)))
    w, n = F.col("_w"), F.size("_w")
    full = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
    every = F.when(n >= words, full).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    docs = docs.withColumn("_s", every)
    kept = F.array_sort(F.array_distinct(F.filter("_s", lambda h: h < F.lit(limit) if scale > 1 else F.lit(True))))
    return docs.withColumn(f"{prefix}_digest", F.xxhash64(w, n)).withColumn(f"{prefix}_hashes", kept).drop("_w", "_s")


def as_string(prefix: str) -> Column:
    hexed = F.transform(F.col(f"{prefix}_hashes"), lambda h: F.lower(F.lpad(F.hex(h), 16, "0")))
    return F.concat_ws(":", F.lower(F.lpad(F.hex(F.col(f"{prefix}_digest")), 16, "0")), F.array_join(hexed, ","))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketches in the same row."""
    x, y = F.col(f"{a}_hashes"), F.col(f"{b}_hashes")
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(F.col(f"{a}_digest") == F.col(f"{b}_digest"), 1.0).when(either == 0, 0.0).otherwise(both / either)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b holds; null if a has no kept hash."""
    x, y = F.col(f"{a}_hashes"), F.col(f"{b}_hashes")
    return F.when(F.col(f"{a}_digest") == F.col(f"{b}_digest"), 1.0).when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def merged(a: str, b: str) -> Column:
    """Kept hashes of two texts together."""
    return F.array_sort(F.array_union(F.col(f"{a}_hashes"), F.col(f"{b}_hashes")))


def with_next(docs: DataFrame, key: str, text: str, add: Callable[[DataFrame], DataFrame], columns: list[str], per_partition: int = 2) -> DataFrame:
    """Add ``next_<c>`` for each column: its value in the row next by ``key``; after the last, the first.

    Rows are cut into ranges of the key, so each task sorts its own range; the
    first row of each range (one for each range) is handed to the range before.
    Rows of equal keys follow a hash of ``text``. ``add`` makes ``columns``, once
    for each row.
    """
    spark = docs.sparkSession
    ranges = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    tree = F.lit(0)
    if bounds:
        # position of the key among the bounds, by a binary search written as an expression
        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(F.col(key) < F.lit(bounds[mid]), search(low, mid)).otherwise(search(mid + 1, high))

        tree = F.when(F.col(key).isNull(), F.lit(0)).otherwise(search(0, len(bounds)))
    rows = docs.withColumn("_range", tree).withColumn("_tie", F.xxhash64(text))
    first = rows.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull(), F.col(key), F.col("_tie"))).alias("_f")).select("_range", F.col(f"_f.{key}").alias("_key"), F.col("_f._tie").alias("_first_tie"))
    across = Window.orderBy("_range")  # one row for each range
    ends = first.select(F.col("_range").alias("_to"), "_key", "_first_tie", F.coalesce(F.lag("_range").over(across), F.max("_range").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_from"))
    opening = rows.join(F.broadcast(ends), (F.col("_range") == F.col("_to")) & F.col(key).eqNullSafe(F.col("_key")) & (F.col("_tie") == F.col("_first_tie")))
    opening = add(opening.dropDuplicates(["_from"])).select("_from", F.struct(*columns).alias("_opening"))
    rows = add(rows)
    kept = [c for c in rows.columns if c not in ("_range", "_tie")]
    within = Window.partitionBy("_range").orderBy(key, "_tie")
    rows = rows.withColumn("_next", F.lead(F.struct(*columns)).over(within))
    joined = rows.join(F.broadcast(opening), (F.col("_range") == F.col("_from")) & F.col("_next").isNull(), "left")
    joined = joined.withColumn("_next", F.coalesce("_next", "_opening"))
    return joined.select(*kept, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """(id, n_chars, digest, hashes, fingerprint) of every whole text."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = sketch(rows, "_text", "own", scale)
    return rows.select(id_col, F.length("_text").cast("long").alias("n_chars"), F.col("own_digest").alias("digest"), F.col("own_hashes").alias("hashes"), as_string("own").alias("fingerprint"))


def compare_edited(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprint each text and its edit: the last half replaced by the next text's beginning."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("own_text"))
    rows = with_next(rows, "doc_id", "own_text", lambda d: sketch(d, "own_text", "own", scale), ["own_text", "own_digest", "own_hashes"])
    rows = rows.withColumnsRenamed({"next_own_digest": "next_digest", "next_own_hashes": "next_hashes"})
    n = F.length("own_text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited_text", F.concat(F.left(F.col("own_text"), n - half), F.left(F.col("next_own_text"), half)))
    rows = sketch(rows, "edited_text", "edited", scale)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_string("own").alias("fingerprint"),
        as_string("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )
