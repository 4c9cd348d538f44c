"""Similarity join of documents on word n-grams: a size-aware heavy-light join.

A document's set holds its distinct shingles of ``width`` words. Two documents link
if ``100 * intersection >= percent * union``, that is, if sets of sizes a and b share
``need(a, b)`` shingles.

Light side (sets up to a boundary size): for each pair of sizes (a, b) that can
link, a set enumerates its subsets of exactly need(a, b) shingles; sets that meet in
a subset link, all of them to the smallest set of the smaller size: no pairs.
Heavy side (larger sets): inverted lists. In one order of all shingles two linked
sets share one of their first ``first(n)`` shingles, so only those have lists. The
order begins with a region, a fixed fraction of all hashes, from the rarest shingle to
the most frequent, by exact counts over all documents; the other shingles follow in
the order of their hashes. The lists are scanned in two rounds: first every entry is
compared with a few stars of its list, which ties groups of copies
together; then entries outside the list's main component are compared with the
entries of other components, each pair in its first lists only. Bitmaps bound how
much two sets share; the pairs that are left are decided by their whole sets. The
boundary takes the least cost over the histogram of sizes.

Sets that are equal are one node, so thousands of copies cost no pairs.

``LIGHT``, ``STARS``, ``BITMAP``, ``PICKED`` and the sizes of the bitmaps bear on speed alone: results are
exact at every size.

Defined results: a null text is empty; a document without words has no set and
links with nothing; with fewer words than ``width`` the whole sequence is its one
shingle; rows with equal ids and different texts are nodes each; a row with a null id
takes part and gets a null component; an empty table gives an empty result; other
columns are ignored. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, mix, release, small_batches, words
from .components import components

LIGHT = 40
PARITY = 512
FINE = 8192
FINE_ABOVE = 512
BITMAP = 26
PICKED = 3
BEFORE = 3
STARS = 16
SCAN_COST = 8
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def need(a: int, b: int, percent: int) -> int:
    """Shingles that sets of sizes a and b must share."""
    return -(-percent * (a + b) // (100 + percent))


def first(n: int, percent: int) -> int:
    """How many of its first shingles a set of n must list."""
    return n - -(-percent * n // 100) + 1


def shingles(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and where each text's begin (and the end)."""
    text, h = words(raw)
    n = np.bincount(text, minlength=len(raw))
    ends = np.cumsum(n)
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        out = out * _STEP + h[k : len(h) - width + 1 + k]
    inside = text[: len(out)] == text[width - 1 :] if len(out) else np.zeros(0, bool)
    found, owner = mix(out[inside]), text[: len(out)][inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = []
        for i in short:
            s = int(n[i])
            for x in h[ends[i] - n[i] : ends[i]].tolist():
                s = (s * int(_STEP) + x) & _MASK
            extra.append(s)
        found = np.concatenate([found, mix(np.array(extra, np.uint64) ^ _STEP)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, np.searchsorted(owner, np.arange(len(raw) + 1))


def sums(own: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums that stand for a set."""
    return len(own), int(mix(own).sum()), int(mix(own ^ _STEP).sum())


def node() -> Column:
    """The key of a set, from the columns of its ``sums``."""
    return F.xxhash64("n", "s1", "s2").alias("node")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, s1, s2) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            h, at = shingles(raw, width)
            each = [sums(np.unique(h[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*each, strict=True)]
            yield pa.record_batch([part.column("doc_id"), *columns], names=["doc_id", "n", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def bitmap(keys: DataFrame, place: Callable[[int], Column]) -> tuple[int, DataFrame]:
    """How many bits (at most ``BITMAP``) the places of ``keys`` have, and their bitmap
    (w, b) of words that aren't 0. ``place`` hashes a key to so many bits."""
    bits = min(BITMAP, max(10, (8 * keys.count()).bit_length()))
    h = keys.select(place(bits).alias("h"))
    return bits, h.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("b"))


def picked(docs: DataFrame, key: str, kept: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``kept``; every key is in ``kept`` or ``gone``.

    A bitmap of the keys that go leaves out most rows that stay, one of the other keys
    that it holds leaves out most rows that go, and so on. Only rows that all bitmaps
    hold are joined, so texts are hardly shuffled; the sizes of the bitmaps bear on
    speed alone.
    """
    rows = docs.select(F.col(key).alias("key"), F.struct(*docs.columns).alias("row"), F.lit(None).cast("int").alias("left_out"))
    held, others = (materialize(x.select(F.col(key).alias("key"))) for x in (gone, kept))
    for level in range(PICKED):
        place = lambda bits: F.xxhash64("key", F.lit(level)).bitwiseAND((1 << bits) - 1)  # noqa: B023, E731
        bits, found = bitmap(held, place)
        told = F.broadcast(materialize(found))
        inside = F.coalesce(F.expr("shiftright(b, int(h & 63)) & 1 = 1"), F.lit(False))
        look = lambda df: df.withColumn("h", place(bits)).join(told, F.shiftright("h", 6) == F.col("w"), "left").withColumn("inside", inside).drop("h", "w", "b")  # noqa: B023, E731
        rows = look(rows).withColumn("left_out", F.when(F.col("left_out").isNull() & ~F.col("inside"), level).otherwise(F.col("left_out"))).drop("inside")
        more = materialize(look(others).where("inside").select("key"))
        discard(others)
        held, others = more, held
    last, rest = (held, others) if PICKED % 2 else (others, held)
    discard(rest)
    sure = rows.where("left_out % 2 = 0")
    return sure.select("row.*").union(rows.where("left_out is null").join(last, "key", "left_semi").select("row.*"))


def reread(docs: DataFrame, ids: DataFrame, width: int, kinds: str, give: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """(node, *kinds) of the sets of rows whose ids are in ``ids(doc_id)``, and of few others,
    which may be copies: ``single`` leaves one row of a node.

    ``give`` makes the columns of ``kinds`` from sets in the order of their hashes. A
    bitmap of hashed ids (at most ``1 << BITMAP`` bits) tells tasks which texts to
    read, so texts are never shuffled.
    """
    place = lambda bits: F.xxhash64("doc_id").bitwiseAND((1 << bits) - 1)
    bits, found = bitmap(ids, place)
    words_ = found.toArrow()
    asked_ = np.zeros(max(1, 1 << bits >> 6), np.int64)
    asked_[words_.column("w").to_numpy()] = words_.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(asked_.view(np.uint64))
    names = ["n", "s1", "s2", *(k.split()[0] for k in kinds.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ = shared.value
        for batch in batches:
            h = batch.column("h").to_numpy()
            asked = asked_[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1) == 1
            for _, raw in chunks(iter([batch.filter(pa.array(asked))]), "text"):
                hashes, at = shingles(raw, width)
                each = [x for a, b in zip(at[:-1], at[1:], strict=True) if len(x := np.unique(hashes[a:b]))]
                if each:
                    keys = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*map(sums, each), strict=True)]
                    yield pa.record_batch([*keys, *give(each)], names=names)

    read = docs.select("text", place(bits).alias("h")).mapInArrow(run, f"n long, s1 long, s2 long, {kinds}")
    return read.select(node(), "n", *names[3:])


def single(read: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """One row of each node of a ``reread`` table, and the scratch tables that hold it.

    Only the keys are shuffled; nodes with copies are few, as bitmaps hold few other rows.
    """
    held = materialize(read.withColumn("row", F.monotonically_increasing_id()))
    several = materialize(held.groupBy("node").agg(F.min("row").alias("least"), F.count("*").alias("copies")).where("copies > 1").select("node", "least"))
    return held.join(several, "node", "left").where("least is null or row = least").drop("row", "least"), (held, several)


def listed(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0] + [len(x) for x in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows).view(np.int64)))


def sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles) of the sets of rows with ``ids(doc_id)``, and of few others."""
    return reread(docs, ids, width, "shingles array<long>", lambda each: [listed(each)])


def turned_bits(own: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits, as longs, in which each shingle has turned one bit."""
    bits = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def region(percent: int) -> float:
    """The fraction of hashes whose shingles are ordered by their counts."""
    return min(1.0, 1.5 * (100 - percent) / 100 + 0.02)


def described(docs: DataFrame, ids: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, n, r, head, items, parity, fine) of sets: how many shingles lie in the region,
    those and as many more as must have lists, all shingles of a set of at most ``LIGHT``,
    and two bitmaps in which each shingle has turned one bit (the fine one for sets above
    ``FINE_ABOVE`` only)."""
    end = np.uint64(min(_MASK, int(region(percent) * 2**64)))

    def give(each: list[np.ndarray]) -> list[pa.Array]:
        inside = [int(np.searchsorted(x, end)) for x in each]
        heads = [x[: max(r, first(len(x), percent))] for x, r in zip(each, inside, strict=True)]
        items = [x if len(x) <= LIGHT else x[:0] for x in each]
        fine = [turned_bits(x, FINE) if len(x) > FINE_ABOVE else x[:0] for x in each]
        return [pa.array(inside, pa.int64()), listed(heads), listed(items), listed([turned_bits(x, PARITY) for x in each]), listed(fine)]

    return reread(docs, ids, width, "r long, head array<long>, items array<long>, parity array<long>, fine array<long>", give)


def pairs_of_sizes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(a, b, need) of the pairs of sizes a <= b that can link and hold n."""
    top = 100 * n // percent
    found = [(n, b, need(n, b, percent)) for b in range(n, top + 1)]
    found += [(a, n, need(a, n, percent)) for a in range(-(-percent * n // 100), n)]
    return [(a, b, c) for a, b, c in found if c <= a]


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The largest size whose subsets are enumerated: least total cost, at most ``LIGHT``."""
    light = [0.0] + [sum(comb(n, c) for _, _, c in pairs_of_sizes(n, percent)) for n in range(1, LIGHT + 1)]
    heavy = [0.0] + [float(SCAN_COST * first(n, percent)) for n in range(1, LIGHT + 1)]
    cost = lambda x: sum(histogram.get(n, 0) * (light[n] if n <= x else heavy[n]) for n in range(1, LIGHT + 1))
    allowed = [x for x in range(LIGHT + 1) if all(light[n] <= 20_000 for n in range(1, x + 1))]
    return min(allowed, key=lambda x: (cost(x), x))


def light_links(classes: DataFrame, percent: int) -> DataFrame:
    """(u, v) of sets that share a subset; every set with one representative of the subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in zip(batch.column("node").to_pylist(), batch.column("items"), strict=True):
                own = items.values.to_numpy().view(np.uint64)
                total, n = own.sum(), len(own)
                keys, smaller = [], []
                for a, b, c in pairs_of_sizes(n, percent):
                    out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                    keys.append(mix(total - own[out].sum(axis=1, dtype=np.uint64) + np.uint64((a << 32 | b) * int(_STEP) & _MASK)))
                    smaller.append(np.full(len(out), n == a))
                if keys:
                    flat = np.concatenate(keys).view(np.int64)
                    yield pa.record_batch([pa.array(flat), pa.array(np.full(len(flat), node)), pa.array(np.concatenate(smaller))], names=["key", "node", "smaller"])

    subsets = materialize(classes.select("node", "items").mapInArrow(run, "key long, node long, smaller boolean"))
    meet = subsets.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("smaller"), F.col("node"))).alias("u")).where("n > 1 and u is not null").select("key", "u")
    return subsets.join(meet, "key").where("node <> u").select("u", F.col("node").alias("v")).distinct()


def bits_apart(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def verified(pairs: DataFrame, own: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` of nodes that link, by their whole sets.

    First only the listed shingles and the bitmaps are compared: two sets share
    at most the shingles that both list and all that one of them does not list, and
    they differ at least in as many shingles as their bitmaps in bits. What may still
    link is compared in full.
    """
    side = lambda c: own.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", "head", "parity", "fine")))
    both = F.col("u_n") + F.col("v_n")
    most = F.size(F.array_intersect("u_head", "v_head")) + F.greatest(F.col("u_n") - F.size("u_head"), F.col("v_n") - F.size("v_head"))
    may_differ = both - 2 * needed("u_n", "v_n", percent)
    near = (bits_apart("u_parity", "v_parity") <= may_differ) & ((F.size("u_fine") == 0) | (F.size("v_fine") == 0) | (bits_apart("u_fine", "v_fine") <= may_differ))
    met = pairs.join(side("u"), "u").join(side("v"), "v")
    asked = materialize(met.where(near & ((100 + percent) * most >= percent * both)).select("u", "v").distinct())
    nodes = asked.select(F.col("u").alias("node")).union(asked.select("v")).distinct()
    whole, scratch = single(sets(docs, classes.join(nodes, "node").select("doc_id"), width))
    joined = asked.join(whole.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(whole.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    links = materialize(joined.where((100 + percent) * shared >= percent * (F.size("x") + F.size("y"))).select("u", "v").distinct())
    discard(asked, *scratch)
    return links


def needed(a: str, b: str, percent: int) -> Column:
    """``need`` of two columns."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))


def may_link(u: str, v: str, percent: int) -> Column:
    """Whether the sets of two entries of a list may link, if no list before had both.

    The columns are {u}_n and {u}_at, the place of the list's shingle in the set. Two
    sets that meet first at places i and j share at most what follows.
    """
    a, b = F.col(f"{u}_n"), F.col(f"{v}_n")
    least = needed(f"{u}_n", f"{v}_n", percent)
    return (F.col(f"{u}_at") <= a - least) & (F.col(f"{v}_at") <= b - least)


def apart_by_parity(u: str, v: str) -> Column:
    """In how many bits {u}_parity and {v}_parity differ; null where one is missing."""
    return reduce(lambda p, q: p + q, (F.bit_count(F.get(f"{u}_parity", F.lit(i)).bitwiseXOR(F.get(f"{v}_parity", F.lit(i)))) for i in range(PARITY // 64)))


def alike(u: str, v: str, percent: int) -> Column:
    """Whether two sets differ in few enough bits of {u}_parity; true where one is too large for it."""
    return F.coalesce(apart_by_parity(u, v) <= F.col(f"{u}_n") + F.col(f"{v}_n") - 2 * needed(f"{u}_n", f"{v}_n", percent), F.lit(True))


def side(entries: DataFrame, name: str, *more: str, before: bool = False) -> DataFrame:
    """The columns of entries with names for one side of a join."""
    own = ["node", "n", "at", *(["parity", *(f"b{i}" for i in range(1, BEFORE + 1))] if before else [])]
    return entries.select("list", *more, *(F.col(c).alias(f"{name}_{c}" if c != "node" else name) for c in own))


def lists(own: DataFrame, percent: int) -> DataFrame:
    """(list, node, n, at, parity, b1, b2, ...): the inverted lists with at least two entries.

    ``at`` is the place of the shingle in the order of its set, b1, b2, ... are the
    lists right before it there; only sets of at most ``FINE_ABOVE`` have the bitmap. Most shingles have one entry; only their number in a
    set bears on the places of the others.
    """
    entries = own.select("node", F.posexplode("head").alias("pos", "list"))
    counts = entries.groupBy("list").agg(F.count("*").alias("df")).where("df > 1")
    met = materialize(entries.join(counts, "list"))
    sizes = own.select("node", "n", "r", F.when(F.col("n") <= FINE_ABOVE, F.col("parity")).alias("parity"))
    rows = met.join(sizes, "node").withColumn("inside", F.col("pos") < F.col("r"))
    order = Window.partitionBy("node").orderBy(F.desc("inside"), F.when(F.col("inside"), F.col("df")), "list")
    ranked = rows.withColumns({
        "rank": F.row_number().over(order) - 1,
        "several": F.count_if("inside").over(Window.partitionBy("node")),
        **{f"b{i}": F.lag("list", i).over(order) for i in range(1, BEFORE + 1)},
    })
    at = F.when(F.col("inside"), F.col("r") - F.col("several") + F.col("rank")).otherwise(F.col("pos"))
    kept = ranked.withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / 100))
    out = materialize(kept.select("list", "node", "n", "at", "parity", *(f"b{i}" for i in range(1, BEFORE + 1))))
    discard(met)
    return out


def stars(entries: DataFrame, percent: int) -> DataFrame:
    """(u, v): each entry with two of the stars that its lists share with it.

    A list has about ``STARS`` stars, those nodes whose hashes are below a bound that
    falls with the list's length, so that alike lists have the same ones. Of those that
    may link with an entry it takes the nearest by their bitmaps and the one with the
    lowest hash; the first ties it most surely, the second to most others.
    """
    sizes = entries.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    sized = entries.join(sizes, "list")
    hashed = F.shiftrightunsigned(F.xxhash64("node", F.lit(1)), 1)
    lead = side(sized.where(hashed.cast("double") * F.col("size") < STARS * 2.0**63), "u", before=True)
    met = side(sized, "v", before=True).join(lead, "list").where((F.col("u") != F.col("v")) & may_link("u", "v", percent) & ~met_before() & alike("u", "v", percent))
    each = met.select("u", "v", F.coalesce(apart_by_parity("u", "v"), F.lit(0)).alias("bits"), F.xxhash64("u", F.lit(1)).alias("h"))
    best = each.groupBy("v").agg(F.min_by("u", F.struct("bits", "h")).alias("near"), F.min_by("u", F.struct(F.shiftrightunsigned("h", 1), "h")).alias("low"))
    return best.select(F.explode(F.array_distinct(F.array("near", "low"))).alias("u"), "v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def met_before() -> Column:
    """Whether two entries of a list have one of the lists right before it in common."""
    found = F.lit(False)
    for i in range(1, BEFORE + 1):
        for j in range(1, BEFORE + 1):
            found = found | F.coalesce(F.col(f"u_b{i}") == F.col(f"v_b{j}"), F.lit(False))
    return found


def across(entries: DataFrame, tied: DataFrame, percent: int) -> DataFrame:
    """(u, v) pairs of a list that lie in different components, u < v.

    Of two such entries one is outside the list's main component. The lists right
    before tell of most pairs whether an earlier list has both, and gives the pair.
    """
    marked = materialize(entries.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node")))
    main = marked.groupBy("list", "component").agg(F.count("*").alias("c")).groupBy("list").agg(F.count("*").alias("several"), F.max_by("component", F.struct("c", -F.col("component"))).alias("main")).where("several > 1")
    outside = side(marked.join(main, "list").where("component <> main").withColumnRenamed("component", "cu"), "u", "cu", "main", before=True)
    apart = (F.col("cu") != F.col("component")) & ((F.col("component") == F.col("main")) | (F.col("u") < F.col("v")))
    met = outside.join(side(marked, "v", "component", before=True), "list").where(apart & may_link("u", "v", percent) & ~met_before() & alike("u", "v", percent))
    out = materialize(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    discard(marked)
    return out


def join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; its component is the smallest id reachable by links."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, width).select("doc_id", "n", node()))
    classes = materialize(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    own, scratch = single(described(docs, classes.select("doc_id"), width, percent))
    histogram = {r["n"]: r["c"] for r in own.where(F.col("n") <= LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most LIGHT rows
    x = boundary(histogram, percent)
    light = light_links(own.where(F.col("n") <= x), percent)
    entries = lists(own.where(100 * F.col("n") >= percent * (x + 1)), percent)
    release(spark)
    near = materialize(light.union(stars(entries, percent)).distinct())
    links = verified(near, own, classes, docs, width, percent)
    release(spark)
    apart = across(entries, components(links), percent)
    discard(entries, near)
    more = verified(apart, own, classes, docs, width, percent)
    discard(apart, *scratch)
    release(spark)
    tied = components(links.union(more))
    least = classes.join(tied, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    named = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = materialize(least.join(named, "component").select("node", "component_id"))
    discard(classes, links, more)
    release(spark)
    found = signed.join(whole, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
