"""Near-duplicate embeddings through a neighbour graph refined by NN-descent.

A first graph comes from random hyperplanes: vectors on the same sides of them are
compared in blocks. Then, in rounds, the neighbours of each vector (those in its
list, and those in whose lists it is) are compared with each other, and each list
keeps its best. A list is saturated if all it holds are links; saturated lists are
enlarged, twice as long each time, and refined again among themselves, until they hold
other vectors too or are ``LARGEST`` long. As a list of any length would not do for a
group of thousands, the vectors of a component that had a saturated list are also
compared in blocks, so their links are counted in whole, and search again with lists
that hold only vectors of other components, until no two of these components link. A sample of vectors is audited against all rows; while
it finds less than ``recall`` of the links of vectors with about as many links, more
hyperplanes and rounds follow; a target that is not met is logged as a warning.

Equal vectors are one class, so thousands of copies cost no pairs. Links are decided
by cosines in double precision.

Defined results: a vector that is null, has null or non-finite components, has norm
zero, or has another length than most vectors, links with nothing (its component is
itself); rows with equal ids are vectors each; a null id has a null component_id
where no linked vector has an id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components

NEIGHBOURS = 8
LARGEST = 64
PLANES = 8
LEAF = 192
BLOCK = 512
AUDIT = 1024
GROUP = 256


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column as vectors of norm 1, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best distinct others."""
    order = np.lexsort((other, -sim, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (other[order][1:] == other[order][:-1])
    order = order[np.concatenate(([True], ~same))] if len(order) else order
    starts = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1]))) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(sim, pa.float64())})


EDGES = "u long, v long, sim double"


def top(edges: DataFrame, k: int) -> DataFrame:
    """Each vector's k best edges."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.dropDuplicates(["u", "v"]).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def planes_for(total: int, cosine: float, recall: float) -> int:
    """Trees by which two vectors at ``cosine`` share a leaf with a chance of ``recall`` at any ``total``."""
    bits = max(0, math.ceil(math.log2(max(1, total) / LEAF)))
    meet = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return PLANES if meet == 1 else max(PLANES, math.ceil(math.log(max(1 - recall, 1e-3)) / math.log1p(-meet)))


def by_planes(vectors: DataFrame, total: int, dims: int, k: int, seed: int, planes: int = PLANES) -> DataFrame:
    """Edges between vectors of different ``own`` on the same sides of random hyperplanes."""
    bits = max(0, math.ceil(math.log2(max(1, total) / LEAF)))
    normals = np.random.default_rng(seed).standard_normal((planes, bits, dims))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column("x"))
            for t in range(planes):
                code = ((x @ normals[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(x), np.int64)
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), batch.column("cid"), batch.column("own"), batch.column("x")], names=["tree", "code", "cid", "own", "x"])

    kind = vectors.schema["x"].dataType.simpleString()
    coded = materialize(vectors.select("cid", "own", "x").mapInArrow(cut, f"tree int, code long, cid long, own long, x {kind}"))
    parts = coded.groupBy("tree", "code").agg(F.ceil(F.count("*") / (4 * LEAF)).cast("int").alias("parts"))
    rows = coded.join(parts, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("cid", "tree"), F.col("parts")))

    def compare(table: pa.Table) -> pa.Table:
        ids, own, x = table.column("cid").to_numpy(), table.column("own").to_numpy(), unit(table.column("x"))
        sim = x @ x.T
        sim[own[:, None] == own] = -2.0
        kept = min(k, len(ids) - 1)
        if not kept:
            return _edges(ids[:0], ids[:0], sim[0, :0])
        near = np.argpartition(-sim, kept - 1, axis=1)[:, :kept]
        best = np.take_along_axis(sim, near, 1).ravel()
        other = best > -2.0
        return _edges(np.repeat(ids, kept)[other], ids[near.ravel()][other], best[other])

    return rows.groupBy("tree", "code", "part").applyInArrow(compare, EDGES)


def descend(edges: DataFrame, vectors: DataFrame, total: int, k: int) -> DataFrame:
    """Better edges, between vectors of different ``own``, among the neighbours of each vector."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))
    around = edges.select("u", "v").union(back.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")).distinct()
    least = edges.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("least"))
    known = vectors.select(F.col("cid").alias("v"), "own", "x").join(least.select(F.col("u").alias("v"), "least"), "v", "left")
    groups = max(1, total // GROUP)
    rows = around.join(known, "v").withColumn("group", F.pmod(F.xxhash64("u"), F.lit(groups)))

    def local(table: pa.Table) -> pa.Table:
        u, v, group = (table.column(c).to_numpy() for c in ("u", "v", "own"))
        x, least = unit(table.column("x")), table.column("least").to_numpy(zero_copy_only=False)
        order = np.argsort(u, kind="stable")
        bounds = np.append(np.flatnonzero(np.concatenate(([True], u[order][1:] != u[order][:-1]))), len(u))
        found = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[a:b]
            sim = x[own] @ x[own].T
            sim[group[own][:, None] == group[own]] = -2.0
            i, j = np.nonzero(sim > least[own][:, None])
            found.append((v[own[i]], v[own[j]], sim[i, j]))
        p, q, s = (np.concatenate(c) for c in zip(*found, strict=True))
        kept = _best(p, q, s, k)
        return _edges(p[kept], q[kept], s[kept])

    return rows.groupBy("group").applyInArrow(local, EDGES)


def refine(edges: DataFrame, vectors: DataFrame, total: int, k: int, rounds: int = 3) -> DataFrame:
    """Rounds of ``descend`` until few lists change."""
    edges = materialize(top(edges, k))
    for _ in range(rounds):
        better = materialize(top(edges.union(descend(edges, vectors, total, k)), k))
        changed = better.join(edges, ["u", "v"], "left_anti").count()
        discard(edges)
        edges = better
        if changed <= 0.01 * k * total:
            break
    return edges


def saturated(edges: DataFrame, k: int, cosine: float) -> DataFrame:
    """(u) of the lists of length k that hold links only."""
    return edges.where(F.col("sim") >= cosine).groupBy("u").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("u")


def enlarged(edges: DataFrame, vectors: DataFrame, total: int, k: int, cosine: float) -> DataFrame:
    """(u, v): links of the longer lists that saturated lists of ``edges`` grow into."""
    found = edges.select("u", "v").limit(0)
    lists = materialize(edges.join(saturated(edges, k, cosine), "u", "left_semi"))
    while k < LARGEST and not lists.isEmpty():
        k *= 2
        better = lists.union(descend(lists, vectors, total, k)).join(lists.select("u").distinct(), "u", "left_semi")
        better = materialize(top(better, k))
        found = found.union(better.where(F.col("sim") >= cosine).select("u", "v"))
        lists = materialize(better.join(saturated(better, k, cosine), "u", "left_semi"))
    return materialize(found.distinct())


def between(vectors: DataFrame, dims: int, cosine: float, k: int, recall: float, seed: int) -> DataFrame:
    """(u, v): links found between vectors(cid, own, x) of different ``own``, each way."""
    total = vectors.count()
    edges = refine(by_planes(vectors, total, dims, k, seed, planes_for(total, cosine, recall)), vectors, total, k)
    near = edges.where(F.col("sim") >= cosine)
    return near.select("u", "v").union(near.select("v", "u")).distinct()


def in_blocks(vectors: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(cid, links): links of each vector within its component, components in blocks.

    ``members`` is (cid, component) of the components to compare.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).join(vectors, "cid")
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    rows = rows.withColumn("_p", F.explode(each)).select("component", "_p.i", "_p.j", "block", "cid", "n", "x")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, ids, n = (table.column(c).to_numpy() for c in ("block", "cid", "n"))
        x = unit(table.column("x"))
        a, b = block == i, block == j
        linked = x[a] @ x[b].T >= cosine
        if i == j:
            np.fill_diagonal(linked, False)
        links = linked @ n[b]
        out = [(ids[a], links)] + ([] if i == j else [(ids[b], linked.T @ n[a])])
        return pa.table({"cid": pa.array(np.concatenate([c for c, _ in out])), "links": pa.array(np.concatenate([c for _, c in out]), pa.int64())})

    return rows.groupBy("component", "i", "j").applyInArrow(compare, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def audit(vectors: DataFrame, total: int, cosine: float, size: int = AUDIT) -> DataFrame:
    """(cid, true_links): links of about ``size`` vectors, against all rows."""
    share = int(min(1.0, size / max(1, total)) * (1 << 30))
    asked = vectors.where(F.xxhash64("cid", F.lit(7)).bitwiseAND((1 << 30) - 1) < share).select("cid", "x").toArrow()
    if not asked.num_rows:
        return vectors.select("cid", F.lit(0).cast("long").alias("true_links")).limit(0)
    shared = vectors.sparkSession.sparkContext.broadcast((asked.column("cid").to_numpy(), unit(asked.column("x"))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        links = np.zeros(len(ids), np.int64)
        for batch in batches:
            own, n = batch.column("cid").to_numpy(), batch.column("n").to_numpy()
            links += (q @ unit(batch.column("x")).T >= cosine) @ n
            _, mine, theirs = np.intersect1d(ids, own, return_indices=True)
            links[mine] -= n[theirs]
        yield pa.record_batch([pa.array(ids), pa.array(links)], names=["cid", "true_links"])

    return vectors.mapInArrow(compare, "cid long, true_links long").groupBy("cid").agg(F.sum("true_links").alias("true_links"))


def recalled(truth: DataFrame, found: DataFrame) -> float:
    """The least recall of a band of audited vectors, each linked vector weighing alike.

    A band has vectors with about as many links (within a factor of two), so large
    groups cannot hide what is missed in small ones.
    """
    both = truth.where("true_links > 0").join(found, "cid", "left")
    share = F.least("true_links", F.coalesce("links", F.lit(0))) / F.col("true_links")
    bands = both.groupBy(F.floor(F.log2("true_links")).alias("band")).agg(F.avg(share).alias("r"))
    worst = bands.agg(F.min("r")).first()[0]
    return 1.0 if worst is None else worst


def near_duplicates(rows: DataFrame, cosine: float = 0.95, k: int = NEIGHBOURS, recall: float = 0.98, tries: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    x = F.col(vector_col)
    rows = rows.select(F.col(id_col).alias("vec_id"), x.alias("x"))
    sound = F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0)
    rows = rows.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    usual = rows.where("_ok").groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).agg(F.max_by("d", F.struct("c", -F.col("d")))).first()[0]
    rows = rows.withColumn("cid", F.when(F.col("_ok") & (F.size("x") == F.lit(usual)), F.xxhash64("x"))).drop("_ok")
    vectors = materialize(rows.where("cid is not null").groupBy("cid", "x").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n")))
    total = vectors.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    truth = materialize(audit(vectors, total, cosine))
    each = vectors.withColumn("own", F.col("cid"))
    edges = crossing = None
    for attempt in range(tries):
        fresh = by_planes(each, total, usual, k, seed=attempt, planes=planes_for(total, cosine, recall))
        edges = refine(fresh if edges is None else edges.union(fresh), each, total, k)
        near = edges.where(F.col("sim") >= cosine)
        links = near.select("u", "v").union(near.select("v", "u"))
        wide = enlarged(edges, each, total, k, cosine)
        links = links.union(wide).union(wide.select("v", "u"))
        links = materialize((links if crossing is None else links.union(crossing)).distinct())
        full = saturated(edges, k, cosine).withColumnRenamed("u", "node")
        while True:
            tied = materialize(components(links))
            dense = tied.join(full, "node", "left_semi").select("component").distinct()
            members = materialize(tied.join(dense, "component", "left_semi").select(F.col("node").alias("cid"), "component"))
            if members.select("component").distinct().limit(2).count() < 2:
                break
            # a link that full lists left out is between two of these components; each round merges some
            more = materialize(between(vectors.join(members.withColumnRenamed("component", "own"), "cid"), usual, cosine, k, recall, tries + attempt))
            if more.isEmpty():
                break
            crossing = more if crossing is None else crossing.union(more)
            links = materialize(links.union(more).distinct())
        counted = in_blocks(vectors, members, cosine)
        listed = links.join(vectors.select(F.col("cid").alias("v"), "n"), "v").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("listed"))
        found = materialize(listed.join(counted, "cid", "full").select("cid", F.coalesce("links", "listed").alias("links")))
        reached = recalled(truth, found)
        if reached >= recall:
            break
    else:
        logging.getLogger(__name__).warning("recall of the worst band is %.4f after %d attempts, below %.4f", reached, tries, recall)
    named = tied.withColumnRenamed("node", "cid").join(vectors.select("cid", "least_id"), "cid").groupBy("component").agg(F.min("least_id").alias("first_id"))
    whole = vectors.join(found, "cid", "left").join(tied.withColumnRenamed("node", "cid"), "cid", "left").join(named, "component", "left")
    whole = whole.select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("first_id", "least_id").alias("component_id"))
    out = rows.select("vec_id", "cid").join(whole, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))
