"""Best-fit packing of token sequences by patterns of lengths.

The plan looks only at the histogram of piece lengths (at most ``capacity``
numbers): coarse patterns of up to four pieces that fill a sequence get repeat
counts from a non-negative least-squares fit to the histogram, the counts are
rounded down, each repeat is realised with lengths at hand (the last one the
largest that still fits), and what is left is packed best-fit decreasing. The
plan turns into segments "pieces number a to b of length L go to sequences from
s on, at offset o"; pieces are numbered within their length in parallel.

Defined results: a null text is empty, an empty text is one piece with only the
end id; repeated rows are packed each for itself; equal pieces may trade places;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize, small_batches
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token pieces of each document: only longer ones are cut, the first may be shorter.

    With ``keep_ids`` the ids themselves follow as an array.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for part, raw in chunks(batches, "text"):
            ids, n = bpe.encode([x.decode("utf-8", "replace") for x in raw])
            out: list[tuple] = []
            at = 0
            for doc, k in zip(part.column("id").to_pylist(), n.tolist(), strict=True):
                own = np.append(ids[at : at + k], np.uint32(end_id)).astype("<u4")
                at += k
                head = (k + 1) % capacity or capacity
                bounds = [0, *range(head, k + 2, capacity)]
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    out.append((doc, i, a, b - a, zlib.crc32(own[a:b].tobytes()), *([own[a:b].astype(np.int32)] if keep_ids else [])))
            columns = zip(*out, strict=True)
            yield pa.record_batch([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


# ---------------------------------------------------------------- the plan

def patterns(parts: int, most: int = 4) -> list[tuple[int, ...]]:
    """All ways to write ``parts`` as a sum of at most ``most`` positive numbers, falling."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, top: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < most:
            for x in range(min(left, top), 0, -1):
                if x * (most - len(head)) < left:
                    break
                extend((*head, x), left - x, x)

    extend((), parts, parts)
    return found


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that makes ``a @ x`` close to ``b`` in least squares (active sets)."""
    x = np.zeros(a.shape[1])
    passive: list[int] = []
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive.append(best)
        while True:
            z, *_ = np.linalg.lstsq(a[:, passive], b, rcond=None)
            if (z > 0).all():
                break
            old = x[passive]
            low = z <= 0
            step = float(np.min(old[low] / np.maximum(old[low] - z[low], 1e-300)))
            new = old + step * (z - old)
            x[passive] = np.maximum(new, 0)
            drop = [p for p, v, bad in zip(passive, new, low, strict=True) if bad and v <= 1e-12 * max(1.0, float(b.max()))]
            x[drop] = 0
            passive = [p for p in passive if p not in drop] if drop else passive[:-1]
            if not passive:
                z = np.zeros(0)
                break
        x[:] = 0
        x[passive] = z
    return x


class Stock:
    """Counts of pieces by length; finds the largest length that fits."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.bits = sum(1 << n for n, c in counts.items() if c)

    def best(self, room: int, low: int = 1) -> int:
        """The largest length from ``low`` to ``room`` in stock; 0 if there is none."""
        found = (self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1
        return found if found >= low else 0

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.bits &= ~(1 << length)


def plan(histogram: dict[int, int], capacity: int, grain: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences), for all pieces."""
    stock = Stock({n: c for n, c in histogram.items() if c})
    out: list[tuple[tuple[int, ...], int]] = []

    def close(lengths: list[int], most: int | None = None) -> int:
        """Fill up what the lengths leave, repeat as often as stock and ``most`` allow."""
        room = capacity - sum(lengths)
        used = {n: lengths.count(n) for n in lengths}
        while room > 0:
            n = stock.best(room)
            while n and stock.counts[n] <= used.get(n, 0):
                n = stock.best(n - 1) if n > 1 else 0
            if not n:
                break
            lengths.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
        times = min(stock.counts[n] // k for n, k in used.items())
        times = min(times, most) if most else times
        for n, k in used.items():
            stock.take(n, k * times)
        out.append((tuple(lengths), times))
        return times

    step = max(1, capacity // grain)
    classes = np.zeros(grain + 1)
    for n, c in histogram.items():
        classes[-(-n // step) if n < capacity else grain] += c
    kinds = [p for p in patterns(grain) if len(p) > 1 and all(classes[x] for x in p)]
    if kinds:
        a = np.zeros((grain + 1, len(kinds)))
        for j, p in enumerate(kinds):
            for x in p:
                a[x, j] += 1
        b = classes.copy()
        b[grain] = max(0.0, b[grain] - histogram.get(capacity, 0))
        scale = np.sqrt(np.maximum(b, 1.0))[:, None]
        repeats = np.floor(nnls(a / scale, b / scale[:, 0])).astype(np.int64)
        for j in np.argsort([-max(p) for p in kinds], kind="stable"):
            left = int(repeats[j])
            while left > 0:
                lengths: list[int] = []
                used: dict[int, int] = {}
                for x in kinds[j][:-1]:
                    span = [n for n in range((x - 1) * step + 1, min(x * step, capacity) + 1) if stock.counts.get(n, 0) > used.get(n, 0)]
                    if not span:
                        break
                    n = max(span, key=lambda n: (stock.counts[n] - used.get(n, 0), n))
                    lengths.append(n)
                    used[n] = used.get(n, 0) + 1
                if len(lengths) < len(kinds[j]) - 1 or sum(lengths) > capacity:
                    break
                left -= close(lengths, left)
    while stock.bits:
        close([stock.best(capacity)])
    return out


def segments(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first piece number, sequence of that piece, offset, of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in made:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for n, v in runs.items()}  # type: ignore[misc]


def numbered(rows: DataFrame, key: str, order: list[str], most: int, room: int = 2_000) -> DataFrame:
    """Column ``rank``: 0, 1, 2, ... within ``key``, without one task for a hot key.

    Rows of a key are dealt to buckets by a hash of ``order``; counts of buckets
    give each bucket its first number. ``most`` is the largest count of a key.
    """
    spread = F.pmod(F.xxhash64(*order), F.lit(max(1, -(-most // room))))
    rows = rows.withColumn("_b", spread)
    counts = rows.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(key, "_b").orderBy(*order)
    joined = rows.withColumn("_r", F.row_number().over(own) - 1).join(first, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn("rank", (F.col("_first") + F.col("_r")).cast("long")).drop("_b", "_k", "_c", "_first", "_r")


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each piece of ``pieces`` (a stored table) its sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(segments(plan(histogram, capacity)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                first, base, at = runs[n]
                k = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = base[k] + rank[own] - first[k], at[k]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    ranked = numbered(cut, "length", ["doc_id", "piece", "ids_crc32"], max(histogram.values(), default=1))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(assign, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack all documents: one row for each piece with its place in a sequence."""
    return place(materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids)), capacity)
