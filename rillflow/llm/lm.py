"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts up to ``ORDER`` bytes long is counted over all training
texts. A symbol that a context has not seen costs an escape (method D: half a
count of each distinct symbol) to the next shorter context, where the symbols
already ruled out are excluded; below order 0 all remaining bytes are equally
likely. The sum over a text, with its end as one more symbol, is the log10
probability of the lower-cased text. The trie keeps every branch, as a distributed
table. Only the ``1 << SHARE`` most frequent grams are broadcast, with their
probabilities; all others are scored once each by the whole trie, a
bucket of contexts at a time, and joined. ``adaptive`` instead learns within each
text alone.

Beside it a base score: a unigram model of words with add-0.1 smoothing, whose
counts stay a distributed table. Only words as frequent as one in ``1 << WORDS``
are broadcast; all others are joined.

Defined results: a null text is empty, an empty text has the end alone; without
training texts every symbol is equally likely; repeated rows are scored each;
bytes FE and FF, which UTF-8 never has, count as FD; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, small_batches, words

ORDER = 5
SHARE = 19
WORDS = 17
BUCKETS = 1024
START, END, SYMBOLS = 0xFE, 0xFF, 255
END_WORD = 0
_TOP = 8 * ORDER
_CHUNK = 8 << 20


def symbols(text: bytes) -> bytes:
    """The lower-cased bytes of a text."""
    text = text.lower()
    return text.replace(b"\xfe", b"\xfd").replace(b"\xff", b"\xfd") if b"\xfe" in text or b"\xff" in text else text


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, key) of each symbol: from high to low, it and the bytes before it."""
    data = [symbols(x) for x in raw]
    joined = b"".join(bytes([START]) * ORDER + x + bytes([END]) for x in data)
    a = np.frombuffer(joined, np.uint8)
    here = np.flatnonzero(a != START)
    key = a[here].astype(np.uint64) << np.uint64(_TOP)
    for back in range(1, ORDER + 1):
        key |= a[here - back].astype(np.uint64) << np.uint64(_TOP - 8 * back)
    return np.repeat(np.arange(len(data), dtype=np.uint64), [len(x) + 1 for x in data]), key


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts, or sums of weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return keys[first], sums.astype(np.int64)


def count_training(docs: DataFrame, room: int = 3_000_000) -> DataFrame:
    """(kind, key, n): counts of words (kind 0) and of grams (kind 1) of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}

        def merge(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            return tally(keys, n)

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = merge(kind)
            held[kind] = []
            for i in range(0, len(keys), 1 << 18):
                k = keys[i : i + (1 << 18)].view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + (1 << 18)])], names=["kind", "key", "n"])

        for _, raw in chunks(batches, "text", _CHUNK):
            _, word = words(raw)
            held[0].append(tally(np.append(word, np.full(len(raw), END_WORD, np.uint64))))
            held[1].append(tally(grams(raw)[1]))
            for kind in held:
                if sum(len(k) for k, _ in held[kind]) > room:
                    held[kind] = [merge(kind)]
                    if len(held[kind][0][0]) > room // 2:
                        yield from out(kind)
        for kind in held:
            if held[kind]:
                yield from out(kind)

    return docs.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Model:
    """The trie as sorted arrays: per order the branches, and the contexts' escapes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]):
        """levels: (gram, n) by order; contexts: (context, symbols seen)."""
        self.grams, self.log_p, self.contexts, self.log_escape, self.log_left = [], [], [], [], []
        below: tuple[np.ndarray, np.ndarray] | None = None
        for k, ((gram, n), (context, total)) in enumerate(zip(levels, contexts, strict=True)):
            order = np.argsort(gram)
            gram, n = gram[order], n[order]
            own = gram & np.uint64((1 << 8 * k) - 1)
            kept = np.unique(own)
            order = np.argsort(context)
            at = order[np.searchsorted(context, kept, sorter=order)] if len(kept) else np.zeros(0, np.int64)
            where = np.searchsorted(kept, own)
            p = (n - 0.5) / total[at][where] if len(gram) else np.zeros(0)
            escape = 1.0 - np.bincount(where, weights=p, minlength=len(kept))
            left = np.ones(len(kept))
            if below is not None and len(gram):
                left -= np.bincount(where, weights=below[1][np.searchsorted(below[0], gram >> np.uint64(8))], minlength=len(kept))
            self.grams.append(gram)
            self.log_p.append(np.log10(p))
            self.contexts.append(kept)
            self.log_escape.append(np.log10(escape))
            self.log_left.append(np.log10(np.maximum(left, 1e-300)))
            below = (gram, p)
        self.log_rest = -math.log10(SYMBOLS - len(self.grams[0]))

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context."""
        out, left = np.zeros(len(key)), np.zeros(len(key))
        live = np.arange(len(key))
        for k in range(ORDER, -1, -1):
            if not len(live) or not len(self.contexts[k]):
                continue
            gram = key[live] >> np.uint64(8 * (ORDER - k))
            context = gram & np.uint64((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == context
            i = np.minimum(np.searchsorted(self.grams[k], gram), len(self.grams[k]) - 1)
            hit = known & (self.grams[k][i] == gram)
            out[live[hit]] += self.log_p[k][i[hit]] - left[live[hit]]
            miss = known & ~hit
            out[live[miss]] += self.log_escape[k][at[miss]] - left[live[miss]]
            left[live[miss]] = self.log_left[k][at[miss]]
            live = live[~hit]
        out[live] += self.log_rest
        return out

    def texts(self, raw: list[bytes]) -> np.ndarray:
        """log10 probability of each text; equal symbols in equal contexts are scored once."""
        out = np.zeros(len(raw))
        for at in range(0, len(raw), 1 << 16):
            text, key = grams(raw[at : at + (1 << 16)])
            both = np.sort(key << np.uint64(16) | text)
            key = both >> np.uint64(16)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            each = np.repeat(self.score(key[first]), np.diff(np.append(first, len(key))))
            own = np.bincount((both & np.uint64(0xFFFF)).astype(np.int64), weights=each)
            out[at : at + len(own)] = own
        return out


class Usual:
    """The frequent grams with their log10 probabilities; all others are handed on."""

    def __init__(self, gram: np.ndarray, log_p: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.log_p = gram[order], log_p[order]

    def texts(self, raw: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The log10 probability of each text's frequent grams, and (text, gram, times) of the others, by text."""
        text, key = grams(raw)
        both = np.sort(key << np.uint64(16) | text)
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(both)))
        key, text = both[first] >> np.uint64(16), (both[first] & np.uint64(0xFFFF)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.gram, key), max(len(self.gram) - 1, 0))
        hit = self.gram[at] == key if len(self.gram) else np.zeros(len(key), bool)
        out = 0.0 + np.bincount(text[hit], weights=self.log_p[at[hit]] * times[hit], minlength=len(raw))
        order = np.argsort(text[~hit], kind="stable")
        return out, (text[~hit][order], key[~hit][order], times[~hit][order])


def usual_grams(counts: DataFrame) -> Usual:
    """The ``1 << SHARE`` most frequent grams, without those that tie with the next one, scored exactly."""
    known = counts.where("kind = 1")
    # how many grams have each count; distinct counts are at most the root of twice the symbols
    least, room = 1, 1 << SHARE
    for r in sorted(known.groupBy("n").agg(F.count("*").alias("c")).collect(), reverse=True):
        room -= r["c"]
        if room < 0:
            least = r["n"] + 1
            break
    context = F.col("key").bitwiseAND((1 << _TOP) - 1).alias("context")
    often = known.where(F.col("n") >= least).select("key", "n", context)
    often = often.join(known.groupBy(context).agg(F.sum("n").alias("total")), "context").select("key", "n", "total").toPandas()
    gram, n, total = (often[c].to_numpy(np.int64) for c in ("key", "n", "total"))
    return Usual(gram.view(np.uint64), np.log10((n - 0.5) / total))


def score_grams(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, log_p) of all counted grams and of those of ``asked(key)``, by the whole trie.

    The trie is never in one place: all contexts that end with the same two bytes are
    in one bucket, which builds their branches of order 2 and above and scores there
    what is asked. Only orders 0 and 1, at most 2^16 branches, are broadcast.
    """
    known = counts.where("kind = 1").select("key", "n")
    low = known.groupBy(F.shiftrightunsigned("key", 8 * (ORDER - 1)).alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    one = (low["gram"].to_numpy(np.int64).view(np.uint64), low["n"].to_numpy(np.int64))
    shared = counts.sparkSession.sparkContext.broadcast([tally(one[0] >> np.uint64(8), one[1]), tally(*one)])

    def run(table: pa.Table) -> pa.Table:
        key, n = tally(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy())
        seen = n > 0
        levels = [*shared.value, *(tally(key[seen] >> np.uint64(8 * (ORDER - k)), n[seen]) for k in range(2, ORDER + 1))]
        contexts = [tally(gram & np.uint64((1 << 8 * k) - 1), c) for k, (gram, c) in enumerate(levels)]
        return pa.table({"key": pa.array(key.view(np.int64)), "log_p": pa.array(Model(levels, contexts).score(key))})

    ends = F.shiftrightunsigned("key", 8 * (ORDER - 2)).bitwiseAND(0xFFFF)
    rows = known.union(asked.select("key", F.lit(0).cast("long").alias("n")).distinct())
    return rows.groupBy(F.pmod(F.xxhash64(ends), F.lit(BUCKETS)).alias("bucket")).applyInArrow(run, "key long, log_p double")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all texts by models of those where ``held_out`` is false."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    counts = materialize(count_training(rows.where(~F.col("held_out")).select("text")))
    sums = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n, v = sums.get(0, (0, 0))
    word_counts = counts.where("kind = 0").select("key", "n")
    usual = word_counts.where((F.col("n") >= max(1, -(-n >> WORDS))) | (F.col("key") == END_WORD)).toPandas().sort_values("key", key=lambda s: s.astype("uint64"))
    shared = spark.sparkContext.broadcast((usual_grams(counts), usual["key"].to_numpy(np.int64).view(np.uint64), usual["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, key, seen = shared.value
        log_seen = np.log10(seen + 0.1)
        end_at = np.flatnonzero(key == END_WORD)
        end_log, end_known = (log_seen[end_at[0]], 1) if len(end_at) else (-1.0, 0)
        row = count(TaskContext.get().partitionId() << 40)
        for part, raw in chunks(batches, "text", _CHUNK):
            text, h = words(raw)
            at = np.minimum(np.searchsorted(key, h), max(len(key) - 1, 0))
            hit = key[at] == h if len(key) else np.zeros(len(h), bool)
            base = np.bincount(text[hit], weights=log_seen[at[hit]], minlength=len(raw)) + end_log
            known = np.bincount(text[hit], minlength=len(raw)) + end_known
            rare = h[~hit].view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text[~hit], minlength=len(raw))))).astype(np.int32)
            own, (of, gram, times) = model.texts(raw)
            ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(raw))))).astype(np.int32)
            rare_grams = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(times.astype(np.int64))], names=["key", "times"])
            yield pa.record_batch(
                [pa.array([next(row) for _ in raw], pa.int64()), part.column("id"), part.column("held_out"), pa.array(np.bincount(text, minlength=len(raw)) + 1), pa.array(known), pa.array(base), pa.array(own), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare)), pa.ListArray.from_arrays(pa.array(ends), rare_grams)],
                names=["row", "id", "held_out", "n_tokens", "known", "base", "score", "rare", "rare_grams"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = materialize(rows.mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, rare_grams array<struct<key: long, times: long>>"))
    rare = scored.select("row", F.explode("rare").alias("key")).join(word_counts, "key", "left")
    per_text = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_base"), F.count("n").alias("rare_known"))
    # only held-out texts have grams that no training text has
    asked = scored.where(~F.col("held_out").eqNullSafe(False)).select(F.explode("rare_grams.key").alias("key"))
    parts = scored.select("row", F.inline("rare_grams")).join(score_grams(counts, asked), "key")
    per_row = parts.groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("rare_score"))
    below = math.log10(n + 0.1 * (v + 1))
    return scored.drop("rare", "rare_grams").join(per_text, "row", "left").join(per_row, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


class Trie:
    """The same model as a plain trie of dictionaries that learns as it goes."""

    def __init__(self, order: int = ORDER):
        self.order, self.seen = order, {}

    def probability(self, context: bytes, symbol: int) -> float:
        p, gone = 1.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            node = self.seen.get(context[len(context) - k :])
            if not node:
                continue
            total = sum(node.values())
            left = 1.0 - sum(node[s] - 0.5 for s in gone if s in node) / total
            if symbol in node and symbol not in gone:
                return p * (node[symbol] - 0.5) / total / left
            p *= len(node) / 2 / total / left
            gone |= set(node)
        return p / (SYMBOLS - len(gone))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(min(self.order, len(context)) + 1):
            node = self.seen.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def read(self, text: bytes, learn: bool, score: bool = True) -> float:
        """log10 probability of a text and its end; with ``learn`` each symbol is then counted."""
        line = bytes([START]) * self.order + symbols(text) + bytes([END])
        out = 0.0
        for i in range(self.order, len(line)):
            context = line[i - self.order : i]
            out += math.log10(self.probability(context, line[i])) if score else 0.0
            if learn:
                self.learn(context, line[i])
        return out


def adaptive(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): each text coded by a trie that starts empty and learns from it alone.

    A trie grows with its text only, so memory is that of one text.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            yield pa.record_batch([part.column("id"), pa.array([Trie(order).read(x, learn=True) for x in raw], pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, score double")
