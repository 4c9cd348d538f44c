"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other texts are unlabelled: no text
is taken to be clean. A logistic model over the presence of hashed words and word
beginnings minimises the class-prior-corrected risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

and takes a step against the second term where it is below zero. Every learnable text
is learned from as unlabelled: the texts are dealt at random to parts of about ``PART``
rows, each task descends from the common model over its part, ``BLOCK`` rows at a time,
with numpy, and the models of all blocks are averaged, ``ROUNDS`` times. Positives are at
most about ``SAMPLE`` confirmed texts, chosen by a hash of their ids. The model's size
is fixed: ``FEATURES`` of ``1 << BITS`` hashed features at most, those whose counts over
all texts differ most surely between positives and all texts (``SURE`` deviations).
Every text is scored, whole.

Defined results: a null text is empty, an empty text gets the score of a text
without features; repeated rows are scored each; a label row without a document
(or with a null in doc_id or toxic) is ignored, a document with several labels is
toxic if one says so; without any positive all scores are 0; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, _SPACE, _power, chunks, discard, materialize, mix, small_batches

SAMPLE = 4096
BITS = 18
FEATURES = 4096
SURE = 3.0
PART = 65536
BLOCK = 16384
ROUNDS = 2
STEPS = 75
BEGINNINGS = (3, 4, 5, 6, 8)


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of each word and of each longer word's first bytes.

    Letters A-Z are lower-cased; bytes other than letters, digits and those of
    other alphabets part words too.
    """
    data = np.frombuffer(b"\n".join(raw).lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = ~_WORD[data]
    edge = np.diff(np.concatenate(([True], part, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    scale = _power(_INVERSE, len(data))
    first = np.cumsum([0] + [len(x) + 1 for x in raw[:-1]])
    text = np.searchsorted(first, starts, side="right") - 1
    found = [(text, mix((sums[ends] - sums[starts]) * scale[starts]))]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        at = starts[long]
        found.append((text[long], mix((sums[at + n] - sums[at]) * scale[at] + np.uint64(n))))
    return np.concatenate([t for t, _ in found]), np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for _, h in found])


_WORD = ~_SPACE
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = False


def presence(raw: list[bytes], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, feature) pairs; ``among`` keeps only features it marks."""
    text, feature = features(raw)
    if among is not None:
        kept = among[feature]
        text, feature = text[kept], feature[kept]
    pairs = np.unique(text << BITS | feature)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray  # by feature, zero where it isn't used
    bias: float

    def scores(self, raw: list[bytes]) -> np.ndarray:
        text, feature = presence(raw, self.weights != 0)
        margin = self.bias + np.bincount(text, weights=self.weights[feature], minlength=len(raw))
        return np.where(np.isneginf(margin), 0.0, 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))))


def select(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The features to learn from, by how many of n_p positives and n_u texts have each."""
    rate_p, rate_u = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    gap = np.abs(rate_p - rate_u) / np.sqrt(rate_p * (1 - rate_p) / n_p + rate_u * (1 - rate_u) / max(1, n_u))
    gap[in_p + in_u < min(5, n_p)] = 0
    used = np.argsort(-gap, kind="stable")[:FEATURES]
    return used[gap[used] > SURE] if (gap[used] > SURE).any() else used[:16]


@dataclass
class Rows:
    """Texts as pairs (row, column) of the features they have."""

    row: np.ndarray
    column: np.ndarray
    n: int

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> "Rows":
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return cls(row, np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), len(lists))


def descend(w: np.ndarray, b: float, p: Rows, u: Rows, prior: float, steps: int, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias after ``steps`` of the non-negative risk estimator, by Adam."""
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    margin = lambda x: b + np.bincount(x.row, weights=w[x.column], minlength=x.n)
    back = lambda x, g: np.append(np.bincount(x.column, weights=g[x.row], minlength=len(w)), g.sum()) / x.n
    for step in range(1, steps + 1):
        zp, zu = margin(p), margin(u)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_rest = back(u, sigmoid(zu)) - prior * back(p, sigmoid(zp))
        grad = prior * back(p, sigmoid(zp) - 1) + of_rest if rest >= -beta else -of_rest
        grad[:-1] += decay * w
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE, prior: float | None = None) -> Model:
    """Fit on the documents where ``may_learn`` holds; ``prior`` defaults to the toxic share of their labels."""
    spark = docs.sparkSession
    small_batches(spark)
    nothing = Model(np.zeros(1 << BITS), -np.inf)
    docs = docs.select("doc_id", "text", may_learn.alias("_learn")).where("_learn and doc_id is not null")
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(may_learn)
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first()
    if not toxic:
        return nothing
    prior = toxic / n if prior is None else prior
    share = int(min(1.0, sample / toxic) * (1 << 30))
    # about `sample` ids at most
    chosen = known.where((F.col("toxic") == 1) & (F.xxhash64("doc_id", F.lit(1)).bitwiseAND((1 << 30) - 1) < share)).select("doc_id", F.lit(True).alias("_toxic"))
    rows = docs.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("_toxic", F.lit(False)).alias("toxic"), F.xxhash64("doc_id", "text").alias("deal"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        texts = np.zeros(2, np.int64)
        for part, raw in chunks(batches, "text"):
            text, feature = presence(raw)
            positive = part.column("toxic").to_numpy(zero_copy_only=False)
            seen[0] += np.bincount(feature, minlength=1 << BITS)
            seen[1] += np.bincount(feature[positive[text]], minlength=1 << BITS)
            texts += (len(raw), positive.sum())
        used = np.flatnonzero(seen[0])
        yield pa.record_batch([pa.array(np.append(used, -1).astype(np.int32)), *(pa.array(np.append(x[used], t)) for x, t in zip(seen, texts, strict=True))], names=["feature", "u", "p"])

    counts = rows.mapInArrow(spread, "feature int, u long, p long").groupBy("feature").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toArrow()  # at most 1 << BITS rows
    feature, u, p = (counts.column(c).to_numpy() for c in ("feature", "u", "p"))
    n_u, n_p = (int(x[feature == -1].sum()) for x in (u, p))
    if not n_p or not prior:
        return nothing
    in_u, in_p = np.zeros(1 << BITS), np.zeros(1 << BITS)
    in_u[feature[feature >= 0]], in_p[feature[feature >= 0]] = u[feature >= 0], p[feature >= 0]
    used = np.sort(select(in_p, in_u, n_p, n_u))
    shared = spark.sparkContext.broadcast(used)

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1)
        place[shared.value] = np.arange(len(shared.value))
        for part, raw in chunks(batches, "text"):
            text, found = presence(raw, place >= 0)
            bounds = np.searchsorted(text, np.arange(len(raw) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[found].astype(np.int16)))
            yield pa.record_batch([part.column("toxic"), part.column("deal"), lists], names=["toxic", "deal", "features"])

    reduced = rows.mapInArrow(reduce_texts, "toxic boolean, deal long, features array<smallint>").repartition(max(1, n_u // PART), "deal")
    reduced = materialize(reduced.select("toxic", "features"))
    lists = lambda table: [x.values.to_numpy() for x in table.column("features")]
    positive = spark.sparkContext.broadcast(Rows.of(lists(reduced.where("toxic").toArrow())))  # about `sample` rows of chosen features
    w, b = np.zeros(len(used)), 0.0
    for _ in range(ROUNDS):
        start = spark.sparkContext.broadcast((w, b))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = start.value  # noqa: B023
            held: list[np.ndarray] = []
            texts = 0
            sums = np.zeros(len(w) + 1)

            def step() -> None:
                nonlocal w, b, held, texts, sums
                w, b = descend(w, b, positive.value, Rows.of(held), prior, STEPS)
                sums += np.append(w, b) * len(held)
                texts += len(held)
                held = []

            for batch in batches:
                held += lists(batch)
                if len(held) >= 2 * BLOCK:  # so that no block is much shorter than another
                    later = held[BLOCK:]
                    held = held[:BLOCK]
                    step()
                    held = later
            if held:
                step()
            if texts:
                yield pa.record_batch([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums), pa.array(np.full(len(sums), texts))], names=["at", "value", "texts"])

        sums = reduced.select("features").mapInArrow(learn, "at int, value double, texts long").groupBy("at").agg((F.sum("value") / F.sum("texts")).alias("value")).toArrow()  # a row for each feature of the model
        mean = np.zeros(len(used) + 1)
        mean[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
        w, b = mean[:-1], float(mean[-1])
        start.destroy()
    for x in (positive, shared):
        x.destroy()
    discard(reduced)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights, b)


def score(docs: DataFrame, model: Model, keep: list[str], out: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs``, and the score of each whole text (0 to 1) as ``out``."""
    small_batches(docs.sparkSession)
    reads = "text" if "text" in keep else "_scored_text"
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[model.weights != 0], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shared.value
        weights = np.zeros(1 << BITS)
        weights[at] = values
        own = Model(weights, bias)
        for part, raw in chunks(batches, reads):
            yield pa.record_batch([*(part.column(n) for n in keep), pa.array(own.scores(raw))], names=[*keep, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, *([] if "text" in keep else [F.col("text").alias(reads)])).mapInArrow(run, f"{kinds}, {out} double")
