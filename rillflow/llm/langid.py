"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 code points of the lower-cased
text), weighted by term frequency times inverse document frequency; document
frequencies are counted over all training texts. The weights are learned by
follow-the-regularised-leader with elastic-net penalties, text by text, in ``EPOCHS``
passes over at most about ``SAMPLE`` labelled texts (``LEAST`` of each language at
least), as many of each language as there are, chosen by a hash of their ids. A fifth of
them is kept back to fit the temperature that calibrates the probabilities; its loss
takes one more text of each language to be mistaken, so few texts never make it sure. The
learner runs in one task; the driver gets a row for each language and the model.

Defined results: a null text or one without a letter is ``und`` with score 0; an
empty label column or no training text makes all texts ``und``; rows with a null
language teach nothing; repeated rows are scored each; between languages of equal
score the first in alphabetical order wins; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, small_batches
from .tokens import _LETTER, _classes

SAMPLE = 4096
LEAST = 64
EPOCHS = 8
BITS = 16
LONGEST = 3
UNKNOWN = "und"


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature) of each n-gram, n-grams of each text, and whether it has a letter.

    Each blank character is a feature of its own; an n-gram never leaves its text.
    """
    joined = "\x00".join(texts).lower()
    sizes = [len(t) for t in texts]
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) != sum(sizes) + len(sizes) - 1:  # lower case may be longer
        sizes = [len(t.lower()) for t in texts]
        code = np.frombuffer("\x00".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.array(sizes) + 1)[:-1]
    stops = np.cumsum(np.array(sizes) + 1)[:-1] - 1
    inside = np.ones(len(code), bool)
    inside[stops] = False
    letter = np.bincount(owner[(_classes()[code] == _LETTER) & inside], minlength=len(texts)) > 0
    wide = code.astype(np.uint64) + np.uint64(1)
    found_text, found = [], []
    h = np.zeros(len(code), np.uint64)
    whole = inside.copy()
    for n in range(1, LONGEST + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] * np.uint64(0x100000001B3)) + wide[n - 1 :] + np.uint64(n)
        whole = whole[: len(code) - n + 1] & inside[n - 1 :]
        found.append((h[whole] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32))
        found_text.append(owner[: len(whole)][whole])
    text = np.concatenate(found_text) if found else np.zeros(0, np.int32)
    return text, np.concatenate(found) if found else text, np.bincount(text, minlength=len(texts)), letter


def frequencies(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature, share of the text's n-grams), distinct pairs in order."""
    text, feature, n, _ = ngrams([x.decode("utf-8", "replace") for x in raw])
    pairs, times = np.unique(text.astype(np.int64) << BITS | feature, return_counts=True)
    text = pairs >> BITS
    return text, pairs & ((1 << BITS) - 1), times / np.maximum(n[text], 1)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # by feature and language: weight times inverse document frequency
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text, feature, n, letter = ngrams(texts)
        out = np.empty((len(texts), len(self.langs)))
        for j in range(len(self.langs)):
            out[:, j] = self.bias[j] + np.bincount(text, weights=self.table[j][feature], minlength=len(texts)) / np.maximum(n, 1)
        return out, letter

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, letter = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = np.argmax(p, axis=1)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)], np.where(letter, p.max(axis=1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (class by feature) and biases, by follow-the-regularised-leader.

    Each row is (features, values). A weight stays zero while its sum of
    gradients is within ``l1``.
    """
    size = 1 << BITS
    z, n = np.zeros((classes, size + 1)), np.zeros((classes, size + 1))  # the last feature is the bias

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[:, at], n[:, at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = softmax((w @ x)[None])[0]
            p[labels[i]] -= 1.0
            g = p[:, None] * x
            squares = n[:, at]
            n[:, at] = squares + g * g
            z[:, at] += g - (np.sqrt(n[:, at]) - np.sqrt(squares)) / alpha * w
    w = weights(slice(None))
    return w[:, :size], w[:, size]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search of its logarithm.

    The loss counts one more text for each class, of which the model is as wrong as of
    any class, so that it has a minimum even if no text is mistaken.
    """
    if not len(labels):
        return 1.0
    doubt = logits.shape[1] / (len(labels) + logits.shape[1])

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))
        return float(-(1 - doubt) * p[np.arange(len(labels)), labels].mean() - doubt * p.mean())

    low, high, g = -4.0, 8.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of the documents where ``may_learn`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", "lang", may_learn.alias("_learn")).where("_learn and lang is not null and text is not null")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        texts = 0
        for _, raw in chunks(batches, "text"):
            seen += np.bincount(frequencies(raw)[1], minlength=1 << BITS)
            texts += len(raw)
        used = np.flatnonzero(seen)
        if texts:
            yield pa.record_batch([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(seen[used], texts))], names=["feature", "n"])

    found = rows.select("text").mapInArrow(spread, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most 1 << BITS rows
    at, n = (found.column(c).to_numpy() for c in ("feature", "n"))
    total = int(n[at == -1].sum())
    if not total:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros(0), 1.0)
    idf = np.full(1 << BITS, np.log(1 + total))
    idf[at[at >= 0]] = np.log((1 + total) / (1 + n[at >= 0])) + 1e-3

    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    quota = max(LEAST, sample // len(sizes))
    shares = spark.createDataFrame([(lang, int(min(1.0, quota / n) * (1 << 30))) for lang, n in sizes.items()], "lang string, share long")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) < F.col("share"))
    langs = sorted(sizes)
    shared = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            text, feature, value = frequencies(raw)
            bounds = pa.array(np.searchsorted(text, np.arange(len(raw) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.record_batch([part.column("deal"), part.column("lang"), *lists], names=["deal", "lang", "features", "shares"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, scale = shared.value, 100.0
        read = []
        for batch in batches:
            for deal, lang, f, v in zip(*(batch.column(c) for c in ("deal", "lang", "features", "shares")), strict=True):
                at = f.values.to_numpy()
                read.append((deal.as_py(), langs.index(lang.as_py()), at.copy(), (v.values.to_numpy() * idf[at] * scale).astype(np.float32)))
        read.sort(key=lambda r: (r[0], r[1], len(r[2])))
        kept, back = [r for k, r in enumerate(read) if k % 5], [r for k, r in enumerate(read) if not k % 5]
        if not kept:
            kept, back = read, []
        weights, bias = ftrl([(at, v) for _, _, at, v in kept], np.array([r[1] for r in kept]), len(langs))
        logits = np.array([[weights[j][at] @ v + bias[j] for j in range(len(langs))] for _, _, at, v in back]).reshape(len(back), len(langs))
        t = temperature(logits, np.array([r[1] for r in back], np.int64))
        yield pa.record_batch([pa.array([(weights * idf * scale).tobytes()]), pa.array([bias.tobytes()]), pa.array([t])], names=["weights", "bias", "temperature"])
        del read, kept, back
        give_back()

    vectorised = chosen.select(F.xxhash64("doc_id", "text").alias("deal"), "lang", "text").mapInArrow(vectors, "deal long, lang string, features array<int>, shares array<float>")
    # at most about `sample` rows, or LEAST for each language, go to the learner's task
    made = vectorised.repartition(1).mapInArrow(learn, "weights binary, bias binary, temperature double").first()
    shared.destroy()
    return Model(langs, np.frombuffer(made["weights"]).reshape(len(langs), -1), np.frombuffer(made["bias"]), made["temperature"])


def predict(docs: DataFrame, model: Model, keep: list[str], out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``docs``, the language of each whole text and its probability as ``out``."""
    small_batches(docs.sparkSession)
    reads = "text" if "text" in keep else "_read_text"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, raw in chunks(batches, reads, 1 << 20):
            langs, p = own.predict([x.decode("utf-8", "replace") for x in raw])
            yield pa.record_batch([*(part.column(n) for n in keep), pa.array(langs, pa.string()), pa.array(p, pa.float64())], names=[*keep, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, *([] if "text" in keep else [F.col("text").alias(reads)])).mapInArrow(run, f"{kinds}, {out[0]} string, {out[1]} double")
