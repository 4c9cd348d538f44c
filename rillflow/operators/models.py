"""Online models: classifier (AROW), anomaly scorer (LOF), recommender (cosine).

``update`` takes a DataFrame of rows in an order; ``analyze`` adds a column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import erase, exists, shared_dir
from .features import DATUM, vector, with_datum
from .neighbours import search, with_hash

UPDATES = {"CLASSIFIER": ("train",), "ANOMALY": ("add",), "RECOMMENDER": ("update_row",)}
ANALYSES = {"CLASSIFIER": ("classify",), "ANOMALY": ("calc_score",), "RECOMMENDER": ("complete_row_from_id", "complete_row_from_datum")}
NEAREST = 128


class Model:
    """What models share: their rules and the vector of a row."""

    def __init__(self, name: str, rules: list, key: str | None, config: str, call: Callable[[str, list[Column]], Column]):
        self.name, self.rules, self.key, self.call = name, rules, key, call
        self.config = json.loads(config)
        if not isinstance(self.config, dict):
            raise TypeError
        self.parameter = self.config.get("parameter") or {}

    def save(self, spark: SparkSession, folder: str) -> dict:
        """Write what was learned; gives what ``load`` needs beside the folder."""
        rows = self.rows
        if rows is not None:
            rows.write.mode("overwrite").parquet(folder)
        return {"rows": None if rows is None else rows.schema.jsonValue()}

    def load(self, spark: SparkSession, folder: str, record: dict) -> None:
        schema = record["rows"]
        self.rows = None if schema is None else _kept(spark.read.schema(T.StructType.fromJson(schema)).parquet(folder))

    def read(self, df: DataFrame, *hidden: str) -> DataFrame:
        """``df`` with the datum of each row as ``_datum``, and its vector as ``_x``."""
        return with_datum(df, self.rules, self.key, self.call, hidden=hidden).withColumn("_x", vector(F.col("_datum")))


class Classifier(Model):
    """Adaptive regularisation of weights, one example at a time, diagonal covariance.

    With ``parts`` above 1 rows are learned in parts at once, and weights averaged.
    """

    parts = 1

    def __init__(self, *args):
        super().__init__(*args)
        self.state: dict[tuple[str, str], tuple[float, float]] = {}
        self.labels: list[str] = []

    def save(self, spark: SparkSession, folder: str) -> dict:
        rows = [(o, f, w, c) for (o, f), (w, c) in self.state.items()]
        spark.createDataFrame(rows, "label string, feature string, w double, c double").write.mode("overwrite").parquet(folder)
        return {"labels": self.labels}

    def load(self, spark: SparkSession, folder: str, record: dict) -> None:
        self.labels = record["labels"]
        rows = spark.read.schema("label string, feature string, w double, c double").parquet(folder).collect()  # the model
        self.state = {(m["label"], m["feature"]): (m["w"], m["c"]) for m in rows}

    @staticmethod
    def learn(state: dict, labels: list[str], label: str, x: dict[str, float], r: float) -> None:
        """One example; ``state`` holds (weight, variance) by label and feature."""
        if label not in labels:
            labels.append(label)
        own = {f: state.get((label, f), (0.0, 1.0)) for f in x}
        scores = {o: sum(state.get((o, f), (0.0, 1.0))[0] * v for f, v in x.items()) for o in labels if o != label}
        rival = max(scores, key=lambda o: scores[o], default=None)
        other = {f: state.get((rival, f), (0.0, 1.0)) for f in x} if rival is not None else dict.fromkeys(x, (0.0, 1.0))
        margin = sum(own[f][0] * v for f, v in x.items()) - scores.get(rival, 0.0)
        if margin >= 1:
            return
        spread = sum(v * v * (own[f][1] + other[f][1]) for f, v in x.items())
        beta = 1 / (spread + 1 / r)
        alpha = (1 - margin) * beta
        for f, v in x.items():
            w, c = own[f]
            state[label, f] = (w + alpha * c * v, c - beta * c * c * v * v)
            if rival is not None:
                w, c = other[f]
                state[rival, f] = (w - alpha * c * v, c - beta * c * c * v * v)

    def update(self, df: DataFrame, order: list[str]) -> None:
        keys = [f"_o{i}" for i in range(len(order))]
        rows = self.read(df.where(F.col(self.key).isNotNull())).select(F.col(self.key).cast("string").alias("label"), F.col("_x").alias("x"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)))
        if self.parts == 1:
            for part, by in _ranges(rows, keys):
                self._learn_rows(part.coalesce(1).sortWithinPartitions(*by))
        else:
            self._learn_rows(rows.repartitionByRange(self.parts, *keys).sortWithinPartitions(*keys))
        known = {o for o, _ in self.state}
        self.labels = [o for o in self.labels if o in known]

    def _learn_rows(self, rows: DataFrame) -> None:
        """Learn each partition's rows in their order, from what is known so far."""
        r = float(self.parameter.get("regularization_weight", 1.0))
        shared = rows.sparkSession.sparkContext.broadcast((self.state, self.labels))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, labels = dict(shared.value[0]), list(shared.value[1])
            for batch in batches:
                for label, x in zip(batch["label"], batch["x"], strict=True):
                    Classifier.learn(state, labels, label, dict(x), r)
            out = [(o, f, w, c, labels.index(o)) for (o, f), (w, c) in state.items()]
            known = {o for o, _ in state}
            out += [(o, None, None, None, i) for i, o in enumerate(labels) if o not in known]
            yield pd.DataFrame(out, columns=["label", "feature", "w", "c", "rank"])

        made = rows.select("label", "x").mapInPandas(run, "label string, feature string, w double, c double, rank long")
        made = made.groupBy("label", "feature").agg(F.avg("w").alias("w"), F.min("c").alias("c"), F.min("rank").alias("rank")).collect()  # the model
        shared.destroy()
        self.state = {(m["label"], m["feature"]): (m["w"], m["c"]) for m in made if m["w"] is not None}
        rank: dict[str, int] = {}
        for m in made:
            rank[m["label"]] = min(m["rank"], rank.get(m["label"], m["rank"]))
        self.labels = sorted(rank, key=lambda o: (rank[o], o))

    def analyze(self, df: DataFrame, method: str, column: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.state, self.labels))

        def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, labels = shared.value
            kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))
            for batch in batches:
                scores = [[{"label": o, "score": sum(state.get((o, f), (0.0,))[0] * v for f, v in x)} for o in labels] for x in batch.column("_x").to_pylist()]
                names = [n for n in batch.schema.names if n != "_x"]
                yield pa.record_batch([*(batch.column(n) for n in names), pa.array(scores, kind)], names=[*names, column])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return self.read(df).drop("_datum").mapInArrow(classify, f"{kinds}, `{column}` array<struct<label: string, score: double>>")


RANGE = 1 << 19  # rows that one task sorts at most, or about so


def _ranges(rows: DataFrame, keys: list[str]) -> Iterator[tuple[DataFrame, list[str]]]:
    """The rows in ranges of ``keys``, one after the other, and by what a range is sorted.

    Rows are dealt to ranges by many tasks and written to the shared folder, so that the
    task that learns sorts one range at a time. Equal keys go by arrival, and may be cut.
    """
    spark = rows.sparkSession
    n = -(-rows.count() // RANGE)
    if n <= 1:
        yield rows, keys
        return
    by = [*keys, "_t"]
    place = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    dealt = rows.withColumn("_t", F.monotonically_increasing_id())
    try:
        dealt.repartitionByRange(n, *by).withColumn("_p", F.spark_partition_id()).write.partitionBy("_p").parquet(place)
        for i in range(n):
            if exists(spark, f"{place}/_p={i}"):
                yield spark.read.schema(dealt.schema).parquet(f"{place}/_p={i}"), by
    finally:
        erase(spark, place)


class Recommender(Model):
    """Rows by id; a row is completed by the mean of its most similar rows."""

    def __init__(self, *args):
        super().__init__(*args)
        self.rows: DataFrame | None = None

    def update(self, df: DataFrame, order: list[str]) -> None:
        """Insert or replace rows by id; null ids are skipped."""
        new = self.read(df.where(F.col(self.key).isNotNull())).select(F.col(self.key).cast("string").alias("id"), F.col("_datum").alias("datum"), F.struct(*order).alias("_o"))
        new = new.groupBy("id").agg(F.max_by("datum", "_o").alias("datum"))
        old = self.rows.join(new, "id", "left_anti").unionByName(new) if self.rows is not None else new
        self.rows = _kept(old)

    def analyze(self, df: DataFrame, method: str, column: str) -> DataFrame:
        asked = _kept(df.withColumn("_q", F.monotonically_increasing_id()))
        mine = self._stored(df.sparkSession)
        if method == "complete_row_from_id":
            wanted = asked.select("_q", F.coalesce(F.col(self.key).cast("string"), F.lit("NULL")).alias("id")).join(mine, "id").select("_q", "datum")
        else:
            wanted = self.read(asked, "_q").select("_q", F.col("_datum").alias("datum"))
        wanted = _kept(with_hash(wanted.select("_q", F.col("datum.string_values").alias("s"), vector(F.col("datum")).alias("x"))))
        # numbers in the order of ids: of equally similar rows the first ids count
        numbered = mine.select("id", vector(F.col("datum")).alias("x")).repartitionByRange("id").sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("id"), "x")
        full = search(wanted.select("h", "x"), _kept(with_hash(numbered)), NEAREST, "cosine", means=True)
        found = wanted.select("_q", "s", "h").join(full, "h").drop("h")
        empty_s, empty_n = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,double>")
        joined = asked.join(found, "_q", "left")
        return joined.withColumn(column, F.struct(F.coalesce("s", empty_s).alias("string_values"), F.coalesce("n", empty_n).alias("num_values"))).drop("_q", "n", "s")

    def _stored(self, spark: SparkSession) -> DataFrame:
        return self.rows if self.rows is not None else spark.createDataFrame([], f"id string, datum {DATUM}")


class Anomaly(Model):
    """Local outlier factor by exact Euclidean neighbours."""

    def __init__(self, *args):
        super().__init__(*args)
        self.rows: DataFrame | None = None
        self.k = int(self.parameter.get("nearest_neighbor_num", 10))

    def update(self, df: DataFrame, order: list[str]) -> None:
        new = self.read(df).select(F.expr("uuid()").alias("id"), F.col("_x").alias("x"))
        self.rows = _kept(self.rows.unionByName(new) if self.rows is not None else new)

    def analyze(self, df: DataFrame, method: str, column: str) -> DataFrame:
        if self.rows is None:
            return df.withColumn(column, F.lit(1.0))
        asked = _kept(df.withColumn("_q", F.monotonically_increasing_id()))
        mine = _kept(with_hash(self.read(asked, "_q").select("_q", F.col("_x").alias("x"))))
        stored = _kept(with_hash(self.rows.select(F.monotonically_increasing_id().alias("id"), "x")))
        # one search for both: one more neighbour, as a stored row is none of its own
        found = search(stored.select("h", "x").unionByName(mine.select("h", "x")), stored, self.k + 1, "distance")
        lists = lambda near: F.explode(F.slice(near, 1, self.k)).alias("e")
        flat = lambda rows: rows.select("q", F.col("e.id").alias("id"), F.col("e.score").alias("d"))
        own = flat(stored.select(F.col("id").alias("q"), "h").join(found, "h").select("q", lists(F.filter("near", lambda e: e["id"] != F.col("q")))))
        reach = own.groupBy("q").agg(F.max("d").alias("reach")).select(F.col("q").alias("id"), "reach")
        reach = _kept(reach)
        density = lambda near: near.join(reach, "id").groupBy("q").agg(F.try_divide(F.lit(1.0), F.avg(F.greatest("d", "reach"))).alias("lrd"))
        stored_lrd = _kept(density(own).select(F.col("q").alias("id"), F.col("lrd").alias("their")))
        near = flat(mine.select("h").distinct().join(found, "h").select(F.col("h").alias("q"), lists(F.col("near"))))
        score = near.join(stored_lrd, "id").groupBy("q").agg(F.avg("their").alias("their")).join(density(near), "q").select(F.col("q").alias("h"), F.try_divide("their", "lrd").alias("_s"))
        scores = mine.select("_q", "h").join(score, "h").drop("h")
        sound = F.when(F.col("_s").isNull() | F.isnan("_s") | (F.abs("_s") == float("inf")), 1.0).otherwise(F.col("_s"))
        return asked.join(scores, "_q", "left").withColumn(column, sound).drop("_q", "_s")


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage at files in the folder that spark.checkpoint.dir names."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


KINDS = {"CLASSIFIER": Classifier, "ANOMALY": Anomaly, "RECOMMENDER": Recommender}


def highest_score_label(scores: Column) -> Column:
    """The label with the highest score; empty text if there is none."""
    best = F.filter(scores, lambda e: e["score"] == F.array_max(F.transform(scores, lambda s: s["score"])))
    return F.coalesce(F.get(best, F.lit(0))["label"], F.lit(""))
