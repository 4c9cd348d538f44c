"""Training-data pipeline: documents through five stages to packed sequences.

Each stage takes all documents that the one before kept and learns, where it
learns, from those. Stages 1 to 4 return the columns of documents.

Defined results: documents without a letter are rejected by the first stage (so
are null and empty texts); rows of equal id and text are one document to the third,
and of a group of near copies it keeps the one with the smallest id (one without an
id only where none has one); the fourth repeats documents of
scarce sources and drops none; an empty table passes all stages; columns may have any
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import jaccard, langid, mixing, packing, toxicity
from rillflow.llm.common import discard, materialize
from rillflow.llm.queries import bpe_path


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a recognisable language."""
    model = langid.train(docs, F.lit(True))
    lang, score = fresh(docs, "_stage_lang"), fresh(docs, "_stage_score")
    read = langid.predict(docs, model, docs.columns, (lang, score))
    return read.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= 0.5)).select(*docs.columns)


def nnpu_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that are likelier toxic than not."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score = fresh(docs, "_stage_score")
    return toxicity.score(docs, model, docs.columns, score).where(F.col(score) < 0.5).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    key = fresh(docs, "_stage_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = jaccard.join(keyed, width=5, percent=80, id_col=key).groupBy(key).agg(F.min("component_id").alias("_group"), F.count("*").alias("_copies"))
    ids = keyed.groupBy(key).agg(F.min("doc_id").alias("_id"))
    order = F.struct(F.col("_id").isNull(), "_id", key)
    named = materialize(found.join(ids, key))
    best = named.groupBy("_group").agg(F.min_by(F.struct(key, "_copies"), order).alias("_best"))
    kept = materialize(best.select(f"_best.{key}", "_best._copies"))
    one, several = (kept.where(c).select(key) for c in ("_copies = 1", "_copies > 1"))
    pick = lambda own: jaccard.picked(keyed, key, own, named.select(key).join(own, key, "left_anti"))
    out = pick(one).select(*docs.columns)
    if not several.isEmpty():
        out = out.union(pick(several).dropDuplicates([key]).select(*docs.columns))
    discard(named, kept)
    return out


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of scarce sources until the sources have their target weights."""
    return mixing.apply(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of at most 2048."""
    return packing.pack(docs, bpe_path(), capacity=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("nnpu_toxicity", nnpu_toxicity),
    ("jaccard_join", jaccard_join),
    ("temperature_mixing", temperature_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can express a learned filter; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            discard(before)
    return docs
