"""The classifier learns rows in their order, a range at a time."""

from pyspark.sql import functions as F

from rillflow.operators import models

RULES = [("columns", ["v"], "id"), ("columns", ["u"], "id")]


def rows(spark, n):
    return spark.range(n).select(F.expr("(id * 7919) % 1009").alias("t"), "id", F.concat(F.lit("l"), (F.col("id") * 31 % 5).cast("string")).alias("l"), (F.rand(3) * 4 - 2).alias("v"), (F.rand(4) - 0.5).alias("u")).localCheckpoint()


def learned(df, order):
    model = models.Classifier("m", RULES, "l", '{"parameter": {"regularization_weight": 1.0}}', None)
    model.update(df.select("l", "v", "u", *order), order)
    return model


def test_ranges_are_learned_in_order(spark, monkeypatch):
    monkeypatch.setattr(models, "RANGE", 300)
    df = rows(spark, 2000)
    state, labels = {}, []
    for r in sorted(df.collect(), key=lambda r: (r.t, r.id)):
        models.Classifier.learn(state, labels, r.l, {"v@num": r.v, "u@num": r.u}, 1.0)
    got = learned(df, ["t", "id"])
    assert got.labels == labels
    assert got.state == state
    # rows without an order are cut as well, and learned by arrival
    state, labels = {}, []
    for r in sorted(df.collect(), key=lambda r: r.id):
        models.Classifier.learn(state, labels, r.l, {"v@num": r.v, "u@num": r.u}, 1.0)
    assert learned(df.withColumn("none", F.lit(None).cast("long")), ["none"]).state == state


def test_no_task_sorts_more_than_a_range(spark, monkeypatch):
    monkeypatch.setattr(models, "RANGE", 500)
    most = []
    real = models.Classifier._learn_rows
    monkeypatch.setattr(models.Classifier, "_learn_rows", lambda self, part: (most.append(part.count()), real(self, part))[1])
    learned(rows(spark, 4000), ["t", "id"])
    assert sum(most) == 4000 and max(most) < 1000
