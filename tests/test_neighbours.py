"""Exact neighbours against brute force, and how what is shuffled grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import models
from rillflow.operators import neighbours as N


def brute(asked, stored, k, measure):
    """Lists of (id, score) by all pairs; maps as dicts, stored by id."""
    names = sorted({f for x in [*asked, *stored] for f in x})
    a, b = (np.array([[x.get(f, 0.0) for f in names] for x in xs]) for xs in (asked, stored))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        if measure == "cosine":
            dot = a @ b.T
            m = -(dot / np.sqrt((a * a).sum(axis=1))[:, None] / np.sqrt((b * b).sum(axis=1))[None, :])
            m[(dot == 0)] = np.inf
        else:
            m = np.stack([np.sqrt(((b - one) ** 2).sum(axis=1)) for one in a])
    m[~np.isfinite(m)] = np.inf
    order = np.argsort(m, axis=1, kind="stable")[:, :k]
    return [[(j, abs(m[i, j])) for j in row.tolist() if np.isfinite(m[i, j])] for i, row in enumerate(order)]


def vectors():
    rng = np.random.default_rng(5)
    grid = [{"a@num": float(a), "b@num": float(b)} for a, b in rng.integers(0, 12, (500, 2))]  # ties, copies and zeros
    fine = [{"a@num": a, "b@num": b, "c@num": c} for a, b, c in rng.standard_normal((700, 3)).tolist()]
    odd = [{"a@num": float("nan")}, {"a@num": float("inf"), "b@num": 1.0}, {"a@num": 1e200, "b@num": 1e200}, {"a@num": 1e200, "b@num": 1e200}, {}, {"t$x@str": 1.0}, {"t$y@str": 1.0, "a@num": 2.0}]
    return [*grid, *fine, *odd]


@pytest.mark.parametrize("measure", ["cosine", "distance"])
def test_search_is_exact(spark, monkeypatch, measure):
    monkeypatch.setattr(N, "ENTRIES", 700)  # several chunks
    xs = vectors()
    rows = N.with_hash(spark.createDataFrame(list(enumerate(xs)), "id long, x map<string,double>")).localCheckpoint()
    near = {bytes(r.h): r.near for r in N.search(rows.select("h", "x"), rows, 11, measure).collect()}
    expected = brute(xs, xs, 11, measure)
    for r in rows.collect():
        got, own = near[bytes(r.h)], expected[r.id]
        assert len(got) == len(own)
        assert np.allclose([abs(e.score) for e in got], [s for _, s in own], rtol=1e-9, atol=1e-12)
        if measure == "distance":  # equal sums give equal numbers: ids too
            assert [e.id for e in got] == [i for i, _ in own]


def shuffled(spark, do):
    read = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = read()
    do()
    return read() - before


@pytest.mark.parametrize("method", ["complete_row_from_id", "complete_row_from_datum"])
def test_recommender_shuffles_no_row_for_each_block(spark, method):
    def run(n):
        rows = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.rand(1) * 50).alias("u"), (F.rand(2) * 900).alias("v"))
        model = models.Recommender("r", [("all", [], "id")], "id", "{}", None)
        model.update(rows, ["id"])
        assert model.analyze(rows, method, "row").where("size(row.num_values) = 2").count() == n

    few, many = (shuffled(spark, lambda n=n: run(n)) for n in (2048, 16384))
    assert many < 12 * few  # 8 times the rows; with pairs of blocks 64 times


def test_anomaly_is_blind_to_row_numbers_and_stands_copies(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((60, 2)), np.repeat([[9.0, 9.0]], 15, axis=0)])
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "i long, a double, b double").repartition(3).select("i", "a", "b")
    scores = []
    for rules in ([("all", [], "id")], [("columns", ["a"], "id"), ("columns", ["b"], "id")]):
        model = models.Anomaly("a", rules, "i", '{"parameter": {"nearest_neighbor_num": 5}}', None)
        model.update(rows, ["i"])
        scores.append({r.i: r.s for r in model.analyze(rows, "calc_score", "s").collect()})
    assert scores[0] == pytest.approx(scores[1], nan_ok=False)
    assert len(scores[0]) == 75 and all(scores[0][i] == 1.0 for i in range(60, 75))


def test_anomaly_shuffles_no_row_for_each_block(spark):
    def run(n):
        rows = spark.range(n).select("id", (F.rand(1) * 50).alias("u"), (F.rand(2) * 900).alias("v"))
        model = models.Anomaly("a", [("all", [], "id")], "id", "{}", None)
        model.update(rows, ["id"])
        assert model.analyze(rows, "calc_score", "s").where("s > 0").count() == n

    few, many = (shuffled(spark, lambda n=n: run(n)) for n in (2048, 16384))
    assert many < 12 * few
