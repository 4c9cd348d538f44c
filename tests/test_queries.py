"""Each named query against its SQL in DuckDB."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from rillflow import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    clean = [tuple(round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in Q.ORACLE:
        assert got
        return
    cursor = duck.execute(Q.ORACLE[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    assert plain(got) == plain([tuple(r[named.index(c)] for c in columns) for r in cursor.fetchall()])


def test_anomaly_scores_of_all_rows_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((230, 12))
    x[:, :8] = x[:, :8].round()
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    k = 10
    stored = np.argsort(d, axis=1)[:, :k]
    reach = np.take_along_axis(d, stored, 1)[:, -1]
    lrd = 1 / np.maximum(np.take_along_axis(d, stored, 1), reach[stored]).mean(axis=1)
    np.fill_diagonal(d, 0)  # an asked row finds its stored copy as well
    near = np.argsort(d, axis=1)[:, :k]
    own = 1 / np.maximum(np.take_along_axis(d, near, 1), reach[near]).mean(axis=1)
    got = {r.vec_id: r.score for r in Q.QUERIES["anom_calc_score"](spark, str(tmp_path)).collect()}
    assert len(got) == len(x)
    assert np.allclose([got[i] for i in range(len(x))], lrd[near].mean(axis=1) / own, atol=1e-5)


@pytest.mark.parametrize("name", ["rec_complete_from_id", "rec_complete_from_datum"])
def test_every_part_is_completed(spark, name):
    got = [r.id for r in Q.QUERIES[name](spark, SF).select("id").collect()]
    assert sorted(got) == sorted(str(r.p_partkey) for r in Q.table(spark, SF, "part").select("p_partkey").collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
