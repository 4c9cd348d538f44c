"""Statements end to end, against golden values and plain versions."""

import json
import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from rillflow.engine import Engine
from rillflow.functions import aggregates as A
from rillflow.functions.scripts import NODE
from rillflow.operators import features, windows
from rillflow.operators.models import Classifier
from rillflow.plans import parser as P
from pyspark.sql import functions as F

AGES = [21, 22, 23, 24, 21, 18, 22, 31, 23, 19, 24, 26]
GENDERS = "mfffmfmfmmmf"
TIMES = ["21.943", "22.100", "23.000", "24.5", "26.1", "27.25", "28.0", "30.0", "33.3", "36.0", "40.0", "47.0"]


@pytest.fixture()
def people(spark, tmp_path):
    lines = [json.dumps({"gender": g, "age": a, "event_timestamp": f"2014-11-21T14:52:{t}"}) for a, g, t in zip(AGES, GENDERS, TIMES, strict=True)]
    (tmp_path / "data.json").write_text("\n".join(lines))
    made = Engine(spark, output=lambda line: said.append(line))
    said = made.said = []
    return made, f"file://{tmp_path}"


def ok(engine, *texts):
    for t in texts:
        r = engine.execute(t)
        assert r.code == 200, r.body
    return r.body


SOURCE = "CREATE DATASOURCE ds (gender string, age numeric, event_timestamp string) FROM (STORAGE: \"{}\")"


def test_window_statement_golden(people):
    engine, place = people
    ok(engine, SOURCE.format(place), "CREATE STREAM w FROM SLIDING WINDOW (SIZE 4 ADVANCE 1 TUPLES) OVER ds WITH avg(age), maxelem(gender) AS m", "START PROCESSING ds")
    rows = [tuple(r) for r in engine.table("w").collect()]
    want = []
    for i in range(len(AGES) - 3):
        count = Counter(GENDERS[i : i + 4])
        want.append((sum(AGES[i : i + 4]) / 4, max(count, key=lambda g: (count[g], GENDERS[i : i + 4].rindex(g), g))))
    assert rows == want and rows[0] == (22.5, "f")


def test_where_having_concat(people):
    engine, place = people
    ok(engine, SOURCE.format(place), "CREATE STREAM w FROM SLIDING WINDOW (SIZE 4 ADVANCE 1 TUPLES) OVER ds WITH avg(age) AS avg_age, concat(gender) AS c WHERE age > 21 HAVING avg_age < 25", "START PROCESSING ds")
    kept = [(a, g) for a, g in zip(AGES, GENDERS, strict=True) if a > 21]
    want = [(sum(a for a, _ in kept[i : i + 4]) / 4, " ".join(g for _, g in kept[i : i + 4])) for i in range(len(kept) - 3)]
    assert [tuple(r) for r in engine.table("w").collect()] == [w for w in want if w[0] < 25]


def test_select_log_trigger_cascade(people):
    engine, place = people
    ok(
        engine,
        SOURCE.format(place),
        "CREATE STREAM a FROM SELECT gender, age FROM ds WHERE age > 22",
        "CREATE STREAM b FROM SELECT gender, count(*) AS n FROM a GROUP BY gender",
        "LOG STREAM b",
        "CREATE TRIGGER FUNCTION t(x numeric) LANGUAGE Python AS $$return x$$",
        "CREATE TRIGGER ON a FOR EACH ROW WHEN age > 25 EXECUTE t(age)",
        "START PROCESSING ds",
    )
    assert {r.gender: r.n for r in engine.table("b").collect()} == Counter(g for a, g in zip(AGES, GENDERS, strict=True) if a > 22)
    assert engine.said[0].startswith("STREAM: b\ngender string | n bigint")
    assert ok(engine, "STATUS")["sources"] == {"ds": "Running"}
    assert "already" in engine.execute(SOURCE.format(place)).body["result"]
    assert ok(engine, "STOP PROCESSING")["result"].startswith("STOP PROCESSING (processing time: ")
    assert engine.execute("START PROCESSING ds").body["result"] == "cannot start processing a data source in state Finished"
    assert ok(engine, "SHUTDOWN")["result"] == "SHUTDOWN"
    assert engine.execute("STATUS").code == 503


def test_live_hand_over(people, tmp_path, spark):
    engine, place = people
    live = tmp_path / "live"
    live.mkdir()
    old = json.dumps({"gender": "x", "age": 1, "event_timestamp": "2014-11-21T14:52:30.0"})
    new = [json.dumps({"gender": "n", "age": 50 + i, "event_timestamp": f"2014-11-21T14:53:0{i}.0"}) for i in range(4)]
    (live / "a.json").write_text("\n".join([old, *new, "no json"]))
    ok(engine, f'CREATE DATASOURCE ds (gender string, age numeric, event_timestamp string) FROM (STORAGE: "{place}/data.json", STREAM: "file://{live}")', "CREATE STREAM w FROM SLIDING WINDOW (SIZE 4 ADVANCE 4 TUPLES) OVER ds WITH avg(age) AS a", "CREATE STREAM s FROM SELECT gender, age FROM ds", "START PROCESSING ds")
    engine.running.processAllAvailable()
    ok(engine, "STOP PROCESSING")
    assert engine.table("s").where("gender = 'n'").count() == 4 and engine.table("s").where("gender = 'x'").count() == 0
    ages = AGES + [50, 51, 52, 53]
    assert [r.a for r in engine.table("w").collect()] == [sum(ages[i : i + 4]) / 4 for i in range(0, 16, 4)]


def test_restart_goes_on_where_it_stopped(people, tmp_path, spark):
    """Windows, models and rows of a named engine that is started anew equal those of one that ran through."""
    _, place = people
    statements = [
        "CREATE STREAM w FROM SLIDING WINDOW (SIZE 5 ADVANCE 3 TUPLES) OVER ds WITH avg(age) AS a",
        "CREATE STREAM t FROM SLIDING WINDOW (SIZE 2 ADVANCE 1 TIME) OVER ds WITH avg(age) AS a",
        "CREATE STREAM s FROM SELECT age, age, gender FROM ds",
        """CREATE CLASSIFIER MODEL m (label: gender) AS age CONFIG '{"method": "AROW", "parameter": {}}'""",
        "UPDATE MODEL m USING train FROM ds",
    ]

    def line(i: int) -> str:
        return json.dumps({"gender": "fm"[i % 2], "age": 50 + i * i, "event_timestamp": f"2014-11-21T14:55:{i:02}.0"})

    def begin(live, name):
        engine = Engine(spark, output=lambda _: None, name=name)
        ok(engine, f'CREATE DATASOURCE ds (gender string, age numeric, event_timestamp string) FROM (STORAGE: "{place}/data.json", STREAM: "file://{live}")', *statements, "START PROCESSING ds")
        engine.running.processAllAvailable()
        return engine

    def end(engine):
        ok(engine, "STOP PROCESSING")
        shown = {n: sorted(map(tuple, engine.table(n).collect()), key=str) for n in ("w", "t", "s")}
        return shown, engine.models["m"].labels, dict(engine.models["m"].state)

    def files(live, numbers):
        part = live / f".{numbers[0]}"
        part.write_text("\n".join(map(line, numbers)))
        part.rename(live / f"{numbers[0]}.json")

    found = {}
    for name in ("through", "again"):
        live = tmp_path / name
        live.mkdir()
        engine = begin(live, f"{name}-{tmp_path.name}-{time.time_ns()}")
        for numbers in (range(7), range(7, 10), range(10, 24)):
            if name == "again":
                end(engine)
                engine = begin(live, engine.name)
            files(live, numbers)
            engine.running.processAllAvailable()
        found[name] = end(engine)
        if name == "again":
            idle = begin(live, engine.name)  # nothing new: all rows are there
            assert end(idle)[0] == found[name][0]
            statements.pop(0)
            refused = Engine(spark, name=engine.name)
            ok(refused, f'CREATE DATASOURCE ds (gender string, age numeric, event_timestamp string) FROM (STORAGE: "{place}/data.json", STREAM: "file://{live}")', *statements)
            assert "other statements" in refused.execute("START PROCESSING ds").body["result"]
    assert found["through"] == found["again"]
    ages = AGES + [50 + i * i for i in range(24)]
    assert found["again"][0]["w"] == sorted([(sum(ages[i : i + 5]) / 5,) for i in range(0, len(ages) - 4, 3)], key=str)


def test_transform_of_a_stream(spark):
    engine = Engine(spark, output=lambda _: None)
    engine.register("e", spark.createDataFrame([(i, float(i)) for i in range(6)], "id long, x double"), ["id"])
    engine.transform("odd", "e", lambda df: df.where("id % 2 = 1").withColumn("y", F.col("x") * 2))
    ok(engine, "CREATE STREAM w FROM SLIDING WINDOW (SIZE 2 ADVANCE 1 TUPLES) OVER odd WITH avg(y) AS a", "START PROCESSING e")
    assert [r.a for r in engine.table("w").collect()] == [4.0, 8.0]


@pytest.mark.parametrize(
    ("text", "code", "part"),
    [
        ("START PROCESSING nix", 400, "unknown data source: nix"),
        ("STOP PROCESSING", 400, "apparently there was no stream processing running"),
        ("CREATE NONSENSE", 400, "unable to parse queryString"),
        ('CREATE DATASOURCE d FROM (STORAGE: "hdfs:/x")', 400, ""),
        ("CREATE STREAM s FROM SELECT a FROM nix", 400, "not found"),
        ("CREATE STREAM s FROM SLIDING WINDOW (SIZE 2 ADVANCE 1 TUPLES) OVER e WITH nope(x)", 400, "invalid parameter specification: unknown aggregation function: nope"),
        ("CREATE STREAM s FROM SLIDING WINDOW (SIZE 2 ADVANCE 1 TUPLES) OVER e WITH quantile(2.0, x)", 400, "must be in [0,1] range"),
        ("CREATE STREAM s FROM SLIDING WINDOW (SIZE 2 ADVANCE 1 TUPLES) OVER e WITH histogram(1, 2, x)", 400, "wrong type of parameters for histogram"),
        ("CREATE FUNCTION f(a numeric) RETURNS numeric LANGUAGE Ruby AS $$1$$", 400, "only JavaScript is supported"),
        ("CREATE FUNCTION f() RETURNS numeric LANGUAGE Python AS $$return 1$$", 400, "at least one element"),
        ("CREATE FUNCTION f(a numeric) RETURNS numeric LANGUAGE Python AS $$return ($$", 400, ""),
        ("CREATE CLASSIFIER MODEL m (label: l) AS * WITH nope CONFIG '{}'", 400, "unknown feature functions: nope"),
        ("CREATE CLASSIFIER MODEL m (label: l) AS * CONFIG '[]'", 400, "input config is not a JSON object."),
        ("CREATE CLASSIFIER MODEL m (label: l) AS * CONFIG '{'", 400, "input config is not a JSON."),
        ("UPDATE MODEL m USING train FROM e", 400, "model 'm' not found"),
        ("CREATE TRIGGER ON e FOR EACH ROW EXECUTE nope(x)", 400, "no user-defined function named nope"),
        ("CREATE TRIGGER ON e FOR EACH ROW EXECUTE upper(x)", 400, "unintentional Spark SQL builtin function"),
    ],
)
def test_refusals(spark, text, code, part):
    engine = Engine(spark)
    engine.register("e", spark.createDataFrame([(1, 2.0)], "id long, x double"), ["id"])
    r = engine.execute(text)
    assert r.code == code and part in r.body["result"], r.body


def test_requests(spark):
    engine = Engine(spark)
    assert engine.request("{").code == 400 and engine.request("{}").code == 400
    assert engine.request('{"query": "STATUS"}').code == 200


def test_parser_shapes():
    s = P.parse("CREATE RECOMMENDER MODEL m (id: 名前) AS a*, *z WITH unigram, (b, c) WITH f, * CONFIG '{\"x\": 1}'")
    assert s.key == ("id", "名前") and s.features == [("prefix", ["a"], "id"), ("suffix", ["z"], "unigram"), ("columns", ["b", "c"], "f"), ("all", [], "id")]
    s = P.parse("CREATE STREAM x FROM SLIDING WINDOW (SIZE 4 ADVANCE 3 TIME) OVER y WITH AVG(a) AS q, concat(', ', b) WHERE b = 'x, y' AND (c > 1) HAVING q % 2 = 0")
    assert s.kind == "time" and s.aggregates[1] == ("concat", ["', '", "b"], None) and s.where == "b = 'x, y' AND (c > 1)" and s.having == "q % 2 = 0"
    s = P.parse("CREATE FUNCTION f(a numeric, b string) RETURNS string LANGUAGE JavaScript AS $$ return '$' + a; $$")
    assert s.body == " return '$' + a; "
    assert P.parse("create stream s from select a, `b c` from t order by a").sql == "select a, `b c` from t order by a"
    assert P.parse("CREATE STREAM s FROM ANALYZE a BY MODEL m USING classify AS c").column == "c"
    for bad in ("", "LOG STREAM", "START PROCESSING a b", "CREATE DATASOURCE d (a decimal) FROM (STORAGE: 'x')", "SELECT 1"):
        with pytest.raises(P.BadStatement):
            P.parse(bad)


@pytest.mark.parametrize(("size", "advance"), [(1, 1), (3, 2), (4, 5), (2, 7), (5, 1)])
def test_window_membership(spark, size, advance):
    n = 23
    df = spark.range(n).select(F.col("id"), F.explode(windows.windows_of(F.col("id"), size, advance)).alias("k"))
    got = {}
    for r in df.collect():
        got.setdefault(r.k, []).append(r.id)
    want = {k: [x for x in range(k * advance, min(n, k * advance + size))] for k in range(n)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_numbers_of_text_keys_and_equal_first_columns(spark):
    values = [None, "", "a", "b", "ü"]
    rows = [(None, values[(i * 7) % 5], float("nan") if i % 11 == 0 else None if i % 13 == 0 else i % 4 / 2, i) for i in range(400)]
    df = spark.createDataFrame(rows, "t timestamp, s string, d double, i long").repartition(3)
    for order in (["t", "i"], ["s", "i"], ["t", "s", "d", "i"]):
        got = windows.numbered(df, order, parts=8).orderBy("_x").collect()
        assert [r._x for r in got] == list(range(400))
        assert [r.i for r in got] == [r.i for r in df.orderBy(*(F.col(c).asc_nulls_first() for c in order)).collect()]
    assert windows.numbered(df.limit(0), ["s"]).count() == 0
    assert len(windows._bounds(df, ["t", "i"], 8)) == 7


def test_numbering_is_total_and_in_order(spark):
    df = spark.createDataFrame([(float(x % 7), x) for x in range(100)] + [(None, -1)], "a double, b long").repartition(5)
    rows = sorted((r._x, r.a if r.a is not None else -1.0, r.b) for r in windows.numbered(df, ["a", "b"]).collect())
    assert [r[0] for r in rows] == list(range(101)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


DOUBLES = [(1, 2, 1.0), (1, 9, 2.0), (1, 8, 1.5), (1, 100, 2.5), (2, 1, 3.0)]
STRINGS = [(1, 2, "a"), (1, 9, "b"), (1, 8, "a"), (1, 100, "a"), (2, 1, "c")]


def aggregated(spark, rows, kind, name, constants=()):
    df = spark.createDataFrame(rows, f"_win long, _ord long, _v0 {kind}")
    out = A.aggregate(df, ["_win"], [A.Aggregate.of(name, list(constants), "v", "o")])
    return {r["_win"]: r["o"] for r in out.collect()}


def test_aggregate_golden(spark):
    near = lambda a, b: all(math.isclose(a[k], b[k], abs_tol=1e-6) for k in b)
    assert near(aggregated(spark, DOUBLES, "double", "avg"), {1: 1.75, 2: 3.0})
    assert near(aggregated(spark, DOUBLES, "double", "stddev"), {1: 0.559017, 2: 0.0})
    assert near(aggregated(spark, DOUBLES, "double", "quantile"), {1: 2.0, 2: 3.0})
    line = aggregated(spark, DOUBLES, "double", "linapprox")
    assert (line[1].a, line[1].b) == (0.5, 1.0) and math.isnan(line[2].a) and math.isnan(line[2].b)
    assert aggregated(spark, DOUBLES, "double", "histogram", [1.0, 2.0, 3]) == {1: [0.0, 0.5, 0.5], 2: [0.0, 0.0, 1.0]}
    assert aggregated(spark, STRINGS, "string", "concat", [""]) == {1: "aaba", 2: "c"}
    assert aggregated(spark, STRINGS, "string", "maxelem") == {1: "a", 2: "c"}
    for text, best in (("ab", "b"), ("aba", "a"), ("abab", "b"), ("fmfm", "m")):
        assert aggregated(spark, [(0, i, c) for i, c in enumerate(text)], "string", "maxelem") == {0: best}


def test_transforms_golden(spark):
    assert A.haar(np.array([3.0, 1, 0, 4, 8, 6, 9, 9])) == [5, -3, 0, -1, 1, -2, 1, 0]
    assert A.haar(np.array([9.0, 7, 3, 5, 6, 10, 2, 6])) == [6, 0, 2, 2, 1, -1, -2, -2]
    assert A.haar(np.array([4.0])) == [4.0]
    rows = [(1, i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9])]
    got = aggregated(spark, rows, "double", "fourier")[1]
    x = [3, 1, 4, 1, 5, 9, 0, 0]
    want = [sum(v * np.exp(2j * np.pi * j * k / 8) for j, v in enumerate(x)) / 8 for k in range(8)]
    assert np.allclose(np.array(got.re) + 1j * np.array(got.im), want)
    ten = [(1, i, float(i)) for i in range(10)]
    assert np.allclose(aggregated(spark, ten, "double", "histogram", [0.0, 10.0, 7])[1], [0, 0.2, 0.2, 0.2, 0.2, 0.2, 0])
    assert np.allclose(aggregated(spark, ten, "double", "histogram", [1.0, 1.0, 2])[1], [0.1, 0.9])


def test_not_finite_is_an_error(spark):
    with pytest.raises(Exception, match="not finite"):
        aggregated(spark, [(1, 1, float("nan"))], "double", "avg")


def test_property_quantile_and_maxelem(spark):
    rnd = random.Random(3)
    rows = [(k, i, float(rnd.randint(0, 5))) for k in range(8) for i in range(rnd.randint(1, 20))]
    for q in (0.0, 0.3, 0.5, 1.0):
        want = {}
        for k in range(8):
            v = sorted(x for w, _, x in rows if w == k)
            want[k] = v[math.floor((len(v) - 1) * q + 0.5)]
        assert aggregated(spark, rows, "double", "quantile", [q]) == want


def test_first_example_of_the_classifier():
    state, labels = {}, []
    for label, x in (("p", {"a": 1.0, "b": 1.0}), ("q", {"b": 1.0})):
        Classifier.learn(state, labels, label, x, 1.0)
    assert labels == ["p", "q"] and math.isclose(state["p", "a"][0], 0.2) and state["q", "b"][0] > 0 > state["p", "b"][0] - 0.2


def test_classifier_through_statements(spark):
    rows = [(i, "tall" if i % 2 else "small", float(i % 2), "xy" if i % 2 else "zw") for i in range(40)]
    said = []
    engine = Engine(spark, output=said.append)
    engine.register("e", spark.createDataFrame(rows, "id long, kind string, size double, word string"), ["id"])
    ok(engine, """CREATE CLASSIFIER MODEL m (label: kind) AS size, word WITH unigram CONFIG '{"method": "AROW", "parameter": {"regularization_weight": 1.0}}'""", "CREATE STREAM c FROM ANALYZE e BY MODEL m USING classify", "CREATE STREAM before FROM SELECT highestScoreLabel(classify) AS l FROM c", "LOG STREAM before", "UPDATE MODEL m USING train FROM e", "CREATE STREAM after FROM SELECT kind, highestScoreLabel(classify) AS l FROM c", "START PROCESSING e")
    assert all(r.kind == r.l for r in engine.table("after").collect())
    assert set(said[0].split("\n")[2:]) == {""}
    out = ok(engine, """ANALYZE '{"size": 1, "word": "xy"}' BY MODEL m USING classify""")["result"]["predictions"]
    assert max(out, key=lambda p: p["score"])["label"] == "tall"


def test_recommender_and_anomaly(spark):
    rows = [(f"r{i}", float(i), float(2 * i)) for i in range(10)] + [(None, 1.0, 1.0)]
    engine = Engine(spark)
    engine.register("e", spark.createDataFrame(rows, "id string, a double, b double"), ["id"])
    ok(engine, "CREATE RECOMMENDER MODEL r (id: id) AS * CONFIG '{}'", "CREATE ANOMALY MODEL x AS a, b CONFIG '{\"parameter\": {\"nearest_neighbor_num\": 3}}'", "UPDATE MODEL r USING update_row FROM e", "UPDATE MODEL x USING add FROM e", "START PROCESSING e")
    near = ok(engine, "ANALYZE 'r3' BY MODEL r USING complete_row_from_id")["result"]["num_values"]
    assert math.isclose(near["a"], 5.0) and math.isclose(near["b"], 10.0)  # r0 has no direction
    assert ok(engine, "ANALYZE '{\"a\": 100, \"b\": 0}' BY MODEL x USING calc_score")["result"]["score"] > 2


def test_feature_rules(spark):
    df = spark.createDataFrame([("abc", "bar bar", 27, 1.23, True)], "label string, foo string, hoge int, f double, flag boolean")
    names = lambda rules: {(r.k, r.v) for r in features.with_datum(df, rules, "label").select(F.explode(features.vector(F.col("_datum"))).alias("k", "v")).collect()}
    assert names([("all", [], "id")]) == {("foo$bar bar@str", 1.0), ("hoge@num", 27.0), ("f@num", 1.23)}
    assert names([("columns", ["foo"], "unigram")]) == {(f"foo-unigram-conv${c}@unigram", float(n)) for c, n in Counter("bar bar").items()}
    assert names([("prefix", ["ho"], "id"), ("suffix", ["o"], "id")]) == {("hoge@num", 27.0), ("foo$bar bar@str", 1.0)}
    with pytest.raises(features.BadFeature, match="column named 'x' not found"):
        names([("columns", ["x"], "id")])


@pytest.mark.skipif(NODE is None, reason="node is not installed")
def test_javascript_functions(spark):
    engine = Engine(spark)
    engine.register("e", spark.createDataFrame([(1, "ab"), (2, "c")], "id long, s string"), ["id"])
    ok(engine, "CREATE FUNCTION f(s string, n numeric) RETURNS string LANGUAGE JavaScript AS $$ return Array(n + 1).join(s); $$", "CREATE FUNCTION g(n numeric) RETURNS numeric LANGUAGE JavaScript AS $$ if (n > 1) { throw 1; } return n * 2; $$", "CREATE FEATURE FUNCTION h(s string) LANGUAGE JavaScript AS $$ return {x: s.length, y: s}; $$", "CREATE CLASSIFIER MODEL m (label: s) AS s WITH h CONFIG '{}'", "CREATE STREAM o FROM SELECT id, f(s, id) AS r, g(id) AS d FROM e", "START PROCESSING e")
    assert [tuple(r) for r in engine.table("o").orderBy("id").collect()] == [(1, "ab", 2.0), (2, "cc", 0.0)]
    assert engine.execute("CREATE FUNCTION f(a numeric) RETURNS numeric LANGUAGE JavaScript AS $$ return ( $$").code == 400
    df = spark.createDataFrame([("l", "abc")], "label string, s string")
    datum = features.with_datum(df, [("columns", ["s"], "h")], "label", engine._feature, "d").first().d
    assert datum.num_values == {"h#s#x": 3.0} and datum.string_values == {"h#s#y": "abc"}
