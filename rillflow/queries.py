"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.scripts import Script
from .operators import features, models
from .sources import uris
from .sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the source ``events``, in the order of time and id."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    made = Engine(spark, output=lambda line: None)
    events = table(spark, sf_dir, "events")
    made.register("events", events.withColumn("event_timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), ["ts", "event_id"])
    return made


def run(made: Engine, *statements: str) -> Engine:
    for s in [*statements, "START PROCESSING events"]:
        said = made.execute(s)
        if said.code != 200:
            raise RuntimeError(f"{s}: {said.body}")
    return made


def statements(*texts: str, of: str = "s", select: list[str] | None = None) -> Query:
    """A query that runs statements over events and gives the rows of a stream."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(engine(spark, sf_dir), *texts).table(of)
        return out.selectExpr(*select) if select else out

    return query


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


# ---------------------------------------------------------------- sliding windows

def _windows(size: int, advance: int, where: str = "true", columns: str = "*") -> str:
    """SQL of (k, pos, columns) of complete count windows."""
    return f"""
WITH x AS (SELECT {columns}, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events WHERE {where}),
t AS (SELECT count(*) AS n FROM x),
k AS (SELECT unnest(range(0, CAST((SELECT n FROM t) / {advance} AS BIGINT) + 1)) AS k),
w AS (SELECT k.k, x.i - k.k * {advance} AS pos, x.* FROM k JOIN x ON x.i >= k.k * {advance} AND x.i < k.k * {advance} + {size}
      WHERE k.k * {advance} + {size} <= (SELECT n FROM t))"""


def window(name: str, size: int, advance: int, aggs: str, select: list[str], sql: str, where: str | None = None, having: str | None = None) -> None:
    text = f"CREATE STREAM s FROM SLIDING WINDOW (SIZE {size} ADVANCE {advance} TUPLES) OVER events WITH {aggs}"
    text += f" WHERE {where}" if where else ""
    text += f" HAVING {having}" if having else ""
    add(name, statements(text, select=select), _windows(size, advance, where or "true") + sql)


window("win_tuples_avg_stddev", 4, 3, "avg(value) AS a, stddev(value) AS d, maxelem(event_type) AS m", ["round(a, 6) AS a", "round(d, 6) AS d", "m"], """
, c AS (SELECT k, event_type, count(*) AS n, max(pos) AS p FROM w GROUP BY ALL)
SELECT a, d, m FROM (SELECT k, round(avg(value), 6) AS a, round(stddev_pop(value), 6) AS d FROM w GROUP BY k)
JOIN (SELECT k, arg_max(event_type, n * 1000 + p) AS m FROM c GROUP BY k) USING (k)""")
for _name, _p in (("win_tuples_quantile", 0.5), ("win_tuples_quantile_p90", 0.9)):
    window(_name, 5, 2, f"quantile({_p}, value) AS q", ["round(q, 6) AS q"], f"""
SELECT round(list_sort(list(value))[CAST(floor((count(*) - 1) * {_p} + 0.5) AS BIGINT) + 1], 6) AS q FROM w GROUP BY k""")
window("win_tuples_linapprox", 4, 3, "linapprox(value) AS l", ["round(l.a, 6) AS a", "round(l.b, 6) AS b"], """
SELECT round(regr_slope(value, pos), 6) AS a, round(regr_intercept(value, pos), 6) AS b FROM w GROUP BY k""")
_FOURIER = "SELECT " + ", ".join(f"round(sum(value * cos(2 * pi() * pos * {k} / 8)) / 8, 6) + 0.0 AS re{k}, round(sum(value * sin(2 * pi() * pos * {k} / 8)) / 8, 6) + 0.0 AS im{k}" for k in (0, 1, 3)) + " FROM w GROUP BY k"
window("win_tuples_fourier", 6, 4, "fourier(value) AS f", [f"round(f.{c}[{k}], 6) + 0.0 AS {c}{k}" for k in (0, 1, 3) for c in ("re", "im")], _FOURIER)
window("win_tuples_wavelet", 4, 3, "wavelet(value) AS v", [f"round(v[{i}], 6) AS v{i}" for i in range(4)], """
, p AS (SELECT k, max(value) FILTER (pos = 0) AS a, max(value) FILTER (pos = 1) AS b, max(value) FILTER (pos = 2) AS c, max(value) FILTER (pos = 3) AS d FROM w GROUP BY k)
SELECT round((a + b + c + d) / 4, 6) AS v0, round((a + b - c - d) / 4, 6) AS v1, round((a - b) / 2, 6) AS v2, round((c - d) / 2, 6) AS v3 FROM p""")


def _bins(low: float, high: float, bins: int) -> str:
    edges = [low + i * (high - low) / (bins - 2) for i in range(bins - 1)] if bins > 2 else [low]
    tests = [f"value < {edges[0]!r}"] + [f"value >= {a!r} AND value < {b!r}" for a, b in zip(edges[:-1], edges[1:], strict=True)] + [f"value >= {edges[-1]!r}"]
    return "SELECT " + ", ".join(f"round(count(*) FILTER ({t}) / count(*), 6) AS h{i}" for i, t in enumerate(tests)) + " FROM w GROUP BY k"


for _name, _args, _form in (("win_tuples_histogram", "", (0.1, 0.9, 10)), ("win_tuples_histogram_bins", "4, ", (0.1, 0.9, 4)), ("win_tuples_histogram_bounds", "10.0, 90.0, ", (10.0, 90.0, 10)), ("win_tuples_histogram_full", "10.0, 90.0, 5, ", (10.0, 90.0, 5))):
    window(_name, 8, 5, f"histogram({_args}value) AS h", [f"round(h[{i}], 6) AS h{i}" for i in range(_form[2])], _bins(*_form))
window("win_tuples_concat", 4, 3, "concat(event_type) AS c", ["c"], "SELECT string_agg(event_type, ' ' ORDER BY pos) AS c FROM w GROUP BY k")
window("win_tuples_concat_sep", 3, 1, "concat('/', event_type) AS c", ["c"], "SELECT string_agg(event_type, '/' ORDER BY pos) AS c FROM w GROUP BY k")
_MAXELEM = ", c AS (SELECT k, event_type, count(*) AS n, max(pos) AS p FROM w GROUP BY ALL) SELECT arg_max(event_type, n * 1000 + p) AS m FROM c GROUP BY k"
window("win_tuples_maxelem", 7, 3, "maxelem(event_type) AS m", ["m"], _MAXELEM)
window("win_tuples_gap", 3, 5, "avg(value) AS a", ["round(a, 6) AS a"], "SELECT round(avg(value), 6) AS a FROM w GROUP BY k")
window("win_tuples_tumbling", 5, 5, "avg(value) AS a", ["round(a, 6) AS a"], "SELECT round(avg(value), 6) AS a FROM w GROUP BY k")
window("win_tuples_where", 4, 1, "avg(value) AS a", ["round(a, 6) AS a"], "SELECT round(avg(value), 6) AS a FROM w GROUP BY k", where="value > 20")
window("win_tuples_having", 4, 1, "avg(value) AS a", ["round(a, 6) AS a"], "SELECT round(avg(value), 6) AS a FROM w GROUP BY k HAVING avg(value) < 50", having="a < 50")


def _times(size: int, advance: int) -> str:
    return f"""
WITH x AS (SELECT *, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events),
w AS (SELECT *, unnest(range(greatest(0, CAST(ceil((ms - {size}000 + 1) / {advance}000) AS BIGINT)), CAST(floor(ms / {advance}000) AS BIGINT) + 1)) AS k FROM x)
SELECT strftime(make_timestamp(k * {advance}000000), '%Y-%m-%dT%H:%M:%S.%g') AS event_timestamp, """


for _name, _size, _advance in (("win_time_avg", 3600, 1800), ("win_time_gap", 600, 1800)):
    add(_name, statements(f"CREATE STREAM s FROM SLIDING WINDOW (SIZE {_size} ADVANCE {_advance} TIME) OVER events WITH avg(value) AS a", select=["event_timestamp", "round(a, 6) AS a"]), _times(_size, _advance) + "round(avg(value), 6) AS a FROM w GROUP BY k")
add("win_time_multi", statements("CREATE STREAM s FROM SLIDING WINDOW (SIZE 7200 ADVANCE 3600 TIME) OVER events WITH avg(value) AS a, stddev(value) AS d, quantile(value) AS q, concat('', event_type) AS c", select=["event_timestamp", "round(a, 6) AS a", "round(d, 6) AS d", "round(q, 6) AS q", "c"]), _times(7200, 3600) + "round(avg(value), 6) AS a, round(stddev_pop(value), 6) AS d, round(list_sort(list(value))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS BIGINT) + 1], 6) AS q, string_agg(event_type, '' ORDER BY ms, event_type) AS c FROM w GROUP BY k")
add("win_cascade", statements("CREATE STREAM v FROM SELECT ts, event_id, value * 2 AS twice FROM events WHERE event_type <> 'click'", "CREATE STREAM w FROM SLIDING WINDOW (SIZE 4 ADVANCE 2 TUPLES) OVER v WITH avg(twice) AS a", "CREATE STREAM s FROM SELECT round(a, 6) AS a FROM w WHERE a > 80"), _windows(4, 2, "event_type <> 'click'") + "SELECT round(avg(value * 2), 6) AS a FROM w GROUP BY k HAVING avg(value * 2) > 80")


# ---------------------------------------------------------------- SELECT

def select(name: str, spark_sql: str, duck_sql: str | None = None, oracle: bool = True) -> None:
    tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        for t in tables:
            if t in spark_sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    add(name, query, (duck_sql or spark_sql) if oracle else None)


select("sel_project_filter", "SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
select("sel_star", "SELECT n_nationkey AS k, * FROM nation")
select("sel_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
select("sel_case_cast", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class, CAST(p_retailprice AS BIGINT) AS price FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class, CAST(trunc(p_retailprice) AS BIGINT) AS price FROM part")
select("sel_predicates", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11', 'Brand#12') OR p_name LIKE '%a%' AND NOT p_type IS NULL")
select("sel_string_math", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, substring(c_name, 1, 5) AS s, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS r, c_custkey % 7 AS m FROM customer")
select("sel_conditional", "SELECT c_custkey, if(c_acctbal < 0, 'debt', 'fine') AS state, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
select("sel_rlike", "SELECT p_partkey FROM part WHERE p_brand RLIKE '[0-9]*5$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[0-9]*5$')")
select("sel_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
select("sel_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
select("sel_approx_count", "SELECT o_orderstatus, approx_count_distinct(o_custkey) AS n FROM orders GROUP BY o_orderstatus", oracle=False)
select("sel_first_last", "SELECT DISTINCT l_orderkey, first(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS f, last(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM lineitem", "SELECT l_orderkey, arg_min(l_linenumber, l_linenumber) AS f, arg_max(l_linenumber, l_linenumber) AS l FROM lineitem GROUP BY l_orderkey")
select("sel_join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
select("sel_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT OUTER JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
select("sel_join_right", "SELECT n_name, s_name FROM supplier RIGHT OUTER JOIN nation ON s_nationkey = n_nationkey")
select("sel_join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 3")
select("sel_join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
select("sel_join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
select("sel_join_cross", "SELECT r_name, n_name FROM region, nation")
select("sel_union_all", "SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) AS t")
select("sel_union", "SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) AS t")
select("sel_intersect", "SELECT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) AS t")
select("sel_except", "SELECT k FROM (SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation) AS t")
select("sel_subquery", "SELECT t.p_brand, t.n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) AS t WHERE t.n > 3")
select("sel_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("sel_join_self", statements("CREATE STREAM a FROM SELECT event_id, user_id FROM events WHERE value > 90", "CREATE STREAM b FROM SELECT event_id AS other, user_id AS u FROM events WHERE value < 10", "CREATE STREAM s FROM SELECT event_id, other FROM a JOIN b ON user_id = u"), "SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.value > 90 AND b.value < 10")


# ---------------------------------------------------------------- sources

def _json(kinds: list[tuple[str, str]]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "events").select(F.col("props").alias("value"), "event_id")
        return uris.rows(lines, uris.schema_of(kinds), ["event_id"])

    return query


add("src_json_schema", _json([("k", "numeric")]), "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
add("src_json_missing", _json([("k", "numeric"), ("absent", "string")]), "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")


def _handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that reads stored rows (here: even ids) and then live ones that come after them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_timestamp"))
    place = f"{shared_dir(spark)}/handover-{uuid.uuid4().hex}"
    place = place if ":/" in place else f"file://{place}"
    for name, part in (("stored", "event_id % 2 = 0"), ("live", "event_id % 2 = 1")):
        rows.where(part).select(F.to_json(F.struct("event_id", "event_timestamp")).alias("value")).write.text(f"{place}/{name}")
    place = place if place.startswith("file://") else place.replace("file:/", "file:///")
    made = Engine(spark, output=lambda line: None)
    run(made, f'CREATE DATASOURCE events (event_id numeric, event_timestamp string) FROM (STORAGE: "{place}/stored", STREAM: "{place}/live")', "CREATE STREAM s FROM SELECT CAST(event_id AS BIGINT) AS event_id FROM events")
    made.running.processAllAvailable()
    made.execute("STOP PROCESSING")
    return made.table("s").select("event_id")


add("src_handover_dedup", _handover, "SELECT event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 2 = 1 AND ts > (SELECT max(ts) FROM events WHERE event_id % 2 = 0)")


# ---------------------------------------------------------------- functions, triggers, logs

def _function(kind: str, body: str, call: str, columns: str) -> Query:
    return statements(f"CREATE FUNCTION f(v numeric, t string) RETURNS {kind} LANGUAGE Python AS $${body}$$", f"CREATE STREAM s FROM SELECT event_id, {call} AS r{columns} FROM events")


add("udf_scalar_numeric", _function("numeric", "return v * 2 + len(t)", "round(f(value, event_type), 6)", ""), "SELECT event_id, round(value * 2 + length(event_type), 6) AS r FROM events")
add("udf_scalar_string", _function("string", "return t.upper() + '!'", "f(value, event_type)", ""), "SELECT event_id, upper(event_type) || '!' AS r FROM events")
add("udf_scalar_boolean", _function("boolean", "return v > 50", "f(value, event_type)", ""), "SELECT event_id, value > 50 AS r FROM events")
add("udf_error_default", _function("numeric", "return 1 / (0 if t == 'click' else 1)", "f(value, event_type)", ""), "SELECT event_id, CASE WHEN event_type = 'click' THEN 0.0 ELSE 1.0 END AS r FROM events")


def _trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arguments of all calls of a trigger with a condition."""
    made, calls = engine(spark, sf_dir), []
    made.fired = lambda _, df: calls.append(models._kept(df))
    run(made, "CREATE STREAM s FROM SELECT event_id, value FROM events WHERE value > 75", "CREATE TRIGGER FUNCTION t(i numeric) LANGUAGE Python AS $$return i$$", "CREATE TRIGGER ON s FOR EACH ROW WHEN value < 80 EXECUTE t(event_id)")
    return calls[0].select(F.col("i").alias("event_id"))


add("trigger_when", _trigger, "SELECT event_id FROM events WHERE value > 75 AND value < 80")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of LOG STREAM over all events: the first hundred rows, and an ellipsis if there are more."""
    made, lines = engine(spark, sf_dir), []
    made.output = lines.append
    run(made, "CREATE STREAM s FROM SELECT event_id FROM events ORDER BY event_id", "LOG STREAM s")
    return spark.createDataFrame([(x,) for x in lines[0].split("\n")[2:]], "line string")


add("log_stream", _log, "SELECT line FROM (SELECT CAST(event_id AS VARCHAR) AS line FROM events ORDER BY event_id LIMIT 100) UNION ALL SELECT '...' AS line WHERE (SELECT count(*) FROM events) > 100")


# ---------------------------------------------------------------- features and models

def _features(rules: list[features.Rule], columns: list[str], name: str = "part") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(*columns)
        return features.with_datum(rows, rules, columns[0]).select(columns[0], F.explode(features.vector(F.col("_datum"))).alias("feature", "v"))

    return query


add("feat_id", _features([("columns", ["p_brand"], "id"), ("columns", ["p_size"], "id")], ["p_partkey", "p_brand", "p_size"]), "SELECT p_partkey, 'p_brand$' || p_brand || '@str' AS feature, 1.0 AS v FROM part UNION ALL SELECT p_partkey, 'p_size@num', CAST(p_size AS DOUBLE) FROM part")
add("feat_wildcards", _features([("suffix", ["_size"], "id"), ("all", [], "id")], ["p_partkey", "p_brand", "p_size"]), ORACLE["feat_id"])
for _n, _kind in ((1, "unigram"), (2, "bigram")):
    add(f"feat_{_kind}", _features([("columns", ["p_brand"], _kind)], ["p_partkey", "p_brand"]), f"SELECT p_partkey, 'p_brand-{_kind}-conv$' || g || '@{_kind}' AS feature, CAST(count(*) AS DOUBLE) AS v FROM (SELECT p_partkey, substr(p_brand, CAST(unnest(range(1, length(p_brand) - {_n} + 2)) AS INT), {_n}) AS g FROM part) GROUP BY ALL")


def _user_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature function that gives two features of two columns."""
    script = Script("f", ("a", "b"), "return {'size': b * 2, 'brand': a + '!'}", "python")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    read = features.with_datum(rows, [("columns", ["p_brand", "p_size"], "f")], "p_partkey", lambda _, c: features.feature_udf(script)(*c), "d")
    return read.select("p_partkey", F.col("d.string_values")["f#p_brand,p_size#brand"].alias("brand"), F.col("d.num_values")["f#p_brand,p_size#size"].alias("size"))


add("feat_userfn", _user_feature, "SELECT p_partkey, p_brand || '!' AS brand, CAST(p_size * 2 AS DOUBLE) AS size FROM part")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run(engine(spark, sf_dir), """CREATE CLASSIFIER MODEL m (label: event_type) AS value, user_id CONFIG '{"method": "AROW", "parameter": {"regularization_weight": 1.0}}'""", "CREATE STREAM few FROM SELECT ts, event_id, event_type, value, user_id FROM events", "UPDATE MODEL m USING train FROM few", "CREATE STREAM c FROM ANALYZE few BY MODEL m USING classify", "CREATE STREAM s FROM SELECT event_id, highestScoreLabel(classify) AS label FROM c")
    return made.table("s")


add("clf_train_classify", _classified)


def _recommended(method: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size", "p_retailprice").orderBy("id")
        model = models.Recommender("r", [("all", [], "id")], "id", "{}", None)
        model.update(part, ["id"])
        out = model.analyze(part, method, "row")
        return out.select("id", F.round(F.col("row.num_values")["p_size"], 6).alias("size"), F.round(F.col("row.num_values")["p_retailprice"], 4).alias("price"))

    return query


add("rec_complete_from_id", _recommended("complete_row_from_id"))
add("rec_complete_from_datum", _recommended("complete_row_from_datum"))


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    vectors = rows.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(size)))
    model = models.Anomaly("a", [("prefix", ["e"], "id")], "vec_id", '{"parameter": {"nearest_neighbor_num": 10}}', None)
    model.update(vectors, ["vec_id"])
    return model.analyze(vectors, "calc_score", "score").select("vec_id", F.round("score", 6).alias("score"))


add("anom_calc_score", _anomalies)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine(spark, sf_dir)
    return spark.createDataFrame(list(made.execute("STATUS").body["sources"].items()), "source string, state string")


add("status_rows", _status, "SELECT 'events' AS source, 'Initialized' AS state")
