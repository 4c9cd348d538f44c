"""The engine: statements in, responses out.

Statements about a data source are collected until START PROCESSING; then they run,
in their order, over the stored rows and after that over each batch of live rows.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates
from .functions.scripts import BadScript, Script, coerce
from .operators import features, models
from .plans import parser as p
from .sources import uris
from .streaming.home import STORED, Home
from .streaming.windows import OngoingWindow


@dataclass
class Response:
    code: int
    body: dict


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Source:
    name: str
    reader: Callable[[], DataFrame]
    order: list[str]
    stream: str | None = None
    schema: object = None
    state: str = "Initialized"
    steps: list[tuple[object, Callable[[Batch], None]]] = field(default_factory=list)
    windows: list[OngoingWindow] = field(default_factory=list)


@dataclass
class Batch:
    """One pass over the steps: rows of the source, then of the streams."""

    tables: dict[str, DataFrame]
    last: bool


class Engine:
    """One session: sources, streams, models and functions by name.

    ``stamp`` is the column with event times (text, ISO 8601 without zone);
    ``output`` gets lines of LOG STREAM. ``fired`` gets a stream's name and the calls
    of a trigger, a row with the arguments for each; it must run them once.

    With a ``name``, a live source goes on where the last engine of that name stopped
    or broke off: give the same statements again, then START PROCESSING. The stored
    part isn't read again; rows of streams are given once, triggers and logs of the
    batch that broke off run again.
    """

    def __init__(self, spark: SparkSession, stamp: str = "event_timestamp", output: Callable[[str], object] = print, fired: Callable[[str, DataFrame], object] | None = None, name: str | None = None):
        if name is not None and not re.fullmatch(r"\w[\w.-]*", name):
            raise ValueError(f"an engine's name has letters, digits, '_', '.' and '-': {name}")
        self.spark, self.stamp, self.output, self.name = spark, stamp, output, name
        self.fired = fired or (lambda stream, calls: calls.write.format("noop").mode("overwrite").save())
        spark.conf.set("spark.sql.ansi.enabled", "false")
        self.sources: dict[str, Source] = {}
        self.roots: dict[str, str] = {}
        self.models: dict[str, models.Model] = {}
        self.scripts: dict[str, tuple[str, Script]] = {}
        self.running = None
        self.current: Source | None = None
        self.closing = False
        self.state = "running"  # then "stop-and-poll" while a stream ends, "shutdown" for good
        self.times = [0, 0]
        self.results: dict[str, Callable[[], DataFrame]] = {}
        self.prefix = f"s{uuid.uuid4().hex[:8]}_"
        spark.sql(_HIGHEST)

    # ------------------------------------------------------------ requests

    def request(self, text: str) -> Response:
        """A request as JSON text with the field ``query``."""
        try:
            asked = json.loads(text)
        except ValueError:
            return Response(400, {"result": f"received string '{text}' was not valid JSON"})
        if not isinstance(asked, dict) or not isinstance(asked.get("query"), str):
            return Response(400, {"result": f"received JSON '{text}' did not contain a query string"})
        return self.execute(asked["query"])

    def execute(self, text: str) -> Response:
        try:
            statement = p.parse(text)
        except p.BadStatement:
            return Response(400, {"result": f"unable to parse queryString '{text}'"})
        if self.closing:
            return Response(503, {"result": f"received {statement} while shutting down, not taking action"})
        try:
            out = _ACTIONS[type(statement)](self, statement)
        except Refused as e:
            return Response(e.code, {"result": str(e)})
        except Exception as e:  # noqa: BLE001
            return Response(500, {"result": str(e)})
        return Response(200, out if isinstance(out, dict) else {"result": out})

    # ------------------------------------------------------------ names

    def register(self, name: str, table: DataFrame, order: list[str]) -> None:
        """A data source that is a table at hand, in the order of the columns ``order``."""
        self._new_name(name, "data source")
        self.sources[name] = Source(name, lambda: table, order, schema=table.schema)
        self.roots[name] = name

    def _new_name(self, name: str, kind: str) -> None:
        if name in self.roots:
            raise Refused(400, f"{kind} '{name}' already exists")

    def _source_of(self, streams: list[str]) -> Source:
        for s in streams:
            if s not in self.roots:
                raise Refused(400, f"source '{s}' not found")
        roots = {self.roots[s] for s in streams}
        if len(roots) != 1:
            raise Refused(400, "you cannot use streams from multiple different data sources in one statement: " + ", ".join(sorted(roots)))
        source = self.sources[roots.pop()]
        if source.state != "Initialized":
            raise Refused(400, f"data source '{source.name}' cannot accept further statements")
        return source

    def _add(self, source: Source, statement, step: Callable[[Batch], None], stream: str | None = None) -> None:
        source.steps.append((statement, step))
        if stream:
            self.roots[stream] = source.name

    def _tables_in(self, sql: str) -> list[str]:
        """Names of the tables that a query reads."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        found: list[str] = []

        def walk(node) -> None:
            if node.getClass().getSimpleName() == "UnresolvedRelation":
                found.append(node.tableName().strip("`"))
            for side in (node.children(), node.innerChildren()):
                for i in range(side.size()):
                    walk(side.apply(i))
            own = node.subqueries() if hasattr(node, "subqueries") else None
            for i in range(own.size() if own is not None else 0):
                walk(own.apply(i))

        walk(plan)
        return found

    # ------------------------------------------------------------ statements

    def create_source(self, s: p.CreateSource) -> str:
        self._new_name(s.name, "data source")
        try:
            uris.check_storage(s.storage)
            for stream in s.streams:
                uris.check_stream(stream)
        except uris.BadPlace as e:
            raise Refused(400, str(e)) from e
        if len(s.streams) > 1:
            raise Refused(400, "there is more than one stream")
        schema = uris.schema_of(s.columns) if s.columns else uris.infer(self.spark, s.storage)
        source = Source(s.name, lambda: uris.rows(uris.stored(self.spark, s.storage), schema, uris.ARRIVAL), uris.ARRIVAL, s.streams[0] if s.streams else None, schema)
        self.sources[s.name] = source
        self.roots[s.name] = s.name
        return "CREATE DATASOURCE"

    def create_model(self, s: p.CreateModel) -> str:
        known = ("id", *features.NGRAM)
        bad = [f for _, _, f in s.features if f not in known and self.scripts.get(f, ("",))[0] != "feature"]
        if bad:
            raise Refused(400, "unknown feature functions: " + ", ".join(bad))
        if (s.algorithm == "CLASSIFIER") != (s.key is not None and s.key[0] == "label") and s.algorithm == "CLASSIFIER":
            raise Refused(400, "a CLASSIFIER model needs a label")
        try:
            made = models.KINDS[s.algorithm](s.name, s.features, s.key[1] if s.key else None, s.config, self._feature)
        except ValueError as e:
            raise Refused(400, "input config is not a JSON.") from e
        except TypeError as e:
            raise Refused(400, "input config is not a JSON object.") from e
        made.algorithm, made.role = s.algorithm, s.key[0] if s.key else None
        self.models[s.name] = made
        return "CREATE MODEL (started)"

    def _feature(self, name: str, columns: list[Column]) -> Column:
        return features.feature_udf(self.scripts[name][1])(*columns)

    def create_function(self, s: p.CreateFunction) -> str:
        language = s.language.lower()
        if language not in ("javascript", "python"):
            raise Refused(400, "only JavaScript is supported")
        if not s.arguments:
            raise Refused(400, "args should contain at least one element")
        if s.kind != "feature" and len(s.arguments) > 5:
            raise Refused(400, "too many arguments")
        if s.kind == "scalar" and s.returns not in ("numeric", "string", "boolean"):
            raise Refused(400, "bad return type")
        script = Script(s.name, tuple(n for n, _ in s.arguments), s.body, language)
        try:
            script.check()
        except BadScript as e:
            raise Refused(400, str(e)) from e
        self.scripts[s.name] = (s.kind, script)
        if s.kind != "feature":
            self.spark.udf.register(s.name, _as_udf(script, s.returns if s.kind == "scalar" else None))
        return {"scalar": "CREATE FUNCTION", "feature": "CREATE FEATURE FUNCTION", "trigger": "CREATE TRIGGER FUNCTION"}[s.kind]

    def stream_from_select(self, s: p.StreamFromSelect) -> str:
        self._new_name(s.name, "stream")
        try:
            tables = self._tables_in(s.sql)
        except Exception as e:
            raise Refused(400, f"unable to parse queryString '{s.sql}'") from e
        source = self._source_of(tables)

        def step(batch: Batch) -> None:
            session = self.spark
            for t in set(tables):
                rows = batch.tables[t]
                rows.createOrReplaceTempView(t)
                session = rows.sparkSession  # a live batch has a session of its own
            batch.tables[s.name] = session.sql(s.sql)

        self._add(source, s, step, s.name)
        return "CREATE STREAM"

    def transform(self, name: str, stream: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """A stream that any function of DataFrames makes of another one, batch by batch."""
        self._new_name(name, "stream")

        def step(batch: Batch) -> None:
            batch.tables[name] = change(batch.tables[stream])

        self._add(self._source_of([stream]), ("transform", name, stream), step, name)

    def stream_from_window(self, s: p.StreamFromWindow) -> str:
        specs, errors = [], []
        names = [f for f, _, a in s.aggregates if a is None]
        for i, (function, arguments, alias) in enumerate(s.aggregates):
            output = alias or (f"{function}${i}" if names.count(function) > 1 else function)
            try:
                constants = [self._constant(a) for a in arguments[:-1]]
                specs.append(aggregates.Aggregate.of(function, constants, arguments[-1], output))
            except aggregates.BadParameter as e:
                errors.append(str(e))
        if errors:
            raise Refused(400, "invalid parameter specification: " + ", ".join(errors))
        self._new_name(s.name, "stream")
        source = self._source_of([s.source])
        if s.size < 1 or s.advance < 1:
            raise Refused(400, "a window's size and advance are 1 at least")
        state = OngoingWindow(specs, s.size, s.advance, s.kind, self.stamp)
        source.windows.append(state)

        def step(batch: Batch) -> None:
            rows = batch.tables[s.source]
            if s.where:
                rows = rows.where(s.where)
            if s.kind == "time" and self.stamp not in rows.columns:
                raise Refused(400, f"column '{self.stamp}' not found")
            order = [c for c in source.order if c in rows.columns]
            if not order:
                rows, order = rows.withColumn("_arrival", F.monotonically_increasing_id()), ["_arrival"]
            ts = F.to_timestamp(F.col(self.stamp)) if s.kind == "time" else None
            out = state.push(rows, order, ts, batch.last)
            batch.tables[s.name] = out.where(s.having) if s.having else out

        self._add(source, s, step, s.name)
        return "CREATE STREAM"

    def _constant(self, text: str):
        """The value of a constant expression; None if it is none."""
        try:
            value = self.spark.range(1).select(F.expr(text)).first()[0]
        except Exception:  # noqa: BLE001
            return None
        return float(value) if type(value).__name__ == "Decimal" else value

    def _pair(self, model: str, method: str, stream: str | None, table: dict) -> models.Model:
        found = self.models.get(model)
        if found is None:
            raise Refused(400, f"model '{model}' not found")
        if method not in table[found.algorithm]:
            raise Refused(400, f"'{method}' is not a valid method for {found.algorithm}")
        if found.algorithm == "CLASSIFIER" and found.role != "label":
            raise Refused(400, "no datum specified for label")
        if found.algorithm == "RECOMMENDER" and found.role != "id":
            raise Refused(400, "no datum specified for id")
        return found

    def stream_from_analyze(self, s: p.StreamFromAnalyze) -> str:
        self._new_name(s.name, "stream")
        model = self._pair(s.model, s.method, s.source, models.ANALYSES)

        def step(batch: Batch) -> None:
            # made anew by each consumer, with the model as it is then
            batch.tables[s.name] = _Lazy(lambda: model.analyze(batch.tables[s.source], s.method, s.column or s.method))

        self._add(self._source_of([s.source]), s, step, s.name)
        return "CREATE STREAM"

    def create_trigger(self, s: p.CreateTrigger) -> str:
        if s.function not in self.scripts:
            builtin = self.spark.catalog.functionExists(s.function)
            raise Refused(400, "unintentional Spark SQL builtin function" if builtin else f"no user-defined function named {s.function}")
        if len(self.scripts[s.function][1].names) != len(s.arguments):
            raise Refused(400, f"number of arguments is mismatched (number of arguments of {s.function} is {len(self.scripts[s.function][1].names)})")

        def step(batch: Batch) -> None:
            rows = batch.tables[s.stream]
            rows = rows.where(s.when) if s.when else rows
            given = [F.expr(a).alias(n) for n, a in zip(self.scripts[s.function][1].names, s.arguments, strict=True)]
            self.fired(s.stream, rows.select(*given, F.expr(f"{s.function}({', '.join(s.arguments)})").alias("_t")))

        self._add(self._source_of([s.stream]), s, step)
        return "CREATE TRIGGER"

    def log_stream(self, s: p.LogStream) -> str:
        def step(batch: Batch) -> None:
            df = batch.tables[s.stream].drop(*uris.ARRIVAL)
            rows = df.take(101)
            lines = [f"STREAM: {s.stream}", " | ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)]
            lines += [" | ".join(str(v) for v in r) for r in rows[:100]] + ["..."] * (len(rows) > 100)
            self.output("\n".join(lines))

        self._add(self._source_of([s.stream]), s, step)
        return "LOG STREAM"

    def update_model(self, s: p.UpdateModel) -> str:
        model = self._pair(s.model, s.method, s.stream, models.UPDATES)
        source = self._source_of([s.stream])

        def step(batch: Batch) -> None:
            rows = batch.tables[s.stream]
            order = [c for c in source.order if c in rows.columns]
            if not order:
                rows, order = rows.withColumn("_arrival", F.monotonically_increasing_id()), ["_arrival"]
            model.update(rows.select([c for c in rows.columns if c not in order] + order), order)

        self._add(source, s, step)
        return "UPDATE MODEL"

    def analyze(self, s: p.Analyze) -> dict:
        model = self._pair(s.model, s.method, None, models.ANALYSES)
        if s.method == "complete_row_from_id":
            row = {model.key: s.data}
        else:
            try:
                row = features.datum_of_json(s.data)
            except ValueError as e:
                raise Refused(400, f"'{s.data}' is not a JSON object") from e
        kinds = ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'double'}" for k, v in row.items()) or "`_none` string"
        asked = self.spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in row.values()) or (None,)], kinds)
        value = model.analyze(asked, s.method, "_out").select("_out").first()[0]
        if s.method == "classify":
            return {"result": {"predictions": [x.asDict() for x in value]}}
        if s.method == "calc_score":
            return {"result": {"score": value}}
        return {"result": value.asDict(True)}

    def status(self, s: p.Status) -> dict:
        return {"result": "STATUS", "sources": {n: x.state for n, x in self.sources.items()}, "models": dict.fromkeys(self.models, "OK")}

    # ------------------------------------------------------------ processing

    def _pass(self, source: Source, rows: DataFrame, last: bool) -> dict[str, DataFrame]:
        """Run the steps over a batch; gives the rows of each stream."""
        batch = Batch(_Tables({source.name: rows}), last)
        for _, step in source.steps:
            step(batch)
        return {name: df for name, df in batch.tables.items() if name != source.name}

    def _live_pass(self, source: Source, home: Home, number: int, rows: DataFrame, record: dict) -> None:
        """A batch whose results and, for a named engine, state are written."""
        for name, df in self._pass(source, rows, last=False).items():
            home.give(name, number, df)
            self.results[name] = lambda name=name: home.table(name)
        if home.lasting:
            at = home.folder(number)
            windows = [w.save(f"{at}/window{i}") for i, w in enumerate(source.windows)]
            learned = {n: m.save(self.spark, f"{at}/model-{n}") for n, m in self.models.items()}
            home.save(number, {**record, "windows": windows, "models": learned})
        for w in source.windows:
            w.scratch.turn(self.spark)

    def _resume(self, source: Source, home: Home, number: int) -> None:
        """Windows and models as they were after a batch."""
        record, at = home.load(number), home.folder(number)
        for i, (w, state) in enumerate(zip(source.windows, record["windows"], strict=True)):
            w.load(self.spark, f"{at}/window{i}", state)
        for name, state in record["models"].items():
            self.models[name].load(self.spark, f"{at}/model-{name}", state)

    def start(self, s: p.StartProcessing) -> str:
        source = self.sources.get(s.source)
        if source is None:
            raise Refused(400, f"unknown data source: {s.source}")
        if source.state != "Initialized":
            raise Refused(400, f"cannot start processing a data source in state {source.state}")
        if self.current is not None:
            raise Refused(400, "there is already a running process, try to run STOP PROCESSING first")
        if not source.steps:
            raise Refused(400, "there are no processing instructions")
        source.state, self.current = "Running", source
        began = time.time()
        try:
            if source.stream:
                self._go_live(source)
            else:
                self.results.update({name: lambda df=df: df for name, df in self._pass(source, source.reader(), last=True).items()})
                self.times[0] = int((time.time() - began) * 1000)
        except Exception:
            source.state, self.current = "Finished", None
            raise
        return "START PROCESSING"

    def _go_live(self, source: Source) -> None:
        """The stored part, if no engine of this name read it before, then the live one."""
        home, began = Home(self.spark, self.name, source.name), time.time()
        wanted = [source.stream, source.schema.json(), *(repr(s) for s, _ in source.steps)]
        before = home.latest() if home.lasting else None
        if before is None:
            stored = source.reader()
            largest = stored.agg(F.max(self.stamp)).first()[0] if self.stamp in stored.columns else None
            record = {"statements": wanted, "largest": largest}
            self._live_pass(source, home, STORED, stored, record)
        else:
            record = {k: v for k, v in home.load(before).items() if k in ("statements", "largest")}
            if record["statements"] != wanted:
                raise Refused(400, f"the state of '{source.name}' was saved by other statements")
            largest = record["largest"]
            self.results.update({name: lambda name=name: home.table(name) for name in home.streams})
        self.times[0] = int((time.time() - began) * 1000)
        lines = uris.live(self.spark, source.stream, self.stamp)
        resumed = before is None

        def each(df: DataFrame, number: int) -> None:
            nonlocal resumed
            if not resumed:
                self._resume(source, home, number - 1)
                resumed = True
            lines = df.select("value", F.lit(None).cast("timestamp").alias("_a1"), F.lit(None).cast("string").alias("_a2"), F.monotonically_increasing_id().alias("_a3"))
            rows = uris.rows(lines, source.schema, uris.ARRIVAL)
            if largest:
                rows = rows.where(F.col(self.stamp) > largest)
            self._live_pass(source, home, number, rows, record)

        self.live_began = time.time()
        writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{home.path}/checkpoint")
        self.running = writer.trigger(processingTime="2 seconds").start()

    def _stop(self) -> tuple[int, int] | None:
        self.state = "shutdown" if self.closing else "stop-and-poll"
        try:
            return self._stop_current()
        finally:
            self.state = "shutdown" if self.closing else "running"

    def _stop_current(self) -> tuple[int, int] | None:
        if self.current is None:
            return None
        if self.running is not None:
            self.running.stop()
            self.times[1] = int((time.time() - self.live_began) * 1000)
        self.current.state = "Finished"
        self.current, self.running = None, None
        return self.times[0], self.times[1]

    def stop(self, s: p.StopProcessing) -> str:
        took = self._stop()
        if took is None:
            raise Refused(400, "apparently there was no stream processing running")
        return f"STOP PROCESSING (processing time: {took[0]} ms/{took[1]} ms)"

    def shutdown(self, s: p.Shutdown) -> str:
        self.closing = True
        took = self._stop()
        return f"SHUTDOWN (processing time: {took[0]} ms/{took[1]} ms)" if took else "SHUTDOWN"

    def table(self, stream: str) -> DataFrame:
        """All rows that a stream has given so far."""
        return self.results[stream]()


class _Lazy:
    def __init__(self, make: Callable[[], DataFrame]):
        self.make = make


class _Tables(dict):
    """Tables by name; some are made each time they are asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        return found.make() if isinstance(found, _Lazy) else found

    def items(self):
        return [(n, self[n]) for n in self]


def _as_udf(script: Script, returns: str | None):
    kind = {"numeric": "double", "string": "string", "boolean": "boolean", None: "int"}[returns]
    import pandas as pd

    def run(*columns: pd.Series) -> pd.Series:
        rows = [[None if v is None or v != v else (v.item() if hasattr(v, "item") else v) for v in r] for r in zip(*columns, strict=True)]
        out = script.run(rows)
        return pd.Series([0] * len(rows) if returns is None else [coerce(returns, r) for r in out], dtype={"double": "float64", "boolean": "bool", "int": "int32"}.get(kind, "object"))

    n = len(script.names)
    typed = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c), 4: lambda a, b, c, d: run(a, b, c, d), 5: lambda a, b, c, d, e: run(a, b, c, d, e)}[n]
    for name in typed.__code__.co_varnames[:n]:
        typed.__annotations__[name] = pd.Series
    typed.__annotations__["return"] = pd.Series
    return F.pandas_udf(typed, kind)


_HIGHEST = """
CREATE OR REPLACE TEMPORARY FUNCTION highestScoreLabel(c ARRAY<STRUCT<label: STRING, score: DOUBLE>>) RETURNS STRING
RETURN coalesce(filter(c, e -> e.score = array_max(transform(c, x -> x.score)))[0].label, '')
"""

_ACTIONS = {
    p.CreateSource: Engine.create_source,
    p.CreateModel: Engine.create_model,
    p.CreateFunction: Engine.create_function,
    p.StreamFromSelect: Engine.stream_from_select,
    p.StreamFromWindow: Engine.stream_from_window,
    p.StreamFromAnalyze: Engine.stream_from_analyze,
    p.CreateTrigger: Engine.create_trigger,
    p.LogStream: Engine.log_stream,
    p.UpdateModel: Engine.update_model,
    p.Analyze: Engine.analyze,
    p.Status: Engine.status,
    p.StartProcessing: Engine.start,
    p.StopProcessing: Engine.stop,
    p.Shutdown: Engine.shutdown,
}
