"""The sixteen statements, from text to dataclasses.

SELECT bodies and expressions stay text: Spark parses those.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class BadStatement(ValueError):
    pass


@dataclass
class CreateSource:
    name: str
    columns: list[tuple[str, str]]
    storage: str
    streams: list[str]


@dataclass
class CreateModel:
    algorithm: str
    name: str
    key: tuple[str, str] | None
    features: list[tuple[str, list[str], str]]  # (all | prefix | suffix | columns, names, function)
    config: str


@dataclass
class StreamFromSelect:
    name: str
    sql: str


@dataclass
class StreamFromWindow:
    name: str
    size: int
    advance: int
    kind: str
    source: str
    aggregates: list[tuple[str, list[str], str | None]]
    where: str | None
    having: str | None


@dataclass
class StreamFromAnalyze:
    name: str
    source: str
    model: str
    method: str
    column: str | None


@dataclass
class CreateTrigger:
    stream: str
    when: str | None
    function: str
    arguments: list[str]


@dataclass
class LogStream:
    stream: str


@dataclass
class UpdateModel:
    model: str
    method: str
    stream: str


@dataclass
class Analyze:
    data: str
    model: str
    method: str


@dataclass
class Status:
    pass


@dataclass
class Shutdown:
    pass


@dataclass
class StartProcessing:
    source: str


@dataclass
class StopProcessing:
    pass


@dataclass
class CreateFunction:
    kind: str  # scalar, feature or trigger
    name: str
    arguments: list[tuple[str, str]]
    returns: str | None
    language: str
    body: str


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<code>\$\$(?:(?!\$\$).)*\$\$)|(?P<string>'[^']*'|"[^"]*")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[^\W\d]\w*)|(?P<quoted>`[^`]*`)|(?P<symbol><=>|<>|!=|<=|>=|\|\||.)""",
    re.DOTALL,
)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadStatement(f"cannot read {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            found.append(Token(m.lastgroup, m[0], m.start(), m.end()))
        at = m.end()
    return found


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    @property
    def next(self) -> Token:
        return self.tokens[self.at] if self.at < len(self.tokens) else Token("end", "", len(self.text), len(self.text))

    def fail(self, wanted: str):
        raise BadStatement(f"expected {wanted} at {self.next.text!r}")

    def take(self, *words: str) -> bool:
        """Take the words if they all come next."""
        got = [t.word for t in self.tokens[self.at : self.at + len(words)]]
        if got == list(words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                self.fail(w)

    def of(self, kind: str) -> str:
        token = self.next
        if token.kind != kind and not (kind == "name" and token.kind == "quoted"):
            self.fail(kind)
        self.at += 1
        return token.text.strip("`") if kind == "name" else token.text

    def string(self) -> str:
        return self.of("string")[1:-1]

    def list_of(self, item, stop: str = ")") -> list:
        found = [item()]
        while self.take(","):
            found.append(item())
        return found

    def expression(self, *stops: str) -> str:
        """Source text up to a stop word, a comma or a closing bracket outside brackets."""
        start, depth, first = self.next.start, 0, self.at
        while self.next.kind != "end":
            w = self.next.word
            if not depth and (w in (",", ")") or w in stops):
                break
            depth += (w in "([") - (w in ")]") if self.next.kind == "symbol" else 0
            self.at += 1
        if self.at == first:
            self.fail("an expression")
        return self.text[start : self.tokens[self.at - 1].end]


_TYPES = ("NUMERIC", "STRING", "BOOLEAN")


def parse(text: str):
    """The statement of a text; ``BadStatement`` if there is none."""
    r = _Reader(text.strip().removesuffix(";"))
    out = _statement(r)
    if r.next.kind != "end":
        r.fail("the end")
    return out


def _typed(r: _Reader) -> tuple[str, str]:
    name = r.of("name")
    kind = r.next.word
    if kind not in _TYPES:
        r.fail("a type")
    r.at += 1
    return name, kind.lower()


def _typed_list(r: _Reader) -> list[tuple[str, str]]:
    r.need("(")
    found = [] if r.next.word == ")" else r.list_of(lambda: _typed(r))
    r.need(")")
    return found


def _statement(r: _Reader):
    if r.take("LOG", "STREAM"):
        return LogStream(r.of("name"))
    if r.take("UPDATE", "MODEL"):
        model = r.of("name")
        r.need("USING")
        method = r.of("name")
        r.need("FROM")
        return UpdateModel(model, method, r.of("name"))
    if r.take("ANALYZE"):
        data = r.string()
        r.need("BY", "MODEL")
        model = r.of("name")
        r.need("USING")
        return Analyze(data, model, r.of("name"))
    if r.take("STATUS"):
        return Status()
    if r.take("SHUTDOWN"):
        return Shutdown()
    if r.take("START", "PROCESSING"):
        return StartProcessing(r.of("name"))
    if r.take("STOP", "PROCESSING"):
        return StopProcessing()
    r.need("CREATE")
    if r.take("DATASOURCE"):
        return _source(r)
    if r.next.word in ("CLASSIFIER", "ANOMALY", "RECOMMENDER"):
        return _model(r)
    if r.take("STREAM"):
        return _stream(r)
    if r.take("TRIGGER", "ON"):
        stream = r.of("name")
        r.need("FOR", "EACH", "ROW")
        when = r.expression("EXECUTE") if r.take("WHEN") else None
        r.need("EXECUTE")
        function = r.of("name")
        r.need("(")
        arguments = [] if r.next.word == ")" else r.list_of(lambda: r.expression())
        r.need(")")
        return CreateTrigger(stream, when, function, arguments)
    kind = "feature" if r.take("FEATURE") else "trigger" if r.take("TRIGGER") else "scalar"
    r.need("FUNCTION")
    name, arguments, returns = r.of("name"), _typed_list(r), None
    if kind == "scalar":
        r.need("RETURNS")
        returns = r.next.text
        if returns.upper() not in _TYPES:
            r.fail("a type")
        r.at += 1
    r.need("LANGUAGE")
    language = r.of("name")
    r.need("AS")
    return CreateFunction(kind, name, arguments, returns, language, r.of("code")[2:-2])


def _source(r: _Reader) -> CreateSource:
    name = r.of("name")
    columns = _typed_list(r) if r.next.word == "(" else []
    r.need("FROM", "(", "STORAGE", ":")
    storage, streams = r.string(), []
    while r.take(",", "STREAM", ":"):
        streams.append(r.string())
    r.need(")")
    return CreateSource(name, columns, storage, streams)


def _model(r: _Reader) -> CreateModel:
    algorithm = r.of("name").upper()
    r.need("MODEL")
    name, key = r.of("name"), None
    if r.take("("):
        role = r.of("name")
        if role not in ("label", "id"):
            r.fail("label or id")
        r.need(":")
        key = (role, r.of("name"))
        r.need(")")
    r.need("AS")

    def feature() -> tuple[str, list[str], str]:
        if r.take("*"):
            touching = r.next.kind == "name" and r.next.word not in ("WITH", "CONFIG")
            kind, names = ("suffix", [r.of("name")]) if touching else ("all", [])
        elif r.take("("):
            kind, names = "columns", r.list_of(lambda: r.of("name"))
            r.need(")")
        else:
            names = [r.of("name")]
            kind = "prefix" if r.take("*") else "columns"
        return kind, names, r.of("name") if r.take("WITH") else "id"

    features = r.list_of(feature)
    r.need("CONFIG")
    return CreateModel(algorithm, name, key, features, r.string())


def _stream(r: _Reader):
    name = r.of("name")
    r.need("FROM")
    if r.next.word == "SELECT":
        start = r.next.start
        r.at = len(r.tokens)
        return StreamFromSelect(name, r.text[start:].strip())
    if r.take("ANALYZE"):
        source = r.of("name")
        r.need("BY", "MODEL")
        model = r.of("name")
        r.need("USING")
        method = r.of("name")
        return StreamFromAnalyze(name, source, model, method, r.of("name") if r.take("AS") else None)
    r.need("SLIDING", "WINDOW", "(", "SIZE")
    size = r.of("number")
    r.need("ADVANCE")
    advance = r.of("number")
    if r.next.word not in ("TIME", "TUPLES"):
        r.fail("TIME or TUPLES")
    kind = r.next.word.lower()
    r.at += 1
    r.need(")", "OVER")
    source = r.of("name")
    r.need("WITH")

    def aggregate() -> tuple[str, list[str], str | None]:
        function = r.of("name")
        r.need("(")
        arguments = r.list_of(lambda: r.expression())
        r.need(")")
        return function, arguments, r.of("name") if r.take("AS") else None

    aggregates = r.list_of(aggregate)
    where = r.expression("HAVING") if r.take("WHERE") else None
    having = r.expression() if r.take("HAVING") else None
    try:
        return StreamFromWindow(name, int(size), int(advance), kind, source, aggregates, where, having)
    except ValueError as e:
        raise BadStatement("window sizes are integers") from e
