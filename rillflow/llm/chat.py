r"""Chat formatting through a template that is a black box.

A template is any object with ``render(turns) -> str``. Successive prefixes of a
conversation are rendered; where each output begins with the one before, the rest
is the last turn's span. Where it does not, the template rewrites history and the
conversation is marked. Inside a span the text is found by rendering the turn again
with two probes. Whole prefixes are rendered unless the template promises, by
``context``, on how many earlier turns a turn's span may depend; then long
conversations are rendered in windows. The promise is checked: where a window ends,
the next turn is rendered after the old turns and after the new ones. Where the
template rewrites the old turns there, the conversation is marked; where only the
span differs, it is an error.

``InstTemplate`` marks turns by control strings and escapes those inside texts by
a backslash after the first character (and doubles backslashes), so that a control
string in the output is always the template's own and texts can be read back.

Rows are streamed turn by turn in the order of (conv_id, turn, role, text): memory
is that of one window of turns, whatever a conversation's length.

Defined results: a null text or role is empty; turns with equal numbers follow one
another in the order of role and text; rows with a null conv_id are one
conversation; repeated rows are turns each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Turn = tuple[str, str]

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]")

_PLAIN = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_TURN = re.compile(
    r"<<SYS>>(?P<system>.*?)<</SYS>>|<s>\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[TEXT\](?P<other>.*?)\[/ROLE\]|(?P<assistant>.*?)</s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Template(Protocol):
    context: int | None

    def render(self, turns: list[Turn]) -> str: ...


class InstTemplate:
    """System, user and assistant turns by their own marks, any other role by name."""

    context: int | None = 0

    def render(self, turns: list[Turn]) -> str:
        marks = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST]", "[/INST]"), "assistant": ("", "</s>")}
        out = []
        for role, text in turns:
            before, after = marks.get(role) or (f"[ROLE]{escape(role)}[TEXT]", "[/ROLE]")
            out += [before, escape(text), after]
        return "".join(out)

    @staticmethod
    def read(output: str) -> list[Turn]:
        """The turns of a rendered conversation."""
        turns, at = [], 0
        while at < len(output):
            m = _TURN.match(output, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            if m["role"] is not None:
                turns.append((unescape(m["role"]), unescape(m["other"])))
            else:
                kind = next(k for k in ("system", "user", "assistant") if m[k] is not None)
                turns.append((kind, unescape(m[kind])))
            at = m.end()
        return turns


class Rendering:
    """Spans of a conversation's turns, one at a time, by rendering successive prefixes."""

    PROBES = ("A", "B")

    def __init__(self, template: Template, window: int = 256):
        self.template, self.window = template, window
        self.turns: list[Turn] = []
        self.output = ""
        self.rewrites = False

    def _move(self, context: int, turn: Turn) -> None:
        """Begin a new window of the last ``context`` turns, if ``turn`` comes out alike in both."""
        tail = self.turns[len(self.turns) - context :]
        head = self.template.render(tail) if tail else ""
        old, new = self.template.render([*self.turns, turn]), self.template.render([*tail, turn])
        if not old.startswith(self.output):
            self.rewrites = True
        if not self.rewrites and (not new.startswith(head) or old[len(self.output) :] != new[len(head) :]):
            raise ValueError(f"a span depends on more than the {context} turns that the template declares")
        self.turns, self.output = tail, head

    def add(self, role: str, text: str) -> tuple[str | None, int, int]:
        """(span, start and end of the text in it) of the next turn; no span after a rewrite."""
        context = self.template.context
        if context is not None and len(self.turns) >= self.window + context:
            self._move(context, (role, text))
        output = self.template.render([*self.turns, (role, text)])
        if self.rewrites or not output.startswith(self.output):
            self.rewrites = True
            self.turns.append((role, text))
            self.output = output
            return None, 0, 0
        span = output[len(self.output) :]
        one, two = (self.template.render([*self.turns, (role, probe)])[len(self.output) :] for probe in self.PROBES)
        start = next((i for i, (a, b) in enumerate(zip(one, two, strict=False)) if a != b), 0)
        end = len(span) - (len(one) - start - len(self.PROBES[0]))
        self.turns.append((role, text))
        self.output = output
        return span, start, max(start, end)


SPANS = "conv_id {kind}, number long, span string, text_start int, text_end int, learn boolean, rewrites boolean"


def ordered(conversations: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in order."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def spans(conversations: DataFrame, template: Template | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each turn: its part of the output, and where its text lies in it.

    The parts of a conversation in the order of ``number``, put together, are the
    formatted conversation; the loss mask is [text_start, text_end) where ``learn``.
    """
    own = template or InstTemplate()
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rendering, number = object(), None, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if conv != current:
                    current, rendering, number = conv, Rendering(own), 0
                span, start, end = rendering.add(role, text)
                out.append((conv, number, span, start, end, role in learn and span is not None, rendering.rewrites))
                number += 1
            if out:
                kinds = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
                columns = zip(*out, strict=True)
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "number", "span", "text_start", "text_end", "learn", "rewrites"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return ordered(conversations).mapInArrow(run, SPANS.format(kind=kind))


def digests(parts: DataFrame) -> DataFrame:
    """Read conversations back from ``spans`` of ``InstTemplate``: counts and hashes of each.

    Needs the order of ``spans``; hashes grow turn by turn.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, kind = object(), None, None

        def row() -> pa.RecordBatch:
            conv, n, turns, loss_chars, loss, chars = state
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array([x], k) for x, k in zip((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), kinds, strict=True)], names=names)

        for batch in batches:
            kind = batch.column("conv_id").type
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "span", "text_start", "text_end", "learn"))
            for conv, span, start, end, learn in zip(*columns, strict=True):
                if conv != current:
                    if state:
                        yield row()
                    current, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in InstTemplate.read(span):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if learn:
                    text = unescape(span[start:end])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(span)
        if state:
            yield row()

    kind = parts.schema["conv_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(conversations: DataFrame, template: Template | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, text, mask, rewrites): whole conversations and their loss spans.

    One row holds a whole conversation; use ``spans`` where that is too much.
    """
    parts = spans(conversations, template, learn)
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("number", "span", "text_start", "text_end", "learn"))).alias("t"), F.max("rewrites").alias("rewrites"))
    shifted = F.expr("transform(t, (x, i) -> struct(x.learn AS learn, aggregate(slice(t, 1, i), 0, (a, y) -> a + length(coalesce(y.span, ''))) AS at, x.text_start AS s, x.text_end AS e))")
    mask = F.transform(F.filter(shifted, lambda x: x["learn"]), lambda x: F.struct((x["at"] + x["s"]).alias("start"), (x["at"] + x["e"]).alias("end")))
    return rows.select("conv_id", F.array_join(F.col("t.span"), "").alias("text"), F.when(~F.col("rewrites"), mask).alias("mask"), "rewrites")
