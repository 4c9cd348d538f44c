"""From columns to features: extraction rules and the default conversion to numbers.

A datum is two maps, of strings and of numbers. Rules are applied left to right;
columns that a rule has used are no longer in the wildcards of later rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATUM = "struct<string_values: map<string,string>, num_values: map<string,double>>"
NGRAM = {"unigram": "-unigram-conv", "bigram": "-bigram-conv"}
Rule = tuple[str, list[str], str]


class BadFeature(ValueError):
    pass


def _columns(rule: Rule, left: list[str], every: list[str]) -> list[list[str]]:
    """Argument lists of a rule's calls."""
    kind, names, _ = rule
    if kind == "columns":
        for n in names:
            if n not in every:
                raise BadFeature(f"column named '{n}' not found")
        return [names]
    test: Callable[[str], bool] = {"all": lambda c: True, "prefix": lambda c: c.startswith(names[0]), "suffix": lambda c: c.endswith(names[0])}[kind] if kind != "all" else lambda c: True
    return [[c] for c in left if test(c)]


def with_datum(df: DataFrame, rules: list[Rule], key: str | None, call: Callable[[str, list[Column]], Column] | None = None, name: str = "_datum", hidden: tuple[str, ...] = ()) -> DataFrame:
    """Add the datum of each row as a column ``name``.

    ``call(function, columns)`` gives a user function's result as map<string,string>
    of JSON values, with the empty key for a bare value. Columns ``hidden`` are no features.
    """
    every = [c for c in df.columns if c not in hidden]
    left = [c for c in every if c != key]
    kinds = {f.name: f.dataType for f in df.schema}
    strings: list[Column] = []
    numbers: list[Column] = []
    labels: dict[str, list[str]] = {"string": [], "double": []}
    made: list[tuple[str, Column]] = []
    for rule in rules:
        function = rule[2]
        for args in _columns(rule, list(left), every):
            if function in ("id", *NGRAM):
                if len(args) != 1:
                    raise BadFeature(f"function '{function}' takes one column")
                own = args[0]
                label = own + NGRAM.get(function, "")
                kind = kinds[own]
                labels["string" if isinstance(kind, T.StringType) else "double"].append(label)
                if isinstance(kind, T.StringType):
                    strings.append(F.struct(F.lit(label).alias("key"), F.col(f"`{own}`").alias("value")))
                elif isinstance(kind, T.NumericType):
                    numbers.append(F.struct(F.lit(label).alias("key"), F.col(f"`{own}`").cast("double").alias("value")))
            else:
                prefix = f"{function}#{','.join(args)}"
                df = df.withColumn(f"_call{len(made)}", call(function, [F.col(f"`{a}`") for a in args]))
                made.append((prefix, F.col(f"_call{len(made)}")))
            left = [c for c in left if c not in args]
    none = lambda kind: F.array().cast(f"array<struct<key: string, value: {kind}>>")
    texts = F.filter(F.array(*strings), lambda e: e["value"].isNotNull()) if strings else none("string")
    values = F.filter(F.array(*numbers), lambda e: e["value"].isNotNull()) if numbers else none("double")
    for prefix, result in made:
        entries = F.map_entries(result)
        single = F.size(entries) == 1
        named = F.transform(entries, lambda e: F.struct(F.when(single | (e["key"] == ""), F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "#"), e["key"])).alias("key"), e["value"].alias("value")))  # noqa: B023
        quoted = lambda e: e["value"].startswith('"')
        texts = F.concat(texts, F.transform(F.filter(named, quoted), lambda e: F.struct(e["key"].alias("key"), F.get_json_object(F.concat(F.lit('{"v":'), e["value"], F.lit("}")), "$.v").alias("value"))))
        values = F.concat(values, F.transform(F.filter(named, lambda e: ~quoted(e)), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("double").alias("value"))))
    last = lambda a, kind: F.aggregate(a, F.create_map().cast(f"map<string,{kind}>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
    once = not made and all(len(set(names)) == len(names) for names in labels.values())  # no key can come twice
    merge = (lambda a, kind: F.map_from_entries(a)) if once else last
    datum = F.struct(merge(texts, "string").alias("string_values"), merge(values, "double").alias("num_values"))
    return df.withColumn(name, datum).drop(*(f"_call{i}" for i in range(len(made))))


def feature_udf(script) -> Callable[..., Column]:
    """A feature function as a column function; errors stop the query."""

    @F.pandas_udf("map<string,string>")
    def run(*columns: pd.Series) -> pd.Series:
        rows = [[None if pd.isna(v) else v for v in r] for r in zip(*columns, strict=True)]
        out = []
        for row, result in zip(rows, script.run(rows), strict=True):
            if any(v is None for v in row):
                raise BadFeature(f"a null went to feature function '{script.name}'")
            if "error" in result:
                raise BadFeature(result["error"])
            value = result["value"]
            found = value if isinstance(value, dict) else {"": value}
            out.append({k: json.dumps(v) for k, v in found.items() if isinstance(v, (str, int, float)) and not isinstance(v, bool)})
        return pd.Series(out)

    return run.asNondeterministic()  # so that no expression takes it in


def vector(datum: Column) -> Column:
    """Named numbers of a datum: strings as they are, n-grams by their counts, numbers as they are."""

    def grams(entry: Column, n: int, suffix: str) -> Column:
        text = entry["value"]
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        each = F.transform(places, lambda i: F.substring(text, i, F.lit(n)))
        return F.transform(F.array_distinct(each), lambda g: F.struct(F.concat(entry["key"], F.lit("$"), g, F.lit(f"@{suffix}")).alias("key"), F.size(F.filter(each, lambda x: x == g)).cast("double").alias("value")))

    texts = F.map_entries(datum["string_values"])
    whole = F.filter(texts, lambda e: ~e["key"].endswith("-conv"))
    parts = [F.transform(whole, lambda e: F.struct(F.concat(e["key"], F.lit("$"), e["value"], F.lit("@str")).alias("key"), F.lit(1.0).alias("value")))]
    for n, name in ((1, "unigram"), (2, "bigram")):
        own = F.filter(texts, lambda e: e["key"].endswith(NGRAM[name]))  # noqa: B023
        parts.append(F.flatten(F.transform(own, lambda e: grams(e, n, name))))  # noqa: B023
    parts.append(F.transform(F.map_entries(datum["num_values"]), lambda e: F.struct(F.concat(e["key"], F.lit("@num")).alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.concat(*parts))


def datum_of_json(text: str) -> dict:
    """Strings and numbers of a JSON object, for a question asked by hand."""
    value = json.loads(text)
    if not isinstance(value, dict):
        raise BadFeature("the data is not a JSON object")
    found: dict = {}

    def walk(o: dict) -> None:
        for k, v in o.items():
            if isinstance(v, dict):
                walk(v)
            elif isinstance(v, (str, int, float)) and not isinstance(v, bool):
                found[k] = v

    walk(value)
    return found
