"""The nine window aggregates: parameter checks and expressions.

``Aggregate.of(...)`` checks name and parameters; ``build`` gives the expressions.
NaN and infinite inputs raise; nulls are ignored, as in SQL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("avg", "stddev", "quantile", "linapprox", "fourier", "wavelet", "histogram")
TEXTUAL = ("concat", "maxelem")


class BadParameter(ValueError):
    pass


def _power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def inverse_transform(values: np.ndarray) -> tuple[list[float], list[float]]:
    """Discrete Fourier transform with positive exponent, divided by the padded length."""
    padded = np.zeros(_power_of_two(len(values)))
    padded[: len(values)] = values
    out = np.fft.ifft(padded)
    return out.real.tolist(), out.imag.tolist()


def haar(values: np.ndarray) -> list[float]:
    """Haar coefficients by halves: the mean, then details from coarse to fine."""
    a = np.zeros(_power_of_two(len(values)))
    a[: len(values)] = values
    details: list[np.ndarray] = []
    while len(a) > 1:
        details.insert(0, (a[0::2] - a[1::2]) / 2)
        a = (a[0::2] + a[1::2]) / 2
    return np.concatenate([a, *details]).tolist()


def _fourier(values: Column) -> Column:
    def run(values: pd.Series) -> pd.DataFrame:
        both = [inverse_transform(np.asarray(v, float)) for v in values]
        return pd.DataFrame({"re": [r for r, _ in both], "im": [i for _, i in both]})

    return F.pandas_udf(run, "struct<re: array<double>, im: array<double>>", F.PandasUDFType.SCALAR)(values)


def _wavelet(values: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([haar(np.asarray(v, float)) for v in values])

    return F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR)(values)


@dataclass(frozen=True)
class Aggregate:
    name: str
    column: str  # SQL text of the input
    output: str
    constants: tuple = ()

    @property
    def kind(self) -> str:
        return "double" if self.name in NUMERIC else "string"

    @classmethod
    def of(cls, name: str, constants: list, column: str, output: str) -> Aggregate:
        """Check name and constants (evaluated; None where not a constant)."""
        low = name.lower()
        if low not in NUMERIC + TEXTUAL:
            raise BadParameter(f"unknown aggregation function: {name}")
        number = lambda x: isinstance(x, float)
        count = lambda x: isinstance(x, int) and not isinstance(x, bool)
        if any(c is None for c in constants):
            raise BadParameter({"quantile": "first parameter to quantile must be evaluable", "concat": "first parameter to concat must be evaluable"}.get(low, f"parameters for {low} must be evaluable"))
        if low == "quantile":
            if len(constants) > 1 or (constants and not number(constants[0])):
                raise BadParameter("wrong type of parameters for quantile (must be (numeric, numeric))")
            if constants and not 0 <= constants[0] <= 1:
                raise BadParameter("first parameter to quantile must be in [0,1] range")
            constants = constants or [0.5]
        elif low == "histogram":
            forms = {0: (), 1: (count,), 2: (number, number), 3: (number, number, count)}
            if len(constants) not in forms or not all(f(c) for f, c in zip(forms[len(constants)], constants, strict=True)):
                words = {1: "(int, numeric)", 2: "(double, double, numeric)"}.get(len(constants), "(double, double, int, numeric)")
                raise BadParameter(f"wrong type of parameters for histogram, must be {words}")
            low_bound, high_bound = constants[:2] if len(constants) >= 2 else (0.1, 0.9)
            bins = constants[-1] if len(constants) in (1, 3) else 10
            constants = [low_bound, high_bound, bins]
            if bins < 1:
                raise BadParameter("the number of bins must be positive")
            if bins == 1 and (low_bound, high_bound) != (math.inf, -math.inf):
                raise BadParameter("one bin needs infinite bounds")
            if bins == 2 and low_bound != high_bound:
                raise BadParameter("two bins need equal bounds")
            if bins > 2 and not low_bound < high_bound:
                raise BadParameter("more than two bins need the lower bound below the upper")
        elif low == "concat":
            if len(constants) > 1 or (constants and not isinstance(constants[0], str)):
                raise BadParameter("first parameter to concat must be a string")
            constants = constants or [" "]
        elif constants:
            raise BadParameter(f"wrong number of parameters for {low}")
        return cls(low, column, output, tuple(constants))


def _items(value: Column) -> Column:
    """Values of a window in the order of (item, value), nulls left out."""
    item = F.when(value.isNotNull(), F.struct(F.col("_ord").alias("o"), value.alias("v")))
    return F.transform(F.array_sort(F.collect_list(item)), lambda e: e["v"])


def _checked(value: Column, name: str) -> Column:
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} got a value that is not finite")).cast("double")).otherwise(value)


def _linear(y: Column) -> Column:
    """Least squares of the values of an array on their places 0, 1, 2, ..."""
    n = F.size(y).cast("double")
    sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    sy = F.aggregate(y, F.lit(0.0), lambda a, e: a + e)
    sxy = F.aggregate(F.transform(y, lambda e, i: e * i), F.lit(0.0), lambda a, e: a + e)
    slope = F.when(n < 2, float("nan")).otherwise((n * sxy - sx * sy) / (n * sxx - sx * sx))
    return F.struct(slope.alias("a"), F.when(n < 2, float("nan")).otherwise((sy - slope * sx) / n).alias("b"))


def expression(agg: Aggregate, value: Column, placed: bool) -> Column:
    """The aggregate as one expression over rows with ``_ord`` (and ``_pos`` if ``placed``)."""
    name, c = agg.name, agg.constants
    if name in NUMERIC:
        value = _checked(value, name)
    if name == "avg":
        return F.avg(value)
    if name == "stddev":
        return F.stddev_pop(value)
    if name == "quantile":
        every = F.sort_array(F.collect_list(value))
        return F.get(every, F.floor((F.size(every) - 1) * F.lit(c[0]) + 0.5).cast("int"))
    if name == "linapprox":
        if placed:
            nan = F.lit(float("nan"))
            return F.struct(F.coalesce(F.regr_slope(value, "_pos"), nan).alias("a"), F.coalesce(F.regr_intercept(value, "_pos"), nan).alias("b"))
        return _linear(_items(value))
    if name in ("fourier", "wavelet"):
        return _items(value)
    if name == "histogram":
        low, high, bins = c
        n = F.count(value)
        if bins == 1:
            return F.array(F.count(value) / n)
        edges = [low + i * (high - low) / (bins - 2) for i in range(bins - 1)] if bins > 2 else [low]
        parts = [F.count_if(value < edges[0])] + [F.count_if((value >= a) & (value < b)) for a, b in zip(edges[:-1], edges[1:], strict=True)] + [F.count_if(value >= edges[-1])]
        return F.array(*(p / n for p in parts))
    if name == "concat":
        return F.array_join(_items(F.when(value != "", value)), c[0])
    raise ValueError(name)


def aggregate(rows: DataFrame, keys: list[str], aggs: list[Aggregate], placed: bool = False) -> DataFrame:
    """One row for each window: ``keys``, ``_n`` and the outputs, all in one grouping.

    ``rows`` has the inputs as ``_v0``, ``_v1``, ... The most frequent element needs
    counts of its values first, so it is grouped by value and joined on the window.
    """
    plain = [(i, a) for i, a in enumerate(aggs) if a.name != "maxelem"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(expression(a, F.col(f"_v{i}"), placed).alias(f"_o{i}") for i, a in plain))
    for i, a in plain:
        if a.name in ("fourier", "wavelet"):
            out = out.withColumn(f"_o{i}", (_fourier if a.name == "fourier" else _wavelet)(F.col(f"_o{i}")))
    for i, a in enumerate(aggs):
        if a.name == "maxelem":
            by_value = rows.where(F.col(f"_v{i}").isNotNull()).groupBy(*keys, f"_v{i}").agg(F.count("*").alias("_c"), F.max("_ord").alias("_m"))
            best = by_value.groupBy(*keys).agg(F.max_by(f"_v{i}", F.struct("_c", "_m", f"_v{i}")).alias(f"_o{i}"))
            out = out.join(best, keys, "left")
    return out.select(*keys, "_n", *(F.col(f"_o{i}").alias(a.output) for i, a in enumerate(aggs)))
