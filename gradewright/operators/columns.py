"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def steps_to(n: Column, use: Callable[[Column], Column], start: int = 0) -> Column:
    """The array of use(i) for i = start .. n - 1; empty where n <= start (a bare sequence would count downwards)."""
    return F.transform(F.filter(F.sequence(F.lit(start), F.greatest(n - 1, F.lit(start))), lambda i: i < n), use)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def percentile(values: Column, share: float) -> Column:
    """Linear between the two nearest of the sorted values; null for none."""

    def read(v: Column) -> Column:
        at = F.lit(share) * (F.size(v) - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
        return F.when(F.size(v) > 0, a + (b - a) * (at - low))

    return let(F.array_sort(values), read)


def average_ranks(values: Column) -> Column:
    """Ranks from 0, ties at their mean place. Each value meets all others: for short arrays."""
    return F.transform(values, lambda x: F.size(F.filter(values, lambda y: y < x)) + (F.size(F.filter(values, lambda y: y == x)) - 1) / 2.0)


def rank_correlation(values: Column, order: Column) -> Column:
    """Spearman's correlation of two short arrays; 0 below three points or for constants (up to 1e-8 + 1e-5 of the first)."""

    def flat(a: Column) -> Column:
        first = F.get(a, F.lit(0))
        return F.forall(a, lambda x: F.abs(x - first) <= 1e-8 + 1e-5 * F.abs(first))

    def centred(a: Column) -> Column:
        return let(average_ranks(a), lambda r: F.transform(r, lambda x: x - (F.size(r) - 1) / 2.0))

    def corr(p: Column) -> Column:
        dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
        size = F.sqrt(dot(p["a"], p["a"]) * dot(p["b"], p["b"]))
        return F.when(size > 0, dot(p["a"], p["b"]) / size).otherwise(0.0)

    short = (F.size(values) < 3) | flat(values) | flat(order)
    return F.when(short, 0.0).otherwise(let(F.struct(centred(values).alias("a"), centred(order).alias("b")), corr))


def iso_seconds(ts: Column) -> Column:
    """A UTC time as ISO 8601 text with seconds, in a session whose zone is UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def half_even(c: Column, digits: int) -> Column:
    """Rounded as Python rounds: half to even on the exact binary value, which no SQL function looks at. For what is shown, not for keys."""

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits), na_action="ignore")

    return rounded(c.cast("double"))
