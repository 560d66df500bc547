"""Running sums, ranks and order statistics in the order of a number, without a whole group in one task.

Rows are grouped to distinct values first (a sum that combines before the shuffle), dealt into buckets that follow the
order of the value, and summed inside them; the totals of the buckets, some thousands a key at most, give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets an octave of the value.
FINE = 256


def range_bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises, from the value alone: no bounds to sample, the same in every job."""
    v = value.cast("double")
    octave = lambda x: F.floor(F.log2(x) * FINE) + 1100 * FINE  # noqa: E731 - over the least exponent, so above 0
    return F.when(v > 0, octave(v)).when(v < 0, -octave(-v)).otherwise(0).cast("long")


def running(rows: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """rows (keys, value, sums; one a value and key) with, for each sum c, c_before over the lesser values and c_all over all of the key."""
    keys, sums = list(keys), list(sums)
    d = rows.withColumn("__bucket", range_bucket(F.col(value)))
    totals = d.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a bucket
    lesser = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__bucket", *[F.coalesce(F.sum(f"__{c}").over(lesser), F.lit(0)).alias(f"__{c}_before") for c in sums], *[F.sum(f"__{c}").over(whole).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    j = d.join(totals, [*keys, "__bucket"])
    return j.select(*rows.columns, *[(F.col(f"__{c}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums], *[f"{c}_all" for c in sums])


def counted(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """A row a key and distinct value: n, n_before, n_all. Null values are left out."""
    return running(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), value, ["n"], keys)


def average_ranks(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with `rank`, from 1 in each key, ties at their mean place."""
    c = counted(rows, value, keys).select(*keys, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"))
    return rows.join(c, [*keys, value])


def places(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with `place` from 0 in the order of value in each key, and `of`, the rows of the key; value is unique in a key."""
    c = running(rows.withColumn("__one", F.lit(1).cast("long")), value, ["__one"], keys)
    return c.select(*rows.columns, F.col("__one_before").alias("place"), F.col("__one_all").alias("of"))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """keys and, by name, the exact percentiles of value, linear between the two nearest; null for a key without values."""
    c = counted(rows, value, keys)
    aggregates, out = [], []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("n_all") - 1)
        for end, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            aggregates.append(F.max(F.when((F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n")), F.col(value))).alias(f"__{name}_{end}"))
        aggregates.append(F.max(at - F.floor(at)).alias(f"__{name}_share"))
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        out.append((low + (high - low) * F.col(f"__{name}_share")).alias(name))
    return c.groupBy(*keys).agg(*aggregates).select(*keys, *out)
