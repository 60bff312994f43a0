"""Aggregate expressions of the benchmark's statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import numbered

#: Gains smaller than this count as none.
ZEROISH = 0.01


def _clean(x: Column | str) -> Column:
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(x), x)


def nearest_rank(x: Column | str, p: float) -> Column:
    """The value at index round((n - 1) * p), halves rounded up; 0 of none. For groups that fit in memory."""
    ordered = F.sort_array(F.collect_list(x))
    return F.coalesce(F.get(ordered, F.floor((F.size(ordered) - 1) * F.lit(p) + 0.5).cast("int")), F.lit(0))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """by.. and a column for each name of places: nearest_rank() of value at that p, for groups of any size.

    Counts by value are numbered over range partitions, so neither a large group nor a common value meets in
    one task. Nulls among the values don't count; a null among `by` is a group of its own.
    """
    counts = rows.groupBy(*by, value).agg(F.count(value).alias("_n"))
    ordered = numbered(counts, [*by, value], "_before", "_n")
    groups = ordered.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_all"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    place = F.col("_before") - F.col("_first")

    def found(p: float) -> Column:
        at = F.floor((F.col("_all") - 1) * F.lit(p) + 0.5)
        return F.coalesce(F.max(F.when((at >= place) & (at < place + F.col("_n")), F.col(value))), F.lit(0))

    return ordered.join(groups, same).groupBy(*by).agg(*[found(p).alias(name) for name, p in places.items()])


def percentile(x: Column | str, p: float) -> Column:
    """Linear interpolation; NaN dropped, 0 of none, p held within 0 and 100."""
    return F.coalesce(F.percentile(_clean(x), min(max(p, 0.0), 100.0) / 100), F.lit(0.0))


def median(x: Column | str) -> Column:
    return percentile(x, 50)


def iqr(x: Column | str) -> Column:
    return percentile(x, 75) - percentile(x, 25)


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(0.0))


def least(x: Column | str) -> Column:
    """Minimum; NaN dropped, 0 of none or of an infinite one."""
    return _finite(F.min(_clean(x)))


def greatest(x: Column | str) -> Column:
    return _finite(F.max(_clean(x)))


def positive_runs(gain: str, zeroish: float = ZEROISH) -> Column:
    return F.count_if(F.col(gain) >= zeroish)


def negative_runs(gain: str, zeroish: float = ZEROISH) -> Column:
    return F.count_if(F.col(gain) <= -zeroish)


def zeroish_runs(gain: str, zeroish: float = ZEROISH) -> Column:
    return F.count_if(F.abs(F.col(gain)) < zeroish)


def flips(gain: str, by: list[str], order: str, zeroish: float = ZEROISH) -> Column:
    """1 where a run's gain has the other sign than the run before, both beyond zeroish; a zeroish run breaks the chain."""
    before = F.lag(gain).over(Window.partitionBy(*by).orderBy(order))
    both = (F.abs(F.col(gain)) >= zeroish) & (F.abs(before) >= zeroish)
    return F.when(both & (F.signum(F.col(gain)) != F.signum(before)), 1).otherwise(0)
