"""Ranks and exact percentiles within groups of any size.

A group's values are counted first, so that ties are one row; then its values are dealt into ranges between approximate
percentiles, the ranges are summed up, and only within a range values are put in order.  No group is met in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut

RANGES = 64  #: ranges of a group's values


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n): how often each value that is known stands in its group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def _same(by: list[str], prefix: str):
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(prefix + c))
    return on


def cumulative(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """`counts` (by, value, n) with before, the number of the group's lesser values, and of, the number of all.

    Groups may be null, and `by` empty; an empty table has an empty result.
    """
    shares = [k / RANGES for k in range(1, RANGES)]
    bounds = counts.groupBy(*by).agg(F.percentile_approx(value, shares, 20 * RANGES).alias("__bounds"), F.sum("n").alias("of"))
    bounds = bounds.select(*[F.col(c).alias(f"__g_{c}") for c in by], "__bounds", "of")
    # approximate percentiles depend on the order in which parts arrive: what is read twice below must be the same table
    bounds = cut(bounds)
    # (without `by`, bounds is one row)
    placed = counts.join(bounds, _same(by, "__g_")) if by else counts.join(F.broadcast(bounds))
    placed = placed.select(*by, value, "n", "of", F.size(F.filter("__bounds", lambda b: b <= F.col(value))).alias("__range"))
    sums = placed.groupBy(*by, "__range").agg(F.sum("n").alias("__m"))
    below = F.sum("__m").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"__g_{c}") for c in by], F.col("__range").alias("__g___range"), F.coalesce(below, F.lit(0)).alias("__below"))
    inside = F.sum("n").over(Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    found = placed.join(sums, _same([*by, "__range"], "__g_"))
    return found.select(*by, value, "n", "of", (F.col("__below") + F.coalesce(inside, F.lit(0))).alias("before"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], interpolate: bool = True) -> DataFrame:
    """Each group's exact percentiles by name: on the line between the two nearest values, or the lower of these."""
    placed = cumulative(counted(rows, by, value), by, value)
    found = []
    for name, share in shares.items():
        spot = F.lit(share) * (F.col("of") - 1)
        at = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n")), F.col(value)))
        lower = at(F.floor(spot))
        if interpolate:
            part = F.max(spot - F.floor(spot))
            found.append((lower + part * (at(F.ceil(spot)) - lower)).alias(name))
        else:
            found.append(lower.alias(name))
    return placed.groupBy(*by).agg(*found)
