"""Statistics of series: one row for each key and date, `value` NULL where there is no data.

Keys hold the dates of one place, some thousands at most; only Sen's slope gathers them into an array, everything else
aggregates on the way or runs as a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.scalar import divide
from .ranks import counted, cumulative, percentiles

KEY = "px"
FRONT_BLOCKS = 16  #: parts that sets are held against each other in


def by_key(key: str = KEY):
    return Window.partitionBy(key)


def in_order(key: str = KEY, ts: str = "ts"):
    return Window.partitionBy(key).orderBy(calendar.micros(F.col(ts)))


def backwards(key: str = KEY, ts: str = "ts"):
    """The same dates from the last on: what follows a date is summed up row by row then, as what precedes it is in order."""
    return Window.partitionBy(key).orderBy(calendar.micros(F.col(ts)).desc())


def middle(sorted_values: Column) -> Column:
    """Median of a sorted array; NULL if it is empty."""
    n = F.size(sorted_values)
    at = lambda i: F.get(sorted_values, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def series_stats(obs: DataFrame, key: str = KEY) -> DataFrame:
    """n, mean, median, std (n - 1; 0 of one value), cv, extremes with their first dates, least squares and Sen's line over decimal years, largest drop."""
    valid = obs.where(F.col("value").isNotNull()).withColumn("x", calendar.decimal_year(F.col("ts")))
    valid = valid.withColumn("drop", F.lag("value").over(in_order(key)) - F.col("value"))
    v, x = F.col("value"), F.col("x")
    at = lambda s: s["x"]
    out = valid.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.percentile(v, 0.5).alias("median"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        at(F.min(F.struct(v, x))).alias("argmin"),
        (-F.max(F.struct(v, (-x).alias("x")))["x"]).alias("argmax"),
        F.covar_pop(x, v).alias("cxy"),
        F.var_pop(x).alias("cxx"),
        F.var_pop(v).alias("cyy"),
        F.avg(x).alias("mx"),
        F.max(F.when(F.col("drop") > 0, F.struct("drop", (-x).alias("x")))).alias("fall"),
        F.array_sort(F.collect_list(F.struct(x, v))).alias("points"),
    )
    slope = divide(F.col("cxy"), F.col("cxx"))
    r2 = F.when(F.col("cyy") > 0, divide(F.col("cxy") * F.col("cxy"), F.col("cxx") * F.col("cyy"))).otherwise(0.0)
    pairs = F.flatten(F.transform("points", lambda a, i: F.transform(F.slice("points", i + 2, F.size("points")), lambda b: divide(b["value"] - a["value"], b["x"] - a["x"]))))
    out = out.withColumn("sen_slope", F.when(F.col("n") >= 3, middle(F.array_sort(F.filter(pairs, lambda s: s.isNotNull())))))
    rest = F.array_sort(F.transform("points", lambda p: p["value"] - F.col("sen_slope") * p["x"]))
    return out.select(
        key, "n", "mean", "median", "std", F.when(F.col("mean") == 0, 0.0).otherwise(divide(F.col("std"), F.abs("mean"))).alias("cv"),
        "min", "max", "argmin", "argmax", slope.alias("slope"), (F.col("mean") - slope * F.col("mx")).alias("intercept"), r2.alias("r2"),
        "sen_slope", F.when(F.col("sen_slope").isNotNull(), F.get(rest, F.floor(F.col("n") / 2).cast("int"))).alias("sen_intercept"),
        F.when(F.col("n") >= 2, F.coalesce(F.col("fall.drop"), F.lit(0.0))).alias("largest_drop"), (-F.col("fall.x")).alias("drop_date"),
    )


def sample_stats(obs: DataFrame) -> DataFrame:
    """Over all keys at a date: n, mean, std (n - 1; 0 of one) and percentiles that are values of the sample, the lower one."""
    sums = obs.where(F.col("value").isNotNull()).groupBy("ts").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return sums.join(percentiles(obs, ["ts"], "value", {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)}, interpolate=False), "ts")


def observations_per_year(obs: DataFrame, key: str = KEY) -> DataFrame:
    """365.25 days over the (upper) median step between valid dates, rounded, at least 1."""
    valid = obs.where(F.col("value").isNotNull())
    step = (calendar.epoch(F.col("ts")) - F.lag(calendar.epoch(F.col("ts"))).over(in_order(key))) / 86400.0
    steps = valid.withColumn("step", step).where("step is not null")
    ranked = steps.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("step")) - 1).withColumn("n", F.count("*").over(by_key(key)))
    found = ranked.where("k = floor(n / 2)")
    return found.select(key, F.greatest(F.lit(1), F.rint(F.coalesce(divide(F.lit(365.25), F.col("step")), F.lit(1.0))).cast("int")).alias("per_year"))


def monthly_climatology(obs: DataFrame, key: str = KEY) -> DataFrame:
    return obs.groupBy(key, F.month("ts").alias("month")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def deseasonalised(obs: DataFrame, key: str = KEY) -> DataFrame:
    """Values less the mean of their calendar month."""
    w = Window.partitionBy(key, F.month("ts"))
    return obs.select(key, "ts", (F.col("value") - F.avg("value").over(w)).alias("value"))


def cusum(obs: DataFrame, key: str = KEY) -> DataFrame:
    """Running sum of the deviations from the mean; no data stays none and adds nothing."""
    centred = obs.withColumn("d", F.col("value") - F.avg("value").over(by_key(key)))
    running = F.sum("d").over(in_order(key).rowsBetween(Window.unboundedPreceding, 0))
    return centred.select(key, "ts", F.when(F.col("d").isNotNull(), running).alias("value"))


def seasonal_grid(obs: DataFrame, bins: int = 12, key: str = KEY) -> DataFrame:
    """Mean and number of values for each year and part of the year."""
    part = calendar.season_bin(F.col("ts"), bins)
    return obs.groupBy(key, F.year("ts").alias("year"), part.alias("bin")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def seasonal_years(obs: DataFrame, start: int, key: str = KEY) -> DataFrame:
    """Mean by year that begins on day `start`."""
    return obs.groupBy(key, calendar.season_year(F.col("ts"), start).alias("season")).agg(F.avg("value").alias("mean"))


def season_filter(obs: DataFrame, first: int, last: int) -> DataFrame:
    """Dates from day `first` to day `last` of the year, across the new year if first > last."""
    doy = F.dayofyear("ts")
    return obs.where(doy.between(first, last) if first <= last else (doy >= first) | (doy <= last))


def annual_harmonic(obs: DataFrame, key: str = KEY) -> DataFrame:
    """Least squares of mean + a cos + b sin over the year: mean, amplitude, and the day of the peak; none with fewer than 3 dates or a singular fit."""
    angle = (calendar.decimal_year(F.col("ts")) - F.year("ts")) * F.lit(2 * 3.141592653589793)
    p = obs.where(F.col("value").isNotNull()).select(key, F.col("value").alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    m = p.groupBy(key).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(e).alias(a) for a, e in (("c", F.col("c")), ("s", F.col("s")), ("y", F.col("y")), ("cc", F.col("c") * F.col("c")), ("ss", F.col("s") * F.col("s")), ("cs", F.col("c") * F.col("s")), ("cy", F.col("c") * F.col("y")), ("sy", F.col("s") * F.col("y")))]
    )
    n, c, s, y, cc, ss, cs, cy, sy = (F.col(k) for k in ("n", "c", "s", "y", "cc", "ss", "cs", "cy", "sy"))
    # centred normal equations
    kcc, kss, kcs, kcy, ksy = cc - c * c / n, ss - s * s / n, cs - c * s / n, cy - c * y / n, sy - s * y / n
    det = kcc * kss - kcs * kcs
    ok = (n >= 3) & (det > 1e-9)
    a, b = F.when(ok, divide(kcy * kss - ksy * kcs, det)), F.when(ok, divide(ksy * kcc - kcy * kcs, det))
    m = m.select(key, a.alias("a"), b.alias("b"), n.alias("n"), c.alias("c"), s.alias("s"), y.alias("y"))
    turn = F.atan2("b", "a") / F.lit(2 * 3.141592653589793)
    return m.select(key, ((F.col("y") - F.col("a") * F.col("c") - F.col("b") * F.col("s")) / F.col("n")).alias("mean"), F.hypot("a", "b").alias("amplitude"), ((turn - F.floor(turn)) * 365.25).alias("peak_day"))


def average_ranks(obs: DataFrame, by: str = "ts") -> DataFrame:
    """Rank of each value among those of its date; ties share the mean of their ranks."""
    ranks = cumulative(counted(obs, [by], "value"), [by], "value")
    ranks = ranks.select(F.col(by).alias("__by"), F.col("value").alias("__value"), (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))
    return obs.join(ranks, F.col(by).eqNullSafe(F.col("__by")) & (F.col("value") == F.col("__value")), "left").drop("__by", "__value")


def clearest_dates(obs: DataFrame, k: int) -> DataFrame:
    """The k dates with the greatest share of keys that have a value, earlier ones first on ties."""
    share = obs.groupBy("ts").agg((F.count("value") / F.count("*")).alias("clear"), F.count("value").alias("n"))
    return share.orderBy(F.desc("clear"), F.desc("n"), "ts").limit(k)


def pareto_front(sets: DataFrame, better: list[str], key: str) -> DataFrame:
    """Sets that no other one beats: at least as good in all of `better` (greater is better) and better in one.

    Sets are dealt into FRONT_BLOCKS by hash: first each block keeps its own front, then the fronts are held against each
    other block by block.  `key` tells sets apart.
    """
    own = sets.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(FRONT_BLOCKS)))
    other = own.select(F.col("__block").alias("__other"), *[F.col(b).alias(f"__o_{b}") for b in better])
    beaten, one = F.col("__block") == F.col("__other"), F.lit(False)
    for b in better:
        beaten = beaten & (F.col(f"__o_{b}") >= F.col(b))
        one = one | (F.col(f"__o_{b}") > F.col(b))
    front = own.join(other, beaten & one, "left_anti")
    other = front.select(F.col("__block").alias("__other"), *[F.col(b).alias(f"__o_{b}") for b in better])
    met = front.select(key, *better, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FRONT_BLOCKS - 1).cast("long"))).alias("__block"))
    lost = met.join(other, beaten & one, "left_semi").select(F.col(key).alias("__lost")).distinct()
    return front.join(lost, F.col(key).eqNullSafe(F.col("__lost")), "left_anti").select(*sets.columns)


def band_scores(cube: DataFrame, bands: list[str]) -> DataFrame:
    """Bands as deviations from their means over all keys and dates, in standard deviations, meaned by date."""
    w = cube.agg(*[F.avg(b).alias(f"m_{b}") for b in bands], *[F.stddev_samp(b).alias(f"s_{b}") for b in bands])
    scored = cube.join(F.broadcast(w))  # one row
    return scored.groupBy("ts").agg(*[F.avg(divide(F.col(b) - F.col(f"m_{b}"), F.col(f"s_{b}"))).alias(b) for b in bands])


def summary(obs: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """Histogram of all values between lo and hi; values outside count in the first or last bin."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("value") - lo) / ((hi - lo) / bins)))).cast("int")
    return obs.where(F.col("value").isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))


def is_categorical(obs: DataFrame, most: int = 64) -> DataFrame:
    """Whether the first date has few distinct values, all whole."""
    first = obs.join(F.broadcast(obs.agg(F.min("ts").alias("ts"))), "ts", "left_semi")
    return first.agg(F.countDistinct("value").alias("n"), (F.bool_and(F.col("value") == F.floor("value")) & (F.countDistinct("value") <= most)).alias("categorical"))


def class_shares(classes: DataFrame) -> DataFrame:
    """Keys and percent of each class at each date (px, ts, class)."""
    n = classes.where("class is not null").groupBy("ts", "class").agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("ts")))


def transitions(classes: DataFrame, first, second) -> DataFrame:
    """Keys by class at two dates or periods (px, period, class)."""
    a = classes.where(F.col("period") == first).select("px", F.col("class").alias("from"))
    b = classes.where(F.col("period") == second).select("px", F.col("class").alias("to"))
    return a.join(b, "px").groupBy("from", "to").agg(F.count("*").alias("n"))


def flows(classes: DataFrame, least_share: float) -> DataFrame:
    """Keys by class from each period to the key's next one; classes below a share of all go together as `other`."""
    n = classes.groupBy("class").agg(F.count("*").alias("n"))
    rare = n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("class", (F.col("n") < least_share * F.col("all")).alias("rare"))
    named = classes.join(rare, "class").select("px", "period", F.when(F.col("rare"), "other").otherwise(F.col("class").cast("string")).alias("class"))
    w = Window.partitionBy("px").orderBy("period")
    pairs = named.select("period", F.lead("period").over(w).alias("next_period"), F.col("class").alias("from"), F.lead("class").over(w).alias("to"))
    return pairs.where("next_period is not null").groupBy("period", "next_period", "from", "to").agg(F.count("*").alias("n"))


def composite_around(obs: DataFrame, day: str, days: int, key: str = KEY) -> DataFrame:
    """One image of the dates within `days` of a day: mean, median, number."""
    near = obs.where(F.abs(F.datediff(F.to_date("ts"), F.lit(day).cast("date"))) <= days)
    return near.groupBy(key).agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.count("value").alias("n"))


def gap_filled(obs: DataFrame, key: str = KEY) -> DataFrame:
    """Dates without a value take it from the line between the valid dates around them; at the ends the nearest value."""
    t = calendar.epoch(F.col("ts"))
    known = F.when(F.col("value").isNotNull(), F.struct(t.alias("t"), F.col("value").alias("v")))
    rows = obs.withColumn("a", F.last(known, ignorenulls=True).over(in_order(key).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("b", F.last(known, ignorenulls=True).over(backwards(key).rowsBetween(Window.unboundedPreceding, 0)))
    line = F.col("a.v") + divide(F.col("b.v") - F.col("a.v"), (F.col("b.t") - F.col("a.t")).cast("double")) * (t - F.col("a.t"))
    return rows.select(key, "ts", F.coalesce("value", line, "a.v", "b.v").alias("value"))


def stretch(obs: DataFrame, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Limits between which the middle of all values lies, for display: exact percentiles of a date's values."""
    found = percentiles(obs, ["ts"], "value", {"lo": lo, "hi": hi})
    return obs.select("ts").distinct().join(found, "ts", "left")
