"""Per-key tools over time: folds to periods, gaps, interpolation, regular series, trends, agreement of maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.scalar import divide
from .series import KEY, by_key, in_order


def metrics(v: Column) -> dict[str, Column]:
    """Sixteen statistics of values as aggregates; std is that of a sample, skewness and excess kurtosis are those of the moments."""
    p = lambda q: F.percentile(v, q)
    n, m1 = F.count(v), F.avg(v)
    return {
        "count": n, "min": F.min(v), "p5": p(0.05), "p10": p(0.1), "p25": p(0.25), "median": p(0.5), "p75": p(0.75), "p90": p(0.9), "p95": p(0.95),
        "max": F.max(v), "range": F.max(v) - F.min(v), "iqr": p(0.75) - p(0.25), "mean": m1, "std": F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))),
        "skew": F.skewness(v), "kurtosis": F.kurtosis(v),
    }


def temporal_metrics(obs: DataFrame, names: list[str] | None = None, key: str = KEY) -> DataFrame:
    found = metrics(F.col("value"))
    return obs.groupBy(key).agg(*[found[m].alias(f"m_{m}") for m in names or found])


def fold(obs: DataFrame, by: str, names: list[str], key: str = KEY) -> DataFrame:
    """Statistics by quarter, month, week or day of a year of 365 days, or by year; every period of every key has a row, empty ones a count of 0."""
    if by == "year":
        span = obs.groupBy(key).agg(F.min(F.year("ts")).alias("lo"), F.max(F.year("ts")).alias("hi"))
        spine = span.select(key, F.explode(F.sequence("lo", "hi")).alias("period"))
        part = F.year("ts")
    else:
        n, of = calendar.PARTS[by]
        spine = obs.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("period"))
        part = of(F.col("ts"))
    found = metrics(F.col("value"))
    stats = obs.where(F.col("value").isNotNull()).groupBy(key, part.cast("int").alias("period")).agg(*[found[m].alias(f"f_{m}") for m in names])
    out = spine.join(stats, [key, "period"], "left")
    return out.withColumn("f_count", F.coalesce("f_count", F.lit(0))) if "count" in names else out


def clear_observations(obs: DataFrame, months: int, key: str = KEY) -> DataFrame:
    """For each window of `months` from the key's first month: valid dates, and the longest and mean gap between them in days, the window's edges included."""
    number = F.year("ts") * 12 + F.month("ts") - 1
    first = obs.groupBy(key).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    windows = first.select(key, F.explode(F.sequence("lo", "hi", F.lit(months))).alias("window"))
    edge = lambda m: F.make_date((F.floor(m / 12)).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))
    days = lambda d: F.unix_date(d)
    windows = windows.select(key, "window", days(edge(F.col("window"))).alias("start"), days(edge(F.col("window") + months)).alias("end"))
    valid = obs.where(F.col("value").isNotNull()).join(first, key)
    valid = valid.select(key, (F.col("lo") + F.floor((number - F.col("lo")) / months) * months).cast("int").alias("window"), days(F.to_date("ts")).alias("day"))
    edges = windows.select(key, "window", F.explode(F.array("start", "end")).alias("day"), F.lit(0).alias("obs"))
    points = valid.withColumn("obs", F.lit(1)).unionByName(edges)
    gap = F.col("day") - F.lag("day").over(Window.partitionBy(key, "window").orderBy("day", "obs"))
    return points.withColumn("gap", gap).groupBy(key, "window").agg(F.sum("obs").alias("o_count"), F.max("gap").alias("o_max"), F.avg("gap").alias("o_mean"))


def spine(obs: DataFrame, step: int, key: str = KEY) -> DataFrame:
    """(key, ts): dates from the key's first valid one on, every `step` days."""
    d = obs.where(F.col("value").isNotNull()).groupBy(key).agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    n = F.floor((F.datediff("hi", "lo") + 1) / step)
    return d.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: F.date_add("lo", i * step))).alias("day"))


def interpolate_linear(obs: DataFrame, step: int, key: str = KEY) -> DataFrame:
    """Values on a regular grid, on the line between the valid dates before and after; none outside them."""
    valid = obs.where(F.col("value").isNotNull()).groupBy(key, F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    both = valid.withColumn("grid", F.lit(0)).unionByName(spine(obs, step, key).select(key, "day", F.lit(None).cast("double").alias("value"), F.lit(1).alias("grid")))
    day = F.unix_date("day")
    known = F.when(F.col("value").isNotNull(), F.struct(day.alias("d"), F.col("value").alias("v")))
    order = Window.partitionBy(key).orderBy(day, "grid")
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # (over the descending order, for a frame that ends with the key's last date is summed up anew for each row)
    after = F.last(known, ignorenulls=True).over(Window.partitionBy(key).orderBy(day.desc(), F.col("grid").desc()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("a", before).withColumn("b", after).withColumn("d", day).where("grid = 1")
    slope = divide(F.col("b.v") - F.col("a.v"), F.col("b.d") - F.col("a.d"))
    return both.select(key, "day", F.when(F.col("a.d") == F.col("d"), F.col("a.v")).otherwise(F.col("a.v") + slope * (F.col("d") - F.col("a.d"))).alias("value"))


def near_grid(obs: DataFrame, step: int, reach: int, key: str = KEY) -> DataFrame:
    """(key, day, gap, v): valid values within `reach` days of each date of the grid; equal blocks of days are joined."""
    valid = obs.where(F.col("value").isNotNull()).select(key, F.unix_date(F.to_date("ts")).alias("d"), F.col("value").alias("v"))
    block = max(1, reach)
    grid = spine(obs, step, key).withColumn("g", F.unix_date("day"))
    grid = grid.select(key, "day", "g", F.explode(F.sequence(F.floor((F.col("g") - reach) / block), F.floor((F.col("g") + reach) / block))).alias("block"))
    found = grid.join(valid.withColumn("block", F.floor(F.col("d") / block)), [key, "block"]).where(F.abs(F.col("d") - F.col("g")) <= reach)
    return found.select(key, "day", (F.col("d") - F.col("g")).alias("gap"), "v")


def interpolate_moving(obs: DataFrame, step: int, reach: int, key: str = KEY) -> DataFrame:
    """Mean of the valid values within `reach` days of each date of the grid."""
    found = near_grid(obs, step, reach, key).groupBy(key, "day").agg(F.avg("v").alias("value"))
    return spine(obs, step, key).join(found, [key, "day"], "left")


def interpolate_rbf(obs: DataFrame, step: int, sigma: float, reach: int, key: str = KEY) -> DataFrame:
    """Mean of the valid values near each date of the grid, weighted by a Gaussian of their distance."""
    near = near_grid(obs, step, reach, key)
    w = F.exp(-(F.col("gap") * F.col("gap")) / F.lit(2.0 * sigma * sigma))
    found = near.groupBy(key, "day").agg(divide(F.sum(w * F.col("v")), F.sum(w)).alias("value"))
    return spine(obs, step, key).join(found, [key, "day"], "left")


def standardize(obs: DataFrame, method: str = "normalize", key: str = KEY) -> DataFrame:
    """Values less their mean, and over their sample deviation when normalizing; a key with fewer than two stays as it is, a constant one becomes none."""
    mean, std, n = (f("value").over(by_key(key)) for f in (F.avg, F.stddev_samp, F.count))
    centred = F.col("value") - mean
    new = centred if method == "center" else F.when(std > 0, divide(centred, std))
    return obs.select(key, "ts", F.when(n < 2, F.col("value")).otherwise(new).alias("value"))


def regression(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Least squares of y on x by group: mean, offset, slope, rsq, rmse, mae, maxe, num; one pass for the line, one for its errors."""
    xc, yc = F.col(x), F.col(y)
    valid = points.where(xc.isNotNull() & yc.isNotNull())
    m = valid.groupBy(*keys).agg(F.count("*").alias("num"), F.avg(xc).alias("mx"), F.avg(yc).alias("mean"), F.var_pop(xc).alias("sxx"), F.var_pop(yc).alias("syy"), F.covar_pop(xc, yc).alias("sxy"))
    m = m.withColumn("slope", divide(F.col("sxy"), F.col("sxx"))).withColumn("offset", F.col("mean") - F.col("slope") * F.col("mx"))
    e = F.abs(yc - F.col("offset") - F.col("slope") * xc)
    errors = valid.join(m, keys).groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.max(e).alias("maxe"))
    rsq = F.when(F.col("syy") > 0, divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))).otherwise(0.0)
    return m.join(errors, keys).select(*keys, "num", "mean", "offset", "slope", rsq.alias("rsq"), "rmse", "mae", "maxe")


def linear_trend(obs: DataFrame, by: str = "year", key: str = KEY) -> DataFrame:
    """Trend of the means by year over their positions; empty years count as steps.  Gains are of the line from its first to its last position."""
    folded = fold(obs, by, ["mean"], key)
    first = folded.groupBy(key).agg(F.min("period").alias("lo"), (F.max("period") - F.min("period") + 1).alias("len"))
    points = folded.join(first, key).select(key, (F.col("period") - F.col("lo")).cast("double").alias("x"), F.col("f_mean").alias("y"))
    out = regression(points, [key]).join(first.select(key, "len"), key)
    gain = F.col("slope") * (F.col("len") - 1)
    return out.withColumn("abs_gain", gain).withColumn("pct_gain", 100 * divide(gain, F.abs("offset")))


def change_and_trends(obs: DataFrame, by: str = "year", key: str = KEY) -> DataFrame:
    """The greatest loss between consecutive valid years' means, and the trend in total, before and after it."""
    folded = fold(obs, by, ["mean"], key).where(F.col("f_mean").isNotNull()).select(key, "period", F.col("f_mean").alias("y"))
    loss = F.lag("y").over(Window.partitionBy(key).orderBy("period")) - F.col("y")
    falls = folded.withColumn("loss", loss)
    worst = falls.groupBy(key).agg(F.max(F.when(F.col("loss") > 0, F.struct("loss", (-F.col("period")).alias("p")))).alias("w"), F.min("period").alias("lo"))
    worst = worst.select(key, "lo", F.col("w.loss").alias("loss"), (-F.col("w.p")).alias("change_time"))
    points = folded.join(worst, key).select(key, (F.col("period") - F.col("lo")).cast("double").alias("x"), "y", (F.col("period") >= F.col("change_time")).alias("after"))
    trend = lambda rows, name: regression(rows, [key]).select(key, F.col("slope").alias(f"{name}_slope"), F.col("num").alias(f"{name}_num"))
    out = worst.drop("lo").withColumn("change", F.col("loss").isNotNull().cast("int"))
    for name, rows in (("total", points), ("before", points.where("not after")), ("after", points.where("after"))):
        out = out.join(trend(rows, name), key, "left")
    return out


def mann_kendall(obs: DataFrame, key: str = KEY, z_limit: float = 1.959963984540054) -> DataFrame:
    """Mann-Kendall's S with ties, z, tau, and Sen's line over the index of valid dates; sig_slope only where |z| passes the limit."""
    valid = obs.where(F.col("value").isNotNull())
    points = valid.withColumn("i", F.row_number().over(in_order(key)) - 1)
    ties = points.groupBy(key, "value").agg(F.count("*").alias("t")).groupBy(key).agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties"))
    rows = points.groupBy(key).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda p: p["value"]).alias("v"))
    after = lambda i: F.slice("v", i + 2, F.size("v"))
    signs = F.aggregate(F.transform("v", lambda a, i: F.aggregate(after(i), F.lit(0.0), lambda s, b: s + F.signum(b - a))), F.lit(0.0), lambda s, x: s + x)
    slopes = F.array_sort(F.flatten(F.transform("v", lambda a, i: F.transform(after(i), lambda b, j: (b - a) / (j + 1)))))
    from .series import middle

    out = rows.join(ties, key).select(key, "n", "v", "ties", signs.alias("s"), middle(slopes).alias("slope"))
    n = F.col("n")
    var = (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18.0
    z = F.when(F.col("s") == 0, 0.0).otherwise(divide(F.col("s") - F.signum("s"), F.sqrt(var)))
    out = out.withColumn("z", z).withColumn("tau", divide(F.col("s"), n * (n - 1) / 2.0))
    middle_v = middle(F.array_sort("v"))
    trend = F.when(F.abs("z") > z_limit, F.signum("z").cast("int")).otherwise(0)
    return out.select(key, "n", "s", "z", "tau", "slope", (middle_v - F.col("slope") * (n - 1) / 2.0).alias("intercept"), trend.alias("trend"), F.when(F.abs("z") > z_limit, F.col("slope")).alias("sig_slope"))


def agreement(maps: DataFrame, tolerance: int, key: str = KEY) -> DataFrame:
    """Consensus of maps' years of change (key, map, yod): the year most others are within `tolerance` of; on ties the one met exactly most often, then the earliest."""
    found = maps.where(F.col("yod").isNotNull() & (F.col("yod") > 0))
    a, b = found.select(key, F.col("yod").alias("y")).distinct(), found.select(key, F.col("yod").alias("o"))
    support = a.join(b, key).groupBy(key, "y").agg(F.count_if(F.abs(F.col("o") - F.col("y")) <= tolerance).alias("n_agree"), F.count_if(F.col("o") == F.col("y")).alias("exact"))
    best = support.groupBy(key).agg(F.max(F.struct("n_agree", "exact", (-F.col("y")).alias("y"))).alias("b"))
    spread = found.groupBy(key).agg(F.count("*").alias("n_detected"), (F.max("yod") - F.min("yod")).alias("spread"))
    of = maps.groupBy(key).agg(F.count("*").alias("n_maps"))
    out = best.join(spread, key).join(of, key)
    return out.select(key, (-F.col("b.y")).alias("yod"), F.col("b.n_agree").alias("n_agree"), "n_detected", (F.col("b.n_agree") / F.col("n_maps")).alias("share"), "spread")


def regularize(obs: DataFrame, step: str, method: str = "median", key: str = KEY, bands: tuple[str, ...] = ("value",)) -> DataFrame:
    """One date for each month, year or `n days` of a key's span: the median of its bands, or of all its dates the one nearest to the medians (medoid); empty periods stay as rows without values."""
    if step in ("month", "year"):
        period = lambda ts: F.to_date(F.date_trunc(step, ts))
        every = F.expr(f"interval 1 {step}")
    else:
        n = int(step.split()[0])
        period = lambda ts: F.date_from_unix_date((F.floor(F.unix_date(F.to_date(ts)) / n) * n).cast("int"))
        every = F.expr(f"interval {n} day")
    rows = obs.withColumn("period", period(F.col("ts")))
    span = rows.groupBy(key).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    grid = span.select(key, F.explode(F.sequence("lo", "hi", every)).alias("period"))
    medians = rows.groupBy(key, "period").agg(*[F.percentile(b, 0.5).alias(b) for b in bands])
    if method == "medoid":
        named = medians.select(key, "period", *[F.col(b).alias(f"m_{b}") for b in bands])
        far = sum((F.pow(F.col(b) - F.col(f"m_{b}"), F.lit(2.0)) for b in bands[1:]), F.pow(F.col(bands[0]) - F.col(f"m_{bands[0]}"), F.lit(2.0)))
        near = rows.join(named, [key, "period"]).withColumn("far", far).where("far is not null")
        medians = near.groupBy(key, "period").agg(F.min(F.struct("far", calendar.micros(F.col("ts")).alias("at"), *bands)).alias("b")).select(key, "period", *[F.col(f"b.{b}").alias(b) for b in bands])
    return grid.join(medians, [key, "period"], "left")


def regularize_clearest(obs: DataFrame, step: str, key: str = KEY) -> DataFrame:
    """One value for each month or year of a key's span: that of the clearest of the period's dates that has one.

    Dates are ranked within a period by the share of all keys' values that are known, the earlier first on ties; empty
    periods stay as rows without a value.
    """
    period = F.to_date(F.date_trunc(step, F.col("ts")))
    share = obs.groupBy("ts").agg((F.count("value") / F.count("*")).alias("share"))
    rows = obs.withColumn("period", period).join(share, "ts")
    known = F.when(F.col("value").isNotNull(), F.struct("share", (-calendar.micros(F.col("ts"))).alias("at"), "value"))
    best = rows.groupBy(key, "period").agg(F.max(known).alias("b")).select(key, "period", F.col("b.value").alias("value"))
    span = best.groupBy(key).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    grid = span.select(key, F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {step}"))).alias("period"))
    return grid.join(best, [key, "period"], "left")


def greenest_pixel(cube: DataFrame, green: str, bands: list[str], step: str = "year", key: str = KEY) -> DataFrame:
    """Composite by period: all bands at the date at which `green` is greatest, the earlier on ties."""
    period = F.to_date(F.date_trunc(step, F.col("ts")))
    best = cube.where(F.col(green).isNotNull()).groupBy(key, period.alias("period")).agg(F.max(F.struct(F.col(green).alias("g"), (-calendar.micros(F.col("ts"))).alias("at"), *bands)).alias("b"))
    return best.select(key, "period", *[F.col(f"b.{b}").alias(b) for b in bands])


def fill_linear(periods: DataFrame, max_gap_days: int | None = None, key: str = KEY) -> DataFrame:
    """Empty periods on the line between their neighbours, unless these are more than `max_gap_days` apart."""
    day = F.unix_date("period")
    known = F.when(F.col("value").isNotNull(), F.struct(day.alias("d"), F.col("value").alias("v")))
    order = Window.partitionBy(key).orderBy(day)
    rows = periods.withColumn("a", F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("b", F.last(known, ignorenulls=True).over(Window.partitionBy(key).orderBy(day.desc()).rowsBetween(Window.unboundedPreceding, 0)))
    line = F.col("a.v") + divide(F.col("b.v") - F.col("a.v"), F.col("b.d") - F.col("a.d")) * (day - F.col("a.d"))
    if max_gap_days is not None:
        line = F.when(F.col("b.d") - F.col("a.d") <= max_gap_days, line)
    return rows.select(key, "period", F.coalesce("value", line).alias("value"))


def best_pixel(obs: DataFrame, target_doy: int, key: str = KEY) -> DataFrame:
    """Composite by year: the date with the best score of closeness to a day of the year and of clear neighbours in time; earlier on ties."""
    valid = obs.where(F.col("value").isNotNull())
    gap = F.abs(F.dayofyear("ts") - target_doy)
    score = F.greatest(F.lit(0.0), 1 - gap / 183.0)
    best = valid.groupBy(key, F.year("ts").alias("year")).agg(F.max(F.struct(score.alias("score"), (-calendar.micros(F.col("ts"))).alias("at"), "value")).alias("b"))
    return best.select(key, "year", F.col("b.score").alias("score"), F.col("b.value").alias("value"))


def harmonize(obs: DataFrame, lines: DataFrame, key: str = KEY) -> DataFrame:
    """Values of each sensor on the reference's scale: gain * value + offset by sensor; sensors without a line stay (obs: key, ts, sensor, value; lines: a row for each sensor)."""
    out = obs.join(lines, "sensor", "left")
    return out.select(key, "ts", "sensor", (F.coalesce("gain", F.lit(1.0)) * F.col("value") + F.coalesce("offset", F.lit(0.0))).alias("value"))


def desawtooth(classes: DataFrame, key: str = KEY) -> DataFrame:
    """A class that differs from equal ones before and after it becomes theirs (key, period, class)."""
    w = Window.partitionBy(key).orderBy("period")
    a, b = F.lag("class").over(w), F.lead("class").over(w)
    return classes.select(key, "period", F.when((a == b) & (a != F.col("class")), a).otherwise(F.col("class")).alias("class"))
