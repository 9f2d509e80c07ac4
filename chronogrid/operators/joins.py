"""Joins of series by date, of cells by place, and of maps by cell.

Nearest dates are found by equality of blocks of days, never by comparing all dates of a key.  Polygons are a stated set of
zones, broadcast when `ZONES` or fewer, joined by tiles of their bounding boxes beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from .ranks import percentiles

ZONES = 5_000  #: zones that are broadcast, at most
DAY = 86_400_000_000


def match_nearest(left: DataFrame, right: DataFrame, days: float = 8.0, key: str = "px") -> DataFrame:
    """Each left row (key, ts, value) with the value of the nearest right date within `days`, the earlier on ties; left outer."""
    reach = int(days * DAY)
    l = left.select(key, "ts", "value").withColumn("t", calendar.micros(F.col("ts")))
    r = right.select(key, calendar.micros(F.col("ts")).alias("u"), F.col("value").alias("other"))
    spread = F.explode(F.sequence(F.floor((F.col("t") - reach) / reach), F.floor((F.col("t") + reach) / reach)))
    near = l.select(key, "t", spread.alias("block")).distinct().join(r.withColumn("block", F.floor(F.col("u") / reach)), [key, "block"])
    near = near.where(F.abs(F.col("u") - F.col("t")) <= reach)
    best = near.groupBy(key, "t").agg(F.min(F.struct(F.abs(F.col("u") - F.col("t")).alias("d"), "u", "other")).alias("b"))
    out = l.join(best, [key, "t"], "left")
    return out.select(key, "ts", "value", F.col("b.other").alias("other"), (F.col("b.d") / DAY).alias("days"))


def match_exact(left: DataFrame, right: DataFrame, key: str = "px") -> DataFrame:
    """By equal days; the first right date of a day."""
    first = right.groupBy(key, F.to_date("ts").alias("day")).agg(F.min(F.struct("ts", F.col("value").alias("other"))).alias("b"))
    out = left.withColumn("day", F.to_date("ts")).join(first, [key, "day"], "left")
    return out.select(key, "ts", "value", F.col("b.other").alias("other"))


def match_period(left: DataFrame, right: DataFrame, unit: str, key: str = "px") -> DataFrame:
    """The nearest right date within the same year or month, the earlier on ties."""
    p = lambda ts: F.date_trunc(unit, ts)
    l = left.select(key, "ts", "value", calendar.micros(F.col("ts")).alias("t"), p(F.col("ts")).alias("p"))
    r = right.select(key, calendar.micros(F.col("ts")).alias("u"), F.col("value").alias("other"), p(F.col("ts")).alias("p"))
    near = l.join(r, [key, "p"]).groupBy(key, "ts").agg(F.min(F.struct(F.abs(F.col("u") - F.col("t")).alias("d"), "u", "other")).alias("b"))
    return l.select(key, "ts", "value").join(near, [key, "ts"], "left").select(key, "ts", "value", F.col("b.other").alias("other"))


def match_statistics(matched: DataFrame) -> DataFrame:
    """How many dates met, over all and by share, and the mean gap where it is known."""
    gap = F.avg("days") if "days" in matched.columns else F.lit(None).cast("double")
    return matched.agg(F.count("*").alias("n"), F.count("other").alias("matched"), (F.count("other") / F.count("*")).alias("share"), gap.alias("mean_days"))


def quality_masked(obs: DataFrame, quality: DataFrame, clear, key: str = "px") -> DataFrame:
    """Values become none where the codes of the same key and date aren't clear; dates without a code stay."""
    out = obs.join(quality, [key, "ts"], "left")
    return out.select(key, "ts", F.when(F.coalesce(clear(F.col("q")), F.lit(True)), F.col("value")).alias("value"))


def run_mask(obs: DataFrame, mask: DataFrame, key: str = "px") -> DataFrame:
    """Only keys at which the mask (key, value) is known and not 0."""
    return obs.join(mask.where("value <> 0").select(key), key, "left_semi")


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether a point lies in a ring (array of struct x, y; closed or not)."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        between = (p["y"] > y) != (q["y"] > y)
        return F.when(between, (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1


def cells_in_zones(cells: DataFrame, zones: DataFrame, tile: float = 8.0) -> DataFrame:
    """(zone, and the cells' columns): a cell counts in every zone whose ring has its centre (cells: x, y; zones: zone, ring)."""
    xs, ys = (F.expr(f"transform(ring, p -> p.{c})") for c in "xy")
    tiles = zones.select("zone", "ring", F.floor(F.array_min(xs) / tile).alias("a"), F.floor(F.array_max(xs) / tile).alias("b"), F.floor(F.array_min(ys) / tile).alias("c"), F.floor(F.array_max(ys) / tile).alias("d"))
    tiles = tiles.select("zone", "ring", F.explode(F.sequence("a", "b")).alias("tx"), "c", "d").select("zone", "ring", "tx", F.explode(F.sequence("c", "d")).alias("ty"))
    if zones.limit(ZONES + 1).count() <= ZONES:
        tiles = F.broadcast(tiles)
    put = cells.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    hit = put.join(tiles, ["tx", "ty"]).where(inside(F.col("x").cast("double"), F.col("y").cast("double"), F.col("ring")))
    return hit.select("zone", *cells.columns)


def zonal_statistics(obs: DataFrame, cells: DataFrame, zones: DataFrame) -> DataFrame:
    """n, mean, std (of all), extremes and percentiles of the values in each zone at each date (obs: px, ts, value; cells: px, x, y)."""
    rows = obs.where("value is not null").join(cells_in_zones(cells, zones).select("zone", "px"), "px")
    sums = rows.groupBy("zone", "ts").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    shares = percentiles(rows, ["zone", "ts"], "value", {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    return sums.join(shares, ["zone", "ts"]).select("zone", "ts", "n", "mean", "std", "min", "p10", "p25", "median", "p75", "p90", "max")


def zonal_classes(classes: DataFrame, cells: DataFrame, zones: DataFrame, cell_area: float = 900.0) -> DataFrame:
    """Cells, square metres, hectares and percent of the zone by class and date (classes: px, ts, class)."""
    rows = classes.where("class is not null").join(cells_in_zones(cells, zones).select("zone", "px"), "px")
    n = rows.groupBy("zone", "ts", "class").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("zone", "ts"))
    return n.select("zone", "ts", "class", "n", (F.col("n") * cell_area).alias("m2"), (F.col("n") * cell_area / 10000).alias("ha"), (100.0 * F.col("n") / whole).alias("percent"))


def rasterize(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """The value of the last zone (zone, rank, value, ring) that has each cell's centre; none where no zone has it."""
    hit = cells_in_zones(cells, zones.select("zone", "ring")).join(zones.select("zone", "rank", "value"), "zone")
    top = hit.groupBy("px").agg(F.max(F.struct("rank", "value")).alias("t")).select("px", F.col("t.value").alias("value"))
    return cells.select("px", "x", "y").join(top, "px", "left")


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace rule."""
    n = F.size(ring)
    step = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(step, F.lit(0.0), lambda a, b: a + b)) / 2


def point_lookup(points: DataFrame, obs: DataFrame, x0: float, y0: float, size: float, width: int) -> DataFrame:
    """Values of the cell in which each point (id, x, y) lies, on a grid of `width` columns."""
    cell = (F.floor((F.col("y") - y0) / size) * width + F.floor((F.col("x") - x0) / size)).cast("long")
    return points.withColumn("px", cell).join(obs, "px", "left")


def compare_alerts(changes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Cells by whether the map (px, year), the alerts (px, year) or both have them, with Dice's share and lag statistics."""
    both = changes.select("px", F.col("year").alias("a")).join(alerts.select("px", F.col("year").alias("b")), "px", "full_outer")
    lag = F.col("b") - F.col("a")
    out = both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_map"), F.count_if(F.col("a").isNull()).alias("only_alerts"),
        F.avg(lag).alias("mean_lag"), F.percentile(lag, 0.5).alias("median_lag"), F.count_if(lag == 0).alias("same_year"),
    )
    return out.withColumn("dice", F.try_divide(2.0 * F.col("both"), 2.0 * F.col("both") + F.col("only_map") + F.col("only_alerts")))


def resolved_labels(labels: DataFrame) -> DataFrame:
    """One label for each sample of several interpreters' (sample, interpreter, label): the most frequent, the least on ties; with their number and whether all agree."""
    n = labels.where("label is not null").groupBy("sample", "label").agg(F.count("*").alias("n"))
    best = n.groupBy("sample").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"), F.sum("n").alias("of"), F.count("*").alias("labels"))
    return best.select("sample", (-F.col("b.l")).alias("label"), F.col("b.n").alias("votes"), "of", (F.col("labels") == 1).alias("unanimous"))


def strata_without_samples(strata: DataFrame, samples: DataFrame) -> DataFrame:
    return strata.select("stratum").distinct().join(samples.select("stratum").distinct(), "stratum", "left_anti")


def line_profile(lines: DataFrame, cells: DataFrame, obs: DataFrame, step: float = 1.0) -> DataFrame:
    """Values along lines (line, x0, y0, x1, y1) every `step` cells, from the nearest cell: line, distance, px, ts, value."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    points = lines.select("line", "x0", "y0", "x1", "y1", length.alias("length"), F.explode(F.sequence(F.lit(0), F.floor(length / step).cast("int"))).alias("k"))
    share = F.try_divide(F.col("k") * F.lit(step), F.col("length"))
    at = lambda c: F.floor(F.col(f"{c}0") + F.coalesce(share, F.lit(0.0)) * (F.col(f"{c}1") - F.col(f"{c}0")) + 0.5)
    put = points.select("line", (F.col("k") * F.lit(step)).alias("distance"), at("x").alias("cx"), at("y").alias("cy"))
    named = cells.select("px", F.floor("x").alias("cx"), F.floor("y").alias("cy"))
    return put.join(named, ["cx", "cy"]).join(obs, "px").select("line", "distance", "px", "ts", "value")


def feature_series(obs: DataFrame, cells: DataFrame, zones: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Each feature's series: the mean over a polygon's cells, the cell's own value at a point (feature, x, y)."""
    inside_ = cells_in_zones(cells, zones).select(F.col("zone").cast("string").alias("feature"), "px")
    at = points.select(F.col("feature").cast("string").alias("feature"), (F.floor("y") * width + F.floor("x")).cast("long").alias("px"))
    return obs.join(inside_.unionByName(at), "px").groupBy("feature", "ts").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def buffered_folds(points: DataFrame, radius: float) -> DataFrame:
    """For each point (id, x, y), how many others lie within a radius and so leave its training set; points are dealt by tiles as wide as the radius."""
    tile = lambda c: F.floor(F.col(c) / radius)
    a = points.select("id", "x", "y", F.explode(F.sequence(tile("x") - 1, tile("x") + 1)).alias("tx"), tile("y").alias("t")).select("id", "x", "y", "tx", F.explode(F.sequence(F.col("t") - 1, F.col("t") + 1)).alias("ty"))
    b = points.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), tile("x").alias("tx"), tile("y").alias("ty"))
    near = a.join(b, ["tx", "ty"]).where((F.col("id") != F.col("other")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= radius))
    return points.select("id").join(near.groupBy("id").agg(F.count("*").alias("left_out")), "id", "left").select("id", F.coalesce("left_out", F.lit(0)).alias("left_out"))


EARTH = 6_371_007.2  #: radius in metres of the sphere of the Earth's area


def cell_area(lat: Column, size: float) -> Column:
    """Square metres of a cell of `size` degrees whose centre is at a latitude, on the authalic sphere."""
    band = F.sin(F.radians(lat + size / 2)) - F.sin(F.radians(lat - size / 2))
    return F.lit(EARTH * EARTH) * F.radians(F.lit(size)) * band


def class_areas(classes: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Hectares of each class and date, with the whole of each date (class NULL), from cells (px, lat) of `size` degrees."""
    rows = classes.join(cells.select("px", (cell_area(F.col("lat"), size) / 10000).alias("ha")), "px")
    return rows.rollup("ts", "class").agg(F.sum("ha").alias("ha"), F.count("*").alias("n"), F.grouping("class").alias("whole")).where("ts is not null").drop("whole")
