"""Operators on grids (x, y, and a value at a date or none): neighbourhoods, blocks, components, change vectors.

A neighbourhood is joined by the cell: every cell sends its value to the cells around it, so a date's grid is never gathered
in one task, and sums are aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divide
from .ranks import counted, cumulative


def offsets(radius: int, shape: str = "square") -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(a, b) for a in r for b in r if shape == "square" or a * a + b * b <= radius * radius]


def spread(cells: DataFrame, around: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """Each cell's value, sent to the cells around it: keys, x, y, v."""
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in around])
    out = cells.where("value is not null").select(*keys, "x", "y", F.col("value").alias("v"), F.explode(steps).alias("o"))
    return out.select(*keys, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "v")


def focal(cells: DataFrame, around: list[tuple[int, int]], keys: list[str], **aggregates: Column) -> DataFrame:
    """Cells with aggregates of `v`, the values around them."""
    found = spread(cells, around, keys).groupBy(*keys, "x", "y").agg(*[c.alias(k) for k, c in aggregates.items()])
    return cells.join(found, [*keys, "x", "y"], "left")


def hotspots(cells: DataFrame, radius: int, keys: list[str], shape: str = "square") -> DataFrame:
    """Getis-Ord Gi*: the neighbourhood's sum against what the date's mean and deviation lead one to expect, in deviations."""
    whole = cells.where("value is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    near = focal(cells, offsets(radius, shape), keys, w=F.count("v"), s=F.sum("v")).join(whole, keys)
    n, w = F.col("n"), F.col("w")
    scale = F.col("std") * F.sqrt(divide(n * w - w * w, n - 1))
    return near.where("value is not null").select(*keys, "x", "y", divide(F.col("s") - F.col("mean") * w, F.when(scale > 0, scale)).alias("gi"))


def majority(cells: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """The most frequent value around each cell; its own if that is among the most frequent, else the least of them."""
    n = spread(cells, offsets(radius), keys).groupBy(*keys, "x", "y", "v").agg(F.count("*").alias("n"))
    own = cells.where("value is not null").select(*keys, "x", "y", F.col("value").alias("own"))
    rated = n.join(own, [*keys, "x", "y"])
    best = rated.groupBy(*keys, "x", "y").agg(F.max(F.struct("n", (F.col("v") == F.col("own")).alias("is_own"), (-F.col("v")).alias("v"))).alias("b"))
    return best.select(*keys, "x", "y", (-F.col("b.v")).alias("value"))


def lee_filter(cells: DataFrame, radius: int, looks: float, keys: list[str]) -> DataFrame:
    """Lee's speckle filter: the local mean, moved towards the value by the share of its variance that noise of `looks` doesn't explain."""
    near = focal(cells, offsets(radius), keys, m=F.avg("v"), var=F.var_pop("v"))
    noise = F.col("m") * F.col("m") / looks
    k = F.greatest(F.lit(0.0), divide(F.col("var") - noise, F.when(F.col("var") > 0, F.col("var"))))
    return near.select(*keys, "x", "y", F.when(F.col("value").isNotNull(), F.col("m") + F.coalesce(k, F.lit(0.0)) * (F.col("value") - F.col("m"))).alias("value"))


def quegan_filter(cells: DataFrame, radius: int) -> DataFrame:
    """Quegan's multitemporal filter: the local mean times the mean over dates of value / local mean (cells: x, y, ts, value)."""
    near = focal(cells, offsets(radius), ["ts"], m=F.avg("v"))
    ratio = F.avg(divide(F.col("value"), F.when(F.col("m") != 0, F.col("m")))).over(Window.partitionBy("x", "y"))
    return near.select("ts", "x", "y", F.when(F.col("value").isNotNull(), F.col("m") * ratio).alias("value"))


def overview(cells: DataFrame, factor: int, keys: list[str]) -> DataFrame:
    """Means of blocks of factor by factor cells."""
    b = lambda c: F.floor(F.col(c) / factor)
    return cells.groupBy(*keys, b("x").alias("x"), b("y").alias("y")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def change_vectors(before: DataFrame, after: DataFrame, bands: list[str], key: str = "px") -> DataFrame:
    """Length and sector (bits of the bands that rose) of the change of bands between two images."""
    both = before.select(key, *[F.col(b).alias(f"b_{b}") for b in bands]).join(after.select(key, *[F.col(b).alias(f"a_{b}") for b in bands]), key)
    d = [F.col(f"a_{b}") - F.col(f"b_{b}") for b in bands]
    square, sector = F.lit(0.0), F.lit(0)
    for k, x in enumerate(d):
        square = square + x * x
        sector = sector + F.when(x > 0, 1 << k).otherwise(0)
    return both.select(key, F.sqrt(square).alias("magnitude"), F.when(square.isNotNull(), sector).alias("sector"))


def brightness(cube: DataFrame, coefficients: dict[str, dict[str, float]], key: list[str]) -> DataFrame:
    """Fixed linear maps of bands, such as tasseled cap components: one column for each."""
    out = []
    for name, weights in coefficients.items():
        c = F.lit(0.0)
        for band, w in weights.items():
            c = c + F.col(band) * F.lit(w)
        out.append(c.alias(name))
    return cube.select(*key, *out)


def relative_calibration(pairs: DataFrame, by: str) -> DataFrame:
    """Gain and offset by which a target follows a reference, from orthogonal regression of invariant cells (by, reference, target)."""
    m = pairs.groupBy(by).agg(F.avg("target").alias("mx"), F.avg("reference").alias("my"), F.var_pop("target").alias("xx"), F.var_pop("reference").alias("yy"), F.covar_pop("target", "reference").alias("xy"), F.count("*").alias("n"))
    d = F.col("yy") - F.col("xx")
    gain = divide(d + F.sqrt(d * d + 4 * F.col("xy") * F.col("xy")), 2 * F.when(F.col("xy") != 0, F.col("xy")))
    return m.select(by, "n", gain.alias("gain"), (F.col("my") - gain * F.col("mx")).alias("offset"))


def illumination_corrected(obs: DataFrame, keys: list[str]) -> DataFrame:
    """C correction: values (keys, px, value, cos_i, cos_z) scaled by (cos z + c) / (cos i + c), c from the regression of value on cos i."""
    m = obs.groupBy(*keys).agg(F.covar_pop("cos_i", "value").alias("xy"), F.var_pop("cos_i").alias("xx"), F.avg("cos_i").alias("mx"), F.avg("value").alias("my"))
    slope = divide(F.col("xy"), F.when(F.col("xx") > 0, F.col("xx")))
    m = m.select(*keys, divide(F.col("my") - slope * F.col("mx"), F.when(slope != 0, slope)).alias("c"))
    fixed = F.col("value") * divide(F.col("cos_z") + F.col("c"), F.col("cos_i") + F.col("c"))
    return obs.join(m, keys).select(*keys, "px", F.coalesce(fixed, F.col("value")).alias("value"))


def lagged_correlation(obs: DataFrame, driver: DataFrame, lags: list[int], key: str = "px") -> DataFrame:
    """Correlation of each key's monthly means with a driver (month number, value) that many months before; the driver is one row a month."""
    month = F.year("ts") * 12 + F.month("ts") - 1
    monthly = obs.where("value is not null").groupBy(key, month.alias("month")).agg(F.avg("value").alias("y"))
    moved = driver.select(F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "month", "value").select("lag", (F.col("month") + F.col("lag")).alias("month"), F.col("value").alias("x"))
    pairs = monthly.join(moved, "month")
    m = pairs.groupBy(key, "lag").agg(F.count("*").alias("n"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    r = divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    return m.select(key, "lag", "n", F.when((F.col("n") >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0), r).alias("r"))


def false_discovery(tests: DataFrame, p: str, alpha: float, by: str) -> DataFrame:
    """Benjamini-Hochberg: tests that stay significant at a false discovery rate; ranks are counted within `by`."""
    ranked = cumulative(counted(tests, [by], p), [by], p)
    limit = F.max(F.when(F.col(p) <= alpha * (F.col("before") + F.col("n")) / F.col("of"), F.col(p)))
    limits = ranked.groupBy(F.col(by).alias("__by")).agg(limit.alias("__limit"))
    return tests.join(limits, F.col(by).eqNullSafe(F.col("__by")), "left").withColumn("significant", F.coalesce(F.col(p) <= F.col("__limit"), F.lit(False))).drop("__by", "__limit")


def patches(cells: DataFrame, cut, diagonal: bool = False) -> DataFrame:
    """Connected patches of cells (x, y, value) of equal values: patch (its least cell's number), value, cells."""
    return patch_labels(cells, cut, diagonal).groupBy(F.col("label").alias("patch"), "value").agg(F.count("*").alias("cells"))


def patch_labels(cells: DataFrame, cut, diagonal: bool = False) -> DataFrame:
    """x, y, value and the label of each cell's patch.

    Labels spread by the least of the neighbours' and double their reach by following the labels' own labels; `cut` ends
    lineage after each round, for instance DataFrame.checkpoint.
    """
    around = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if diagonal else [])
    number = lambda x, y: (x.cast("long") * F.lit(1 << 32) + y.cast("long")).alias("id")
    known = cells.where("value is not null").select("x", "y", "value", number(F.col("x"), F.col("y")))
    right = known.select("x", "y", F.col("value").alias("v"), F.col("id").alias("other"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around]))
    moved = known.select("id", "value", "x", "y", steps.alias("o")).select("id", "value", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"))
    edges = moved.join(right, ["x", "y"]).where("value = v").select(F.col("id").alias("a"), F.col("other").alias("b"))
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(known.select("id", F.col("id").alias("label")))
    while True:
        least = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(least, labels["id"] == least["a"], "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = cut(new.join(jump, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label"), "was"))
        if not new.where("label <> was").take(1):
            break
        labels = new.select("id", "label")
    return known.join(labels, "id").select("x", "y", "value", "label")


def sieved(cells: DataFrame, smallest: int, cut) -> DataFrame:
    """Cells of patches of fewer than `smallest` cells take the most frequent class around them (the least on ties), if there is another one."""
    labels = patch_labels(cells, cut)
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    marked = labels.join(size, "label").select("x", "y", "value", (F.col("size") < smallest).alias("small"))
    around = spread(marked.where("not small"), [(a, b) for a, b in offsets(1) if (a, b) != (0, 0)], [])
    votes = around.groupBy("x", "y", "v").agg(F.count("*").alias("n")).groupBy("x", "y").agg(F.max(F.struct("n", (-F.col("v")).alias("v"))).alias("b"))
    out = marked.join(votes, ["x", "y"], "left")
    return out.select("x", "y", F.when(F.col("small"), F.coalesce(-F.col("b.v"), F.col("value"))).otherwise(F.col("value")).alias("value"))


def smoothed_probabilities(cells: DataFrame, radius: int, weight: float) -> DataFrame:
    """Bayesian smoothing of class probabilities (x, y, class, value) in logits: the neighbourhood's mean and the cell's own, weighted by their variances (`weight` is the own one)."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("value")))
    logit = cells.select("x", "y", "class", F.log(p / (1 - p)).alias("value"))
    near = focal(logit, offsets(radius), ["class"], m=F.avg("v"), s2=F.var_pop("v"))
    mixed = (F.col("s2") * F.col("value") + weight * F.col("m")) / (F.col("s2") + weight)
    return near.select("x", "y", "class", (1 / (1 + F.exp(-mixed))).alias("value"))
