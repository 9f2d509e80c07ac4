"""Design-based surveys: strata, samples, estimators, accuracy, agreement of dates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divide

Z95 = 1.959963984540054
HASH_RANGES = 1024  #: ranges of hashes within a stratum


def confusion(samples: DataFrame) -> DataFrame:
    """Samples by map and reference class."""
    return samples.groupBy("map", "reference").agg(F.count("*").alias("n"))


def kappa(samples: DataFrame) -> DataFrame:
    """Overall agreement and Cohen's kappa; none where chance alone agrees always."""
    n = confusion(samples)
    whole = n.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("map") == F.col("reference"), F.col("n")).otherwise(0)).alias("same"))
    rows = n.groupBy(F.col("map").alias("class")).agg(F.sum("n").alias("a"))
    cols = n.groupBy(F.col("reference").alias("class")).agg(F.sum("n").alias("b"))
    chance = rows.join(cols, "class").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    out = whole.join(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("all"), F.col("ab") / (F.col("all") * F.col("all"))
    return out.select(F.col("all").alias("n"), po.alias("overall"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def stratified_means(samples: DataFrame, strata: DataFrame) -> DataFrame:
    """Weighted mean of y over strata (stratum, size) with its standard error; strata without samples are left out and the others' weights made to sum to 1."""
    per = samples.where("y is not null").groupBy("stratum").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("v"))
    both = strata.join(per, "stratum").withColumn("w", F.col("size") / F.sum("size").over(Window.partitionBy()))
    se = F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("v") / F.col("n")))
    mean = F.sum(F.col("w") * F.col("m"))
    return both.agg(F.sum("n").alias("n"), mean.alias("mean"), se.alias("se"), (mean - Z95 * se).alias("low"), (mean + Z95 * se).alias("high"))


def stratified_ratio(samples: DataFrame, strata: DataFrame) -> DataFrame:
    """Ratio of the weighted totals of y and x over strata, with its linearised standard error."""
    per = samples.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("vy"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("vx"), F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("cxy"))
    both = strata.join(per, "stratum")
    totals = both.agg(F.sum(F.col("size") * F.col("my")).alias("ty"), F.sum(F.col("size") * F.col("mx")).alias("tx"))
    r = divide(F.col("ty"), F.col("tx"))
    joined = both.join(F.broadcast(totals))  # one row
    var = F.sum(F.col("size") * F.col("size") * (F.col("vy") + r * r * F.col("vx") - 2 * r * F.col("cxy")) / F.col("n"))
    return joined.groupBy("ty", "tx").agg(F.sum("n").alias("n"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("s")).select("n", r.alias("ratio"), divide(F.col("s"), F.abs("tx")).alias("se"))


def area_weighted_accuracy(samples: DataFrame, areas: DataFrame) -> DataFrame:
    """User's and producer's accuracy and error-adjusted area by class, weighted by mapped areas (map, area); strata are the map's classes."""
    n = samples.groupBy("map", "reference").agg(F.count("*").alias("n"))
    w = areas.withColumn("w", F.col("area") / F.sum("area").over(Window.partitionBy()))
    share = n.join(w, "map").withColumn("of", F.sum("n").over(Window.partitionBy("map"))).withColumn("p", F.col("w") * F.col("n") / F.col("of"))
    rows = share.groupBy(F.col("map").alias("class")).agg(F.sum("p").alias("row"), F.sum(F.when(F.col("map") == F.col("reference"), F.col("p")).otherwise(0.0)).alias("hit"), F.sum(F.when(F.col("map") == F.col("reference"), F.col("n")).otherwise(0)).alias("n_hit"), F.sum("n").alias("n"))
    cols = share.groupBy(F.col("reference").alias("class")).agg(F.sum("p").alias("col"), F.sum((F.col("w") * F.col("p") - F.col("p") * F.col("p")) / F.when(F.col("of") > 1, F.col("of") - 1)).alias("var"))
    total = areas.agg(F.sum("area").alias("total"))
    out = rows.join(cols, "class", "full_outer").join(F.broadcast(total))  # one row
    return out.select("class", divide(F.col("n_hit"), F.col("n")).alias("users"), divide(F.col("hit"), F.col("col")).alias("producers"), (F.coalesce("col", F.lit(0.0)) * F.col("total")).alias("area"), (F.sqrt("var") * F.col("total")).alias("area_se"))


def date_agreement(samples: DataFrame, tolerance: int) -> DataFrame:
    """How well map years follow reference years: matches within a tolerance, bias and mean error where both have one."""
    both = samples.withColumn("d", F.col("map_year") - F.col("reference_year"))
    return both.agg(
        F.count("*").alias("n"), F.count("d").alias("both"), F.count_if(F.abs("d") <= tolerance).alias("matched"), F.avg("d").alias("bias"), F.avg(F.abs("d")).alias("mae"),
        F.count_if(F.col("map_year").isNotNull() & F.col("reference_year").isNull()).alias("commission"), F.count_if(F.col("map_year").isNull() & F.col("reference_year").isNotNull()).alias("omission"),
    )


def sample_size(shares: list[float], accuracies: list[float], standard_error: float) -> int:
    """Samples that a stratified estimate of overall accuracy needs for a standard error."""
    s = sum(w * math.sqrt(u * (1 - u)) for w, u in zip(shares, accuracies, strict=True))
    return math.ceil((s / standard_error) ** 2)


def allocation(strata: DataFrame, n: int, least: int) -> DataFrame:
    """Samples of each stratum (stratum, size, std): equal, in proportion to size, and Neyman's, at least `least` of each."""
    w = Window.partitionBy()
    share = F.col("size") / F.sum("size").over(w)
    spread = F.col("size") * F.col("std") / F.sum(F.col("size") * F.col("std")).over(w)
    at_least = lambda x: F.greatest(F.lit(least), F.rint(n * x).cast("int"))
    return strata.select("stratum", "size", at_least(1 / F.count("*").over(w)).alias("equal"), at_least(share).alias("proportional"), at_least(spread).alias("neyman"))


def draw(units: DataFrame, strata: DataFrame, unit: str, seed: int) -> DataFrame:
    """n units of each stratum (stratum, n), those with the least hash of seed and unit."""
    ranked = in_hash_order(units, unit, seed).join(strata.select("stratum", "n"), "stratum")
    return ranked.where("__k <= n").drop("__k", "__of", "n")


def in_hash_order(units: DataFrame, unit: str, seed: int) -> DataFrame:
    """`units` with __k, the place of their hash in the stratum, and __of, the stratum's units.

    Hashes are dealt into HASH_RANGES ranges by their beginning, whose counts are summed up; only within a range units are
    put in order, so that no stratum is met in one task.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string")))
    dealt = units.withColumn("__h", order).withColumn("__range", F.floor(F.conv(F.substring("__h", 1, 3), 16, 10).cast("int") * HASH_RANGES / 4096).cast("int"))
    sums = dealt.groupBy(F.col("stratum").alias("__s"), F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__s")
    below = F.coalesce(F.sum("__n").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__s", "__r", below.alias("__below"), F.sum("__n").over(w).alias("__of"))
    k = F.row_number().over(Window.partitionBy("stratum", "__range").orderBy("__h"))
    found = dealt.withColumn("__k", k).join(sums, F.col("stratum").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    return found.withColumn("__k", F.col("__k") + F.col("__below")).drop("__h", "__range", "__s", "__r", "__below")


def area_by_year(changes: DataFrame, cell_ha: float) -> DataFrame:
    return changes.where("year is not null").groupBy("year").agg(F.count("*").alias("cells"), (F.count("*") * cell_ha).alias("ha"))


def split_in_strata(samples: DataFrame, share: float, unit: str, seed: int) -> DataFrame:
    """`calibration` for a share of each stratum by hash order, else `validation`."""
    ranked = in_hash_order(samples, unit, seed)
    return ranked.withColumn("part", F.when(F.col("__k") <= F.rint(share * F.col("__of")), "calibration").otherwise("validation")).drop("__k", "__of")


def block_folds(points: DataFrame, size: float, folds: int) -> DataFrame:
    """Folds of spatial blocks of `size`, dealt by the block's hash so that a block is never split."""
    block = F.concat_ws(":", F.floor(F.col("x") / size).cast("string"), F.floor(F.col("y") / size).cast("string"))
    return points.withColumn("fold", (F.conv(F.substring(F.md5(block), 1, 8), 16, 10).cast("long") % folds).cast("int"))
