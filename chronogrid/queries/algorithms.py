"""Kernels and learned models over the test tables: no SQL can express them; tests hold them against known cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices
from ..kernels import changes as C
from ..kernels import images as I
from ..kernels import trends as T
from ..kernels.run import per_key, per_key_bands, per_row_bands
from ..lang import Cube
from ..operators import learning as L
from ..operators import vectors as E
from ..plans import bindings
from .common import Registry, item_obs, obs, table
from .space import _means, classes, grid, vectors

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
BANDS = ["quantity", "discount", "tax"]

KERNELS = {
    "mann_kendall_hamed_rao": (T.mann_kendall("hamed_rao"), T.MANN_KENDALL),
    "mann_kendall_yue_wang": (T.mann_kendall("yue_wang"), T.MANN_KENDALL),
    "mann_kendall_seasonal": (T.mann_kendall("seasonal"), T.MANN_KENDALL),
    "ar_trend": (T.autoregressive_trend(), T.AUTOREGRESSIVE),
    "smooth_whittaker": (T.whittaker(10.0), T.SMOOTHED),
    "smooth_savitzky_golay": (T.savitzky_golay(7, 2), T.SMOOTHED),
    "interpolate_harmonic": (T.harmonic_interpolation(30, 2), T.SMOOTHED),
    "polar_metrics": (T.polar_metrics(), T.POLAR),
    "landtrendr": (C.landtrendr(), C.LANDTRENDR),
    "recovery": (C.recovery(), C.RECOVERY),
    "bfast_lite": (C.break_points(), C.BREAKS),
    "bfast_monitor": (C.monitor(1999.0), C.MONITOR),
    "ewmacd": (C.ewmacd(1998.0), C.EWMACD),
    "sccd_state": (C.kalman_state(), C.KALMAN),
    "tmask": (C.robust_outliers(), C.OUTLIERS),
    "phenology": (C.phenology(), C.PHENOLOGY),
    "twdtw": (C.twdtw({"flat": ([15, 105, 195, 285], [25.0, 25.0, 25.0, 25.0]), "summer": ([15, 105, 195, 285], [10.0, 25.0, 45.0, 25.0])}), C.TWDTW),
    "omnibus": (C.omnibus(4.0), C.OMNIBUS),
    "coded": (C.coded(2.0), C.CODED),
}
for _name, (_kernel, _schema) in KERNELS.items():
    R.add(_name, lambda s, d, k=_kernel, m=_schema: per_key(item_obs(s, d), k, m))

R.add("ccdc", lambda s, d: per_key_bands(bindings.items(s, d).rows, BANDS, C.ccdc(), C.CCDC))
MEMBERS = {"low": [5.0, 0.02, 0.01], "high": [45.0, 0.05, 0.05], "sale": [25.0, 0.1, 0.02]}
UNMIXED = "year double, rmse double, f_low double, f_high double, f_sale double"
R.add("unmix", lambda s, d: per_row_bands(bindings.items(s, d).rows, BANDS, C.unmixed(MEMBERS), UNMIXED))
R.add("ndfi", lambda s, d: per_row_bands(bindings.items(s, d).rows, BANDS, C.unmixed(MEMBERS, False), UNMIXED).withColumn("ndfi", F.try_divide(F.col("f_high") - F.col("f_low") - F.col("f_sale"), F.col("f_high") + F.col("f_low") + F.col("f_sale"))))

# -- models ------------------------------------------------------------------------------------------------------------


def labelled(s, d):
    return vectors(s, d).withColumn("label", F.col("label").cast("double"))


R.add("random_forest", lambda s, d: L.predicted(L.random_forest(labelled(s, d).where("id % 4 <> 0"), "vector", "label", 20), labelled(s, d), "vector").select("id", "label", "prediction", "p"))
R.add("logistic_regression", lambda s, d: L.predicted(L.logistic(labelled(s, d).where("id % 4 <> 0"), "vector", "label"), labelled(s, d), "vector").select("id", "label", "prediction", "p"))
R.add("spatial_cross_validation", lambda s, d: L.cross_predicted(labelled(s, d).withColumn("fold", F.floor(F.col("id") / 50) % 3), "vector", "label", "fold", 3, lambda t: L.random_forest(t, "vector", "label", 10)).select("id", "fold", "label", "prediction"))
R.add("kmeans", lambda s, d: L.kmeans(vectors(s, d), "vector", 10).select("id", "cluster"))
R.add("self_organising_map", lambda s, d: L.self_organised(_means(s, d, 1996), BANDS, 3, 2).select("px", "node"))
R.add("principal_components", lambda s, d: L.principal_components(vectors(s, d), "vector", 3).select("id", *[F.col("pc")[k].alias(f"pc{k + 1}") for k in range(3)]))
R.add("direction_of_change", lambda s, d: _direction(s, d))
R.add("empirical_functions", lambda s, d: L.empirical_functions(_wide(s, d), [f"y{y}" for y in range(1995, 2001)], 3)[0])
R.add("noise_fractions", lambda s, d: L.noise_fractions(_bands(s, d), BANDS, 2)[0])
R.add("irmad", lambda s, d: L.altered_by_reweighting(_means(s, d, 1996), _means(s, d, 1999), BANDS))
R.add("texture", lambda s, d: L.texture(grid(s, d).where("ts = 1997"), 8, 20.0, 32.0, 1, 5))
R.add("tuned_settings", lambda s, d: _tuned(s, d))
R.add("nadir_adjusted", lambda s, d: indices.nadir_adjusted(_angles(s, d), ["red", "nir"]))
R.add("superpixels", lambda s, d: I.per_tile(_customers(s, d), ["s"], 16, I.superpixels(4, 0.5), "segment long"))
R.add("tile_shifts", lambda s, d: I.per_tile(_customers(s, d), ["s", "moved"], 16, I.shift_by_tile(4), "dx double, dy double, peak double"))


def _customers(s, d):
    """Mean prices (in 100,000) on a grid of 50 columns, and the same a cell to the right."""
    g = obs(s, d).groupBy("px").agg((F.avg("value") / 100000).alias("s")).select((F.col("px") % 50).alias("x"), F.floor(F.col("px") / 50).alias("y"), "s")
    return g.join(g.select((F.col("x") + 1).alias("x"), "y", F.col("s").alias("moved")), ["x", "y"], "left")


def _direction(s, d):
    """Principal components of the differences of vectors whose cosine change passes a threshold."""
    a, b = (vectors(s, d).where(f"id % 2 = {k}").select(F.expr("id div 2").alias("id"), "vector") for k in (0, 1))
    changed = E.change(a, b).where(F.col("change") > 0.2)
    both = a.withColumnRenamed("vector", "a").join(b.withColumnRenamed("vector", "b"), "id").join(changed, "id")
    rows = both.select("id", "change", F.zip_with("b", "a", lambda x, y: x.cast("double") - y.cast("double")).alias("vector"))
    return L.principal_components(rows, "vector", 2).select("id", "change", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


def _wide(s, d):
    g = grid(s, d)
    return g.groupBy("x", "y").pivot("ts", list(range(1995, 2001))).agg(F.avg("value")).select("x", "y", *[F.col(str(y)).alias(f"y{y}") for y in range(1995, 2001)])


def _bands(s, d):
    return _means(s, d, 1996).select((F.col("px") % 10).alias("x"), F.floor(F.col("px") / 10).alias("y"), *BANDS)


def _tuned(s, d):
    """Thresholds from a Latin hypercube, scored by the years at which means fall below them."""
    sets = L.latin_hypercube({"threshold": (100000.0, 300000.0)}, 8, 5)
    table_ = s.createDataFrame([(k, x["threshold"]) for k, x in enumerate(sets)], "setting int, threshold double")
    yearly = obs(s, d).groupBy(F.col("px").alias("sample"), F.year("ts").alias("y")).agg(F.avg("value").alias("m"))
    found = yearly.join(F.broadcast(table_), F.col("m") < F.col("threshold")).groupBy("setting", "sample").agg(F.min("y").alias("year"))
    truth = classes(s, d).groupBy(F.col("px").alias("sample")).agg(F.min(F.when(F.col("class") == 1, F.col("period"))).alias("year"))
    return L.scored_settings(found, truth, 1).join(table_, "setting")


def _angles(s, d):
    i = table(s, d, "lineitem")
    return i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("px"), F.date_trunc("month", "l_shipdate").alias("ts"), (20 + F.col("l_quantity")).alias("sza"), (F.col("l_linenumber") * 3.0).alias("vza"), (F.col("l_discount") * 1000).alias("raa"), (F.col("l_tax") + 0.05).alias("red"), (F.col("l_discount") + 0.2).alias("nir"))


# -- indices: every formula of the catalogue over bands made of line items; SQL where the formula is its own SQL ----------
ROLES = {"blue": "l_tax / 2 + 0.02", "green": "l_tax + 0.03", "red": "l_tax + 0.05", "rededge": "l_discount + 0.1", "nir": "l_discount + 0.3", "swir1": "l_quantity / 200 + 0.1", "swir2": "l_quantity / 300 + 0.05"}


def _scene(s, d) -> Cube:
    i = table(s, d, "lineitem")
    return Cube(i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("px"), F.col("l_shipdate").cast("timestamp").alias("ts"), *[F.expr(e).alias(k) for k, e in ROLES.items()]))


def _index_sql(formula: str) -> str:
    """The formula in SQL: only its differences, powers and divisions need another spelling."""
    import re

    text = re.sub(r"nd\((\w+), (\w+)\)", r"((\1 - \2) / (\1 + \2))", formula).replace("(1 / 3)", "(1.0 / 3)")
    rows = ", ".join(f"{e} AS {k}" for k, e in ROLES.items())
    return f"SELECT px, ts, CASE WHEN isfinite(value) THEN value END AS value FROM (SELECT px, ts, ({text})::DOUBLE AS value FROM (SELECT l_orderkey * 10 + l_linenumber AS px, l_shipdate AS ts, {rows} FROM lineitem))"  # a division by zero is no data


for _index, _formula in indices.INDICES.items():
    R.add(f"index_{_index}", lambda s, d, k=_index: indices.index(_scene(s, d), k).withColumnRenamed(k, "value"), _index_sql(_formula), "value", 5)

#: Bands of the scene by centre in nm, and a pair that is narrow enough for PRI
CENTRES = {"blue": 480.0, "green": 560.0, "red": 655.0, "rededge": 717.0, "edge3": 783.0, "nir": 865.0, "swir1": 1609.0, "swir2": 2201.0, "n531": 530.0, "n570": 572.0}


def _fine_scene(s, d) -> Cube:
    scene = _scene(s, d)
    more = {"edge3": F.col("nir") - 0.02, "n531": F.col("green") - 0.01, "n570": F.col("green") + 0.01}
    return Cube(scene.rows.withColumns(more), scene.keys, scene.ts)


for _name, _a, _b in (("ndvi", "nir", "red"), ("ndre", "nir - 0.02", "rededge"), ("ndwi", "green", "nir"), ("ndmi", "nir", "swir1"), ("nbr", "nir", "swir2"), ("ndsi", "green", "swir1"), ("pri", "green - 0.01", "green + 0.01")):
    _rows = ", ".join(f"{e} AS {k}" for k, e in ROLES.items())
    _sql = f"SELECT px, ts, (({_a}) - ({_b})) / (({_a}) + ({_b})) AS value FROM (SELECT l_orderkey * 10 + l_linenumber AS px, l_shipdate AS ts, {_rows} FROM lineitem)"
    R.add(f"wavelength_{_name}", lambda s, d, k=_name: indices.by_wavelength(_fine_scene(s, d), CENTRES, k).withColumnRenamed(k, "value"), _sql, "value", 5)


#: index by roles: bands by their words, and by wavelength alone
NAMED = {"Blue": None, "Green": None, "Red": None, "b5": 705.0, "b8": 842.0, "SWIR 1": None, "b12": 2190.0}


def _named_scene(s, d) -> Cube:
    scene = _scene(s, d)
    names = dict(zip(("blue", "green", "red", "rededge", "nir", "swir1", "swir2"), NAMED, strict=True))
    return Cube(scene.rows.withColumnsRenamed(names), scene.keys, scene.ts)


for _name in ("evi", "mndwi", "nbr", "mcari"):
    R.add(f"role_{_name}", lambda s, d, k=_name: indices.by_roles(_named_scene(s, d), k, NAMED).withColumnRenamed(k, "value"), _index_sql(indices.INDICES[_name]), "value", 5)
