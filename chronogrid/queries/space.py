"""Joins, zones, grids, surveys and vectors over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import grids as G
from ..operators import joins as J
from ..operators import surveys as V
from ..operators import vectors as E
from ..plans import bindings
from .common import CLASSES, ITEM_OBS, OBS, Registry, classes, event_obs, item_obs, obs, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

# -- dates ---------------------------------------------------------------------------------------------------------
VIEWS = "SELECT user_id::BIGINT AS px, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2"
CLICKS = "SELECT user_id::BIGINT AS px, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2"


def kind(s, d, name):
    e = table(s, d, "events").where(F.col("event_type") == name)
    return e.groupBy(F.col("user_id").cast("long").alias("px"), F.col("ts").cast("timestamp").alias("ts")).agg(F.max("value").alias("value"))


NEAREST = f"""SELECT px, ts, value, other, d / 86400e6 AS days FROM (SELECT a.px, a.ts, a.value, b.value AS other, abs(epoch_us(b.ts) - epoch_us(a.ts)) AS d,
    row_number() OVER (PARTITION BY a.px, a.ts ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)) NULLS LAST, b.ts) AS k
    FROM ({VIEWS}) a LEFT JOIN ({CLICKS}) b ON a.px = b.px AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 86400000000) WHERE k = 1"""
R.add("match_nearest_date", lambda s, d: J.match_nearest(kind(s, d, "view"), kind(s, d, "click"), 1.0), NEAREST, "value other days")
R.add("match_statistics", lambda s, d: J.match_statistics(J.match_nearest(kind(s, d, "view"), kind(s, d, "click"), 1.0)), f"SELECT count(*) AS n, count(other) AS matched, count(other) / count(*) AS share, avg(days) AS mean_days FROM ({NEAREST})", "share mean_days")
R.add("match_exact_day", lambda s, d: J.match_exact(kind(s, d, "view"), kind(s, d, "click")), f"SELECT a.px, a.ts, a.value, b.other FROM ({VIEWS}) a LEFT JOIN (SELECT px, ts::DATE AS day, arg_min(value, ts) AS other FROM ({CLICKS}) GROUP BY 1, 2) b ON a.px = b.px AND a.ts::DATE = b.day", "value other")
PERIOD = """SELECT px, ts, value, other FROM (SELECT a.px, a.ts, a.value, b.value AS other, row_number() OVER (PARTITION BY a.px, a.ts ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)) NULLS LAST, b.ts) AS k
    FROM ({a}) a LEFT JOIN ({b}) b ON a.px = b.px AND date_trunc('{u}', a.ts) = date_trunc('{u}', b.ts)) WHERE k = 1"""
R.add("match_same_month", lambda s, d: J.match_period(obs(s, d), obs(s, d).select((F.col("px") - 1).alias("px"), "ts", "value"), "month"), PERIOD.format(a=f"SELECT * FROM ({OBS})", b=f"SELECT px - 1 AS px, ts, value FROM ({OBS})", u="month"), "value other")
R.add("match_same_year", lambda s, d: J.match_period(obs(s, d), obs(s, d).select((F.col("px") - 1).alias("px"), "ts", "value"), "year"), PERIOD.format(a=f"SELECT * FROM ({OBS})", b=f"SELECT px - 1 AS px, ts, value FROM ({OBS})", u="year"), "value other")
R.add("quality_mask", lambda s, d: J.quality_masked(event_obs(s, d), bindings.events(s, d).rows.select("px", "ts", "q"), lambda q: scalar.usable(q, "landsat_c2")), f"SELECT px, ts, CASE WHEN coalesce((q::BIGINT & 59) = 0, true) THEN s END AS value FROM ({bindings.EVENTS_SQL})", "value")
R.add("run_mask", lambda s, d: J.run_mask(obs(s, d), obs(s, d).groupBy("px").agg(F.count_if(F.col("value") > 400000).alias("value"))), f"SELECT * FROM ({OBS}) o WHERE px IN (SELECT px FROM ({OBS}) WHERE value > 400000)", "value")
R.add("image_with_series", lambda s, d: obs(s, d).join(obs(s, d).groupBy("px").agg(F.max("value").alias("top")), "px").select("px", "ts", (F.col("value") / F.col("top")).alias("value")), f"SELECT px, ts, value / max(value) OVER (PARTITION BY px) AS value FROM ({OBS})", "value")
R.add("bands_side_by_side", lambda s, d: _pivot(s, d), "SELECT user_id::BIGINT AS px, ts::DATE AS day, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1, 2", "view click purchase")


def _pivot(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("long").alias("px"), F.to_date("ts").alias("day"), "event_type", "value")
    return e.groupBy("px", "day").pivot("event_type", ["view", "click", "purchase"]).agg(F.max("value"))


# -- cells and zones: customers on a grid of 50 columns --------------------------------------------------------------
CELLS = f"SELECT DISTINCT px, (px % 50)::DOUBLE AS x, (px // 50)::DOUBLE AS y FROM ({OBS})"
#: zone: vertices.  Two overlap; one is concave.
ZONES = {1: [(0.5, 0.5), (20.5, 0.5), (20.5, 12.5), (0.5, 12.5)], 2: [(10.5, 5.5), (40.5, 5.5), (30.5, 25.5)], 3: [(25.5, 0.5), (48.5, 0.5), (48.5, 28.5), (37.3, 10.2)]}


def cells(s, d):
    return obs(s, d).select("px").distinct().select("px", (F.col("px") % 50).cast("double").alias("x"), F.floor(F.col("px") / 50).cast("double").alias("y"))


def zones(s):
    rows = [(z, 4 - z, z * 10.0, ring) for z, ring in ZONES.items()]
    return s.createDataFrame(rows, "zone int, rank int, value double, ring array<struct<x:double,y:double>>")


def _inside_sql() -> str:
    """Cells and the zones that have them, by the same crossings, edge by edge."""
    parts = []
    for z, ring in ZONES.items():
        edges = [f"(CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1} + 0.0) + {x1} THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True) if y1 != y2]
        parts.append(f"SELECT {z} AS zone, px, x, y FROM ({CELLS}) WHERE ({' + '.join(edges)}) % 2 = 1")
    return " UNION ALL ".join(parts)


INSIDE = _inside_sql()
R.add("zonal_statistics", lambda s, d: J.zonal_statistics(obs(s, d).withColumn("ts", F.date_trunc("year", "ts")), cells(s, d), zones(s)), f"""SELECT zone, date_trunc('year', ts)::TIMESTAMP AS ts, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25,
    median(value) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, max(value) AS max FROM ({OBS}) o JOIN ({INSIDE}) z ON o.px = z.px WHERE value IS NOT NULL GROUP BY 1, 2""", "mean std min p10 p25 median p75 p90 max")
R.add("zonal_classes", lambda s, d: J.zonal_classes(classes(s, d).withColumnRenamed("period", "ts"), cells(s, d), zones(s)), f"SELECT zone, period AS ts, class, count(*) AS n, count(*) * 900.0 AS m2, count(*) * 0.09 AS ha, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY zone, period) AS percent FROM ({CLASSES}) c JOIN ({INSIDE}) z ON c.px = z.px GROUP BY 1, 2, 3", "m2 ha percent")
R.add("rasterize_zones", lambda s, d: J.rasterize(cells(s, d), zones(s)), f"SELECT c.px, x, y, v AS value FROM ({CELLS}) c LEFT JOIN (SELECT px, arg_max(zone * 10.0, 4 - zone) AS v FROM ({INSIDE}) GROUP BY px) z ON c.px = z.px", "x y value")
R.add("polygon_areas", lambda s, d: zones(s).select("zone", J.ring_area(F.col("ring")).alias("area")), " UNION ALL ".join(f"SELECT {z}::INT AS zone, {abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))) / 2}::DOUBLE AS area" for z, r in ZONES.items()), "area")
R.add("point_lookup", lambda s, d: J.point_lookup(cells(s, d).where("px % 17 = 0").select(F.col("px").alias("id"), (F.col("x") + 0.4).alias("x"), (F.col("y") + 0.7).alias("y")), obs(s, d), 0.0, 0.0, 1.0, 50), f"SELECT c.px AS id, x + 0.4 AS x, y + 0.7 AS y, c.px, ts, value FROM ({CELLS}) c LEFT JOIN ({OBS}) o ON c.px = o.px WHERE c.px % 17 = 0", "x y value")
LAST = f"SELECT px, max(period) AS year FROM ({CLASSES}) WHERE class = 3 GROUP BY px"
ALERT = "SELECT o_custkey::BIGINT AS px, min(year(o_orderdate))::INT AS year FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"
R.add("compare_alerts", lambda s, d: J.compare_alerts(classes(s, d).where("class = 3").groupBy("px").agg(F.max("period").alias("year")), table(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("long").alias("px")).agg(F.min(F.year("o_orderdate")).alias("year"))), f"""SELECT *, 2.0 * "both" / nullif(2.0 * "both" + only_map + only_alerts, 0) AS dice FROM (SELECT count(*) FILTER (a.px IS NOT NULL AND b.px IS NOT NULL) AS "both", count(*) FILTER (b.px IS NULL) AS only_map, count(*) FILTER (a.px IS NULL) AS only_alerts,
    avg(b.year - a.year) AS mean_lag, median(b.year - a.year) AS median_lag, count(*) FILTER (b.year = a.year) AS same_year FROM ({LAST}) a FULL JOIN ({ALERT}) b ON a.px = b.px)""", "mean_lag median_lag dice")
VOTES = "SELECT l_orderkey AS sample, l_linenumber AS interpreter, (l_suppkey % 4)::INT AS label FROM lineitem"
R.add("resolved_labels", lambda s, d: J.resolved_labels(table(s, d, "lineitem").select(F.col("l_orderkey").alias("sample"), (F.col("l_suppkey") % 4).cast("int").alias("label"))), f'SELECT sample, arg_max(label, (n, -label)) AS label, max(n) AS votes, sum(n)::BIGINT AS "of", count(*) = 1 AS unanimous FROM (SELECT sample, label, count(*) AS n FROM ({VOTES}) GROUP BY 1, 2) GROUP BY sample')
R.add("strata_without_samples", lambda s, d: J.strata_without_samples(table(s, d, "customer").select(F.col("c_nationkey").alias("stratum")), table(s, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_nationkey").alias("stratum"))), "SELECT DISTINCT c_nationkey AS stratum FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 0)")

# -- grids: suppliers on a grid of 10 columns, yearly ------------------------------------------------------------------
GRID = f"SELECT px % 10 AS x, px // 10 AS y, year(ts)::INT AS ts, avg(value) AS value FROM ({ITEM_OBS}) GROUP BY px, 3"


def grid(s, d):
    g = item_obs(s, d).groupBy("px", F.year("ts").alias("ts")).agg(F.avg("value").alias("value"))
    return g.select((F.col("px") % 10).alias("x"), F.floor(F.col("px") / 10).alias("y"), "ts", "value")


def _near(r: int, aggregates: str) -> str:
    return f"SELECT a.x, a.y, a.ts, any_value(a.value) AS value, {aggregates} FROM ({GRID}) a JOIN ({GRID}) b ON a.ts = b.ts AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} GROUP BY a.x, a.y, a.ts"


R.add("hotspots", lambda s, d: G.hotspots(grid(s, d), 1, ["ts"]), f"SELECT x, y, n.ts, (s - mean * w) / (std * sqrt((n * w - w * w) / (n - 1))) AS gi FROM ({_near(1, 'count(b.value) AS w, sum(b.value) AS s')}) n JOIN (SELECT ts, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM ({GRID}) GROUP BY ts) t ON n.ts = t.ts", "gi")
R.add("overview", lambda s, d: G.overview(grid(s, d), 2, ["ts"]), f"SELECT ts, x // 2 AS x, y // 2 AS y, avg(value) AS value, count(value) AS n FROM ({GRID}) GROUP BY 1, 2, 3", "value")
R.add("speckle_lee", lambda s, d: G.lee_filter(grid(s, d), 1, 4.0, ["ts"]), f"SELECT x, y, ts, m + CASE WHEN var > 0 THEN greatest(0, (var - m * m / 4) / var) ELSE 0 END * (value - m) AS value FROM ({_near(1, 'avg(b.value) AS m, var_pop(b.value) AS var')})", "value")
R.add("speckle_quegan", lambda s, d: G.quegan_filter(grid(s, d), 1), f"SELECT x, y, ts, m * avg(value / m) OVER (PARTITION BY x, y) AS value FROM ({_near(1, 'avg(b.value) AS m')})", "value")
CLASSED = f"SELECT x, y, ts, floor(value / 2) AS value FROM ({GRID})"
R.add("majority_filter", lambda s, d: G.majority(grid(s, d).withColumn("value", F.floor(F.col("value") / 2).cast("double")), 1, ["ts"]), f"""SELECT x, y, ts, arg_max(v, (n, (v = own)::INT, -v))::DOUBLE AS value FROM (SELECT a.x, a.y, a.ts, a.value AS own, b.value AS v, count(*) AS n FROM ({CLASSED}) a JOIN ({CLASSED}) b ON a.ts = b.ts AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3""", "value")
PATCH = f"SELECT px % 50 AS x, px // 50 AS y, class AS value, (px % 50) * 4294967296 + px // 50 AS id FROM ({CLASSES}) WHERE period = 1997"
R.add("connected_patches", lambda s, d: G.patches(classes(s, d).where("period = 1997").select((F.col("px") % 50).alias("x"), F.floor(F.col("px") / 50).alias("y"), F.col("class").alias("value")), lambda df: _cut(df)), f"""WITH RECURSIVE c AS ({PATCH}), r(id, label) AS (SELECT id, id FROM c UNION SELECT b.id, r.label FROM r JOIN c a ON r.id = a.id JOIN c b ON a.value = b.value AND abs(a.x - b.x) + abs(a.y - b.y) = 1)
    SELECT patch, value, count(*) AS cells FROM (SELECT r.id, min(label) AS patch FROM r GROUP BY r.id) p JOIN c ON p.id = c.id GROUP BY 1, 2""")


def _cut(df):
    """Ends the lineage in the shared folder."""
    from ..plans.cut import cut

    return cut(df)


BANDS = ["quantity", "discount", "tax"]
YEAR_MEANS = "SELECT l_suppkey::BIGINT AS px, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem WHERE year(l_shipdate) = {} GROUP BY 1"


def _means(s, d, year):
    i = table(s, d, "lineitem").where(F.year("l_shipdate") == year)
    # exact sums: doubles' last bits follow the order of rows, and would tell which of two equal means is greater
    return i.groupBy(F.col("l_suppkey").cast("long").alias("px")).agg(*[F.avg(F.col(f"l_{b}").cast("decimal(24,10)")).cast("double").alias(b) for b in BANDS])


R.add("change_vectors", lambda s, d: G.change_vectors(_means(s, d, 1996), _means(s, d, 1999), BANDS), f"SELECT a.px, sqrt((b.quantity - a.quantity) ** 2 + (b.discount - a.discount) ** 2 + (b.tax - a.tax) ** 2) AS magnitude, (b.quantity > a.quantity)::INT + 2 * (b.discount > a.discount)::INT + 4 * (b.tax > a.tax)::INT AS sector FROM ({YEAR_MEANS.format(1996)}) a JOIN ({YEAR_MEANS.format(1999)}) b ON a.px = b.px", "magnitude")
R.add("linear_components", lambda s, d: G.brightness(_means(s, d, 1996), {"brightness": {"quantity": 0.3, "discount": 0.4, "tax": 0.5}, "greenness": {"quantity": -0.2, "discount": 0.7, "tax": -0.1}}, ["px"]), f"SELECT px, 0.3 * quantity + 0.4 * discount + 0.5 * tax AS brightness, -0.2 * quantity + 0.7 * discount - 0.1 * tax AS greenness FROM ({YEAR_MEANS.format(1996)})", "brightness greenness")
R.add("relative_calibration", lambda s, d: G.relative_calibration(_pairs(s, d), "flag"), """SELECT flag, n, (yy - xx + sqrt((yy - xx) ** 2 + 4 * xy * xy)) / (2 * xy) AS gain, my - (yy - xx + sqrt((yy - xx) ** 2 + 4 * xy * xy)) / (2 * xy) * mx AS "offset" FROM (
    SELECT l_returnflag AS flag, count(*) AS n, avg(l_extendedprice) AS mx, avg(l_quantity * 1000) AS my, var_pop(l_extendedprice) AS xx, var_pop(l_quantity * 1000) AS yy, covar_pop(l_quantity * 1000, l_extendedprice) AS xy FROM lineitem GROUP BY 1)""", 'gain "offset"', 5)


def _pairs(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity") * 1000).alias("reference"), F.col("l_extendedprice").alias("target"))


R.add("topographic_correction", lambda s, d: G.illumination_corrected(table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("px"), F.col("l_quantity").alias("value"), (0.5 + F.col("l_discount")).alias("cos_i"), F.lit(0.7).alias("cos_z")), ["flag"]), """WITH r AS (SELECT l_returnflag AS flag, l_orderkey * 10 + l_linenumber AS px, l_quantity AS value, 0.5 + l_discount AS ci FROM lineitem),
    m AS (SELECT flag, covar_pop(value, ci) / var_pop(ci) AS slope, avg(ci) AS mx, avg(value) AS my FROM r GROUP BY flag)
    SELECT r.flag, px, value * (0.7 + (my - slope * mx) / slope) / (ci + (my - slope * mx) / slope) AS value FROM r JOIN m ON r.flag = m.flag""", "value", 3)
DRIVER = "SELECT year(ts)::INT * 12 + month(ts)::INT - 1 AS month, avg(value) AS value FROM ({}) GROUP BY 1".format(OBS)
R.add("lagged_correlation", lambda s, d: G.lagged_correlation(item_obs(s, d), obs(s, d).groupBy((F.year("ts") * 12 + F.month("ts") - 1).alias("month")).agg(F.avg("value").alias("value")), [0, 1, 2, 3]), f"""WITH m AS (SELECT px, year(ts)::INT * 12 + month(ts)::INT - 1 AS month, avg(value) AS y FROM ({ITEM_OBS}) WHERE value IS NOT NULL GROUP BY 1, 2), l AS (SELECT unnest([0, 1, 2, 3])::INT AS lag), d AS ({DRIVER})
    SELECT px, lag, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(y, d.value) END AS r FROM m JOIN l ON true JOIN d ON m.month = d.month + lag GROUP BY 1, 2""", "r")
R.add("false_discovery_rate", lambda s, d: G.false_discovery(_tests(s, d), "p", 0.1, "g"), """WITH t AS (SELECT c_custkey AS id, c_nationkey AS g, ((c_custkey * 7919) % 1009) ** 2 / 1018081.0 AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS k, count(*) OVER (PARTITION BY g) AS m FROM t)
    SELECT id, g, p, coalesce(p <= max(p) FILTER (p <= 0.1 * k / m) OVER (PARTITION BY g), false) AS significant FROM r""", "p")


def _tests(s, d):
    p = F.pow((F.col("c_custkey") * 7919) % 1009, F.lit(2.0)) / 1018081.0
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), p.alias("p"))


# -- surveys: documents' labels, strata by language ----------------------------------------------------------------------
SAMPLES = "SELECT l.doc_id AS sample, d.lang AS stratum, toxic AS map, quality AS reference, (d.n_chars / 1000.0) AS y, (1 + quality)::DOUBLE AS x FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
STRATA = "SELECT lang AS stratum, count(*)::DOUBLE AS size, coalesce(stddev_samp(n_chars), 0) AS std FROM documents GROUP BY 1"


def samples(s, d):
    l, o = table(s, d, "labels"), table(s, d, "documents").select("doc_id", "lang", "n_chars")
    return l.join(o, "doc_id").select(F.col("doc_id").alias("sample"), F.col("lang").alias("stratum"), F.col("toxic").alias("map"), F.col("quality").alias("reference"), (F.col("n_chars") / 1000.0).alias("y"), (1 + F.col("quality")).cast("double").alias("x"))


def strata(s, d):
    return table(s, d, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").cast("double").alias("size"), F.coalesce(F.stddev_samp("n_chars"), F.lit(0.0)).alias("std"))


R.add("confusion_matrix", lambda s, d: V.confusion(samples(s, d)), f"SELECT map, reference, count(*) AS n FROM ({SAMPLES}) GROUP BY 1, 2")
R.add("cohen_kappa", lambda s, d: V.kappa(samples(s, d)), f"""WITH s AS ({SAMPLES}), r AS (SELECT map AS c, count(*) AS a FROM s GROUP BY 1), c AS (SELECT reference AS c, count(*) AS b FROM s GROUP BY 1), e AS (SELECT sum(a * b)::DOUBLE AS ab FROM r JOIN c ON r.c = c.c)
    SELECT n, po AS overall, (po - pe) / (1 - pe) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (map = reference) / count(*) AS po, any_value(ab) / (count(*) * count(*)) AS pe FROM s, e)""", "overall kappa")
R.add("stratified_mean", lambda s, d: V.stratified_means(samples(s, d), strata(s, d)), f"""WITH p AS (SELECT stratum, count(*) AS n, avg(y) AS m, coalesce(var_samp(y), 0) AS v FROM ({SAMPLES}) GROUP BY 1), b AS (SELECT n, m, v, size / sum(size) OVER () AS w FROM p JOIN ({STRATA}) t ON p.stratum = t.stratum)
    SELECT sum(n)::BIGINT AS n, sum(w * m) AS mean, sqrt(sum(w * w * v / n)) AS se, sum(w * m) - 1.959963984540054 * sqrt(sum(w * w * v / n)) AS low, sum(w * m) + 1.959963984540054 * sqrt(sum(w * w * v / n)) AS high FROM b""", "mean se low high")
R.add("stratified_ratio", lambda s, d: V.stratified_ratio(samples(s, d), strata(s, d)), f"""WITH p AS (SELECT stratum, count(*) AS n, avg(y) AS my, avg(x) AS mx, coalesce(var_samp(y), 0) AS vy, coalesce(var_samp(x), 0) AS vx, coalesce(covar_samp(y, x), 0) AS c FROM ({SAMPLES}) GROUP BY 1),
    b AS (SELECT p.*, size FROM p JOIN ({STRATA}) t ON p.stratum = t.stratum), r AS (SELECT sum(size * my) AS ty, sum(size * mx) AS tx FROM b)
    SELECT sum(n)::BIGINT AS n, any_value(ty / tx) AS ratio, sqrt(sum(size * size * (vy + (ty / tx) ** 2 * vx - 2 * ty / tx * c) / n)) / any_value(abs(tx)) AS se FROM b, r""", "ratio se")
AREAS = "SELECT toxic AS map, count(*) * 0.09 AS area FROM labels GROUP BY 1"
R.add("area_weighted_accuracy", lambda s, d: V.area_weighted_accuracy(samples(s, d), table(s, d, "labels").groupBy(F.col("toxic").alias("map")).agg((F.count("*") * 0.09).alias("area"))), f"""WITH n AS (SELECT map, reference, count(*) AS n FROM ({SAMPLES}) GROUP BY 1, 2), w AS (SELECT map, area / sum(area) OVER () AS w FROM ({AREAS})),
    p AS (SELECT n.*, w, sum(n) OVER (PARTITION BY n.map) AS t, w * n / sum(n) OVER (PARTITION BY n.map) AS p FROM n JOIN w ON n.map = w.map),
    r AS (SELECT map AS class, sum(p) FILTER (map = reference) AS hit, sum(n) FILTER (map = reference) / sum(n) AS users FROM p GROUP BY 1), c AS (SELECT reference AS class, sum(p) AS col, sum((w * p - p * p) / (t - 1)) AS var FROM p GROUP BY 1)
    SELECT class, coalesce(users, 0) AS users, coalesce(hit, 0) / col AS producers, coalesce(col, 0) * (SELECT sum(area) FROM ({AREAS})) AS area, sqrt(var) * (SELECT sum(area) FROM ({AREAS})) AS area_se FROM r FULL JOIN c USING (class)""", "users producers area area_se")
YEARS = f"SELECT a.px, a.year AS map_year, b.year AS reference_year FROM ({LAST}) a FULL JOIN ({ALERT}) b ON a.px = b.px"
R.add("date_agreement", lambda s, d: V.date_agreement(_years(s, d), 1), f'SELECT count(*) AS n, count(map_year - reference_year) AS "both", count(*) FILTER (abs(map_year - reference_year) <= 1) AS matched, avg(map_year - reference_year) AS bias, avg(abs(map_year - reference_year)) AS mae, count(*) FILTER (reference_year IS NULL) AS commission, count(*) FILTER (map_year IS NULL) AS omission FROM ({YEARS})', "bias mae")


def _years(s, d):
    a = classes(s, d).where("class = 3").groupBy("px").agg(F.max("period").alias("map_year"))
    b = table(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("long").alias("px")).agg(F.min(F.year("o_orderdate")).alias("reference_year"))
    return a.join(b, "px", "full_outer")


R.add("sample_allocation", lambda s, d: V.allocation(strata(s, d), 300, 30), f"SELECT stratum, size, greatest(30, round_even(300.0 / count(*) OVER (), 0))::INT AS equal, greatest(30, round_even(300 * size / sum(size) OVER (), 0))::INT AS proportional, greatest(30, round_even(300 * size * std / sum(size * std) OVER (), 0))::INT AS neyman FROM ({STRATA})", "size")
ORDERED = "row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws(':', '17', {}::VARCHAR)))"
R.add("stratified_draw", lambda s, d: V.draw(table(s, d, "documents").select("doc_id", F.col("lang").alias("stratum")), strata(s, d).select("stratum", F.lit(25).alias("n")), "doc_id", 17), f"SELECT stratum, doc_id FROM (SELECT lang AS stratum, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '17', doc_id::VARCHAR))) AS k FROM documents) WHERE k <= 25")
R.add("area_by_year", lambda s, d: V.area_by_year(_years(s, d).withColumnRenamed("map_year", "year"), 0.09), f"SELECT map_year AS year, count(*) AS cells, count(*) * 0.09 AS ha FROM ({YEARS}) WHERE map_year IS NOT NULL GROUP BY 1", "ha")
R.add("calibration_split", lambda s, d: V.split_in_strata(samples(s, d).select("sample", "stratum"), 0.3, "sample", 17), f"SELECT sample, stratum, CASE WHEN {ORDERED.format('sample')} <= round_even(0.3 * count(*) OVER (PARTITION BY stratum), 0) THEN 'calibration' ELSE 'validation' END AS part FROM ({SAMPLES})")
R.add("block_folds", lambda s, d: V.block_folds(cells(s, d), 6.0, 5), f"SELECT px, x, y, (('0x' || md5(floor(x / 6)::BIGINT || ':' || floor(y / 6)::BIGINT)[1:8])::BIGINT % 5)::INT AS fold FROM ({CELLS})", "x y")
R.add("strata_from_rules", lambda s, d: cells(s, d).select("px", F.when(F.col("x") < 10, "edge").when((F.col("x") + F.col("y")) % 7 == 0, "buffer").otherwise(F.concat(F.lit("bin"), F.floor(F.col("y") / 10).cast("string"))).alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n")), f"SELECT CASE WHEN x < 10 THEN 'edge' WHEN (x + y)::INT % 7 = 0 THEN 'buffer' ELSE 'bin' || floor(y / 10)::BIGINT END AS stratum, count(*) AS n FROM ({CELLS}) GROUP BY 1")

# -- vectors -----------------------------------------------------------------------------------------------------------
REFERENCE = [round(0.1 * ((k * 7) % 11 - 5), 1) for k in range(64)]
VEC = "embedding::DOUBLE[]"


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


R.add("cosine_similarity", lambda s, d: E.similarity_to(vectors(s, d), REFERENCE), f"SELECT vec_id AS id, list_cosine_similarity({VEC}, {REFERENCE}::DOUBLE[]) AS similarity FROM embeddings", "similarity")
R.add("cosine_change", lambda s, d: E.change(vectors(s, d).where("id % 2 = 0").withColumn("id", F.expr("id div 2")), vectors(s, d).where("id % 2 = 1").withColumn("id", F.expr("id div 2"))), "SELECT a.vec_id // 2 AS id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS change FROM embeddings a JOIN embeddings b ON a.vec_id // 2 = b.vec_id // 2 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1", "change")
R.add("nearest_centroid", lambda s, d: E.classify_nearest(vectors(s, d), E.centroids(vectors(s, d).where("id % 5 = 0"))), f"""WITH u AS (SELECT label, list_transform({VEC}, lambda x: x / sqrt(list_dot_product({VEC}, {VEC}))) AS u FROM embeddings WHERE vec_id % 5 = 0),
    k AS (SELECT label, unnest(range(1, 65)) AS k, unnest(u) AS v FROM u), c AS (SELECT label, list(v ORDER BY k) AS c FROM (SELECT label, k, avg(v) AS v FROM k GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT vec_id AS id, c.label, round(list_cosine_similarity({VEC}, c), 12) AS s FROM embeddings, c) SELECT id, arg_max(label, (s, -label)) AS label, max(s) AS similarity FROM r GROUP BY id""", "similarity")
R.add("vector_quantisation", lambda s, d: E.quantised(vectors(s, d)).select("id", "scale", "offset", F.aggregate("codes", F.lit(0), lambda a, b: a + b.cast("int")).alias("code_sum")), f'SELECT id, scale, "offset", list_sum(list_transform(v, lambda x: round_even((x - "offset") / scale, 0)))::INT AS code_sum FROM (SELECT vec_id AS id, {VEC} AS v, (list_max({VEC}) - list_min({VEC})) / 254.0 AS scale, (list_max({VEC}) + list_min({VEC})) / 2 AS "offset" FROM embeddings)', 'scale "offset"')
R.add("nearest_neighbours", lambda s, d: E.nearest_neighbours(vectors(s, d).where("id % 20 = 0"), vectors(s, d), 5), """SELECT query, id, similarity, rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5""", "similarity", 6)
R.add("area_of_applicability", lambda s, d: E.dissimilarity(_points(s, d), _points(s, d).where("id % 30 = 0")), """WITH p AS (SELECT l_suppkey::BIGINT AS id, avg(l_quantity) AS a, avg(l_discount) * 100 AS b FROM lineitem GROUP BY 1), t AS (SELECT * FROM p WHERE id % 30 = 0),
    m AS (SELECT avg(d) AS m FROM (SELECT sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS d FROM t x, t y) WHERE d > 0) SELECT p.id, min(sqrt((p.a - t.a) ** 2 + (p.b - t.b) ** 2)) / any_value(m) AS di FROM p, t, m GROUP BY p.id""", "di")


def _points(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("id")).agg(F.array(F.avg("l_quantity"), F.avg("l_discount") * 100).alias("x"))


R.add("percentile_scaling", lambda s, d: E.percentile_scaled(obs(s, d)), f"SELECT px, ts, CASE WHEN value IS NOT NULL THEN least(1, greatest(1e-4, (value - a) / (b - a))) END AS value FROM ({OBS}), (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM ({OBS}))", "value")


# -- lines, features, areas ----------------------------------------------------------------------------------------------
LINES = [("a", 0.0, 0.0, 30.0, 20.0), ("b", 49.0, 5.0, 10.0, 5.0), ("c", 7.2, 3.3, 7.2, 3.3)]


def _lines_sql() -> str:
    """Points of the lines every 2 cells, and their nearest cells."""
    import math

    out = []
    for name, x0, y0, x1, y1 in LINES:
        length = math.hypot(x1 - x0, y1 - y0)
        for k in range(int(length // 2) + 1):
            share = 2.0 * k / length if length else 0.0
            out.append(f"('{name}', {2.0 * k}::DOUBLE, {math.floor(x0 + share * (x1 - x0) + 0.5)}, {math.floor(y0 + share * (y1 - y0) + 0.5)})")
    return f"(VALUES {', '.join(out)}) AS l(line, distance, cx, cy)"


R.add("line_profiles", lambda s, d: J.line_profile(s.createDataFrame(LINES, "line string, x0 double, y0 double, x1 double, y1 double"), cells(s, d), obs(s, d), 2.0), f"SELECT line, distance, o.px, ts, value FROM {_lines_sql()} JOIN ({CELLS}) c ON c.x = cx AND c.y = cy JOIN ({OBS}) o ON o.px = c.px", "distance value")
R.add("feature_series", lambda s, d: J.feature_series(obs(s, d).withColumn("ts", F.date_trunc("month", "ts")), cells(s, d), zones(s), cells(s, d).where("px % 100 = 3").select(F.concat(F.lit("p"), F.col("px").cast("string")).alias("feature"), (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.9).alias("y")), 50), f"""SELECT feature, date_trunc('month', ts)::TIMESTAMP AS ts, avg(value) AS value, count(value) AS n FROM ({OBS}) o JOIN (
    SELECT zone::VARCHAR AS feature, px FROM ({INSIDE}) UNION ALL SELECT 'p' || px, px FROM ({CELLS}) WHERE px % 100 = 3) f ON o.px = f.px GROUP BY 1, 2""", "value")
R.add("buffered_folds", lambda s, d: J.buffered_folds(cells(s, d).select(F.col("px").alias("id"), "x", "y"), 2.5), f"SELECT a.px AS id, count(b.px) AS left_out FROM ({CELLS}) a LEFT JOIN ({CELLS}) b ON a.px <> b.px AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2.5 GROUP BY 1")
R.add("class_areas", lambda s, d: J.class_areas(classes(s, d).withColumnRenamed("period", "ts"), cells(s, d).select("px", (F.col("y") - 15).alias("lat")), 1.0), f"""SELECT ts, class, sum(ha) AS ha, count(*) AS n FROM (SELECT period AS ts, class, 6371007.2 * 6371007.2 * radians(1.0) * (sin(radians(y - 14.5)) - sin(radians(y - 15.5))) / 10000 AS ha FROM ({CLASSES}) k JOIN ({CELLS}) c ON k.px = c.px) GROUP BY ROLLUP (ts, class) HAVING ts IS NOT NULL""", "ha", 1)
R.add("sieved_patches", lambda s, d: G.sieved(classes(s, d).where("period = 1997").select((F.col("px") % 50).alias("x"), F.floor(F.col("px") / 50).alias("y"), F.col("class").alias("value")), 3, _cut), f"""WITH RECURSIVE c AS ({PATCH}), r(id, label) AS (SELECT id, id FROM c UNION SELECT b.id, r.label FROM r JOIN c a ON r.id = a.id JOIN c b ON a.value = b.value AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
    l AS (SELECT id, min(label) AS label FROM r GROUP BY id), m AS (SELECT c.*, count(*) OVER (PARTITION BY label) < 3 AS small FROM c JOIN l ON c.id = l.id),
    v AS (SELECT x, y, arg_max(v, (n, -v)) AS v FROM (SELECT a.x, a.y, b.value AS v, count(*) AS n FROM m a JOIN m b ON NOT b.small AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT m.x, m.y, CASE WHEN small THEN coalesce(v, value) ELSE value END AS value FROM m LEFT JOIN v ON m.x = v.x AND m.y = v.y""")
R.add("probability_smoothing", lambda s, d: G.smoothed_probabilities(grid(s, d).select("x", "y", F.col("ts").alias("class"), (F.col("value") / 60).alias("value")), 1, 0.3), f"""WITH g AS (SELECT x, y, ts AS class, ln((value / 60) / (1 - value / 60)) AS v FROM ({GRID})), n AS (SELECT a.x, a.y, a.class, any_value(a.v) AS v, avg(b.v) AS m, var_pop(b.v) AS s FROM g a JOIN g b ON a.class = b.class AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3)
    SELECT x, y, class, 1 / (1 + exp(-((s * v + 0.3 * m) / (s + 0.3)))) AS value FROM n""", "value")
R.add("first_valid_mosaic", lambda s, d: _mosaic(s, d), "SELECT k.px, k.day, v AS value FROM (SELECT DISTINCT l_suppkey::BIGINT AS px, date_trunc('month', l_shipdate)::DATE AS day FROM lineitem) k LEFT JOIN (SELECT l_suppkey AS px, date_trunc('month', l_shipdate)::DATE AS day, arg_min(l_quantity, (l_orderkey * 10 + l_linenumber, l_quantity)) AS v FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2) m ON k.px = m.px AND k.day = m.day", "value")


def _mosaic(s, d):
    from ..sources.catalogues import mosaic

    i = table(s, d, "lineitem")
    rows = i.select(F.col("l_suppkey").cast("long").alias("px"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_order"), F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("value"))
    return mosaic(rows, ["px", "day"])
