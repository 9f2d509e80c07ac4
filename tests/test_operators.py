"""Operators beyond the registered queries: edge rows, geometry, stores, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from chronogrid import streaming
from chronogrid.functions import calendar, indices
from chronogrid.operators import grids, joins, learning, ranks, series, surveys, temporal, vectors
from chronogrid.queries import space
from chronogrid.sources import catalogues, names, store

DAY = datetime.datetime(2020, 1, 1)


def obs(spark, *values, px=1, step=10):
    return spark.createDataFrame([(px, DAY + datetime.timedelta(days=step * i), v) for i, v in enumerate(values)], "px long, ts timestamp, value double")


SERIES = [
    series.series_stats, series.sample_stats, series.observations_per_year, series.monthly_climatology, series.deseasonalised, series.cusum, series.seasonal_grid, series.annual_harmonic, series.average_ranks,
    temporal.temporal_metrics, lambda o: temporal.fold(o, "month", ["count", "mean"]), lambda o: temporal.fold(o, "year", ["count", "std"]), lambda o: temporal.clear_observations(o, 3), lambda o: temporal.interpolate_linear(o, 7),
    lambda o: temporal.interpolate_rbf(o, 7, 10.0, 20), temporal.standardize, temporal.linear_trend, temporal.change_and_trends, temporal.mann_kendall, lambda o: temporal.regularize(o, "month"), lambda o: temporal.regularize(o, "16 days", "medoid"),
    lambda o: temporal.best_pixel(o, 100),
]


@pytest.mark.parametrize("operator", SERIES)
def test_edge_series(spark, operator):
    for rows in (obs(spark), obs(spark, None, None), obs(spark, 1.0), obs(spark, 1.0, 2.0), obs(spark, 3.0, 3.0, 3.0), obs(spark, 1.0, None, 5.0, 5.0, 2.0), obs(spark, 1.0, 2.0, step=0)):
        operator(rows).collect()


def test_series_stats_of_a_line(spark):
    r = series.series_stats(obs(spark, 10.0, 8.0, None, 4.0)).first()
    assert (r["n"], r["min"], r["max"], r["largest_drop"]) == (3, 4.0, 10.0, 4.0)
    assert r["slope"] == pytest.approx(-0.2 * 366) and r["sen_slope"] == pytest.approx(-0.2 * 366) and r["r2"] == pytest.approx(1.0)
    constant = series.series_stats(obs(spark, 2.0, 2.0)).first()
    assert (constant["r2"], constant["std"], constant["largest_drop"]) == (0.0, 0.0, 0.0)
    assert series.series_stats(obs(spark, 2.0)).first()["largest_drop"] is None


def test_standardize_edges(spark):
    values = lambda o: [r["value"] for r in o.orderBy("ts").collect()]
    assert values(temporal.standardize(obs(spark, 7.0, None))) == [7.0, None]
    assert values(temporal.standardize(obs(spark, 7.0, 7.0))) == [None, None]


def test_leap_days_fold_into_march(spark):
    days = spark.createDataFrame([(datetime.date(2020, 2, 28),), (datetime.date(2020, 2, 29),), (datetime.date(2020, 3, 1),), (datetime.date(2021, 3, 1),), (datetime.date(2020, 12, 31),)], "d date")
    assert [r[0] for r in days.select(calendar.day_365(F.col("d"))).collect()] == [59, 60, 60, 60, 365]
    assert [r[0] for r in days.select(calendar.week_52(F.col("d"))).collect()][-1] == 52


def test_point_in_rings(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    zones = spark.createDataFrame([("a", square), ("b", hole), ("c", square)], "zone string, ring array<struct<x:double,y:double>>")
    cells = spark.createDataFrame([(1, 2.0, 3.0), (2, 1.0, 1.0), (3, 9.0, 9.0), (4, 2.0, 0.5)], "px long, x double, y double")
    found = {(r["zone"], r["px"]) for r in joins.cells_in_zones(cells, zones, tile=2.0).collect()}
    assert found == {("a", 1), ("c", 1), ("a", 2), ("b", 2), ("c", 2), ("a", 4), ("b", 4), ("c", 4)}


def test_patches(spark):
    picture = ["110", "010", "101"]
    cells = spark.createDataFrame([(x, y, int(c)) for y, row in enumerate(picture) for x, c in enumerate(row)], "x int, y int, value int")
    from chronogrid.plans.cut import cut

    assert sorted(r["cells"] for r in grids.patches(cells.where("value = 1"), cut).collect()) == [1, 1, 3]
    assert sorted(r["cells"] for r in grids.patches(cells.where("value = 1"), cut, diagonal=True).collect()) == [5]


def test_confusion_extremes(spark):
    same = spark.createDataFrame([(1, 1), (1, 1)], "map int, reference int")
    assert surveys.kappa(same).first()["kappa"] is None
    mixed = spark.createDataFrame([(0, 0), (1, 1), (0, 1), (1, 0)], "map int, reference int")
    assert surveys.kappa(mixed).first()["kappa"] == pytest.approx(0.0)
    assert surveys.sample_size([0.2, 0.8], [0.7, 0.9], 0.02) == 275


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-3.0, -4.0])], "id long, vector array<double>")
    assert [r["similarity"] for r in vectors.similarity_to(v, [6.0, 8.0]).orderBy("id").collect()] == [pytest.approx(1.0), None, pytest.approx(-1.0)]
    back = vectors.restored(vectors.quantised(v)).orderBy("id").collect()
    assert back[0]["vector"] == pytest.approx([3.0, 4.0], abs=0.01) and back[1]["vector"] == [0.0, 0.0]


def test_irmad_finds_the_changed_cells(spark):
    import random

    r = random.Random(1)
    rows = [(k, *(lambda a, b: (a, b, a * 1.1 + r.gauss(0, 0.05) + (8 if k < 10 else 0), b * 0.9 + r.gauss(0, 0.05)))(r.gauss(0, 1), r.gauss(0, 1))) for k in range(300)]
    t = spark.createDataFrame(rows, "px long, a double, b double, a2 double, b2 double")
    found = learning.altered_by_reweighting(t.select("px", "a", "b"), t.select("px", F.col("a2").alias("a"), F.col("b2").alias("b")), ["a", "b"])
    assert {x["px"] for x in found.where("p_unchanged < 0.01").collect()} >= set(range(10))
    assert {x["px"] for x in found.orderBy(F.desc("chi2")).limit(10).collect()} == set(range(10))


def test_indices(spark):
    assert indices.nearest_bands({"b4": 665, "b8": 842}, "ndvi") == ("b8", "b4")
    assert indices.nearest_bands({"b4": 665, "b8": 842, "b11": 1609}, "ndmi") == ("b8", "b11")
    with pytest.raises(ValueError, match="no band within 6"):
        indices.nearest_bands({"b2": 490, "b3": 560}, "pri")
    with pytest.raises(ValueError, match="no band within 15"):
        indices.nearest_bands({"b5": 740, "b7": 790}, "ndre")
    assert [indices.band_of_role({"SWIR 1": None, "x": 1610.0, "y": 1660.0}, c) for c in ("S1", "S2")] == ["SWIR 1", None]
    assert indices.band_of_role({"x": 1560.0, "y": 1660.0}, "S1") == "y"
    with pytest.raises(ValueError, match="no band within"):
        indices.nearest_bands({"b4": 665}, "ndvi")
    rows = spark.createDataFrame([(1, DAY, 30.0, 0.0, 0.0, 0.1)], "px long, ts timestamp, sza double, vza double, raa double, red double")
    assert indices.nadir_adjusted(rows, ["red"]).first()["red"] == pytest.approx(0.1)


@pytest.mark.parametrize(
    "name, date",
    [("S2_20190615T101031_x", "2019-06-15 10:10:31"), ("a_2019-02-30", "2019-01-01 00:00:00"), ("LC08_20190615", "2019-06-15 00:00:00"), ("MOD.A2019366", None), ("x_2019_06_15b", "2019-06-15 00:00:00"), ("y2019.07", "2019-07-01 00:00:00"), ("none", None), ("12345678", None)],
)
def test_dates_of_names(spark, name, date):
    found = spark.createDataFrame([(name,)], "n string").select(names.date_of_name(F.col("n"))).first()[0]
    if name == "MOD.A2019366":
        assert str(found) == "2020-01-01 00:00:00"  # day 366 of a year of 365
    elif name == "a_2019-02-30":
        assert found is None or found.year == 2019
    else:
        assert (None if found is None else str(found)) == date


def test_natural_order_and_calendars(spark):
    files = spark.createDataFrame([("b10",), ("b9",), ("B1",), ("b009x",)], "n string")
    assert [r["n"] for r in files.orderBy(names.natural_key(F.col("n"))).collect()] == ["B1", "b9", "b009x", "b10"]
    t = spark.createDataFrame([(59.0,), (365.0,), (0.5,)], "v double")
    noleap = [str(r[0]) for r in t.select(names.cf_time(F.col("v"), "days since 2004-01-01", "noleap")).collect()]
    assert noleap == ["2004-03-01 00:00:00", "2005-01-01 00:00:00", "2004-01-01 12:00:00"]


def test_items_and_features(spark, tmp_path):
    item = '{"id":"%s","collection":"c","bbox":[%d,0,%d,1],"properties":{"datetime":"2020-01-0%dT10:00:00Z","eo:cloud_cover":%s,"proj:epsg":%d,"gsd":10,"platform":"p"},"assets":{}}'
    lines = [item % ("a", 0, 1, 3, "50", 32722), item % ("b", 0, 1, 1, "null", 32722), item % ("c", 5, 6, 2, "10", 32721)]
    (tmp_path / "items.json").write_text("\n".join(lines))
    items = catalogues.read_items(spark, str(tmp_path / "items.json"))
    assert [r["id"] for r in catalogues.search(items, bbox=(0, 0, 2, 2), max_cloud=60, max_items=5).collect()] == ["b", "a"]
    assert [r["id"] for r in catalogues.search(items, start="2020-01-02", end="2020-01-03").orderBy("id").collect()] == ["a", "c"]
    assert catalogues.common_grid(items).first()["epsg"] == 32722
    assert catalogues.by_day(items).count() == 3
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"1","properties":{"n":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}}]}')
    f = catalogues.read_features(spark, str(tmp_path / "f.json")).select("fid", "attrs", joins.ring_area(catalogues.outer_ring(F.col("rings"))).alias("area")).first()
    assert (f["fid"], f["attrs"]["n"], f["area"]) == ("1", "x", 4.0)


def test_store_and_grids(spark, tmp_path):
    rows = obs(spark, 1.0, float("nan"), 3.0, step=300).select(F.lit("s").alias("series"), "px", "ts", F.lit("b").alias("band"), "value")
    store.save_series(rows, str(tmp_path / "s"))
    back = store.open_series(spark, str(tmp_path / "s"), "s", "2020-01-01", "2020-12-31")
    assert [r["value"] for r in back.orderBy("ts").collect()] == [1.0, None]
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nnodata_value -9\n1 2\n-9 4\n")
    store.register(spark)
    cells = spark.read.format("grid").option("files", str(tmp_path / "g.asc")).option("date", "2020-05-01").load()
    assert [(r["px"], r["x"], r["y"], r["value"]) for r in cells.orderBy("px").collect()] == [(0, 0, 0, 1.0), (1, 1, 0, 2.0), (2, 0, 1, None), (3, 1, 1, 4.0)]
    wide = store.wide_table(obs(spark, 1.0, 2.0), ["2020-01-01", "2020-01-11"]).first()
    assert (wide["2020-01-01"], wide["2020-01-11"]) == (1.0, 2.0)


def test_states_of_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    obs(spark, 5.0, 5.0, None, 5.0, 0.0, 5.0).coalesce(1).write.parquet(path)

    def arrived():
        return spark.readStream.schema("px long, ts timestamp, value double").parquet(path)

    def done(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).orderBy("ts").collect()

    found = done(streaming.persistence(arrived(), 1.0, 2), "persisting")
    assert [r["persists"] for r in found] == [False, True, True, True, False, False]
    found = done(streaming.ewma_state(arrived(), 0.5, 2.0), "means")
    assert [r["alarm"] for r in found] == [False, False, False, True, True]
    pairs = done(streaming.joined_streams(arrived(), arrived(), "1 day", "1 day").select("px", "ts", "other"), "pairs")
    assert len(pairs) == 6


def test_percentiles_of_many_values_are_exact(spark):
    """Approximate bounds come out otherwise when computed anew: they must be one table."""
    rows = spark.range(0, 300_000, 1, 24).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") % 10_000_000 / 100.0).alias("value"))
    for by in ([], ["g"]):
        ranked = ranks.cumulative(ranks.counted(rows, by, "value"), by, "value")
        assert "percentile_approx" not in ranked._jdf.queryExecution().optimizedPlan().toString()
        mine = {tuple(r[c] for c in by): (r["lo"], r["hi"]) for r in ranks.percentiles(rows, by, "value", {"lo": 0.02, "hi": 0.98}).collect()}
        for r in rows.groupBy(*by).agg(F.percentile("value", [0.02, 0.98]).alias("p")).collect():
            assert mine.pop(tuple(r[c] for c in by)) == pytest.approx(tuple(r["p"]), abs=1e-9)
        assert not mine


def test_equal_means_are_no_change(spark, tmp_path):
    """364 of 91 items and 316 of 79 have the same mean, whatever the last bits of their sums in doubles."""
    rows = []
    for year, n in ((1996, 91), (1999, 79)):
        tax = [k % 9 / 100 for k in range(n - n % 9)] + [0.04] * (n % 9)
        rows += [(1, f"{year}-05-01", 7.0, 0.05, x) for x in tax] + [(2, f"{year}-05-01", 7.0, 0.05, x) for x in sorted(tax, reverse=year == 1996)]
        rows += [(3, f"{year}-05-01", 7.0, 0.05, 0.04 + (year == 1999) / 100)] * n
    df = spark.createDataFrame(rows, "l_suppkey long, l_shipdate string, l_quantity double, l_discount double, l_tax double")
    df.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = space.QUERIES["change_vectors"](spark, str(tmp_path)).collect()
    assert {r["px"]: r["sector"] for r in found} == {1: 0, 2: 0, 3: 4}
