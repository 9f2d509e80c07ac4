"""Sources, calendars and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..plans.cut import cut
from ..sources import names
from .common import EVENT_OBS, Registry, event_obs, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

FILES = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'scene_' || strftime(o_orderdate, '%Y%m%d') || '_B' || (o_orderkey % 13) || '.tif' WHEN 1 THEN 'p' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'MOD13.A' || strftime(o_orderdate, '%Y%j') || '.hdf' ELSE 'map_' || strftime(o_orderdate, '%Y') END AS name, CASE o_orderkey % 4 WHEN 3 THEN date_trunc('year', o_orderdate)::TIMESTAMP ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS ts FROM orders"


def _files(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    k = F.col("o_orderkey") % 4
    of = lambda f: F.date_format("t", f)
    name = F.when(k == 0, F.concat(F.lit("scene_"), of("yyyyMMdd"), F.lit("_B"), (F.col("o_orderkey") % 13).cast("string"), F.lit(".tif"))).when(k == 1, F.concat(F.lit("p"), of("yyyy-MM-dd"))).when(k == 2, F.concat(F.lit("MOD13.A"), of("yyyyDDD"), F.lit(".hdf"))).otherwise(F.concat(F.lit("map_"), of("yyyy")))
    return o.select(F.col("o_orderkey").alias("id"), name.alias("name"))


#: digits at a width of 20, for each shape of name
NATURAL = """SELECT o_orderkey AS id, CASE o_orderkey % 4
    WHEN 0 THEN 'scene_' || lpad(strftime(o_orderdate, '%Y%m%d'), 20, '0') || '_b' || lpad((o_orderkey % 13)::VARCHAR, 20, '0') || '.tif'
    WHEN 1 THEN 'p' || lpad(strftime(o_orderdate, '%Y'), 20, '0') || '-' || lpad(strftime(o_orderdate, '%m'), 20, '0') || '-' || lpad(strftime(o_orderdate, '%d'), 20, '0')
    WHEN 2 THEN 'mod' || lpad('13', 20, '0') || '.a' || lpad(strftime(o_orderdate, '%Y%j'), 20, '0') || '.hdf' ELSE 'map_' || lpad(strftime(o_orderdate, '%Y'), 20, '0') END AS k FROM orders"""

R.add("dates_from_names", lambda s, d: _files(s, d).withColumn("ts", names.date_of_name(F.col("name"))), FILES)
R.add("natural_order", lambda s, d: _files(s, d).select("id", names.natural_key(F.col("name")).alias("k")), NATURAL)
R.add("bands_to_rows", lambda s, d: names.bands_to_rows(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]), "SELECT l_orderkey, l_linenumber, band, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME band VALUE value)", "value")
R.add("stored_numbers", lambda s, d: table(s, d, "part").select("p_partkey", names.scaled(F.col("p_size"), 7, 0.01, -0.1).alias("value")), "SELECT p_partkey, CASE WHEN p_size <> 7 THEN p_size * 0.01 - 0.1 END AS value FROM part", "value")
R.add("cf_time", lambda s, d: table(s, d, "orders").select("o_orderkey", names.cf_time(F.col("o_orderkey") / 4.0, "hours since 1990-03-01 06:00").alias("ts")), "SELECT o_orderkey, TIMESTAMP '1990-03-01 06:00:00' + to_seconds(o_orderkey * 900) AS ts FROM orders")
R.add("cf_time_360", lambda s, d: table(s, d, "orders").select("o_orderkey", names.cf_time(F.col("o_orderkey").cast("double"), "days since 2000-01-01", "360_day").alias("ts")), "SELECT o_orderkey, (first + least(o_orderkey % 30, day(last_day(first)) - 1)::INT)::TIMESTAMP AS ts FROM (SELECT o_orderkey, make_date((2000 + o_orderkey // 360)::INT, ((o_orderkey % 360) // 30 + 1)::INT, 1) AS first FROM orders)")


# -- streams, run until what is there is done ------------------------------------------------------------------------
FILES_OF_STREAM = 4


def _streamed(s, d, of, keys):
    """A streaming plan over `events`, run to its end one file at a time; every file has dates from first to last, so that most are late."""
    source = cut(event_obs(s, d).repartition(FILES_OF_STREAM, "ts", "px"))
    path = source.inputFiles()[0].rsplit("/", 1)[0]
    raw = s.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, checkpoint = f"{path}-out", f"{path}-state"
    streaming.logged(of(raw), out, checkpoint).awaitTermination()
    return streaming.newest(s, out, keys)


R.add("stream_fixed_periods", lambda s, d: _streamed(s, d, lambda x: streaming.fixed_periods(x, "16 days", "60 days"), ["px", "start", "end"]), f"SELECT px, time_bucket(INTERVAL 16 DAY, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 16 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 16 DAY AS \"end\", avg(value) AS mean, min(value) AS min, max(value) AS max, count(value) AS n FROM ({EVENT_OBS}) GROUP BY 1, 2", "mean min max")
R.add("stream_running_reduction", lambda s, d: _streamed(s, d, streaming.running_reduction, ["px"]), f"SELECT px, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM ({EVENT_OBS}) GROUP BY 1", "max mean std")
R.add("stream_sliding_windows", lambda s, d: _streamed(s, d, lambda x: streaming.sliding_windows(x, "10 days", "5 days", "60 days"), ["px", "start", "end"]), f"SELECT px, w AS start, w + INTERVAL 10 DAY AS \"end\", avg(value) AS mean, count(value) AS n FROM (SELECT px, value, unnest([time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 DAY]) AS w FROM ({EVENT_OBS})) GROUP BY 1, 2", "mean")
R.add("batch_session_runs", lambda s, d: streaming.runs(event_obs(s, d), "1 day", "0 seconds"), f"""SELECT px, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n, max(value) AS max FROM (SELECT *, sum(new) OVER (PARTITION BY px ORDER BY ts) AS run FROM (
    SELECT *, (lag(ts) OVER (PARTITION BY px ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY px ORDER BY ts) >= INTERVAL 1 DAY)::INT AS new FROM ({EVENT_OBS}))) GROUP BY px, run""", "max")


def _pairs(s, d):
    """Views and clicks of one user within an hour of each other, from two streams."""
    e = table(s, d, "events").select(F.col("user_id").cast("long").alias("px"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"), "event_type")
    sides = []
    for kind in ("view", "click"):
        rows = cut(e.where(F.col("event_type") == kind).drop("event_type").repartition(FILES_OF_STREAM, "ts", "px"))
        path = rows.inputFiles()[0].rsplit("/", 1)[0]
        sides.append(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))
    out = f"{path}-pairs"
    streaming.to_parquet(streaming.joined_streams(*sides, "1 hour", "60 days"), out, f"{out}-state").awaitTermination()
    return s.read.parquet(out)


R.add("stream_join", _pairs, "SELECT a.user_id::BIGINT AS px, a.ts, a.value, b.ts AS other_ts, b.value AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000", "value other")

