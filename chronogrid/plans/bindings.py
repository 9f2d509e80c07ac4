"""The driver's tables as cubes, and the same in SQL.

Every cube has one row for each key and moment.  Where several source rows share both, the greatest value is taken, so that
the result doesn't depend on their order.  Every seventh source row counts as no data, so that gaps are met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..lang import Cube

ORDERS_SQL = """SELECT o_custkey::BIGINT AS px, o_orderdate AS ts,
  max(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END) AS s, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2"""
EVENTS_SQL = """SELECT user_id::BIGINT AS px, ts,
  max(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END) AS s,
  max(CASE WHEN event_type = 'view' THEN value END) AS red, max(CASE WHEN event_type <> 'view' THEN value END) AS nir,
  max(json_extract_string(props, '$.k')::INT)::DOUBLE AS q FROM events GROUP BY 1, 2"""
ITEMS_SQL = """SELECT l_suppkey::BIGINT AS px, l_shipdate AS ts,
  max(CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END) AS s, max(l_quantity) AS quantity,
  max(l_discount) AS discount, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2"""

#: prices by customer, of which only every twentieth order counts as known: gaps of dozens of dates
GAPS_SQL = """SELECT o_custkey::BIGINT % 20 AS px, o_orderdate AS ts, max(CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice END) AS s FROM orders GROUP BY 1, 2"""
#: quality codes of all 8-bit values
CODES_SQL = """SELECT user_id::BIGINT AS px, ts, max(value) AS s, max(event_id % 256)::DOUBLE AS q FROM events GROUP BY 1, 2"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Cube:
    """Prices of orders by customer: keys over six years."""
    o = read(spark, sf_dir, "orders")
    s = F.max(F.when(F.col("o_orderkey") % 7 != 0, finite(F.col("o_totalprice"))))
    rows = o.groupBy(F.col("o_custkey").cast("long").alias("px"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return Cube(rows.agg(s.alias("s"), F.count("*").cast("double").alias("n")))


def events(spark: SparkSession, sf_dir: str) -> Cube:
    """Values of events by user: two bands by type, quality codes."""
    e = read(spark, sf_dir, "events")
    v, view = finite(F.col("value")), F.col("event_type") == "view"
    rows = e.groupBy(F.col("user_id").cast("long").alias("px"), F.col("ts").cast("timestamp").alias("ts"))
    code = F.get_json_object("props", "$.k").cast("int")
    return Cube(rows.agg(F.max(F.when(F.col("event_id") % 7 != 0, v)).alias("s"), F.max(F.when(view, v)).alias("red"), F.max(F.when(~view, v)).alias("nir"), F.max(code).cast("double").alias("q")))


def gaps(spark: SparkSession, sf_dir: str) -> Cube:
    """Prices of orders by twenty groups of customers, known at one order in twenty."""
    o = read(spark, sf_dir, "orders")
    rows = o.groupBy((F.col("o_custkey").cast("long") % 20).alias("px"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return Cube(rows.agg(F.max(F.when(F.col("o_orderkey") % 20 == 0, finite(F.col("o_totalprice")))).alias("s")))


def codes(spark: SparkSession, sf_dir: str) -> Cube:
    """Values of events with a quality code from 0 to 255."""
    e = read(spark, sf_dir, "events")
    rows = e.groupBy(F.col("user_id").cast("long").alias("px"), F.col("ts").cast("timestamp").alias("ts"))
    return Cube(rows.agg(F.max(finite(F.col("value"))).alias("s"), F.max(F.col("event_id") % 256).cast("double").alias("q")))


def items(spark: SparkSession, sf_dir: str) -> Cube:
    """Line items by supplier: four bands over six years."""
    i = read(spark, sf_dir, "lineitem")
    rows = i.groupBy(F.col("l_suppkey").cast("long").alias("px"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    s = F.max(F.when(F.col("l_orderkey") % 7 != 0, finite(F.col("l_extendedprice"))))
    return Cube(rows.agg(s.alias("s"), *[F.max(finite(F.col(f"l_{b}"))).alias(b) for b in ("quantity", "discount", "tax")]))
