"""Rows that queries share, and rounding that both engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..plans import bindings

#: (px, ts, value) of orders, in SQL
OBS = f"SELECT px, ts, s AS value FROM ({bindings.ORDERS_SQL})"
EVENT_OBS = f"SELECT px, ts, s AS value FROM ({bindings.EVENTS_SQL})"
ITEM_OBS = f"SELECT px, ts, quantity AS value FROM ({bindings.ITEMS_SQL})"
#: a class from 1 to 4 of each customer and year, by the year's mean price
CLASSES = f"SELECT px, year(ts)::INT AS period, least(4, greatest(1, floor(avg(value) / 100000)::INT)) AS class FROM ({OBS}) WHERE value IS NOT NULL GROUP BY 1, 2"


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.orders(spark, sf_dir).rows.select("px", "ts", F.col("s").alias("value"))


def event_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.events(spark, sf_dir).rows.select("px", "ts", F.col("s").alias("value"))


def item_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.items(spark, sf_dir).rows.select("px", "ts", F.col("quantity").alias("value"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.avg("value") / 100000).cast("int")))
    return obs(spark, sf_dir).where("value is not null").groupBy("px", F.year("ts").alias("period")).agg(c.alias("class"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bindings.read(spark, sf_dir, name)


def shift(digits: int) -> float:
    """An eighth of the last digit.  Sums and slopes of prices in cents often lie right between two rounded numbers, where the
    engines' last bits decide; moved by this much on both sides, they don't."""
    return 0.125 * 10.0**-digits


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, NaN and infinities as NULL."""
    return df.select(*[F.round(finite(F.col(f"`{c}`")) + F.lit(shift(digits)), digits).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])


def rounded_sql(sql: str, doubles: str, digits: int = 6) -> str:
    """The same of the named columns of a query."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE + {shift(digits):.12f}, {digits}) AS {c}' for c in doubles.split())}) FROM ({sql})"


class Registry:
    """Queries of one module by name."""

    def __init__(self):
        self.queries, self.oracle = {}, {}

    def add(self, name: str, run, sql: str | None = None, doubles: str = "", digits: int = 6):
        self.queries[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir), digits)
        if sql is not None:
            self.oracle[name] = rounded_sql(sql, doubles, digits) if doubles else sql
