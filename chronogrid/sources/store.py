"""Series as tables on disk: Parquet by series and year, long and wide CSV, and a data source of numbered text grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import finite

TALL = "series string, px long, ts timestamp, band string, value double"


def save_series(obs: DataFrame, path: str, mode: str = "error") -> None:
    """Facts by series and year, in order of key and date, so that slices of time and place are pruned."""
    rows = obs.withColumn("year", F.year("ts"))
    rows.repartition("series", "year").sortWithinPartitions("px", "ts").write.mode(mode).partitionBy("series", "year").parquet(path)


def open_series(spark: SparkSession, path: str, series: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Facts again, NaN and infinities as no data; series and dates prune partitions and row groups."""
    rows = spark.read.parquet(path)
    if series is not None:
        rows = rows.where(F.col("series") == series)
    if start is not None:
        rows = rows.where((F.col("year") >= int(start[:4])) & (F.col("ts") >= F.lit(start).cast("timestamp")))
    if end is not None:
        rows = rows.where((F.col("year") <= int(end[:4])) & (F.col("ts") <= F.lit(end).cast("timestamp")))
    return rows.withColumn("value", finite(F.col("value"))).drop("year")


def wide_table(obs: DataFrame, dates: list[str], key: str = "px") -> DataFrame:
    """A column for each of the stated dates."""
    return obs.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy(key).pivot("day", dates).agg(F.max("value"))


def save_table(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


class GridSource(DataSource):
    """`spark.read.format("grid")`: text grids (columns, rows, x0, y0, cell size, no-data mark, then rows of numbers) as cells.

    Option `files` is a comma-separated list, each one partition; option `date` a date for each, in the same order.
    """

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return "px long, x int, y int, ts timestamp, value double"

    def reader(self, schema):
        return GridReader(self.options)


class GridReader(DataSourceReader):
    def __init__(self, options):
        self.files = [f for f in options.get("files", "").split(",") if f]
        self.dates = [d for d in options.get("date", "").split(",") if d]
        if len(self.files) != len(self.dates):
            raise ValueError("options files and date need as many entries")

    def partitions(self):
        return [InputPartition(pair) for pair in zip(self.files, self.dates, strict=True)]

    def read(self, partition):
        import datetime

        path, date = partition.value
        when = datetime.datetime.fromisoformat(date)
        head = {}
        with open(path) as f:
            lines = iter(f)
            for line in lines:
                parts = line.split()
                if len(parts) == 2 and parts[0][0].isalpha():
                    head[parts[0].lower()] = float(parts[1])
                    continue
                break
            else:
                return
            width, nodata = int(head["ncols"]), head.get("nodata_value")
            y = 0
            while True:
                for x, text in enumerate(line.split()):
                    v = float(text)
                    yield (y * width + x, x, y, when, None if v == nodata else v)
                y += 1
                line = next(lines, None)
                if line is None:
                    return


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridSource)
