"""Item catalogues (STAC) and vector files (GeoJSON), as tables.

Files are read with a stated schema by Spark's JSON reader, a line for each item or feature, or a collection in one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = """id string, collection string, bbox array<double>, properties struct<datetime:string,`eo:cloud_cover`:double,`proj:epsg`:int,`proj:code`:string,gsd:double,platform:string,`sat:orbit_state`:string>,
    assets map<string, struct<href:string,type:string>>"""
FEATURE = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items as rows: id, collection, ts, cloud, bbox, epsg, gsd, platform, orbit, assets."""
    whole = spark.read.schema(f"{ITEM}, features array<struct<{_as_struct(ITEM)}>>").option("multiLine", False).json(path)
    flat = whole.where("features is null").drop("features").unionByName(whole.where("features is not null").select(F.explode("features").alias("f")).select("f.*"))
    p = F.col("properties")
    return flat.select(
        "id", "collection", F.try_to_timestamp(p["datetime"]).alias("ts"), p["eo:cloud_cover"].alias("cloud"), "bbox",
        F.coalesce(p["proj:epsg"], F.expr("try_cast(regexp_extract(properties.`proj:code`, '[0-9]+', 0) as int)")).alias("epsg"), p["gsd"].alias("gsd"), p["platform"].alias("platform"), p["sat:orbit_state"].alias("orbit"), "assets",
    )


def _as_struct(schema: str) -> str:
    """A DDL schema as the inside of a struct type."""
    parts = (field.strip().partition(" ") for field in _fields(schema))
    return ",".join(f"{name}:{kind}" for name, _, kind in parts)


def _fields(schema: str) -> list[str]:
    depth, out, now = 0, [], ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def search(items: DataFrame, bbox: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None, max_cloud: float | None = None, max_items: int | None = None, collection: str | None = None) -> DataFrame:
    """Items of a collection that meet a box and dates (both ends included), at most so cloudy, the oldest first; unknown clouds pass."""
    out = items
    if collection is not None:
        out = out.where(F.col("collection") == collection)
    if bbox is not None:
        b = F.col("bbox")
        out = out.where((b[0] <= bbox[2]) & (b[2] >= bbox[0]) & (b[1] <= bbox[3]) & (b[3] >= bbox[1]))
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    if max_cloud is not None:
        out = out.where(F.coalesce("cloud", F.lit(0.0)) <= max_cloud)
    return out.orderBy("ts", "id").limit(max_items) if max_items is not None else out


def by_day(items: DataFrame) -> DataFrame:
    """Items of a day and platform together, with their mean cloud and their common box."""
    b = F.col("bbox")
    return items.groupBy(F.to_date("ts").alias("day"), "platform").agg(
        F.count("*").alias("n"), F.avg("cloud").alias("cloud"), F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3])).alias("bbox"), F.array_sort(F.collect_list("id")).alias("ids")
    )


def common_grid(items: DataFrame) -> DataFrame:
    """The most frequent reference system (the least number on ties) and its finest resolution."""
    n = items.where("epsg is not null").groupBy("epsg").agg(F.count("*").alias("n"), F.min("gsd").alias("gsd"))
    return n.orderBy(F.desc("n"), "epsg").limit(1).select("epsg", "gsd")


def read_features(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Polygons and points of GeoJSON: fid, attrs, rings (array of rings of x, y); a multipolygon's rings go together by the even-odd rule."""
    raw = spark.read.schema(f"{FEATURE}, features array<struct<{_as_struct(FEATURE)}>>").option("multiLine", multiline).json(path)
    flat = raw.where("features is null").drop("features").unionByName(raw.where("features is not null").select(F.explode("features").alias("f")).select("f.*"))
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    polygon = F.from_json(text, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    point = F.array(F.array(F.from_json(text, "array<double>")))
    rings = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi).when(kind == "Point", point)
    named = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return flat.select(F.coalesce("id", F.xxhash64(F.to_json("properties"), text).cast("string")).alias("fid"), F.col("properties").alias("attrs"), kind.alias("kind"), named.alias("rings"))


def outer_ring(rings: Column) -> Column:
    return F.get(rings, F.lit(0))


def mosaic(observations: DataFrame, keys: list[str]) -> DataFrame:
    """The first valid value of each key in the order of items (keys, item_order, value)."""
    best = observations.where("value is not null").groupBy(*keys).agg(F.min(F.struct("item_order", "value")).alias("b"))
    return observations.select(*keys).distinct().join(best, keys, "left").select(*keys, F.col("b.value").alias("value"))


def series_of_files(files: DataFrame) -> DataFrame:
    """Loose files (name, band, tile) as a plan: date, band, the tiles that make it up and its place in the series."""
    from .names import date_of_name, natural_key

    dated = files.withColumn("ts", date_of_name(F.col("name"))).withColumn("k", natural_key(F.col("name")))
    per = dated.where("ts is not null").groupBy("ts", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("files"))
    return per.withColumn("t", F.dense_rank().over(Window.partitionBy("band").orderBy("ts")) - 1)
