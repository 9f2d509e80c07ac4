"""Embedding vectors: similarity, change, few-shot classes, compact storage, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divide
from .ranks import percentiles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; none where one has no length."""
    n = norm(a) * norm(b)
    return divide(dot(a, b), F.when(n > 0, n))


def similarity_to(vectors: DataFrame, reference: list[float]) -> DataFrame:
    return vectors.select("id", cosine(F.col("vector"), F.lit(reference)).alias("similarity"))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """1 - cosine of each id's vectors in two years."""
    both = before.select("id", F.col("vector").alias("a")).join(after.select("id", F.col("vector").alias("b")), "id")
    return both.select("id", (1 - cosine(F.col("a"), F.col("b"))).alias("change"))


def centroids(labelled: DataFrame) -> DataFrame:
    """The mean of each label's unit vectors."""
    per = labelled.select("label", unit(F.col("vector")).alias("u")).select("label", F.posexplode("u").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v"))
    return per.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("centroid"))


def unit(a: Column) -> Column:
    """A vector at length 1; NULL where it has none.  The length is bound to an array's element, or it would be computed for each number."""
    return F.element_at(F.transform(F.array(norm(a)), lambda length: F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))), 1)


def classify_nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """The label whose centroid has the greatest cosine, the least label on ties.  Centres are one row a label, broadcast as one array of unit vectors."""
    table = centres.select("label", unit(F.col("centroid")).alias("u")).agg(F.collect_list(F.struct("label", "u")).alias("centres"))
    rated = vectors.select("id", "vector", norm(F.col("vector")).alias("length")).join(F.broadcast(table))  # one row
    best = F.array_max(F.transform("centres", lambda c: F.struct(F.round(divide(dot(F.col("vector"), c["u"]), F.when(F.col("length") > 0, F.col("length"))), 12).alias("s"), (-c["label"]).alias("l"))))
    return rated.select("id", best.alias("b")).select("id", (-F.col("b.l")).alias("label"), F.col("b.s").alias("similarity"))


def quantised(vectors: DataFrame) -> DataFrame:
    """Vectors as 8-bit steps between their extremes: scale, offset and codes."""
    lo, hi = F.array_min("vector").cast("double"), F.array_max("vector").cast("double")
    scale = F.when(hi > lo, (hi - lo) / 254.0).otherwise(1.0)
    out = vectors.select("id", "vector", scale.alias("scale"), ((hi + lo) / 2).alias("offset"))
    codes = F.transform("vector", lambda x: F.rint((x.cast("double") - F.col("offset")) / F.col("scale")).cast("tinyint"))
    return out.select("id", "scale", "offset", codes.alias("codes"))


def restored(stored: DataFrame) -> DataFrame:
    return stored.select("id", F.transform("codes", lambda c: c * F.col("scale") + F.col("offset")).alias("vector"))


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2_000) -> DataFrame:
    """The k ids of the greatest cosine for each of a stated set of query vectors (the lesser id on ties), exactly.

    Queries go round in blocks of about `block`; each batch of vectors is held against a block by one matrix product and
    keeps its own best k for each query, so that what is shuffled is a few rows for each batch and query.
    """
    n = queries.select("id").distinct().count()
    blocks, out = max(1, -(-n // block)), None
    for part in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).select("id", unit(F.col("vector")).alias("u")).where("u is not null").collect()
        if not rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows]), np.array([r["u"] for r in rows], float)))

        def best(batches, shared=shared):
            ids, against = shared.value
            for b in batches:
                own, x = b.column("id").to_numpy(), np.array(b.column("vector").to_pylist(), float).reshape(b.num_rows, -1)
                length = np.sqrt((x * x).sum(axis=1))
                found = length > 0
                own, x = own[found], x[found] / length[found, None]
                if not len(own):
                    continue
                s = np.round(x @ against.T, 9)
                s[own[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own[:, None], s.shape), -s), axis=0)[:k]
                q = np.broadcast_to(np.arange(len(ids)), order.shape)
                keep = np.isfinite(s[order, q])
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(own[order[keep]]), pa.array(s[order[keep], q[keep]])], ["query", "id", "similarity"])

        near = vectors.select(F.col("id").cast("long").alias("id"), "vector").where("vector is not null").mapInArrow(best, "query long, id long, similarity double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query long, id long, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def dissimilarity(points: DataFrame, training: DataFrame) -> DataFrame:
    """Area of applicability: each point's distance to the nearest training point over their mean distance apart (id, x: array); training is a bounded sample."""
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    table = training.agg(F.collect_list("x").alias("t"))
    own = table.select(F.explode("t").alias("a"), "t").select(F.explode(F.transform("t", lambda b: far(F.col("a"), b))).alias("d"))
    mean = own.where("d > 0").agg(F.avg("d").alias("mean"))
    rated = points.join(F.broadcast(table)).join(F.broadcast(mean))  # one row each
    return rated.select("id", divide(F.array_min(F.transform("t", lambda b: far(F.col("x"), b))), F.col("mean")).alias("di"))


def percentile_scaled(obs: DataFrame, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Values between two percentiles of all as 1e-4 to 1."""
    p = percentiles(obs, [], "value", {"a": lo, "b": hi})
    x = divide(F.col("value") - F.col("a"), F.col("b") - F.col("a"))
    return obs.join(F.broadcast(p)).select("px", "ts", F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(1e-4), x))).alias("value"))
