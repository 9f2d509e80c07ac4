"""Connected components by alternating large-star and small-star, distributed.

Every step writes its edges as Parquet to the shared folder; nothing is collected but two sums that tell whether the last
round changed an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, cut, sized

ROWS = 500_000  #: edges in one part of a table, at least
ROUNDS = 60  #: far more than any graph needs; the number grows with the square of the logarithm of the nodes


def components(edges: DataFrame, into: Workspace | None = None) -> DataFrame:
    """(node, root) of each node of `edges` (columns u and v, of one orderable type); root is the least node reachable.

    Nulls, loops, repeated edges and further columns of `edges` are ignored; without edges the result is empty.  The result is
    a table of `into`, or one that stays as long as the session.
    """
    with Workspace(edges.sparkSession) as work:
        e = work.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
        last, n = None, e.count()
        small = lambda df: sized(df, 2 * n, ROWS)
        for _ in range(ROUNDS):
            # large star: neighbours greater than a node are tied to the least of its neighbourhood
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # (a table of its own, so that the join can split the centre of a large star)
            least = work.cut(small(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "least")
            e = work.cut(small(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()), "large")
            # small star: a node and its lesser neighbours are tied to the least of them
            least = work.cut(small(e.groupBy("u").agg(F.min("v").alias("m"))), "least")
            tied = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            e = work.cut(small(tied.distinct()), "small")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == last:
                break
            last = now
        else:
            raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
        roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return (into.cut if into else cut)(small(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())), "components")
