"""Connected components of an edge table by stars, each round cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: A key is hot if it has more than this part of all rows, so there are fewer hot keys than this number.
HOT = 1000
#: So many keys at most are broadcast as a whole.
SMALL = 50_000


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """left joined with right, which has one row a key and in column `n` how many of the `rows` rows of left have it. The
    few hot keys are broadcast, so that their rows stay where they lie; so are all keys if `rows` bounds them."""
    if rows <= SMALL:
        return left.join(F.broadcast(right.drop(n)), key)
    hot, cold = right.where(F.col(n) > rows // HOT).drop(n), right.where(F.col(n) <= rows // HOT).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def _stars(edges: DataFrame, rows: int) -> DataFrame:
    """Ties each node and all its neighbours to the smallest of them; what was connected stays connected."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    moved = spread_join(both, least, "u", "n", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> (node, comp): comp is the smallest node of the component.

    Only nodes with an edge appear. Rounds end when the edges are stars and no longer change.
    """
    rows, sign = edges.count(), None
    now = common.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), rows)
    while True:
        now = common.cut(_stars(now, rows), 2 * rows)
        last, sign = sign, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        rows = sign[0]
        if sign == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())
