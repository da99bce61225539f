"""Confusion counts, weighted errors, scores and latency ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorix.session import shared_dir

#: Fixed values of the score.
K, T_MAX, P99_MIN, P99_MAX, EPS_MIN, BETA, RATE_CUT, CUT = 1000.0, 1000.0, 1.0, 2000.0, 0.001, 300.0, 0.15, -3000.0
W_FP, W_FN, W_ERR = 1, 3, 5


def confusion(df: DataFrame) -> DataFrame:
    """One row tp, tn, fp, fn, err from columns expected, approved (true: approved) and failed."""
    ok = ~F.col("failed")
    n = lambda expected, approved: F.count_if(ok & (F.col("expected") == expected) & (F.col("approved") == approved))
    return df.agg(n(False, False).alias("tp"), n(True, True).alias("tn"), n(True, False).alias("fp"), n(False, True).alias("fn"), F.count_if("failed").alias("err"))


def weighted(counts: DataFrame) -> DataFrame:
    """Adds n, failures, e, epsilon and failure_rate."""
    c = F.col
    n = c("tp") + c("tn") + c("fp") + c("fn") + c("err")
    failures, e = c("fp") + c("fn") + c("err"), W_FP * c("fp") + W_FN * c("fn") + W_ERR * c("err")
    rate = F.when(c("n") > 0, c("failures") / c("n")).otherwise(0.0)
    out = counts.withColumns({"n": n, "failures": failures, "e": e})
    return out.withColumns({"epsilon": F.when(c("n") > 0, c("e") / c("n")).otherwise(0.0), "failure_rate": F.round(rate * 1000000.0) / 1000000.0})


def p99_score(p99: Column) -> Column:
    return F.when(p99 <= 0, 0.0).when(p99 > P99_MAX, CUT).otherwise(K * F.log10(T_MAX / F.greatest(p99, F.lit(P99_MIN))))


def detection_score(failures: Column, n: Column, epsilon: Column, e: Column) -> Column:
    score = K * F.log10(1.0 / F.greatest(epsilon, F.lit(EPS_MIN))) - BETA * F.log10(1.0 + e)
    return F.when((n > 0) & (failures / n > RATE_CUT), CUT).otherwise(score)


def _places(df: DataFrame, value: str) -> DataFrame:
    """Distinct values x with how many values are up to x, beside n, max and avg of all.

    The values are counted first; the running count over distinct values is found by range partitions, so no task
    sorts all rows.
    """
    counts = df.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("c"))
    shared_dir(df.sparkSession)
    # Written down, so that both uses see the same partitions.
    parts = counts.repartitionByRange("x").withColumn("_part", F.spark_partition_id()).checkpoint()
    totals = parts.groupBy("_part").agg(F.sum("c").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = totals.select("_part", before.alias("before"))
    inside = F.sum("c").over(Window.partitionBy("_part").orderBy("x"))
    upto = parts.withColumn("_in", inside).join(shift, "_part").withColumn("upto", F.col("_in") + F.col("before"))
    n = df.agg(F.count("*").alias("n"), F.max(value).alias("max"), F.avg(value).alias("avg"))
    return upto.crossJoin(F.broadcast(n))  # one row


def _at(place: Column) -> Column:
    """The value at a place from 0."""
    return F.min(F.when(F.col("upto") > place, F.col("x")))


def rank_percentiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999)) -> DataFrame:
    """n, max and the values at place floor(n * p) from 0 of the sorted values."""
    return _places(df, value).groupBy("n", "max").agg(*[_at(F.floor(F.col("n") * p)).alias(_name(p)) for p in at])


def interpolated_percentiles(df: DataFrame, value: str, at: tuple[float, ...]) -> DataFrame:
    """n, max, avg and percentiles between the neighbours of place (n - 1) * p."""
    place = lambda p: (F.col("n") - 1) * p
    ends = [c for p in at for c in (_at(F.floor(place(p))).alias(f"lo_{_name(p)}"), _at(F.ceil(place(p))).alias(f"hi_{_name(p)}"))]
    found = _places(df, value).groupBy("n", "max", "avg").agg(*ends)
    between = [(F.col(f"lo_{_name(p)}") + (F.col(f"hi_{_name(p)}") - F.col(f"lo_{_name(p)}")) * (place(p) - F.floor(place(p)))).alias(_name(p)) for p in at]
    return found.select("n", "max", "avg", *between)


def _name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")
