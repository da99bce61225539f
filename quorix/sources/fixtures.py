"""Requests and references from the driver's events table; integer vectors from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorix.functions import features

MCC_OF_TYPE = {"purchase": "5411", "view": "5812", "click": "5944", "error": "7801"}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request an event, with its fields and a label."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    events = events.withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    user = Window.partitionBy("user_id")
    order, day = user.orderBy("sec", "event_id"), user.orderBy("sec").rangeBetween(-86400, 0)
    # A sum of doubles depends on their order, which decides averages that lie half-way between two cents.
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cents = lambda x: F.floor(x * 1000.0 + 0.5) / 100.0
    kinds = cents_by_type(events, cents)
    mcc = F.coalesce(*[F.when(F.col("event_type") == t, m) for t, m in MCC_OF_TYPE.items()], F.lit("0000"))
    out = events.withColumns({
        "prev_sec": F.lag("sec").over(order), "prev_type": F.lag("event_type").over(order),
        "cust_avg": cents(F.avg("value").over(whole)), "tx_count_24h": F.count("*").over(day).cast("int"),
    }).join(F.broadcast(kinds), "event_type")  # a handful of types
    iso = lambda sec: F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.select(
        F.col("event_id").alias("request_id"), "user_id", "event_type", (F.col("value") * 10.0).alias("amount"), (F.col("k") % 12 + 1).alias("installments"),
        iso(F.col("sec")).alias("requested_at"), "cust_avg", "tx_count_24h", F.col("event_type").alias("merchant_id"),
        F.when(F.col("prev_type").isNotNull(), F.array("prev_type")).otherwise(F.array().cast("array<string>")).alias("known_merchants"),
        mcc.alias("mcc"), "merch_avg", (F.col("k") % 2 == 0).alias("is_online"), (F.col("k") % 3 == 0).alias("card_present"),
        (F.col("event_id") * 7919 % 1000).cast("double").alias("km_home"), (F.col("prev_sec").isNotNull() & (F.col("k") % 7 != 0)).alias("has_last"),
        iso(F.col("prev_sec")).alias("last_ts"), (F.col("event_id") * 104729 % 1000).cast("double").alias("last_km"),
        ((F.col("event_id") * 31 + F.col("k")) % 100 < 35).alias("fraud"), F.col("value").alias("latency_ms"),
    ).withColumn("unknown_merchant", features.is_unknown_merchant(F.col("known_merchants"), F.col("merchant_id")))


def cents_by_type(events: DataFrame, cents) -> DataFrame:
    """Average amount of each event type: a row for each of a handful of types."""
    return events.groupBy("event_type").agg(cents(F.avg("value")).alias("merch_avg"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, bucket, fraud and q0..q13 of every request."""
    r = requests(spark, sf_dir)
    return to_vectors(r).select(F.col("request_id").alias("ref_id"), "bucket", "fraud", *[f"q{i}" for i in features.DIMS])


def to_vectors(r: DataFrame) -> DataFrame:
    cols = {c: F.col(c) for c in r.columns}
    q = {f"q{i}": features.quantize16(x) for i, x in enumerate(features.vector(cols))}
    bucket = features.bucket_key(cols["is_online"], cols["card_present"], cols["unknown_merchant"], cols["has_last"])
    return r.withColumns({**q, "bucket": bucket})


def embedding_vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """ref_id, label, fraud (odd label), bucket (signs of the first four) and q0..q63."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = [features.quantize16(F.col("embedding")[i].cast("double")).alias(f"q{i}") for i in range(dims)]
    flat = e.select(F.col("vec_id").alias("ref_id"), "label", (F.col("label") % 2 == 1).alias("fraud"), *q)
    signs = [(F.col(f"q{i}") >= 0).cast("int") * (1 << i) for i in range(4)]
    return flat.withColumn("bucket", signs[0] + signs[1] + signs[2] + signs[3])
