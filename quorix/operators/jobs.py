"""The jobs around the search: checking a policy against labels and the full scan, replay, throughput, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorix.operators import index, search
from quorix.session import shared_dir
from quorix.sources import fixtures, payload


def verify(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: entries, parse_fail, approved_mismatch (bucket search against the label) with its percentage of all
    entries, and full_mismatch (number of frauds against the scan of all references).

    entries: entry_id, payload, expected_approved. Malformed entries are counted and not searched; entries without a
    label are not held against one.
    """
    shared_dir(refs.sparkSession)
    parsed = fixtures.to_vectors(payload.parse_requests(entries)).withColumnRenamed("entry_id", "query_id").checkpoint()
    good = parsed.where(~F.col("malformed"))
    inside = search.search_bucket(refs, good).checkpoint()  # read by both searches
    full = search.vote(good, search.search_full(refs, good, inside=inside)).select("query_id", F.col("frauds").alias("full"))
    found = search.vote(good, inside).select("query_id", "frauds", "approved").join(full, "query_id")
    every = parsed.select("query_id", "malformed", "expected_approved").join(found, "query_id", "left")
    counted = every.agg(
        F.count("*").alias("entries"), F.count_if("malformed").alias("parse_fail"),
        F.count_if(F.col("approved") != F.col("expected_approved")).alias("approved_mismatch"), F.count_if(F.col("frauds") != F.col("full")).alias("full_mismatch"),
    )
    share = F.when(F.col("entries") > 0, 100.0 * F.col("approved_mismatch") / F.col("entries")).otherwise(0.0)
    return counted.select("entries", "parse_fail", "approved_mismatch", (F.round(share * 10000.0) / 10000.0).alias("approved_mismatch_pct"), "full_mismatch")


def replay(entries: DataFrame, entry_id: str, requests: int) -> DataFrame:
    """request_no from 0 and the entry that it sends: entries in the order of their ids, from the first again after the last."""
    placed = index.ranked(entries.select(F.col(entry_id).alias("entry_id"), F.lit(0).alias("_all")), "_all", "entry_id")
    n = max(1, placed.count())
    numbers = entries.sparkSession.range(requests).select(F.col("id").alias("request_no"), (F.col("id") % n).alias("_at"))
    return numbers.join(placed, F.col("_at") == F.col("rank_in_key")).select("request_no", "entry_id")


def throughput(df: DataFrame, milliseconds: str) -> DataFrame:
    """queries, seconds, microseconds a query and queries a second of work done one after the other."""
    total = df.agg(F.count("*").alias("queries"), (F.sum(milliseconds) / 1000.0).alias("s"))
    three = lambda x: F.round(x * 1000.0) / 1000.0
    return total.select("queries", three(F.col("s")).alias("seconds"), three(F.col("s") / F.col("queries") * 1e6).alias("us_per_query"), three(F.col("queries") / F.col("s")).alias("per_second"))


def metric_rows(report: DataFrame, names: Sequence[str]) -> DataFrame:
    """A one-row report as rows (place, metric, value) in the order of the metrics' names."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    listed = report.select(F.inline(rows))
    return listed.select((F.row_number().over(Window.orderBy("metric")) - 1).alias("place"), "metric", "value")  # a handful of rows


def result_json(report: DataFrame, names: Sequence[str]) -> DataFrame:
    """A report as JSON text with its fields in the order of their names."""
    return report.select(F.to_json(F.struct(*sorted(names))).alias("result"))


def labelled(entries: DataFrame, label: Column | None = None) -> DataFrame:
    """The entries that have a label."""
    return entries.where((F.col("expected_approved") if label is None else label).isNotNull())
