"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

A document has a fixed hash. A source that gets `target` words of its `total` repeats all its documents
floor(target / total) times and adds those whose hash lies below a threshold. The threshold comes from
histograms: words are summed by source and hash bucket, the running sum shows the bucket in which the
budget ends, and only that bucket is split again, until it is one hash value. Nothing is sorted but
histograms. A larger budget has a larger threshold, so the mixes of growing budgets are nested.

Cases: null text has size 0; null sources are one source, last in order; rows without an id, or
of one id, are told apart by their texts, and rows with the same id and text are taken or left together; a table without rows or words gives targets of 0. Of the input, only the named
columns are used, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

HASH_BITS, STEP_BITS = 48, 12


def document_hash(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """48 bits of md5 over seed, id and text: the same on every run and engine."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """One row a source (_source, source_size) -> and target.

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating. All share the sum of
    sizes; no target passes max_repeat * source_size, and what is cut goes to the others by weight. With the
    sources ordered by cap / weight, those below some place are capped and the rest share what is left.
    """
    # One row a source: these windows see the list of sources, never documents.
    names = Window.orderBy(F.col("_source").asc_nulls_last())
    rank = (F.row_number().over(names) - 1) % len(weights)
    weighed = totals.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), rank + 1).cast("long"))
    weighed = weighed.withColumn("_cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shared = weighed.withColumns({
        "_left": F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_shares": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
    }).withColumn("_level", F.col("_left") / F.col("_shares"))
    free = F.col("_level") <= F.col("_cap") / F.col("_w")
    level = F.first(F.when(free, F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return shared.withColumn("target", F.when(level.isNull(), F.col("_cap").cast("double")).otherwise(F.col("_w") * level)).select("_source", "source_size", "target")


def _boundary(sizes: DataFrame, state: DataFrame, level: int, rows: int) -> DataFrame:
    """Splits each source's boundary bucket in 2**STEP_BITS and finds the part in which its budget ends."""
    shift = HASH_BITS - STEP_BITS * (level + 1)
    here = F.shiftright("h", shift + STEP_BITS) == F.col("_prefix")
    inside = sizes.join(common.small_side(state, rows), sizes["source"].eqNullSafe(state["_source"]) & here)
    histogram = inside.groupBy("_source", F.shiftright("h", shift).alias("_bucket")).agg(
        F.sum("size").alias("_words"), F.first("_below").alias("_base"), F.first("_budget").alias("_budget")
    )
    order = Window.partitionBy("_source").orderBy("_bucket")
    running = histogram.withColumn("_incl", F.col("_base") + F.sum("_words").over(order))
    ends = running.where(F.col("_incl") >= F.col("_budget")).groupBy("_source").agg(F.min_by(F.struct(F.col("_bucket").alias("_prefix"), (F.col("_incl") - F.col("_words")).alias("_below"), "_budget", "_incl"), "_bucket").alias("_at"))
    return ends.select("_source", "_at.*")


def thresholds(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """(_source, source_size, target, _whole, _limit): documents with h < _limit come once more than _whole times."""
    targets = common.cut(
        targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size"))
    )
    rows = targets.count()
    state = targets.where(F.col("_budget") > 0).select("_source", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_below"), "_budget")
    for level in range(HASH_BITS // STEP_BITS):
        state = common.cut(_boundary(sizes, state, level, rows))
    # The last bucket is one hash value: it is taken if that brings the sum nearer to the budget.
    takes = (F.col("_below") + F.col("_incl")) < 2 * F.col("_budget")
    limit = state.select(F.col("_source").alias("_s"), (F.col("_prefix") + F.when(takes, 1).otherwise(0)).alias("_limit"))
    joined = targets.join(common.small_side(limit, rows), F.col("_source").eqNullSafe(F.col("_s")), "left")
    return joined.select("_source", "source_size", "target", "_whole", F.coalesce("_limit", F.lit(0).cast("long")).alias("_limit")), rows


def plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """Sizes of all documents (doc_id, source, size, h), thresholds of all sources, and the number of sources."""
    sizes = common.cut(docs.select(
        common.named(doc_id).alias("doc_id"), common.named(source).alias("source"), common.word_count(common.named(text)).alias("size"), document_hash(common.named(doc_id), common.named(text)).alias("h")
    ))
    totals = common.cut(sizes.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("source_size")))
    limits, rows = thresholds(sizes, source_targets(totals, weights, max_repeat))
    return sizes, limits, rows


@common.tidied
def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= size * copies) of every document."""
    sizes, limits, rows = plan(docs, weights, max_repeat, doc_id, text, source)
    joined = sizes.join(common.small_side(limits, rows), sizes["source"].eqNullSafe(limits["_source"]))
    copies = F.col("_whole") + F.when(F.col("h") < F.col("_limit"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


@common.tidied
def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with `copies` (in place of a column of that name); texts stay where they lie."""
    _, limits, rows = plan(docs, weights, max_repeat, doc_id, text, source)
    names = [common.fresh(x, docs.columns) for x in ("_source", "_whole", "_limit")]
    limits = limits.select("_source", "_whole", "_limit").toDF(*names)
    joined = docs.join(common.small_side(limits, rows), common.named(source).eqNullSafe(F.col(names[0])))
    copies = F.col(names[1]) + F.when(document_hash(common.named(doc_id), common.named(text)) < F.col(names[2]), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).where("copies > 0").drop(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rule with a sort of every source in hash order.
SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source ASC NULLS LAST) AS rn FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lev FROM o),
f AS (SELECT min(rn) AS rn FROM l WHERE lev <= CAST(3 * source_size AS DOUBLE) / w),
t AS (SELECT l.source, l.source_size, CASE WHEN l.rn >= f.rn THEN l.w * (SELECT lev FROM l x WHERE x.rn = f.rn) ELSE CAST(3 * l.source_size AS DOUBLE) END AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS incl,
        sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN budget > 0 AND CAST(incl - own + incl AS DOUBLE) < 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
