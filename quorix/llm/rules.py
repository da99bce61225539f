"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each document gets counts of its words and lines. Four ratios of them, as whole numbers, go into sketches:
a sketch is a histogram over buckets of bounded relative width (a value keeps its 6 leading bits), so sketches
merge by adding counts and quantiles are off by 1/32 at most. One sketch for each language, source and ratio is
built by a partial aggregation; those of a language, and of all, are sums of them.

Fences. A ratio has a high quantile (the upper quartile where most texts are alike, the 99th hundredth where many have
nothing and few have much) and a reach. The upper fence of a group lies `reach` spreads above the group's own high
quantile, where the spread is the distance from the median to it, and one sketch bucket at least; so a ratio with a
high quantile of 0.99 rejects less than a hundredth of any group. The lower fence of word length mirrors it. Groups
under `least` documents use their language's fences, or those of all. No constant is compared with a ratio.

Texts are counted once a pass, a piece of a batch at a time, with arrays of a fixed number of entries a word.

Cases: null and empty texts have no words and fail the base rule; null language or source is a group of its
own; repeated rows are judged one by one; an empty table gives no rows. Other columns pass through unchanged, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .jaccard import sequence_hashes

_SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
LEAD_BITS = 6
#: Ratios in whole numbers: (name, numerator, denominator, scale, high quantile, reach, whether there is a lower fence).
RATIOS = (
    ("symbols", "n_symbols", "n_words", 1000, 0.75, 32, False),
    ("word_length", "word_chars", "n_words", 100, 0.75, 8, True),
    ("repeats", "n_repeat_words", "n_words", 1000, 0.99, 2, False),
    ("dup_lines", "n_dup_lines", "n_lines", 1000, 0.99, 2, False),
)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
_LETTER = np.arange(256) & 0xC0 != 0x80  # the first byte of a character ...
_LETTER[list(common.SPACE_BYTES)] = False  # ... of a word
_COUNTED = pa.struct([(c.split()[0], pa.int64()) for c in COUNTS.split(", ")])


def _again(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes of parts of texts: which class of equal parts of one text each is in, and the sizes of the classes."""
    _, which, size = np.unique(common.mix64(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    return which, size


def count_piece(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The six counts of texts that lie one after the other in a buffer, as rows."""
    n = len(ends)
    # A line break behind each text keeps its words and lines apart.
    joined = np.insert(data, ends, 10)
    ends = ends + np.arange(1, n + 1)
    total = lambda flags: np.diff(np.r_[0, np.r_[0, np.cumsum(flags)][ends]])
    start, end = common.word_bounds(joined)
    owner = np.searchsorted(ends, start, side="right")
    words = np.bincount(owner, minlength=n)
    breaks = np.flatnonzero(joined == 10)
    first = np.r_[0, breaks[:-1] + 1]
    used = np.searchsorted(start, breaks) > np.searchsorted(start, first)
    first, last = first[used], breaks[used]
    line_owner = np.searchsorted(ends, first, side="right")
    lines = np.bincount(line_owner, minlength=n)
    which, size = _again(line_owner, common.string_hashes(joined, first, last, 51))
    kinds = np.zeros(len(size), np.int64)
    kinds[which] = line_owner
    repeats = np.zeros(n, np.int64)
    if len(start) > 3:
        windows = sequence_hashes(common.string_hashes(joined, start, end, 52), 3)
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        which, size = _again(owner[inside], windows[inside])
        at = inside[size[which] > 1]
        covered = np.zeros(len(start), bool)
        for k in range(3):
            covered[at + k] = True
        repeats = np.bincount(owner[covered], minlength=n)
    return np.stack([words, total(_LETTER[joined]), total(_IS_SYMBOL[joined]), lines, lines - np.bincount(kinds, minlength=n), repeats], axis=1)


def count_column(column: pa.Array) -> np.ndarray:
    """The six counts of each text in UTF-8."""
    data, offsets = common.binary_column(column)
    found = [count_piece(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]) for a, b in common.pieces(offsets, 1 << 20)]
    return np.concatenate(found) if found else np.empty((0, 6), np.int64)


def _count_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in count_column(batch).T], fields=list(_COUNTED))


def text_counts(text: Column) -> Column:
    """The counts as a struct. Marked as nondeterministic, so that no rule of the optimizer evaluates them twice."""
    return F.arrow_udf(_count_batches, COUNTS).asNondeterministic()(F.coalesce(text, F.lit("")).cast("binary"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _ratio(rule: tuple, counts: str = "") -> Column:
    _, top, bottom, scale, *_ = rule
    return F.expr(f"CASE WHEN {counts}{bottom} > 0 THEN {counts}{top} * {scale} div {counts}{bottom} ELSE 0 END")


def bucket(value: Column) -> Column:
    """Bucket of a whole number that keeps its LEAD_BITS leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - LEAD_BITS, F.lit(0))
    return (F.call_function("shiftright", value, shift) + shift * (1 << (LEAD_BITS - 1))).cast("int")


def bucket_value(b: Column) -> Column:
    """The largest value of a bucket."""
    half = 1 << (LEAD_BITS - 1)
    shift = F.greatest((b / half).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - shift * half).cast("long") + 1, shift) - 1


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, count): one mergeable sketch for each language, source and rule."""
    values = F.array(*[F.struct(F.lit(i).alias("rule"), bucket(_ratio(r)).alias("bucket")) for i, r in enumerate(RATIOS)])
    return counts.where("n_words > 0").select("lang", "source", F.inline(values)).groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("count"))


def width(value: Column) -> Column:
    """The width of a value's bucket."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(value)) - LEAD_BITS, F.lit(0)))


def _by_rule(k: int, kind: str) -> Column:
    """Field k of RATIOS for the row's rule."""
    return F.element_at(F.array(*[F.lit(r[k]).cast(kind) for r in RATIOS]), F.col("rule") + 1)


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merged sketches by the given columns -> low and high quantile, median and number of documents for each rule."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("count").alias("count"))
    group = Window.partitionBy(*by, "rule")
    order = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = merged.withColumns({"_upto": F.sum("count").over(order), "_n": F.sum("count").over(group), "_high": _by_rule(4, "double")})
    at = lambda q: F.min(F.when(F.col("_upto") >= F.col("_n") * q, bucket_value(F.col("bucket"))))
    return running.groupBy(*by, "rule").agg(F.first("_n").alias("n"), at(1 - F.col("_high")).alias("low"), at(0.5).alias("mid"), at(F.col("_high")).alias("high"))


def fences(sketch: DataFrame, reach: float = 1.0, least: int = 50) -> DataFrame:
    """(_lang, _source, lower, upper): the fences of each language and source, arrays by rule. One row a group. `reach`
    multiplies the reach of every ratio."""
    far, high, low, mid = F.ceil(_by_rule(5, "long") * reach), F.col("high"), F.col("low"), F.col("mid")
    upper = high + far * F.greatest(high - mid, width(high))
    lower = F.when(_by_rule(6, "boolean"), low - far * F.greatest(mid - low, width(low))).otherwise(F.lit(-1)).cast("long")
    bound = F.struct(F.col("rule"), lower.alias("lower"), upper.alias("upper"))
    rows = lambda by: _quantiles(sketch, by).groupBy(*by).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(bound)).alias("f"))
    own = rows(["lang", "source"]).toDF("_lang", "_source", "n", "f")
    of_lang = rows(["lang"]).toDF("_l", "_ln", "_lf")
    of_all = rows([]).toDF("_an", "_af")
    joined = own.join(of_lang, F.col("_lang").eqNullSafe(F.col("_l")), "left").join(F.broadcast(of_all))
    f = F.when(F.col("n") >= least, F.col("f")).when(F.col("_ln") >= least, F.col("_lf")).otherwise(F.col("_af"))
    return joined.select("_lang", "_source", f.getField("lower").alias("lower"), f.getField("upper").alias("upper"))


def verdict(n_words: Column, n_repeat_words: Column, counts: str = "", lower: str = "lower", upper: str = "upper") -> Column:
    inside = [_ratio(r, counts).between(F.col(lower)[i], F.col(upper)[i]) for i, r in enumerate(RATIOS)]
    ok = ~base_failed(n_words, n_repeat_words)
    for x in inside:
        ok = ok & F.coalesce(x, F.lit(True))
    return ok


@common.tidied
def learned_fences(docs: DataFrame, reach: float = 1.0, least: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    counts = docs.select(common.named(lang).alias("lang"), common.named(source).alias("source"), text_counts(common.named(text)).alias("c")).select("lang", "source", "c.*")
    return common.cut(fences(common.cut(sketches(counts)), reach, least))


@common.tidied
def judge(docs: DataFrame, reach: float = 1.0, least: int = 50, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of every document."""
    counts = common.cut(docs.select(common.named(doc_id).alias("doc_id"), common.named(lang).alias("lang"), common.named(source).alias("source"), text_counts(common.named(text)).alias("c")).select("doc_id", "lang", "source", "c.*"))
    limits = common.cut(fences(common.cut(sketches(counts)), reach, least))
    joined = counts.join(common.small_side(limits, limits.count()), counts["lang"].eqNullSafe(limits["_lang"]) & counts["source"].eqNullSafe(limits["_source"]), "left")
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return joined.select("doc_id", "lang", "source", *[c.split()[0] for c in COUNTS.split(", ")], base_failed(n, r).alias("base_failed"), verdict(n, r).alias("kept"))


@common.tidied
def keep_good(docs: DataFrame, reach: float = 1.0, least: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that pass; texts are counted where they lie and never shuffled: once for the sketches, once for
    the verdict."""
    limits = learned_fences(docs, reach, least, text, lang, source)
    names = [common.fresh(x, docs.columns) for x in ("_lang", "_source", "_lower", "_upper")]
    limits, counts = limits.toDF(*names), common.fresh("_counts", docs.columns)
    counted = docs.withColumn(counts, text_counts(common.named(text)))
    same = common.named(lang).eqNullSafe(F.col(names[0])) & common.named(source).eqNullSafe(F.col(names[1]))
    joined = counted.join(common.small_side(limits, limits.count()), same, "left")
    kept = joined.where(verdict(F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words"), f"{counts}.", *names[2:]))
    return kept.select(*map(common.named, docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same counts, sketches and fences, from the table of ratios above."""
    ratio = lambda r: f"CASE WHEN {r[2]} > 0 THEN {r[1]} * {r[3]} // {r[2]} ELSE 0 END"
    values = " UNION ALL ".join(f"SELECT lang, source, {i} AS rule, {ratio(r)} AS v FROM c WHERE n_words > 0" for i, r in enumerate(RATIOS))
    given = lambda k: "CASE rule " + " ".join(f"WHEN {i} THEN {r[k]}" for i, r in enumerate(RATIOS)) + " END"
    wide = lambda v: f"(CAST(1 AS BIGINT) << greatest(length(bin({v})) - 6, 0))"
    level = lambda name, by: f"""
{name}q AS (SELECT *, sum(n) OVER (PARTITION BY {by} rule ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by} rule) AS total FROM (SELECT {by} rule, b, sum(n) AS n FROM sk GROUP BY {by} rule, b)),
{name}f AS (SELECT *, high + {given(5)} * greatest(high - mid, {wide('high')}) AS hi, CASE WHEN {given(6)} THEN low - {given(5)} * greatest(mid - low, {wide('low')}) ELSE -1 END AS lo FROM (
  SELECT {by} rule, min(total) AS total, min(top) FILTER (upto >= total * (CAST(1 AS DOUBLE) - qh)) AS low, min(top) FILTER (upto >= total * CAST(0.5 AS DOUBLE)) AS mid, min(top) FILTER (upto >= total * qh) AS high
  FROM (SELECT *, CAST({given(4)} AS DOUBLE) AS qh, (((b - greatest(b // 32 - 1, 0) * 32) + 1) << greatest(b // 32 - 1, 0)) - 1 AS top FROM {name}q) GROUP BY {by} rule))"""  # noqa: E731
    same = lambda a, b, c: f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}"
    out = " OR ".join(f"(rule = {i} AND ({ratio(r)} < lo OR {ratio(r)} > hi))" for i, r in enumerate(RATIOS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON r.rid = w.rid),
v AS ({values}),
sk AS (SELECT lang, source, rule, (v >> greatest(length(bin(v)) - 6, 0)) + greatest(length(bin(v)) - 6, 0) * 32 AS b, count(*) AS n FROM v GROUP BY 1, 2, 3, 4),
{level('own', 'lang, source, ')[1:]},{level('lang', 'lang, ')},{level('all', '')},
f AS (SELECT o.lang, o.source, o.rule, CASE WHEN o.total >= 50 THEN o.lo WHEN l.total >= 50 THEN l.lo ELSE a.lo END AS lo, CASE WHEN o.total >= 50 THEN o.hi WHEN l.total >= 50 THEN l.hi ELSE a.hi END AS hi
  FROM ownf o JOIN langf l ON {same('o', 'l', 'lang')} AND l.rule = o.rule JOIN allf a ON a.rule = o.rule),
bad AS (SELECT DISTINCT rid FROM c JOIN f ON {same('c', 'f', 'lang')} AND {same('c', 'f', 'source')} WHERE {out})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND c.rid NOT IN (SELECT rid FROM bad) AS kept FROM c
"""


SQL = _sql()
