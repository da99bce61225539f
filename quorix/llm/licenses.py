"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths
(DataFrame functions only).

The sentences of a text that carry a licence cue are its headers. Headers and templates are vectors of terms,
weighted by frequency and by how few headers of the whole table have the term; the template of the largest cosine
names the licence if it reaches `least`. Files with a cue or the name of a licence file are compared as a whole with the
texts of licences in the same way; `least_whole` decides. Files that are a licence's text, that have a licence file's name and a
licence, or whose headers are at least half of their words are licence files, and name the licence of their directory. A file without a header of its own inherits from the nearest directory above it
that has one: its ancestors are joined to the licensed directories by path.

Only template terms can add to a dot product and their number is fixed, so that table is broadcast; the norm of
a header is a sum over all its terms, each with its count over the headers of the whole table. Ancestors join by the directory of files, grouped before, so a directory with a
third of all files is one row there.

Cases: null texts and paths have no licence; equal cosines go to the first template by name; several licence files
in one directory: the one with the largest cosine, then the first path; repeated rows get one row each; empty
tables give no rows. Of the input only the id, path and text columns are used.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Names of licences and the sentences that grant them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
)
CUE = r"(?i)licen[sc]e|\bspdx\b|redistribution and use|permission is hereby granted"
#: Names of licence files.
NAME = r"(?i)(^|/)(un)?(licen[sc]es?|copying)([._-][^/]*)?$"
#: Terms of so many headers at least, and of a 20,000th of all counts, are joined by broadcast.
FREQUENT = 100
_SENTENCE = r"\n|(?<=[.!?])\s+"
_TERM = r"[a-z0-9][a-z0-9+-]*(?:\.[0-9]+)*"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Names and whole texts of licences, as they lie beside this file."""
    return tuple((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def headers(files: DataFrame) -> DataFrame:
    """(_row, header number, header) of the sentences with a cue."""
    sentences = F.filter(F.split("text", _SENTENCE), lambda s: s.rlike(CUE))
    return files.where(F.col("text").rlike(CUE)).select("_row", F.posexplode(sentences).alias("no", "header"))


def template_terms(spark, templates: tuple = TEMPLATES) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    return table.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def match_headers(found: DataFrame, against: tuple = TEMPLATES) -> DataFrame:
    """headers (or whole texts) -> (_row, no, n_words, license, cosine) of each header's best template."""
    spark = found.sparkSession
    found = common.cut(found)
    total = found.count()
    # Words are counted before the terms become rows; above them, each row would split its whole text again.
    sized = found.select("_row", "no", F.size(F.split(F.trim("header"), r"\s+")).alias("n_words"), _terms(F.col("header")).alias("terms"))
    terms = sized.select("_row", "no", "n_words", F.explode("terms").alias("term"))
    counted = terms.groupBy("_row", "no", "n_words", "term").agg(F.count("*").alias("tf"))
    known = common.cut(counted.groupBy("term").agg(F.count("*").alias("df")))
    templates = template_terms(spark, against)
    ours = known.join(F.broadcast(templates.select("term").distinct()), "term", "left_semi")
    idf = lambda df: F.log(F.lit(1.0) + F.lit(float(total + 1)) / (F.lit(1.0) + df))
    weights = common.cut(templates.join(ours, "term", "left").withColumn("w", F.col("tf") * idf(F.coalesce("df", F.lit(0)))))
    norms = weights.groupBy("template", "license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = weights.join(norms, ["template", "license"]).select("template", "license", "term", (F.col("w") / F.col("norm")).alias("tw"))
    by_term = weights.groupBy("term").agg(F.collect_list(F.struct("template", "license", "tw")).alias("t"))
    # Frequent terms are few, as their counts add up to the rows, and are broadcast with the templates' terms; all
    # others are joined by term, where no term has many rows. Rows that need no such join get a key of their own.
    often = max(FREQUENT, (known.agg(F.sum("df")).first()[0] or 0) // 20_000)
    near = by_term.join(known.where(F.col("df") >= often), "term", "full").select("term", "t").join(known, "term", "left")
    met = counted.join(F.broadcast(near.withColumnRenamed("df", "_df")), "term", "left")
    met = met.withColumn("_key", F.when(F.col("_df").isNull(), F.col("term")).otherwise(F.concat_ws("\0", F.lit(""), "_row", "term")))
    rare = known.where(F.col("df") < often).toDF("_key", "df")
    weighed = met.join(rare, "_key", "left").withColumn("w", F.col("tf") * idf(F.coalesce("_df", "df")))
    length = weighed.groupBy("_row", "no", "n_words").agg(F.sum(F.col("w") * F.col("w")).alias("sq"), F.flatten(F.collect_list(F.transform("t", lambda t: F.struct(t["template"].alias("template"), t["license"].alias("license"), (t["tw"] * F.col("w")).alias("x"))))).alias("dots"))
    # A header has as many products as it has template terms; they are summed by template inside the row.
    dot = lambda i: F.aggregate(F.filter("dots", lambda d: d["template"] == i), F.lit(0.0), lambda a, d: a + d["x"])
    best = F.array_max(F.array(*[F.struct(F.round(dot(i) / F.sqrt("sq"), 9).alias("cosine"), F.lit(-i).alias("i"), F.lit(name).alias("license")) for i, (name, _) in enumerate(against)]))
    return length.select("_row", "no", "n_words", best.alias("b")).select("_row", "no", "n_words", "b.license", "b.cosine")


def scan(files: DataFrame, least: float = 0.6, least_whole: float = 0.8, file_id: str = "file_id", path: str = "path", text: str = "text") -> DataFrame:
    """file_id, path, own_license, cosine, license and license_dir (where it comes from; null: own or none)."""
    picked = files.select(common.named(file_id).alias("file_id"), common.named(path).alias("path"), common.named(text).alias("text"))
    picked = picked.withColumn("_row", F.xxhash64("file_id", "path", "text"))
    # Texts without a cue never leave the task that reads them.
    candidates = common.cut(picked.where(F.col("text").rlike(CUE) | F.col("path").rlike(NAME)).select("_row", "path", "text").dropDuplicates(["_row"]))
    matched = match_headers(headers(candidates)).where(F.col("cosine") >= least)
    whole = match_headers(candidates.select("_row", F.lit(0).alias("no"), F.col("text").alias("header")), full_texts()).where(F.col("cosine") >= least_whole)
    whole = whole.select("_row", F.col("license").alias("whole"), F.col("cosine").alias("whole_cosine"))
    own = matched.groupBy("_row").agg(F.max(F.struct("cosine", (-F.col("no")).alias("no"), "license")).alias("b"), F.sum("n_words").alias("header_words"))
    own = own.select("_row", "b.license", "b.cosine", "header_words").join(whole, "_row", "full")
    own = own.select("_row", F.coalesce("whole", "license").alias("license"), F.coalesce("whole_cosine", "cosine").alias("cosine"), "header_words", F.col("whole").isNotNull().alias("is_text"))
    named = picked.select("_row", "file_id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), common.word_count(F.col("text")).alias("n_words"))
    judged = common.cut(named.join(own, "_row", "left"))
    is_file = F.col("is_text") | F.col("path").rlike(NAME) | (2 * F.col("header_words") >= F.col("n_words"))
    of_dir = judged.where("license is not null and path is not null").where(is_file).groupBy("dir").agg(
        F.min_by("license", F.struct(-F.col("cosine"), "path")).alias("dir_license"))
    dirs = judged.where("license is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    lineage = dirs.select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = lineage.join(of_dir.toDF("up", "dir_license"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "dir_license"), F.length("up")).alias("near"))
    nearest = common.cut(nearest.select(F.col("dir").alias("_dir"), "near.up", "near.dir_license"))
    inherits = F.col("license").isNull() & (F.col("dir") == F.col("_dir"))
    out = judged.join(common.small_side(nearest, nearest.count()), inherits, "left")
    return out.select("file_id", "path", F.col("license").alias("own_license"), "cosine", F.coalesce("license", "dir_license").alias("license"), F.when(F.col("license").isNull(), F.col("up")).alias("license_dir"))


def query(spark, sf_dir: str) -> DataFrame:
    """The documents as files: source/language/hundreds of the id/id.txt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hundred = F.expr("cast(doc_id div 100 as string)")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", path.alias("path"), "text"), file_id="doc_id").withColumnRenamed("file_id", "doc_id")
