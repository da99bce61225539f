"""Benchmark decontamination by spaced seeds.

A mask is a row of token places that count and places that are ignored. The items of a benchmark are hashed under
all masks at all places, training texts under the same masks, and a common hash is a hit even if tokens at
ignored places were substituted. Around each hit the item is laid over the text without shift. Of all runs that agree
in at least `share` of their tokens the one with most agreeing tokens is judged. It counts if it agrees in `least` tokens,
or in `share` of the item's tokens if these are fewer.

The benchmark is the query set: it is sent to the executors in slices of bounded size, each slice against all rows,
so texts are never shuffled and a benchmark of any size needs the same memory a task.

The masks are chosen so that none of these runs is without a hit if share is 0.7 or more and least is 13 or more: a
longer run has a part of 20 to 39 tokens that agrees as much, and tests go through all patterns up to there.

Cases: null and empty texts and items match nothing; items of up to three tokens are hashed as a whole; repeated rows
are judged one by one; an item that matches at several places is reported once with its best run; empty tables give
no rows. Other columns pass through `remove_contaminated` unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .jaccard import _STEP, word_hashes

#: Fixed masks of five places for items of FULL tokens or more and of three places for shorter ones. Each set leaves no
#: gap: whatever tokens are substituted, a run that agrees in 0.7 of its tokens has a hit (runs of 13 and of 4 tokens on).
MASKS = ("101111", "111011", "11001011", "111010001", "1000010111", "111001000001")
SHORT_MASKS = ("111", "1011", "1101")
FULL = 13
LEAST, SHARE = 13, 0.7
#: Items of fewer tokens say too little to condemn a document by: the registered query and the pipeline leave them out.
SHORTEST = 8
SLICE_BYTES = 4 << 20
_TABLE_BITS = np.uint64(20)
FOUND = "array<struct<item_id: long, text_token: long, item_token: long, n_tokens: long, n_matched: long>>"


def masked_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of len(mask) word hashes under the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out += words[j : j + n] * _STEP[j]
    return common.mix64(out)


class Probe:
    """The hashes of one slice of the items: for each mask sorted hashes with item and place, and a table of their first bits."""

    def __init__(self, items: list[tuple[int, bytes]], least: int, share: float):
        self.least, self.share, self.items = least, share, []
        found: dict[str, list] = {}
        for item, text in items:
            words, _ = word_hashes(np.frombuffer(text, np.uint8), 3)
            if not len(words):
                continue
            self.items.append((item, words))
            masks = MASKS if len(words) >= FULL else SHORT_MASKS if len(words) > len(SHORT_MASKS[0]) else ("1" * len(words),)
            for mask in masks:
                hashes = masked_hashes(words, mask)
                found.setdefault(mask, []).append((hashes, np.full(len(hashes), len(self.items) - 1), np.arange(len(hashes))))
        self.masks = {}
        for mask, parts in found.items():
            hashes, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << int(_TABLE_BITS), bool)
            table[hashes >> (np.uint64(64) - _TABLE_BITS)] = True
            self.masks[mask] = (hashes[order], item[order], place[order], table)

    def best_run(self, item: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
        """The run (text token, item token, tokens, agreeing) with most agreeing tokens of those that agree in `share`
        of their tokens, where item[i] lies on text[i + shift]."""
        first, last = max(0, -shift), min(len(item), len(text) - shift)
        same = item[first:last] == text[first + shift : last + shift]
        agreed = np.r_[0, np.cumsum(same)]
        if agreed[-1] < self.needed(len(item)):
            return None
        # From each begin the furthest end that is no lower; the run loses its ends that do not agree.
        over = agreed - self.share * np.arange(len(agreed))
        furthest = np.maximum.accumulate(over[::-1])[::-1]
        end = np.searchsorted(-furthest, 1e-9 - over, side="right") - 1
        begin = int(np.argmax(agreed[end] - agreed))
        agree = int(agreed[end[begin]] - agreed[begin])
        if agree < self.needed(len(item)):
            return None
        inside = begin + np.flatnonzero(same[begin : end[begin]])
        begin, end = int(inside[0]), int(inside[-1]) + 1
        return first + shift + begin, first + begin, end - begin, agree

    def needed(self, n: int) -> int:
        """The least agreeing tokens of an item of n."""
        return max(1, min(self.least, math.ceil(self.share * n - 1e-9)))

    def search(self, column: pa.Array) -> list[list[dict]]:
        """For each text the items that overlap with it."""
        data, offsets = common.binary_column(column)
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for first, last in common.pieces(offsets, 1 << 20):
            base = offsets[first]
            ends = offsets[first + 1 : last + 1] - base
            joined = np.insert(data[base : offsets[last]], ends, 32)
            words, start = word_hashes(joined, 3)
            bounds = np.r_[0, np.searchsorted(start, ends + np.arange(1, last - first + 1))]
            hits = set()
            for mask, (hashes, item, place, table) in self.masks.items():
                own = masked_hashes(words, mask)
                near = np.flatnonzero(table[own >> (np.uint64(64) - _TABLE_BITS)])
                low, high = np.searchsorted(hashes, own[near]), np.searchsorted(hashes, own[near], side="right")
                near, low, high = near[high > low], low[high > low], high[high > low]
                text = np.searchsorted(bounds, near, side="right") - 1
                inside = near + len(mask) <= bounds[text + 1]
                near, text, low, n = near[inside], text[inside], low[inside], (high - low)[inside]
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                hits.update(zip(np.repeat(text, n).tolist(), item[at].tolist(), (np.repeat(near - bounds[text], n) - place[at]).tolist(), strict=True))
            best: dict[tuple[int, int], tuple] = {}
            for t, i, shift in sorted(hits):
                run = self.best_run(self.items[i][1], words[bounds[t] : bounds[t + 1]], shift)
                if run and (best.get((t, i)) is None or run[3] > best[t, i][3]):
                    best[t, i] = run
            for (t, i), run in best.items():
                out[first + t].append({"item_id": self.items[i][0], "text_token": run[0], "item_token": run[1], "n_tokens": run[2], "n_matched": run[3]})
        return out


def item_slices(benchmark: DataFrame, item_id: str, text: str, slice_bytes: int, shortest: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in slices of about slice_bytes, dealt by hash of the id."""
    long_enough = common.word_count(common.named(text)) >= shortest
    items = benchmark.where(long_enough).select(common.named(item_id).cast("long").alias("i"), common.named(text).cast("binary").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-int(total) // slice_bytes))
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k)
        yield [(r.i, bytes(r.t)) for r in part.orderBy("i").collect()]


def _searcher(shared, least: int, share: float):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        probe = Probe(shared.value, least, share)
        for batch in texts:
            yield pd.Series(probe.search(pa.array(batch, pa.large_binary())), dtype=object)

    return run


def overlap_column(docs: DataFrame, text: Column, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES, shortest: int = 1) -> Column:
    """For each text the overlapping items of at least `shortest` tokens, as an array; one Python pass for each slice of
    the benchmark."""
    context = docs.sparkSession.sparkContext
    found = []
    for items in item_slices(benchmark, item_id, item_text, slice_bytes, shortest):
        found.append(F.pandas_udf(_searcher(context.broadcast(items), least, share), FOUND)(F.coalesce(text, F.lit("")).cast("binary")))
    return F.concat(*found) if len(found) > 1 else found[0]


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """doc_id, item_id, text_token, item_token, n_tokens, n_matched: one row for each text and item that overlap."""
    column = overlap_column(docs, common.named(text), benchmark, **rule)
    return docs.select(common.named(doc_id).alias("doc_id"), column.alias("_found")).select("doc_id", F.inline("_found"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **rule) -> DataFrame:
    """The rows of docs whose text overlaps with no item."""
    return docs.where(F.size(overlap_column(docs, common.named(text), benchmark, **rule)) == 0)


def query(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=SHORTEST)
