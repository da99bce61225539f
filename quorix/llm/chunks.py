"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text and cuts where it is small, so an insertion moves the cuts near it
and no others. The chunks' digests are compared over the whole table: documents lie in blocks, a block sends its
distinct digests with their first document to hash buckets, and a bucket answers which of them an earlier document
has. A chunk that appeared earlier (smaller id, or same text further left) is a repeat. Runs of repeats of `least_run`
bytes or more are removed, and runs that are a whole text, so of exact copies one stays, however short; shorter runs
are phrases that texts share by chance. A very common chunk is one row of a block however often it appears.

Chunks are equal if their 128-bit blake2b digests are.

Cases: null text has no chunks; equal ids count in the order of a hash of their text, then of the text; null ids come after all others; a text
shorter than the least chunk is one chunk; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .blocks import MAIL, bucket_slices, deal, in_order, mail, planes, unplanes

LEAST, MEAN_REST, MOST = 32, 32, 512
#: A chunk's mean length; a run of repeats must have it, or be the whole text.
LEAST_RUN = LEAST + MEAN_REST
_GEAR = (common.byte_table(77) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < 32 of gear[data[i - j]] << j, by five doubling steps."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        later = h.copy()
        later[k:] += h[:-k] << np.uint32(k)
        h = later
    return h


def cut_text(marks: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of a text in start..end: the marks at least LEAST apart, and every MOST bytes between."""
    out, last = [], start
    for mark in marks:
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark - last >= LEAST and mark < end:
            out.append(mark)
            last = mark
    while end - last > MOST:
        last += MOST
        out.append(last)
    if end > last:
        out.append(end)
    return out


class Chunks:
    """The chunks of a block of documents in order of id."""

    def __init__(self, table: pa.Table, doc_id: str, text: str):
        self.table, self.ids = in_order(table, doc_id, text)
        self.data, self.offsets = common.binary_column(self.table[text])
        first, last, digest = [], [], []
        for a, b in common.pieces(self.offsets, 1 << 20):
            base, end = int(self.offsets[a]), int(self.offsets[b])
            part = self.data[base:end]
            if not len(part):
                continue
            marks = np.flatnonzero(gear_hash(part) < np.uint32((1 << 32) // MEAN_REST)) + 1 + base
            bounds = self.offsets[a : b + 1]
            at = np.searchsorted(marks, bounds)
            marks = marks.tolist()
            ends, begins = [], []
            for i in range(b - a):
                own = cut_text(marks[at[i] : at[i + 1]], int(bounds[i]), int(bounds[i + 1]))
                if own:
                    ends += own
                    begins += [int(bounds[i]), *own[:-1]]
            begins, ends = np.array(begins, np.int64), np.array(ends, np.int64)
            first.append(begins)
            last.append(ends)
            digest.append(common.digests(part, begins - base, ends - base))
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.first, self.last = join(first, np.int64), join(last, np.int64)
        digests = np.concatenate(digest) if digest else np.empty((0, 2), np.uint64)
        # Distinct digests in order, each with its first chunk; most are told apart by their first half.
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        ranked = digests[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        self.distinct, self.at = ranked[new], order[new]
        self.back = np.empty(len(order), np.int64)
        self.back[order] = np.cumsum(new) - 1

    def names(self, buckets: int) -> list[tuple[int, int, bytes]]:
        doc = self.ids[np.searchsorted(self.offsets, self.first[self.at], side="right") - 1] if len(self.at) else self.at
        return [(q, b - a, planes(self.distinct[a:b, 0], 8) + self.distinct[a:b, 1].tobytes() + doc[a:b].tobytes()) for q, a, b in bucket_slices(self.distinct[:, 0], buckets)]

    def repeats(self, codes: np.ndarray) -> np.ndarray:
        """Whether each chunk appeared earlier."""
        again = np.ones(len(self.first), bool)
        again[self.at] = False
        return again | codes[self.back].astype(bool) if len(codes) else again


def _compare(table: pa.Table) -> pa.Table:
    """Digests of all blocks for one bucket -> for each whether a block with an earlier document has it."""
    q, p, n, blobs = (table[c].to_pylist() for c in ("q", "p", "n", "blob"))
    digest = np.concatenate([unplanes(b, k, 8) for b, k in zip(blobs, n, strict=True)])
    rest = np.concatenate([np.frombuffer(b, np.uint64, k, 8 * k) for b, k in zip(blobs, n, strict=True)])
    doc = np.concatenate([np.frombuffer(b, np.int64, k, 16 * k) for b, k in zip(blobs, n, strict=True)])
    order = np.lexsort((np.repeat(np.array(p), n), doc, rest, digest))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (rest[order[1:]] == rest[order[:-1]])
    return mail([(a, b, k, np.packbits(x).tobytes()) for a, b, k, x in zip(q, p, n, np.split(later, np.cumsum(n)[:-1]), strict=True)])


def _finish(chunks: Chunks, codes: np.ndarray, least_run: int) -> pa.Table:
    again = chunks.repeats(codes)
    rows = []
    upto = np.searchsorted(chunks.first, chunks.offsets)
    for i in range(len(chunks.ids)):
        a, b = upto[i], upto[i + 1]
        edges = np.flatnonzero(np.diff(np.r_[False, again[a:b], False]))
        spans = [(int(chunks.first[a + x]), int(chunks.last[a + y - 1])) for x, y in zip(edges[::2], edges[1::2], strict=True)]
        start, end = int(chunks.offsets[i]), int(chunks.offsets[i + 1])
        spans = [s for s in spans if s[1] - s[0] >= least_run or s == (start, end)]
        kept, at = hashlib.sha256(), start
        for x, y in spans:
            kept.update(chunks.data[at:x].tobytes())
            at = y
        kept.update(chunks.data[at:end].tobytes())
        rows.append((end - start, int(b - a), int(again[a:b].sum()), sum(y - x for x, y in spans), [{"start": x - start, "end": y - start} for x, y in spans], kept.hexdigest()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * 4 + [span, pa.string()]
    return pa.table([pa.array(chunks.ids if not chunks.table[0].null_count else chunks.table[0].cast(pa.int64()).to_pylist(), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_chunks", "n_dup_chunks", "n_removed", "spans", "kept_sha256"])


def dedup(docs: DataFrame, least_run: int = LEAST_RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_dup_chunks, n_removed, spans (removed, in bytes) and kept_sha256 of every row."""
    dealt, blocks = deal(docs.select(common.named(doc_id).alias("doc_id"), common.named(text).alias("text")), "doc_id", "text")

    def build(table):
        return Chunks(table.drop_columns(["_p"]), "doc_id", "text")

    def say(key, table):
        return mail([(q, key[0].as_py(), n, blob) for q, n, blob in build(table).names(blocks)])

    def finish(key, table, answers):
        got = sorted(zip(answers["q"].to_pylist(), answers["n"].to_pylist(), answers["blob"].to_pylist(), strict=True))
        codes = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in got]) if got else np.empty(0, np.uint8)
        return _finish(build(table), codes, least_run)

    # One plan: the documents are shuffled into blocks once and read from there twice.
    answers = dealt.groupBy("_p").applyInArrow(say, MAIL).groupBy("q").applyInArrow(lambda key, table: _compare(table), MAIL)
    schema = "doc_id long, n_bytes long, n_chunks long, n_dup_chunks long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    return dealt.groupBy("_p").cogroup(answers.groupBy("p")).applyInArrow(finish, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
