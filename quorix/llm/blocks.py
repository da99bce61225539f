"""Blocks of documents and the packed messages that they exchange with hash buckets.

Rows of single hashes would cost a row's overhead each, so a block sends each bucket one row with all its hashes,
sorted and packed, and a bucket answers each block with one row in the same order. A bucket is a range of the
hash. There are never more messages than hashes, and a key that a block has a million times is in one of them once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAIL = "q int, p int, n int, blob binary"
_MAIL = pa.schema([("q", pa.int32()), ("p", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])


def mail(rows: list[tuple]) -> pa.Table:
    """Messages (bucket, block, number of entries, bytes) as an Arrow table."""
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MAIL, strict=True)], schema=_MAIL)


def planes(values: np.ndarray, width: int) -> bytes:
    """The high `width` bytes of sorted hashes, one plane after the other, which packs well."""
    return np.ascontiguousarray(values.byteswap().view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(blob: bytes, n: int, width: int) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width).reshape(width, n).T
    return raw.view(np.uint64).ravel().byteswap()


def bucket_slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, without empty ones."""
    if not len(keys):
        return []
    cuts = np.searchsorted(keys, np.array([(q << 64) // buckets for q in range(1, buckets)], np.uint64))
    return [(q, int(a), int(b)) for q, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)) if b > a]


def deal(docs: DataFrame, doc_id: str, text: str, block_bytes: int = 8 << 20, name: str = "_p") -> tuple[DataFrame, int]:
    """docs with their block in column `name`, and the number of blocks. Id and text decide, so rows of one id, or
    without one, spread over the blocks."""
    blocks = common.blocks_for(common.text_bytes(docs, text), docs.sparkSession, block_bytes)
    key = F.xxhash64(F.col(doc_id).cast("long"), F.col(text))
    return docs.withColumn(name, F.pmod(key, F.lit(blocks)).cast("int")), blocks


def in_order(table: pa.Table, doc_id: str, text: str) -> tuple[pa.Table, np.ndarray]:
    """The rows by id, equal ids by text, null ids last, and the ids (nulls as the largest number)."""
    ids = table[doc_id].cast(pa.int64())
    ids = (ids.fill_null(np.iinfo(np.int64).max) if ids.null_count else ids).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        texts = table[text].to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], (texts[i] or "").encode())), np.int64)
    return table.take(pa.array(order)), ids[order].astype(np.int64)
