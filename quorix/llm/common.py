"""What the text operators share: word rule, shared folder, hashing of byte strings, document blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.session import new_folder, shared_dir

#: Words are maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The six bytes that end a word.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def fresh(wanted: str, columns: list[str]) -> str:
    """`wanted`, with underscores in front until no column is called that."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def named(column: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


#: Lets Spark delete a query's shuffle files when it ends; else they stay until the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned in here leave no shuffle files behind."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def tidied(operator):
    """An operator of which no query on the way to its result leaves shuffle files behind."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        with tidy(docs.sparkSession):
            out = operator(docs, *args, **how)
        return out.select("*")

    return run


#: Rows a task of tables whose rows are counted and a few numbers wide.
FEW = 20_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Reliable checkpoint in the shared folder: later plans read it instead of computing df again. With the number of
    rows, in no more tasks and files than these need."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        df = df.select("*") if rows is None else df.coalesce(max(1, -(-rows // FEW)))
        return df.checkpoint(eager=True)


def table(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: smaller than a checkpoint."""
    path = new_folder(df.sparkSession, what)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame, what: str) -> None:
    """Deletes the folders of table(..., what) that df reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if f"/quorix-{what}-" in f}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int, most: int = 50_000) -> DataFrame:
    """Marks df for broadcasting if its counted rows are within `most`; else the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(total_bytes: int, spark: SparkSession, block_bytes: int = 24 << 20) -> int:
    """How many blocks of documents: as many as shuffle partitions, more if a block would outgrow block_bytes."""
    return max(1, n_partitions(spark), -(-int(total_bytes) // block_bytes))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(named(text)))).first()[0] or 0


# --- hashing of byte strings with numpy -------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random odd words, one for each byte value."""
    base = np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1)
    return mix64(base * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: Strings of more bytes than this are hashed one by one.
_LANES = 64


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, without a copy; data ends with 8 bytes to spare."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data.data, strides=(1,))


_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of bounds: 8 bytes at a time, each folded in by a multiplication and
    a full mix, so that no arrangement of the bytes cancels out; long strings by blake2b."""
    size = (end - start).astype(np.int64)
    out = mix64(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
    lanes = _lanes(np.concatenate([data, np.zeros(8, np.uint8)]))
    rows = np.flatnonzero(size <= 8 * _LANES)
    for j in range(int(-(-size[rows].max() // 8)) if len(rows) else 0):
        if j:
            rows = rows[size[rows] > 8 * j]
        lane = lanes[start[rows] + 8 * j] & _LANE_MASK[np.minimum(size[rows] - 8 * j, 8)]
        out[rows] = mix64((out[rows] ^ lane) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA24BAED4963EE407))
    for i in np.flatnonzero(size > 8 * _LANES).tolist():
        name = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=str(seed).encode()).digest()
        out[i] = np.frombuffer(name, np.uint64)[0]
    return out


def same_strings(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] agree in every byte, for arrays of places."""
    out = np.ones(len(a), bool)
    lanes = _lanes(np.concatenate([data, np.zeros(8, np.uint8)]))
    rows, j = np.flatnonzero((size > 0) & (a != b)), 0
    while len(rows):
        mask = _LANE_MASK[np.minimum(size[rows] - 8 * j, 8)]
        same = ((lanes[a[rows] + 8 * j] ^ lanes[b[rows] + 8 * j]) & mask) == 0
        out[rows[~same]] = False
        j += 1
        rows = rows[same & (size[rows] > 8 * j)]
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit blake2b digests of data[start:end], as rows of two numbers: equality of these counts as equality."""
    raw, blake = data.tobytes(), hashlib.blake2b
    names = [blake(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)


class RollingHash:
    """Polynomial hash modulo 2**64 of every substring of a buffer, from prefix sums.

    hash(i, j) depends on the bytes i..j-1 alone: sum of table[byte] * P**(j-1-k), mixed. Different strings can be made
    to agree, so it deals strings to places and never decides that two are equal.
    """

    def __init__(self, seed: int = 1, multiplier: int = 0xD6E8FEB86659FD93):
        self.table, self.p, self.inv = byte_table(seed), multiplier | 1, pow(multiplier | 1, -1, 1 << 64)
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    @staticmethod
    def _grown(base: int, now: np.ndarray, n: int) -> np.ndarray:
        while len(now) < n:
            step = np.uint64(pow(base, len(now), 1 << 64))
            now = np.concatenate([now, now * step])
        return now

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """S with S[i] = sum over k < i of table[data[k]] * P**k."""
        n = len(data)
        self._powers = self._grown(self.p, self._powers, n + 1)
        self._inverse = self._grown(self.inv, self._inverse, n + 1)
        out = np.empty(n + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.table[data] * self._powers[:n], out=out[1:])
        return out

    def substrings(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end] for arrays of bounds."""
        return mix64((prefix[end] - prefix[start]) * self._inverse[start])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all substrings of the given width."""
        n = len(prefix) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix64((prefix[width:] - prefix[:n]) * self._inverse[:n])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    edge = np.empty(len(data) + 2, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = _IS_SPACE[data]
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    return turn[::2], turn[1::2]


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose bytes stay near `most`; a row is never split."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out
