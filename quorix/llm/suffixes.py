"""Substring dedup by blockwise suffix sorting with a difference cover.

Every string of `length` bytes that also starts earlier (smaller id, or same document and earlier start) is
removed with all bytes that it covers. Suffixes are judged by their first `length` bytes, so a suffix is a window.

Buckets. The suffixes are dealt to buckets by content: a window belongs to the bucket of its smallest k-gram hash,
so equal windows meet, and neighbouring windows with the same smallest k-gram travel as one segment. Documents lie in
blocks. A block first names its distinct segments by digest; the bucket answers which k-grams occur elsewhere,
which segments are wholly repeats of an earlier block's, and which k-grams have segments that differ. Only these are
sent as bytes, and their windows are suffix-sorted in the bucket. k-grams with very many differing segments (the
borders of a very common passage) are dealt again by window, so that no group meets in one task.

Sorting a bucket. The positions of the bucket's text whose remainder lies in a difference cover modulo 31 get ranks by
two doubling steps. The suffixes are sorted one block at a time by 32 bytes; longer ties are resolved against a
leader by the ranks at the shift that brings both into the cover, then by the bytes behind. Memory is a block's
suffixes, the cover's ranks and the bucket's text. Two windows of the sort are equal only if all their bytes are; whole
segments, of which only one copy is sorted, by their 128-bit blake2b digest.

Cases: null text has no bytes; matches never cross documents; rows with equal id count in the order of a
hash of their text, then of the text; null ids come after all others; texts under `length` bytes stay whole; an empty table gives no rows. Other
columns pass through `remove_repeats` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .blocks import MAIL, bucket_slices, deal, in_order, mail, planes, unplanes

#: A perfect difference set modulo 31.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
TIE, DEPTH = 32, 62  # bytes sorted at first; bytes that a rank stands for
GRAM = 28
HOT_SEGMENTS = 1000
H_BYTES = 6
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)
_PIECE = 1 << 19
_LONGEST = 4 << 20


def _shift_table() -> np.ndarray:
    """For each pair of remainders the least shift from TIE - MODULUS + 1 on that brings both into the cover."""
    table = np.full((MODULUS, MODULUS), -1, np.int64)
    for shift in range(TIE, TIE - MODULUS, -1):
        hit = np.isin((np.arange(MODULUS) + shift) % MODULUS, COVER)
        table[np.ix_(hit, hit)] = shift
    return table


_SHIFT = _shift_table()
_SLOT = np.full(MODULUS, -1, np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, without a copy."""
    return np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))


def _names(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows given by keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def cover_ranks(text: np.ndarray) -> np.ndarray:
    """Ranks by DEPTH bytes of the cover's positions: position p is at (p // MODULUS) * len(COVER) + slot."""
    words = _words(text)
    rows = max(0, (len(text) - DEPTH - 8) // MODULUS)
    at = (np.arange(rows)[:, None] * MODULUS + np.array(COVER)).ravel()
    names = _names([words[at + d].astype(np.uint64) for d in (0, 8, 16, 23)])
    later = np.minimum(np.arange(len(at)) + len(COVER), max(0, len(at) - 1))
    return _names([names, names[later]])


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int, block: int = 1 << 17) -> np.ndarray:
    """A number for each window text[s:s+length], the same for equal windows; length is at least DEPTH + TIE."""
    n = len(starts)
    classes = np.full(n, -1, np.int32)
    if not n:
        return classes
    text = np.concatenate([text, np.zeros(4 * MODULUS + DEPTH, np.uint8)])
    words, ranks = _words(text), cover_ranks(text)
    tail = [*range(TIE + TIE, length - 8, 8), length - 8]
    first = words[starts].astype(np.uint64)
    order = np.argsort(first).astype(np.int32)
    first = first[order]
    borders = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    at, made = 0, 0
    while at < n:
        # One block of suffixes: whole groups of equal first bytes.
        k = int(np.searchsorted(borders, at + block))
        end = int(borders[k]) if k < len(borders) else n
        own = order[at:end]
        keys = [first[at:end]] + [words[starts[own] + d].astype(np.uint64) for d in range(8, TIE, 8)]
        at = end
        group = _names(keys)
        turn = np.argsort(group, kind="stable")
        own, group = own[turn], group[turn]
        while len(own):
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[edge, len(own)])
            lead_of = np.repeat(own[edge + size // 2], size)
            a, b = starts[own], starts[lead_of]
            shift = _SHIFT[a % MODULUS, b % MODULUS]
            pa_, pb = a + shift, b + shift
            ra = ranks[pa_ // MODULUS * len(COVER) + _SLOT[pa_ % MODULUS]]
            rb = ranks[pb // MODULUS * len(COVER) + _SLOT[pb % MODULUS]]
            sign = np.sign(ra - rb)
            for d in tail:
                open_ = np.flatnonzero(sign == 0)
                if not len(open_):
                    break
                x, y = words[a[open_] + d].astype(np.uint64), words[b[open_] + d].astype(np.uint64)
                sign[open_] = (x > y).astype(np.int64) - (x < y)
            same = sign == 0
            classes[own[same]] = made + np.repeat(np.arange(len(edge)), size)[same]
            made += len(edge)
            rest = ~same
            key = group[rest] * 2 + (sign[rest] > 0)
            own = own[rest]
            turn = np.argsort(key, kind="stable")
            own = own[turn]
            group = np.cumsum(np.r_[False, np.diff(key[turn]) != 0]) if len(own) else own
    return classes


# --- segments of a block ------------------------------------------------------------------------


def _least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` k-grams the position of the smallest, the first of equals; from 40 bits of hash."""
    keyed = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=np.uint64)
    span, now = 1, keyed
    while span * 2 <= width:
        now = np.minimum(now[: len(now) - span], now[span:])
        span *= 2
    n = len(keyed) - width + 1
    return (np.minimum(now[:n], now[width - span : width - span + n]) & _POS_MASK).astype(np.int64)


class Block:
    """Documents in order of id, their bytes, and their segments sorted by (gram, digest, place)."""

    def __init__(self, table: pa.Table, id_name: str, text_name: str, length: int):
        self.length = length
        self.table, self.ids = in_order(table, id_name, text_name)
        self.data, self.offsets = common.binary_column(self.table[text_name])
        found = [self._segments(*p) for p in self._pieces()]
        a, n, h = (np.concatenate(c) if found else np.empty(0, t) for c, t in zip(zip(*found, strict=True) if found else ((),) * 3, (np.int64, np.int64, np.uint64), strict=True))
        d = common.digests(self.data, a, a + n + length - 1)
        order = np.lexsort((a, d[:, 1], d[:, 0], h))
        self.start, self.count, self.gram, self.digest = a[order], n[order], h[order], d[order]
        m = len(order)
        self.new_gram = np.ones(m, bool)
        self.new_gram[1:] = self.gram[1:] != self.gram[:-1]
        self.new_class = self.new_gram.copy()
        self.new_class[1:] |= (self.digest[1:] != self.digest[:-1]).any(axis=1)
        self.gram_first = np.flatnonzero(self.new_gram)
        self.gram_no = np.cumsum(self.new_gram) - 1

    def _pieces(self) -> Iterator[tuple[int, int]]:
        for first, last in common.pieces(self.offsets, _PIECE):
            start, end = int(self.offsets[first]), int(self.offsets[last])
            for at in range(start, end, _LONGEST):
                yield at, min(end, at + _LONGEST + self.length - 1)

    def _segments(self, start: int, end: int) -> tuple[np.ndarray, ...]:
        """Runs of windows inside documents whose smallest k-gram is the same one: start, count, gram."""
        part, length = self.data[start:end], self.length
        n = len(part) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = _GRAMS.windows(_GRAMS.prefix(part), GRAM)
        at = _least_grams(grams, length - GRAM + 1)[:n]
        inside = np.ones(n, bool)
        for end_of in self.offsets[np.searchsorted(self.offsets, start, "right") : np.searchsorted(self.offsets, end)] - start:
            inside[max(0, end_of - length + 1) : end_of] = False
        new = np.ones(n, bool)
        new[1:] = at[1:] != at[:-1]
        new[1:] |= ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.flatnonzero(np.r_[(new | ~inside)[1:], True] & inside) + 1
        # Smallest hashes are small numbers; mixed again they spread over the buckets.
        return first + start, stop - first, common.mix64(grams[at[first]])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    # what the block sends and reads

    def names(self, buckets: int) -> list[tuple[int, int, bytes]]:
        """For each bucket the grams of the block, with digest, first document and number of differing segments."""
        if not len(self.start):
            return []
        gram = self.gram[self.gram_first]
        variants = np.minimum(np.add.reduceat(self.new_class.astype(np.int64), self.gram_first), 0xFFFF).astype(np.uint16)
        least = np.minimum.reduceat(self.start, self.gram_first)
        doc = self.ids[self.doc_of(least)]
        digest = self.digest[self.gram_first]
        return [(q, b - a, planes(gram[a:b], H_BYTES) + variants[a:b].tobytes() + digest[a:b].tobytes() + doc[a:b].tobytes()) for q, a, b in bucket_slices(gram, buckets)]

    def items(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What goes to the sort: key, start, count of each item; and for windows of hot grams their item and place."""
        code = codes[self.gram_no]
        cold = np.flatnonzero(self.new_class & (code == 2))
        hot = np.flatnonzero(self.new_class & (code == 3))
        counts = self.count[hot]
        place = np.repeat(self.start[hot] - np.r_[0, np.cumsum(counts)[:-1]] if len(hot) else counts, counts) + np.arange(int(counts.sum()))
        key = np.empty(0, np.uint64)
        if len(place):
            key = _hash_windows(self.data, place, self.length)
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        # Windows count as the same here only if their bytes are; others of one hash are sent side by side.
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        twin = np.flatnonzero(~new)
        new[twin] = ~common.same_strings(self.data, place[twin - 1], place[twin], np.full(len(twin), self.length))
        keys = np.concatenate([self.gram[cold], key[new]])
        starts = np.concatenate([self.start[cold], place[new]])
        sizes = np.concatenate([self.count[cold], np.ones(int(new.sum()), np.int64)])
        order = np.argsort(keys, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        window_item = back[len(cold) + np.cumsum(new) - 1] if len(key) else np.empty(0, np.int64)
        return keys[order], starts[order], sizes[order], place, window_item

    def parcels(self, codes: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
        keys, starts, sizes, _, _ = self.items(codes)
        out = []
        for q, a, b in bucket_slices(keys, buckets):
            s, n = starts[a:b], sizes[a:b]
            doc = self.doc_of(s)
            width = n + self.length - 1
            take = np.repeat(s - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(int(width.sum()))
            out.append((q, b - a, self.ids[doc].tobytes() + (s - self.offsets[doc]).tobytes() + n.astype(np.int32).tobytes() + self.data[take].tobytes()))
        return out

    def removed(self, codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """For each byte whether it goes; flags: of all windows sent, whether they start earlier elsewhere."""
        keys, starts, sizes, place, window_item = self.items(codes)
        cover = np.zeros(len(self.data) + 1, np.int32)
        code = codes[self.gram_no] if len(self.gram_no) else np.empty(0, np.uint8)
        whole = np.flatnonzero(~self.new_class | (code == 1))
        np.add.at(cover, self.start[whole], 1)
        np.add.at(cover, self.start[whole] + self.count[whole] + self.length - 1, -1)
        if len(starts):
            windows = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
            again = windows[flags[: len(windows)]]
            # A window of a hot gram that the block has at an earlier place is a repeat too.
            later = place[place != starts[window_item]] if len(place) else place
            for at in (again, later):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + self.length, -1)
        return np.cumsum(cover[:-1]) > 0


_GRAMS = common.RollingHash(seed=4)


def _hash_windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(at), np.uint64)
    for first in range(0, len(at), 1 << 16):
        rows = data[at[first : first + (1 << 16), None] + np.arange(length)]
        words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -length % 8)))).view(np.uint64)
        total = np.zeros(len(rows), np.uint64)
        for j in range(words.shape[1]):
            total = common.mix64(total * np.uint64(0xD6E8FEB86659FD93) + words[:, j] + np.uint64(j + 1))
        out[first : first + (1 << 16)] = total
    return out


def _compare_names(table: pa.Table) -> pa.Table:
    """Names of all blocks for one bucket -> a code for each: 0 stays, 1 wholly repeats, 2 to be sorted, 3 hot."""
    q, p, n, blobs = (table[c].to_pylist() for c in ("q", "p", "n", "blob"))
    grams, variants, digests, docs = [], [], [], []
    for k, blob in zip(n, blobs, strict=True):
        grams.append(unplanes(blob, k, H_BYTES))
        rest = blob[k * H_BYTES :]
        variants.append(np.frombuffer(rest, np.uint16, k))
        digests.append(np.frombuffer(rest, np.uint64, 2 * k, 2 * k).reshape(k, 2))
        docs.append(np.frombuffer(rest, np.int64, k, 18 * k))
    gram, variant, digest, doc = (np.concatenate(x) for x in (grams, variants, digests, docs))
    order = np.lexsort((np.repeat(np.array(p), n), doc, gram))
    g, v, d = gram[order], variant[order].astype(np.int64), digest[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    group = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
    total = np.add.reduceat(v, first)
    differs = np.bincount(group, weights=(d != d[first][group]).any(axis=1) | (v > 1)) > 0
    code = np.where(differs[group], np.where(total[group] > HOT_SEGMENTS, 3, 2), (np.arange(len(g)) != first[group]).astype(int)).astype(np.uint8)
    out = np.empty(len(code), np.uint8)
    out[order] = code
    parts = np.split(out, np.cumsum(n)[:-1])
    return mail([(b, c, k, x.tobytes()) for b, c, k, x in zip(q, p, n, parts, strict=True)])


def _sort_parcels(table: pa.Table, length: int) -> pa.Table:
    """Segments of all blocks for one bucket -> for each of their windows whether an equal one starts earlier."""
    q, p, n, blobs = (table[c].to_pylist() for c in ("q", "p", "n", "blob"))
    docs, places, sizes, texts = [], [], [], []
    for k, blob in zip(n, blobs, strict=True):
        docs.append(np.frombuffer(blob, np.int64, k))
        places.append(np.frombuffer(blob, np.int64, k, 8 * k))
        sizes.append(np.frombuffer(blob, np.int32, k, 16 * k).astype(np.int64))
        texts.append(np.frombuffer(blob, np.uint8, offset=20 * k))
    doc, place, size, text = (np.concatenate(x) for x in (docs, places, sizes, texts))
    width = size + length - 1
    before = np.cumsum(size) - size
    total = int(size.sum())
    # Items in the order in which their windows count: by id, block and place.
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((place, np.repeat(np.array(p), n), doc))] = np.arange(len(doc))
    starts = np.repeat((np.cumsum(width) - width - before).astype(np.int32), size) + np.arange(total, dtype=np.int32)
    classes = equal_windows(text, starts, length)
    del text, starts
    turn = np.repeat(rank * (int(size.max()) + 1) - before, size) + np.arange(total)
    order = np.lexsort((turn, classes))
    ranked = classes[order]
    again = np.zeros(total, bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    per_block = [int(s.sum()) for s in sizes]
    parts = np.split(again, np.cumsum(per_block)[:-1])
    return mail([(b, c, len(x), np.packbits(x).tobytes()) for b, c, x in zip(q, p, parts, strict=True)])


def _joined(answers: pa.Table, want: int) -> dict[int, tuple[int, bytes]]:
    return {q: (n, blob) for q, n, blob in zip(*(answers[c].to_pylist() for c in ("q", "n", "blob")), strict=True) if (q < 0) == (want < 0)}


def _codes(answers: dict[int, tuple[int, bytes]]) -> np.ndarray:
    return np.concatenate([np.frombuffer(answers[q][1], np.uint8) for q in sorted(answers)]) if answers else np.empty(0, np.uint8)


def _result(block: Block, gone: np.ndarray, id_name: str, text_name: str, digest_only: bool, count: str | None) -> pa.Table:
    removed, spans, kept = [], [], []
    edge = np.r_[False, gone]
    begins = np.flatnonzero(gone & ~edge[:-1])
    for i in range(len(block.ids)):
        a, b = block.offsets[i], block.offsets[i + 1]
        mask = gone[a:b]
        lost = int(mask.sum())
        removed.append(lost)
        # A removed run is counted in the document where it begins or goes on from the one before.
        spans.append(int(np.searchsorted(begins, b) - np.searchsorted(begins, a)) + bool(lost and a and mask[0] and gone[a - 1]))
        left = (block.data[a:b][~mask] if lost else block.data[a:b]).tobytes()
        kept.append(hashlib.sha256(left).hexdigest() if digest_only else left.decode("utf-8", "ignore"))
    if digest_only:
        return pa.table({"doc_id": block.table[id_name].cast(pa.int64()), "n_bytes": pa.array(np.diff(block.offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})
    table = block.table
    text = pa.array([k if v else None for k, v in zip(kept, table[text_name].is_valid().to_pylist(), strict=True)], table.schema.field(text_name).type)
    return table.set_column(table.schema.get_field_index(text_name), text_name, text).append_column(count, pa.array(removed, pa.int64()))


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _run(docs: DataFrame, length: int, doc_id: str, text: str, digest_only: bool, count: str | None = None) -> DataFrame:
    if length < DEPTH + TIE:
        raise ValueError(f"length is at least {DEPTH + TIE}")
    # Inside, columns have names by place, which grouped calls resolve whatever the given ones are.
    docs, given = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns
    doc_id, text, block = f"c{given.index(doc_id)}", f"c{given.index(text)}", "p"
    # Small blocks and more buckets: hashing and sorting take many times the bytes of the text at hand.
    dealt, blocks = deal(docs, doc_id, text, 4 << 20, block)
    buckets = 2 * blocks

    def build(table: pa.Table) -> Block:
        return Block(table.drop_columns([block]), doc_id, text, length)

    def say_names(key, table):
        p = key[0].as_py()
        return mail([(q, p, n, blob) for q, n, blob in build(table).names(buckets)])

    def say_parcels(key, table, answers):
        if not table.num_rows:
            return mail([])
        p = (key[0] if key[0].is_valid else answers["p"][0]).as_py()
        codes = _codes(_joined(answers, 0))
        # The codes go along, under a bucket of their own, for the last step.
        return mail([(-1 - p, p, len(codes), codes.tobytes())] + [(q, p, n, blob) for q, n, blob in build(table).parcels(codes, buckets)])

    def sort(key, table):
        return table.select(["q", "p", "n", "blob"]) if key[0].as_py() < 0 else _sort_parcels(table, length)

    def finish(key, table, answers):
        codes = _codes(_joined(answers, -1))
        bits = _joined(answers, 0)
        flags = [np.unpackbits(np.frombuffer(bits[q][1], np.uint8), count=bits[q][0]).astype(bool) for q in sorted(bits)]
        own = build(table)
        gone = own.removed(codes, np.concatenate(flags) if flags else np.empty(0, bool))
        return _result(own, gone, doc_id, text, digest_only, "removed")

    # One plan: the shuffle of the documents into blocks is written once and read by three steps.
    names = dealt.groupBy(block).applyInArrow(say_names, MAIL)
    codes = names.groupBy("q").applyInArrow(lambda key, table: _compare_names(table), MAIL)
    parcels = dealt.groupBy(block).cogroup(codes.groupBy("p")).applyInArrow(say_parcels, MAIL)
    sorted_ = parcels.groupBy("q").applyInArrow(sort, MAIL)
    if digest_only:
        return dealt.groupBy(block).cogroup(sorted_.groupBy("p")).applyInArrow(finish, _REPORT)
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", T.LongType())])
    return dealt.groupBy(block).cogroup(sorted_.groupBy("p")).applyInArrow(finish, schema).toDF(*given, count)


def repeat_report(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    return _run(docs.select(common.named(doc_id), common.named(text)), length, doc_id, text, True)


def remove_repeats(docs: DataFrame, count: str, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes of the text cut out (a character cut in two goes as well), counted in a column."""
    return _run(docs, length, doc_id, text, False, count)


def query(spark, sf_dir: str) -> DataFrame:
    return repeat_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
