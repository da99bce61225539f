"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents with equal sets are one
node. Nodes a, b (|a| <= |b|) link when |a & b| / |a | b| >= 3/4, so |a| >= 3/4 |b| and |a ^ b| <= (|a|+|b|)/7.

Reduction. A shared shingle lies in two nodes at least. Blocks of documents send their shingles to hash buckets as
packed arrays; a bucket answers how many shingles of each document it has seen twice. Nodes with fewer than 3/4
such shingles link with nothing and end here.

Signatures. Sizes fall in bands that grow by 4/3; linked nodes lie in the same band or in neighbours. A node
takes part in its own band and in the next, as the smaller side there. Band with sizes below u: the feature domain
is partitioned by hash in n1 = ceil(0.35 u) parts, and the subsets that are enumerated are the single parts. Of the
parts at most k <= min(n/3, (n+u-1)/7) differ between a node of size n and its partner, so n1 - k parts
are equal. A node whose empty parts are fewer than that shares a filled part, its signature, with each partner. If
both sides have more empty parts (tiny sets), they meet by single shingles instead. So no link is lost.
More than that: a node with f filled parts shares f - k signatures at least with each partner, so the rarest of them
is not among its f - k - 1 most frequent ones. These are left out, which rids nodes of what common passages give.

Sketches. A message carries parity bitmaps of its nodes, which bound |a ^ b| from below, so most pairs that share
signatures but do not link are dropped in the bucket, before they are rows.

Verification. The members of a signature are compared with one pivot, the member with the largest share of
repeated shingles (the likely origin of its copies), and links become components. Then what is left: members of
one signature in different components: all pairs in small groups, four pivots in large ones, and at last, if there
were large ones, all pairs that are left.

Cases: null, empty or blank text has size 0 and is its own component; under 5 words the whole sequence is the
shingle; repeated rows and ids meet as equal sets; null ids are kept and never name a component that has another
id; an empty table gives no rows. Of the input only the id and text columns are used.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .blocks import MAIL, bucket_slices, mail, planes, unplanes
from .graph import components, spread_join

BLOCK_BYTES = 12 << 20
SIGNATURE_BYTES = 8 << 20
_STEP = tuple(np.uint64(x) for x in common.mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1))


def word_hashes(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a buffer, A-Z lowered, and where it starts."""
    start, end = common.word_bounds(data)
    return common.string_hashes(common.LOWER[data], start, end, seed), start


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` word hashes; one hash of them all if there are fewer."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, width)
    out = np.zeros(n - w + 1, np.uint64)
    for j in range(w):
        out += words[j : n - w + 1 + j] * _STEP[j]
    return common.mix64(out + np.uint64(w))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = common.binary_column(column)
    for first, last in common.pieces(offsets, 1 << 20):
        base = offsets[first]
        part = data[base : offsets[last]]
        # A separator after each text keeps its last word from meeting the next text.
        joined = np.insert(part, offsets[first + 1 : last + 1] - base, 32)
        words, start = word_hashes(joined, 10)
        ends = offsets[first + 1 : last + 1] - base + np.arange(1, last - first + 1)
        upto = np.searchsorted(start, ends)
        at = 0
        for end in upto:
            yield np.unique(sequence_hashes(words[at:end], width))
            at = end


def set_id(shingles: np.ndarray) -> int:
    """64 bits that name a set."""
    if not len(shingles):
        return 0
    mixed = common.mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))
    total = np.array([int(np.add.reduce(mixed)) ^ (int(np.bitwise_xor.reduce(shingles)) * 31 & 0xFFFFFFFFFFFFFFFF)], np.uint64)
    return int(common.mix64(total).view(np.int64)[0])


_SENT = pa.schema([("q", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])


def _send(batches: Iterator[pa.RecordBatch], buckets: int, width: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc_id, text, mark) -> for each bucket the block's shingles and their documents; q < 0: the documents."""
    part, seq = TaskContext.get().partitionId(), 0

    def flush(ids, marks, sets):
        nonlocal seq
        block, seq = (part << 20) + seq, seq + 1
        nodes = [set_id(s) for s in sets]
        first: dict[int, int] = {}
        for i, node in enumerate(nodes):
            if len(sets[i]):
                first.setdefault(node, i)
        own = sorted(first.values())
        info = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(np.isin(np.arange(len(ids)), own))], names=["doc_id", "mark", "n", "node", "own"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, info.schema) as out:
            out.write_batch(info)
        rows = [(-1 - part, block, len(ids), sink.getvalue().to_pybytes())]
        if own:
            values = np.concatenate([sets[i] for i in own])
            owner = np.repeat(np.array(own, np.uint32), [len(sets[i]) for i in own])
            order = np.argsort(values)
            values, owner = values[order], owner[order]
            for q, a, b in bucket_slices(values, buckets):
                ids_blob = owner[a:b].astype(np.uint16 if len(ids) <= 0xFFFF else np.uint32).tobytes()
                rows.append((q, block, b - a, planes(values[a:b], width) + ids_blob))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    ids, marks, sets, held = [], [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        marks += batch.column(2).to_pylist()
        for s in shingle_sets(batch.column(1), shingle):
            sets.append(s)
            held += 8 * len(s) + 64
            if held >= BLOCK_BYTES * 2:
                k = len(sets)
                yield flush(ids[:k], marks[:k], sets)
                ids, marks, sets, held = ids[k:], marks[k:], [], 0
    if sets:
        yield flush(ids, marks, sets)


_ANSWER = pa.schema([("block", pa.int64()), ("blob", pa.binary()), ("info", pa.bool_())])


def _answer(key, table: pa.Table, width: int) -> pa.Table:
    """One bucket -> for each block, how many shingles of each document the bucket has seen twice or more."""
    table = table.combine_chunks()
    blocks, counts, blobs = table["block"].to_pylist(), table["n"].to_pylist(), table["blob"].to_pylist()
    if key[0].as_py() < 0:
        return pa.table([blocks, blobs, [True] * len(blocks)], schema=_ANSWER)
    values = np.concatenate([unplanes(b, n, width) for b, n in zip(blobs, counts, strict=True)])
    owners = [np.frombuffer(b[n * width :], np.uint16 if len(b) - n * width == 2 * n else np.uint32) for b, n in zip(blobs, counts, strict=True)]
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    twice = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    flags = np.zeros(len(ranked), bool)
    flags[order] = twice
    out, at = [], 0
    for owner, n in zip(owners, counts, strict=True):
        out.append(np.bincount(owner[flags[at : at + n]]).astype(np.uint32).tobytes())
        at += n
    return pa.table([blocks, out, [False] * len(out)], schema=_ANSWER)


def _collect(key, table: pa.Table) -> pa.Table:
    """The answers to one block and its documents -> (doc_id, mark, n, node, own, repeated)."""
    info, total = None, None
    pairs = list(zip(table["info"].to_pylist(), table["blob"].to_pylist(), strict=True))
    info = pa.ipc.open_stream(next(b for flag, b in pairs if flag)).read_all()
    total = np.zeros(info.num_rows, np.int64)
    for flag, blob in pairs:
        if not flag:
            got = np.frombuffer(blob, np.uint32)
            total[: len(got)] += got
    return info.append_column("repeated", pa.array(total))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(common.named(doc_id).cast("long").alias("doc_id"), common.named(text).alias("text")).withColumn("mark", F.xxhash64("text"))


def document_nodes(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), n, node, own (first of its node in its block), repeated (for own rows: shingles
    seen in two nodes)."""
    spark = docs.sparkSession
    picked = _texts(docs, doc_id, text)
    size = common.text_bytes(picked, "text")
    buckets = common.blocks_for(size, spark)
    width = min(8, max(5, (int(size).bit_length() + 17) // 8))
    sent = picked.mapInArrow(functools.partial(_send, buckets=buckets, width=width, shingle=shingle), "q int, block long, n int, blob binary")
    answers = sent.groupBy("q").applyInArrow(lambda key, table: _answer(key, table, width), "block long, blob binary, info boolean")
    return answers.groupBy("block").applyInArrow(lambda key, table: _collect(key, table), "doc_id long, mark long, n long, node long, own boolean, repeated long")


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(text, node, share) -> (node, share, shingles) of the texts whose set is the node, each once a task."""
    seen: set[int] = set()
    for batch in batches:
        keep, blobs = [], []
        for i, (node, s) in enumerate(zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0), shingle), strict=True)):
            if node not in seen and set_id(s) == node:
                seen.add(node)
                keep.append(i)
                blobs.append(s.tobytes())
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2), pa.array(blobs, pa.binary())], names=["node", "share", "shingles"])


@functools.cache
def band_edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 4 // 3 + 1)
    return np.array(edges, np.int64)


def signatures(shingles: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The PartEnum signatures of one set, by band, each with how many of them a linked set shares at least."""
    n, edges, out = len(shingles), band_edges(), []
    own = int(np.searchsorted(edges, n, side="right")) - 1
    for band in (own, own + 1):
        u = int(edges[band + 1])
        n1 = -(-35 * u // 100)
        k = min(n // 3, (n + u - 1) // 7)
        part = (common.mix64(shingles) >> np.uint64(20)) % np.uint64(n1)
        order = np.argsort(part, kind="stable")
        part, mixed = part[order], common.mix64(shingles[order] + np.uint64(77))
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        filled = common.mix64(np.add.reduceat(mixed, first) + common.mix64(part[first] * np.uint64(4096) + np.uint64(2 * band)))
        out.append((filled, max(1, len(first) - k)))
        if len(first) <= k:
            out.append((common.mix64(mixed + np.uint64((2 * band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), -(-3 * n // 4)))
    return out


def _block_signatures(table: pa.Table) -> tuple[pa.Table, list, np.ndarray]:
    """A block's sets in order of node, their signatures, and all of these sorted."""
    table = table.sort_by("node")
    made = [signatures(np.frombuffer(b.as_py(), np.uint64)) for b in table["shingles"]]
    every = np.sort(np.concatenate([s for m in made for s, _ in m])) if made else np.empty(0, np.uint64)
    return table, made, every


def _say_signatures(key, table: pa.Table, buckets: int) -> pa.Table:
    _, _, every = _block_signatures(table)
    return mail([(q, key[0].as_py(), b - a, planes(every[a:b], 8)) for q, a, b in bucket_slices(every, buckets)])


def _count_signatures(table: pa.Table) -> pa.Table:
    """For each signature that a block sent how many nodes have it, up to 65535."""
    q, p, n, blobs = (table[c].to_pylist() for c in ("q", "p", "n", "blob"))
    values, back, counts = np.unique(np.concatenate([unplanes(b, k, 8) for b, k in zip(blobs, n, strict=True)]), return_inverse=True, return_counts=True)
    counts = np.minimum(counts, 65535).astype(np.uint16)[back]
    return mail([(a, b, k, x.tobytes()) for a, b, k, x in zip(q, p, n, np.split(counts, np.cumsum(n)[:-1]), strict=True)])


_KEPT = "node long, share int, n long, sketch binary, sigs binary"


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set's elements over at least 2 n places, a power of two: two sketches differ in no more places
    than the sets have differing elements, and a larger sketch folds to a smaller one."""
    places = 64
    while places < 2 * len(shingles):
        places *= 2
    bits = np.bincount((common.mix64(shingles + np.uint64(5)) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the rows of two matrices of sketches differ, the wider ones folded."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _rarest(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Of signatures of which a linked set shares t at least, all but the t - 1 most frequent; of these, the shared."""
    table, made, every = _block_signatures(table)
    got = sorted(zip(answers["q"].to_pylist(), answers["blob"].to_pylist(), strict=True))
    counts = np.frombuffer(b"".join(b for _, b in got), np.uint16)
    blobs = []
    for m in made:
        kept = []
        for sig, t in m:
            count = counts[np.searchsorted(every, sig)]
            order = np.lexsort((sig, count))[: len(sig) - t + 1]
            kept.append(sig[order][count[order] > 1])
        blobs.append(np.concatenate(kept).tobytes())
    sets = [np.frombuffer(b.as_py(), np.uint64) for b in table["shingles"]]
    columns = [table["node"], table["share"], pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary()), pa.array(blobs, pa.binary())]
    return pa.table(columns, names=["node", "share", "n", "sketch", "sigs"])


def kept_signatures(sets: DataFrame, buckets: int) -> DataFrame:
    """sets (node, share, shingles) -> (node, share, sigs): the signatures by which each node can meet its links."""
    dealt = sets.withColumn("_p", F.pmod("node", F.lit(buckets)).cast("int"))
    said = dealt.groupBy("_p").applyInArrow(lambda key, table: _say_signatures(key, table, buckets), MAIL)
    counts = said.groupBy("q").applyInArrow(lambda key, table: _count_signatures(table), MAIL)
    kept = dealt.groupBy("_p").cogroup(counts.groupBy("p")).applyInArrow(lambda key, a, b: _rarest(a, b), _KEPT)
    return common.table(kept.where(F.octet_length("sigs") > 0), "signatures")


def _pack_signatures(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(node, comp, share, n, sketch, sigs) -> messages to buckets: signatures, which node has each, and the nodes."""

    def flush(rows):
        made = [np.frombuffer(r[5], np.uint64) for r in rows]
        values = np.concatenate(made)
        owner = np.repeat(np.arange(len(made)), [len(m) for m in made])
        order = np.argsort(values)
        values, owner = values[order], owner[order]
        facts = np.array([(r[0], r[1], r[2], r[3], len(r[4])) for r in rows], np.int64)
        out = []
        for q, a, b in bucket_slices(values, buckets):
            own, at = np.unique(owner[a:b], return_inverse=True)
            blob = facts[own].tobytes() + b"".join(rows[i][4] for i in own) + planes(values[a:b], 8) + at.astype(np.uint32).tobytes()
            out.append((q, len(own), b - a, blob))
        return mail(out).to_batches()

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            rows.append(row)
            held += len(row[5])
            if held > 4 << 20:
                yield from flush(rows)
                rows, held = [], 0
    if rows:
        yield from flush(rows)


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("c", pa.int64())])


def _possible(u: np.ndarray, v: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Whether sizes and sketches leave it open that nodes link: |a ^ b| <= (|a| + |b|) / 7, and a sketch shows at
    most what differs."""
    small, large = np.minimum(sizes[u], sizes[v]), np.maximum(sizes[u], sizes[v])
    out = 4 * small >= 3 * large
    width = np.array([len(x) for x in sketches])
    for wu in np.unique(width[u]):
        for wv in np.unique(width[v]):
            rows = np.flatnonzero(out & (width[u] == wu) & (width[v] == wv))
            step = max(1, (4 << 20) // int(max(wu, wv)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                side = lambda x, w: np.frombuffer(b"".join(sketches[i] for i in x[part]), np.uint64).reshape(len(part), w // 8)  # noqa: B023, E731
                out[part] = 7 * differing(side(u, wu), side(v, wv)) <= sizes[u[part]] + sizes[v[part]]
    return out


def _bucket_pairs(table: pa.Table, pivots: int, small: int, seed: int) -> pa.Table:
    """Signatures of one bucket -> pairs (pivot, member, signatures shared here) that may link and whose components
    differ.

    In a group of up to `small` members all are pivots, in a larger one `pivots` of them: for seed 0 the nodes with
    the largest share, else by hash. A row of nulls says that there were larger groups.
    """
    sig, owner, facts, sketches = [], [], [], []
    for k, n, blob in zip(table["p"].to_pylist(), table["n"].to_pylist(), table["blob"].to_pylist(), strict=True):
        head = np.frombuffer(blob, np.int64, 5 * k).reshape(k, 5)
        at = 40 * k
        owner.append(np.frombuffer(blob, np.uint32, n, at + int(head[:, 4].sum()) + 8 * n).astype(np.int64) + len(sketches))
        for width in head[:, 4].tolist():
            sketches.append(blob[at : at + width])
            at += width
        sig.append(unplanes(blob[at:], n, 8))
        facts.append(head)
    sig, owner, facts = np.concatenate(sig), np.concatenate(owner), np.concatenate(facts)
    node, comp = facts[owner, 0], facts[owner, 1]
    rank = -facts[owner, 2] if seed == 0 else common.mix64(node.view(np.uint64) + np.uint64(seed)).view(np.int64)
    order = np.lexsort((node, rank, sig))
    sig, node, comp, owner = sig[order], node[order], comp[order], owner[order]
    first = np.r_[True, sig[1:] != sig[:-1]]
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    size = np.diff(np.r_[start, len(sig)])
    mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
    live = mixed[group]
    most = np.where(size <= small, size, pivots)
    found, counts, held = np.empty(0, np.int64), np.empty(0, np.int64), []
    place = np.arange(len(sig)) - start[group]

    def fold():
        # The pairs met since the last time that may link join those kept; so memory holds a bounded number of others.
        nonlocal found, counts, held
        code, count = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
        keep = _possible(code >> np.int64(32), code & np.int64(0xFFFFFFFF), facts[:, 3], sketches) if len(code) else np.empty(0, bool)
        every = np.concatenate([found, code[keep]])
        found, back = np.unique(every, return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, count[keep]]), minlength=len(found)).astype(np.int64)
        held = []

    for k in range(int(most[mixed].max()) if mixed.any() else 0):
        # The k-th of each group against all behind it.
        at = np.flatnonzero(live & (most[group] > k) & (place > k))
        pivot = start[group[at]] + k
        other = comp[at] != comp[pivot]
        held.append(owner[pivot[other]] << np.int64(32) | owner[at[other]])
        if sum(map(len, held)) > 1 << 19:
            fold()
    fold()
    u, v = found >> np.int64(32), found & np.int64(0xFFFFFFFF)
    out = pa.table([facts[u, 0], facts[v, 0], counts], schema=_PAIRS)
    larger = bool((mixed & (size > small)).any())
    return pa.concat_tables([out, pa.table([[None], [None], [1]], schema=_PAIRS)]) if larger else out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, set of u, set of v) -> the pairs that link."""
    for batch in batches:
        keep = []
        last_key, last_set = None, None
        for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if u != last_key:
                last_key, last_set = u, np.frombuffer(a.as_py(), np.uint64)
            other = np.frombuffer(b.as_py(), np.uint64)
            small, large = (last_set, other) if len(last_set) < len(other) else (other, last_set)
            at = np.searchsorted(large, small)
            shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            keep.append(100 * shared >= 75 * (len(small) + len(large) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    # Both joins read one shuffle of the sets.
    own = sets.select("node", "shingles")
    a, b = own.toDF("u", "a"), own.toDF("v", "b")
    return pairs.select("u", "v").join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInArrow(_verify, "u long, v long")


def _signature_pairs(signed: DataFrame, labels: DataFrame | None, buckets: int, pivots: int, small: int, seed: int) -> DataFrame:
    if labels is None:
        named = signed.withColumn("comp", F.col("node"))
    else:
        named = signed.join(labels.select(F.col("node").alias("_n"), "comp"), F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("comp", "node"))
    sent = named.select("node", "comp", "share", "n", "sketch", "sigs").mapInArrow(functools.partial(_pack_signatures, buckets=buckets), MAIL)
    found = sent.groupBy("q").applyInArrow(lambda key, table: _bucket_pairs(table, pivots, small, seed), "u long, v long, c long")
    return found.groupBy("u", "v").agg(F.sum("c").alias("c"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components so far."""
    side = lambda n: labels.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
    joined = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
    return joined.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select(*pairs.columns)


def node_components(sets: DataFrame, buckets: int) -> DataFrame:
    """sets (node, share, shingles) -> (node, comp) of the nodes that have a link."""
    spark = sets.sparkSession
    links, labels, tested = None, None, None

    def test(pairs: DataFrame) -> None:
        nonlocal links, labels, tested
        found = common.cut(_linked(pairs, sets))
        tested = pairs.select("u", "v") if tested is None else tested.union(pairs.select("u", "v"))
        links = found if links is None else links.union(found)
        labels = common.cut(components(links))

    signed = kept_signatures(sets, buckets)
    # Messages bring their nodes' sketches along, so these buckets are as few as their size allows.
    buckets = max(1, -(-(signed.agg(F.sum(F.octet_length("sigs"))).first()[0] or 0) // SIGNATURE_BYTES))
    pairs = common.cut(_signature_pairs(signed, None, buckets, 1, 0, 0).where("u is not null"))
    # First each member with the pivot that it shares most signatures with, then what this has not joined.
    best = pairs.groupBy("v").agg(F.max_by("u", F.struct("c", "u")).alias("u")).select("u", "v")
    test(common.cut(best))
    rest = common.cut(_apart(pairs, labels).join(tested, ["u", "v"], "left_anti"))
    if rest.take(1):
        test(rest)
    # Then all pairs of small groups and some of large ones, and only if there were large ones all that is left.
    for small in (64, 1 << 62):
        pairs = _signature_pairs(signed, labels, buckets, 4, small, 1)
        seen = tested.union(tested.select("v", "u"))
        pairs = common.cut(pairs.join(seen, ["u", "v"], "left_anti"))
        fresh = pairs.where("u is not null")
        if fresh.take(1):
            test(fresh)
        if not pairs.where("u is null").take(1):
            break
    common.discard(spark, signed, "signatures")
    return labels


@common.tidied
def jaccard_components(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, mark (a hash of the text) and comp (the component's own name, null without
    words) of every row of docs."""
    info = common.cut(document_nodes(docs, shingle, doc_id, text))
    # Ids come before null in the order by which a node picks the row that stands for it.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    nodes = info.where("n > 0").groupBy("node").agg(
        F.min(row).alias("least"), F.max("n").alias("n"), F.max(F.when(F.col("own"), F.col("repeated"))).alias("repeated")
    )
    nodes = common.cut(nodes)
    likely = nodes.where("4 * repeated >= 3 * n").select(F.col("least.doc_id").alias("_id"), F.col("least.mark").alias("_mark"), "node", (100 * F.col("repeated") / F.col("n")).cast("int").alias("share"))
    texts = _texts(docs, doc_id, text).join(likely, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "node", "share")
    sets = common.table(texts.mapInArrow(functools.partial(_sets, shingle=shingle), "node long, share int, shingles binary"), "sets")
    buckets = common.blocks_for(sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0, docs.sparkSession)
    labels = node_components(sets, buckets)
    common.discard(docs.sparkSession, sets, "sets")
    linked = common.cut(nodes.select("node", "least.doc_id").join(labels, "node"))
    comps = common.cut(linked.groupBy("comp").agg(F.min("doc_id").alias("component"), F.count("*").alias("nodes")))
    joined = spread_join(linked.select("node", "comp"), comps, "comp", "nodes", linked.count()).select("node", "comp", "component")
    alone = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"), F.col("least.doc_id").alias("component"))
    named = joined.union(alone).withColumnRenamed("node", "_node")
    out = info.join(named, F.when(F.col("n") > 0, F.col("node")) == F.col("_node"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "mark", F.when(F.col("n") > 0, F.col("comp")).alias("comp"))


@common.tidied
def keep_one(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id, null last; of several rows with that id the one whose text
    has the smallest hash, once. Rows without words stay, of those with equal id and text one."""
    key, mark, rows = (common.fresh(x, docs.columns) for x in ("_key", "_mark", "_rows"))
    name = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    found = jaccard_components(docs, shingle, doc_id, text).where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    named = found.select(name(F.col("doc_id")).alias(key), F.col("mark").alias(mark), F.col("comp").alias("_comp"))
    rows_of = named.groupBy(key, "_comp", mark).agg(F.count("*").alias(rows))
    first = rows_of.where("_comp is not null").groupBy(key, "_comp").agg(F.min(F.struct(mark, rows)).alias("_m")).select(key, f"_m.{mark}", f"_m.{rows}")
    kept = common.cut(first.union(rows_of.where("_comp is null").select(key, mark, rows)))
    joined = docs.withColumns({key: name(common.named(doc_id)), mark: F.xxhash64(common.named(text))}).join(kept, [key, mark])
    # Rows repeated whole lie side by side; only where there are any is one of them picked.
    if kept.where(F.col(rows) > 1).take(1):
        joined = joined.dropDuplicates([key, mark])
    return joined.select(*map(common.named, docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark", "comp")
