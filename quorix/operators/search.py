"""k nearest references by squared Euclidean distance, exact or over quantized and clustered shortlists.

The queries are the stated set. Up to a counted bound they are broadcast and references stay where they lie; a task keeps
k candidates a query, and only these are shuffled for the last ranking. A larger set, and a search by cluster, is a
blocked join: references and queries are cut in parts of bounded size, each pair of parts that share a key meets in one
group, which reads the cells of references that can hold a neighbour (quorix/operators/cells.py), and of each group k
candidates a query remain. The driver sees counts and, within the bound, one set of queries.
Distances are exact: whole numbers below 2**53 in matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorix.functions import features
from quorix.operators import cells
from quorix.session import shared_dir

SLICE_ROWS, REF_ROWS = 50_000, 200_000
_CELLS = 1 << 22
#: Neighbours that a group returns.
_ANSWERS = 2_000_000
_FOUND = "query_id long, d long, ref_id long, fraud long, d2 long"


def _best(query: np.ndarray, distance: np.ndarray, ref: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (distance, ref) of each query."""
    order = np.lexsort((ref, distance, query))
    first = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0]) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


class _Side:
    """Queries: ids, coordinates for the ranking and for the second distance, grouped by key."""

    def __init__(self, table: pa.Table, keys: Sequence[str], dims: Sequence[str], second: Sequence[str]):
        self.ids = table["query_id"].to_numpy().astype(np.int64)
        self.at, self.second = _matrix(table, dims, np.float64), _matrix(table, second, np.int64)
        self.groups = {key: rows for key, rows in _by_key(table, keys)}


def _matrix(table: pa.Table, names: Sequence[str], kind) -> np.ndarray:
    return np.stack([np.asarray(table[c]) for c in names], axis=1).astype(kind) if names else np.empty((table.num_rows, 0), kind)


def _by_key(table: pa.Table, keys: Sequence[str]) -> list[tuple[tuple, np.ndarray]]:
    """The rows of each key."""
    if not keys or not table.num_rows:
        return [((), np.arange(table.num_rows))]
    columns = [table[c].to_numpy() for c in keys]
    order = np.lexsort(columns[::-1])
    stacked = np.stack([c[order] for c in columns])
    cut = np.flatnonzero(np.r_[True, (np.diff(stacked, axis=1) != 0).any(axis=0)])
    return [(tuple(int(c[order[a]]) for c in columns), order[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(order)], strict=True)]


class _Nearest:
    """The k nearest of the references met so far, for each query of a side."""

    def __init__(self, side: _Side, keys: Sequence[str], dims: Sequence[str], second: int, k: int, skip_self: bool):
        self.side, self.keys, self.dims, self.n_second, self.k, self.skip_self = side, keys, dims, second, k, skip_self
        self.kept = [np.empty(0, np.int64)] * 5

    def meet(self, table: pa.Table) -> None:
        side, k = self.side, self.k
        ref, fraud = table["ref_id"].to_numpy().astype(np.int64), table["fraud"].to_numpy().astype(np.int64)
        points, exact = _matrix(table, self.dims, np.float64), _matrix(table, [f"_s{i}" for i in range(self.n_second)], np.int64)
        found = [[x] for x in self.kept]
        for key, rows in _by_key(table, self.keys):
            own = side.groups.get(key)
            if own is None or not len(rows):
                continue
            r = points[rows]
            rr = (r * r).sum(axis=1)
            step = max(1, _CELLS // len(rows))
            for at in range(0, len(own), step):
                q = own[at : at + step]
                d = (side.at[q] ** 2).sum(axis=1)[:, None] + rr - 2.0 * (side.at[q] @ r.T)
                if self.skip_self:
                    d[side.ids[q][:, None] == ref[rows]] = np.inf
                limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
                i, j = np.nonzero((d <= limit) & np.isfinite(d))
                near = d[i, j].astype(np.int64)
                # Of equal distances at the limit only the smaller ids stay.
                best = _best(i, near, ref[rows[j]], k)
                i, j, near = i[best], j[best], near[best]
                delta = exact[rows[j]] - side.second[q[i]]
                for x, y in zip(found, (side.ids[q[i]], near, ref[rows[j]], fraud[rows[j]], (delta * delta).sum(axis=1)), strict=True):
                    x.append(y)
        kept = [np.concatenate(x) for x in found]
        best = _best(kept[0], kept[1], kept[2], k)
        self.kept = [x[best] for x in kept]

    def table(self) -> pa.Table:
        return pa.table([pa.array(x, pa.int64()) for x in self.kept], names=["query_id", "d", "ref_id", "fraud", "d2"])


def _met(refs: pa.Table, asked: pa.Table, keys: Sequence[str], dims: Sequence[str], second: Sequence[str], k: int, skip_self: bool) -> pa.Table:
    """The k nearest references of each asked row that agree in keys. A side without rows has no columns either."""
    out = [np.empty(0, np.int64)] * 5
    if refs.num_rows and asked.num_rows:
        refs = refs.sort_by("ref_id")
        ref, fraud, ids = (t[c].to_numpy().astype(np.int64) for t, c in ((refs, "ref_id"), (refs, "fraud"), (asked, "query_id")))
        points, at = _matrix(refs, dims, np.float64), _matrix(asked, dims, np.float64)
        exact, wanted = _matrix(refs, [f"_s{i}" for i in range(len(second))], np.int64), _matrix(asked, second, np.int64)
        own, found = dict(_by_key(refs, keys)), []
        for key, rows in _by_key(asked, keys):
            if key not in own:
                continue
            # One more, as a query may meet itself.
            place, d = cells.nearest(at[rows], points[own[key]], k + skip_self)
            i, j = np.nonzero(place >= 0)
            q, r, near = rows[i], own[key][place[i, j]], d[i, j]
            if skip_self:
                other = np.flatnonzero(ids[q] != ref[r])
                q, r, near = q[other], r[other], near[other]
            delta = exact[r] - wanted[q]
            found.append((ids[q], near, ref[r], fraud[r], (delta * delta).sum(axis=1)))
        if found:
            out = [np.concatenate(x) for x in zip(*found, strict=True)]
            best = _best(out[0], out[1], out[2], k)
            out = [x[best] for x in out]
    return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "d", "ref_id", "fraud", "d2"])


def salted(df: DataFrame, by: str, own: str, parts: int | str, other: str, copies: int | str) -> DataFrame:
    """df cut in `parts` parts, numbered in column `own`, each once for all `copies` parts of the other side; a name is that
    of a column with the number."""
    parts, copies = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (parts, copies))
    return df.withColumn(own, F.pmod(F.xxhash64(by), parts).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), copies - 1)))


def with_parts(df: DataFrame, of: DataFrame, keys: Sequence[str], rows: int, least: int) -> DataFrame:
    """df with _parts, the parts of up to `rows` rows in which the rows of its key in `of` are cut; keys of more than 4,096
    rows have `least` parts, as far as these are not smaller."""
    n = F.col("_n")
    parts = F.greatest(F.ceil(n / rows), F.least(F.lit(least), F.ceil(n / 4096))).cast("int")
    large = of.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, parts.alias("_parts")).where("_parts > 1")  # few keys, as each has many rows
    return df.join(F.broadcast(large), list(keys), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def _most(df: DataFrame, keys: Sequence[str]) -> tuple[int, int, int]:
    """Rows, keys, and rows of the largest key."""
    r = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*"), F.max("n")).first()
    return int(r[0] or 0), max(1, int(r[1])), int(r[2] or 0)


def nearest(refs: DataFrame, queries: DataFrame, dims: Sequence[str], k: int, keys: Sequence[str] = (), second: Sequence[str] = (), skip_self: bool = True, slice_rows: int = SLICE_ROWS, ref_rows: int = REF_ROWS, near: str | None = None, inside: DataFrame | None = None) -> DataFrame:
    """query_id, ref_id, d, fraud, d2 (over `second`) and rn of the k nearest references that agree in keys.

    refs: ref_id, fraud, keys, dims; queries: query_id and the same. Equal distances go to the smaller ref_id.
    Pairs of equal ids are left out if skip_self. near: a column of few values whose references lie close together; more
    queries than slice_rows are searched within their own value first, then in those whose box can hold a nearer reference.
    inside: the k nearest within the own value, written down, where they are known.
    """
    spark = refs.sparkSession
    picked = refs.select("ref_id", F.col("fraud").cast("int").alias("fraud"), *keys, *dims, *[F.col(c).alias(f"_s{i}") for i, c in enumerate(second)])
    shared_dir(spark)
    hint = [near] if near and near in refs.columns and near in queries.columns and near not in keys else []
    asked = queries.select("query_id", *dict.fromkeys((*keys, *hint, *dims, *second))).checkpoint()
    n_asked, _, most_asked = _most(asked, keys)
    order = Window.partitionBy("query_id").orderBy("d", "ref_id")
    if len(keys) < 2 and n_asked <= slice_rows:
        shared = spark.sparkContext.broadcast(_Side(asked.toArrow(), keys, dims, second))
        found = picked.mapInArrow(_runner(shared, keys, dims, len(second), k, skip_self), _FOUND)
    elif hint:
        how = {"k": k, "second": second, "skip_self": skip_self, "slice_rows": slice_rows, "ref_rows": ref_rows}
        first = (nearest(refs, asked, dims, keys=[*keys, near], **how).checkpoint() if inside is None else inside).drop("rn")
        more = _elsewhere(refs, asked, first, dims, k, near)
        found = first if more.isEmpty() else first.unionByName(nearest(refs, more, dims, keys=[*keys, near], **how).drop("rn"))
    else:
        n, kinds, most = _most(picked, keys)
        tasks = spark.sparkContext.defaultParallelism
        s = max(1, -(-most // ref_rows), min(-(-tasks // kinds), -(-most // 4096)))
        t = max(1, -(-most_asked // max(slice_rows, ref_rows)), -(-most_asked * k // _ANSWERS))
        by = [*keys, "_s", "_t"]
        # Both sides may come from one table; with columns of the same identity the second loses its own.
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
        a, b = picked, asked
        if keys and s > 1:
            least, s = min(-(-tasks // kinds), s), "_parts"
            a, b = (with_parts(x, picked, keys, ref_rows, least) for x in (a, b))
        a, b = salted(a, "ref_id", "_s", s, "_t", t), salted(b, "query_id", "_t", t, "_s", s)
        groups = max(4 * tasks, -(-n // ref_rows))
        if kinds > groups:  # many small keys share a group
            mixed = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")
            a, b, by = a.withColumn("_g", mixed), b.withColumn("_g", mixed), ["_g", "_s", "_t"]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            return _met(left, right, keys, dims, second, k, skip_self)

        found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(meet, _FOUND)
    ranked = found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    return ranked.select("query_id", "ref_id", "d", "fraud", "d2", "rn")


def _elsewhere(refs: DataFrame, asked: DataFrame, first: DataFrame, dims: Sequence[str], k: int, near: str) -> DataFrame:
    """The asked rows under each other value of `near` whose box of references reaches as close as their k-th neighbour so far."""
    ends = [f(c).cast("double").alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in dims]
    boxes = refs.groupBy(near).agg(*ends).toArrow()  # a row a value
    values = boxes[near].to_numpy()
    low, high = (_matrix(boxes, [f"{f}_{c}" for c in dims], np.float64) for f in ("min", "max"))
    last = first.groupBy("query_id").agg(F.max("d").alias("_last"), F.count("*").alias("_n"))
    open_ = asked.join(last, "query_id", "left").withColumn("_last", F.when(F.col("_n") >= k, F.col("_last"))).drop("_n")
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own = _matrix(batch, dims, np.float64), batch[near].to_numpy(zero_copy_only=False)
            limit = batch["_last"].cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)
            table = pa.Table.from_batches([batch.select(names)])
            for value, a, b in zip(values, low, high, strict=True):
                gap = np.maximum(np.maximum(a - at, at - b), 0.0)
                rows = np.flatnonzero(((gap * gap).sum(axis=1) <= limit) & (own != value))
                if len(rows):
                    moved = table.take(rows)
                    yield from moved.set_column(names.index(near), near, pa.array(np.full(len(rows), value)).cast(moved[near].type)).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return open_.mapInArrow(run, schema).checkpoint()


def _runner(shared, *rest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Nearest(shared.value, *rest)
        for batch in batches:
            found.meet(pa.Table.from_batches([batch]))
        yield from found.table().to_batches()

    return run


def rerank(shortlist: DataFrame, k: int) -> DataFrame:
    """The k of a shortlist that are nearest by the exact distance d2."""
    order = Window.partitionBy("query_id").orderBy("d2", "ref_id")
    return shortlist.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def vote(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """query_id, frauds, found, approved and score of every query; a query without neighbours has no frauds."""
    votes = neighbours.groupBy("query_id").agg(F.sum("fraud").alias("frauds"), F.count("*").alias("found"))
    joined = queries.select("query_id").join(votes, "query_id", "left")
    filled = joined.select("query_id", F.coalesce("frauds", F.lit(0)).cast("long").alias("frauds"), F.coalesce("found", F.lit(0)).cast("long").alias("found"))
    return filled.select("*", features.approved(F.col("frauds")).alias("approved"), features.score(F.col("frauds")).alias("score"))


FULL = [f"q{i}" for i in features.DIMS]
STORED = [f"q{i}" for i in features.STORED]
COARSE = [f"e{i}" for i in features.STORED]


def with_coarse(df: DataFrame) -> DataFrame:
    return df.withColumns({f"e{i}": features.quantize8(F.col(f"q{i}")) for i in features.STORED})


def search_full(refs: DataFrame, queries: DataFrame, k: int = features.K, inside: DataFrame | None = None) -> DataFrame:
    """inside: what search_bucket found, written down. It has the same distances, as the coordinates that STORED leaves out are equal within a bucket."""
    return nearest(refs, queries, FULL, k, near="bucket", inside=inside)


def search_bucket(refs: DataFrame, queries: DataFrame, k: int = features.K) -> DataFrame:
    return nearest(refs, queries, STORED, k, keys=["bucket"])


#: Bounds of the shortlist and of the probes.
SHORTLIST, PROBES = (5, 64), (1, 512)


def bounded(value: int, bounds: tuple[int, int]) -> int:
    return min(max(int(value), bounds[0]), bounds[1])


def search_coarse(refs: DataFrame, queries: DataFrame, shortlist: int = 16) -> DataFrame:
    """The shortlist (5 to 64) by coarse distance d, with the exact distance in d2."""
    shortlist = bounded(shortlist, SHORTLIST)
    return nearest(with_coarse(refs), with_coarse(queries), COARSE, shortlist, keys=["bucket"], second=STORED)


def probe_list(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """query_id, bucket, cluster_id, d, rn of the nprobe (1 to 512) nearest clusters of each query, by coarse distance."""
    nprobe = bounded(nprobe, PROBES)
    points = centroids.select(F.col("cluster_id").alias("ref_id"), F.lit(False).alias("fraud"), "bucket", *[F.col(f"e{i}") for i in features.STORED])
    found = nearest(points, with_coarse(queries), COARSE, nprobe, keys=["bucket"], skip_self=False)
    return queries.select("query_id", "bucket").join(found, "query_id").select("query_id", "bucket", F.col("ref_id").alias("cluster_id"), "d", "rn")


def search_clusters(points: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int = 6, shortlist: int = 16, k: int = features.K, slice_rows: int = SLICE_ROWS, ref_rows: int = REF_ROWS) -> DataFrame:
    """The k nearest of the points in the nprobe nearest clusters, over a coarse shortlist (5 to 64).

    A query goes once to each part of its bucket's clusters, with the list of those it probes there, and in slices of
    bounded size; so a group grows neither with the number of probes nor with that of queries.
    """
    shortlist = bounded(shortlist, SHORTLIST)
    spark = points.sparkSession
    queries = with_coarse(queries).select("query_id", "bucket", *COARSE, *STORED).checkpoint()
    n, kinds, most = _most(points, ["bucket"])
    n_asked, _, most_asked = _most(queries, ["bucket"])
    tasks = spark.sparkContext.defaultParallelism
    s = max(1, -(-most // ref_rows), min(-(-tasks // kinds), -(-most // 4096)))
    t = max(1, -(-most_asked * bounded(nprobe, PROBES) // (32 * s * slice_rows)), -(-most_asked // slice_rows))
    part = F.pmod(F.xxhash64("cluster_id"), F.lit(s)).cast("int")
    lists = probe_list(queries, centroids, nprobe).select("query_id", part.alias("_s"), "cluster_id").groupBy("query_id", "_s").agg(F.sort_array(F.collect_list("cluster_id")).alias("_probes"))
    asked = queries.join(lists, "query_id").withColumn("_t", F.pmod(F.xxhash64("query_id"), F.lit(t)).cast("int"))
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
    stored = with_coarse(points).select("ref_id", F.col("fraud").cast("int").alias("fraud"), "bucket", "cluster_id", *COARSE, *STORED, part.alias("_s"))
    stored = stored.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(t - 1))))
    by = ["bucket", "_s", "_t"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _met_clusters(left, right, shortlist)

    found = stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(meet, _FOUND)
    order = Window.partitionBy("query_id").orderBy("d", "ref_id")
    return rerank(found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= shortlist), k)


def _met_clusters(points: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k coarsely nearest points of each asked row, of those in the clusters on its list."""
    out = [np.empty(0, np.int64)] * 5
    if points.num_rows and asked.num_rows:
        points = points.sort_by([("cluster_id", "ascending"), ("ref_id", "ascending")])
        ref, fraud, cluster = (points[c].to_numpy().astype(np.int64) for c in ("ref_id", "fraud", "cluster_id"))
        e, q = (_matrix(points, x, np.float64) for x in (COARSE, STORED))
        ids, at, exact = asked["query_id"].to_numpy().astype(np.int64), _matrix(asked, COARSE, np.float64), _matrix(asked, STORED, np.float64)
        lists = asked["_probes"].combine_chunks()
        sizes, probes = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(ids)), sizes)
        by = np.argsort(probes, kind="stable")
        rows, probes = rows[by], probes[by]
        numbers, first = np.unique(probes, return_index=True)
        ends, start, stop = np.r_[first[1:], len(probes)], np.searchsorted(cluster, numbers), np.searchsorted(cluster, numbers, "right")
        held: list[tuple] = []
        kept = [np.empty(0, np.int64)] * 3
        waiting = 0
        for a, b, x, y in zip(first, ends, start, stop, strict=True):
            if x == y:
                continue
            r = e[x:y]
            rr = (r * r).sum(axis=1)
            step = max(1, _CELLS // (y - x))
            for c in range(a, b, step):
                own = rows[c : min(b, c + step)]
                d = (at[own] ** 2).sum(axis=1)[:, None] + rr - 2.0 * (at[own] @ r.T)
                d[ids[own][:, None] == ref[x:y]] = np.inf
                limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if y - x > k else np.inf
                i, j = np.nonzero((d <= limit) & np.isfinite(d))
                held.append((own[i], d[i, j].astype(np.int64), x + j))
                waiting += len(i)
                if waiting > _CELLS // 4:
                    kept, held, waiting = _nearest_of([kept, *held], ref, k), [], 0
        row, near, place = _nearest_of([kept, *held], ref, k)
        delta = np.empty(len(row), np.int64)
        for c in range(0, len(row), _CELLS // 8):
            z = slice(c, c + _CELLS // 8)
            delta[z] = ((q[place[z]] - exact[row[z]]) ** 2).sum(axis=1).astype(np.int64)
        out = [ids[row], near, ref[place], fraud[place], delta]
    return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "d", "ref_id", "fraud", "d2"])


def _nearest_of(parts: list, ref: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest (row, distance, place) of each row."""
    row, near, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    best = _best(row, near, ref[place], k)
    return [x[best] for x in (row, near, place)]


def search_adaptive(points: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int = 6, confirm: int = 192, shortlist: int = 16) -> DataFrame:
    """Votes at nprobe; queries with 1 to 4 frauds, or 5 and an extreme profile, are searched again at confirm."""
    shared_dir(points.sparkSession)
    first = vote(queries, search_clusters(points, centroids, queries, nprobe, shortlist)).checkpoint()  # read for the flags and for the result
    flagged = first.join(queries.select("query_id", "extreme"), "query_id")
    again = F.col("frauds").between(1, features.K - 1) | ((F.col("frauds") == features.K) & F.col("extreme"))
    if not 0 < nprobe < confirm:
        return first.withColumn("confirmed", F.lit(False))
    chosen = queries.join(flagged.where(again).select("query_id"), "query_id", "left_semi")
    second = vote(chosen, search_clusters(points, centroids, chosen, confirm, shortlist)).withColumn("confirmed", F.lit(True))
    kept = first.join(second.select("query_id"), "query_id", "left_anti").withColumn("confirmed", F.lit(False))
    return kept.unionByName(second)
