"""Searches against plain numpy, small buckets, slices, the index and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorix.functions import features
from quorix.operators import cells, index, search
from quorix.plans import queries
from quorix.plans.queries import _payloads
from quorix.session import new_folder
from quorix.sources import fixtures
from quorix.streaming import scorer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair(spark):
    refs = fixtures.vectors(spark, SF).cache()
    return refs, refs.where("ref_id % 20 = 0").withColumnRenamed("ref_id", "query_id")


def brute(refs, queries, dims, k, same_bucket):
    rows = refs.collect()
    out = {}
    for q in queries.collect():
        near = sorted((sum((q[d] - r[d]) ** 2 for d in dims), r["ref_id"]) for r in rows if r["ref_id"] != q["query_id"] and (not same_bucket or r["bucket"] == q["bucket"]))
        out[q["query_id"]] = near[:k]
    return out


def listed(found):
    out = {}
    for r in found.orderBy("query_id", "rn").collect():
        out.setdefault(r["query_id"], []).append((r["d"], r["ref_id"]))
    return out


@pytest.mark.parametrize("same", [False, True])
def test_exact_search(pair, same):
    refs, queries = pair
    found = search.search_bucket(refs, queries) if same else search.search_full(refs, queries)
    expected = brute(refs, queries, search.STORED if same else search.FULL, 5, same)
    assert listed(found) == {q: n for q, n in expected.items() if n}


def test_slices_give_the_same(pair):
    refs, queries = pair
    few = search.nearest(refs, queries, search.FULL, 5, slice_rows=7)
    assert listed(few) == listed(search.search_full(refs, queries))


def test_equal_distances_go_to_the_smaller_id(spark):
    refs = spark.range(50).select(F.col("id").alias("ref_id"), F.lit(False).alias("fraud"), F.lit(1).alias("q0"))
    queries = spark.createDataFrame([(1000, 1)], "query_id long, q0 int")
    assert [x[1] for x in listed(search.nearest(refs, queries, ["q0"], 5))[1000]] == [0, 1, 2, 3, 4]


def test_few_or_no_neighbours(spark, pair):
    refs, queries = pair
    lone = queries.limit(1).withColumn("bucket", F.lit(99)).withColumn("query_id", F.lit(-5).cast("long"))
    got = search.vote(lone, search.search_bucket(refs, lone)).first()
    assert (got.frauds, got.found, got.approved, got.score) == (0, 0, True, 0.0)


def test_more_probes_never_find_less(pair):
    refs, queries = pair
    points, centroids = index.build(refs, target=20, iterations=1, spread=False)
    full = {(r.query_id, r.ref_id) for r in search.search_bucket(refs, queries).collect()}
    hits = [len(full & {(r.query_id, r.ref_id) for r in search.search_clusters(points, centroids, queries, p, 64).collect()}) for p in (1, 4, 192)]
    assert hits == sorted(hits) and hits[-1] >= 0.9 * len(full)


def test_assignment_in_slices(pair):
    refs, _ = pair
    seeds = index.strided_seeds(refs, 20)
    a = {r.ref_id: (r.cluster_id, r.d) for r in index.assign(refs, seeds).collect()}
    b = {r.ref_id: (r.cluster_id, r.d) for r in index.assign(refs, seeds, slice_rows=9).collect()}
    assert a == b


def test_ranks_match_a_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 13).alias("k"), (F.col("id") * 104729 % 1009).alias("v"))
    got = {(r.k, r.v): r.rank_in_key for r in index.ranked(df, "k", "v").collect()}
    groups = {}
    for k, v in sorted(got):
        assert got[k, v] == groups.setdefault(k, 0)
        groups[k] += 1


def test_index_tables(spark, pair):
    refs, _ = pair
    points, centroids = index.build(refs, iterations=2)
    path = new_folder(spark, "index")
    index.write(points, centroids, path)
    again, centres = index.read(spark, path)
    assert again.count() == refs.count() and centres.count() == centroids.count()
    spark.read.parquet(f"{path}/meta").withColumn("version", F.lit(99)).write.parquet(f"{path}2/meta")
    with pytest.raises(ValueError):
        index.read(spark, f"{path}2")


def test_searches_over_the_full_index(spark, monkeypatch):
    # All six over one index with the defaults of build(), against plain numpy.
    folder, how = "/root/testdata/sf0.01", []
    built = queries._index(spark, folder)
    monkeypatch.setattr(queries, "_index", lambda spark, sf_dir, **kw: how.append(kw) or built)
    run = lambda name: queries.QUERIES[f"{name}_built"](spark, folder).collect()
    refs, asked, points, centroids = built
    table = lambda df, names: np.array(df.select(*names).collect(), np.int64)
    centres = table(centroids, ["bucket", "cluster_id", *search.COARSE])
    stored = table(search.with_coarse(points), ["bucket", "cluster_id", "ref_id", F.col("fraud").cast("int"), *search.COARSE, *search.STORED])
    wanted = table(search.with_coarse(asked), ["query_id", "bucket", *search.COARSE, *search.STORED])
    n = len(search.COARSE)

    def found(q, probes):
        near = centres[centres[:, 0] == q[1]]
        order = np.lexsort((near[:, 1], ((near[:, 2:] - q[2 : 2 + n]) ** 2).sum(1)))[:probes]
        own = stored[(stored[:, 0] == q[1]) & np.isin(stored[:, 1], near[order, 1])]
        scanned, own = len(own), own[own[:, 2] != q[0]]
        own = own[np.lexsort((own[:, 2], ((own[:, 4 : 4 + n] - q[2 : 2 + n]) ** 2).sum(1)))[:16]]
        own = own[np.lexsort((own[:, 2], ((own[:, 4 + n :] - q[2 + n :]) ** 2).sum(1)))[:5]]
        return near[order, 1].tolist(), scanned, own[:, 2].tolist(), int(own[:, 3].sum())

    want = {int(q[0]): found(q, 6) for q in wanted}
    assert centres.shape[0] > 50 and max(len(x[0]) for x in want.values()) == 6
    assert {(r.query_id, r.rn, r.cluster_id) for r in run("ivf_probe_list")} == {(q, i + 1, c) for q, x in want.items() for i, c in enumerate(x[0])}
    assert {r.query_id: r.frauds for r in run("ivf_knn")} == {q: x[3] for q, x in want.items()}
    assert run("ivf_scan_counters")[0].points == sum(x[1] for x in want.values())
    full = search.search_full(refs, asked).select("query_id", "ref_id").collect()
    recall = run("recall_ivf")[0]
    assert (recall.wanted, recall.found) == (len(full), sum(r.ref_id in want[r.query_id][2] for r in full))
    assert {r.bucket: (r.cnt, r.clusters) for r in run("index_roundtrip")} == {b: ((stored[:, 0] == b).sum(), (centres[:, 0] == b).sum()) for b in set(stored[:, 0].tolist())}
    again = {int(q[0]): found(q, 192)[3] for q in wanted}
    adaptive = run("adaptive_policy")
    assert {r.query_id: r.frauds for r in adaptive} == {r.query_id: again[r.query_id] if r.confirmed else want[r.query_id][3] for r in adaptive}
    assert len(adaptive) == len(want) and any(r.confirmed for r in adaptive) and how == [{}] * 6


def test_stream_equals_batch(spark, pair):
    refs, _ = pair
    source, target, marks = (new_folder(spark, x) for x in ("in", "out", "marks"))
    requests = _payloads(spark, SF).where("request_id % 20 = 0")
    requests.repartition(3).write.parquet(source)
    scorer.start(spark, source, target, marks, refs).awaitTermination()
    got = spark.read.parquet(target).drop("batch").orderBy("request_id").collect()
    assert got == scorer.score_payloads(requests, refs).orderBy("request_id").collect() and len(got) > 10
    assert all(r.approved == (r.frauds < features.DENY_AT) for r in got)


def test_kernel_distances_are_exact():
    a, b = np.full(14, 10000.0), np.full(14, -10000.0)
    assert (a * a).sum() + (b * b).sum() - 2 * (a @ b) == 14 * 20000**2


def test_ranks_of_wide_rows_in_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        wide = spark.range(400_000).select((F.col("id") % 16).alias("bucket"), F.col("id").alias("ref_id"), *[(F.col("id") * (i + 3) % 1009).alias(f"c{i}") for i in range(14)])
        bad = index.ranked(wide, "bucket", "ref_id").agg(F.count("*"), F.count_if(F.col("rank_in_key") != F.expr("ref_id div 16"))).first()
        assert tuple(bad) == (400_000, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocked_join_gives_the_same(pair):
    refs, queries = pair
    for keys, dims in (((), search.FULL), (("bucket",), search.STORED)):
        plain = search.nearest(refs, queries, dims, 5, keys=keys)
        assert listed(search.nearest(refs, queries, dims, 5, keys=keys, slice_rows=3, ref_rows=40)) == listed(plain)


def test_spread_seeds_are_as_many_as_clusters(spark):
    # Equal points give oversampling one candidate a bucket; others fill up.
    refs = spark.range(400).select(F.col("id").alias("ref_id"), (F.col("id") % 2).cast("int").alias("bucket"), *[F.lit(7).alias(c) for c in search.STORED])
    got = index.spread_seeds(refs, target=20).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("ref_id").alias("ids"), F.max("cluster_id").alias("top")).collect()
    assert {(r.bucket, r.n, r.ids, r.top) for r in got} == {(0, 10, 10, 9), (1, 10, 10, 9)}


def test_bounds_of_parameters(pair):
    refs, queries = pair
    assert search.search_coarse(refs, queries, 1).groupBy("query_id").count().agg(F.max("count")).first()[0] == 5
    assert search.bounded(1000, search.SHORTLIST) == 64 and search.bounded(0, search.PROBES) == 1 and search.bounded(600, search.PROBES) == 512


def test_groups_without_queries(spark):
    # Every second key has references and no query, every third a query and no reference.
    refs = spark.range(600).select(F.col("id").alias("ref_id"), F.lit(False).alias("fraud"), (F.col("id") % 12).cast("int").alias("bucket"), (F.col("id") * 37 % 101).cast("int").alias("q0"))
    asked = refs.where("bucket % 2 = 0 and ref_id % 20 = 0").drop("fraud").withColumnRenamed("ref_id", "query_id")
    lone = asked.limit(1).select(F.lit(9001).cast("long").alias("query_id"), F.lit(77).alias("bucket"), "q0")
    found = search.nearest(refs, asked.unionByName(lone), ["q0"], 5, keys=["bucket"], slice_rows=3, ref_rows=40)
    assert listed(found) == brute(refs, asked, ["q0"], 5, True)


def test_full_search_of_many_queries_goes_through_buckets(pair):
    refs, queries = pair
    wide = refs.where("bucket in (0, 3, 13) or ref_id < 60")  # small buckets look elsewhere
    asked = wide.where("ref_id % 3 = 0").withColumnRenamed("ref_id", "query_id")
    got = search.nearest(wide, asked, search.FULL, 5, slice_rows=7, near="bucket")
    assert listed(got) == brute(wide, asked, search.FULL, 5, False)


@pytest.mark.parametrize(("n", "k", "most"), [(4000, 5, 10000), (3000, 17, 127), (2000, 6, 1), (3, 5, 4), (1, 1, 2)])
def test_cells_find_what_a_sort_finds(n, k, most):
    r = np.random.default_rng(n)
    points, asked = (r.integers(-most, most + 1, (m, 7)).astype(float) for m in (n, 300))
    d = ((asked[:, None] - points[None]) ** 2).sum(2).astype(np.int64)
    order = np.lexsort((np.broadcast_to(np.arange(n), d.shape), d), axis=1)[:, :k]
    place, near = cells.nearest(asked, points, k)
    m = min(n, k)
    assert (place[:, :m] == order).all() and (near[:, :m] == np.take_along_axis(d, order, 1)).all() and (place[:, m:] == -1).all()


def test_blocked_join_of_one_table(spark):
    # References and queries of one checkpoint, as the registered queries have them.
    refs, asked = queries._pair(spark, SF)
    for keys, dims in (((), search.FULL), (("bucket",), search.STORED)):
        found = search.nearest(refs, asked, dims, 5, keys=keys, slice_rows=3, ref_rows=40)
        want = brute(refs, asked, dims, 5, bool(keys))
        assert listed(found) == want
        # A vote reads some of the columns only.
        assert {r.query_id: r.found for r in search.vote(asked, found).collect()} == {q: len(n) for q, n in want.items()}


def test_groups_of_clusters_are_bounded(pair):
    # A group's queries grow neither with the probes nor with the queries, and slices give the same.
    refs, asked = pair
    points, centroids = index.build(refs, target=20, iterations=1, spread=False)
    points = points.checkpoint()
    plain = search.search_clusters(points, centroids, asked, 192, 64)
    sliced = search.search_clusters(points, centroids, asked, 192, 64, slice_rows=5, ref_rows=40)
    whole = lambda df: sorted(map(tuple, df.select("query_id", "ref_id", "d2", "rn").collect()))
    assert whole(plain) == whole(sliced) and len(whole(plain)) > 100


def test_only_large_keys_are_cut(pair):
    # A key of one part is searched once; before, all keys had as many parts as the largest.
    refs, asked = pair
    parts = {r.bucket: r._parts for r in search.with_parts(refs, refs, ["bucket"], 40, 1).collect()}
    counts = {r.bucket: r["count"] for r in refs.groupBy("bucket").count().collect()}
    assert parts == {b: -(-n // 40) for b, n in counts.items()} and min(parts.values()) < max(parts.values())
    found = search.nearest(refs, asked, search.STORED, 5, keys=["bucket"], slice_rows=3, ref_rows=40)
    want = brute(refs, asked, search.STORED, 5, True)
    assert listed(found) == {q: n for q, n in want.items() if n}


def test_cells_of_far_apart_and_equal_rows():
    # Equal rows, coordinates that hardly vary and numbers that 32 bits cannot hold.
    r = np.random.default_rng(5)
    points = np.c_[r.integers(0, 2, 3000) * 5_000_000, r.integers(0, 3, 3000), r.integers(0, 40, 3000) * 100, np.full(3000, 7)].astype(float)
    asked = points[::7] + r.integers(-1, 2, (len(points[::7]), 4))
    d = ((asked[:, None] - points[None]) ** 2).sum(2).astype(np.int64)
    order = np.lexsort((np.broadcast_to(np.arange(3000), d.shape), d), axis=1)[:, :9]
    place, near = cells.nearest(asked, points, 9)
    assert (place == order).all() and (near == np.take_along_axis(d, order, 1)).all()


def test_assignment_from_an_earlier_centre():
    r = np.random.default_rng(3)
    points, asked = (r.integers(0, most, (n, 5)).astype(float) for n, most in ((500, 30), (4000, 30)))
    points[1::9] = points[::9][: len(points[1::9])]  # equal centres: the lowest counts
    place, d = cells.nearest(asked, points, 1)
    for start in (place[:, 0], r.integers(0, 500, 4000), np.zeros(4000, int)):
        got, near = cells.nearest_from(asked, points, start)
        assert (got == place[:, 0]).all() and (near == d[:, 0]).all()


def test_a_build_starts_from_earlier_centres(pair, monkeypatch):
    refs, _ = pair
    listed_ = lambda built: [sorted(map(tuple, df.select(*names).collect())) for df, names in zip(built, (["ref_id", "cluster_id"], ["bucket", "cluster_id", *search.STORED]), strict=True)]
    kept = listed_(index.build(refs, target=20, iterations=5))
    monkeypatch.setattr(index, "KEPT", ())
    assert kept == listed_(index.build(refs, target=20, iterations=5))
    seeds = index.strided_seeds(refs, 20)
    cold = index.assign(refs, seeds)
    warm = index.assign(refs.withColumn(index.LAST, F.col("ref_id") % 3), seeds)
    assert sorted(cold.columns) == sorted(warm.columns) and {tuple(x) for x in cold.select("ref_id", "cluster_id", "d").collect()} == {tuple(x) for x in warm.select("ref_id", "cluster_id", "d").collect()}


def test_a_far_start_holds_no_matrix_of_all_pairs():
    import tracemalloc

    r = np.random.default_rng(4)
    points, asked = (r.integers(0, 10000, (n, 6)).astype(float) for n in (4000, 20000))
    tracemalloc.start()
    got, near = cells.nearest_from(asked, points, np.zeros(20000, int))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    place, d = cells.nearest(asked, points, 1)
    assert (got == place[:, 0]).all() and (near == d[:, 0]).all() and peak < 250_000_000
