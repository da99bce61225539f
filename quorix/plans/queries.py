"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorix.functions import features
from quorix.operators import index, jobs, metrics, search
from quorix.session import new_folder, shared_dir, ship
from quorix.sources import fixtures, payload
from quorix.streaming import scorer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared_dir(ship(spark))
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


Q16 = [f"q{i}" for i in features.DIMS]


def _requests(spark, sf_dir):
    return fixtures.to_vectors(fixtures.requests(spark, sf_dir))


def _refs(spark, sf_dir):
    return fixtures.vectors(spark, sf_dir)


def _queries(refs: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return refs.where("ref_id % 20 = 0").withColumnRenamed("ref_id", "query_id")


def _pair(spark, sf_dir):
    refs = _refs(spark, sf_dir).checkpoint()
    return refs, _queries(refs)


@registered
def feature_vector_q14(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", "bucket", *Q16)


@registered
def feature_double_round4(spark, sf_dir):
    r = fixtures.requests(spark, sf_dir)
    v = features.vector({c: F.col(c) for c in r.columns})
    return r.select("request_id", *[features.round4(x).alias(f"v{i}") for i, x in enumerate(v)])


@registered
def bucket_key(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", "bucket")


@registered
def bucket_key_from_vector(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.select("request_id", features.bucket_of_vector([F.col(c) for c in Q16]).alias("bucket"))


@registered
def bucket_counts_offsets(spark, sf_dir):
    counts = _refs(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("cnt"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    return counts.select("bucket", "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0)).cast("long").alias("first"))


@registered
def quantize_int16(spark, sf_dir):
    return fixtures.embedding_vectors(spark, sf_dir).select("ref_id", "bucket", *[f"q{i}" for i in range(64)])


@registered
def quantize_int8(spark, sf_dir):
    e = fixtures.embedding_vectors(spark, sf_dir)
    return e.select("ref_id", *[features.quantize8(F.col(f"q{i}")).alias(f"e{i}") for i in range(64)])


@registered
def mcc_risk_lookup(spark, sf_dir):
    return fixtures.requests(spark, sf_dir).select("request_id", "mcc", features.mcc_risk(F.col("mcc")).alias("risk"))


@registered
def timestamp_parts(spark, sf_dir):
    t = F.col("requested_at")
    return fixtures.requests(spark, sf_dir).select("request_id", features.hour_of(t).alias("hour"), features.weekday_of(t).alias("weekday"), features.epoch_seconds(t).alias("epoch"))


@registered
def minutes_since_last(spark, sf_dir):
    r = fixtures.requests(spark, sf_dir)
    return r.select("request_id", features.minutes_between(F.col("requested_at"), F.col("last_ts")).alias("minutes"))


@registered
def timestamp_fallback(spark, sf_dir):
    t = lambda c: F.translate(c, "-T", "/ ")
    r = fixtures.requests(spark, sf_dir)
    return r.select("request_id", features.hour_of(t("requested_at")).alias("hour"), features.weekday_of(t("requested_at")).alias("weekday"), features.minutes_between(t("requested_at"), t("last_ts")).alias("minutes"))


@registered
def unknown_merchant(spark, sf_dir):
    return fixtures.requests(spark, sf_dir).select("request_id", "unknown_merchant")


@registered
def unknown_merchant_anti_join(spark, sf_dir):
    r = fixtures.requests(spark, sf_dir).select("request_id", "merchant_id", "known_merchants")
    known = r.select("request_id", F.explode("known_merchants").alias("merchant_id"))
    return r.join(known, ["request_id", "merchant_id"], "left_anti").select("request_id")


def _payloads(spark, sf_dir):
    r = fixtures.requests(spark, sf_dir)
    return r.select("request_id", payload.to_payload({c: F.col(c) for c in r.columns}).alias("payload"))


@registered
def parse_payload(spark, sf_dir):
    return payload.parse_requests(_payloads(spark, sf_dir)).select("request_id", "malformed", *payload.FIELDS)


@registered
def parse_malformed_failopen(spark, sf_dir):
    kind, text = F.col("request_id") % 5, F.col("payload")
    broken = F.when(kind == 1, F.lit("")).when(kind == 2, F.expr("left(payload, 40)")).when(kind == 3, F.regexp_replace(text, '"terminal":\\{[^}]*\\}', '"other":{}')).otherwise(text)
    parsed = payload.parse_requests(_payloads(spark, sf_dir).withColumn("payload", broken))
    frauds = F.lit(0)
    return parsed.where("malformed").select("request_id", frauds.alias("frauds"), features.approved(frauds).alias("approved"), features.score(frauds).alias("score"))


@registered
def knn_full_exact(spark, sf_dir):
    refs, queries = _pair(spark, sf_dir)
    return search.vote(queries, search.search_full(refs, queries))


@registered
def knn_bucket_exact(spark, sf_dir):
    refs, queries = _pair(spark, sf_dir)
    return search.vote(queries, search.search_bucket(refs, queries))


@registered
def knn_neighbors(spark, sf_dir):
    refs, queries = _pair(spark, sf_dir)
    return search.search_full(refs, queries).select("query_id", "ref_id", "d", "rn")


@registered
def knn_embeddings(spark, sf_dir):
    refs = fixtures.embedding_vectors(spark, sf_dir)
    return search.nearest(refs, _queries(refs), [f"q{i}" for i in range(64)], features.K).select("query_id", "ref_id", "d", "rn")


@registered
def bucket_xor_distance(spark, sf_dir):
    pair = spark.range(256).select(F.expr("cast(id div 16 as int)").alias("a"), (F.col("id") % 16).cast("int").alias("b"))
    return pair.select("a", "b", features.bucket_gap(F.col("a"), F.col("b")).alias("gap"))


@registered
def knn_coarse_shortlist(spark, sf_dir):
    return search.search_coarse(*_pair(spark, sf_dir)).select("query_id", "ref_id", "d", "rn")


@registered
def knn_coarse_rerank(spark, sf_dir):
    refs, queries = _pair(spark, sf_dir)
    return search.vote(queries, search.rerank(search.search_coarse(refs, queries), features.K))


@registered
def knn_rerank_cap64(spark, sf_dir):
    refs, queries = _pair(spark, sf_dir)
    return search.vote(queries, search.rerank(search.search_coarse(refs, queries, 64), features.K))


@registered
def cluster_sizes(spark, sf_dir):
    return index.cluster_sizes(_refs(spark, sf_dir))


@registered
def kmeans_strided_seed(spark, sf_dir):
    return index.strided_seeds(_refs(spark, sf_dir)).select("bucket", "cluster_id", "ref_id")


@registered
def kmeans_lloyd_step(spark, sf_dir):
    refs = _refs(spark, sf_dir).checkpoint()
    return index.lloyd_step(refs, index.strided_seeds(refs)).select("bucket", "cluster_id", F.col("n_points").cast("long").alias("n_points"), *search.STORED)


@registered
def centroid_mean(spark, sf_dir):
    refs = _refs(spark, sf_dir).checkpoint()
    return index.centroid_means(index.assign(refs, index.strided_seeds(refs))).select("bucket", "cluster_id", "n_points", *search.STORED)


@registered
def kmeans_pp_seed(spark, sf_dir):
    return index.spread_seeds(_refs(spark, sf_dir).checkpoint()).select("bucket", "cluster_id", "ref_id")


@registered
def kmeans_full_build(spark, sf_dir):
    points, _ = index.build(_refs(spark, sf_dir).checkpoint())
    return points.groupBy("bucket", "cluster_id").agg(F.count("*").alias("n_points"))


def _index(spark, sf_dir, **how):
    refs, queries = _pair(spark, sf_dir)
    points, centroids = index.build(refs, **how)
    return refs, queries, points.checkpoint(), centroids


def over_index(f):
    """Registers f over the index that the SQL unrolls (strided seeds, one step), and as NAME_built over build() as it is."""
    for name, how in ((f.__name__, {"iterations": 1, "spread": False}), (f"{f.__name__}_built", {})):

        def run(spark, sf_dir, how=how):
            return f(spark, sf_dir, *_index(spark, sf_dir, **how))

        run.__name__ = name
        registered(run)
    return f


@over_index
def index_roundtrip(spark, sf_dir, refs, queries, points, centroids):
    path = new_folder(spark, "index")
    index.write(points, centroids, path)
    points, centroids = index.read(spark, path)
    clusters = centroids.groupBy("bucket").agg(F.count("*").alias("clusters"))
    return points.groupBy("bucket").agg(F.count("*").alias("cnt"), F.count_if("fraud").alias("frauds")).join(clusters, "bucket").select(F.col("bucket").cast("int").alias("bucket"), "cnt", "frauds", "clusters")


@over_index
def ivf_probe_list(spark, sf_dir, refs, queries, points, centroids):
    return search.probe_list(queries, centroids, 6)


@over_index
def ivf_knn(spark, sf_dir, refs, queries, points, centroids):
    return search.vote(queries, search.search_clusters(points, centroids, queries))


@over_index
def ivf_scan_counters(spark, sf_dir, refs, queries, points, centroids):
    sizes = points.groupBy("bucket", "cluster_id").agg(F.count("*").alias("n"))
    scanned = search.probe_list(queries, centroids, 6).join(sizes, ["bucket", "cluster_id"], "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
    per_bucket = centroids.groupBy("bucket").agg(F.count("*").alias("c"))
    looked = queries.join(per_bucket, "bucket").agg(F.count("*").alias("queries"), F.sum("c").alias("centroids"))
    return looked.crossJoin(scanned)  # one row each


@registered
def confirm_extreme(spark, sf_dir):
    r = _requests(spark, sf_dir)
    hand = spark.createDataFrame([(-1, 13, 8, 3000.0, 200.0, 10, 300.0, 400.0, 50.0, "7995", True), (-2, 13, 11, 3000.0, 200.0, 10, 300.0, 400.0, 50.0, "7995", True)], "request_id long, bucket int, installments int, amount double, cust_avg double, tx_count_24h int, km_home double, last_km double, merch_avg double, mcc string, has_last boolean")
    every = r.select(*hand.columns).unionByName(hand)
    return every.select("request_id", features.is_extreme(F.col("bucket"), {c: F.col(c) for c in every.columns}).alias("extreme"))


@over_index
def adaptive_policy(spark, sf_dir, refs, queries, points, centroids):
    r = _requests(spark, sf_dir).where("request_id % 20 = 0")
    flags = r.select(F.col("request_id").alias("query_id"), features.is_extreme(F.col("bucket"), {c: F.col(c) for c in r.columns}).alias("extreme"))
    return search.search_adaptive(points, centroids, queries.join(flags, "query_id").checkpoint())


def reply(frauds):
    """The reply text; a score of 0 or 1 has no decimals."""
    number = F.element_at(F.array(*[F.lit(x) for x in ("0", "0.2", "0.4", "0.6", "0.8", "1")]), (frauds + 1).cast("int"))
    return F.concat(F.lit('{"approved":'), features.approved(frauds).cast("string"), F.lit(',"fraud_score":'), number, F.lit("}"))


@registered
def decision_reply(spark, sf_dir):
    return knn_bucket_exact(spark, sf_dir).select("query_id", reply(F.col("frauds")).alias("reply"))


def _judged(spark, sf_dir):
    refs, queries = _pair(spark, sf_dir)
    voted = search.vote(queries, search.search_bucket(refs, queries)).join(queries.select("query_id", (~F.col("fraud")).alias("expected")), "query_id")
    return voted.select("expected", "approved", (F.col("query_id") % 97 == 0).alias("failed"))


@registered
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_judged(spark, sf_dir))


@registered
def weighted_errors(spark, sf_dir):
    return metrics.weighted(metrics.confusion(_judged(spark, sf_dir)))


def _six(x):
    return F.round(x * 1000000.0) / 1000000.0


@registered
def detection_score(spark, sf_dir):
    c = metrics.weighted(metrics.confusion(_judged(spark, sf_dir)))
    return c.select(_six(metrics.detection_score(F.col("failures"), F.col("n"), F.col("epsilon"), F.col("e"))).alias("detection_score"))


def _latency(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("value")


@registered
def p99_score(spark, sf_dir):
    return metrics.rank_percentiles(_latency(spark, sf_dir), "value", (0.99,)).select("p99", _six(metrics.p99_score(F.col("p99"))).alias("p99_score"))


@registered
def final_score(spark, sf_dir):
    return detection_score(spark, sf_dir).crossJoin(p99_score(spark, sf_dir)).select(_six(F.col("detection_score") + F.col("p99_score")).alias("final_score"))  # one row each


@registered
def parity_bucket_vs_full(spark, sf_dir):
    refs, queries = _pair(spark, sf_dir)
    inside = search.search_bucket(refs, queries).checkpoint()  # read by both searches
    full = search.vote(queries, search.search_full(refs, queries, inside=inside)).select("query_id", F.col("frauds").alias("f"), F.col("approved").alias("a"))
    both = search.vote(queries, inside).join(full, "query_id")
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("frauds") != F.col("f")).alias("count_mismatch"), F.count_if(F.col("approved") != F.col("a")).alias("approved_mismatch"))


@over_index
def recall_ivf(spark, sf_dir, refs, queries, points, centroids):
    full = search.search_full(refs, queries).select("query_id", "ref_id")
    found = search.search_clusters(points, centroids, queries).select("query_id", "ref_id", F.lit(1).alias("hit"))
    return full.join(found, ["query_id", "ref_id"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


@registered
def latency_rank_percentiles(spark, sf_dir):
    return metrics.rank_percentiles(_latency(spark, sf_dir), "value")


@registered
def latency_interp_percentiles(spark, sf_dir):
    out = metrics.interpolated_percentiles(_latency(spark, sf_dir), "value", (0.5, 0.9, 0.95, 0.99))
    return out.select("n", "max", _six(F.col("avg")).alias("avg"), *[_six(F.col(c)).alias(c) for c in ("p50", "p90", "p95", "p99")])


@registered
def per_bucket_stats(spark, sf_dir):
    r = _requests(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.max("latency_ms").alias("max_ms"), _six(F.avg("latency_ms")).alias("avg_ms"))
    return r


@registered
def dataset_stats(spark, sf_dir):
    s = fixtures.requests(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("fraud").alias("fraud_count"), F.count_if(~F.col("fraud")).alias("legit_count"))
    return s.withColumns({"fraud_rate": F.col("fraud_count") / F.col("total"), "legit_rate": F.col("legit_count") / F.col("total")})


@registered
def topn_limit(spark, sf_dir):
    return fixtures.requests(spark, sf_dir).select("request_id", "amount").orderBy(F.col("amount").desc(), "request_id").limit(100)


@registered
def round_robin_assign(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("request_id"), F.lit(0).alias("_all"))
    return index.ranked(ids, "_all", "request_id").select("request_id", F.pmod("rank_in_key", F.lit(2)).cast("int").alias("backend"))


@registered
def stream_score(spark, sf_dir):
    refs = _refs(spark, sf_dir).checkpoint()
    source, target, marks = (new_folder(spark, x) for x in ("requests", "scores", "stream"))
    _payloads(spark, sf_dir).where("request_id % 20 = 0").repartition(3).write.parquet(source)
    scorer.start(spark, source, target, marks, refs).awaitTermination()
    return spark.read.parquet(target).drop("batch")


@registered
def verify_policy(spark, sf_dir):
    """Every hundredth payload is cut short, every sixtieth has no label."""
    r = fixtures.requests(spark, sf_dir)
    entries = r.select("request_id", payload.to_payload({c: F.col(c) for c in r.columns}).alias("payload"), "fraud").where("request_id % 20 = 0")
    entries = entries.select(F.col("request_id").alias("entry_id"), F.when(F.col("request_id") % 100 == 0, F.expr("left(payload, 40)")).otherwise(F.col("payload")).alias("payload"), F.when(F.col("request_id") % 60 != 0, ~F.col("fraud")).alias("expected_approved"))
    return jobs.verify(entries, _refs(spark, sf_dir).checkpoint())


@registered
def replay_with_wrap(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return jobs.replay(events, "event_id", events.count() + 500)


@registered
def scan_throughput(spark, sf_dir):
    return jobs.throughput(_latency(spark, sf_dir), "value")


CONFUSION = ("tp", "tn", "fp", "fn", "err")


@registered
def metrics_by_name(spark, sf_dir):
    return jobs.metric_rows(metrics.confusion(_judged(spark, sf_dir)), CONFUSION)


@registered
def result_report(spark, sf_dir):
    return jobs.result_json(metrics.confusion(_judged(spark, sf_dir)), CONFUSION)


@registered
def stream_score_index(spark, sf_dir):
    _, _, points, centroids = _index(spark, sf_dir, iterations=1, spread=False)
    path, source, target, marks = (new_folder(spark, x) for x in ("index", "requests", "scores", "stream"))
    index.write(points, centroids, path)
    _payloads(spark, sf_dir).where("request_id % 20 = 0").repartition(2).write.parquet(source)
    scorer.start_over_index(spark, source, target, marks, path).awaitTermination()
    return spark.read.parquet(target).drop("batch")
