"""Clustered index of the references: cluster counts, seeds, Lloyd steps, tables on disk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorix.functions import features
from quorix.operators import cells
from quorix.operators.search import REF_ROWS, STORED, salted
from quorix.session import shared_dir

#: A column of references: the centre of an earlier assignment, from which the next one starts.
LAST = "_last"
FORMAT, VERSION, TARGET, BUCKETS = "quorix-index", 1, 75, 16


def cluster_count(points: Column, target: int = TARGET) -> Column:
    """Rounded points / target, at least 1 and at most points."""
    wanted = F.floor((points + target // 2) / target)
    return F.least(points, F.greatest(F.lit(1).cast("long"), wanted)).cast("long")


def cluster_sizes(refs: DataFrame, target: int = TARGET) -> DataFrame:
    return refs.groupBy("bucket").agg(F.count("*").alias("cnt")).withColumn("clusters", cluster_count(F.col("cnt"), target))


def ranked(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with rank_in_key from 0, without a window over a key: rows are placed by range, numbered in their
    partition, and shifted by what earlier partitions hold of the key. Places are written down before they are used twice:
    planned twice, the same rows may lie in other partitions."""
    shared_dir(df.sparkSession)
    placed = df.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint()
    counts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(shift, [key, "_part"]).withColumn("rank_in_key", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def strided_seeds(refs: DataFrame, target: int = TARGET) -> DataFrame:
    """bucket, cluster_id, ref_id and coordinates: seed j of a bucket is its point number j * points div clusters."""
    sizes = cluster_sizes(refs, target)
    seeds = sizes.select("bucket", "cnt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("clusters") - 1)).alias("cluster_id"), "clusters")
    seeds = seeds.withColumn("rank_in_key", F.expr("cluster_id * cnt div clusters")).select("bucket", "cluster_id", "rank_in_key")
    # Ranks need the ids alone; coordinates are read for the seeds only.
    chosen = ranked(refs.select("bucket", "ref_id"), "bucket", "ref_id").join(seeds, ["bucket", "rank_in_key"]).select(F.col("ref_id").alias("_seed"), "cluster_id")
    return refs.join(chosen, F.col("ref_id") == F.col("_seed")).select("bucket", "cluster_id", "ref_id", *STORED)


def _nearest_centres(points: np.ndarray, bucket: np.ndarray, centres: dict, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point's bucket and its distance; equal distances: the lowest centre. last: the number of a
    centre that is likely close."""
    cluster, distance = np.zeros(len(bucket), np.int64), np.full(len(bucket), np.iinfo(np.int64).max)
    for b in np.unique(bucket):
        rows = np.flatnonzero(bucket == b)
        ids, at = centres.get(int(b), (None, None))
        if ids is None:
            continue
        if last is None:
            place, d = (x[:, 0] for x in cells.nearest(points[rows], at, 1))
        else:
            place, d = cells.nearest_from(points[rows], at, np.minimum(np.searchsorted(ids, last[rows]), len(ids) - 1))
        cluster[rows], distance[rows] = ids[place], d
    return cluster, distance


def _centres(table: pa.Table) -> dict:
    """For each bucket the sorted ids of its centres and their coordinates."""
    ids, bucket = table["cluster_id"].to_numpy().astype(np.int64), table["bucket"].to_numpy()
    at = np.stack([table[c].to_numpy() for c in STORED], axis=1).astype(np.float64)
    out = {}
    for b in np.unique(bucket):
        rows = np.flatnonzero(bucket == b)
        rows = rows[np.argsort(ids[rows])]
        out[int(b)] = (ids[rows], at[rows])
    return out


def _with_nearest(table: pa.Table, centres: dict) -> pa.Table:
    points = np.stack([table[c].to_numpy() for c in STORED], axis=1).astype(np.float64)
    last = table[LAST].to_numpy() if LAST in table.column_names else None
    cluster, distance = _nearest_centres(points, table["bucket"].to_numpy(), centres, last)
    if last is not None:
        table = table.drop_columns([LAST])
    return table.append_column("cluster_id", pa.array(cluster)).append_column("d", pa.array(distance))


def assign(refs: DataFrame, centroids: DataFrame, slice_rows: int = 200_000) -> DataFrame:
    """refs with cluster_id and d of the nearest centroid in their bucket.

    Up to slice_rows centroids, by count, are broadcast and refs stay where they lie. More are cut in parts: each part of a
    bucket's points meets each part of its centroids in a group, and each point keeps the best of its groups. With broadcast
    centroids the search of a point starts from its LAST centre, if refs have it.
    """
    kept = [c for c in refs.columns if c not in (*STORED, "bucket", LAST)]
    layout, centres = refs.select(*kept, "bucket", *STORED), centroids.select(*[F.col(c).alias(c) for c in ("bucket", "cluster_id", *STORED)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout.schema.fields) + ", cluster_id long, d long"
    if centres.count() <= slice_rows:
        shared = refs.sparkSession.sparkContext.broadcast(_centres(centres.toArrow()))
        start = refs.select(*layout.columns, LAST) if LAST in refs.columns else layout
        return start.mapInArrow(_assigner(shared), schema)
    most = lambda df: df.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    s, t = max(1, -(-most(layout) // REF_ROWS)), max(1, -(-most(centres) // slice_rows))
    a, b = salted(layout, "ref_id", "_s", s, "_t", t), salted(centres, "cluster_id", "_t", t, "_s", s)
    names = layout.columns

    def meet(points: pa.Table, centres: pa.Table) -> pa.Table:
        if not points.num_rows:
            return points.select(names).append_column("cluster_id", pa.array([], pa.int64())).append_column("d", pa.array([], pa.int64()))
        return _with_nearest(points.select(names), _centres(centres) if centres.num_rows else {})

    every = a.groupBy("bucket", "_s", "_t").cogroup(b.groupBy("bucket", "_s", "_t")).applyInArrow(meet, schema)
    if t == 1:
        return every
    best = every.groupBy("ref_id").agg(F.min(F.struct("d", "cluster_id")).alias("_b"))
    return layout.join(best, "ref_id").select(*names, F.col("_b.cluster_id").alias("cluster_id"), F.col("_b.d").alias("d"))


#: Points that are assigned at once.
AT_ONCE = 100_000


def _assigner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= AT_ONCE:
                yield from _with_nearest(pa.Table.from_batches(held), shared.value).to_batches(4000)
                held = []
        if held:
            yield from _with_nearest(pa.Table.from_batches(held), shared.value).to_batches(4000)

    return run


def gathered(refs: DataFrame) -> DataFrame:
    """refs dealt so that close points lie in one partition: by bucket, then by the leading bits of all coordinates, mixed."""
    refs = refs.checkpoint()
    tasks = max(2 * refs.sparkSession.sparkContext.defaultParallelism, -(-refs.count() // AT_ONCE))
    if tasks <= 2 * refs.sparkSession.sparkContext.defaultParallelism:
        return refs
    level = {c: F.greatest(F.lit(0), F.least(F.lit(15), (F.col(c) * 16 / (features.SCALE + 1)).cast("int"))).cast("long") for c in STORED}
    bits = [F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")) for b in (3, 2, 1, 0) for x in level.values()]
    mixed = F.lit(0).cast("long")
    for i, bit in enumerate(reversed(bits)):
        mixed = mixed + F.shiftleft(bit, i)
    return refs.withColumn("_z", mixed).repartitionByRange(tasks, "bucket", "_z").sortWithinPartitions("bucket", "_z").drop("_z").checkpoint()


def centroid_means(assigned: DataFrame) -> DataFrame:
    """bucket, cluster_id, n_points and the mean of each coordinate, half away from zero."""
    means = [F.round(F.sum(c).cast("double") / F.count("*")).cast("int").alias(c) for c in STORED]
    return assigned.groupBy("bucket", "cluster_id").agg(F.count("*").alias("n_points"), *means)


def lloyd_step(refs: DataFrame, centroids: DataFrame, reseed: int | None = None, assigned: DataFrame | None = None) -> DataFrame:
    """Centroids after one step. A cluster without points keeps its place, or with `reseed` moves to a point of its
    bucket that a hash of the number picks. assigned: refs with the nearest of the centroids, where it is known."""
    means = centroid_means(assign(refs, centroids) if assigned is None else assigned).withColumnRenamed("cluster_id", "_c").withColumnRenamed("bucket", "_b")
    means = means.select("_b", "_c", "n_points", *[F.col(c).alias(f"_{c}") for c in STORED])
    joined = centroids.join(means, (F.col("bucket") == F.col("_b")) & (F.col("cluster_id") == F.col("_c")), "left")
    moved = joined.select("bucket", "cluster_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), *[F.coalesce(f"_{c}", c).alias(c) for c in STORED])
    if reseed is None:
        return moved
    picked = refs.groupBy(F.col("bucket").alias("_b")).agg(F.min_by(F.struct(*STORED), F.xxhash64("ref_id", F.lit(reseed))).alias("_p"))
    return moved.join(picked, F.col("bucket") == F.col("_b"), "left").select("bucket", "cluster_id", "n_points", *[F.when(F.col("n_points") == 0, F.col("_p")[c]).otherwise(F.col(c)).alias(c) for c in STORED])


def spread_seeds(refs: DataFrame, target: int = TARGET, rounds: int = 4, seed: int = 1) -> DataFrame:
    """k-means++ seeding as rounds of oversampling: a point becomes a candidate with a chance in proportion to its
    squared distance from the candidates so far, decided by a hash. A bucket's heaviest candidates are its seeds; where
    they are too few, other points of the bucket follow in the order of their hash."""
    sizes = F.broadcast(cluster_sizes(refs, target))  # a row for each of 16 buckets
    first = refs.groupBy("bucket").agg(F.min_by(F.struct("ref_id", *STORED), F.xxhash64("ref_id", F.lit(seed))).alias("p"))
    candidates = first.select("bucket", F.col("p.ref_id").alias("cluster_id"), *[F.col("p")[c].alias(c) for c in STORED]).checkpoint()
    points = refs.select("ref_id", "bucket", *STORED)
    for r in range(rounds):
        near = assign(points, candidates).checkpoint()  # read for the sum and for the draw
        points = near.select("ref_id", "bucket", *STORED, F.col("cluster_id").alias(LAST))
        weight = F.broadcast(near.groupBy("bucket").agg(F.sum(F.col("d").cast("double")).alias("w")))
        chance = 2.0 * F.col("clusters") * F.col("d") / (rounds * F.col("w"))
        luck = F.pmod(F.xxhash64("ref_id", F.lit(seed * 1000 + r)), F.lit(1 << 30)) / float(1 << 30)
        fresh = near.drop("cluster_id").join(sizes, "bucket").join(weight, "bucket").where((F.col("d") > 0) & (luck < chance))
        candidates = candidates.unionByName(fresh.select("bucket", F.col("ref_id").alias("cluster_id"), *STORED)).checkpoint()
    weights = assign(points, candidates).groupBy("bucket", "cluster_id").agg(F.count("*").alias("n"))
    heavy = candidates.select("bucket", "cluster_id").join(weights, ["bucket", "cluster_id"], "left")
    others = points.select("bucket", "ref_id").join(candidates.select(F.col("cluster_id").alias("ref_id")), "ref_id", "left_anti")
    others = others.select("bucket", F.col("ref_id").alias("cluster_id"), F.struct(F.lit(1).alias("late"), F.xxhash64("ref_id", F.lit(seed)).alias("by"), F.col("ref_id").alias("id")).alias("_o"))
    # Only buckets that are short of candidates take others.
    short = candidates.groupBy("bucket").agg(F.count("*").alias("c")).join(sizes, "bucket").where("c < clusters").select("bucket")
    every = heavy.select("bucket", "cluster_id", F.struct(F.lit(0).alias("late"), (-F.coalesce("n", F.lit(0))).cast("long").alias("by"), F.col("cluster_id").alias("id")).alias("_o"))
    every = every.unionByName(others.join(F.broadcast(short), "bucket", "left_semi"))
    chosen = ranked(every, "bucket", "_o").join(sizes.select("bucket", "clusters"), "bucket").where("rank_in_key < clusters")
    chosen = chosen.select(F.col("cluster_id").alias("_seed"), F.col("rank_in_key").cast("long").alias("cluster_id"))
    return refs.join(chosen, F.col("ref_id") == F.col("_seed")).select("bucket", "cluster_id", "ref_id", *STORED)


def with_coarse_centres(centroids: DataFrame) -> DataFrame:
    return centroids.withColumns({f"e{i}": features.quantize8(F.col(f"q{i}")) for i in features.STORED})


#: Steps of a build whose assignment is written down, so that the later ones start from it.
KEPT = (0, 3)


def build(refs: DataFrame, target: int = TARGET, iterations: int = 12, spread: bool = True) -> tuple[DataFrame, DataFrame]:
    """(points with cluster_id, centroids with coarse coordinates); each step is cut by a checkpoint."""
    refs = gathered(refs)
    seeds = spread_seeds(refs, target) if spread else strided_seeds(refs, target)
    centroids = seeds.select("bucket", "cluster_id", *STORED).checkpoint()
    for i in range(iterations):
        known = None
        if i in KEPT:
            known = assign(refs, centroids).drop("d").checkpoint()
            refs = known.withColumnRenamed("cluster_id", LAST)
        centroids = lloyd_step(refs, centroids, i + 1 if spread else None, known).select("bucket", "cluster_id", *STORED).checkpoint()
    return assign(refs, centroids).drop("d"), with_coarse_centres(centroids)


def write(points: DataFrame, centroids: DataFrame, path: str) -> None:
    """Points by bucket, sorted by cluster and id so that row groups can be skipped; centroids; one row of facts."""
    points.repartition("bucket", "cluster_id").sortWithinPartitions("bucket", "cluster_id", "ref_id").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/points")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    facts = points.agg(F.count("*").alias("nrefs")).crossJoin(centroids.agg(F.count("*").alias("nclust")))
    facts.select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(len(features.STORED)).alias("vdim"), F.lit(BUCKETS).alias("nbuckets"), F.lit(features.SCALE).alias("scale"), "nrefs", "nclust").write.mode("overwrite").parquet(f"{path}/meta")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of an index; one of another layout is refused."""
    facts = spark.read.parquet(f"{path}/meta").first()
    if (facts["format"], facts["version"], facts["vdim"], facts["nbuckets"], facts["scale"]) != (FORMAT, VERSION, len(features.STORED), BUCKETS, features.SCALE):
        raise ValueError(f"{path} is no index of this layout: {facts}")
    return spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/centroids")
