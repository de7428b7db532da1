"""Nearest neighbours and cluster assignment over vectors (``id, vector`` and any labels).

Exact search sends the queries to the candidates' tasks in waves of bounded size; each task keeps k rows per
query by matrix products, so distances of pairs are never rows. Where there are several waves, each one's result is checkpointed
and its queries freed before the next. ``approximate`` uses random projections.

Rows without an id, and vectors that are missing, empty or hold missing or infinite components, take no part; queries meet
candidates of their own length only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators import encode
from trajecta.sources import work_folder

#: Numbers in a wave of queries, and candidates that are compared at once.
WAVE_NUMBERS, TOGETHER = 2_000_000, 4096


def usable(df: DataFrame, *keep: str) -> DataFrame:
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("id").isNotNull() & (F.size("vector") > 0) & whole).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *keep)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, same: bool = False) -> DataFrame:
    """``query_id, rank, id, distance``: the k candidates of least Euclidean distance, ties to the smaller id.
    With ``same`` a candidate that has the query's id isn't its neighbour."""
    queries, candidates = usable(queries), usable(candidates)
    sizes = [r[0] for r in queries.select(F.size("vector")).distinct().collect()]
    found = None
    for d in sizes:
        some = _nearest(queries.where(F.size("vector") == d), candidates.where(F.size("vector") == d), d, k, same)
        found = some if found is None else found.unionByName(some)
    return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance double") if found is None else found


def _nearest(queries: DataFrame, candidates: DataFrame, d: int, k: int, same: bool) -> DataFrame:
    spark = queries.sparkSession
    waves = max(1, math.ceil(queries.count() * d / max(WAVE_NUMBERS, d)))
    found = None
    for wave in range(waves):
        own = queries if waves == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave)
        rows = own.collect()
        shared = spark.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.vector for r in rows], np.float64).reshape(len(rows), d)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_d, best_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
            for whole in batches:
                for start in range(0, whole.num_rows, TOGETHER):
                    batch = whole.slice(start, TOGETHER)
                    x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                    here = batch.column("id").to_numpy()
                    for lo in range(0, len(ids), 512):
                        part = slice(lo, lo + 512)
                        square = (q[part] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * q[part] @ x.T
                        if same:
                            square[ids[part][:, None] == here] = np.inf
                        if lo == 0:
                            kept_d, kept_i = [], []
                        some = min(2 * k + 8, square.shape[1])
                        near = np.argpartition(square, some - 1, 1)[:, :some]
                        # the expansion above is inexact; the few nearest are measured again
                        exact = np.sqrt(((q[part][:, None, :] - x[near]) ** 2).sum(2))
                        exact[np.isinf(np.take_along_axis(square, near, 1))] = np.inf
                        d_, i_ = np.concatenate([best_d[part], exact], 1), np.concatenate([best_i[part], here[near]], 1)
                        order = np.lexsort((i_, d_), axis=1)[:, :k]
                        kept_d.append(np.take_along_axis(d_, order, 1))
                        kept_i.append(np.take_along_axis(i_, order, 1))
                    if len(ids):
                        best_d, best_i = np.concatenate(kept_d), np.concatenate(kept_i)
            real = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(best_i[real]), pa.array(best_d[real])], names=["query_id", "id", "distance"])

        order = Window.partitionBy("query_id").orderBy("distance", "id")
        ranked = candidates.mapInArrow(run, "query_id long, id long, distance double").withColumn("rank", F.row_number().over(order))
        some = ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
        if waves > 1:
            spark.sparkContext.setCheckpointDir(work_folder(spark))
            some = some.checkpoint()
            shared.destroy()
        found = some if found is None else found.unionByName(some)
    return found


def approximate(df: DataFrame, k: int, radius: float, bucket: float, tables: int = 5, seed: int = 42) -> DataFrame:
    """``query_id, rank, id, distance`` among pairs that random projections bring together within ``radius``."""
    rows = df.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    pairs = model.approxSimilarityJoin(rows, rows, radius, "distance").where("datasetA.id <> datasetB.id").select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("id"), "distance")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def distance_to(vector: Column, centre: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(vector, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def assign(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Adds ``cluster`` and ``centre_distance``: the nearest of the given centres, ties to the smaller number."""
    vector = F.col("vector").cast("array<double>")
    each = F.array(*(F.struct(distance_to(vector, F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)))
    return df.withColumn("nearest", F.array_min(each)).withColumns({"cluster": F.col("nearest.i"), "centre_distance": F.col("nearest.d")}).drop("nearest")


def cluster_sizes(df: DataFrame, split: str, splits: list[str]) -> DataFrame:
    """``cluster, size_all, size_<split>, density``: sizes by split and 1 / (mean distance to the centre + 0.001)."""
    return df.groupBy("cluster").agg(F.count("*").alias("size_all"), *(F.count_if(F.col(split) == s).alias(f"size_{s}") for s in splits), (1 / (F.avg("centre_distance") + 1e-3)).alias("density"))


def neighbour_features(neighbours: DataFrame, labels: DataFrame, depths: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query: mean distance of the nearest 1, 3, ... neighbours, label means, and distances of the nearest
    positive and negative one (the last neighbour's if there is none) with their ratio. ``labels``: ``id, label``."""
    rows = neighbours.join(labels, "id", "left")
    within = lambda k, c: F.avg(F.when(F.col("rank") <= k, F.col(c)))
    last = F.max("distance")
    pos, neg = (F.coalesce(F.min(F.when(F.col("label") == y, F.col("distance"))), last) for y in (1, 0))
    return rows.groupBy("query_id").agg(
        *(within(k, "distance").alias(f"dist_{k}_mean") for k in depths), *(within(k, "label").alias(f"label_mean_{k}") for k in depths), F.stddev_pop("distance").alias("dist_std"), pos.alias("pos_dist_min"), neg.alias("neg_dist_min"), (neg / (pos + 1e-3)).alias("neg_pos_ratio")
    )


def knn_block(df: DataFrame, splits: list[str], folds: int = 5) -> DataFrame:
    """``id`` and 13 + one column a split of rows (id, vector, split, label, fold). Distances are among all rows, and to the nearest
    row of each split; label columns are of the 10 nearest labelled rows, for labelled rows those of the other folds. A class
    that isn't among them counts as far as the last of them, for labelled rows as the last of the fold's rows."""
    rows = usable(df, "split", "label", "fold")
    depths = (3, 5, 10, 20)
    within = lambda k, c: F.avg(F.when(F.col("rank") <= k, F.col(c)))
    out = nearest(rows, rows, 20, same=True).groupBy(F.col("query_id").alias("id")).agg(
        F.min("distance").alias("knn_dist_1"), *(within(k, "distance").alias(f"knn_dist_{k}_mean") for k in depths), F.stddev_pop(F.when(F.col("rank") <= 10, F.col("distance"))).alias("knn_dist_std_10")
    )
    for split in splits:
        closest = nearest(rows, rows.where(F.col("split") == split), 1, same=True)
        out = out.join(closest.select(F.col("query_id").alias("id"), F.col("distance").alias(f"knn_{split}_dist_min")), "id", "left")
    labelled, rest = rows.where("label is not null"), rows.where("label is null")
    parts = [nearest(labelled.where(F.col("fold") == k), labelled.where(F.col("fold") != k), 10) for k in range(folds)]
    found = encode.reduce(lambda a, b: a.unionByName(b), [*parts, nearest(rest, labelled, 10)])
    found = found.join(labelled.select("id", "label"), "id").join(rows.select(F.col("id").alias("query_id"), F.when(F.col("label").isNotNull(), F.col("fold")).alias("fold")), "query_id")
    nearest_of = lambda y: F.min(F.when(F.col("label") == y, F.col("distance")))
    label = found.groupBy(F.col("query_id").alias("id"), "fold").agg(
        *(within(k, "label").alias(f"knn_train_label_mean_{k}") for k in (3, 5, 10)), F.stddev_pop("label").alias("knn_train_label_std_10"), nearest_of(1).alias("pos"), nearest_of(0).alias("neg"), F.max("distance").alias("last")
    )
    furthest = label.where("fold is not null").groupBy("fold").agg(F.max("last").alias("furthest"))
    label = label.join(furthest, "fold", "left").withColumn("missing", F.coalesce("furthest", "last"))
    pos, neg = F.coalesce("pos", "missing"), F.coalesce("neg", "missing")
    kept = [f"knn_train_label_mean_{k}" for k in (3, 5, 10)] + ["knn_train_label_std_10"]
    return out.join(label.select("id", *kept, pos.alias("knn_train_pos_dist_min"), neg.alias("knn_train_neg_dist_min"), (neg / (pos + 1e-3)).alias("knn_neg_pos_ratio")), "id", "left")


def fit_clusters(df: DataFrame, k: int, seed: int = 42, iterations: int = 50) -> list[list[float]]:
    """Centres of a K-means fit, in the order of their components; as many as there are different vectors at most. Rows are dealt
    and sorted by id, so that the fit doesn't depend on how they were stored."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = usable(df).repartition(spread, "id").sortWithinPartitions("id", "vector").select(array_to_vector("vector").alias("features"))
    centres = KMeans(k=k, seed=seed, maxIter=iterations).fit(rows).clusterCenters()
    return sorted([float(x) for x in c] for c in centres)


def cluster_block(df: DataFrame, centres: list[list[float]], prefix: str, splits: list[str]) -> DataFrame:
    """``id`` and 9 + one column a split of rows (id, vector, split, label, fold): cluster, its sizes, distance to the centre, density,
    and the cluster's label statistics, for labelled rows over the other folds. A cluster without labels there gets the overall ones."""
    rows = assign(usable(df, "split", "label", "fold"), centres)
    rows = rows.withColumn("fold", F.when(F.col("label").isNotNull(), F.col("fold")).otherwise(-1))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size_all"), *(F.count_if(F.col("split") == s).alias(f"size_{s}") for s in splits))
    stats = encode.out_of_fold_stats(rows, "cluster", "label").join(sizes, "cluster")
    made = {"id": F.col("cluster").cast("double"), "size_all": F.col("size_all"), **{f"size_{s}": F.col(f"size_{s}") for s in splits}, "distance_to_center": F.col("centre_distance"), "density_proxy": 1 / (F.col("centre_distance") + 1e-3)}
    made |= {c: F.col(c) for c in ("target_mean", "target_std", "label_entropy", "pos_count", "neg_count")}
    return stats.select("id", *(v.cast("double").alias(f"{prefix}_{k}") for k, v in made.items()))
