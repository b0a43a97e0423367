"""Representative samples from clustered embeddings."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordflow.runtime import checked_broadcast, cut_lineage

# Cluster means broadcast up to this many; more of them join by shuffle.
MAX_CENTERS = 10_000


def assign_clusters(emb: DataFrame, vector: str, k: int, seed: int = 7, out: str = "cluster") -> DataFrame:
    """Add a k-means cluster number. Fitting runs distributed jobs over the vectors."""
    features = emb.withColumn("_features", array_to_vector(F.col(vector)))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out).fit(features)
    return model.transform(features).drop("_features")


def _distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def cluster_sample(emb: DataFrame, key: str, vector: str, cluster: str, k: int) -> DataFrame:
    """The ``k`` members nearest to each cluster's mean vector.

    Means are stored first (one job) and reduce map-side to one row per cluster; ``row_number() <= k`` is applied per task before
    the shuffle, so a cluster holding most rows sends only ``k`` rows per task.
    """
    as_double = F.col(vector).cast("array<double>")
    centers = emb.groupBy(cluster).agg(
        vector_to_array(Summarizer.mean(array_to_vector(as_double))).alias("_center")
    )
    # Stored once: its size is counted before the broadcast without computing the means again.
    centers = checked_broadcast(cut_lineage(centers, "centers"), MAX_CENTERS)
    near = emb.join(centers, cluster).withColumn(
        "_distance", _distance(as_double, F.col("_center"))
    ).select(key, cluster, "_distance")
    order = Window.partitionBy(cluster).orderBy("_distance", key)
    return (
        near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
        .select(key, cluster, F.col("_rank").cast("bigint").alias("rank"), F.round("_distance", 5).alias("distance"))
    )
