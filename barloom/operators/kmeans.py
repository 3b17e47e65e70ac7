"""k-means for every ticker (and restart) at once, by Lloyd steps on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.nearest import nearest_centroid
from barloom.sources.shared import checkpointed

KEYS = ("run", "ticker")


def restarts(points: DataFrame, runs: int) -> DataFrame:
    """points once for each restart, with ``run`` from 0."""
    return points.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def initial_centroids(points: DataFrame, k: int, seed: str = "0", key: str = "row_id") -> DataFrame:
    """(run, ticker, cluster, center): the k rows of smallest md5(seed|run|key), whatever the partitioning.

    A ticker with fewer than k rows has too few for a model and gets none.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("run").cast("string"), F.col(key).cast("string")))
    # each task keeps k rows of a group before any are shuffled
    ranked = points.select("run", "ticker", "features", F.row_number().over(Window.partitionBy("run", "ticker").orderBy(order, key)).alias("_r")).where(F.col("_r") <= k)
    enough = points.groupBy("run", "ticker").agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
    return ranked.join(enough, ["run", "ticker"], "left_semi").select("run", "ticker", (F.col("_r") - 1).cast("long").alias("cluster"), F.col("features").alias("center"))


def cluster_means(assigned: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, cluster, center): mean vector of the members; a cluster without members is gone. Partial sums are shuffled."""
    each = assigned.select(*keys, "cluster", F.posexplode("features").alias("dim", "x"))
    means = each.groupBy(*keys, "cluster", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy(*keys, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("center"))


def kmeans_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    return cluster_means(nearest_centroid(points.select(*KEYS, "features"), centroids, KEYS))


#: Steps between looks at whether a center still moves.
LOOK = 5


def kmeans_fit(points: DataFrame, k: int = 100, iterations: int = 100, seed: str = "0", key: str = "row_id") -> DataFrame:
    """Centroids (run, ticker, cluster, center) after ``iterations`` steps, or once no center moves (which is the same).

    points: (run, ticker, features, key). They and each step's centers go through a checkpoint, so a step reads points
    that are made and shuffles partial sums of centers alone. Every five steps the keys (run, ticker) whose centers stand
    still are put aside, and later steps no longer measure their points.
    """
    points = checkpointed(points.select(*KEYS, "features", key))
    centers = checkpointed(initial_centroids(points, k, seed, key))
    done: list[DataFrame] = []
    for step in range(1, iterations + 1):
        after = checkpointed(kmeans_step(points, centers))
        if step % LOOK == 0 and step < iterations:
            changed = centers.join(after.withColumnRenamed("center", "_new"), [*KEYS, "cluster"], "left").where("_new is null or _new <> center")
            moving = checkpointed(changed.select(*KEYS).distinct())
            done.append(checkpointed(after.join(moving, list(KEYS), "left_anti").select(*after.columns)))
            after = checkpointed(after.join(moving, list(KEYS), "left_semi").select(*after.columns))
            if moving.isEmpty():
                break
        centers = after
    else:
        done.append(centers)
    return reduce(DataFrame.unionByName, done)


def assign_clusters(points: DataFrame, centroids: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return nearest_centroid(points, centroids, keys)
