"""Registered queries of the fitted model: from k-means to names, scores and picks, through stored model tables."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import pct_gain
from barloom.operators import dataset, indicators, kmeans, labels, scoring
from barloom.params import CATEGORIES
from barloom.plans import oracles
from barloom.plans.oracles import CLUSTERS, r, sql
from barloom.plans.queries import SOME, STRONG, K, rounded
from barloom.sources import fixtures as fx
from barloom.sources.model import load_model_tables, save_model_tables
from barloom.sources.shared import checkpointed, shared_folder

#: Restarts that SQL follows through all steps, and those of the full size.
FEW_RUNS, ALL_RUNS, CLUSTERS_EACH, AHEAD_DAYS = 2, 10, 100, 2
PARTS = ("centroids", "labels", "thresholds")
#: The features that are clustered. Fixed values.
CLUSTERED = "boll20 boll50 macd_line signal_line macd_hist rsi stochastic_k stochastic_k_d".split()


def _stored(spark: SparkSession, **parts: DataFrame) -> dict[str, DataFrame]:
    """The parts as a later job finds them: written as model tables and loaded, for tickers that have all of them."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model_tables(path, **parts)
    return load_model_tables(spark, path, tuple(parts))


def _pooled(rows: DataFrame, k: int) -> DataFrame:
    """Clusters of all runs under one number."""
    return rows.withColumn("cluster", F.col("run") * k + F.col("cluster")).drop("run")


def fitted_model(points: DataFrame, gains: DataFrame, k: int, runs: int, strong: float, some: float, train_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centroids, labels, thresholds): k-means in ``runs`` restarts, clusters named by the categories that they hold in
    train and both tests, the best Strong Buys of all runs kept, the others Buy.

    points: (ticker, row_id, features, split, cat); gains: (ticker, gain). train_only: fit on the training rows alone.
    """
    restarts = checkpointed(kmeans.restarts(points, runs))
    centers = checkpointed(kmeans.kmeans_fit(restarts.where("split = 'train'") if train_only else restarts, k))
    thresholds = checkpointed(dataset.rank_thresholds(gains))
    counts = labels.cluster_category_counts(kmeans.assign_clusters(restarts, centers), keys=kmeans.KEYS)
    named = labels.best_strong_buys(labels.label_clusters(counts, thresholds, CATEGORIES, strong, some, kmeans.KEYS))
    return centers, checkpointed(named), thresholds


def _small(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Embeddings as points, and their stored model."""
    rows = checkpointed(dataset.chrono_split(fx.clustering_rows(spark, d), "row_id"))
    centers, named, thresholds = fitted_model(rows, rows, K, FEW_RUNS, STRONG, SOME)
    return rows, _stored(spark, centroids=centers, labels=named, thresholds=thresholds)


def fitted_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_small(spark, d)[1]["labels"].select("run", "ticker", "cluster", "label", "top_share"))


def _small_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, model = _small(spark, d)
    return scoring.score_latest(rows, _pooled(model["centroids"], K), _pooled(model["labels"], K)), model["thresholds"]


def fitted_scores(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of every ticker by the nearest of all runs' centers."""
    return rounded(_small_scores(spark, d)[0])


def fitted_picks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.pick_buys(*_small_scores(spark, d), total=300.0))


class Training(NamedTuple):
    matrix: DataFrame
    gains: DataFrame
    newest: DataFrame


def daily_training_rows(spark: SparkSession, d: str) -> Training:
    """Long daily bars as training rows: eight features scaled to 0..1 and, as ninth, the category of the gain of the
    close two days later. newest: each ticker's last row with all features, which has no gain yet."""
    daily = checkpointed(fx.daily_long(spark, d))
    parts = [indicators.bollinger_daily(daily), indicators.macd_daily(daily), indicators.rsi_daily(daily), indicators.stochastic_daily(daily).select("ticker", "date", F.col("k").alias("stochastic_k"), (F.col("k") - F.col("d")).alias("stochastic_k_d"))]
    rows = daily.select("ticker", "date", "close")
    for p in parts:
        rows = rows.join(p, ["ticker", "date"])
    later = F.lead("close", AHEAD_DAYS).over(Window.partitionBy("ticker").orderBy("date"))
    rows = checkpointed(rows.withColumn("gain", pct_gain(later, F.col("close"))).withColumn("row_id", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")))
    scaled = dataset.min_max_scale(rows, dataset.feature_min_max(rows, CLUSTERED), CLUSTERED)
    categorized = dataset.categorize(scaled, dataset.rank_thresholds(rows))
    whole = dataset.drop_null_rows(categorized, [*CLUSTERED, "cat"])
    matrix = checkpointed(dataset.chrono_split(dataset.training_matrix(whole, CLUSTERED).select("ticker", "row_id", "features", "cat"), "row_id"))
    newest = dataset.training_matrix(dataset.drop_null_rows(scaled, CLUSTERED), CLUSTERED, include_label=False)
    return Training(matrix, rows.select("ticker", "gain"), newest)


def trained_model(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], Training]:
    """The model at full size, stored and loaded."""
    rows = daily_training_rows(spark, d)
    centers, named, thresholds = fitted_model(rows.matrix, rows.gains, CLUSTERS_EACH, ALL_RUNS, labels.STRONG, labels.SOME, train_only=True)
    return _stored(spark, centroids=centers, labels=named, thresholds=thresholds), rows


def trained_scores(spark: SparkSession, d: str) -> DataFrame:
    """The newest day of every ticker by a model of 100 clusters, ten runs and eight features; too slow in SQL."""
    model, rows = trained_model(spark, d)
    return rounded(scoring.score_latest(rows.newest, _pooled(model["centroids"], CLUSTERS_EACH), _pooled(model["labels"], CLUSTERS_EACH)))


QUERIES = {f.__name__: f for f in (fitted_labels, fitted_scores, fitted_picks, trained_scores)}

_STEPS = oracles.FIT_STEPS.replace("from ce where run < 2", "from c0")
_FITTED = [*CLUSTERS[:2], f"runs as (select unnest(range(0, {FEW_RUNS}))::int run)", CLUSTERS[3].replace("ce as", "c0 as", 1), _STEPS, "ce as (select run, ticker, cluster, c from st where step = 100)", *CLUSTERS[4:]]
_BEST = """bb as (select run, ticker, cluster, case when "label" = 'Strong Buy' and rk > 3 then 'Buy' else "label" end "label", top_share
  from (select *, row_number() over (partition by ticker, "label" order by top_share desc, run, cluster) rk from lb))"""
_NEWEST = f"""nw as (select ticker, row_id, run * {K} + cluster cluster, distance, "label" from (
    select p.ticker, p.row_id, ce.run, ce.cluster, list_distance(p.f, ce.c) distance, row_number() over (partition by p.ticker order by list_distance(p.f, ce.c), ce.run, ce.cluster) best
    from p join ce using (ticker) where p.row_id in (select max(row_id) from p group by ticker)) left join bb using (run, ticker, cluster) where best = 1)"""
ORACLES = {
    "fitted_labels": sql(f"select run, ticker, cluster, \"label\", {r('top_share', 'top_share')} from bb", *_FITTED, _BEST),
    "fitted_scores": sql(f"select ticker, row_id, cluster, {r('distance', 'distance')}, \"label\" from nw", *_FITTED, _BEST, _NEWEST),
    "fitted_picks": sql(
        f"select ticker, {r('t', 't_last')} from nw join pt using (ticker) where \"label\" = 'Strong Buy' and i = 7 order by t desc, ticker limit 3", *_FITTED, _BEST, _NEWEST
    ),
}
assert set(ORACLES) <= set(QUERIES)
