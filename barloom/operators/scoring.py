"""Scores of the newest rows, and which tickers to buy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.nearest import nearest_centroid
from barloom.params import Trading


def usable_tickers(tickers: DataFrame, *parts: DataFrame) -> DataFrame:
    """Tickers that every part of the model has."""
    return reduce(lambda a, b: a.join(b.select("ticker").distinct(), "ticker", "left_semi"), parts, tickers.select("ticker").distinct())


def score_latest(rows: DataFrame, centroids: DataFrame, labels: DataFrame, order: str = "row_id") -> DataFrame:
    """(ticker, order, cluster, distance, label) of the newest row of every ticker; on the feature dimensions only."""
    newest = rows.groupBy("ticker").agg(F.max(order).alias(order), F.max_by("features", order).alias("features"))
    return nearest_centroid(newest, centroids).join(labels.select("ticker", "cluster", "label"), ["ticker", "cluster"], "left").select("ticker", order, "cluster", "distance", "label")


def pick_buys(scores: DataFrame, thresholds: DataFrame, total: float, trading: Trading = Trading()) -> DataFrame:
    """Of the tickers scored Strong Buy, as many as the money allows, those of the highest last threshold first."""
    last = thresholds.groupBy("ticker").agg(F.max_by("t", "i").alias("t_last"))
    strong = scores.where("label = 'Strong Buy'").select("ticker").join(last, "ticker")
    return strong.orderBy(F.desc("t_last"), "ticker").limit(trading.number_of_buys(total))
