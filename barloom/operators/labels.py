"""Names of clusters by their mix of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.params import CATEGORIES

SPLITS = ("train", "test1", "test2")
STRONG, SOME = 0.9, 0.6


def cluster_category_counts(assigned: DataFrame, n_cat: int = CATEGORIES, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, split, cluster, cat, n), zero-filled over all categories of a cluster that has rows in the split."""
    counts = assigned.groupBy(*keys, "split", "cluster").agg(*[F.count(F.when(F.col("cat") == c, 1)).alias(f"c{c}") for c in range(n_cat)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cat"), F.col(f"c{c}").alias("n")) for c in range(n_cat)]))
    return counts.select(*keys, "split", "cluster", each.alias("e")).select(*keys, "split", "cluster", "e.cat", "e.n")


def cluster_mode(counts: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, split, cluster, mode): the most frequent category, the lower one of a tie."""
    return counts.groupBy(*keys, "split", "cluster").agg(F.max_by("cat", F.struct("n", -F.col("cat"))).alias("mode"))


def split_point(thresholds: DataFrame) -> DataFrame:
    """(ticker, s): the 0-based place of the first threshold above 0, or 0."""
    return thresholds.groupBy("ticker").agg(F.coalesce(F.min(F.when(F.col("t") > 0, F.col("i") - 1)), F.lit(0)).alias("s"))


def label_clusters(counts: DataFrame, thresholds: DataFrame, n_cat: int = CATEGORIES, strong: float = STRONG, some: float = SOME, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, cluster, label, top_share): seven names from Strong Sell to Strong Buy; clusters without training rows are gone.

    Buy side: the most frequent category is above the split point in train, test1 and test2; sell side: below it in all
    three; else, or without rows in a split, Neutral. The share of the two outermost categories on that side, in every
    split, makes it strong, plain or weak. top_share: the smallest share of the two highest categories over the splits.
    """
    of = lambda *cats: F.sum(F.when(F.col("cat").isin(*cats), F.col("n")).otherwise(0))
    shares = counts.groupBy(*keys, "split", "cluster").agg(
        F.max_by("cat", F.struct("n", -F.col("cat"))).alias("mode"), F.sum("n").alias("n"), (of(n_cat - 2, n_cat - 1) / F.sum("n")).alias("top"), (of(0, 1) / F.sum("n")).alias("low")
    )
    joined = shares.where("n > 0").join(split_point(thresholds), "ticker")
    all_splits = lambda c: F.count(F.when(c, 1)) == len(SPLITS)
    found = joined.groupBy(*keys, "cluster").agg(
        F.max(F.col("split") == "train").alias("trained"),
        all_splits(F.col("mode") > F.col("s")).alias("buy"),
        all_splits(F.col("mode") < F.col("s")).alias("sell"),
        F.min("top").alias("top"),
        F.min("low").alias("low"),
    )

    def graded(share: Column, side: str) -> Column:
        return F.when(share > strong, f"Strong {side}").when(share > some, side).otherwise(f"Weak {side}")

    label = F.when(F.col("buy"), graded(F.col("top"), "Buy")).when(F.col("sell"), graded(F.col("low"), "Sell")).otherwise("Neutral")
    return found.where("trained").select(*keys, "cluster", label.alias("label"), F.col("top").alias("top_share"))


def best_strong_buys(labels: DataFrame, n: int = 3) -> DataFrame:
    """labels (run, ticker, cluster, label, top_share): of a ticker's Strong Buys over all runs the n with the greatest
    share stay, the others are Buys."""
    strong = F.when(F.col("label") == "Strong Buy", 0).otherwise(1)
    by = Window.partitionBy("ticker").orderBy(strong, F.desc("top_share"), "run", "cluster")
    ranked = labels.withColumn("_r", F.row_number().over(by))
    return ranked.withColumn("label", F.when((F.col("label") == "Strong Buy") & (F.col("_r") > n), "Buy").otherwise(F.col("label"))).drop("_r")


def strong_buy_count(labels: DataFrame) -> DataFrame:
    return labels.groupBy("ticker").agg(F.count_if(F.col("label") == "Strong Buy").alias("n_strong_buy"))
