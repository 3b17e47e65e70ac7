"""Training rows: scaling, forward gains, splits, thresholds, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import pct_gain
from barloom.operators.ranks import values_at, with_rank
from barloom.params import CATEGORIES, GRID_MINUTES


def feature_min_max(rows: DataFrame, features: list[str]) -> DataFrame:
    """(ticker, feature, min, max), all features in one pass; partial sums keep hot tickers cheap."""
    wide = rows.groupBy("ticker").agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("min", F.min), ("max", F.max))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"min_{c}").cast("double").alias("min"), F.col(f"max_{c}").cast("double").alias("max")) for c in features]))
    return wide.select("ticker", each.alias("s")).select("ticker", "s.*")


def dropped_features(scaling: DataFrame) -> DataFrame:
    """(ticker, feature) that are constant or missing for a ticker: every scaled value would be null."""
    return scaling.where("min is null or min = max").select("ticker", "feature")


def min_max_scale(rows: DataFrame, scaling: DataFrame, features: list[str]) -> DataFrame:
    """rows with the features between 0 and 1 within the scaling's bounds; null where the bounds are equal."""
    bounds = scaling.where(F.col("feature").isin(features)).groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("min", "max")))).alias("_bounds"))
    joined = rows.join(bounds, "ticker", "left")

    def scaled(c: str) -> Column:
        b = F.try_element_at(F.col("_bounds"), F.lit(c))
        return F.when(b["max"] > b["min"], (F.col(c) - b["min"]) / F.nullif(b["max"] - b["min"], F.lit(0.0)))

    return joined.withColumns({c: scaled(c) for c in features}).drop("_bounds")


def future_close(aligned: DataFrame, n: int, unit: str) -> DataFrame:
    """aligned (ticker, session_no, minute_no, ts, close) with ``future``, the close n minutes or days later, and ``gain``.

    On a complete grid the later row has a known number, so this is an equi-join and no window spans days.
    """
    if unit not in ("minute", "day"):
        raise ValueError("the unit is 'minute' or 'day'")
    shift = n if unit == "minute" else n * GRID_MINUTES
    number = F.col("session_no").cast("long") * GRID_MINUTES + F.col("minute_no")
    later = aligned.select("ticker", (number - shift).alias("number"), F.col("close").alias("future"))
    out = aligned.withColumn("number", number).join(later, ["ticker", "number"], "left").drop("number")
    return out.withColumn("gain", pct_gain(F.col("future"), F.col("close")))


def drop_null_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.dropna(how="any", subset=columns)


def chrono_split(rows: DataFrame, order: str, two_way: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with ``split``: train up to 60 % of a ticker's rows, test1 up to 80 %, then test2; two-way: up to two thirds.

    ties: the columns that order rows of one time, so that each run splits them alike."""
    at = with_rank(rows, "ticker", order, ties=ties)
    if two_way:
        split = F.when(F.col("_i") <= F.floor(2 * F.col("_n") / 3), "train").otherwise("test1")
    else:
        # in whole numbers, so that no rounding moves a border
        split = F.when(F.col("_i") <= F.floor(6 * F.col("_n") / 10), "train").when(F.col("_i") <= F.floor(8 * F.col("_n") / 10), "test1").otherwise("test2")
    return at.withColumn("split", split).select(*rows.columns, "split")


def rank_thresholds(rows: DataFrame, n_cat: int = CATEGORIES, approximate: bool = False) -> DataFrame:
    """(ticker, i, t): the gains that part a ticker's rows into n_cat categories, at the 0-based ranks ceil(n / n_cat * i).

    Tickers with fewer than n_cat gains have none. Exact by counting brackets (``values_at``), for which rows are read a
    few times: hand over a table rather than a long plan. approximate: by a mergeable quantile sketch, in one pass.
    """
    known = rows.select("ticker", "gain").where("gain is not null")
    if approximate:
        shares = [i / n_cat for i in range(1, n_cat)]
        found = known.groupBy("ticker").agg(F.percentile_approx("gain", shares, 100_000).alias("t"), F.count("*").alias("n")).where(F.col("n") >= n_cat)
    else:
        # a ticker with too few has ranks beyond its end, and is left out below
        place = lambda n, i: F.least(F.floor((n * i + n_cat - 1) / n_cat), n - 1)
        found = values_at(known, "ticker", "gain", lambda n: [place(n, i) for i in range(1, n_cat)]).where(F.col("n") >= n_cat).withColumnRenamed("values", "t")
    return found.select("ticker", F.posexplode("t").alias("i", "t")).withColumn("i", F.col("i") + 1)


def threshold_list(thresholds: DataFrame) -> DataFrame:
    """(ticker, thresholds array) in ascending order of i."""
    return thresholds.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("thresholds"))


def categorize(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows with ``cat``: how many of the ticker's thresholds the gain exceeds."""
    joined = rows.join(threshold_list(thresholds), "ticker")
    over = F.size(F.filter("thresholds", lambda t: F.col("gain") > t))
    return joined.withColumn("cat", F.when(F.col("gain").isNotNull(), over)).drop("thresholds")


def training_matrix(rows: DataFrame, features: list[str], n_cat: int = CATEGORIES, include_label: bool = True) -> DataFrame:
    """rows with ``features``: the scaled features and, as last dimension, the category between 0 and 1."""
    columns = [F.col(c).cast("double") for c in features] + ([(F.col("cat") / (n_cat - 1)).cast("double")] if include_label else [])
    return rows.withColumn("features", F.array(*columns))
