"""Registered queries of stored tables: each writes rows, changes or loads them as a later job would, and reads them back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import dataset
from barloom.plans.oracles import GAINS, r, sql
from barloom.plans.queries import _gains, rounded
from barloom.sources import bars as bar_tables
from barloom.sources import fixtures as fx
from barloom.sources.model import load_model_tables, save_model_tables
from barloom.sources.shared import shared_folder

TICKERS = ["click", "view"]
UNUSABLE = "5-LOW"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stored_minutes(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "bars")
    bar_tables.write_bars(fx.minute_bars(spark, d).drop("date"), path, "minute")
    return path


BAR = ["ticker", "ts", "open", "high", "low", "close", "volume"]


def stored_bars(spark: SparkSession, d: str) -> DataFrame:
    """Two tickers of a range of minute bars."""
    return bar_tables.read_bars(spark, _stored_minutes(spark, d), date(2024, 1, 5), date(2024, 1, 20), "minute", TICKERS).select(*BAR)


def stored_daily(spark: SparkSession, d: str) -> DataFrame:
    """A range of daily bars, which begins six months earlier."""
    path = _folder(spark, "bars")
    bar_tables.write_bars(fx.daily_short(spark, d).withColumn("ts", F.col("date").cast("timestamp_ntz")).drop("date"), path, "daily")
    return bar_tables.read_bars(spark, path, date(2024, 7, 10), date(2024, 7, 20), "daily").select(*BAR)


def stored_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether the rows of each ticker and day lie in their file in the order of ticker and time."""
    rows = bar_tables.read_bars(spark, _stored_minutes(spark, d), date(2024, 1, 1), date(2024, 12, 31), "minute")
    placed = rows.select("ticker", "date", F.struct("ticker", "ts").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    before = F.lag("at").over(Window.partitionBy("file").orderBy("place"))
    marked = placed.withColumn("follows", F.coalesce(before <= F.col("at"), F.lit(True)))
    return marked.groupBy("ticker", "date").agg(F.count("*").alias("n_rows"), F.min("follows").alias("in_order"))


def replaced_slice(spark: SparkSession, d: str) -> DataFrame:
    """Minute bars after six days have given way to one ticker's bars."""
    path, (start, end) = _stored_minutes(spark, d), (date(2024, 1, 10), date(2024, 1, 15))
    bar_tables.replace_slice(spark, path, start, end, "minute", fx.minute_bars(spark, d).drop("date").where(F.col("ticker") == TICKERS[0]))
    return bar_tables.read_bars(spark, path, date(2024, 1, 1), date(2024, 12, 31), "minute").select(*BAR)


def stored_model(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds and bounds of the tickers that all stored parts have."""
    rows, path = _gains(spark, d), _folder(spark, "model")
    updates = rows.where(F.col("ticker") != UNUSABLE).groupBy("ticker").agg(F.max("date").alias("updated"))
    save_model_tables(path, thresholds=dataset.rank_thresholds(rows), scaling=dataset.feature_min_max(rows, ["close"]), updates=updates)
    model = load_model_tables(spark, path, ("thresholds", "scaling", "updates"))
    return rounded(model["thresholds"].join(model["scaling"].drop("feature"), "ticker").join(model["updates"], "ticker"))


QUERIES = {f.__name__: f for f in (stored_bars, stored_daily, stored_order, replaced_slice, stored_model)}

_BAR = ", ".join(BAR)
ORACLES = {
    "stored_bars": sql(f"select {_BAR} from m where date between date '2024-01-05' and date '2024-01-20' and ticker in ('click', 'view')"),
    "stored_daily": sql("select ticker, date::timestamp ts, open, high, low, close, volume from d where date between date '2024-01-10' and date '2024-07-20'"),
    "stored_order": sql("select ticker, date, count(*) n_rows, true in_order from m group by 1, 2"),
    "replaced_slice": sql(f"select {_BAR} from m where date not between date '2024-01-10' and date '2024-01-15' or ticker = 'click'"),
    "stored_model": sql(
        f"select th.ticker, i, {r('t', 't')}, {r('lo', 'min')}, {r('hi', 'max')}, updated from th join (select ticker, min(close) lo, max(close) hi, max(date) updated from l group by 1) b using (ticker) where ticker <> '{UNUSABLE}'",
        *GAINS,
    ),
}
assert set(ORACLES) == set(QUERIES)
