"""Market data made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import cents, epoch_ms, minute_start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str, ticker: str = "event_type") -> DataFrame:
    """(ticker, ts, bid, ask, price, size, event_id, event_type): an event's value is the bid, its k the spread in cents."""
    k = F.get_json_object("props", "$.k").cast("int")
    bid = F.col("value")
    ask = bid + k / 100.0
    return table(spark, sf_dir, "events").select(
        F.col(ticker).cast("string").alias("ticker"), "ts", bid.alias("bid"), ask.alias("ask"), ((bid + ask) / 2).alias("price"), k.alias("size"), "event_id", "event_type"
    )


def _bars(rows: DataFrame, keys: list[str], value: Column, order: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("volume")
    )


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, date, open, high, low, close, volume) by minute."""
    q = quotes(spark, sf_dir).select("ticker", minute_start(F.col("ts")).alias("ts"), F.to_date("ts").alias("date"), "bid", F.col("ts").alias("at"))
    return _bars(q, ["ticker", "ts", "date"], F.col("bid"), F.col("at"))


def daily_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the same tickers."""
    q = quotes(spark, sf_dir).select("ticker", F.to_date("ts").alias("date"), "bid", "ts")
    return _bars(q, ["ticker", "date"], F.col("bid"), F.col("ts"))


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars over years: orders by priority, on their total price, in the order of their keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderkey")
    return _bars(o, ["ticker", "date"], F.col("o_totalprice"), F.col("o_orderkey"))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, body): a JSON reply of candles for each ticker and day."""
    bar = F.struct(epoch_ms(F.col("ts")).alias("datetime"), "open", "close", "high", "low", "volume")
    return minute_bars(spark, sf_dir).groupBy("ticker", "date").agg(F.to_json(F.struct(F.sort_array(F.collect_list(bar)).alias("candles"))).alias("body")).drop("date")


def clustering_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, row_id, features, cat, gain): embeddings as feature rows."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 4).cast("string").alias("ticker"),
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") % 8).cast("int").alias("cat"),
        F.col("embedding")[0].cast("double").alias("gain"),
    )


def buy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, placed_ts, order_id, limit_price, quantity): purchases of a user, as limit orders below the value."""
    return quotes(spark, sf_dir, "user_id").where("event_type = 'purchase'").select(
        "ticker", F.col("ts").alias("placed_ts"), F.col("event_id").alias("order_id"), cents(F.col("bid") * 0.9).alias("limit_price"), (F.col("size") + 1).alias("quantity")
    )


def order_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that can fill those orders: all other events of the user."""
    return quotes(spark, sf_dir, "user_id").where("event_type <> 'purchase'").select("ticker", "ts", "bid", "ask", "price")
