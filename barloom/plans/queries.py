"""Registered queries: each reads the given tables and applies an operator to all their rows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.nearest import nearest_centroid
from barloom.functions.scalars import cents, in_session, pct_gain
from barloom.functions.scalars import minute_end as stamp_of_minute
from barloom.operators import align, calendar, dataset, indicators, kmeans, labels, orders, scoring
from barloom.params import CATEGORIES
from barloom.sources import bars as bar_tables
from barloom.sources import fixtures as fx

K, RUNS = 10, 3
STRONG, SOME = 0.25, 0.1
LABELS = ("Strong Sell", "Sell", "Weak Sell", "Neutral", "Weak Buy", "Buy", "Strong Buy")


#: Long daily bars are in the hundred thousands, where a double has no use for more digits.
LONG_DIGITS = 4


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to 6 digits: sums differ between engines in the last ones. Minus zero becomes zero."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


# bars ------------------------------------------------------------------------------------------------------------------


def candles_json(spark: SparkSession, d: str) -> DataFrame:
    return bar_tables.read_candles_json(fx.candles(spark, d))


def daily_stamp(spark: SparkSession, d: str) -> DataFrame:
    early = fx.daily_short(spark, d).withColumn("ts", F.date_sub("date", 1).cast("timestamp_ntz")).drop("date")
    return bar_tables.shift_daily_stamp(early, date(2024, 1, 5), date(2024, 1, 25))


def minute_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.minute_bar(fx.quotes(spark, d)))


def dedupe_bars(spark: SparkSession, d: str) -> DataFrame:
    m = fx.minute_bars(spark, d).drop("date")
    first, second = m.where(F.col("ts") < F.lit(datetime(2024, 1, 20))), m.where(F.col("ts") >= F.lit(datetime(2024, 1, 10)))
    return align.dedupe_bars(align.append_bars(first, second))


def history_summary(spark: SparkSession, d: str) -> DataFrame:
    return align.history_summary(fx.minute_bars(spark, d))


def average_volume(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.average_volume(fx.daily_long(spark, d)))


def last_n(spark: SparkSession, d: str) -> DataFrame:
    return align.last_n(fx.daily_long(spark, d), 3)


def roll_features(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.daily_short(spark, d)
    newest = rows.groupBy("ticker").agg(F.max("date").alias("newest"))
    marked = rows.join(newest, "ticker")
    stored = align.last_n(marked.where("date < newest").drop("newest"), 3)
    return align.roll_features(stored, marked.where("date = newest").drop("newest"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def quotes_wide(spark: SparkSession, d: str) -> DataFrame:
    q = fx.quotes(spark, d).withColumn("bid_size", F.col("size")).withColumn("ask_size", F.col("size") + 1)
    return rounded(align.quotes_wide(q, EVENT_TYPES))


def minute_end(spark: SparkSession, d: str) -> DataFrame:
    return fx.quotes(spark, d).select("event_id", stamp_of_minute(F.col("ts")).alias("ts"))


def retention(spark: SparkSession, d: str) -> DataFrame:
    return align.retention(fx.quotes(spark, d, "user_id"), 60, 20, ties=("event_id",)).select("event_id", "ticker", "ts")


# calendar --------------------------------------------------------------------------------------------------------------


def _order_range(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))


def _event_range(spark: SparkSession, d: str, *keys: Column) -> DataFrame:
    return fx.table(spark, d, "events").groupBy(*keys).agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))


def market_holidays(spark: SparkSession, d: str) -> DataFrame:
    return calendar.market_holidays(_order_range(spark, d))


def daily_grid(spark: SparkSession, d: str) -> DataFrame:
    return calendar.daily_grid(_order_range(spark, d))


def minute_grid(spark: SparkSession, d: str) -> DataFrame:
    return calendar.minute_grid(calendar.open_days(_event_range(spark, d)))


def session_filter(spark: SparkSession, d: str) -> DataFrame:
    q = fx.quotes(spark, d).where(in_session(F.col("ts"))).withColumn("date", F.to_date("ts"))
    return calendar.exclude_holidays(q, calendar.market_holidays(_event_range(spark, d))).select("event_id", "ticker", "ts")


def ticker_grid(spark: SparkSession, d: str) -> DataFrame:
    return calendar.minute_grid(calendar.open_days(_event_range(spark, d, F.col("event_type").alias("ticker")), ["ticker"]))


def rows_per_session(spark: SparkSession, d: str) -> DataFrame:
    return align.rows_per_session(ticker_grid(spark, d))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return align.asof_align(ticker_grid(spark, d), fx.minute_bars(spark, d))


def asof_align(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("ticker", "ts", "open", "high", "low", "close", "volume")


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return align.gap_fill(fx.minute_bars(spark, d), ticker_grid(spark, d)).select("ticker", "ts", "close", "volume")


def wide_merge(spark: SparkSession, d: str) -> DataFrame:
    return align.wide_merge(aligned(spark, d), EVENT_TYPES, ["close", "volume"])


# indicators ------------------------------------------------------------------------------------------------------------


def _daily(f):
    return lambda spark, d: rounded(f(fx.daily_long(spark, d)), LONG_DIGITS)


def _minute(f):
    return lambda spark, d: rounded(f(fx.minute_bars(spark, d), fx.daily_short(spark, d)))


def stochastic_daily(daily: DataFrame) -> DataFrame:
    return indicators.stochastic_daily(daily).select("ticker", "date", "k", "d", "d_slow")


def day_high_low(spark: SparkSession, d: str) -> DataFrame:
    return indicators.day_high_low(fx.minute_bars(spark, d)).select("ticker", "ts", "day_high", "day_low")


def diff_high_low(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.diff_high_low(fx.daily_long(spark, d)).select("ticker", "date", "diff_high_low"))


def spread_feature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.spread_feature(fx.quotes(spark, d)).select("event_id", "diff_high_low"))


def lag_close(spark: SparkSession, d: str) -> DataFrame:
    return indicators.lag_close(aligned(spark, d))


def features_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.minute_features(aligned(spark, d), fx.daily_short(spark, d)))


# dataset ---------------------------------------------------------------------------------------------------------------

SCALED = ["close", "diff_high_low", "sma5", "ema5"]


def _feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Minute bars with a few features and the gain of the next minute bar's close over the daily open."""
    m, daily = fx.minute_bars(spark, d), fx.daily_short(spark, d)
    rows = indicators.diff_high_low(m).join(indicators.sma_minute(m, daily, (5,)), ["ticker", "ts"]).join(indicators.ema_minute(m, daily, (5,)), ["ticker", "ts"])
    return rows.select("ticker", "ts", *SCALED)


def feature_min_max(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dataset.feature_min_max(_feature_rows(spark, d), SCALED))


def min_max_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = _feature_rows(spark, d)
    return rounded(dataset.min_max_scale(rows, dataset.feature_min_max(rows, SCALED), SCALED).select("ticker", "ts", *SCALED))


def future_close(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dataset.future_close(aligned(spark, d), 2, "day").select("ticker", "ts", "close", "future", "gain"))


def future_close_minute(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dataset.future_close(aligned(spark, d), 30, "minute").select("ticker", "ts", "close", "future", "gain"))


def all_null_columns(spark: SparkSession, d: str) -> DataFrame:
    """A month of days has no average of 50; of the short bars that is the only feature that a ticker misses."""
    daily = fx.daily_short(spark, d)
    rows = daily.join(indicators.sma_daily(daily, (5, 50)), ["ticker", "date"])
    return dataset.dropped_features(dataset.feature_min_max(rows, ["close", "volume", "sma5", "sma50"]))


def drop_null_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dataset.drop_null_rows(_feature_rows(spark, d), SCALED))


def _gains(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars with the gain of the close over the open."""
    return fx.daily_long(spark, d).withColumn("gain", pct_gain(F.col("close"), F.col("open")))


def chrono_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.chrono_split(fx.daily_long(spark, d), "date").select("ticker", "date", "split")


def rank_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dataset.rank_thresholds(_gains(spark, d)))


def categorize(spark: SparkSession, d: str) -> DataFrame:
    rows = _gains(spark, d)
    return dataset.categorize(rows, dataset.rank_thresholds(rows)).select("ticker", "date", "cat")


def training_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = _gains(spark, d)
    cat = dataset.categorize(rows, dataset.rank_thresholds(rows))
    scaled = dataset.min_max_scale(cat, dataset.feature_min_max(rows, ["open", "close"]), ["open", "close"])
    matrix = dataset.training_matrix(dataset.drop_null_rows(scaled, ["open", "close", "cat"]), ["open", "close"])
    return rounded(matrix.select("ticker", "date", *[F.col("features")[i].alias(f"x{i}") for i in range(3)]))


# clustering ------------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, d: str, runs: int = 1) -> DataFrame:
    return kmeans.restarts(fx.clustering_rows(spark, d), runs)


def _start(points: DataFrame) -> DataFrame:
    return kmeans.initial_centroids(points, K)


def nearest(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return rounded(nearest_centroid(p.select("run", "ticker", "row_id", "features"), _start(p), kmeans.KEYS).select("ticker", "row_id", "cluster", "distance"))


def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return rounded(kmeans.kmeans_step(p, _start(p)).select("ticker", "cluster", F.posexplode("center").alias("dim", "x")))


def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    """Two restarts of 100 steps."""
    return rounded(kmeans.kmeans_fit(_points(spark, d, 2), K).select("run", "ticker", "cluster", F.posexplode("center").alias("dim", "x")))


def _assigned(spark: SparkSession, d: str, runs: int = 1) -> DataFrame:
    p = kmeans.restarts(dataset.chrono_split(fx.clustering_rows(spark, d), "row_id"), runs)
    return kmeans.assign_clusters(p, _start(p))


def assign_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).groupBy("ticker", "cluster").agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(F.col("row_id"))), ",").alias("rows"))


def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.cluster_category_counts(_assigned(spark, d))


def cluster_mode(spark: SparkSession, d: str) -> DataFrame:
    return labels.cluster_mode(labels.cluster_category_counts(_assigned(spark, d)))


def _labels(spark: SparkSession, d: str, runs: int) -> DataFrame:
    counts = labels.cluster_category_counts(_assigned(spark, d, runs), keys=kmeans.KEYS)
    return labels.label_clusters(counts, dataset.rank_thresholds(fx.clustering_rows(spark, d)), CATEGORIES, STRONG, SOME, kmeans.KEYS)


def label_clusters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_labels(spark, d, 1).drop("run"))


def best_strong_buys(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.best_strong_buys(_labels(spark, d, RUNS)))


def strong_buy_count(spark: SparkSession, d: str) -> DataFrame:
    return labels.strong_buy_count(_labels(spark, d, RUNS))


def score_latest(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return rounded(scoring.score_latest(p.drop("run"), _start(p).drop("run"), _labels(spark, d, 1).drop("run")))


# scoring and orders ----------------------------------------------------------------------------------------------------


def _user_labels(spark: SparkSession, d: str) -> DataFrame:
    users = fx.table(spark, d, "events").select("user_id").distinct()
    return users.select(F.col("user_id").cast("string").alias("ticker"), F.array(*map(F.lit, LABELS))[(F.col("user_id") % 7).cast("int")].alias("label"))


def _user_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return dataset.rank_thresholds(fx.quotes(spark, d, "user_id").withColumn("gain", pct_gain(F.col("ask"), F.col("bid"))))


def usable_tickers(spark: SparkSession, d: str) -> DataFrame:
    q = fx.quotes(spark, d, "user_id")
    return scoring.usable_tickers(q, *[q.where(F.col("event_type") == t) for t in EVENT_TYPES])


def pick_buys(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.pick_buys(_user_labels(spark, d), _user_thresholds(spark, d), total=300.0))


def filter_orders(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("entered"), F.col("o_orderstatus").alias("status"))
    return orders.filter_orders(o, datetime(1996, 1, 1), datetime(1998, 12, 31), "F")


def order_touch(spark: SparkSession, d: str) -> DataFrame:
    return orders.buy_touch(fx.buy_orders(spark, d), fx.order_quotes(spark, d)).select("order_id", "ticker", "touch_ts")


def fills(spark: SparkSession, d: str) -> DataFrame:
    return rounded(orders.fills(fx.buy_orders(spark, d), fx.order_quotes(spark, d)).withColumn("quantity", F.col("quantity").cast("int")))


def sell_touch(spark: SparkSession, d: str) -> DataFrame:
    """Touched buys become stock with a limit of a fifth above."""
    bought = orders.buy_touch(fx.buy_orders(spark, d), fx.order_quotes(spark, d)).where("touch_ts is not null")
    stock = bought.select("order_id", "ticker", F.col("touch_ts").alias("buy_ts"), cents(F.col("limit_price") * 1.2).alias("limit_sell_price"))
    return rounded(orders.sell_touch(stock, fx.order_quotes(spark, d)))


def link_fills(spark: SparkSession, d: str) -> DataFrame:
    f = orders.fills(fx.buy_orders(spark, d), fx.order_quotes(spark, d))
    buys = f.where("state <> 'open'").select(F.col("order_id").alias("buy_order_id"), F.col("buy_price").alias("price"), "quantity", F.col("buy_ts").alias("time_filled"))
    sells = f.where("state = 'past'").select(
        (F.col("order_id") + 1_000_000_000).alias("sell_order_id"), "ticker", F.col("sell_price"), F.col("sell_ts").alias("sell_time"), F.col("order_id").alias("buy_order_id_link")
    )
    return rounded(orders.link_fills(sells, buys).withColumn("quantity", F.col("quantity").cast("int")))


def _book(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Open orders and held stock after all fills."""
    o = fx.buy_orders(spark, d)
    f = orders.fills(o, fx.order_quotes(spark, d))
    return o.join(f.where("state = 'open'").select("order_id"), "order_id"), f.where("state = 'held'")


def total_balance(spark: SparkSession, d: str) -> DataFrame:
    return orders.total_balance(*_book(spark, d), 300.0)


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return fx.order_quotes(spark, d).groupBy("ticker").agg(*[F.max_by(c, "ts").alias(c) for c in ("bid", "ask", "price")])


def tradable(spark: SparkSession, d: str) -> DataFrame:
    volume = fx.quotes(spark, d, "user_id").groupBy("ticker", F.to_date("ts").alias("date")).agg((F.sum("size") * 1000).alias("volume"))
    total = float(orders.total_balance(*_book(spark, d), 300.0).first()["total"])
    return rounded(orders.tradable(_latest(spark, d), align.average_volume(volume), total).select("ticker", "price", "avg_volume"))


def _now(spark: SparkSession, d: str) -> datetime:
    return fx.table(spark, d, "events").agg(F.max("ts")).first()[0]


def sell_decisions(spark: SparkSession, d: str) -> DataFrame:
    _, held = _book(spark, d)
    # every second position has a sell order
    stock = held.select("order_id", "ticker", "buy_ts", "buy_price", F.when(F.col("order_id") % 2 == 0, F.col("order_id")).alias("limit_sell_id"), cents(F.col("buy_price") * 1.2).alias("limit_sell_price"))
    last = _user_thresholds(spark, d).groupBy("ticker").agg(F.max_by("t", "i").alias("t_last"))
    return rounded(orders.sell_decisions(stock, _latest(spark, d), _user_labels(spark, d), last, _now(spark, d)))


def cancel_decisions(spark: SparkSession, d: str) -> DataFrame:
    return orders.cancel_decisions(_book(spark, d)[0], _user_labels(spark, d), _now(spark, d))


QUERIES = {
    "sma_daily": _daily(indicators.sma_daily),
    "std_daily": _daily(indicators.std_daily),
    "bollinger_daily": _daily(indicators.bollinger_daily),
    "ema_daily": _daily(indicators.ema_daily),
    "macd_daily": _daily(indicators.macd_daily),
    "rsi_daily": _daily(indicators.rsi_daily),
    "stochastic_daily": _daily(stochastic_daily),
    "sma_minute": _minute(indicators.sma_minute),
    "std_minute": _minute(indicators.std_minute),
    "bollinger_minute": _minute(indicators.bollinger_minute),
    "ema_minute": _minute(indicators.ema_minute),
    "macd_minute": _minute(indicators.macd_minute),
    "rsi_minute": _minute(indicators.rsi_minute),
    "stochastic_minute": _minute(indicators.stochastic_minute),
    "nearest_centroid": nearest,
} | {
    f.__name__: f
    for f in (
        candles_json, daily_stamp, minute_bars, dedupe_bars, history_summary, average_volume, last_n, roll_features, quotes_wide, minute_end, retention, wide_merge,
        market_holidays, daily_grid, minute_grid, session_filter, rows_per_session, asof_align, gap_fill,
        diff_high_low, lag_close, day_high_low, spread_feature, features_all,
        feature_min_max, min_max_scale, future_close, future_close_minute, all_null_columns, drop_null_rows, chrono_split, rank_thresholds, categorize, training_matrix,
        kmeans_step, kmeans_fit, assign_clusters, cluster_counts, cluster_mode, label_clusters, best_strong_buys, strong_buy_count, score_latest,
        usable_tickers, pick_buys, filter_orders, order_touch, sell_touch, fills, link_fills, total_balance, tradable, sell_decisions, cancel_decisions,
    )
}
