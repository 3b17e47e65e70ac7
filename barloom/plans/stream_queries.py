"""Registered queries on streams: each replays the given events in pieces, with a restart after each, and returns all that
the stream gave out. Their SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import mid_price, pct_gain
from barloom.operators import calendar, dataset, indicators, orders
from barloom.plans.oracles import BOOK, holidays, r, sql
from barloom.plans.queries import LABELS, _event_range, rounded
from barloom.sources import fixtures as fx
from barloom.sources.shared import checkpointed
from barloom.streaming import quotes as streams
from barloom.streaming.replay import replayed

MOST, DROP = 60, 20
TOTAL = 300.0
SCORED = ["close", "close1min"]


def _zoned(rows: DataFrame, *names: str) -> DataFrame:
    """Times as a stream's event time needs them."""
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in names})


def _plain(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


def _quotes(spark: SparkSession, d: str, ticker: str = "event_type") -> DataFrame:
    return _zoned(fx.quotes(spark, d, ticker).select("ticker", "ts", "bid", "ask", "event_id"), "ts")


def _a_day_later(rows: DataFrame, order: str = "ts") -> DataFrame:
    """The last row once more, a day later, whose coming closes what is open."""
    return rows.orderBy(F.desc(order)).limit(1).withColumn(order, F.col(order) + F.expr("INTERVAL 1 DAY"))


def stream_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Mid prices of the session's quotes."""
    closed = checkpointed(calendar.market_holidays(_event_range(spark, d)))
    return rounded(_plain(replayed(_quotes(spark, d), "ts", lambda s: streams.session_quotes(s, closed)), "ts"))


def stream_minute_bars(spark: SparkSession, d: str) -> DataFrame:
    rows = _quotes(spark, d)
    bars = replayed(rows, "ts", lambda s: streams.minute_bars_stream(s.select("ticker", "ts", mid_price(F.col("bid"), F.col("ask")).alias("price"))), last=_a_day_later(rows))
    return rounded(_plain(bars, "ts"))


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    return _zoned(fx.minute_bars(spark, d).drop("date", "volume"), "ts")


def stream_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Minute bars of the session, filled up to the last watermark: two minutes before the newest bar of all tickers."""
    rows = _minutes(spark, d).select("ticker", "ts", F.col("close").alias("price"))
    return rounded(_plain(replayed(rows, "ts", streams.gap_fill_stream), "ts"))


def stream_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = _quotes(spark, d, "user_id").select("ticker", "ts", F.col("event_id").alias("row_id"))
    changes = replayed(rows, "ts", lambda s: streams.retention_stream(s, MOST, DROP))
    return _plain(streams.kept_rows(changes), "ts").select(F.col("row_id").alias("event_id"), "ticker", "ts")


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scaling, centers, labels and thresholds of every ticker: the bounds of its closes, a center for each label along
    the price, thresholds of its spreads."""
    bars = fx.minute_bars(spark, d)
    close = dataset.feature_min_max(bars, ["close"])
    scaling = close.unionByName(close.withColumn("feature", F.lit("close1min")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(LABELS) - 1).cast("long")))
    named = bars.select("ticker").distinct().select("ticker", each.alias("cluster"))
    centers = named.withColumn("center", F.array(F.col("cluster") / 24.0, (F.col("cluster") % 3) / 2.0))
    labels = named.withColumn("label", F.array(*map(F.lit, LABELS))[F.col("cluster").cast("int")])
    thresholds = dataset.rank_thresholds(fx.quotes(spark, d).withColumn("gain", pct_gain(F.col("ask"), F.col("bid"))))
    return tuple(checkpointed(t) for t in (scaling, centers, labels, thresholds))


def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every minute bar's cluster and label, from the days' state before it."""
    scaling, centers, labels, _ = _model(spark, d)
    state = checkpointed(indicators.daily_state(fx.daily_short(spark, d)))
    scores = replayed(_minutes(spark, d), "ts", lambda s: streams.score_stream(s, state, scaling, centers, labels, SCORED))
    return rounded(_plain(scores, "ts"))


def stream_picks(spark: SparkSession, d: str) -> DataFrame:
    """What to buy in each minute, by a sink that writes a batch again where it is run again."""
    scaling, centers, labels, thresholds = _model(spark, d)
    state = checkpointed(indicators.daily_state(fx.daily_short(spark, d)))
    score = lambda s: streams.score_stream(s, state, scaling, centers, labels, SCORED)
    picks = replayed(_minutes(spark, d), "ts", score, sink=lambda path: streams.picks_sink(path, thresholds, TOTAL))
    return rounded(_plain(picks, "ts").select("ts", "ticker", "t_last"))


def stream_order_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no quote has touched within ten minutes."""
    placed = fx.buy_orders(spark, d)
    touched = checkpointed(orders.buy_touch(placed, fx.order_quotes(spark, d)))
    begin = touched.select("order_id", F.col("placed_ts").alias("ts"), F.lit("placed").alias("kind"), (F.col("limit_price") * F.col("quantity")).alias("refund"))
    end = touched.where("touch_ts is not null").select("order_id", F.col("touch_ts").alias("ts"), F.lit("filled").alias("kind"), F.lit(0.0).alias("refund"))
    events = _zoned(begin.unionByName(end), "ts")
    last = _a_day_later(events).withColumn("order_id", F.lit(-1).cast("long"))
    return rounded(_plain(replayed(events, "ts", streams.order_timeout_stream, last=last), "cancel_ts"))


QUERIES = {f.__name__: f for f in (stream_quotes, stream_minute_bars, stream_gap_fill, stream_retention, stream_scores, stream_picks, stream_order_timeouts)}

_SCORES = [
    "bd as (select ticker, min(close) lc, max(close) hc from m group by 1)",
    """sm as (select ticker, ts, close, (close - lc) / nullif(hc - lc, 0) x, (before - lc) / nullif(hc - lc, 0) y
      from (select *, lag(close) over (partition by ticker order by ts) before from m) join bd using (ticker))""",
    """sr as (select ticker, ts, close, case when x is not null and y is not null then c end cluster from (
      select *, row_number() over (partition by ticker, ts order by (x - c / 24.0::double) * (x - c / 24.0::double) + (y - (c % 3) / 2.0::double) * (y - (c % 3) / 2.0::double), c) b
      from sm, (select unnest(range(0, 7))::bigint c)) where b = 1)""",
    f"sl as (select *, [{', '.join(repr(x) for x in LABELS)}][cluster + 1] \"label\" from sr)",
    """st as (select ticker, gain t_last from (select ticker, (ask - bid) / nullif(bid, 0) gain, row_number() over (partition by ticker order by (ask - bid) / nullif(bid, 0)) - 1 rk,
      count(*) over (partition by ticker) n from q where bid <> 0) where n >= 8 and rk = ceil(n * 7 / 8.0))""",
]

ORACLES = {
    "stream_quotes": sql(
        f"select ticker, ts, {r('price', 'price')} from q where isodow(ts) < 6 and ts::date not in (select date from hol) and ts::time between time '04:00:00' and time '17:00:00'", holidays("hol", "span")
    ),
    "stream_minute_bars": sql(f"select ticker, date_trunc('minute', ts)::timestamp + interval 1 minute ts, {r('arg_max(price, ts)', 'price')} from q group by 1, 2"),
    "stream_gap_fill": sql(
        f"""select g.ticker, g.ts, {r('m.close', 'price')}, m.ts <> g.ts filled from g asof join m on g.ticker = m.ticker and g.ts >= m.ts join (select ticker, max(ts) b from m group by 1) e on e.ticker = g.ticker
        where g.ts <= greatest(b, (select max(ts) from m) - interval 2 minute)""",
        holidays("hol", "span"),
        """g as (select ticker, date + interval 4 hour + to_minutes(i) ts from (select distinct ticker from q), (select unnest(generate_series(lo, hi, interval 1 day))::date date from span),
          (select unnest(range(0, 781))::int i) where isodow(date) < 6 and date not in (select date from hol))""",
    ),
    "stream_retention": sql(
        f"""select event_id, uid ticker, ts from (select event_id, uid, ts, row_number() over (partition by uid order by ts, event_id) i, count(*) over (partition by uid) n from q)
        where n <= {MOST} or i > {DROP} * ceil((n - {MOST}) / {DROP}.0)"""
    ),
    "stream_scores": sql(f"select ticker, ts, {r('close', 'close')}, cluster, \"label\" from sl", *_SCORES),
    "stream_picks": sql(
        f"select ts, ticker, {r('t_last', 't_last')} from (select ts, ticker, t_last, row_number() over (partition by ts order by t_last desc, ticker) k from sl join st using (ticker) where \"label\" = 'Strong Buy') where k <= 3",
        *_SCORES,
    ),
    "stream_order_timeouts": sql(
        f"select order_id, placed_ts + interval 10 minute cancel_ts, {r('limit_price * quantity', 'refund')} from bt where touch_ts is null or touch_ts > placed_ts + interval 10 minute", *BOOK
    ),
}
assert set(ORACLES) == set(QUERIES)
