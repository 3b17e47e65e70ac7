"""Quotes as a stream: mid prices, minute bars, gap filling, retention, scoring, order time-outs.

Streams need event times with a zone (the session's is UTC); bars that batch jobs make from the same quotes are equal
once the watermark has passed them.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from barloom.functions.nearest import squared_distance
from barloom.functions.scalars import in_session, mid_price
from barloom.operators.calendar import market_holidays
from barloom.operators.indicators import add_bias, diff_high_low, one_step, select_features
from barloom.params import CLOSE_MINUTE, LAGS, OPEN_MINUTE, Trading

WATERMARK = "2 minutes"


def quote_stream(spark: SparkSession, path: str, schema: str = "ticker string, ts timestamp, bid double, ask double", files: int | None = None) -> DataFrame:
    """Quotes from Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def session_quotes(quotes: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """(ticker, ts, price) of quotes with both prices, in the session; stateless. holidays: (date), a few rows a year."""
    rows = quotes.select("ticker", "ts", mid_price(F.col("bid"), F.col("ask")).alias("price")).where(F.col("price").isNotNull() & in_session(F.col("ts").cast("timestamp_ntz")))
    if holidays is None:
        return rows
    return rows.withColumn("date", F.to_date("ts")).join(holidays.select("date").distinct(), "date", "left_anti").drop("date")


def minute_bars_stream(prices: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(ticker, ts, price): the last price of each minute, stamped with its end, once the watermark has passed it."""
    w = F.window("ts", "1 minute")
    bars = prices.withWatermark("ts", watermark).groupBy("ticker", w.alias("window")).agg(F.max_by("price", "ts").alias("price"))
    return bars.select("ticker", F.col("window.end").alias("ts"), "price")


def _on_timers(rows: DataFrame) -> DataFrame:
    """Timers and list states are kept in RocksDB only; it also holds more keys than memory does."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows


MINUTE = 60_000_000  # microseconds
DAY = 24 * 60 * MINUTE


class Sessions:
    """Session minutes in microseconds since the epoch: 04:00 to 17:00 of weekdays that are no holiday."""

    def __init__(self, holidays: Iterable[date]):
        self.closed = {(d - date(1970, 1, 1)).days for d in holidays}

    def is_open(self, day: int) -> bool:
        return (day + 3) % 7 < 5 and day not in self.closed

    def on_grid(self, at: int) -> bool:
        day, rest = divmod(at, DAY)
        return rest % MINUTE == 0 and OPEN_MINUTE <= rest // MINUTE <= CLOSE_MINUTE and self.is_open(day)

    def after(self, at: int) -> int:
        """The first session minute after a time."""
        day, rest = divmod(at, DAY)
        minute = max(rest // MINUTE + 1, OPEN_MINUTE)
        if minute > CLOSE_MINUTE or not self.is_open(day):
            day, minute = day + 1, OPEN_MINUTE
            while not self.is_open(day):
                day += 1
        return day * DAY + minute * MINUTE

    def between(self, after: int, until: int) -> np.ndarray:
        """Session minutes after a time and up to another, the latter included."""
        days = [d for d in range(after // DAY, until // DAY + 1) if self.is_open(d)]
        found = [np.arange(max(d * DAY + OPEN_MINUTE * MINUTE, (after // MINUTE + 1) * MINUTE), min(d * DAY + CLOSE_MINUTE * MINUTE, until) + 1, MINUTE, dtype=np.int64) for d in days]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


class _GapFill(StatefulProcessor):
    """State of a ticker: up to which time it has been given out (microseconds), and the last price."""

    def __init__(self, sessions: Sessions):
        self.sessions = sessions

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "upto long, price double")

    def _out(self, ticker: str, parts: list[tuple[np.ndarray, float, bool]]) -> pd.DataFrame:
        n = [len(m) for m, _, _ in parts]
        at = np.concatenate([m for m, _, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
        return pd.DataFrame(
            {
                "ticker": [ticker] * len(at),
                "ts": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us"),
                "price": np.repeat([float(p) for _, p, _ in parts], n),
                "filled": np.repeat([f for _, _, f in parts], n).astype(bool),
            }
        )

    def _wake_up(self, upto: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(self.sessions.after(upto) // 1000)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        bars = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable").drop_duplicates("ts", keep="last")
        upto, price = self.last.get() if self.last.exists() else (None, None)
        parts = []
        for at, now in zip(_micros(bars["ts"]), bars["price"], strict=True):
            if upto is not None:
                if at <= upto:
                    continue
                parts.append((self.sessions.between(upto, at - 1), price, True))
            if self.sessions.on_grid(at):
                parts.append((np.array([at], dtype=np.int64), now, False))
            upto, price = at, now
        self.last.update((upto, float(price)))
        self._wake_up(upto)
        yield self._out(key[0], parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        """Bars up to the watermark can't come any more: what is missing up to there is filled."""
        upto, price = self.last.get()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        minutes = self.sessions.between(upto, now)
        if len(minutes):
            upto = int(minutes[-1])
            self.last.update((upto, price))
        self._wake_up(upto)
        yield self._out(key[0], [(minutes, price, True)])

    def close(self) -> None:
        pass


def all_holidays(spark: SparkSession, start: str = "1970-01-01", end: str = "2100-12-31") -> DataFrame:
    """(date) of the market's holidays, nine a year."""
    return market_holidays(spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))).select("date")


def gap_fill_stream(bars: DataFrame, holidays: DataFrame | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Minute bars (ticker, ts, price) of the session with its missing minutes at the last price; ``filled`` marks those.

    A minute is filled when a later bar of the ticker comes or else when the watermark passes it, whichever is first, so
    a ticker without quotes has its price for the current minute. Weekends and holidays (date; by default all that the
    market's rules give) have no minutes. Bars outside of the session hand on their price and are not given out. A
    ticker's state is one time and one price; a minute that was given out is never given again. A bar at or before the
    watermark is late and dropped. Collects the holidays, nine a year.
    """
    days = all_holidays(bars.sparkSession) if holidays is None else holidays
    sessions = Sessions(r.date for r in days.select("date").distinct().collect())
    marked = _on_timers(bars.select("ticker", "ts", "price").withWatermark("ts", watermark))
    return marked.groupBy("ticker").transformWithStateInPandas(_GapFill(sessions), "ticker string, ts timestamp, price double, filled boolean", "append", "eventTime")


_BARS = "ticker string, ts timestamp, open double, high double, low double, close double, day_high double, day_low double"


def _running(lags: dict[str, int]):
    reach = max(lags.values())

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State: the last minute (microseconds), the day's extremes so far, and the last closes."""
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts").drop_duplicates("ts", keep="last")
        last, high, low, closes = (state.get[0], state.get[1], state.get[2], json.loads(state.get[3])) if state.exists else (None, None, None, [])
        if last is not None:
            rows = rows[rows["ts"] > pd.Timestamp(last, unit="us")]
        if len(rows):
            date = rows["ts"].dt.normalize()
            if last is not None and pd.Timestamp(last, unit="us").normalize() == date.iloc[0]:
                first = date == date.iloc[0]
                rows = rows.assign(_h=rows["high"].where(~first, rows["high"].clip(lower=high)), _l=rows["low"].where(~first, rows["low"].clip(upper=low)))
            else:
                rows = rows.assign(_h=rows["high"], _l=rows["low"])
            rows = rows.assign(day_high=rows["_h"].groupby(date).cummax(), day_low=rows["_l"].groupby(date).cummin())
            whole = pd.Series([*closes, *rows["close"]], dtype=float)
            for name, n in lags.items():
                rows[name] = whole.shift(n).to_numpy()[len(closes) :]
            end = rows.iloc[-1]
            state.update((int(end["ts"].value // 1000), float(end["day_high"]), float(end["day_low"]), json.dumps(whole.tolist()[-reach:])))
            rows["ticker"] = key[0]
            yield rows[[*(f.split()[0] for f in _BARS.split(", ")), *lags]]

    return run


def running_bars(bars: DataFrame, lags: dict[str, int] = LAGS) -> DataFrame:
    """Minute bars (ticker, ts, open, high, low, close) with date, the day's extremes so far and the closes of n bars before.

    A ticker's state is its last bars' closes and the day's extremes; a bar that is not newer than the last is dropped.
    """
    made = bars.groupBy("ticker").applyInPandasWithState(
        _running(lags), ", ".join([_BARS, *(f"{c} double" for c in lags)]), "last long, high double, low double, closes string", "append", GroupStateTimeout.NoTimeout
    )
    # made here, not in Python: an operator that takes whole rows can't follow that one directly
    return made.withColumn("date", F.to_date("ts"))


def features_stream(bars: DataFrame, state: DataFrame) -> DataFrame:
    """(ticker, ts, date and all features) of minute bars (ticker, ts, open, high, low, close), or of prices (ticker, ts, price).

    state: ``daily_state``, one row for each ticker and date; all indicators are one step from it, by a stream-static join.
    """
    if "price" in bars.columns:
        bars = bars.select("ticker", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")])
    rows = running_bars(bars).join(state, ["ticker", "date"], "left")
    return select_features(add_bias(diff_high_low(one_step(rows))))


def score_stream(minutes: DataFrame, state: DataFrame, scaling: DataFrame, centroids: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """(ticker, ts, close, cluster, label) of minute bars or prices, from yesterday's daily state.

    Any of the features of ``features_stream``, scaled by (ticker, feature, min, max), make the point that is compared
    with the ticker's centroids. A ticker without a model has no rows; a point with a missing feature has no cluster.
    """
    rows = features_stream(minutes, state).select("ticker", "ts", *dict.fromkeys(["close", *features]))
    bounds = scaling.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("min", "max")))).alias("b"))
    model = centroids.groupBy("ticker").agg(F.collect_list(F.struct("cluster", "center")).alias("centers"))
    names = labels.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "label"))).alias("names"))
    joined = rows.join(bounds.join(model, "ticker").join(names, "ticker"), "ticker")
    b = lambda f: F.try_element_at(F.col("b"), F.lit(f))
    scaled = F.array(*[(F.col(f) - b(f)["min"]) / F.nullif(b(f)["max"] - b(f)["min"], F.lit(0.0)) for f in features])
    point = joined.withColumn("features", scaled)
    near = F.transform("centers", lambda c: F.struct(squared_distance(F.col("features"), c["center"]).alias("d"), c["cluster"].alias("cluster")))
    best = F.array_min(F.filter(near, lambda x: x["d"].isNotNull()))
    return point.withColumn("cluster", best["cluster"]).select("ticker", "ts", "close", "cluster", F.when(F.col("cluster").isNotNull(), F.try_element_at("names", F.col("cluster"))).alias("label"))


def picks_by_minute(scores: DataFrame, thresholds: DataFrame, total: float, trading: Trading = Trading()) -> DataFrame:
    """(ts, ticker, t_last) to buy in each minute of scores (ticker, ts, label): ``pick_buys`` minute by minute."""
    last = thresholds.groupBy("ticker").agg(F.max_by("t", "i").alias("t_last"))
    strong = scores.where("label = 'Strong Buy'").select("ts", "ticker").join(last, "ticker")
    ranked = strong.withColumn("_r", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("t_last"), "ticker")))
    return ranked.where(F.col("_r") <= trading.number_of_buys(total)).select("ts", "ticker", "t_last")


def picks_sink(path: str, thresholds: DataFrame, total: float, trading: Trading = Trading()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on ``score_stream``: each batch's picks go to a folder of its own below ``path``, named by the
    batch's number, and replace what is there. A batch that is run again after a failure leaves what it left before.

    A minute's scores come in one batch, as those of ``minute_bars_stream`` do.
    """

    def write(batch: DataFrame, number: int) -> None:
        picks_by_minute(batch, thresholds, total, trading).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


class _Retention(StatefulProcessor):
    """State of a ticker: its kept rows as a list that grows by appending, their number and newest time. Only a ticker that
    comes to too many rows has its list read and written anew."""

    def __init__(self, most: int, drop: int, idle: timedelta):
        self.most, self.drop, self.idle_ms = most, drop, int(idle.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "ts long, row_id long")
        self.count = handle.getValueState("count", "n long, newest long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        come = sorted(zip(_micros(new["ts"]), new["row_id"].tolist(), strict=True))
        n, newest = self.count.get() if self.count.exists() else (0, come[-1][0])
        gone: list[tuple[int, int]] = []
        if n + len(come) <= self.most:
            self.kept.appendList(come)
            n += len(come)
        else:
            held = sorted(tuple(r) for r in self.kept.get()) if n else []
            for row in come:
                insort(held, row)
                if len(held) > self.most:
                    gone += held[: self.drop]
                    del held[: self.drop]
            self.kept.put(held)
            n = len(held)
        newest = max(newest, come[-1][0])
        self.count.update((n, newest))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest // 1000 + self.idle_ms)
        both = [(*r, False) for r in come] + [(*r, True) for r in gone]
        yield pd.DataFrame(
            {
                "ticker": [key[0]] * len(both),
                "ts": pd.to_datetime(pd.Series([b[0] for b in both], dtype="int64"), unit="us"),
                "row_id": pd.Series([b[1] for b in both], dtype="int64"),
                "gone": pd.Series([b[2] for b in both], dtype=bool),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.kept.clear()
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def retention_stream(rows: DataFrame, most: int, drop: int, idle: timedelta = timedelta(days=90), watermark: str = "1 hour") -> DataFrame:
    """(ticker, ts, row_id, gone): what comes into the kept table and what leaves it, from rows (ticker, ts, row_id).

    Each time a ticker comes to more than ``most`` rows, its oldest ``drop`` go (by ts, then row_id). State is ``most``
    pairs of numbers for each ticker, and goes where a ticker has had no rows for ``idle`` of event time: its rows then
    stay in the table, and it is counted anew. Rows behind the watermark are dropped. ``kept_rows`` is the table.
    """
    marked = _on_timers(rows.select("ticker", "ts", F.col("row_id").cast("long").alias("row_id")).withWatermark("ts", watermark))
    return marked.groupBy("ticker").transformWithStateInPandas(_Retention(most, drop, idle), "ticker string, ts timestamp, row_id long, gone boolean", "append", "eventTime")


def kept_rows(changes: DataFrame) -> DataFrame:
    """(ticker, ts, row_id) that came and have not gone, from all that ``retention_stream`` gave out."""
    return changes.groupBy("ticker", "ts", "row_id").agg(F.max("gone").alias("gone")).where("not gone").drop("gone")


def order_timeout_stream(events: DataFrame, trading: Trading = Trading(), watermark: str = WATERMARK) -> DataFrame:
    """(order_id, cancel_ts, refund) of orders that are neither filled nor held on to within ten minutes of event time.

    events: (order_id, ts, kind, refund), kind is placed, filled or keep (the ticker still is a Strong Buy). Only their
    times count, not the batches in which they come. An order's events up to ten minutes apart are one session, which the
    engine sums up in a few numbers; what ends an order in time is in the session of its placement. State goes with it.
    """
    wait, placed = F.expr(f"INTERVAL {trading.cancel_minutes} MINUTES"), F.col("kind") == "placed"
    # an end after just ten minutes is in time
    session = F.session_window("ts", f"{trading.cancel_minutes} minutes 1 microsecond")
    sessions = _on_timers(events.withWatermark("ts", watermark)).groupBy("order_id", session).agg(
        F.max(F.when(placed, F.struct("ts", "refund"))).alias("placed"), F.min(F.when(~placed, F.col("ts"))).alias("done")
    )
    late = F.col("placed").isNotNull() & (F.col("done").isNull() | (F.col("done") > F.col("placed.ts") + wait))
    return sessions.where(late).select("order_id", (F.col("placed.ts") + wait).alias("cancel_ts"), F.col("placed.refund").alias("refund"))
