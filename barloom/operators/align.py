"""Bars: cleaning, alignment onto the session grid, gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ranks import with_rank

BAR = ("open", "high", "low", "close", "volume")


def append_bars(*histories: DataFrame) -> DataFrame:
    first, *others = histories
    for h in others:
        first = first.unionByName(h)
    return first


def dedupe_bars(bars: DataFrame) -> DataFrame:
    """One bar for each (ticker, ts): of several, the greatest by (volume, close, open, high, low)."""
    values = F.struct("volume", "close", "open", "high", "low")
    return bars.groupBy("ticker", "ts").agg(F.max(values).alias("b")).select("ticker", "ts", *[F.col(f"b.{c}") for c in BAR])


def asof_align(grid: DataFrame, bars: DataFrame, carry_volume: bool = False) -> DataFrame:
    """grid (ticker, date, ts, ...) with the last bar at or before each row; nulls before a ticker's first bar.

    Windows span one day of one ticker: what an earlier day hands on comes from a table of each day's last bar, so a long
    history adds days, not longer sorts. A filled row has volume 0, or the bar's own with ``carry_volume``.
    """
    values = F.struct(*BAR, F.col("ts").alias("bar_ts"))
    lasts = bars.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.max_by(values, "ts").alias("last"))
    days = grid.select("ticker", "date").distinct().withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType)).withColumn("wanted", F.lit(True))
    earlier = Window.partitionBy("ticker").orderBy("date", "wanted").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        lasts.withColumn("wanted", F.lit(False))
        .unionByName(days)
        # a day's own last bar comes before its grid row in this order and must not count
        .withColumn("before", F.last(F.when(~F.col("wanted"), F.struct("date", "last")), ignorenulls=True).over(earlier))
        .withColumn("older", F.lag("before").over(Window.partitionBy("ticker").orderBy("date", "wanted")))
        .where("wanted")
        .select("ticker", "date", F.when(F.col("before.date") < F.col("date"), F.col("before.last")).otherwise(F.col("older.last")).alias("carry"))
    )
    extra = [c for c in grid.columns if c not in ("ticker", "date", "ts")]
    rows = grid.select("ticker", "date", "ts", *extra, F.lit(True).alias("on_grid"), F.lit(None).cast(lasts.schema["last"].dataType).alias("bar"))
    known = bars.select("ticker", F.to_date("ts").alias("date"), "ts", *[F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in extra], F.lit(False).alias("on_grid"), values.alias("bar"))
    upto = Window.partitionBy("ticker", "date").orderBy("ts", "on_grid").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.unionByName(known).withColumn("bar", F.last("bar", ignorenulls=True).over(upto)).where("on_grid")
    bar = F.coalesce("bar", "carry")
    joined = filled.join(carried, ["ticker", "date"], "left").withColumn("b", bar)
    volume = F.col("b.volume") if carry_volume else F.when(F.col("b.bar_ts") == F.col("ts"), F.col("b.volume")).when(F.col("b").isNotNull(), 0)
    return joined.select("ticker", "date", "ts", *extra, *[F.col(f"b.{c}") for c in BAR if c != "volume"], volume.cast("long").alias("volume"))


def gap_fill(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """Grid minutes from a ticker's first to its last bar, with the bar or else the last price before it."""
    span = bars.groupBy("ticker").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    inside = grid.join(span, "ticker").where("ts between first_ts and last_ts").drop("first_ts", "last_ts")
    return asof_align(inside, bars)


def minute_bar(quotes: DataFrame) -> DataFrame:
    """(ticker, ts, price): the last mid price of each minute, stamped with the minute's end."""
    w = F.window("ts", "1 minute")
    return quotes.where("bid is not null and ask is not null").groupBy("ticker", w).agg(F.max_by((F.col("bid") + F.col("ask")) / 2, "ts").alias("price")).select("ticker", F.col("window.end").alias("ts"), "price")


def history_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("open", "ts").alias("first_open"), F.max_by("close", "ts").alias("last_close")
    )


def last_n(rows: DataFrame, n: int, order: str = "date") -> DataFrame:
    """The newest n rows of each ticker with ``days_ago``, 1 for the newest."""
    return rows.withColumn("days_ago", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(order)))).where(F.col("days_ago") <= n)


def roll_features(stored: DataFrame, today: DataFrame, n: int = 3, order: str = "date") -> DataFrame:
    """Today's rows join the stored ones; the newest n of each ticker stay."""
    return last_n(stored.drop("days_ago").unionByName(today), n, order)


def average_volume(daily: DataFrame, n: int = 30) -> DataFrame:
    """Sum of the last n daily volumes over n, however many days there are."""
    return last_n(daily, n).groupBy("ticker").agg((F.sum("volume") / n).alias("avg_volume"))


def retention(rows: DataFrame, most: int, drop: int, order: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """A ticker with more than ``most`` rows loses its oldest ``drop``; ties: the columns that order rows of one time."""
    return with_rank(rows, "ticker", order, ties=ties).where((F.col("_n") <= most) | (F.col("_i") >= drop)).select(*rows.columns)


def rows_per_session(grid: DataFrame) -> DataFrame:
    return grid.groupBy("ticker", "date").agg(F.count("*").alias("n_rows"))


def wide_merge(aligned: DataFrame, tickers: list[str], columns: list[str]) -> DataFrame:
    """One row for each grid time, and for each ticker its columns, named ticker_column; for those who ask for width."""
    wide = aligned.groupBy("ts").pivot("ticker", tickers).agg(*[F.first(c).alias(c) for c in columns])
    if len(columns) == 1:  # pivot then leaves the column's name out
        return wide.withColumnsRenamed({t: f"{t}_{columns[0]}" for t in tickers})
    return wide


def quotes_wide(quotes: DataFrame, tickers: list[str], every: str = "1 hour") -> DataFrame:
    """One row for each period, and for each ticker its last bid, bid size, ask and ask size."""
    last = lambda c: F.max_by(c, "ts").alias(c)
    w = quotes.groupBy(F.window("ts", every).start.alias("ts")).pivot("ticker", tickers)
    return w.agg(last("bid"), last("bid_size"), last("ask"), last("ask_size"))
