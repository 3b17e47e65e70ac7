"""Technical indicators: a daily form, and a minute form that puts the current price in place of today's close.

The minute form needs a few numbers of the days before, which a left join on (ticker, date) brings to the minute rows.
Moving averages and deviations need all their p values; stochastic extremes take what there is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import ratio
from barloom.functions.smoothing import seeded, smooth
from barloom.params import BOLLINGER, GRID_MINUTES, LAGS, MACD_FAST, MACD_SIGNAL, MACD_SLOW, MEAN_PERIODS, RSI_PERIOD, STOCHASTIC_PERIOD

def W():  # noqa: N802
    """A ticker's days; made when used, as windows need a session."""
    return Window.partitionBy("ticker").orderBy("date")



def _full(value: Column, count: Column, n: int) -> Column:
    return F.when(count == n, value)


def join_minute_daily(minute: DataFrame, daily: DataFrame) -> DataFrame:
    """Left join on (ticker, date); daily has one row for each."""
    return minute.join(daily, ["ticker", "date"], "left")


# simple moving average -------------------------------------------------------------------------------------------------


def sma_daily(daily: DataFrame, periods: tuple[int, ...] = MEAN_PERIODS) -> DataFrame:
    last = lambda p: W().rowsBetween(-(p - 1), 0)
    return daily.select("ticker", "date", *[_full(F.avg("close").over(last(p)), F.count("close").over(last(p)), p).alias(f"sma{p}") for p in periods])


def sma_state(daily: DataFrame, periods: tuple[int, ...] = MEAN_PERIODS) -> DataFrame:
    """Sums of the p - 1 closes before each day."""
    before = lambda p: W().rowsBetween(-(p - 1), -1)
    return daily.select("ticker", "date", *[_full(F.sum("close").over(before(p)), F.count("close").over(before(p)), p - 1).alias(f"sum{p}") for p in periods])


def sma_minute(minute: DataFrame, daily: DataFrame, periods: tuple[int, ...] = MEAN_PERIODS) -> DataFrame:
    rows = join_minute_daily(minute.select("ticker", "ts", "date", "close"), sma_state(daily, periods))
    return rows.select("ticker", "ts", *_sma(periods))


def _sma(periods: tuple[int, ...]) -> list[Column]:
    return [((F.col("close") + F.col(f"sum{p}")) / p).alias(f"sma{p}") for p in periods]


# deviation and Bollinger percent ---------------------------------------------------------------------------------------


def std_daily(daily: DataFrame, periods: tuple[int, ...] = tuple(BOLLINGER)) -> DataFrame:
    last = lambda p: W().rowsBetween(-(p - 1), 0)
    return daily.select("ticker", "date", *[_full(F.stddev_pop("close").over(last(p)), F.count("close").over(last(p)), p).alias(f"std{p}") for p in periods])


def std_state(daily: DataFrame, periods: tuple[int, ...] = tuple(BOLLINGER)) -> DataFrame:
    """Mean and variance of the p - 1 closes before each day."""
    before = lambda p: W().rowsBetween(-(p - 1), -1)
    full = lambda p, f: _full(f("close").over(before(p)), F.count("close").over(before(p)), p - 1)
    return daily.select("ticker", "date", *[full(p, f).alias(f"{n}{p}") for p in periods for n, f in (("mean", F.avg), ("var", F.var_pop))])


def _merged_std(price: Column, p: int) -> Column:
    """Deviation of p - 1 values with known mean and variance and one more."""
    apart = price - F.col(f"mean{p}")
    return F.sqrt(((p - 1) * F.col(f"var{p}") + apart * apart * (p - 1) / p) / p)


def std_minute(minute: DataFrame, daily: DataFrame, periods: tuple[int, ...] = tuple(BOLLINGER)) -> DataFrame:
    rows = join_minute_daily(minute.select("ticker", "ts", "date", "close"), std_state(daily, periods))
    return rows.select("ticker", "ts", *[_merged_std(F.col("close"), p).alias(f"std{p}") for p in periods])


def bollinger(price: Column, mean: Column, std: Column, width: float) -> Column:
    """Percent of the way from the lower to the upper band; null without deviation."""
    return ratio(100 * (price - (mean - width * std)), 2 * width * std)


def bollinger_daily(daily: DataFrame, bands: dict[int, float] = BOLLINGER) -> DataFrame:
    rows = sma_daily(daily, tuple(bands)).join(std_daily(daily, tuple(bands)), ["ticker", "date"]).join(daily.select("ticker", "date", "close"), ["ticker", "date"])
    return rows.select("ticker", "date", *[bollinger(F.col("close"), F.col(f"sma{p}"), F.col(f"std{p}"), k).alias(f"boll{p}") for p, k in bands.items()])


def bollinger_minute(minute: DataFrame, daily: DataFrame, bands: dict[int, float] = BOLLINGER) -> DataFrame:
    rows = join_minute_daily(minute.select("ticker", "ts", "date", "close"), std_state(daily, tuple(bands)))
    return rows.select("ticker", "ts", *_bollinger(bands))


def _bollinger(bands: dict[int, float]) -> list[Column]:
    price = F.col("close")
    mean = lambda p: (F.col(f"mean{p}") * (p - 1) + price) / p
    return [bollinger(price, mean(p), _merged_std(price, p), k).alias(f"boll{p}") for p, k in bands.items()]


# exponential averages and MACD -----------------------------------------------------------------------------------------


def _alpha(p: int) -> float:
    return 2 / (1 + p)


def ema_daily(daily: DataFrame, periods: tuple[int, ...] = MEAN_PERIODS) -> DataFrame:
    return smooth(daily, {f"ema{p}": ("close", _alpha(p)) for p in periods})


def previous_day(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Each day with the columns' values of the day before."""
    return daily.select("ticker", "date", *[F.lag(c).over(W()).alias(f"{c}_prev") for c in columns])


def _step(price: Column, state: str, alpha: float) -> Column:
    return price * alpha + F.col(f"{state}_prev") * (1 - alpha)


def ema_minute(minute: DataFrame, daily: DataFrame, periods: tuple[int, ...] = MEAN_PERIODS) -> DataFrame:
    state = previous_day(ema_daily(daily, periods), [f"ema{p}" for p in periods])
    rows = join_minute_daily(minute.select("ticker", "ts", "date", "close"), state)
    return rows.select("ticker", "ts", *_ema(periods))


def _ema(periods: tuple[int, ...]) -> list[Column]:
    return [_step(F.col("close"), f"ema{p}", _alpha(p)).alias(f"ema{p}") for p in periods]


#: Fast and slow average, line and signal of each day, for ``smooth``.
MACD = {"fast": ("close", _alpha(MACD_FAST)), "slow": ("close", _alpha(MACD_SLOW)), "line": ("fast", "slow"), "signal": ("line", _alpha(MACD_SIGNAL))}


def macd_daily(daily: DataFrame) -> DataFrame:
    return smooth(daily, MACD).select("ticker", "date", F.col("line").alias("macd_line"), F.col("signal").alias("signal_line"), (F.col("line") - F.col("signal")).alias("macd_hist"))


def _with_macd(rows: DataFrame) -> DataFrame:
    line = rows.withColumn("macd_line", _step(F.col("close"), "fast", _alpha(MACD_FAST)) - _step(F.col("close"), "slow", _alpha(MACD_SLOW)))
    return line.withColumn("signal_line", _step(F.col("macd_line"), "signal", _alpha(MACD_SIGNAL))).withColumn("macd_hist", F.col("macd_line") - F.col("signal_line"))


def macd_minute(minute: DataFrame, daily: DataFrame) -> DataFrame:
    state = previous_day(smooth(daily, MACD), ["fast", "slow", "signal"])
    rows = join_minute_daily(minute.select("ticker", "ts", "date", "close"), state)
    return _with_macd(rows).select("ticker", "ts", "macd_line", "signal_line", "macd_hist")


# relative strength -----------------------------------------------------------------------------------------------------


def _rsi(gain: Column, loss: Column) -> Column:
    """Null without losses."""
    return F.when(loss > 0, 100 - 100 / (1 + gain / F.when(loss > 0, loss)))


def _rsi_state(daily: DataFrame, p: int, seed: str) -> DataFrame:
    """Close and average gain and loss of each day; missing on the first p days."""

    def one(rows):
        rows = rows.sort_values("date")
        change = rows["close"].diff()
        for name, values in (("gain", change.clip(lower=0)), ("loss", (-change).clip(lower=0))):
            x = values.to_numpy(dtype=float)
            start = x[1 : p + 1].sum() if seed == "sum" else x[1 : p + 1].mean() if len(x) > p else 0.0
            rows[name] = seeded(x, 1 / p, start, p)
        return rows[["ticker", "date", "close", "gain", "loss"]]

    return daily.select("ticker", "date", "close").groupBy("ticker").applyInPandas(one, "ticker string, date date, close double, gain double, loss double")


def rsi_daily(daily: DataFrame, p: int = RSI_PERIOD, seed: str = "mean") -> DataFrame:
    """seed: the first average is the mean of p gains or losses, or their ``sum``."""
    return _rsi_state(daily, p, seed).select("ticker", "date", _rsi(F.col("gain"), F.col("loss")).alias("rsi"))


def _rsi_now(p: int) -> Column:
    """One step from the day before."""
    change = F.col("close") - F.col("close_prev")
    gain = F.col("gain_prev") * (p - 1) / p + F.greatest(change, F.lit(0.0)) / p
    loss = F.col("loss_prev") * (p - 1) / p + F.greatest(-change, F.lit(0.0)) / p
    return F.when(change.isNotNull(), _rsi(gain, loss)).alias("rsi")


def rsi_minute(minute: DataFrame, daily: DataFrame, p: int = RSI_PERIOD, seed: str = "mean") -> DataFrame:
    rows = join_minute_daily(minute.select("ticker", "ts", "date", "close"), previous_day(_rsi_state(daily, p, seed), ["close", "gain", "loss"]))
    return rows.select("ticker", "ts", _rsi_now(p))


# stochastic oscillator -------------------------------------------------------------------------------------------------


def _percent_k(price: Column, high: Column, low: Column) -> Column:
    return ratio(100 * (price - low), high - low)


def _mean3(now: Column, one: Column, two: Column) -> Column:
    return (now + one + two) / 3


def stochastic_daily(daily: DataFrame, p: int = STOCHASTIC_PERIOD) -> DataFrame:
    span = W().rowsBetween(-(p - 1), 0)
    k = daily.select("ticker", "date", _percent_k(F.col("close"), F.max("high").over(span), F.min("low").over(span)).alias("k"))
    d = k.withColumn("d", _mean3(F.col("k"), F.lag("k", 1).over(W()), F.lag("k", 2).over(W())))
    return d.withColumn("d_slow", _mean3(F.col("d"), F.lag("d", 1).over(W()), F.lag("d", 2).over(W())))


def day_high_low(minute: DataFrame) -> DataFrame:
    """Running extremes of the day up to each minute."""
    upto = Window.partitionBy("ticker", "date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return minute.withColumn("day_high", F.max("high").over(upto)).withColumn("day_low", F.min("low").over(upto))


def stochastic_state(daily: DataFrame, p: int = STOCHASTIC_PERIOD) -> DataFrame:
    """Extremes of the p - 1 days before, and the lines of the two days before."""
    before = W().rowsBetween(-(p - 1), -1)
    extremes = daily.select("ticker", "date", F.max("high").over(before).alias("high_prev"), F.min("low").over(before).alias("low_prev"))
    lines = stochastic_daily(daily, p)
    return extremes.join(lines.select("ticker", "date", *[F.lag(c, n).over(W()).alias(f"{c}{n}") for c in ("k", "d") for n in (1, 2)]), ["ticker", "date"])


def _with_stochastic(rows: DataFrame) -> DataFrame:
    k = rows.withColumn("k", _percent_k(F.col("close"), F.greatest("day_high", "high_prev"), F.least("day_low", "low_prev")))
    return k.withColumn("d", _mean3(F.col("k"), F.col("k1"), F.col("k2"))).withColumn("d_slow", _mean3(F.col("d"), F.col("d1"), F.col("d2")))


def stochastic_minute(minute: DataFrame, daily: DataFrame, p: int = STOCHASTIC_PERIOD) -> DataFrame:
    rows = join_minute_daily(day_high_low(minute.select("ticker", "ts", "date", "high", "low", "close")), stochastic_state(daily, p))
    return _with_stochastic(rows).select("ticker", "ts", "k", "d", "d_slow")


# lags, spreads and the whole set ---------------------------------------------------------------------------------------


def with_lags(aligned: DataFrame, lags: dict[str, int] = LAGS) -> DataFrame:
    """aligned rows (ticker, session_no, minute_no, close, ...) with the closes of n rows before, across day borders.

    A window holds one day of a ticker and the last rows of the session before, as the grid is complete.
    """
    reach = max(lags.values())
    tail = aligned.where(F.col("minute_no") > GRID_MINUTES - reach).withColumns({"session_no": F.col("session_no") + 1, "minute_no": F.col("minute_no") - GRID_MINUTES})
    w = Window.partitionBy("ticker", "session_no").orderBy("minute_no")
    return aligned.unionByName(tail).withColumns({c: F.lag("close", n).over(w) for c, n in lags.items()}).where("minute_no > 0")


def lag_close(aligned: DataFrame, lags: dict[str, int] = LAGS) -> DataFrame:
    return with_lags(aligned.select("ticker", "session_no", "minute_no", "ts", "close"), lags).select("ticker", "ts", *lags)


def lag_daily(daily: DataFrame, lags: dict[str, int] = LAGS) -> DataFrame:
    """The same names, days back."""
    return daily.select("ticker", "date", *[F.lag("close", n).over(W()).alias(c) for c, n in lags.items()])


def diff_high_low(bars: DataFrame) -> DataFrame:
    return bars.withColumn("diff_high_low", F.col("high") - F.col("low"))


def spread_feature(quotes: DataFrame) -> DataFrame:
    """What stands for the difference of high and low on live quotes."""
    return quotes.withColumn("diff_high_low", F.col("ask") - F.col("bid"))


def add_bias(df: DataFrame) -> DataFrame:
    return df.withColumn("bias", F.lit(1.0))


#: All features of a minute row. Fixed values.
FEATURES = (
    "bias close open high low close1min close2min close5min close10min close30min close1hr diff_high_low sma5 sma10 sma20 sma50 "
    "ema5 ema10 ema20 ema50 boll20 boll50 macd_line signal_line macd_hist rsi stochastic_k stochastic_k_d"
).split()


def select_features(df: DataFrame, features: list[str] | str = "all", keys: tuple[str, ...] = ("ticker", "ts", "date")) -> DataFrame:
    """Keys, close and the named features."""
    names = FEATURES if features == "all" else list(features)
    unknown = [f for f in names if f not in FEATURES]
    if unknown:
        raise ValueError(f"no such features: {unknown}")
    return df.select(*[k for k in keys if k in df.columns], *dict.fromkeys(["close", *names]))


def daily_state(daily: DataFrame) -> DataFrame:
    """All that the minute forms need of the days before, one row for each ticker and day."""
    smoothed = smooth(daily, {f"ema{p}": ("close", _alpha(p)) for p in MEAN_PERIODS} | MACD)
    parts = [
        sma_state(daily),
        std_state(daily),
        previous_day(smoothed, [*(f"ema{p}" for p in MEAN_PERIODS), "fast", "slow", "signal"]),
        previous_day(_rsi_state(daily, RSI_PERIOD, "mean"), ["close", "gain", "loss"]),
        stochastic_state(daily),
    ]
    return reduce(lambda a, b: a.join(b, ["ticker", "date"]), parts)


def one_step(rows: DataFrame) -> DataFrame:
    """rows (close, day_high, day_low and the columns of ``daily_state``) with all indicators, each one step from the
    days before; expressions of one row only, so rows may be a stream."""
    lines = _with_stochastic(_with_macd(rows)).select("*", *_sma(MEAN_PERIODS), *_ema(MEAN_PERIODS), *_bollinger(BOLLINGER), _rsi_now(RSI_PERIOD))
    return lines.withColumn("stochastic_k", F.col("k")).withColumn("stochastic_k_d", F.col("k") - F.col("d"))


def minute_features(aligned: DataFrame, daily: DataFrame, features: list[str] | str = "all") -> DataFrame:
    """All features of aligned minute rows (ticker, date, session_no, minute_no, ts, open, high, low, close), by one join
    with the daily state and windows of one day."""
    rows = join_minute_daily(day_high_low(with_lags(aligned)), daily_state(daily))
    return select_features(add_bias(diff_high_low(one_step(rows))), features)
