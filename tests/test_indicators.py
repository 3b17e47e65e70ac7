"""Indicators against plain loops on small hand-made series."""

from datetime import date, timedelta
from math import sqrt

import pytest

from barloom.functions.smoothing import ewm, seeded
from barloom.operators import indicators

START = date(2024, 1, 1)


def daily(spark, closes, highs=None, lows=None):
    rows = [("T", START + timedelta(days=i), c, (highs or closes)[i], (lows or closes)[i], c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double")


def minute(spark, day, price):
    return spark.createDataFrame([("T", f"{START + timedelta(days=day)} 10:00:00", START + timedelta(days=day), price, price, price)], "ticker string, ts string, date date, close double, high double, low double")


RISING = [float(i) for i in range(1, 31)]
WAVE = [10.0 + (i * 7 % 5) - (i % 3) for i in range(30)]
WITH_GAPS = [None, None, *WAVE[2:]]


def collected(df):
    return [r.asDict() for r in df.orderBy("date").collect()]


@pytest.mark.parametrize("closes", [RISING, WAVE, [5.0] * 30])
def test_averages_and_bands(spark, closes):
    rows = collected(indicators.sma_daily(daily(spark, closes)))
    stds = collected(indicators.std_daily(daily(spark, closes)))
    bands = collected(indicators.bollinger_daily(daily(spark, closes)))
    for i in range(len(closes)):
        last = closes[max(0, i - 4) : i + 1]
        assert rows[i]["sma5"] == (pytest.approx(sum(last) / 5) if i >= 4 else None)
        if i < 19:
            assert stds[i]["std20"] is None and bands[i]["boll20"] is None
            continue
        twenty = closes[i - 19 : i + 1]
        mean = sum(twenty) / 20
        std = sqrt(sum((x - mean) ** 2 for x in twenty) / 20)
        assert stds[i]["std20"] == pytest.approx(std)
        assert bands[i]["boll20"] == (pytest.approx(100 * (closes[i] - mean + 2 * std) / (4 * std)) if std else None)


def test_minute_forms_equal_daily_ones_at_the_close(spark):
    for i in (25, 29):
        d = daily(spark, WAVE)
        day = START + timedelta(days=i)
        pairs = [
            (indicators.sma_minute, indicators.sma_daily, ["sma5", "sma20"]),
            (indicators.std_minute, indicators.std_daily, ["std20"]),
            (indicators.bollinger_minute, indicators.bollinger_daily, ["boll20"]),
            (indicators.ema_minute, indicators.ema_daily, ["ema5", "ema50"]),
            (indicators.macd_minute, indicators.macd_daily, ["macd_line", "signal_line", "macd_hist"]),
            (indicators.rsi_minute, indicators.rsi_daily, ["rsi"]),
            (indicators.stochastic_minute, indicators.stochastic_daily, ["k", "d", "d_slow"]),
        ]
        for now, whole, names in pairs:
            live, closed = now(minute(spark, i, WAVE[i]), d).first(), whole(d).where(f"date = '{day}'").first()
            for n in names:
                assert live[n] == pytest.approx(closed[n]), n


def test_ema_seed_is_the_first_known_close(spark):
    rows = collected(indicators.ema_daily(daily(spark, WITH_GAPS), (5,)))
    e = None
    for r, c in zip(rows, WITH_GAPS, strict=True):
        e = c if e is None else c / 3 + e * 2 / 3
        assert r["ema5"] == (pytest.approx(e) if c is not None else None)


def test_rsi(spark):
    assert all(r["rsi"] is None for r in collected(indicators.rsi_daily(daily(spark, RISING))))  # no losses
    falling = collected(indicators.rsi_daily(daily(spark, RISING[::-1])))
    assert [r["rsi"] for r in falling] == [None] * 14 + [0.0] * 16
    for seed in ("mean", "sum"):
        rows = collected(indicators.rsi_daily(daily(spark, WAVE), seed=seed))
        change = [b - a for a, b in zip(WAVE, WAVE[1:], strict=False)]
        gain, loss = (sum(max(s * c, 0) for c in change[:14]) / (14 if seed == "mean" else 1) for s in (1, -1))
        for i in range(14, 30):
            if i > 14:
                gain, loss = (x * 13 / 14 + max(s * change[i - 1], 0) / 14 for x, s in ((gain, 1), (loss, -1)))
            assert rows[i]["rsi"] == pytest.approx(100 - 100 / (1 + gain / loss))
            assert 0 <= rows[i]["rsi"] <= 100


def test_stochastic_takes_short_windows(spark):
    highs, lows = [c + 1 for c in WAVE], [c - 1 for c in WAVE]
    rows = collected(indicators.stochastic_daily(daily(spark, WAVE, highs, lows)))
    for i in range(30):
        h, low = max(highs[max(0, i - 13) : i + 1]), min(lows[max(0, i - 13) : i + 1])
        assert rows[i]["k"] == pytest.approx(100 * (WAVE[i] - low) / (h - low))
        assert rows[i]["d"] == (None if i < 2 else pytest.approx(sum(rows[j]["k"] for j in (i, i - 1, i - 2)) / 3))
    assert all(r["k"] is None for r in collected(indicators.stochastic_daily(daily(spark, [5.0] * 5))))


def test_helpers():
    assert list(ewm([1.0, 2.0, 3.0], 0.5)) == [1.0, 1.5, 2.25]
    import numpy as np

    assert np.isnan(seeded(np.array([1.0, 2.0]), 0.5, 0.0, 5)).all()


def test_unknown_feature_is_refused(spark):
    with pytest.raises(ValueError):
        indicators.select_features(daily(spark, RISING), ["nothing"])
