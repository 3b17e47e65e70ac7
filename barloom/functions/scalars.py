"""Scalar column functions. Missing values are NULL; a division by 0 gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.params import CLOSE_MINUTE, MARKET_ZONE, OPEN_MINUTE


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def epoch_ms_to_local(ms: Column, zone: str = MARKET_ZONE) -> Column:
    """Epoch milliseconds as local time of the market."""
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a time that is read in the session's zone."""
    return F.unix_millis(ts.cast("timestamp"))


def mid_price(bid: Column, ask: Column) -> Column:
    """Null unless both are there."""
    return (bid + ask) / 2


def pct_gain(out: Column, into: Column) -> Column:
    return ratio(out - into, into)


def minute_start(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def minute_end(ts: Column) -> Column:
    return minute_start(ts) + F.expr("INTERVAL 1 MINUTE")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(ts: Column) -> Column:
    """04:00 to 17:00 local, both ends included, Monday to Friday; holidays are not looked at."""
    inside = (minute_of_day(ts) >= OPEN_MINUTE) & ((minute_of_day(ts) < CLOSE_MINUTE) | (F.date_trunc("minute", ts).cast("timestamp_ntz") == ts) & (minute_of_day(ts) == CLOSE_MINUTE))
    return inside & (F.weekday(ts) < 5)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def cents(price: Column) -> Column:
    """To two digits, halves up, by the same double arithmetic in every engine."""
    return F.floor(price * 100 + 0.5) / 100
