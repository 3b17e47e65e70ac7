"""Trading calendar as tables made from date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.params import CLOSE_MINUTE, OPEN_MINUTE


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by integer arithmetic."""
    div = lambda a, b: F.floor(a / b)
    golden, century = year % 19, div(year, F.lit(100))
    moon = (19 * golden + century - div(century, F.lit(4)) - div(8 * century + 13, F.lit(25)) + 15) % 30
    full = moon - div(moon, F.lit(28)) * (1 - div(moon, F.lit(28)) * div(F.lit(29), moon + 1) * div(21 - golden, F.lit(11)))
    sunday = (year + div(year, F.lit(4)) + full + 2 - century + div(century, F.lit(4))) % 7
    from_march = full - sunday
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), from_march.cast("int"))


def _nth(year: Column, month: int, day: int, n: int) -> Column:
    """The n-th weekday (0 Monday) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, ((F.lit(day) - F.weekday(first) + 7) % 7 + 7 * (n - 1)).cast("int"))


def _observed(year: Column, month: int, day: int) -> Column:
    """A fixed date, moved from Saturday to Friday and from Sunday to Monday."""
    on = F.make_date(year, F.lit(month), F.lit(day))
    return F.date_add(on, F.when(F.weekday(on) == 5, -1).when(F.weekday(on) == 6, 1).otherwise(0))


def market_holidays(ranges: DataFrame) -> DataFrame:
    """(date, holiday) within the ranges (start, end), each date once; a few rows a year."""
    years = ranges.select("start", "end", F.explode(F.sequence(F.year("start"), F.year("end"))).alias("y"))
    y = F.col("y")
    last_may = F.make_date(y, F.lit(5), F.lit(31))
    days = {
        "New Year": F.make_date(y, F.lit(1), F.lit(1)),
        "Martin Luther King Day": _nth(y, 1, 0, 3),
        "Washington's Birthday": _nth(y, 2, 0, 3),
        "Good Friday": F.date_sub(easter(y), 2),
        "Memorial Day": F.date_sub(last_may, F.weekday(last_may)),
        "Independence Day": _observed(y, 7, 4),
        "Labor Day": _nth(y, 9, 0, 1),
        "Thanksgiving": _nth(y, 11, 3, 4),
        "Christmas": _observed(y, 12, 25),
    }
    each = F.explode(F.array(*[F.struct(d.alias("date"), F.lit(n).alias("holiday")) for n, d in days.items()]))
    found = years.select("start", "end", each.alias("h")).where(F.col("h.date").between(F.col("start"), F.col("end")))
    return found.groupBy("h.date").agg(F.min("h.holiday").alias("holiday"))


def open_days(ranges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, date, session_no): weekdays of each range (keys, start, end) that are no holiday, numbered from 1."""
    from pyspark.sql import Window

    keys = keys or []
    days = ranges.select(*keys, F.explode(F.sequence("start", "end")).alias("date")).where(F.weekday("date") < 5)
    spans = ranges.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    left = days.join(market_holidays(spans).select("date"), "date", "left_anti").select(*keys, "date").distinct()
    return left.withColumn("session_no", F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date")))


def daily_grid(ranges: DataFrame) -> DataFrame:
    """(date, session_no, ts): one row for each open day, stamped 22:00."""
    return open_days(ranges).withColumn("ts", (F.to_timestamp_ntz(F.col("date").cast("string")) + F.expr("INTERVAL 22 HOURS")))


def minute_grid(days: DataFrame) -> DataFrame:
    """days and (minute_no, ts): 781 rows for each of them, 04:00 to 17:00, numbered from 1."""
    rows = days.withColumn("minute_no", F.explode(F.sequence(F.lit(1), F.lit(CLOSE_MINUTE - OPEN_MINUTE + 1))))
    start = F.to_timestamp_ntz(F.col("date").cast("string"))
    return rows.withColumn("ts", start + F.make_dt_interval(mins=F.lit(OPEN_MINUTE - 1) + F.col("minute_no")))


def exclude_holidays(rows: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    return rows.join(holidays.select(F.col("date").alias(date)).distinct(), date, "left_anti")
