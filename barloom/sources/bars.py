"""Reading and writing bars: candle replies, Parquet tables in place of files with dates in their names."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import epoch_ms_to_local
from barloom.params import MARKET_ZONE

CANDLES = T.StructType([T.StructField("candles", T.ArrayType(T.StructType([T.StructField("datetime", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")], T.StructField("volume", T.LongType())])))])


def read_candles_json(replies: DataFrame, zone: str = MARKET_ZONE) -> DataFrame:
    """(ticker, ts, open, high, low, close, volume) from (ticker, body): one JSON reply each, one row for each candle.

    ts is the market's local time. A body that can't be read, or without candles, gives no rows.
    """
    c = replies.select("ticker", F.explode(F.from_json("body", CANDLES)["candles"]).alias("c"))
    return c.select("ticker", epoch_ms_to_local(F.col("c.datetime"), zone).cast("timestamp_ntz").alias("ts"), *[F.col(f"c.{x}") for x in ("open", "high", "low", "close", "volume")])


def shift_daily_stamp(bars: DataFrame, start: date, end: date) -> DataFrame:
    """Daily candles come stamped one day early: those of the range less a day are kept and moved on by 24 hours."""
    moved = bars.withColumn("ts", F.col("ts") + F.expr("INTERVAL 24 HOURS"))
    return date_range(moved, start, end)


def date_range(bars: DataFrame, start: date, end: date) -> DataFrame:
    """From the first moment of start to the last of end."""
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(end), 1).cast("timestamp_ntz")))


#: What is stored where. A row says that from this version on the bars of a frequency and day are those of a write, or
#: (null) that there are none.
LOG = "frequency string, date date, write string, version long"
STORED = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume long, frequency string, date date"
#: Bytes of a row group: small, so that reading a few tickers leaves most of a day's file out.
ROW_GROUP = 4 << 20


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def stored_slices(spark: SparkSession, path: str) -> DataFrame:
    """(frequency, date, write): the write that each stored day's bars come from."""
    now = _log(spark, path).groupBy("frequency", "date").agg(F.max_by("write", "version").alias("write"))
    return now.where("write is not null")


def _store(bars: DataFrame, path: str, frequency: str, row_group: int, gone: DataFrame | None = None) -> None:
    """Write bars to a folder of their own, then tell the log in one file; gone: (date) days that have no bars any more.

    Until that file is there, readers see what was there before; a failure on the way leaves a folder that nothing names.
    """
    spark, write = bars.sparkSession, uuid.uuid4().hex
    rows = bars.withColumn("frequency", F.lit(frequency)).withColumn("date", F.to_date("ts"))
    sorted_rows = rows.repartition("date").sortWithinPartitions("date", "ticker", "ts")
    files = sorted_rows.write.option("parquet.block.size", row_group).option("parquet.bloom.filter.enabled#ticker", "true")
    files.partitionBy("frequency", "date").parquet(f"{path}/data/write={write}")
    days = rows.select("date").distinct().select("date", F.lit(write).alias("write"))
    if gone is not None:
        days = days.unionByName(gone.select("date", F.lit(None).cast("string").alias("write")))
    version = (_log(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    told = days.select(F.lit(frequency).alias("frequency"), "date", "write").coalesce(1)
    told.write.mode("errorifexists").parquet(f"{path}/log/version={version}")


def write_bars(bars: DataFrame, path: str, frequency: str, row_group: int = ROW_GROUP) -> None:
    """Adds or replaces the days that bars hold, all at once; other days and frequencies stay.

    A day's file is sorted by ticker and time, with a Bloom filter and bounds of the tickers of each row group. One
    writer at a time: of two that store the same version the second fails. What older versions wrote stays in its folder,
    for readers that still use it.
    """
    _store(bars, path, frequency, row_group)


def read_bars(spark: SparkSession, path: str, start: date, end: date, frequency: str, tickers: list[str] | None = None) -> DataFrame:
    """Bars of the range as they are stored at this moment; daily ones begin six months earlier. Other days' files aren't
    opened, and of those of the range only the row groups that may hold the tickers. Collects the days of the range."""
    first = F.add_months(F.lit(start), -6) if frequency == "daily" else F.lit(start)
    found = stored_slices(spark, path).where((F.col("frequency") == frequency) & F.col("date").between(first, F.lit(end))).collect()
    if not found:
        return spark.createDataFrame([], STORED)
    folders = [f"{path}/data/write={r.write}/frequency={r.frequency}/date={r.date}" for r in found]
    rows = spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("write")
    return rows.where(F.col("ticker").isin(tickers)) if tickers else rows


def replace_slice(spark: SparkSession, path: str, start: date, end: date, frequency: str, bars: DataFrame) -> None:
    """What is stored of this frequency from start to end gives way to bars of the range, for all tickers, at once: a
    reader sees all of the old or all of the new bars."""
    inside = date_range(bars, start, end)
    stored = stored_slices(spark, path).where((F.col("frequency") == frequency) & F.col("date").between(F.lit(start), F.lit(end)))
    gone = stored.select("date").join(inside.select(F.to_date("ts").alias("date")).distinct(), "date", "left_anti")
    _store(inside, path, frequency, ROW_GROUP, gone)


def export_quotes_wide(wide: DataFrame, path: str, form: str = "csv") -> None:
    wide.write.mode("overwrite").option("header", True).format(form).save(path)
