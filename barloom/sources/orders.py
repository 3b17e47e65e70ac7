"""Order tables over JDBC."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the three tables.
BUYS = "buy_order_id ticker price quantity time_placed time_filled".split()
SELLS = "sell_order_id ticker price quantity time_placed time_filled buy_order_id_link".split()
OPEN_SELLS = "sell_order_id ticker price date buy_order_id_link".split()


def order_log(fills: DataFrame, columns: list[str]) -> DataFrame:
    """The rows as they are appended: the table's columns, in order."""
    return fills.select(*columns)


def write_order_log(fills: DataFrame, url: str, table: str, columns: list[str], properties: dict[str, str] | None = None) -> None:
    order_log(fills, columns).write.jdbc(url, table, mode="append", properties=properties or {})


def clean_open_orders(rows: DataFrame) -> DataFrame:
    """Ids without blanks around them, prices in cents."""
    ids = [c for c in rows.columns if c.endswith("_id") or c.endswith("_link")]
    return rows.withColumns({c: F.trim(c) for c in ids} | {"price": F.round("price", 2)})


def read_open_orders(
    spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, by: str | None = None, lower=None, upper=None, parts: int = 1
) -> DataFrame:
    """by: a column of numbers or times, by whose ranges between lower and upper the table is read in parallel; what lies
    outside of them is in the first and last part. Conditions on the table's own columns go to the database."""
    reader = spark.read.option("url", url).option("dbtable", table).options(**(properties or {}))
    if by:
        reader = reader.option("partitionColumn", by).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return clean_open_orders(reader.format("jdbc").load())


def refresh_open_orders(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The open-orders table after its symbols in ``current`` are replaced."""
    return stored.join(current.select("ticker").distinct(), "ticker", "left_anti").select(*stored.columns).unionByName(current.select(*stored.columns))


# Writes that count once they are told ----------------------------------------------------------------------------------
#
# The rows of a write carry its number (attempt, a new one for each try) and their own; a row of another table, put in
# last and by one transaction, tells that the attempt is whole. Readers take the rows of told attempts, each once: rows
# of a failed try are never read, and those that a task wrote twice, as its first try was taken for lost, are one.


def _tables(table: str) -> tuple[str, str, str]:
    return f"{table}_rows", f"{table}_told", f"{table}_symbols"


def _put(rows: DataFrame, url: str, table: str, attempt: str, properties: dict[str, str]) -> None:
    numbered = rows.withColumn("attempt", F.lit(attempt)).withColumn("row_no", F.monotonically_increasing_id())
    numbered.write.option("createTableColumnTypes", "attempt varchar(40)").jdbc(url, table, mode="append", properties=properties)


def _tell(spark: SparkSession, url: str, table: str, attempt: str, batch: str, properties: dict[str, str]) -> None:
    told = spark.range(1).coalesce(1).select(F.lit(attempt).alias("attempt"), F.lit(batch).alias("batch"), F.unix_micros(F.current_timestamp()).alias("told_at"))
    told.write.option("createTableColumnTypes", "attempt varchar(40), batch varchar(200)").jdbc(url, table, mode="append", properties=properties)


def _read(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    rows = spark.read.jdbc(url, table, properties=properties)
    return rows.toDF(*[c.lower() for c in rows.columns])


def _told(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    """(batch, attempt, told_at): the first told attempt of each batch."""
    told = _read(spark, url, table, properties)
    return told.groupBy("batch").agg(F.min_by("attempt", F.struct("told_at", "attempt")).alias("attempt"), F.min("told_at").alias("told_at"))


def append_once(rows: DataFrame, url: str, table: str, batch: str, properties: dict[str, str] | None = None) -> None:
    """rows as the batch of this name, which counts once however often it is appended. Tasks write in parallel."""
    properties, attempt = properties or {}, uuid.uuid4().hex
    stored, told, _ = _tables(table)
    _put(rows, url, stored, attempt, properties)
    _tell(rows.sparkSession, url, told, attempt, batch, properties)


def read_appended(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """The rows of all batches, with ``batch``."""
    stored, told, _ = _tables(table)
    rows = _read(spark, url, stored, properties or {}).join(F.broadcast(_told(spark, url, told, properties or {}).drop("told_at")), "attempt")
    return rows.dropDuplicates(["attempt", "row_no"]).drop("attempt", "row_no")


def store_open_orders(current: DataFrame, symbols: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """The open orders of ``symbols`` (ticker) become those of ``current``, all at once; those of other tickers stay. A
    symbol without orders has none any more. If this fails, the stored orders are as before."""
    properties, attempt = properties or {}, uuid.uuid4().hex
    stored, told, names = _tables(table)
    _put(current.join(symbols.select("ticker").distinct(), "ticker", "left_semi").select(*current.columns), url, stored, attempt, properties)
    _put(symbols.select("ticker").distinct(), url, names, attempt, properties)
    _tell(current.sparkSession, url, told, attempt, attempt, properties)


def read_stored_orders(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """The open orders of each ticker by the last told refresh that names it."""
    properties = properties or {}
    stored, told, names = _tables(table)
    named = _read(spark, url, names, properties).join(_told(spark, url, told, properties).drop("batch"), "attempt")
    newest = named.groupBy("ticker").agg(F.max_by("attempt", F.struct("told_at", "attempt")).alias("attempt"))
    rows = _read(spark, url, stored, properties).join(newest, ["ticker", "attempt"], "left_semi")
    return rows.dropDuplicates(["attempt", "row_no"]).drop("attempt", "row_no")
