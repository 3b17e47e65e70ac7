"""Bounded replays: a table's rows as a stream that comes in pieces, stops after each and is taken up from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.shared import shared_folder

PARTITIONS = "spark.sql.shuffle.partitions"


def _pieces(rows: DataFrame, order: str, n: int) -> list[DataFrame]:
    """rows in n spans of equal length of ``order``, a time; rows without one are in the first."""
    lo, hi = rows.select(F.unix_micros(F.min(order)), F.unix_micros(F.max(order))).first()
    if lo is None:
        return [rows]
    at = F.coalesce(F.unix_micros(order), F.lit(lo))
    borders = [lo + (hi - lo) * i // n for i in range(n)]
    pieces = [rows.where((at >= a) & (at < b)) for a, b in zip(borders, borders[1:], strict=False)]
    return [*pieces, rows.where(at >= borders[-1])]


def replayed(
    rows: DataFrame,
    order: str,
    stream: Callable[[DataFrame], DataFrame],
    pieces: int = 3,
    last: DataFrame | None = None,
    sink: Callable[[str], Callable[[DataFrame, int], None]] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """What ``stream`` makes of rows that come in the order of time, as a table.

    The rows are written to a folder piece by piece. After each piece the stream is started, reads what is new, stops, and
    leaves its offsets and state in its checkpoint, from which the next start goes on: what comes out has gone through as
    many restarts as there are pieces. last: rows of a piece of its own at the end, to bring the watermark past the
    others. sink: of a path, a function for foreachBatch that writes below it; by default an exactly-once file sink.
    partitions: of the stream's state, which a checkpoint fixes for good; by default one for each core.

    All is written below the shared folder, in a folder of this replay. Order is a timestamp (with a zone, the session's).
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    before = spark.conf.get(PARTITIONS)
    try:
        for piece in [*_pieces(rows, order, pieces), *([last] if last is not None else [])]:
            piece.write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            spark.conf.set(PARTITIONS, str(partitions or spark.sparkContext.defaultParallelism))
            writer = stream(source).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
            query = writer.foreachBatch(sink(f"{folder}/out")).start() if sink else writer.format("parquet").option("path", f"{folder}/out").start()
            try:
                query.awaitTermination()
            finally:
                query.stop()
            spark.conf.set(PARTITIONS, before)
    finally:
        spark.conf.set(PARTITIONS, before)
    return spark.read.parquet(f"{folder}/out")
