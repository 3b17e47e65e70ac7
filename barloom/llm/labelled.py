"""Bounded samples to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, order: Column, size: int) -> DataFrame:
    """The ``size`` rows of least hash. order: a 64-bit hash column.

    Rows are counted first, so that only those below four times the expected cut are sorted: what tasks hand on doesn't
    grow with their number. If these are too few after all, all rows are sorted.
    """
    n = rows.count()
    if n > 8 * size:
        low = rows.where(order < -(2**63) + int(2**64 * 4 * size / n))
        if low.count() >= size:
            rows = low
    return rows.orderBy(order, *rows.columns).limit(size)


def sample_of(docs: DataFrame, labels: DataFrame, label: str, size: int, learn) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, label) of the ``size`` labelled rows of least hash that may be learned from.

    learn: a condition on doc_id. A doc_id whose labels differ, or are null, teaches nothing; one that docs repeat is
    taken once.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("z"))
        .where("y = z")
        .where(learn(F.col("doc_id")))
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # at most ``size`` rows, so they may be sent to every task
    picked = least_hashed(known.join(ids, "doc_id", "left_semi"), F.xxhash64(F.lit("sample"), "doc_id"), size)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = sorted(rows.collect(), key=lambda r: r.doc_id)
    return [(r.doc_id, bytes(r.text), r.y) for r in found]
