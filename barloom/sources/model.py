"""Model tables: one Parquet table for each part, keyed by ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.scoring import usable_tickers

PARTS = ("centroids", "labels", "thresholds", "scaling", "last_features", "last_minutes", "daily_bars", "average_volume", "updates")


def save_model_tables(path: str, **parts: DataFrame) -> None:
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"no such parts: {sorted(unknown)}")
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model_tables(spark: SparkSession, path: str, parts: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """The parts, each with the tickers that all of them have."""
    tables = {p: spark.read.parquet(f"{path}/{p}") for p in parts}
    first = tables[parts[0]]
    usable = usable_tickers(first, *[tables[p] for p in parts[1:]])
    return {p: t.join(usable, "ticker", "left_semi") for p, t in tables.items()}
