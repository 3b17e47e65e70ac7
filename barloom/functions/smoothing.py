"""Recursive smoothing of daily series, one vectorised pass for each ticker.

Recursion is the one thing that windows can't express. Daily series are short (about 250 rows a year), so a ticker's
series is a bounded group; minute rows never come here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ewm(values: np.ndarray, alpha: float) -> np.ndarray:
    """E0 is the first value that isn't missing, then E = x * alpha + E * (1 - alpha); missing values give missing ones
    and leave the state."""
    s = pd.Series(values)
    known = s.notna()
    out = pd.Series(np.nan, index=s.index)
    out[known] = s[known].ewm(alpha=alpha, adjust=False).mean()
    return out.to_numpy()


def seeded(values: np.ndarray, alpha: float, seed: float, at: int) -> np.ndarray:
    """The same from row ``at`` on, where the state is ``seed``; missing before."""
    out = np.full(len(values), np.nan)
    if len(values) > at:
        out[at:] = ewm(np.concatenate([[seed], values[at + 1 :]]), alpha)
    return out


def smooth(daily: DataFrame, outputs: dict[str, tuple[str, float | str]]) -> DataFrame:
    """(ticker, date, outputs): each output smooths a column of daily (ticker, date, ...) with an alpha, or is the
    difference of two columns.

    An output may use earlier outputs. All are made in one pass over a ticker's rows.
    """
    inputs = [c for c in dict.fromkeys(c for o in outputs.values() for c in o if isinstance(c, str)) if c not in outputs]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        for name, (source, by) in outputs.items():
            rows[name] = rows[source] - rows[by] if isinstance(by, str) else ewm(rows[source].to_numpy(dtype=float), by)
        return rows[["ticker", "date", *outputs]]

    schema = "ticker string, date date, " + ", ".join(f"{c} double" for c in outputs)
    return daily.select("ticker", "date", *inputs).groupBy("ticker").applyInPandas(one, schema)
