"""Products of tall matrices, summed where their rows lie."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Numbers of a block of a summed product.
_BLOCK = 1 << 17


def _wide(column: pd.Series, at: pd.Series | None, dim: int) -> np.ndarray:
    """Rows of a column of vectors, or of values whose places are in ``at``, as a matrix."""
    if at is None:
        return np.array(column.tolist(), dtype=float).reshape(-1, dim)
    out = np.zeros((len(column), dim))
    for n, (places, values) in enumerate(zip(at, column, strict=True)):
        out[n, places] = values
    return out


def summed_product(rows: DataFrame, left: str, right: str, n: int, m: int, left_at: str | None = None, right_at: str | None = None) -> np.ndarray:
    """(n x m) sum over rows of the outer products of their vectors ``left`` and ``right``.

    ``left_at`` and ``right_at`` name columns with the places of the values, for vectors that leave zeros out.  A task adds up
    all its rows before it sends anything, blocks of some rows of the product are added up in Spark, and the driver gets each
    block once.
    """
    step = max(1, _BLOCK // max(1, m))

    def run(frames):
        total, any_rows = np.zeros((n, m)), False
        for f in frames:
            for lo in range(0, len(f), 1024):
                part = f.iloc[lo : lo + 1024]
                total += _wide(part["l"], part["la"] if left_at else None, n).T @ _wide(part["r"], part["ra"] if right_at else None, m)
                any_rows = True
        for at in range(0, n if any_rows else 0, step):
            yield pd.DataFrame({"at": [at], "data": [total[at : at + step].tobytes()]})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [key[0]], "data": [sum(np.frombuffer(x) for x in frame["data"]).tobytes()]})

    names = {"l": left, "r": right} | ({"la": left_at} if left_at else {}) | ({"ra": right_at} if right_at else {})
    parts = rows.selectExpr(*[f"`{c}` as {alias}" for alias, c in names.items()]).mapInPandas(run, "at int, data binary")
    out = np.zeros((n, m))
    for r in parts.groupBy("at").applyInPandas(add, "at int, data binary").collect():
        out[r["at"] : r["at"] + step] = np.frombuffer(r["data"]).reshape(-1, m)
    return out
