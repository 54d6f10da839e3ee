"""Column transforms of responses."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def logit(y: Column) -> Column:
    """ln(y / (1 - y)) of y clipped to 0.01 to 0.99."""
    c = F.greatest(F.lit(0.01), F.least(F.lit(0.99), y))
    return F.ln(c / (F.lit(1.0) - c))


def clr(y: Column, by: str = "clone", pseudocount: float = 1e-3) -> Column:
    """Centred log ratio over the rows of ``by``."""
    return F.ln(y + pseudocount) - F.avg(F.ln(y + pseudocount)).over(Window.partitionBy(by))


def transform(y: Column, kind: str | None, by: str = "clone", pseudocount: float = 1e-3) -> Column:
    """Apply ``logit``, ``log1p``, ``sqrt``, ``clr`` or nothing; another name is an error."""
    if kind is None:
        return y
    known = {"logit": lambda: logit(y), "log1p": lambda: F.log1p(y), "sqrt": lambda: F.sqrt(y), "clr": lambda: clr(y, by, pseudocount)}
    if kind not in known:
        raise ValueError(f"unknown transform {kind!r}")
    return known[kind]()
