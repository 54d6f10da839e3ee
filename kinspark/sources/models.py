"""Fitted models as small Parquet tables: a row for each array, list or number of a model."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from typing import Any, get_type_hints

import numpy as np
from pyspark.sql import SparkSession

_SCHEMA = "name string, kind string, shape array<long>, data binary"


def _rows(model: Any, prefix: str = ""):
    for f in fields(model):
        value, name = getattr(model, f.name), prefix + f.name
        if is_dataclass(value):
            yield from _rows(value, f"{name}.")
        elif isinstance(value, np.ndarray):
            yield name, value.dtype.str, list(value.shape), value.tobytes()
        else:
            yield name, "json", None, json.dumps(value).encode()


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """Write a model (a dataclass of arrays, lists, numbers and such dataclasses) below ``path``, a new folder."""
    spark.createDataFrame(list(_rows(model)), _SCHEMA).coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, kind: type, path: str) -> Any:
    """Read a model of class ``kind`` that :func:`save_model` has written; all values are the same bit by bit."""
    held = {r.name: r for r in spark.read.parquet(path).collect()}

    def build(cls: type, prefix: str):
        hints, out = get_type_hints(cls), {}
        for f in fields(cls):
            name = prefix + f.name
            if name in held:
                r = held[name]
                out[f.name] = json.loads(bytes(r.data)) if r.kind == "json" else np.frombuffer(bytes(r.data), r.kind).reshape(r.shape).copy()
                if str(hints[f.name]).startswith("tuple"):
                    out[f.name] = tuple(out[f.name])
            elif is_dataclass(hints[f.name]):
                out[f.name] = build(hints[f.name], f"{name}.")
            else:
                raise ValueError(f"{path} has no {name}")
        return cls(**out)

    return build(kind, "")
