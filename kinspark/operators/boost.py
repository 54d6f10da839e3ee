"""Boosted trees of all responses at once, categories by ordered statistics, and exact tree attributions (SHAP)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators import booster
from kinspark.operators.booster import CLASSES, SQUARES, Boosted, Tree
from kinspark.operators.ranged import sums_before
from kinspark.sources.store import stored

__all__ = ["Boosted", "Categories", "Fit", "Tree", "correct_shap", "encode_categories", "estimated_counts", "fit_boosted", "fit_classes", "shap_norm", "shap_summary", "shap_values"]


@dataclass
class Categories:
    """Statistics of a string feature: (category, s array, n array), sums and weights of each response over its training rows."""

    feature: str
    table: DataFrame
    prior: np.ndarray  # mean of each response
    weight: float

    def shares(self, s: Column, n: Column) -> list[Column]:
        """A response's smoothed mean each: the sum plus ``weight`` priors over the weight plus ``weight``."""
        return [(F.coalesce(F.get(s, F.lit(r)), F.lit(0.0)) + self.weight * float(p)) / (F.coalesce(F.get(n, F.lit(r)), F.lit(0.0)) + self.weight) for r, p in enumerate(self.prior)]


def _category(name: str) -> Column:
    """A feature's category; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`")), F.lit("null"))


def encode_categories(rows: DataFrame, features: list[str], kinds: dict[str, str], responses: list[str], prior: np.ndarray, weight: float = 1.0, seed: int = 42, most_broadcast: int = 200_000) -> tuple[DataFrame, list[str], list[Categories]]:
    """``rows`` (_row, features, _y array, _w array, _held) with ``_x`` and ``_seen``, the names of their values, and the statistics.

    A string feature becomes one value for each response: the smoothed mean of the response over the category's training rows.
    In ``_x`` these are all of them, for predictions; in ``_seen``, which the fit learns from, a training row has only those before it in an order of
    hashes with ``seed``, so no row's own response is among its features.  Other features stay as they are.  The sums before a row are
    taken by ranges of (category, hash), so a category that fills the table is many tasks' work, and no number of
    categories is too large; statistics of up to ``most_broadcast`` categories are broadcast.
    """
    names, full, seen, found = [], [], [], []
    for f in features:
        if kinds[f] != "string":
            names.append(f)
            value = F.col(f"`{f}`").cast("double")
            full.append(value)
            seen.append(value)
            continue
        sums = [f"_s{r}" for r in range(len(responses))]
        weights = [f"_n{r}" for r in range(len(responses))]
        one = rows.where("not _held").select("_row", _category(f).alias("_cat"), F.xxhash64(F.lit(seed), "_row").alias("_h"), *[F.coalesce(F.get("_y", F.lit(r)), F.lit(0.0)).alias(s) for r, s in enumerate(sums)], *[F.get("_w", F.lit(r)).alias(n) for r, n in enumerate(weights)])
        totals = stored(one.groupBy("_cat").agg(F.array(*[F.sum(s) for s in sums]).alias("s"), F.array(*[F.sum(n) for n in weights]).alias("n")), "categories")
        held = Categories(f, totals.withColumnRenamed("_cat", "category"), prior, weight)
        found.append(held)
        before = sums_before(one, ["_cat"], ["_h", "_row"], [*sums, *weights])
        before = before.select("_row", F.array(*[f"{s}_before" for s in sums]).alias(f"_sb{len(found)}"), F.array(*[f"{n}_before" for n in weights]).alias(f"_nb{len(found)}"))
        near = F.broadcast if totals.count() <= most_broadcast else (lambda x: x)
        rows = rows.withColumn("_cat", _category(f)).join(near(totals.withColumnsRenamed({"s": f"_s{len(found)}", "n": f"_n{len(found)}"})), "_cat", "left").drop("_cat")
        rows = rows.join(before, "_row", "left")
        own = held.shares(F.col(f"_s{len(found)}"), F.col(f"_n{len(found)}"))
        past = held.shares(F.col(f"_sb{len(found)}"), F.col(f"_nb{len(found)}"))
        names += [f"{f}~{r}" for r in responses]
        full += own
        seen += [F.when(F.col("_held"), a).otherwise(b) for a, b in zip(own, past, strict=True)]
    return rows.withColumns({"_x": F.array(*full), "_seen": F.array(*seen)}), names, found


@dataclass
class Fit:
    """A fitted model, the statistics of its string features, and responses without a model of their own."""

    model: Boosted
    categories: list[Categories]
    left_out: list[str]


def _fitted(rows: DataFrame, kind: str, kinds: dict[str, str], features: list[str], responses: list[str], mean: np.ndarray, base: np.ndarray, seed: int, options: dict) -> tuple[DataFrame, Fit]:
    rows, names, categories = encode_categories(rows, features, kinds, responses, mean, seed=seed)
    rows = stored(rows.select("_row", "_key", "_y", "_held", "_x", "_seen"), "boosted")
    model = booster.fit(rows.select(F.col("_seen").alias("x"), F.col("_y").alias("y"), F.col("_held").alias("held")), kind, names, responses, base, **options)
    return rows, Fit(model, categories, [])


def _judged(rows: DataFrame, model: Boosted, key: str, key_type: str) -> DataFrame:
    """(key, response, y, predicted, validation) of rows (_key, _x, _y, _held)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        model = sent.value
        for f in frames:
            scores = model.scores(booster.filled(f["_x"], len(model.features)))
            out = scores if model.kind == SQUARES else booster.softmax(scores)
            n, r = out.shape
            yield pd.DataFrame({key: np.repeat(f["_key"].to_numpy(), r), "response": model.responses * n, "y": np.array([np.asarray(v, dtype=float) for v in f["_y"]]).ravel(), "predicted": out.ravel(), "validation": np.repeat(f["_held"].to_numpy(), r)})

    out = rows.select("_key", "_x", "_y", "_held").mapInPandas(run, f"`{key}` {key_type}, response string, y double, predicted double, validation boolean")
    return out.withColumn("y", F.nanvl("y", F.lit(None).cast("double")))


def _rows(table: DataFrame, features: list[str], key: str, flag: Column, y: Column, w: Column) -> DataFrame:
    """(_row, features, _key, _y, _w, _held), stored, so that row numbers stay."""
    own = [F.col(f"`{f}`").alias(f) for f in features]
    return stored(table.select(F.monotonically_increasing_id().alias("_row"), *own, F.col(f"`{key}`").alias("_key"), y.alias("_y"), w.alias("_w"), flag.alias("_held")), "table")


def fit_boosted(
    table: DataFrame, features: list[str], responses: list[str], validation: str | None = None, key: str = "clone", n_trees: int = 50, depth: int = 4, learning_rate: float = 0.1, min_size: int = 3, seed: int = 42, **options
) -> tuple[DataFrame, DataFrame, Fit]:
    """Boosted regression of all responses by one sequence of trees with a value for each.  Returns predictions (key, response, y,
    predicted, validation), attributions (key, response, feature, value, shap) and the fit.

    ``validation``: boolean column; its rows stop the fit by the loss over all responses and take no part in it.  Responses with fewer than ``min_size``
    values other than 0 among training rows, or validation rows, are left out; a null response of a row is no part of the loss.
    String features are encoded by :func:`encode_categories`; null numbers are less than any other; ``options`` are those of :func:`booster.fit`.
    """
    flag = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    value = {r: F.col(f"`{r}`").cast("double") for r in responses}
    sizes = table.agg(
        *[F.count_if((y != 0) & ~flag).alias(f"a{i}") for i, y in enumerate(value.values())],
        *[F.count_if((y != 0) & flag).alias(f"b{i}") for i, y in enumerate(value.values())],
        *[F.avg(F.when(~flag, y)).alias(f"m{i}") for i, y in enumerate(value.values())],
    ).first()
    kept = [i for i in range(len(responses)) if sizes[f"a{i}"] >= min_size and (not validation or sizes[f"b{i}"] >= min_size)]
    if not kept:
        raise ValueError(f"no response has {min_size} values other than 0")
    names, mean = [responses[i] for i in kept], np.array([sizes[f"m{i}"] for i in kept])
    y, w = F.array(*[value[r] for r in names]), F.array(*[F.when(value[r].isNotNull(), 1.0).otherwise(0.0) for r in names])
    kinds = dict(table.dtypes)
    rows, fit = _fitted(_rows(table, features, key, flag, y, w), SQUARES, kinds, features, names, mean, mean, seed, {"n_trees": n_trees, "depth": depth, "learning_rate": learning_rate, **options})
    fit.left_out = [r for r in responses if r not in names]
    return _judged(rows, fit.model, key, kinds[key]), shap_values(rows, fit.model, key, kinds[key]), fit


def fit_classes(
    table: DataFrame, features: list[str], responses: list[str], validation: str | None = None, key: str = "clone", n_trees: int = 50, depth: int = 5, learning_rate: float = 0.1, seed: int = 42, **options
) -> tuple[DataFrame, DataFrame, Fit]:
    """Boosted trees of all responses as classes of one softmax: a row weighs for each class as that response says (null: 0).

    Returns predictions (key, response, y, predicted, validation), predicted being a class's probability, attributions (key,
    response, feature, value, shap) of the scores whose softmax these are, and the fit.  ``validation``: boolean column;
    its rows stop the fit early and take no part in it.  A class without weight among training rows has probability 0, no
    attributions and no part of the model; a table without any weight is an error.  Features and ``options`` as in :func:`fit_boosted`.
    """
    flag = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    value = {r: F.coalesce(F.col(f"`{r}`").cast("double"), F.lit(0.0)) for r in responses}
    sums = table.agg(*[F.sum(F.when(~flag, v)).alias(f"s{i}") for i, v in enumerate(value.values())]).first()
    names = [r for i, r in enumerate(responses) if (sums[i] or 0) > 0]
    if not names:
        raise ValueError("no class has a weight above 0")
    share = np.array([sums[i] for i, r in enumerate(responses) if r in names], dtype=float)
    share /= share.sum()
    y, whole = F.array(*[value[r] for r in names]), sum((value[r] for r in names), F.lit(0.0))
    kinds = dict(table.dtypes)
    rows = _rows(table, features, key, flag, y, F.array_repeat(whole, len(names)))
    rows, fit = _fitted(rows, CLASSES, kinds, features, names, share, np.log(share), seed, {"n_trees": n_trees, "depth": depth, "learning_rate": learning_rate, **options})
    fit.left_out = [r for r in responses if r not in names]
    predictions = _judged(rows, fit.model, key, kinds[key])
    own = table.select(F.col(f"`{key}`").alias(key), F.explode(F.array(*[F.struct(F.lit(r).alias("response"), F.col(f"`{r}`").cast("double").alias("y")) for r in responses])).alias("e"), flag.alias("validation"))
    if fit.left_out:
        empty = own.where(F.col("e.response").isin(fit.left_out)).select(key, "e.response", "e.y", F.lit(0.0).alias("predicted"), "validation")
        predictions = predictions.unionByName(empty)
    return predictions, shap_values(rows, fit.model, key, kinds[key]), fit


def shap_values(rows: DataFrame, model: Boosted, key: str = "clone", key_type: str = "long") -> DataFrame:
    """(key, response, feature, value, shap) of rows (_key, _x); rows are independent, so nothing is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        model = sent.value
        trees, n, r = model.trees(), len(model.features), len(model.responses)
        for f in frames:
            for lo in range(0, len(f), 1024):
                part = f.iloc[lo : lo + 1024]
                x = booster.filled(part["_x"], n)
                total = sum((t.shap(x) for t in trees), np.zeros((len(part), n, r)))
                value = np.where(x == booster.MISSING, np.nan, x)
                yield pd.DataFrame({key: np.repeat(part["_key"].to_numpy(), n * r), "response": model.responses * (len(part) * n), "feature": np.tile(np.repeat(np.array(model.features, dtype=object), r), len(part)), "value": np.repeat(value.ravel(), r), "shap": total.ravel()})

    out = rows.select("_key", "_x").mapInPandas(run, f"`{key}` {key_type}, response string, feature string, value double, shap double")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def shap_summary(shaps: DataFrame) -> DataFrame:
    """(response, feature, mean_shap, corr): mean absolute attribution, and its correlation with the feature's values."""
    corr = F.try_divide(F.covar_pop("value", "shap"), F.stddev_pop("value") * F.stddev_pop("shap"))
    return shaps.groupBy("response", "feature").agg(F.avg(F.abs("shap")).alias("mean_shap"), corr.alias("corr"))


def shap_norm(shaps: DataFrame, key: str = "clone") -> DataFrame:
    """(key, feature, l2): root of the sum over responses of squared attributions."""
    return shaps.groupBy(key, "feature").agg(F.sqrt(F.sum(F.col("shap") * F.col("shap"))).alias("l2"))


def correct_shap(summary: DataFrame, correct_sign: bool = True, normalize: bool = False) -> DataFrame:
    """``summary`` with ``corrected``: mean attribution over its response's largest if wanted, times the sign of the correlation."""
    value = F.col("mean_shap")
    if normalize:
        value = F.try_divide(value, F.max("mean_shap").over(Window.partitionBy("response")))
    if correct_sign:
        value = value * F.signum("corr")
    return summary.withColumn("corrected", value)


def estimated_counts(predictions: DataFrame, totals: DataFrame, key: str = "clone") -> DataFrame:
    """Predicted proportions times row totals (key, total)."""
    return predictions.join(totals, key).withColumn("predicted", F.col("predicted") * F.col("total"))
