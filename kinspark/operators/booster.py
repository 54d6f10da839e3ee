"""Gradient boosting with one tree for all responses.

Features become codes of at most 256 borders.  The trees grow level by level: tasks sum gradients and second derivatives of all responses
by node, feature and code, the sums of a feature meet in one task that finds its best border for each node, and the driver
picks among features.  A level is one job however many responses there are, and what reaches the driver is one border per
node and feature.  A tree's leaves have a value for each response.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.sources.store import forget, stored

SQUARES, CLASSES = "squares", "classes"
#: What stands for a missing value: less than any other.
MISSING = float(np.finfo(float).min)
_BLOCK_ROWS = 4096
#: Trees after which scores are written anew instead of being computed from the trees since.
_KEEP = 10


class Tree:
    """Arrays of one regression tree: left, right (-1 at leaves), feature, threshold, value (a number, or one for each response), cover."""

    def __init__(self, left, right, feature, threshold, value, cover):
        self.left, self.right, self.feature, self.threshold, self.value, self.cover = left, right, feature, threshold, value, cover

    def mean(self):
        """The mean value over what the tree has learnt from."""
        return sum(np.asarray(v) * c for v, c, leaf in zip(self.value, self.cover, self.left, strict=True) if leaf < 0) / self.cover[0]

    def leaves(self):
        """(value, [(feature, low, high, share)]) of each leaf: the features of its path, each once, with the interval that leads
        there, low < x <= high, and the share of cover that goes on without knowing the feature."""
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            if self.left[at] < 0:
                yield self.value[at], [(f, *v) for f, v in path.items()]
                continue
            f, t = self.feature[at], self.threshold[at]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((self.left[at], (low, min(high, t))), (self.right[at], (max(low, t), high))):
                todo.append((child, {**path, f: (*bounds, share * self.cover[child] / self.cover[at])}))

    def shap(self, rows: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values: rows x features, and x responses where values are vectors.

        A leaf is a game of its own: it pays its value times, for each feature of its path, 1 or 0 if the feature is known and the
        row goes there or not, and the share if it is not known.  The products over all sets of a size are the coefficients of
        the polynomial in t of the factors share + t * known, taken for all rows at once.
        """
        out = np.zeros((*rows.shape, *np.shape(self.value[0])))
        for value, path in self.leaves():
            d = len(path)
            known = [((rows[:, f] > low) & (rows[:, f] <= high)).astype(float) for f, low, high, _ in path]
            weight = [math.factorial(n) * math.factorial(d - n - 1) / math.factorial(d) for n in range(d)]
            for j, (f, _, _, share) in enumerate(path):
                sets = np.zeros((len(rows), d))
                sets[:, 0] = 1.0
                for k, (_, _, _, other) in enumerate(path):
                    if k != j:
                        sets[:, 1:] = sets[:, 1:] * other + sets[:, :-1] * known[k][:, None]
                        sets[:, 0] *= other
                out[:, f] += np.multiply.outer((known[j] - share) * (sets @ weight), value)
        return out

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Values of rows (rows x features), each row's leaf."""
        left, right, feature = (np.asarray(a) for a in (self.left, self.right, self.feature))
        threshold, at = np.asarray(self.threshold), np.zeros(len(rows), np.int64)
        while (inner := left[at] >= 0).any():
            low = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return np.asarray(self.value)[at]


@dataclass
class Boosted:
    """A fitted model: base value of each response, and the nodes of all trees, one tree after the other."""

    kind: str
    responses: list[str]
    features: list[str]
    base: np.ndarray  # responses
    first: np.ndarray  # each tree's first node
    left: np.ndarray  # within the tree; -1 at leaves
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # nodes x responses
    cover: np.ndarray
    losses: np.ndarray  # trees so far x (training, validation): mean losses

    def trees(self) -> list[Tree]:
        ends = [*self.first.tolist()[1:], len(self.left)] if len(self.first) else []
        return [Tree(*(a[s:e] for a in (self.left, self.right, self.feature, self.threshold, self.value, self.cover))) for s, e in zip(self.first.tolist(), ends, strict=True)]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Raw values, rows x responses: predictions of squares, log odds of classes up to a constant of the row."""
        return sum((t.predict(rows) for t in self.trees()), np.tile(self.base, (len(rows), 1)))

    def mean(self) -> np.ndarray:
        """What attributions start from: the base and the trees' means."""
        return sum((t.mean() for t in self.trees()), self.base.copy())


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(kind: str, y: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Negative gradients and second derivatives (rows x responses), loss and weight of each row.

    Squares: a missing response has neither.  Classes: y has the weights of a row's classes.
    """
    if kind == SQUARES:
        known = ~np.isnan(y)
        gap = np.where(known, y - scores, 0.0)
        return gap, known.astype(float), (gap * gap).sum(axis=1), known.sum(axis=1).astype(float)
    whole, p = y.sum(axis=1), softmax(scores)
    loss = -(y * np.log(np.maximum(p, 1e-300))).sum(axis=1)
    return y - whole[:, None] * p, whole[:, None] * p * (1 - p), loss, whole


def histograms(codes: np.ndarray, stats: np.ndarray, node: np.ndarray, n_nodes: int, n_codes: int) -> np.ndarray:
    """Sums of ``stats`` (rows x s) by feature, node and code."""
    out = np.zeros((codes.shape[1], n_nodes, n_codes, stats.shape[1]))
    for f in range(codes.shape[1]):
        at = node * n_codes + codes[:, f]
        for s in range(stats.shape[1]):
            out[f, :, :, s] = np.bincount(at, stats[:, s], n_nodes * n_codes).reshape(n_nodes, n_codes)
    return out


def best_borders(hist: np.ndarray, l2: float) -> list[tuple]:
    """(gain, code, sums left, sums of all) of each node from the sums of one feature; gain is -inf without a border.

    Sums are gradients, second derivatives and, last, rows.  Rows of a code up to the border go left.
    """
    r = (hist.shape[2] - 1) // 2
    worth = lambda s: (s[..., :r] ** 2 / (s[..., r : 2 * r] + l2)).sum(axis=-1)
    out = []
    for own in hist:
        below = np.cumsum(own, axis=0)
        total, left = below[-1], below[:-1]
        right = total - left
        gain = np.where((left[:, -1] > 0.5) & (right[:, -1] > 0.5), worth(left) + worth(right) - worth(total), -np.inf) if len(left) else np.array([-np.inf])
        at = int(gain.argmax())
        out.append((float(gain[at]), at, left[at] if len(left) else total, total))
    return out


class _Growing:
    """The tree that grows: a level's splits are added at once."""

    def __init__(self):
        self.left, self.right, self.feature, self.code, self.cover = [-1], [-1], [-1], [-1], [0.0]
        self.sums: list = [None]
        self.open = [0]  # nodes of the present level

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The number of each row's node among the open ones; -1 in a leaf that is done."""
        left, right, feature, code = (np.asarray(a) for a in (self.left, self.right, self.feature, self.code))
        at = np.zeros(len(codes), np.int64)
        while (inner := left[at] >= 0).any():
            low = codes[np.arange(len(codes)), np.maximum(feature[at], 0)] <= code[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        number = np.full(len(left), -1)
        number[self.open] = np.arange(len(self.open))
        return number[at]

    def split(self, found: list[list[tuple]], least_gain: float) -> None:
        """Split each open node by the best of the features' borders (features x nodes)."""
        open_ = []
        for k, node in enumerate(self.open):
            f = max(range(len(found)), key=lambda f: (found[f][k][0], -f))
            gain, code, left, total = found[f][k]
            self.sums[node], self.cover[node] = total, total[-1]
            if gain > least_gain:
                self.left[node], self.right[node], self.feature[node], self.code[node] = len(self.left), len(self.left) + 1, f, code
                for s in (left, total - left):
                    open_.append(len(self.left))
                    for a in (self.left, self.right, self.feature, self.code):
                        a.append(-1)
                    self.sums.append(s)
                    self.cover.append(s[-1])
        self.open = open_

    def done(self, borders: list[np.ndarray], rate: float, l2: float) -> Tree:
        r = (len(self.sums[0]) - 1) // 2
        value = np.array([rate * s[:r] / (s[r : 2 * r] + l2) for s in self.sums])
        threshold = np.array([borders[f][c] if f >= 0 else 0.0 for f, c in zip(self.feature, self.code, strict=True)])
        return Tree(np.array(self.left), np.array(self.right), np.array(self.feature), threshold, value, np.array(self.cover))


def grow(level: Callable, settle: Callable, borders: list[np.ndarray], n_trees: int, depth: int, rate: float, l2: float, patience: int) -> tuple[list[Tree], list[tuple[float, float]]]:
    """Trees and mean losses before each, from ``level(growing)``: best borders of the open nodes (features x nodes) and the losses so far.

    ``settle(growing, tree)`` tells that a tree is done.  Growth stops ``patience`` trees after the least loss of validation rows, and
    the trees after it are dropped; without such rows all trees stay.
    """
    trees: list[Tree] = []
    losses: list[tuple[float, float]] = []

    def best() -> int:
        held = [v for _, v in losses]
        return int(np.argmin(held)) if held and not math.isnan(held[0]) else len(losses) - 1

    while True:
        growing = _Growing()
        found, loss = level(growing)
        losses.append(loss)
        if len(trees) == n_trees or len(losses) - 1 - best() >= patience or not found:
            break
        for at in range(depth):
            if at:
                found = level(growing)[0]
            growing.split(found, 1e-12)
            if not growing.open:
                break
        if growing.left[0] < 0:
            break  # nothing left to learn
        trees.append(growing.done(borders, rate, l2))
        settle(growing, trees[-1])
    return trees[: best()], losses


class _Block:
    """Some rows: codes, responses, validation, scores."""

    def __init__(self, n: int, codes: bytes, y: bytes, held: bytes, score: bytes):
        self.codes = np.frombuffer(codes, np.uint8).reshape(n, -1)
        self.y, self.score = (np.frombuffer(b).reshape(n, -1) for b in (y, score))
        self.held = np.frombuffer(held, np.bool_)

    def sums(self, kind: str, growing: _Growing, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
        g, h, loss, weight = derivatives(kind, self.y, self.score)
        use = ~self.held & (weight > 0)
        node = growing.place(self.codes)
        own = use & (node >= 0)
        stats = np.column_stack([g, h, np.ones(len(g))])[own]
        losses = np.array([loss[use].sum(), weight[use].sum(), loss[self.held].sum(), weight[self.held].sum()])
        return histograms(self.codes[own], stats, node[own], len(growing.open), n_codes), losses


def _mean_losses(sums: np.ndarray) -> tuple[float, float]:
    with np.errstate(invalid="ignore", divide="ignore"):
        return float(sums[0] / sums[1]), float(sums[2] / sums[3])


def _fit_blocks(blocks: list[_Block], kind: str, borders: list[np.ndarray], n_codes: int, options: dict):
    """All levels over blocks that are at hand."""

    def level(growing):
        sums = [b.sums(kind, growing, n_codes) for b in blocks]
        hist = sum(s[0] for s in sums)
        return [best_borders(f, options["l2"]) for f in hist], _mean_losses(sum(s[1] for s in sums))

    def settle(growing, tree):
        coded = Tree(tree.left, tree.right, tree.feature, np.array(growing.code), tree.value, tree.cover)
        for b in blocks:
            b.score = b.score + coded.predict(b.codes)

    return grow(level, settle, borders, **options)


def _fit_spark(table: DataFrame, kind: str, borders: list[np.ndarray], n_codes: int, options: dict):
    """All levels as jobs over stored blocks; scores are written anew every few trees."""
    held = {"table": table, "since": []}
    spark, l2 = table.sparkSession, options["l2"]

    def level(growing):
        sent = spark.sparkContext.broadcast((growing, held["since"]))

        def run(frames):
            growing, since = sent.value
            hist = losses = None
            for f in frames:
                for row in f.itertuples(index=False):
                    b = _Block(*row)
                    b.score = sum((t.predict(b.codes) for t in since), b.score)
                    h, e = b.sums(kind, growing, n_codes)
                    hist, losses = (h, e) if hist is None else (hist + h, losses + e)
            if hist is not None:
                yield pd.DataFrame({"feature": [*range(len(hist)), -1], "data": [*(h.tobytes() for h in hist), losses.tobytes()]})

        def best(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            data = sum(np.frombuffer(x) for x in frame["data"])
            if key[0] < 0:
                return pd.DataFrame({"feature": [-1], "node": [0], "gain": [0.0], "code": [0], "low": [data.tolist()], "total": [[]]})
            found = best_borders(data.reshape(len(growing.open), n_codes, -1), l2)
            return pd.DataFrame([(key[0], k, g, c, a.tolist(), b.tolist()) for k, (g, c, a, b) in enumerate(found)], columns=["feature", "node", "gain", "code", "low", "total"])

        parts = held["table"].mapInPandas(run, "feature int, data binary")
        rows = parts.groupBy("feature").applyInPandas(best, "feature int, node int, gain double, code int, low array<double>, total array<double>").collect()
        sent.destroy()
        found = [[None] * len(growing.open) for _ in borders]
        loss = (math.nan, math.nan)
        for r in rows:
            if r.feature < 0:
                loss = _mean_losses(np.array(r.low))
            else:
                found[r.feature][r.node] = (r.gain, r.code, np.array(r.low), np.array(r.total))
        return found if rows else [], loss

    def settle(growing, tree):
        held["since"].append(Tree(tree.left, tree.right, tree.feature, np.array(growing.code), tree.value, tree.cover))
        if len(held["since"]) < _KEEP:
            return
        since, before = held["since"], held["table"]

        def run(frames):
            for f in frames:
                out = []
                for row in f.itertuples(index=False):
                    b = _Block(*row)
                    out.append((*row[:4], sum((t.predict(b.codes) for t in since), b.score).tobytes()))
                yield pd.DataFrame(out, columns=f.columns)

        held["table"], held["since"] = stored(before.mapInPandas(run, before.schema), "scores"), []
        if before is not table:
            forget(before)

    out = grow(level, settle, borders, **options)
    if held["table"] is not table:
        forget(held["table"])
    return out


def feature_borders(rows: DataFrame, x: str, n_features: int, most_codes: int) -> list[np.ndarray]:
    """Thresholds of each feature of the vectors ``x``: at most ``most_codes`` - 1 of its values at equal ranks, the largest never."""
    shares = [(i + 1) / most_codes for i in range(most_codes)]
    values = rows.select(F.posexplode(x).alias("feature", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    held = dict(values.groupBy("feature").agg(F.percentile_approx("value", shares, 100 * most_codes)).collect())
    return [np.unique(held[f])[:-1] if f in held else np.zeros(0) for f in range(n_features)]


def fit(
    rows: DataFrame, kind: str, features: list[str], responses: list[str], base: np.ndarray, n_trees: int = 50, depth: int = 4, learning_rate: float = 0.1, l2: float = 1.0, patience: int = 10, most_codes: int = 64, one_task: int = 4_000_000
) -> Boosted:
    """A model of rows (x array<double>, y array<double>, held boolean).

    ``held`` rows stop the fit and take no part in it.  Tables of at most ``one_task`` codes (rows x features, counted first) are fitted by
    one task, larger ones level by level over all; the steps are the same.
    """
    if not 2 <= most_codes <= 256:
        raise ValueError("most_codes must be from 2 to 256")
    borders = feature_borders(rows.where("not held"), "x", len(features), most_codes)
    n_codes, n = max(2, 1 + max((len(b) for b in borders), default=1)), len(responses)
    start = np.asarray(base, dtype=float)

    def pack(frames):
        for f in frames:
            for lo in range(0, len(f), _BLOCK_ROWS):
                part = f.iloc[lo : lo + _BLOCK_ROWS]
                x = filled(part["x"], len(features))
                codes = np.column_stack([np.searchsorted(b, x[:, j]) for j, b in enumerate(borders)]).astype(np.uint8)
                y = np.array([np.asarray(v, dtype=float) for v in part["y"]]).reshape(len(part), n)
                held = part["held"].to_numpy(dtype=bool)
                yield pd.DataFrame([(len(part), codes.tobytes(), y.tobytes(), held.tobytes(), np.tile(start, (len(part), 1)).tobytes())], columns=["n", "codes", "y", "held", "score"])

    table = stored(rows.select("x", "y", "held").mapInPandas(pack, "n int, codes binary, y binary, held binary, score binary"), "codes")
    options = {"n_trees": n_trees, "depth": depth, "rate": learning_rate, "l2": l2, "patience": patience}
    size = (table.agg(F.sum("n")).first()[0] or 0) * max(1, len(features))
    if size <= one_task:

        def whole(frames):
            blocks = [_Block(*row) for f in frames for row in f.itertuples(index=False)]
            trees, losses = _fit_blocks(blocks, kind, borders, n_codes, options) if blocks else ([], [])
            yield pd.DataFrame([("tree", i, *(np.asarray(a, float).tobytes() for a in (t.left, t.right, t.feature, t.threshold, t.value, t.cover))) for i, t in enumerate(trees)] + [("loss", 0, np.array(losses).tobytes(), *[b""] * 5)], columns=["what", "i", *"abcdef"])

        got = table.coalesce(1).mapInPandas(whole, "what string, i int, a binary, b binary, c binary, d binary, e binary, f binary").collect()
        trees = []
        for r in sorted((r for r in got if r.what == "tree"), key=lambda r: r.i):
            left, right, feature, threshold, value, cover = (np.frombuffer(bytes(x)) for x in r[2:])
            trees.append(Tree(left.astype(int), right.astype(int), feature.astype(int), threshold, value.reshape(len(left), n), cover))
        losses = next((np.frombuffer(bytes(r.a)).reshape(-1, 2) for r in got if r.what == "loss"), np.zeros((0, 2)))
    else:
        trees, losses = _fit_spark(table, kind, borders, n_codes, options)
    forget(table)
    join = lambda name, like: np.concatenate([getattr(t, name) for t in trees]) if trees else like
    none = np.zeros(0, int)
    first = np.cumsum([0, *(len(t.left) for t in trees)])[:-1] if trees else none
    return Boosted(kind, list(responses), list(features), start, first, join("left", none), join("right", none), join("feature", none), join("threshold", np.zeros(0)), join("value", np.zeros((0, n))), join("cover", np.zeros(0)), np.array(losses).reshape(-1, 2))


def filled(column: pd.Series, dim: int) -> np.ndarray:
    """Vectors as a matrix; missing values are less than any other."""
    x = np.array([np.asarray(v, dtype=float) for v in column]).reshape(len(column), dim)
    return np.where(np.isnan(x), MISSING, x)
