"""Embeddings of groups from their neighbour counts: a full softmax model and a Poisson factor model.

Counts stay in Spark, grouped by row (and by column for the Poisson model) and stored once.  A round is one job: the driver
sends the parameters, groups x dimensions; tasks solve their own rows, some at a time, and sum what the columns need.  What
comes back is groups x dimensions again, never counts or a groups x groups matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.sources.store import forget, stored

#: Cells of a dense block of counts in a task.
_CELLS = 2_000_000
#: Numbers of a sum that are added up and sent to the driver together.
_SENT = 1 << 17


@dataclass
class EmbeddingModel:
    """Rows of ``u`` belong to ``rows``, rows of ``v`` (and ``bias``) to ``cols``; one loss per round in ``history``."""

    rows: list[str]
    cols: list[str]
    u: np.ndarray
    v: np.ndarray
    bias: np.ndarray
    row_bias: np.ndarray | None = None
    history: list[float] = field(default_factory=list)

    def embedding(self, spark) -> DataFrame:
        return spark.createDataFrame([(r, [float(x) for x in e]) for r, e in zip(self.rows, self.u, strict=True)], "clone string, u array<double>")

    def weights(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, [float(x) for x in e], float(b)) for c, e, b in zip(self.cols, self.v, self.bias, strict=True)], "clone string, v array<double>, bias double")

    def losses(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, float(x)) for i, x in enumerate(self.history)], "epoch int, loss double")


def check_counts(edges: DataFrame) -> None:
    """Counts must be whole and not negative."""
    if not edges.where((F.col("weight") < 0) | (F.col("weight") != F.floor("weight"))).isEmpty():
        raise ValueError("edge weights must be whole and not negative")


def add_mask_columns(edges: DataFrame, masked: DataFrame) -> DataFrame:
    """Edges with the counts (src, mask, n) of masked neighbours as further columns."""
    return edges.select(F.col("src").cast("string"), F.col("dst").cast("string"), "weight").unionByName(
        masked.select(F.col("src").cast("string"), F.col("mask").cast("string").alias("dst"), F.col("n").alias("weight"))
    )


@dataclass
class _Counts:
    """Stored counts: ``frame`` has (i, at, w) for each row: its number, the numbers of its columns and their counts."""

    frame: DataFrame
    rows: int
    cols: int
    row_sums: np.ndarray
    col_sums: np.ndarray
    parts: int = 1

    def blocks(self, f: Callable, *sent):
        """Apply ``f`` in tasks to (numbers, dense counts) of some rows at a time and collect what it yields: (key, array).

        Arrays with the same key are added up, those with the key -1 are rows' own and stay apart.  Tasks add up what they have, and
        Spark the tasks' sums, a block of numbers at a time, so what the driver gets doesn't grow with the number of tasks.
        """
        spark, cols = self.frame.sparkSession, self.cols
        payload = spark.sparkContext.broadcast(sent)

        def run(frames):
            sums: dict[int, np.ndarray] = {}
            for frame in frames:
                step = max(1, _CELLS // max(1, cols))
                for lo in range(0, len(frame), step):
                    part = frame.iloc[lo : lo + step]
                    a = np.zeros((len(part), cols))
                    for n, (at, w) in enumerate(zip(part["at"], part["w"], strict=True)):
                        a[n, at] = w
                    for key, value in f(part["i"].to_numpy(), a, *payload.value):
                        if key < 0:
                            yield pd.DataFrame({"key": [-1], "at": [int(part["i"].iloc[0])], "data": [value.tobytes()]})
                        else:
                            sums[key] = value if key not in sums else sums[key] + value
            rows = [(key, at, v[at : at + _SENT].tobytes()) for key, v in sums.items() for at in range(0, len(v), _SENT)]
            yield pd.DataFrame(rows, columns=["key", "at", "data"])

        def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"key": [key[0]], "at": [key[1]], "data": [sum(np.frombuffer(x) for x in frame["data"]).tobytes()]})

        got = self.frame.select("i", "at", "w").mapInPandas(run, "key int, at int, data binary")
        if self.parts > 1:  # rows' own values have their first row's number, so each is a group of its own
            got = got.groupBy("key", "at").applyInPandas(add, "key int, at int, data binary")
        own, total = [], {}
        for r in sorted(got.collect(), key=lambda r: (r.key, r["at"])):
            value = np.frombuffer(r.data)
            if r.key < 0:
                own.append(value)
            else:
                total.setdefault(r.key, []).append(value)
        payload.destroy()
        return own, {key: np.concatenate(parts) for key, parts in total.items()}

    def solve(self, f: Callable, width: int, *sent) -> np.ndarray:
        """(rows x width): ``f`` gives the values of some rows from (numbers, counts)."""

        def own(i, a, *sent):
            yield -1, np.column_stack([i.astype(float), f(i, a, *sent)]).ravel()

        out = np.zeros((self.rows, width))
        for part in self.blocks(own, *sent)[0]:
            part = part.reshape(-1, width + 1)
            out[part[:, 0].astype(int)] = part[:, 1:]
        return out

    def sums(self, f: Callable, *sent) -> dict[int, np.ndarray]:
        """Sums over all rows of the arrays that ``f`` yields by key."""
        return self.blocks(f, *sent)[1]


def _names(edges: DataFrame, col: str, most_groups: int) -> list[str]:
    found = [r[0] for r in edges.select(F.col(col).cast("string").alias("c")).where("c is not null").distinct().orderBy("c").limit(most_groups + 1).collect()]
    if len(found) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    return found


def count_rows(edges: DataFrame, both: bool = False, most_groups: int = 500_000) -> tuple[_Counts, _Counts | None, list[str], list[str]]:
    """Stored counts by row, by column if ``both``, and the names of rows and columns in order.

    ``most_groups`` bounds what the driver holds and sends: names and parameters of groups.
    """
    check_counts(edges)
    rows, cols = _names(edges, "src", most_groups), _names(edges, "dst", most_groups)
    spark = edges.sparkSession

    def numbered(names, col):
        return spark.createDataFrame(pd.DataFrame({col: pd.Series(names, dtype=object), f"_{col}": np.arange(len(names))}), f"{col} string, _{col} int")

    own = edges.where("weight > 0").select(F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("double").alias("w"))
    at = own.join(F.broadcast(numbered(rows, "src")), "src").join(F.broadcast(numbered(cols, "dst")), "dst").groupBy("_src", "_dst").agg(F.sum("w").alias("w"))
    at = stored(at, "counts")
    totals = [np.zeros(len(rows)), np.zeros(len(cols))]
    for total, col in zip(totals, ("_src", "_dst"), strict=True):
        for r in at.groupBy(col).agg(F.sum("w").alias("w")).collect():
            total[r[0]] = r.w
    out = []
    for i, j in (("_src", "_dst"), ("_dst", "_src"))[: 1 + both]:
        n, m = (len(rows), len(cols)) if i == "_src" else (len(cols), len(rows))
        packed = at.groupBy(F.col(i).alias("i")).agg(F.collect_list(j).alias("at"), F.collect_list("w").alias("w"))
        # So many partitions that each has some dense blocks of work, and no more.
        parts = max(1, min(spark.sparkContext.defaultParallelism * 4, -(-n * m // (4 * _CELLS))))
        packed = stored(packed.coalesce(parts) if parts == 1 else packed.repartition(parts), "rows")
        mine, others = (totals[0], totals[1]) if i == "_src" else (totals[1], totals[0])
        out.append(_Counts(packed, n, m, mine, others, parts))
    forget(at)
    return out[0], out[1] if both else None, rows, cols


def svd_start(counts: _Counts, z: int, seed: int = 4, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """U and V scaled by the roots of the singular values of log(1 + counts), by subspace iteration over the stored rows."""
    z = min(z, counts.rows, counts.cols)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(counts.cols, min(z + 10, counts.rows, counts.cols))))[0]

    def times(i, a, v):
        return np.log1p(a) @ v

    def turned(i, a, q):
        yield 0, (np.log1p(a).T @ q[i]).ravel()

    for left in range(rounds, -1, -1):
        q = np.linalg.qr(counts.solve(times, v.shape[1], v))[0]
        b = counts.sums(turned, q).get(0, np.zeros(counts.cols * q.shape[1])).reshape(counts.cols, -1)
        if left:
            v = np.linalg.qr(b)[0]
    right, s, left = np.linalg.svd(b, full_matrices=False)
    u, s, v = (q @ left.T)[:, :z], s[:z], right[:, :z]
    sign = np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return u * np.sqrt(s) * sign, v * np.sqrt(s) * sign


def _wide(x: np.ndarray, z: int) -> np.ndarray:
    """``x`` with columns of zeros up to z."""
    return x if x.shape[1] >= z else np.column_stack([x, np.zeros((len(x), z - x.shape[1]))])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _settled(history: list[float], delta: float, patience: int) -> bool:
    """The relative change was under ``delta`` in each of the last ``patience`` rounds."""
    last = history[-patience - 1 :]
    return len(last) == patience + 1 and all(abs((b - a) / (abs(a) + 1e-9)) < delta for a, b in zip(last, last[1:], strict=False))


def _ascend(u: np.ndarray, like: Callable, direction: Callable, rounds: int) -> np.ndarray:
    """Newton steps of rows, each halved until the row's likelihood does not fall."""
    every = np.arange(len(u))
    for _ in range(rounds):
        step, now, size = direction(u), like(u, every), np.ones(len(u))
        worse = every
        for _ in range(30):
            worse = worse[like(u[worse] + size[worse, None] * step[worse], worse) < now[worse] - 1e-12]
            if not len(worse):
                break
            size[worse] /= 2
        else:
            size[worse] = 0.0
        u = u + size[:, None] * step
    return u


def _softmax_rows(a: np.ndarray, v: np.ndarray, b: np.ndarray, u: np.ndarray, rounds: int, ridge: float) -> np.ndarray:
    """Rows of U that make their counts likeliest, V and b given; ``ridge`` a count keeps them finite."""
    total = a.sum(axis=1)
    own = ridge * total

    def like(x, rows):
        logits = x @ v.T + b
        top = logits.max(axis=1)
        return (a[rows] * logits).sum(axis=1) - total[rows] * (top + np.log(np.exp(logits - top[:, None]).sum(axis=1))) - own[rows] * (x * x).sum(axis=1) / 2

    def direction(x):
        p = _softmax(x @ v.T + b)
        mean = p @ v
        spread = np.einsum("ij,jk,jl->ikl", p, v, v, optimize=True) - mean[:, :, None] * mean[:, None, :]
        h = total[:, None, None] * spread + (own[:, None, None] + 1e-9) * np.eye(v.shape[1])
        return np.linalg.solve(h, ((a - total[:, None] * p) @ v - own[:, None] * x)[:, :, None])[:, :, 0]

    return _ascend(u, like, direction, rounds)


def fit_softmax(
    edges: DataFrame, z_dim: int = 10, max_iter: int = 500, step: float = 1.0, init: str | np.ndarray = "svd", seed: int = 4, min_delta: float = 1e-4, patience: int = 5, ridge: float = 1e-3, inner: int = 3
) -> EmbeddingModel:
    """P(j | i) = softmax(V u_i + b)_j, fitted to counts; the loss is the mean negative log-likelihood.

    By turns: every row's u is solved in its task by Newton steps (a row's problem is convex), then V and b take a step
    along their summed gradient, scaled by each column's count and the second moments of the rows, and halved whenever the
    penalised loss rose.  A round is one job.  Groups without counts keep their start.
    """
    counts, _, rows, cols = count_rows(edges)
    rng = np.random.default_rng(seed)
    if isinstance(init, np.ndarray) and init.shape == (len(rows), z_dim):
        u, v = init.astype(float).copy(), _wide(svd_start(counts, z_dim)[1], z_dim)
    elif isinstance(init, str) and init == "random":
        u, v = rng.uniform(-1, 1, (len(rows), z_dim)), rng.uniform(-1, 1, (len(cols), z_dim))
    elif isinstance(init, np.ndarray) or init == "svd":  # an array of another shape is no start
        u, v = (_wide(x, z_dim) for x in svd_start(counts, z_dim))
    else:
        raise ValueError(f"unknown start {init!r}")
    n, share = max(1.0, counts.row_sums.sum()), np.maximum(counts.col_sums, 0.5)
    w = np.column_stack([v, np.log(share / n)])
    keep = np.append(np.full(z_dim, ridge), 0.0)

    def round_of(i, a, w, u):
        v, b = w[:, :-1], w[:, -1]
        x = _softmax_rows(a, v, b, u[i], inner, ridge)
        yield -1, np.column_stack([i.astype(float), x]).ravel()
        total, p = a.sum(axis=1), _softmax(x @ v.T + b)
        one = np.column_stack([x, np.ones(len(x))])
        yield 0, ((total[:, None] * p - a).T @ one).ravel()
        yield 1, ((one * total[:, None]).T @ one).ravel()
        yield 2, np.array([-(a * np.log(np.maximum(p, 1e-300))).sum(), ridge * (total * (x * x).sum(axis=1)).sum() / 2])

    history: list[float] = []
    best = None  # (penalised loss, w, u, gradient, second moments) of the best round
    for _ in range(max_iter):
        own, sums = counts.blocks(round_of, w, u)
        if not sums:
            break
        for part in own:
            part = part.reshape(-1, z_dim + 1)
            u[part[:, 0].astype(int)] = part[:, 1:]
        penalised = float(sums[2].sum() / n + (share / n) @ (w * w) @ keep / 2)
        if best is None or penalised <= best[0] + 1e-12:
            best = penalised, w, u.copy(), sums[0].reshape(len(cols), -1) / n, sums[1].reshape(z_dim + 1, -1) / n
            history.append(float(sums[2][0] / n))
        else:
            step, u = step / 2, best[2].copy()
            history.append(history[-1])
        if _settled(history, min_delta, patience) or step < 1e-3:
            break
        grad = best[3] + best[1] * keep * (share / n)[:, None]
        w = best[1] - step * np.linalg.solve(best[4] + ridge * np.eye(z_dim + 1), grad.T).T / (share / n)[:, None]
    forget(counts.frame)
    if best is not None:
        w, u = best[1], best[2]
    return EmbeddingModel(rows, cols, u, w[:, :-1], w[:, -1], history=history)


def _projected(edges: DataFrame, model: EmbeddingModel, solve: Callable) -> DataFrame:
    """(clone, u) of the rows of ``edges``; columns are matched by name, others are ignored.  Some rows at a time in tasks."""
    sent = edges.sparkSession.sparkContext.broadcast((model.cols, model.v, model.bias))
    src = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))
    grouped = src.groupBy("src").agg(F.collect_list("dst").alias("at"), F.collect_list("weight").alias("w"))

    def run(frames):
        cols, v, b = sent.value
        place = {c: j for j, c in enumerate(cols)}
        step = max(1, _CELLS // max(1, len(cols)))
        for frame in frames:
            for lo in range(0, len(frame), step):
                part = frame.iloc[lo : lo + step]
                a = np.zeros((len(part), len(cols)))
                for n, (at, w) in enumerate(zip(part["at"], part["w"], strict=True)):
                    known = [(place[c], x) for c, x in zip(at, w, strict=True) if c in place]
                    if known:
                        np.add.at(a[n], [j for j, _ in known], [x for _, x in known])
                yield pd.DataFrame({"clone": part["src"].to_numpy(), "u": solve(a, v, b).tolist()})

    return grouped.mapInPandas(run, "clone string, u array<double>")


def project_softmax(edges: DataFrame, model: EmbeddingModel, rounds: int = 25, ridge: float = 1e-3) -> DataFrame:
    """(clone, u) of new groups with V and b frozen, as :func:`fit_softmax` solves its rows.

    Columns are matched by name; rows are fitted alone, in tasks.  A group without a known column gets zeros.
    """
    return _projected(edges, model, lambda a, v, b: _softmax_rows(a, v, b, np.zeros((len(a), v.shape[1])), rounds, ridge))


def _poisson_rows(a: np.ndarray, offset: np.ndarray, v: np.ndarray, u: np.ndarray, rounds: int, ridge: float = 1e-6) -> np.ndarray:
    """Newton steps of every row's Poisson regression on v with an offset."""

    def like(x, rows):
        eta = offset[rows] + x @ v.T
        return (a[rows] * eta - np.exp(np.minimum(eta, 50))).sum(axis=1) - ridge * (x * x).sum(axis=1) / 2

    def direction(x):
        mu = np.exp(np.minimum(offset + x @ v.T, 50))
        h = np.einsum("ij,jk,jl->ikl", mu, v, v, optimize=True) + ridge * np.eye(v.shape[1])
        return np.linalg.solve(h, ((a - mu) @ v - ridge * x)[:, :, None])[:, :, 0]

    return _ascend(u, like, direction, rounds)


def fit_poisson(edges: DataFrame, z_dim: int = 10, max_iter: int = 100, tol: float = 1e-4, col_size_factor: bool = True, row_intercept: bool = True, inner: int = 3, init: str = "svd", seed: int = 4) -> EmbeddingModel:
    """A_ij ~ Poisson(exp(r_i + c_j + u_i . v_j)): row and column offsets from totals, u and v by turns.

    With one side given, the rows of the other are regressions of their own and solved in tasks: a round is one job over the
    counts by row and one over the counts by column.
    """
    by_row, by_col, rows, cols = count_rows(edges, both=True)
    n, m = len(rows), len(cols)
    total = max(1.0, by_row.row_sums.sum())
    r = np.log(np.maximum(by_row.row_sums, 0.5)) if row_intercept else np.zeros(n)
    c = np.log(np.maximum(by_row.col_sums, 0.5) / total) if col_size_factor else np.zeros(m)
    if not row_intercept and not col_size_factor:
        c = c + np.log(total / (n * m))
    if init == "svd":
        u, v = (0.1 * (x - x.mean(axis=0)) for x in svd_start(by_row, z_dim))
    else:
        rng = np.random.default_rng(seed)
        u, v = rng.normal(size=(n, z_dim)) * 0.01, rng.normal(size=(m, z_dim)) * 0.01
    z = u.shape[1]

    def solved(i, a, mine, other, x, y):
        return _poisson_rows(a, mine[i][:, None] + other[None, :], y, x[i], inner)

    def solved_with_loss(i, a, mine, other, x, y):
        new = solved(i, a, mine, other, x, y)
        eta = mine[i][:, None] + other[None, :] + new @ y.T
        yield -1, np.column_stack([i.astype(float), new]).ravel()
        yield 0, np.array([-(a * eta - np.exp(np.minimum(eta, 50))).sum()])

    history: list[float] = []
    for _ in range(max_iter):
        u = by_row.solve(solved, z, r, c, u, v)
        own, sums = by_col.blocks(solved_with_loss, c, r, v, u)
        for part in own:
            part = part.reshape(-1, z + 1)
            v[part[:, 0].astype(int)] = part[:, 1:]
        history.append(float(sums.get(0, np.zeros(1))[0] / total))
        if len(history) > 1 and abs(history[-2] - history[-1]) < tol * (abs(history[-2]) + 1e-9):
            break
    forget(by_row.frame, by_col.frame)
    # One form of the many with the same product: orthogonal columns, largest first.
    (qu, ru), (qv, rv) = np.linalg.qr(u), np.linalg.qr(v)
    p, s, qt = np.linalg.svd(ru @ rv.T)
    left, right = qu @ p, qv @ qt.T
    sign = np.where(left[np.abs(left).argmax(axis=0), np.arange(z)] < 0, -1.0, 1.0)
    return EmbeddingModel(rows, cols, left * np.sqrt(s) * sign, right * np.sqrt(s) * sign, c, r, history)


def project_poisson(edges: DataFrame, model: EmbeddingModel, rounds: int = 25) -> DataFrame:
    """(clone, u) of new groups with v and column offsets frozen; mask columns that the model lacks are ignored."""
    intercept = model.row_bias is not None and bool(np.any(model.row_bias))

    def solve(a, v, c):
        r = np.log(np.maximum(a.sum(axis=1), 0.5)) if intercept else np.zeros(len(a))
        return _poisson_rows(a, r[:, None] + c[None, :], v, np.zeros((len(a), v.shape[1])), rounds)

    return _projected(edges, model, solve)
