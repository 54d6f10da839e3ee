"""B-spline bases and small generalised linear models."""

from __future__ import annotations

import math

import numpy as np

from kinspark.functions.tails import chi2_sf


def knots(x: np.ndarray, df: int, degree: int) -> np.ndarray:
    """Boundary knots degree + 1 times, and df - degree inner knots at equal quantiles."""
    inner = np.quantile(x, np.linspace(0, 1, df - degree + 2)[1:-1])
    return np.concatenate([np.repeat(x.min(), degree + 1), inner, np.repeat(x.max(), degree + 1)])


def basis(x: np.ndarray, t: np.ndarray, degree: int) -> np.ndarray:
    """Values of all B-splines on the knots t at x by the Cox-de Boor recursion; the last one includes its right end.

    ``t`` holds the knots of all x, or has a row of knots for each.
    """
    x, t = np.asarray(x, dtype=float), np.atleast_2d(t)
    wide = t.shape[1] - 1
    filled = t[:, :-1] < t[:, 1:]
    last = wide - 1 - filled[:, ::-1].argmax(axis=1)
    b = [((t[:, i] <= x) & ((x < t[:, i + 1]) | ((last == i) & (x == t[:, i + 1])))).astype(float) for i in range(wide)]
    for p in range(1, degree + 1):
        nxt = []
        for i in range(wide - p):
            up, down = t[:, i + p] - t[:, i], t[:, i + p + 1] - t[:, i + 1]
            rise = np.divide(x - t[:, i], up, out=np.zeros(len(x)), where=np.broadcast_to(up > 0, len(x)))
            fall = np.divide(t[:, i + p + 1] - x, down, out=np.zeros(len(x)), where=np.broadcast_to(down > 0, len(x)))
            nxt.append(rise * b[i] + fall * b[i + 1])
        b = nxt
    return np.array(b).T


def design(x: np.ndarray, t: np.ndarray, degree: int) -> np.ndarray:
    """A constant and all splines but the first: they sum to one, so one of them makes way for the constant."""
    return np.column_stack([np.ones(len(x)), basis(x, t, degree)[:, 1:]])


def solve(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """Least squares from summed products, and the rank of the design without its constant."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    value, vector = np.linalg.eigh(gram / scale / scale[:, None])
    good = value > 1e-11 * value[-1]
    return (vector[:, good] / value[good]) @ (vector[:, good].T @ (right / scale)) / scale, int(good.sum()) - 1


def wald_statistic(gram: np.ndarray, beta: np.ndarray) -> float:
    """Wald statistic of all coefficients but the constant's, from the weighted Gram matrix; column 0 is the constant.

    The inverse of their covariance is the Gram matrix of the centred columns.  That needs no inverse, and where the design
    has not full rank every least-squares solution has the same statistic.
    """
    centred = gram[1:, 1:] - np.outer(gram[1:, 0], gram[0, 1:]) / gram[0, 0]
    return max(0.0, float(beta[1:] @ centred @ beta[1:]))


def _binomial(design: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Iteratively reweighted least squares: coefficients and log-likelihood without its constant part."""
    mu = (w * y + 0.5) / (w + 1.0)
    beta = np.zeros(design.shape[1])
    last = -math.inf
    for _ in range(100):
        eta = np.log(mu / (1 - mu))
        v = np.maximum(w * mu * (1 - mu), 1e-12)
        z = eta + (y - mu) / np.maximum(mu * (1 - mu), 1e-12)
        beta = np.linalg.lstsq(design * np.sqrt(v)[:, None], z * np.sqrt(v), rcond=None)[0]
        mu = np.clip(1 / (1 + np.exp(-np.clip(design @ beta, -700, 700))), 1e-12, 1 - 1e-12)
        like = float((w * (y * np.log(mu) + (1 - y) * np.log(1 - mu))).sum())
        if abs(like - last) < 1e-10 * (abs(like) + 1e-10):
            break
        last = like
    return beta, like


def spline_fit(x: np.ndarray, y: np.ndarray, totals: np.ndarray | None = None, df: int = 5, degree: int = 3, p_method: str = "lrt") -> dict[str, float]:
    """y against a spline of x: r2 (Cox-Snell), amplitude and slope of the fit, p-value against a constant.

    Gaussian, or binomial with proportions y of ``totals``.  A constant x, or a fit that fails, gives NaN.
    """
    nan = dict.fromkeys(("r2", "amplitude", "slope", "pvalue"), math.nan)
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    n = len(x)
    if n < df + 2 or np.allclose(x, x[0]):
        return nan
    t = knots(x, df, degree)

    d = design(x, t, degree)
    rank = np.linalg.matrix_rank(d) - 1
    try:
        if totals is None:
            beta = np.linalg.lstsq(d, y, rcond=None)[0]
            rss, tss = float(((y - d @ beta) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
            if tss <= 0 or rss <= 0:
                return nan
            lrt, size = n * math.log(tss / rss), n
            wald = (tss - rss) / (rss / (n - rank - 1))
            link = lambda v: v
        else:
            w = np.asarray(totals, dtype=float)
            beta, like = _binomial(d, y, w)
            base = float(np.clip((w * y).sum() / w.sum(), 1e-12, 1 - 1e-12))
            null = float((w * (y * math.log(base) + (1 - y) * math.log(1 - base))).sum())
            lrt, size = 2 * (like - null), float(w.sum())
            mu = 1 / (1 + np.exp(-(d @ beta)))
            info = d.T @ (d * (w * mu * (1 - mu))[:, None])
            wald = wald_statistic(info, beta)
            link = lambda v: 1 / (1 + np.exp(-np.clip(v, -700, 700)))
    except np.linalg.LinAlgError:
        return nan
    fit, ends = link(d @ beta), link(design(np.array([x.max(), x.min()]), t, degree) @ beta)
    stat = lrt if p_method == "lrt" else wald
    return {"r2": 1 - math.exp(-lrt / size), "amplitude": float(fit.max() - fit.min()), "slope": float(ends[0] - ends[1]), "pvalue": float(chi2_sf(stat, rank))}
