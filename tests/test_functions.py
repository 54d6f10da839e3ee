import math

import numpy as np
import pytest

from kinspark.functions import tails
from kinspark.functions.splines import basis, knots, spline_fit, wald_statistic


def test_tails_have_known_values():
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert tails.t_sf(2.2281388519649385, 10) == pytest.approx(0.025, abs=1e-10)
    assert tails.t_sf(-1.0, 5) == pytest.approx(1 - tails.t_sf(1.0, 5))
    assert tails.t_sf(0.5, 1) == pytest.approx(0.5 - math.atan(0.5) / math.pi, abs=1e-12)
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi2_sf(5.0, 2) == pytest.approx(math.exp(-2.5), abs=1e-12)
    assert tails.beta_inc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-10)


def test_tracy_widom_meets_its_table_and_rises():
    for x, y in tails.TRACY_WIDOM_TABLE:
        assert tails.tracy_widom_cdf(x) == pytest.approx(y, abs=1e-9)
    assert tails.tracy_widom_cdf(-20) == 0
    assert tails.tracy_widom_cdf(5) > tails.tracy_widom_cdf(3.5) > 0.99
    x = np.linspace(0, 4, 9)
    assert tails.cubic_spline(x, x**3 - x, 1.3) == pytest.approx(1.3**3 - 1.3)


def test_splines_sum_to_one():
    x = np.random.default_rng(1).normal(size=50)
    b = basis(x, knots(x, 5, 3), 3)
    assert b.shape == (50, 6)
    assert np.allclose(b.sum(axis=1), 1)


def test_spline_fit_finds_a_curve_and_refuses_a_constant():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, 200)
    good = spline_fit(x, x**3 + 0.01 * rng.normal(size=200))
    none = spline_fit(x, rng.normal(size=200))
    assert good["r2"] > 0.9 and good["pvalue"] < 1e-20 and good["slope"] == pytest.approx(x.max() ** 3 - x.min() ** 3, abs=0.1)
    assert none["pvalue"] > 1e-3
    assert math.isnan(spline_fit(np.ones(20), x[:20])["r2"])
    w = rng.integers(5, 50, 200)
    y = rng.binomial(w, 1 / (1 + np.exp(-2 * x))) / w
    assert spline_fit(x, y, w)["pvalue"] < 1e-20 and spline_fit(x, y, w, p_method="wald")["pvalue"] < 1e-10


def test_wald_statistic_does_not_depend_on_the_solution():
    rng = np.random.default_rng(3)
    d = np.column_stack([np.ones(40), rng.normal(size=(40, 3))])
    gram, beta = d.T @ d, rng.normal(size=4)
    want = beta[1:] @ np.linalg.inv(np.linalg.inv(gram)[1:, 1:]) @ beta[1:]
    assert wald_statistic(gram, beta) == pytest.approx(want, rel=1e-10)
    d = np.column_stack([np.ones(40), np.arange(40) < 5, np.arange(40) >= 5]).astype(float)  # the last two add up to the first
    gram = d.T @ d
    assert wald_statistic(gram, np.array([0.5, 1.0, 3.0])) == pytest.approx(wald_statistic(gram, np.array([3.5, -2.0, 0.0])), rel=1e-10)
