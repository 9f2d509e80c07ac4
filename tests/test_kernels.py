"""Kernels against closed forms, published values and known breaks; edge series."""

import math

import numpy as np
import pytest

from chronogrid.kernels import changes as C
from chronogrid.kernels import distributions as D
from chronogrid.kernels import trends as T

MONTHLY = np.arange(120) / 12 + 2000.0


def season(t):
    return 10 + 3 * np.sin(2 * np.pi * t)


def test_distributions():
    assert D.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert D.chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95)
    assert D.chi2_quantile(0.99, 5) == pytest.approx(15.08627246938899)
    assert D.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert D.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)


EDGES = [np.array([]), np.array([1.0]), np.array([1.0, 2.0]), np.full(40, 3.0), np.arange(40.0), np.array([1.0, 1.0, 2.0, 2.0] * 10)]
KERNELS = [
    T.mann_kendall("hamed_rao"), T.mann_kendall("yue_wang"), T.mann_kendall("seasonal"), T.autoregressive_trend(), T.whittaker(5.0), T.savitzky_golay(5, 2), T.harmonic_interpolation(16, 1),
    T.polar_metrics(), C.landtrendr(), C.recovery(), C.break_points(), C.monitor(2002.0), C.ewmacd(2002.0), C.kalman_state(), C.robust_outliers(), C.phenology(), C.omnibus(4.0), C.coded(),
    C.twdtw({"a": ([50, 100], [1.0, 2.0]), "b": ([50, 100], [2.0, 1.0])}),
]


@pytest.mark.parametrize("kernel", KERNELS)
@pytest.mark.parametrize("values", EDGES)
def test_edge_series_have_an_answer(kernel, values):
    found = kernel(2000 + np.arange(len(values)) / 6, values)
    assert isinstance(found, (dict, list))


def test_trend_tests_see_a_line_through_noise():
    rng = np.random.default_rng(1)
    v = 0.5 * np.arange(60) + rng.normal(0, 3, 60)
    for method in ("hamed_rao", "yue_wang", "seasonal"):
        found = T.mann_kendall(method)(2000 + np.arange(60) / 12, v)
        assert found["trend"] == 1 and found["p"] < 0.01
    assert T.mann_kendall("hamed_rao")(2000 + np.arange(60) / 12, rng.normal(0, 3, 60))["trend"] == 0
    ar = T.autoregressive_trend()(np.arange(60.0), v)
    assert ar["significant"] == 1 and ar["slope"] == pytest.approx(0.5 * 59, rel=0.15)


def test_smoothers():
    t = MONTHLY
    line = 2 + 0.1 * np.arange(120)
    for kernel in (T.whittaker(100.0), T.savitzky_golay(9, 2)):
        assert [r["value"] for r in kernel(t, line)] == pytest.approx(line)
    v = season(t) + np.random.default_rng(2).normal(0, 1, 120)
    a = np.eye(120) + 10 * np.diff(np.eye(120), 2, axis=0).T @ np.diff(np.eye(120), 2, axis=0)
    assert [r["value"] for r in T.whittaker(10.0)(t, v)] == pytest.approx(np.linalg.solve(a, v))
    found = T.harmonic_interpolation(10, 1)(t, season(t))
    assert [r["value"] for r in found] == pytest.approx([season(r["year"]) for r in found])


def test_landtrendr_finds_the_drop():
    v = np.r_[np.full(15, 0.8), 0.3, 0.35, 0.4, 0.45, 0.5] + np.random.default_rng(3).normal(0, 0.01, 20)
    found = C.landtrendr()(np.arange(2000.0, 2020.0), v)
    assert found["yod"] == 2015 and found["magnitude"] == pytest.approx(0.5, abs=0.05) and found["duration"] == 1
    found = C.recovery()(np.arange(2000.0, 2020.0), v)
    assert found["yod"] == 2015 and found["magnitude"] == pytest.approx(0.5, abs=0.03)


def test_breaks_of_a_season():
    rng = np.random.default_rng(4)
    v = season(MONTHLY) + np.where(MONTHLY >= 2006, -6, 0) + rng.normal(0, 0.3, 120)
    assert C.break_points()(MONTHLY, v)["break_date"] == pytest.approx(2006, abs=0.1)
    assert C.break_points()(MONTHLY, season(MONTHLY) + rng.normal(0, 0.3, 120))["n_breaks"] == 0
    assert 2005.9 < C.monitor(2005.0)(MONTHLY, v)["break_date"] < 2007
    assert C.monitor(2005.0)(MONTHLY, season(MONTHLY) + rng.normal(0, 0.3, 120))["has_break"] == 0
    assert C.ewmacd(2004.0)(MONTHLY, v)["break_date"] == pytest.approx(2006, abs=0.2)
    assert C.coded(3.0)(MONTHLY, v)["first_change"] == pytest.approx(2006, abs=0.1)
    assert C.kalman_state()(MONTHLY, v)["n_breaks"] >= 1
    bands = np.column_stack([v, v + rng.normal(0, 0.3, 120)])
    assert C.ccdc()(MONTHLY, bands)[0]["break_date"] == pytest.approx(2006, abs=0.2)


def test_break_points_are_the_best_split():
    """One break: the same as trying every place."""
    rng = np.random.default_rng(5)
    v = np.r_[rng.normal(0, 1, 30), rng.normal(3, 1, 30)]
    t = 2000 + np.arange(60) / 12
    x = C.design(t, 1, t[0])
    cost = {k: C.fit(x[:k], v[:k])[1] + C.fit(x[k:], v[k:])[1] for k in range(9, 52)}
    assert C.break_points(max_breaks=1)(t, v)["first_break"] == pytest.approx(t[min(cost, key=cost.get)])


def test_outliers_and_omnibus():
    v = season(MONTHLY) + np.random.default_rng(6).normal(0, 0.2, 120)
    v[[10, 50, 90]] += 20
    assert 3 <= C.robust_outliers()(MONTHLY, v)["n_flagged"] <= 6
    rng = np.random.default_rng(7)
    same, changed = rng.gamma(4, 0.25, 30), np.r_[rng.gamma(4, 0.25, 15), rng.gamma(4, 2.5, 15)]
    t = np.arange(30) / 10 + 2000
    assert C.omnibus(4.0)(t, same)["n_changes"] == 0
    found = C.omnibus(4.0)(t, changed)
    assert found["n_changes"] >= 1 and found["direction"] == 1


def test_unmixing_recovers_fractions():
    members = {"a": [0.1, 0.4, 0.2], "b": [0.5, 0.1, 0.3], "c": [0.0, 0.0, 0.9]}
    true = np.array([0.2, 0.5, 0.3])
    y = np.array(list(members.values())).T @ true
    found = C.unmix(members)(np.array([2000.0]), y[None])[0]
    assert [found["f_a"], found["f_b"], found["f_c"]] == pytest.approx(true, abs=1e-5)
    assert C.nonnegative(np.eye(2), np.array([-1.0, 2.0])).tolist() == [0.0, 2.0]


def test_time_warping_and_phenology():
    kernel = C.twdtw({"early": ([60, 120, 180], [0.0, 1.0, 0.0]), "late": ([200, 260, 320], [0.0, 1.0, 0.0])})
    t = 2001 + np.array([60, 120, 180, 240, 300]) / 365.25
    assert kernel(t, np.array([0.0, 1.0, 0.0, 0.0, 0.0]))["class"] == "early"
    dense = 2000 + np.arange(0, 366, 8) / 365.25
    found = C.phenology(lmbda=0.1)(dense, np.exp(-(((dense - 2000.5) * 365.25 / 40) ** 2)))
    assert found[0]["peak_doy"] == pytest.approx(183, abs=8) and found[0]["start_doy"] == pytest.approx(183 - 40 * math.sqrt(math.log(2)), abs=8)


def test_superpixels_and_shifts():
    from chronogrid.kernels import images as I

    image = np.zeros((16, 16, 1))
    image[:, 8:] = 5.0
    image[3, 3] = np.nan
    label = I.superpixels(8, 0.5)(image)["segment"]
    assert label[3, 3] == 0 and set(np.unique(label[:, :8])) & set(np.unique(label[:, 8:])) == set()
    assert (label > 0).sum() == 255
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (32, 32))
    b = np.roll(a, (2, -3), axis=(0, 1))
    found = I.shift_by_tile(5)(np.dstack([a, b]))[0]
    assert (found["dx"], found["dy"]) == (-3.0, 2.0)
    assert I.shift_by_tile(5)(np.full((8, 8, 2), np.nan))[0]["dx"] is None
