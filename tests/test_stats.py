"""Kernels against closed forms, exact sums and brute force."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tidemark.functions import stats


@given(st.integers(1, 60), st.integers(0, 60), st.integers(1, 99))
@settings(max_examples=200, deadline=None)
def test_binomial_tail_is_exact(n, k, percent):
    k = min(k, n)
    p = Fraction(percent, 100)
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert stats.binom_sf(k, n, percent / 100) == pytest.approx(float(want), rel=1e-9, abs=1e-12)


def test_distributions():
    assert stats.norm_sf(1.959963984540054) == pytest.approx(0.025)
    assert stats.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert stats.t_sf(2.228138851986, 10) == pytest.approx(0.025, abs=1e-9)
    assert stats.t_sf(-1.0, 1) == pytest.approx(0.75)
    assert stats.f_sf(4.964602743730, 1, 10) == pytest.approx(0.05, abs=1e-9)


@given(st.lists(st.integers(0, 40), min_size=1, max_size=6, unique=True), st.lists(st.integers(41, 80), min_size=1, max_size=6, unique=True), st.randoms())
@settings(max_examples=60, deadline=None)
def test_mann_whitney_exact(a, b, rnd):
    pool = a + b
    rnd.shuffle(pool)
    x, y = pool[: len(a)], pool[len(a) :]
    u, p = stats.mann_whitney(np.array(x), np.array(y))
    count = lambda s: sum(i > j for i in s for j in pool if j not in s)
    assert u == count(x)
    us = [count(c) for c in itertools.combinations(pool, len(x))]
    assert p == pytest.approx(sum(v >= u for v in us) / len(us))


def test_mann_whitney_with_ties_is_normal():
    u, p = stats.mann_whitney(np.array([3, 3, 4, 5, 6, 7, 8, 9, 10]), np.array([1, 2, 3, 3, 4, 2, 1, 2, 3]))
    assert u > 60 and p < 0.01


@given(st.lists(st.integers(-30, 30).filter(bool), min_size=1, max_size=9, unique_by=abs))
@settings(max_examples=60, deadline=None)
def test_wilcoxon_exact(d):
    w, p = stats.wilcoxon_greater(np.array(d))
    ranks = [sorted(map(abs, d)).index(abs(x)) + 1 for x in d]
    assert w == sum(r for r, x in zip(ranks, d) if x > 0)
    sums = [sum(r for r, keep in zip(range(1, len(d) + 1), c) if keep) for c in itertools.product([0, 1], repeat=len(d))]
    assert p == pytest.approx(sum(s >= w for s in sums) / len(sums))


def test_fisher_and_odds():
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)
    assert stats.fisher_exact(8, 2, 1, 5) == pytest.approx(0.034965034965, abs=1e-9)
    o, low, high = stats.odds_ratio(10, 5, 4, 8)
    assert o == 4.0 and low < 1 < high
    assert stats.odds_ratio(0, 5, 4, 8)[0] == pytest.approx(0.5 * 8.5 / (5.5 * 4.5))


def test_welch_and_correlations():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([2.0, 4, 6, 8, 11])
    t, p = stats.welch(x, y)
    assert t == pytest.approx(-3.2 / (2.94**0.5)) and 0.09 < p < 0.14
    assert stats.spearman(x, y)[0] == pytest.approx(1.0)
    z = np.random.default_rng(0).normal(size=200)
    a, b = z + np.random.default_rng(1).normal(size=200) * 0.1, z + np.random.default_rng(2).normal(size=200) * 0.1
    assert stats.spearman(a, b)[0] > 0.95 and abs(stats.partial_spearman(a, b, z)[0]) < 0.3


@given(st.lists(st.floats(0, 1), min_size=1, max_size=30))
def test_bh_is_monotone_and_above_p(p):
    p = np.array(p)
    q = stats.benjamini_hochberg(p)
    assert (q >= p - 1e-12).all() and (q <= 1).all()
    order = np.argsort(p, kind="stable")
    assert (np.diff(q[order]) >= -1e-12).all()
    assert np.isnan(stats.benjamini_hochberg(np.array([np.nan, 0.5]))).tolist() == [True, False]


def brute_partition(x, penalty, least):
    med = np.median(((x[:, None] - x[None, :]) ** 2)[np.triu_indices(len(x), 1)])
    d = (x[:, None] - x[None, :]) ** 2
    k = np.exp(-np.clip(d / med if med > 0 else d, 1e-2, 100))
    np.fill_diagonal(k, 1.0)
    cost = lambda a, b: (b - a) - k[a:b, a:b].sum() / (b - a)
    best = {0: -penalty}
    for b in range(least, len(x) + 1):
        options = [best[a] + cost(a, b) + penalty for a in best if b - a >= least]
        if options:
            best[b] = min(options)
    return best[len(x)], cost


@given(st.lists(st.floats(-5, 5), min_size=6, max_size=24), st.sampled_from([0.5, 1.0, 2.0]), st.integers(2, 4))
@example([0, 0, 2, 2, 3, 2.25, 0], 0.5, 3)
@settings(max_examples=500, deadline=None)
def test_pelt_is_optimal(values, penalty, least):
    x = np.array(values)
    ends = stats.pelt(x, penalty, least)
    if len(x) < 2 * least:
        assert ends == [len(x)]
        return
    want, cost = brute_partition(x, penalty, least)
    got = sum(cost(a, b) + penalty for a, b in zip([0, *ends[:-1]], ends)) - penalty
    assert got == pytest.approx(want, abs=1e-9) and all(b - a >= least for a, b in zip([0, *ends[:-1]], ends))


@given(st.lists(st.floats(-5, 5).map(lambda v: round(v, 2)), min_size=3, max_size=40))
@settings(max_examples=200, deadline=None)
def test_median_gap_without_pairs(values):
    x = np.array(values)
    assert stats.median_gap(x, 0) == pytest.approx(stats.median_gap(x), rel=1e-9, abs=1e-12)


def test_pelt_finds_a_step():
    x = np.concatenate([np.zeros(40), np.ones(30) * 4, np.zeros(40)]) + np.random.default_rng(0).normal(0, 0.2, 110)
    assert stats.pelt(x, 2, 7) == [40, 70, 110]


def ar2(n, seed, extra=None):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(2, n):
        y[t] = 0.5 * y[t - 1] - 0.3 * y[t - 2] + rng.normal() + (extra[t] if extra is not None else 0)
    return y


def test_regressions():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=400), rng.normal(size=400), np.ones(400)])
    y = x @ [2.0, 0.0, 1.0] + rng.normal(size=400)
    for cov in ("plain", "hc1", "hac"):
        fit = stats.ols(y, x, cov)
        assert fit.beta == pytest.approx([2, 0, 1], abs=0.2) and fit.p[0] < 1e-10 and fit.p[1] > 0.01
    plain, robust = stats.ols(y, x), stats.ols(y, x, "hac", 0)
    assert robust.se == pytest.approx(plain.se, rel=0.3)
    lg = stats.logit((rng.random(2000) < 1 / (1 + np.exp(-1.0))).astype(float), np.ones((2000, 1)))
    assert lg.beta[0] == pytest.approx(1.0, abs=0.2)
    assert stats.ar_order(ar2(600, 4)) == 2


def test_granger_and_lags():
    rng = np.random.default_rng(5)
    s = rng.normal(size=300)
    t = np.concatenate([[0, 0], s[:-2]]) + 0.3 * rng.normal(size=300)
    f, p, lag = stats.granger(s, t, 4)
    assert p < 1e-6 and lag == 2 and stats.granger(t, s, 4)[1] > 0.001
    assert stats.cross_correlation(s, t)[0] == 2
    assert stats.lagged(np.array([[1.0], [2.0], [3.0]]), 1).tolist() == [[1, 0], [2, 1], [3, 2]]
    h = stats.local_projection(t, s, 4)
    assert h[2][1] == pytest.approx(1.0, abs=0.15) and h[2][3] < 1e-6


def test_stability_selection_recovers_the_drivers():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 12))
    y = 1.5 * x[:, 2] - 1.0 * x[:, 7] + rng.normal(size=200)
    freq, stable = stats.stability_selection(y, np.column_stack([x, np.linspace(-1, 1, 200)]), controls=1, samples=40)
    assert stable[2] and stable[7] and freq[2] == freq[7] == 1.0 and freq[[i for i in range(12) if i not in (2, 7)]].mean() < 0.95
    b = stats.elastic_net(y - y.mean(), x - x.mean(0), 0.3, 0.9)
    assert set(np.flatnonzero(b)) == {2, 7}
    boots = stats.bootstrap_sums(y, x, [np.array([2]), np.array([7])], 200)
    assert np.quantile(boots[:, 0], 0.05) > 1 and np.quantile(boots[:, 1], 0.95) < -0.5


def test_effects_around_a_peak():
    t = np.concatenate([np.zeros(40), np.ones(40)]) + np.random.default_rng(7).normal(0, 0.1, 80)
    did, p = stats.diff_in_diff(t, 40)
    assert did == pytest.approx(1.0, abs=0.1) and p < 1e-8
    assert stats.circular_shift_p(lambda s: stats.diff_in_diff(s, 40)[0], t) < 0.2


def test_information():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 4, 2000)
    assert stats.mutual_information(a, a) == pytest.approx(stats.joint_entropy(a))
    assert stats.mutual_information(a, rng.integers(0, 4, 2000)) < 0.02
    b = np.concatenate([[0], a[:-1]])
    assert stats.transfer_entropy(a, b) > 1.5 > 0.1 > stats.transfer_entropy(b, a)
    assert stats.bins(np.array([1.0, 1.0])).tolist() == [0, 0] and stats.bins(np.array([0, 0.5, 1.0]), 2).tolist() == [0, 1, 1]


def test_series_helpers():
    assert stats.weighted_percentile(np.array([1.0, 2, 3]), np.array([1.0, 1, 1]), 0.5) == 2
    assert math.isnan(stats.weighted_percentile(np.array([1.0]), np.array([0.0]), 0.5))
    assert stats.peaks(np.array([0, 1, 0, 0, 0, 0, 0, 0, 0, 3, 0.0]), 0.5) == [1, 9]
    assert stats.centred_mean(np.array([1.0, 2, 3, 4]), 3).tolist() == [1.5, 2, 3, 3.5]
