"""Statistical kernels in NumPy: small arrays, called once a group inside Spark tasks."""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np

# --- distributions -------------------------------------------------------------


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - norm_sf(mid) < p else (low, mid)
    return (low + high) / 2


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return min(1.0, front * f)


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    if not math.isfinite(t):
        return 0.0 if t > 0 else 1.0
    tail = betainc(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t >= 0 else 1 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial, exact."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    return 1.0 if p >= 1 else betainc(k, n - k + 1, p)


# --- tests --------------------------------------------------------------------------


def ranks(x: np.ndarray) -> np.ndarray:
    """Mean ranks from 1."""
    x = np.asarray(x, float)
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    end = np.concatenate([at[1:], [len(x)]])
    out = np.empty(len(x))
    out[order] = ((at + 1 + end) / 2)[group]
    return out


def _tie_term(x: np.ndarray) -> float:
    _, c = np.unique(x, return_counts=True)
    return float((c.astype(float) ** 3 - c).sum())


def mann_whitney(x: np.ndarray, y: np.ndarray, exact_below: int = 8) -> tuple[float, float]:
    """U of x and the one-sided p that x is greater: exact for small samples without ties, else normal with continuity."""
    n, m = len(x), len(y)
    both = np.concatenate([x, y]).astype(float)
    u = float(ranks(both)[:n].sum() - n * (n + 1) / 2)
    ties = _tie_term(both)
    if not ties and min(n, m) <= exact_below:
        ways = np.zeros((n + 1, n * m + 1))
        ways[0, 0] = 1
        for v in range(1, n + m + 1):  # choose which ranks are x's
            for k in range(min(n, v), 0, -1):
                shift = v - k
                if shift <= n * m:
                    ways[k, shift:] += ways[k - 1, : n * m + 1 - shift]
        return u, float(ways[n, int(round(u)) :].sum() / ways[n].sum())
    total = n + m
    sd = math.sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1)))) if total > 1 else 0.0
    return u, norm_sf((u - n * m / 2 - 0.5) / sd) if sd > 0 else 1.0


def wilcoxon_greater(d: np.ndarray) -> tuple[float, float]:
    """Signed-rank sum of the positive differences and its one-sided p; zeros are dropped."""
    d = np.asarray(d, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    r = ranks(np.abs(d))
    w = float(r[d > 0].sum())
    if n <= 25 and not _tie_term(np.abs(d)):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return w, float(ways[int(w) :].sum() / ways.sum())
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - _tie_term(np.abs(d)) / 48)
    return w, norm_sf((w - n * (n + 1) / 4 - 0.5) / sd)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: all tables of its margins that are no likelier."""
    n, r, k = a + b + c + d, a + b, a + c
    logc = lambda n_, k_: math.lgamma(n_ + 1) - math.lgamma(k_ + 1) - math.lgamma(n_ - k_ + 1)
    low, high = max(0, r + k - n), min(r, k)
    logs = np.array([logc(k, x) + logc(n - k, r - x) for x in range(low, high + 1)]) - logc(n, r)
    probs = np.exp(logs)
    return float(min(1.0, probs[probs <= probs[a - low] * (1 + 1e-7)].sum()))


def odds_ratio(a: float, b: float, c: float, d: float, alpha: float = 0.05) -> tuple[float, float, float]:
    """Odds ratio with Woolf's interval; half a row is added to every cell if one is empty."""
    if min(a, b, c, d) == 0:
        a, b, c, d = a + 0.5, b + 0.5, c + 0.5, d + 0.5
    o, half = a * d / (b * c), norm_ppf(1 - alpha / 2) * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return o, math.exp(math.log(o) - half), math.exp(math.log(o) + half)


def welch(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Welch's t of x against y and its two-sided p."""
    vx, vy = np.var(x, ddof=1) / len(x), np.var(y, ddof=1) / len(y)
    if vx + vy <= 0:
        return 0.0, 1.0
    t = float((np.mean(x) - np.mean(y)) / math.sqrt(vx + vy))
    df = (vx + vy) ** 2 / (vx**2 / (len(x) - 1) + vy**2 / (len(y) - 1))
    return t, 2 * t_sf(abs(t), df)


def spearman(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Rank correlation and its two-sided p."""
    rho = _corr(ranks(x), ranks(y))
    n = len(x)
    if n < 3 or abs(rho) >= 1:
        return rho, 0.0 if n >= 3 else 1.0
    return rho, 2 * t_sf(abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def partial_spearman(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """Rank correlation of x and y with what z explains taken out of both."""
    rz = np.column_stack([np.ones(len(z)), ranks(z)])
    rest = [r - rz @ np.linalg.lstsq(rz, r, rcond=None)[0] for r in (ranks(x), ranks(y))]
    rho, n = _corr(*rest), len(x)
    return rho, 2 * t_sf(abs(rho) * math.sqrt((n - 3) / max(1e-12, 1 - rho * rho)), n - 3)


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    n = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / n if n > 0 else 0.0


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    """q-values; NaN stays NaN and isn't counted."""
    p = np.asarray(p, float)
    q, ok = np.full(len(p), np.nan), np.flatnonzero(~np.isnan(p))
    order = ok[np.argsort(p[ok], kind="stable")]
    n = len(order)
    if n:
        q[order] = np.minimum(1, np.minimum.accumulate((p[order] * n / np.arange(1, n + 1))[::-1])[::-1])
    return q


def cross_correlation(source: np.ndarray, target: np.ndarray, max_lag: int = 14) -> tuple[int, float, float]:
    """Lag (source ahead: positive) of the strongest correlation, it, and its Fisher-z p."""
    best = (0, 0.0, 1.0)
    n = len(source)
    for lag in range(-max_lag, max_lag + 1):
        a, b = (source[: n - lag], target[lag:]) if lag >= 0 else (source[-lag:], target[: n + lag])
        if len(a) < 5:
            continue
        r = _corr(a, b)
        if abs(r) > abs(best[1]) + 1e-12:
            z = math.atanh(max(-0.999999, min(0.999999, r))) * math.sqrt(max(1, len(a) - 3))
            best = (lag, r, 2 * norm_sf(abs(z)))
    return best


def diff_in_diff(target: np.ndarray, peak: int, before: int = 14, after: int = 28) -> tuple[float, float]:
    """Mean from the peak on less the mean before it, and Welch's p; NaN without two rows on both sides."""
    pre, post = target[max(0, peak - before) : peak], target[peak : peak + after + 1]
    if len(pre) < 2 or len(post) < 2:
        return float("nan"), float("nan")
    return float(post.mean() - pre.mean()), welch(post, pre)[1]


def circular_shift_p(statistic, target: np.ndarray, n: int = 200, seed: int = 42) -> float:
    """Share of circular shifts of the target on which the statistic's size reaches the observed one."""
    rng = np.random.default_rng(seed)
    seen = abs(statistic(target))
    hits = sum(abs(statistic(np.roll(target, int(s)))) >= seen for s in rng.integers(1, len(target), n))
    return (hits + 1) / (n + 1)


# --- regression -------------------------------------------------------------------


class Fit(NamedTuple):
    beta: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    r2: float
    resid: np.ndarray
    cov: np.ndarray | None = None


def ols(y: np.ndarray, x: np.ndarray, cov: str = "plain", lags: int | None = None) -> Fit:
    """Least squares with plain, HC1 or Newey-West ("hac": Bartlett weights) errors."""
    n, k = x.shape
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ (x.T @ y)
    e = y - x @ beta
    if cov == "plain":
        v = inv * float(e @ e) / max(1, n - k)
    else:
        xe = x * e[:, None]
        s = xe.T @ xe
        if cov == "hac":
            m = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
            for j in range(1, min(m, n - 1) + 1):
                g = xe[j:].T @ xe[:-j]
                s += (1 - j / (m + 1)) * (g + g.T)
        else:
            s *= n / max(1, n - k)
        v = inv @ s @ inv
    se = np.sqrt(np.maximum(np.diag(v), 0))
    t = np.divide(beta, se, out=np.zeros(k), where=se > 0)
    p = np.array([2 * (norm_sf(abs(z)) if cov == "hac" else t_sf(abs(z), max(1, n - k))) for z in t])
    total = float(((y - y.mean()) ** 2).sum())
    return Fit(beta, se, t, p, 1 - float(e @ e) / total if total > 0 else 0.0, e, v)


def wald(fit: Fit, columns: np.ndarray, df: int) -> float:
    """One-sided p that the sum of some coefficients has the sign that it has."""
    if fit.cov is None:
        return 1.0
    var = float(fit.cov[np.ix_(columns, columns)].sum())
    return t_sf(abs(float(fit.beta[columns].sum())) / math.sqrt(var), max(1, df)) if var > 0 else 1.0


def logit(y: np.ndarray, x: np.ndarray, rounds: int = 50) -> Fit:
    """Logistic regression by reweighted least squares."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (mu * (1 - mu))[:, None]) + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - mu))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    return Fit(b, se, b / se, np.array([2 * norm_sf(abs(z)) for z in b / se]), float("nan"), y - mu)


def granger(source: np.ndarray, target: np.ndarray, max_lag: int = 7) -> tuple[float, float, int]:
    """Largest F of adding the source's lags to the target's own, its p and lag."""
    best = (0.0, 1.0, 0)
    for k in range(1, max_lag + 1):
        n = len(target) - k
        if n <= 2 * k + 2:
            break
        own = np.column_stack([np.ones(n), *[target[k - j : len(target) - j] for j in range(1, k + 1)]])
        full = np.column_stack([own, *[source[k - j : len(source) - j] for j in range(1, k + 1)]])
        y = target[k:]
        r0, r1 = (float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()) for m in (own, full))
        f = ((r0 - r1) / k) / (r1 / (n - 2 * k - 1)) if r1 > 1e-12 else 0.0
        p = f_sf(f, k, n - 2 * k - 1)
        if p < best[1]:
            best = (f, p, k)
    return best


def ar_order(y: np.ndarray, most: int = 5) -> int:
    """Order of the autoregression, 1 to ``most``, of the smallest BIC on one common sample."""
    n, best = len(y) - most, (math.inf, 1)
    for p in range(1, most + 1):
        x = np.column_stack([np.ones(n), *[y[most - j : len(y) - j] for j in range(1, p + 1)]])
        e = y[most:] - x @ np.linalg.lstsq(x, y[most:], rcond=None)[0]
        bic = n * math.log(max(float(e @ e) / n, 1e-300)) + (p + 1) * math.log(n)
        best = min(best, (bic, p))
    return best[1]


def ar_columns(y: np.ndarray, p: int) -> np.ndarray:
    return np.column_stack([np.concatenate([np.zeros(k), y[: len(y) - k]]) for k in range(1, p + 1)])


def lagged(x: np.ndarray, lags: int) -> np.ndarray:
    """The columns of x at lags 0 to ``lags``, zero before the start."""
    return np.column_stack([np.concatenate([np.zeros((k, x.shape[1])), x[: len(x) - k]]) for k in range(lags + 1)])


def _descend(g: np.ndarray, c: np.ndarray, alpha: float, ratio: float, beta: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Coordinate descent for the elastic net on a Gram matrix g and correlations c."""
    b, l1, l2 = beta.copy(), alpha * ratio, alpha * (1 - ratio)
    r = c - g @ b
    d = np.diag(g)
    for _ in range(rounds):
        most = 0.0
        for j in range(len(b)):
            if d[j] <= 1e-12:
                continue
            z = r[j] + d[j] * b[j]
            new = (z - l1 if z > l1 else z + l1 if z < -l1 else 0.0) / (d[j] + l2)
            if new != b[j]:
                r -= g[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]))
                b[j] = new
        if most < 1e-6:
            break
    return b


def elastic_net(y: np.ndarray, x: np.ndarray, alpha: float, ratio: float = 0.5, beta: np.ndarray | None = None) -> np.ndarray:
    """Coefficients for centred data: mean squared error / 2 + alpha (ratio |b| + (1 - ratio) b^2 / 2)."""
    n = len(y)
    return _descend(x.T @ x / n, x.T @ y / n, alpha, ratio, np.zeros(x.shape[1]) if beta is None else beta)


def _standard(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1)


def calibrate(y: np.ndarray, x: np.ndarray, n_alphas: int = 50, eps: float = 1e-3) -> tuple[float, float]:
    """Penalty and mixing of the least error over contiguous folds, along a warm-started path for each mixing."""
    n, k = x.shape
    ratios = (0.7, 0.9, 0.95, 0.99) if k > n else (0.5, 0.7, 0.9, 0.95)
    folds = np.array_split(np.arange(n), min(5, max(3, n // 5)))
    parts = []
    for part in folds:
        train = np.setdiff1d(np.arange(n), part)
        mx, my = x[train].mean(0), y[train].mean()
        xt, yt = x[train] - mx, y[train] - my
        parts.append((xt.T @ xt / len(train), xt.T @ yt / len(train), x[part] - mx, y[part] - my))
    best = (math.inf, 0.0, ratios[0])
    for ratio in ratios:
        top = max(float(np.abs(x.T @ (y - y.mean())).max()) / n / ratio, 1e-10)
        path = np.geomspace(top, top * eps, n_alphas)
        errors = np.zeros(n_alphas)
        for g, c, xv, yv in parts:
            b = np.zeros(k)
            for i, a in enumerate(path):
                b = _descend(g, c, a, ratio, b, 200)
                errors[i] += float(((yv - xv @ b) ** 2).mean())
        i = int(errors.argmin())
        best = min(best, (float(errors[i]), float(path[i]), ratio))
    return best[1], best[2]


def stability_selection(y: np.ndarray, x: np.ndarray, controls: int = 0, samples: int = 100, share: float = 0.5, threshold: float = 0.6, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """How often each column is selected on half-samples at half the calibrated penalty, and which are ``threshold`` often.

    The last ``controls`` columns take part, but are not reported.
    """
    alpha, ratio = calibrate(y, _standard(x))
    rng, k = np.random.default_rng(seed), x.shape[1] - controls
    n_sub, hits = max(int(len(y) * share), min(10, len(y))), np.zeros(k)
    for _ in range(samples):
        at = rng.choice(len(y), n_sub, replace=False)
        ys = y[at] - y[at].mean()
        hits += np.abs(elastic_net(ys, _standard(x[at]), alpha / 2, ratio)[:k]) > 1e-10
    return hits / samples, hits / samples >= threshold


def bootstrap_sums(y: np.ndarray, x: np.ndarray, columns: list[np.ndarray], n: int = 500, seed: int = 42) -> np.ndarray:
    """(n, groups): sums of the coefficients of some column groups over residual bootstraps."""
    fit = ols(y, x)
    rng, inv = np.random.default_rng(seed), np.linalg.pinv(x.T @ x) @ x.T
    fitted = y - fit.resid
    e = fit.resid - fit.resid.mean()
    b = inv @ (fitted[:, None] + rng.choice(e, (len(y), n)))
    return np.column_stack([b[c].sum(0) for c in columns])


def local_projection(target: np.ndarray, shock: np.ndarray, horizons: int, ar: int = 5, mask: np.ndarray | None = None) -> list[tuple[int, float, float, float]]:
    """(h, response, error, p) of the target's change h rows after a shock, with its own lags as controls, HAC errors."""
    out = []
    for h in range(horizons + 1):
        t = np.arange(ar, len(target) - h)
        t = t[mask[t]] if mask is not None else t
        if len(t) < ar + 10:
            break
        x = np.column_stack([shock[t], np.ones(len(t)), *[target[t - k] for k in range(1, ar + 1)]])
        fit = ols(target[t + h], x, "hac", max(h, 1))
        out.append((h, float(fit.beta[0]), float(fit.se[0]), float(fit.p[0])))
    return out


# --- information ------------------------------------------------------------------


def bins(x: np.ndarray, n: int = 5) -> np.ndarray:
    """Equal-width bins; one bin for a flat series."""
    low, high = float(np.min(x)), float(np.max(x))
    return np.zeros(len(x), int) if high <= low else np.minimum(((x - low) / (high - low) * n).astype(int), n - 1)


def joint_entropy(*columns: np.ndarray) -> float:
    """Bits of the joint distribution of columns of classes."""
    n = len(columns[0])
    if n <= 64:  # too short for array calls to pay
        return -sum(c / n * math.log2(c / n) for c in Counter(zip(*(x.tolist() for x in columns))).values())
    p = np.unique(np.stack(columns), axis=1, return_counts=True)[1] / n
    return float(-(p * np.log2(p)).sum())


def mutual_information(x: np.ndarray, y: np.ndarray) -> float:
    return joint_entropy(x) + joint_entropy(y) - joint_entropy(x, y)


def transfer_entropy(source: np.ndarray, target: np.ndarray, lag: int = 1) -> float:
    """What the source's past says of the target beyond the target's own past, in bits."""
    now, past, other = target[lag:], target[:-lag], source[:-lag]
    return joint_entropy(now, past) - joint_entropy(past) - joint_entropy(now, past, other) + joint_entropy(past, other)


# --- series -----------------------------------------------------------------------


def weighted_percentile(values: np.ndarray, weights: np.ndarray, p: float) -> float:
    """Interpolated between the midpoints of the sorted values' weights; NaN without weight."""
    order = np.argsort(values, kind="stable")
    v, w = np.asarray(values, float)[order], np.asarray(weights, float)[order]
    v, w = v[w > 0], w[w > 0]
    return float(np.interp(p, (np.cumsum(w) - w / 2) / w.sum(), v)) if len(v) else float("nan")


def median_gap(x: np.ndarray, direct: int = 2048) -> float:
    """Median of the squared differences of all pairs.

    Up to ``direct`` values it is taken over the pairs; beyond, the middle differences
    are found by bisection over the sorted values, in memory of their number.
    """
    n = len(x)
    if n <= direct:
        return float(np.median(((x[:, None] - x[None, :]) ** 2)[np.triu_indices(n, 1)]))
    v, pairs = np.sort(x), n * (n - 1) // 2
    above = np.arange(1, n + 1)

    def smallest(k: int) -> float:
        """The k-th smallest difference, from 1."""
        low, high = 0.0, float(v[-1] - v[0])
        if int((np.searchsorted(v, v, "right") - above).sum()) >= k:
            return 0.0
        for _ in range(200):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (low, mid) if int((np.searchsorted(v, v + mid, "right") - above).sum()) >= k else (mid, high)
        return high

    middle = {smallest((pairs + 1) // 2), smallest(pairs // 2 + 1)}
    return sum(m * m for m in middle) / len(middle)


def pelt(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """Segment ends of the optimal partition under a Gaussian-kernel cost (median bandwidth) and a penalty a segment.

    Every start is tried for every end, so the partition is optimal also where pruning
    would not be safe (segments of a least length); kernel sums run along with the end,
    so that memory grows with the length only.
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < 2 * least:
        return [n]
    med = median_gap(x) or 1.0
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    sums = np.zeros(n)  # of the kernel over pairs of each start's segment so far
    for b in range(1, n + 1):
        k = np.exp(-np.clip((x[: b - 1] - x[b - 1]) ** 2 / med, 1e-2, 100))
        sums[: b - 1] += 2 * np.cumsum(k[::-1])[::-1]
        sums[:b] += 1
        if b < least:
            continue
        size = b - np.arange(b - least + 1)
        value = best[: b - least + 1] + size - sums[: b - least + 1] / size + penalty
        last[b] = int(value.argmin())
        best[b] = float(value[last[b]])
    ends, b = [], n
    while b > 0:
        ends.append(b)
        b = int(last[b])
    return ends[::-1]


def peaks(x: np.ndarray, prominence: float, distance: int = 7) -> list[int]:
    """Local maxima of a least prominence, the higher first where two are closer than ``distance``."""
    n = len(x)
    at = [i for i in range(1, n - 1) if x[i] > x[i - 1] and x[i] >= x[i + 1]]
    keep: list[int] = []
    for i in sorted(at, key=lambda i: (-x[i], i)):
        left = x[:i][::-1]
        right = x[i + 1 :]
        stop = lambda s: s[: int(np.argmax(s > x[i]))] if (s > x[i]).any() else s
        bases = [stop(s).min() if len(stop(s)) else x[i] for s in (left, right)]
        if x[i] - max(bases) >= prominence and all(abs(i - j) >= distance for j in keep):
            keep.append(i)
    return sorted(keep)


def centred_mean(x: np.ndarray, width: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x)])
    i = np.arange(len(x))
    a, b = np.maximum(i - width // 2, 0), np.minimum(i + width // 2 + 1, len(x))
    return (c[b] - c[a]) / (b - a)
