"""Which of several groups dominate a window: 13 metrics in four families, and a vote on the set."""

from __future__ import annotations

import numpy as np

from . import stats

FAMILIES = {
    "information": ("mutual_information", "entropy_reduction", "information_content"),
    "network": ("pagerank", "pagerank_stability", "eigenvector", "eigenvector_stability"),
    "causality": ("granger", "transfer_entropy"),
    "proportional": ("mean_proportion", "elevation", "consistency", "percentile_rank"),
}


def _ranked(a: np.ndarray, damping: float = 0.85) -> tuple[np.ndarray, np.ndarray]:
    """PageRank and eigenvector centrality of each of a stack of weighted matrices without a diagonal."""
    k, n, _ = a.shape
    out = a.sum(2, keepdims=True)
    move = np.divide(a, out, out=np.full(a.shape, 1 / n), where=out > 0)
    r = np.full((k, 1, n), 1 / n)
    for _ in range(100):
        r = damping * (r @ move) + (1 - damping) / n
    v = np.ones((k, n, 1))
    for _ in range(200):
        v = a @ v + 1e-12
        v /= np.sqrt((v * v).sum(1, keepdims=True))
    return r[:, 0], v[:, :, 0]


def _network(x: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """Groups are linked where both are above their medians at once; stability over windows that move along."""
    high = (x > np.median(x, axis=0)).astype(float)
    parts = [high, *(high[i : i + window] for i in range(max(1, len(x) - window + 1)))]
    a = np.stack([h.T @ h for h in parts])
    a[:, np.arange(x.shape[1]), np.arange(x.shape[1])] = 0
    page, eigen = _ranked(a)
    return {"pagerank": page[0], "pagerank_stability": 1 / (1 + page[1:].std(0)), "eigenvector": eigen[0], "eigenvector_stability": 1 / (1 + eigen[1:].std(0))}


def metrics(x: np.ndarray) -> dict[str, np.ndarray]:
    """The 13 metrics of a (weeks, groups) matrix of proportions, one value a group each."""
    n, k = x.shape
    cut = min(10, max(3, int(np.sqrt(n))))
    b = np.stack([stats.bins(x[:, j], cut) for j in range(k)], axis=1)
    others = [[i for i in range(k) if i != j] for j in range(k)]
    h = np.array([stats.joint_entropy(b[:, j]) for j in range(k)])
    total = stats.joint_entropy(*b.T)
    lag = 1 if n < 10 else 2 if n < 20 else 3 if n < 40 else 4
    out = {
        "mutual_information": np.array([np.mean([stats.mutual_information(b[:, j], b[:, i]) for i in others[j]]) for j in range(k)]),
        "entropy_reduction": np.array([total - (total - h[j]) for j in range(k)]) - np.array([stats.joint_entropy(*b.T) - stats.joint_entropy(*b[:, others[j]].T) for j in range(k)]),
        "information_content": -np.log2(np.maximum(x.mean(0), 1e-12)) * x.mean(0),
        **_network(x),
        "granger": np.array([np.mean([1 - stats.granger(x[:, j], x[:, i], lag)[1] for i in others[j]]) for j in range(k)]),
        "transfer_entropy": np.array([np.mean([stats.transfer_entropy(b[:, j], b[:, i]) for i in others[j]]) for j in range(k)]),
    }
    mean, mid = x.mean(0), float(np.median(np.median(x, axis=0)))
    sd = x.std(0, ddof=1) if n > 1 else np.zeros(k)
    out["mean_proportion"] = mean
    out["elevation"] = np.maximum(0, (mean - mid) / mid) if mid > 0 else np.zeros(k)
    out["consistency"] = 1 / (1 + np.divide(sd, mean, out=np.zeros(k), where=mean > 0))
    out["percentile_rank"] = np.array([((mean < m).mean() + (mean <= m).mean()) / 2 for m in mean])
    return out


def scores(x: np.ndarray) -> np.ndarray:
    """Mean of the four families' scores; a family's is the mean of its metrics, each from 0 to 1 (0.5 if all are equal)."""
    m = metrics(x)

    def scaled(v: np.ndarray) -> np.ndarray:
        span = v.max() - v.min()
        return (v - v.min()) / span if span > 0 else np.full(len(v), 0.5)

    return np.mean([np.mean([scaled(m[name]) for name in names], axis=0) for names in FAMILIES.values()], axis=0)


def _elbow(s: np.ndarray) -> set[int]:
    """Those before the point of the sorted scores that is farthest below the line from first to last."""
    order = np.argsort(-s, kind="stable")
    y = s[order]
    if len(y) < 3 or y[0] == y[-1]:
        return set(order.tolist())
    line = y[0] + (y[-1] - y[0]) * np.arange(len(y)) / (len(y) - 1)
    return set(order[: max(1, int(np.argmax(line - y)))].tolist())


def dominant(s: np.ndarray) -> list[int]:
    """Groups that three of four criteria pick, best first: the median, the largest gap, the elbow, mean + half a deviation."""
    order = np.argsort(-s, kind="stable")
    gap = int(np.argmax(np.abs(np.diff(s[order])))) + 1 if len(s) > 1 else 1
    broken = [int(i) for i in order[: gap + 1]] if gap < len(s) else order.tolist()
    votes = [set(np.flatnonzero(s > np.median(s)).tolist()), set(broken), _elbow(s), set(np.flatnonzero(s >= s.mean() + 0.5 * s.std(ddof=1)).tolist() if len(s) > 1 else [0])]
    picked = [int(i) for i in order if sum(int(i) in v for v in votes) >= 3]
    return picked[:1] or [int(order[0])] if not picked else picked if len(picked) <= 6 else broken[:6]


KINDS = {1: "single", 2: "dual", 3: "triple"}


def kind(n: int) -> str:
    return KINDS.get(n, "multi")
