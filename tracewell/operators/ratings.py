"""Ratings from pairwise comparisons, active choice of pairs, and small tournaments.

Ratings of an item's parts depend on the order of its matches, so each item is
fitted by one function; items are independent and spread over the cluster.
Start values and scale are the usual ones of public Weng-Lin implementations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MU, SIGMA = 25.0, 25.0 / 3
BETA, KAPPA = SIGMA / 2, 1e-4


def update(mu: np.ndarray, sigma: np.ndarray, left: int, right: int, outcome: str) -> None:
    """One Plackett-Luce update of two players; outcome is a, b or tie."""
    variance = sigma[[left, right]] ** 2
    c = math.sqrt(variance.sum() + 2 * BETA**2)
    strength = np.exp(mu[[left, right]] / c)
    ranks = {"a": (0, 1), "b": (1, 0), "tie": (0, 0)}[outcome]
    for i, player in enumerate((left, right)):
        gain, shrink = 0.0, 0.0
        for q in (0, 1):
            if ranks[q] > ranks[i]:
                continue
            pool = sum(strength[s] for s in (0, 1) if ranks[s] >= ranks[q])
            tied = sum(ranks[s] == ranks[q] for s in (0, 1))
            share = strength[i] / pool
            gain += ((1 - share) if q == i else -share) / tied
            shrink += share * (1 - share) / tied
        gamma = math.sqrt(variance[i]) / c
        mu[player] += variance[i] / c * gain
        sigma[player] *= math.sqrt(max(1 - variance[i] / c**2 * gamma * shrink, KAPPA))


def fit(n: int, matches: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean-centred ratings and their deviations: matches played forward and backward, averaged; zeros below two items or without matches."""
    if n < 2 or not matches:
        return np.zeros(n), np.full(n, SIGMA)
    runs = []
    for order in (matches, matches[::-1]):
        mu, sigma = np.full(n, MU), np.full(n, SIGMA)
        for left, right, outcome in order:
            update(mu, sigma, left, right, outcome)
        runs.append((mu, sigma))
    mu, sigma = (runs[0][0] + runs[1][0]) / 2, (runs[0][1] + runs[1][1]) / 2
    return mu - mu.mean(), sigma


def outcome_probabilities(mu: np.ndarray, sigma: np.ndarray, a: int, b: int) -> tuple[float, float, float]:
    """Win, loss and draw of two players by the normal model; the draw margin is that of two players."""
    normal = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    spread = math.sqrt(2 * BETA**2 + sigma[a] ** 2 + sigma[b] ** 2)
    margin = math.sqrt(2) * BETA * 0.6744897501960817 * 0.5
    win, loss = normal((mu[a] - mu[b] - margin) / spread), normal((mu[b] - mu[a] - margin) / spread)
    return win, loss, max(0.0, 1 - win - loss)


def next_pair(n: int, matches: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """The pair not yet compared whose outcome is most uncertain; the first in order on ties."""
    mu, sigma = fit(n, matches)
    seen = {frozenset(m[:2]) for m in matches}
    best, most = None, -1.0
    for a in range(n):
        for b in range(a + 1, n):
            if frozenset((a, b)) in seen:
                continue
            entropy = -sum(p * math.log(p) for p in outcome_probabilities(mu, sigma, a, b) if p > 0)
            if entropy > most + 1e-12:
                best, most = (a, b), entropy
    return best


def longer(a: str, b: str) -> str:
    """A judge that needs no model: the longer text is the more detailed one."""
    return "a" if len(a) > len(b) else "b" if len(b) > len(a) else "tie"


def compare(judge: Callable[[str, str], str], left: str, right: str) -> str:
    """Outcome of a judge asked in both presentation orders; a tie unless both agree."""
    first, second = judge(left, right), judge(right, left)
    return first if second == {"a": "b", "b": "a"}.get(first) else "tie"


def tournament(chunks: list[str], judge: Callable[[str, str], str], budget: int, batch: int = 5) -> list[tuple[int, int, str]]:
    """Consecutive pairs first, then the most uncertain pairs in batches up to a budget of comparisons."""
    n = len(chunks)
    matches = [(i, i + 1, compare(judge, chunks[i], chunks[i + 1])) for i in range(min(n - 1, budget))]
    while len(matches) < budget:
        chosen: list[tuple[int, int]] = []
        for _ in range(min(batch, budget - len(matches))):
            pair = next_pair(n, matches + [(a, b, "tie") for a, b in chosen])
            if pair is None:
                break
            chosen.append(pair)
        if not chosen:
            break
        matches += [(a, b, compare(judge, chunks[a], chunks[b])) for a, b in chosen]
    return matches


def rate_matches(matches: DataFrame, key: str = "item_id", order: str = "seq") -> DataFrame:
    """item, part, mu and sigma from rows (key, seq, left, right, outcome, n_parts)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        n = int(frame["n_parts"].iloc[0])
        mu, sigma = fit(n, list(zip(frame["left"], frame["right"], frame["outcome"], strict=True)))
        return pd.DataFrame({key: frame[key].iloc[0], "part": range(n), "mu": mu, "sigma": sigma})

    kind = dict(matches.dtypes)[key]
    return matches.groupBy(key).applyInPandas(run, f"{key} {kind}, part bigint, mu double, sigma double")


def run_tournaments(chunks: DataFrame, judge: Callable[[str, str], str], budget: int, key: str, order: str, text: str) -> DataFrame:
    """Matches of every item's chunks: key, seq, left, right, outcome, n_parts.  Items must be of moderate size: pairs are compared within one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = frame.sort_values(order)[text].fillna("").tolist()
        played = tournament(parts, judge, budget)
        return pd.DataFrame({key: frame[key].iloc[0], "seq": range(len(played)), "left": [m[0] for m in played], "right": [m[1] for m in played], "outcome": [m[2] for m in played], "n_parts": len(parts)})

    kind = dict(chunks.dtypes)[key]
    return chunks.groupBy(key).applyInPandas(run, f"{key} {kind}, seq bigint, left bigint, right bigint, outcome string, n_parts bigint")
