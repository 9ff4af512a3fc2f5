"""Leaves of one feature from its statistics; no data is read here."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from lumenstep.operators import splits
from lumenstep.operators.params import StepParams
from lumenstep.operators.stats import FeatureStats, candidates


@dataclass(frozen=True)
class Node:
    """A leaf (lower, upper], a category, or the null node of a feature."""

    feature: str
    kind: str
    node_id: int
    lower: float | None
    upper: float | None
    category: str | None
    is_null: bool
    score: float
    mean: float
    freq: float
    raw: float


def _raw(mean: float, freq: float, base: float, params: StepParams, regression: bool) -> float:
    d = mean - base
    return math.copysign(abs(d) ** params.tail_sensitivity, d) if regression else params.activation(freq * 100) * d


def _numeric(f: FeatureStats, n: int, base: float, p: StepParams, alpha: float) -> list[splits.Leaf]:
    """(lower, upper, count, sum) of the leaves, ascending.

    Gains use the feature's base and row count at every depth; the smallest split wins a tie.
    """
    split, count, total = candidates(f, alpha)
    least = max(1, int(p.min_leaf_size * n))
    leaves: list[splits.Leaf] = []

    def visit(lo: int, hi: int, lower: float, upper: float, c0: float, s0: float, c1: float, s1: float, depth: int) -> None:
        if depth < p.max_depth and lo < hi:
            gain = splits.gains(count[lo:hi], total[lo:hi], (c0, s0), (c1, s1), n, base, least, p.min_info_gain)
            at = int(np.argmax(gain))
            if gain[at] > 0:
                i = lo + at
                cut, c, s = float(split[i]), float(count[i]), float(total[i])
                visit(lo, i, lower, cut, c0, s0, c, s, depth + 1)
                visit(i + 1, hi, cut, upper, c, s, c1, s1, depth + 1)
                return
        leaves.append((lower, upper, c1 - c0, s1 - s0))

    visit(0, len(split), -math.inf, math.inf, 0, 0.0, float(f.count.sum()), float(f.total.sum()), 0)
    return leaves


def wide_leaves(stats: dict[str, FeatureStats], n: int, base: float, params: Callable[[str], StepParams], alpha: float) -> dict[str, list[splits.Leaf]]:
    """Leaves of the features whose values stay distributed, all grown together."""
    wide = {k: f for k, f in stats.items() if f.kind == "numeric" and f.wide is not None}
    if gone := [k for k, f in wide.items() if isinstance(f.wide, str)]:
        raise ValueError(f"values of {gone} are not saved with a model; fit again")
    return splits.grow({k: (f.wide, params(k).resolved(base), float(f.count.sum()), float(f.total.sum())) for k, f in wide.items()}, n, base, alpha)


def nodes(name: str, f: FeatureStats, n: int, base: float, params: StepParams, alpha: float = 0.1, regression: bool = False, grown: list[splits.Leaf] | None = None) -> list[Node]:
    """Leaves or categories (by mean, then name), the null node last; scores are still 0.

    grown: the leaves of a feature whose values stay distributed (else they are grown here).
    """
    p, out = params.resolved(base), []
    if f.kind == "numeric":
        leaves = _numeric(f, n, base, p, alpha) if f.wide is None else grown or wide_leaves({name: f}, n, base, lambda _: params, alpha)[name]
        for lower, upper, c, s in leaves:
            mean, freq = (s / c if c else base), c / n
            out.append(Node(name, f.kind, len(out), lower, upper, None, False, 0.0, mean, freq, _raw(mean, freq, base, p, regression) if c else 0.0))
    else:
        for mean, value, c in sorted((float(s / c), str(v), float(c)) for v, c, s in zip(f.values, f.count, f.total)):
            out.append(Node(name, f.kind, len(out), None, None, value, False, 0.0, mean, c / n, _raw(mean, c / n, base, p, regression)))
    c, mean = f.null_count, f.null_total / f.null_count if f.null_count else 0.0
    raw = _raw(mean, c / n, base, p, regression) if c else 0.0
    return [*out, Node(name, f.kind, len(out), None, None, None, True, 0.0, mean, c / n, raw)]


def normalised(profile: dict[str, list[Node]], base: float, params: dict[str, StepParams]) -> dict[str, list[Node]]:
    """Scores such that base and all contributions sum to a number in [0, 1]."""
    counted = {k: [x.raw for x in v if not (x.is_null and params[k].ignore_nan)] or [0.0] for k, v in profile.items()}
    low, high = sum(min(r) for r in counted.values()), sum(max(r) for r in counted.values())

    def score(x: Node, p: StepParams) -> float:
        if x.is_null and p.ignore_nan or x.raw == 0:
            return 0.0
        side = low if x.raw < 0 else high
        return 0.0 if side == 0 else abs(x.raw) / side * base if x.raw < 0 else x.raw / side * (1 - base)

    return {k: [replace(x, score=score(x, params[k])) for x in v] for k, v in profile.items()}


def importances(profile: dict[str, list[Node]]) -> dict[str, float]:
    """Share of each feature, ascending: evenness of its leaves times their absolute scores."""
    raw = {k: min(1.0, max(0.0, 1 - sum(x.freq**2 for x in v))) * sum(abs(x.score) for x in v) for k, v in profile.items()}
    whole = sum(raw.values()) or 1.0
    return dict(sorted(((k, v / whole) for k, v in raw.items()), key=lambda kv: (kv[1], kv[0])))
