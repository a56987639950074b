"""Scores of paths that grow by one instance at a time.

A greedy walk asks at each node what every successor would make of the path. A path's score is made of sums over its
features and clans, of which an instance changes its own only: the scorers here keep the sums, so that a candidate
costs its feature's instances at most and not the whole path. ``value`` is the score now; ``peek`` that with one more
instance; ``take`` adds it for good.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from ..options import ScoringOptions


def tool_prefix(feature: str) -> str:
    prefix = feature.split("_", 1)[0]
    return "coils2" if prefix == "coils" else prefix


def by_feature(elements: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for e in elements:
        out.setdefault(e["feature"], []).append(e)
    return out


def clan_tally(elements: list[dict]) -> dict[str, int]:
    out: dict[str, int] = {}
    for e in elements:
        if e["clan"] is not None:
            out[e["clan"]] = out.get(e["clan"], 0) + 1
    return out


def closeness(positions: list[float], position: float) -> float:
    """1 less the distance to the nearest of the sorted ``positions``, 0 at least."""
    at = bisect_left(positions, position)
    near = [abs(position - positions[k]) for k in (at - 1, at) if 0 <= k < len(positions)]
    return max(1.0 - min(near), 0.0) if near else 0.0


class _Growing:
    def peek(self, e: dict) -> float:
        undo = self._add(e)
        value = self.value()
        self._restore(undo)
        return value

    def take(self, e: dict) -> None:
        self._add(e)

    def _add(self, e: dict) -> tuple:
        raise NotImplementedError

    def _restore(self, undo: tuple) -> None:
        raise NotImplementedError

    def value(self) -> float:
        raise NotImplementedError


class SeedPath(_Growing):
    """The final score of a seed path against a fixed query path, by similarity or by distance.

    Sums are kept for each constrained tool apart (its weights may be scaled up as a whole) and for all others:
    weights, weighted shares, weighted closeness, and the weights of all instances.
    """

    def __init__(self, normal: list[dict], query_lin: list[dict], query_normal: list[dict], weights: dict | None, o: ScoringOptions, distance: bool):
        self.o, self.distance = o, distance
        query = by_feature(query_lin + query_normal)
        self.n_query = {f: len(es) for f, es in query.items()}
        self.positions = {f: sorted(e["position"] for e in es) for f, es in query.items()}
        self.query_clans = clan_tally(query_lin)
        self.uniform = weights is None and not distance
        self.weights, self.default = weights or {}, o.distance_default if distance else 1.0
        self.limits = o.constraints if o.constraints and weights is not None and not distance else {}
        self.features: dict[str, tuple[int, float]] = {}  # instances, sum of their closeness
        self.sums: dict[str | None, tuple[float, float, float, float]] = {}
        self.clans: dict[str, int] = {}
        for e in normal:
            self._count(e)

    def _group(self, e: dict) -> str | None:
        tool = tool_prefix(e["feature"])
        return tool if e["linearized"] and tool in self.limits and e["feature"] not in self.limits else None

    def _parts(self, feature: str, n: int, near: float, w: float) -> tuple[float, float, float, float]:
        return (w, w * min(self.n_query.get(feature, 0) / n, 1.0), w * near / n, w * n) if n else (0.0, 0.0, 0.0, 0.0)

    def _count(self, e: dict) -> tuple:
        f, group = e["feature"], self._group(e)
        n, near = self.features.get(f, (0, 0.0))
        w = 1.0 if self.uniform else self.weights.get(f, self.default)
        sums = self.sums.get(group, (0.0, 0.0, 0.0, 0.0))
        more = near + closeness(self.positions.get(f, []), e["position"])
        self.features[f] = (n + 1, more)
        self.sums[group] = tuple(s - a + b for s, a, b in zip(sums, self._parts(f, n, near, w), self._parts(f, n + 1, more, w), strict=True))
        return f, (n, near), group, sums

    def _add(self, e: dict) -> tuple:
        clan = e["clan"]
        if clan is not None:
            self.clans[clan] = self.clans.get(clan, 0) + 1
        return (clan, *self._count(e))

    def _restore(self, undo: tuple) -> None:
        clan, f, feature, group, sums = undo
        if clan is not None:
            self.clans[clan] -= 1
            if not self.clans[clan]:
                del self.clans[clan]
        if feature[0]:
            self.features[f] = feature
        else:
            del self.features[f]
        self.sums[group] = sums

    def value(self) -> float:
        weight = share = near = 0.0
        for group, (w, a, p, each) in self.sums.items():
            limit = self.limits.get(group)
            factor = limit / each if limit is not None and 0 < each < limit else 1.0
            weight, share, near = weight + w * factor, share + a * factor, near + p * factor
        if self.distance:
            scale = 1 / weight if weight > 1 else 1.0
            ms, ps = 1.0 + (share - weight) * scale, 1.0 + (near - weight) * scale
        else:
            scale = 1 / weight if weight > 0 else 0.0
            ms, ps = share * scale, near * scale
        return combined(ms, clan_score(self.clans, self.query_clans, self.distance), ps, self.o, not self.distance and not self.features and not self.n_query)


class QueryPath(_Growing):
    """A query path against the whole seed by similarity: uniform weights, its clans against all of the query's own."""

    def __init__(self, seed: list[dict], query_clans: dict[str, int], o: ScoringOptions):
        self.o, self.query_clans = o, query_clans
        seeds = by_feature(seed)
        self.n_seed = {f: len(es) for f, es in seeds.items()}
        self.positions = {f: sorted(e["position"] for e in es) for f, es in seeds.items()}
        self.features: dict[str, tuple[int, float]] = {}
        self.share = self.near = 0.0
        self.clans: dict[str, int] = {}

    def _parts(self, f: str, n: int, near: float) -> tuple[float, float]:
        return (min(self.n_seed.get(f, 0) / n, 1.0), near / n) if n else (0.0, 0.0)

    def _add(self, e: dict) -> tuple:
        f, clan = e["feature"], e["clan"]
        n, near = self.features.get(f, (0, 0.0))
        undo = clan, f, (n, near), self.share, self.near
        more = near + closeness(self.positions.get(f, []), e["position"])
        (a, p), (b, q) = self._parts(f, n, near), self._parts(f, n + 1, more)
        self.share, self.near = self.share - a + b, self.near - p + q
        self.features[f] = (n + 1, more)
        if clan is not None:
            self.clans[clan] = self.clans.get(clan, 0) + 1
        return undo

    def _restore(self, undo: tuple) -> None:
        clan, f, feature, self.share, self.near = undo
        if feature[0]:
            self.features[f] = feature
        else:
            del self.features[f]
        if clan is not None:
            self.clans[clan] -= 1
            if not self.clans[clan]:
                del self.clans[clan]

    def value(self) -> float:
        n = len(self.features)
        ms, ps = (self.share / n, self.near / n) if n else (0.0, 0.0)
        return ms * self.o.weight_multiplicity + clan_score(self.clans, self.query_clans, False) * self.o.weight_clan + ps * self.o.weight_position


class QueryPathByDistance(_Growing):
    """The final distance score of the whole seed against a query path, with the weights of the weight file. The path
    stands alone, without the query's features that may overlap; an instance changes the closeness of its feature's
    seed instances."""

    def __init__(self, seed_lin: list[dict], seed_normal: list[dict], weights: dict | None, o: ScoringOptions):
        self.o = o
        seeds = by_feature(seed_lin + seed_normal)
        self.positions = {f: np.array([e["position"] for e in es]) for f, es in seeds.items()}
        self.weight = {f: (weights or {}).get(f, o.distance_default) for f in seeds}
        total = sum(self.weight.values())
        self.scale = 1 / total if total > 1 else 1.0
        self.total = total
        self.seed_clans = clan_tally(seed_lin)
        self.near = {f: np.zeros(len(es)) for f, es in seeds.items()}
        self.count: dict[str, int] = {}
        self.share_sum = self.near_sum = 0.0
        self.clans: dict[str, int] = {}

    def _add(self, e: dict) -> tuple:
        f, clan = e["feature"], e["clan"]
        undo = clan, f, self.near.get(f), self.count.get(f, 0), self.share_sum, self.near_sum
        if f in self.near:
            n, k, w = len(self.positions[f]), undo[3], self.weight[f]
            now = np.maximum(undo[2], 1.0 - np.abs(self.positions[f] - e["position"]))
            self.share_sum += w * (min((k + 1) / n, 1.0) - min(k / n, 1.0))
            self.near_sum += w * float(now.sum() - undo[2].sum()) / n
            self.near[f] = now
        self.count[f] = undo[3] + 1
        if clan is not None:
            self.clans[clan] = self.clans.get(clan, 0) + 1
        return undo

    def _restore(self, undo: tuple) -> None:
        clan, f, near, self.count[f], self.share_sum, self.near_sum = undo
        if near is not None:
            self.near[f] = near
        if clan is not None:
            self.clans[clan] -= 1
            if not self.clans[clan]:
                del self.clans[clan]

    def value(self) -> float:
        ms, ps = (1.0 + (x - self.total) * self.scale for x in (self.share_sum, self.near_sum))
        return combined(ms, clan_score(self.seed_clans, self.clans, True), ps, self.o, False)


def clan_score(seed: dict[str, int], query: dict[str, int], distance: bool) -> float:
    """The clans of one side against those of the other; nothing without a clan of the first."""
    if not seed:
        return 0.0
    shared = [(n, query[c]) for c, n in seed.items() if c in query]
    if distance:
        return 1.0 - sum(1.0 - min(q / n, 1.0) for n, q in shared) / len(seed)
    return sum(n * q / max(n, q) ** 2 for n, q in shared) / len(seed)


def combined(ms: float, cs: float, ps: float, o: ScoringOptions, empty: bool) -> float:
    if o.digits is not None:
        ms, cs, ps = (round(x, o.digits) for x in (ms, cs, ps))
    if empty and o.empty_as_1:
        ms = cs = ps = 1.0
    return ms * o.weight_multiplicity + cs * o.weight_clan + ps * o.weight_position
