"""All pairs of paths of many pairs of proteins at once: numpy on the Arrow batches that Spark's joins deal out."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

from ..options import ScoringOptions

#: Scores are compared to so many decimals when the best paths are chosen, so that the order of sums decides nothing.
TIES = 10
#: Instances that are compared at once: arrays of a task stay this long, whatever the proteins.
TOGETHER = 1 << 20


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, as many as its size, one run after the other; and the run that each is of."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + (starts - _before(sizes))[of], of


def _blocks(costs: np.ndarray) -> Iterator[slice]:
    """Neighbours that cost TOGETHER or less, or one that costs more."""
    ends, at = np.cumsum(costs), 0
    while at < len(costs):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")), at + 1)
        yield slice(at, end)
        at = end


def _first_highest(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place of the first highest value of each run of ``sizes``, none of which is 0."""
    starts = _before(sizes)
    at = np.flatnonzero(values == np.repeat(np.maximum.reduceat(values, starts), sizes)) if len(values) else starts
    return at[np.searchsorted(at, starts)]


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """To so many decimals, halves of the shortest decimal away from zero, as Spark rounds."""
    if digits is None:
        return x
    power = 10.0**digits
    scaled = np.abs(x) * power
    out = np.copysign(np.floor(scaled + 0.5) / power, x)
    for k in np.flatnonzero(np.abs(scaled % 1 - 0.5) < 1e-6):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class _Tally:
    """How often each name is met in each view, in the order of its first place there. ``view``, ascending, and
    ``name``: of each member."""

    def __init__(self, view: np.ndarray, name: np.ndarray, names: int, views: int):
        self.names = names
        self.keys, first, inverse, self.counts = np.unique(view * names + name, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.of_member, self.first = rank[inverse], first[order]
        self.view, self.name, self.n = self.keys[order] // names, self.keys[order] % names, self.counts[order]
        self.sizes = np.bincount(self.view, minlength=views)
        self.starts = _before(self.sizes)
        # members by key, in their order within it
        self.members, self.key_starts = np.argsort(inverse, kind="stable"), _before(self.counts)

    def found(self, view: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each name of a view among the keys, and its count there, 0 where it is not met."""
        key = view * self.names + name
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return at, np.where(self.keys[at] == key, self.counts[at], 0) if len(self.keys) else np.zeros(len(key), np.int64)


class _Side:
    """One protein of each row and its views: of each path the instances on it and those that are never resolved;
    without ``paths`` all instances are one view."""

    def __init__(self, rows: pa.StructArray, paths: pa.ListArray | None, features: np.ndarray, n_features: int, clans: np.ndarray, n_clans: int):
        self.feature = features
        self.position = rows.field("position").flatten().to_numpy(zero_copy_only=False)
        self.length = (rows.field("stop").flatten().to_numpy(zero_copy_only=False) - rows.field("start").flatten().to_numpy(zero_copy_only=False)) + 1
        self.size = _sizes(rows.field("feature"))
        if paths is None:
            one = np.arange(len(self.size) + 1, dtype=np.int32)
            paths = pa.ListArray.from_arrays(one, pa.ListArray.from_arrays(one * 0, pa.array([], pa.int32())))
            n_lin = self.size * 0
        else:
            n_lin = _sizes(rows.field("clan"))
        self.start, lin_start = _before(self.size), _before(n_lin)
        self.paths = paths.flatten()
        self.n_views, on = _sizes(paths), _sizes(self.paths)
        self.row = np.repeat(np.arange(len(self.n_views)), self.n_views)
        self.first_view = _before(self.n_views)
        others = (self.size - n_lin)[self.row]
        self.view_size = on + others
        self.view_start = _before(self.view_size)
        ranks, view = self.paths.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(on)), on)
        rest, rest_view = _runs((self.start + n_lin)[self.row], others)
        self.member = np.empty(int(self.view_size.sum()), np.int64)
        self.member[_runs(self.view_start, on)[0]] = self.start[self.row[view]] + ranks
        self.member[_runs(self.view_start + on, others)[0]] = rest
        self.view = np.repeat(np.arange(len(on)), self.view_size)
        self.on_path = self.member - self.start[self.row[self.view]] < n_lin[self.row[self.view]]
        self.features = _Tally(self.view, features[self.member], n_features, len(on))
        clan = clans[lin_start[self.row[view]] + ranks]
        self.clans = _Tally(view[clan >= 0], clan[clan >= 0], n_clans, len(on))


def _codes(*arrays: pa.Array) -> tuple[list[np.ndarray], list[str]]:
    """A number for each of the names, -1 for null, and the names."""
    found = pa.concat_arrays([a.cast(pa.string()) for a in arrays]).dictionary_encode()
    flat = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum([len(a) for a in arrays])[:-1]), found.dictionary.to_pylist()


def _nearest(s: _Side, q: _Side, element: np.ndarray, q_view: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closeness and length ratio of each instance of a seed and the nearest of its feature in a query's view; the
    first one wins ties, none is 0."""
    key, counts = q.features.found(q_view, s.feature[element])
    match, ratio = np.zeros(len(element)), np.zeros(len(element))
    some = np.flatnonzero(counts)
    for block in _blocks(counts[some]):
        item = some[block]
        place, of = _runs(q.features.key_starts[key[item]], counts[item])
        theirs, mine = q.member[q.features.members[place]], element[item]
        close = np.nan_to_num(1.0 - np.abs(s.position[mine][of] - q.position[theirs]), nan=-np.inf)
        at = _first_highest(close, counts[item])
        n, m = s.length[mine], q.length[theirs[at]]
        yes = close[at] > 0
        match[item], ratio[item] = np.where(yes, close[at], 0.0), np.where(yes, np.minimum(n, m) / np.maximum(n, m), 0.0)
    return match, ratio


def _weights(s: _Side, names: list[str], w_map: pa.ListArray | None, map_codes: np.ndarray, options: ScoringOptions, distance: bool, tools: dict[str, str]) -> np.ndarray:
    """The weight of each feature in each of the seeds' views, scaled up to the constraints of its tool."""
    slots, row = s.features, s.row[s.features.view]
    w = np.full(len(slots.view), options.distance_default if distance else 1.0)
    if w_map is None:
        return w
    keys = np.repeat(np.arange(len(w_map)), _sizes(w_map)) * len(names) + map_codes
    values = w_map.flatten().field(1).to_numpy(zero_copy_only=False)
    order = np.argsort(keys)
    if len(keys):
        wanted = row * len(names) + slots.name
        at = order[np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)]
        w = np.where((keys[at] == wanted) & ~np.isnan(values[at]), values[at], w)
    if options.constraints and not distance:
        kinds = sorted(set(tools.values()))
        tool = np.array([kinds.index(tools[f]) for f in names], np.int64)[slots.name]
        limit = np.array([options.constraints.get(k, np.nan) for k in kinds])[tool]
        free = s.on_path[slots.first] & np.array([f not in options.constraints for f in names], bool)[slots.name]
        key = slots.view * len(kinds) + tool
        total = np.bincount(key, np.where(free, w * slots.n, 0.0), len(s.row) * len(kinds))[key]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(free & (total > 0) & (total < limit), w * (limit / total), w)
    return w


def whole_scores(seeds: pa.StructArray, queries: pa.StructArray) -> pa.StructArray:
    """ms, ps, ls of each row's whole seed, which has instances, and query, with uniform weights."""
    (s_codes, q_codes), names = _codes(seeds.field("feature").flatten(), queries.field("feature").flatten())
    none = np.zeros(0, np.int64)
    s, q = (_Side(rows, None, codes, max(len(names), 1), none, 1) for rows, codes in ((seeds, s_codes), (queries, q_codes)))
    near = _nearest(s, q, s.member, s.view)
    slots = s.features
    theirs = q.features.found(slots.view, slots.name)[1]
    parts = [np.minimum(theirs / slots.n, 1.0), *(np.bincount(slots.of_member, x, len(slots.n)) / slots.n for x in near)]
    with np.errstate(invalid="ignore"):
        means = [np.bincount(slots.view, x, len(s.row)) / slots.sizes for x in parts]
    return pa.StructArray.from_arrays([*map(pa.array, means)], names=["ms", "ps", "ls"])


def best_pairs(seeds: pa.StructArray, seed_paths: pa.ListArray, queries: pa.StructArray, query_paths: pa.ListArray, w_map: pa.ListArray | None, options: ScoringOptions, distance: bool, tool_of) -> pa.StructArray:
    """Of each row the pair of paths with the highest final score: final, ms, ps, cs, ls, seed_path, query_path; ties go
    to the first query path, then the first seed path.

    ``seeds`` and ``queries``: feature, position, start and stop of a protein's instances, those on paths first, and
    the clan of these. ``w_map``: (feature, weight) entries, for each row.
    """
    map_keys = pa.array([], pa.string()) if w_map is None else w_map.flatten().field(0)
    (s_codes, q_codes, m_codes), names = _codes(seeds.field("feature").flatten(), queries.field("feature").flatten(), map_keys)
    (s_clans, q_clans), clan_names = _codes(seeds.field("clan").flatten(), queries.field("clan").flatten())
    s = _Side(seeds, seed_paths, s_codes, max(len(names), 1), s_clans, max(len(clan_names), 1))
    q = _Side(queries, query_paths, q_codes, max(len(names), 1), q_clans, max(len(clan_names), 1))
    w = _weights(s, names, w_map, m_codes, options, distance, {f: tool_of(f) for f in names})
    total = np.bincount(s.features.view, w, len(s.row))
    with np.errstate(divide="ignore"):
        scale = np.where(total > 1, 1.0 / total, 1.0) if distance else np.where(total > 0, 1.0 / total, 0.0)

    def scores(pair_s: np.ndarray, pair_q: np.ndarray, item: np.ndarray, match: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """final, ms, ps, cs, ls (5 x pairs). ``item``: where the first instance of the seed stands in match, ratio."""
        n = len(pair_s)
        place, of = _runs(s.view_start[pair_s], s.view_size[pair_s])
        near = item[of] + s.member[place] - s.start[s.row[pair_s]][of]
        sizes = s.features.sizes[pair_s]
        slot, pair = _runs(s.features.starts[pair_s], sizes)
        at = _before(sizes)[of] + s.features.of_member[place] - s.features.starts[pair_s][of]
        mine, theirs = s.features.n[slot], q.features.found(pair_q[pair], s.features.name[slot])[1]
        parts = [np.minimum(theirs / mine, 1.0), *(np.bincount(at, x[near], len(slot)) / mine for x in (match, ratio))]
        if distance:
            ms, ps, ls = (1.0 - np.bincount(pair, (1.0 - x) * w[slot], n) * scale[pair_s] for x in parts)
        else:
            ms, ps, ls = (np.bincount(pair, x * w[slot], n) * scale[pair_s] for x in parts)
        known = s.clans.sizes[pair_s]
        slot, pair = _runs(s.clans.starts[pair_s], known)
        mine, theirs = s.clans.n[slot], q.clans.found(pair_q[pair], s.clans.name[slot])[1]
        if distance:
            lost = np.bincount(pair, np.where(theirs > 0, 1.0 - np.minimum(theirs / mine, 1.0), 0.0), n)
            cs = np.where(known > 0, 1.0 - lost / np.maximum(known, 1), 0.0)
        else:
            most = np.maximum(mine, theirs)
            cs = np.bincount(pair, mine * theirs / (most * most), n) / np.maximum(known, 1)
        ms, ps, cs, ls = (_rounded(x, options.digits) for x in (ms, ps, cs, ls))
        if options.empty_as_1 and not distance:
            none = (s.view_size[pair_s] == 0) & (q.view_size[pair_q] == 0)
            ms, ps, cs, ls = (np.where(none, 1.0, x) for x in (ms, ps, cs, ls))
        return np.stack([ms * options.weight_multiplicity + cs * options.weight_clan + ps * options.weight_position, ms, ps, cs, ls])

    def highest(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _first_highest(np.nan_to_num(np.round(found[0], TIES), nan=np.inf), sizes)

    # the best of each view of a query, then of each row; the views are compared in blocks
    values, chosen = [np.zeros((5, 0))], [np.zeros(0, np.int64)]
    of_row = np.bincount(s.row, s.view_size, len(s.n_views)).astype(np.int64) + s.n_views
    for block in _blocks(s.size[q.row] * (1 + q.view_size) + of_row[q.row]):
        views = np.arange(len(q.row))[block]
        row = q.row[views]
        element, of = _runs(s.start[row], s.size[row])
        match, ratio = _nearest(s, q, element, views[of])
        pair_s, of = _runs(s.first_view[row], s.n_views[row])
        some = [scores(pair_s[b], views[of[b]], _before(s.size[row])[of[b]], match, ratio) for b in _blocks(s.view_size[pair_s] + 1)]
        found = np.concatenate(some, axis=1)
        at = highest(found, s.n_views[row])
        values.append(found[:, at])
        chosen.append(pair_s[at])
    found, chosen = np.concatenate(values, axis=1), np.concatenate(chosen)
    at = highest(found, q.n_views)
    columns = [*map(pa.array, found[:, at]), s.paths.take(pa.array(chosen[at])), q.paths.take(pa.array(at))]
    return pa.StructArray.from_arrays(columns, names=["final", "ms", "ps", "cs", "ls", "seed_path", "query_path"])
