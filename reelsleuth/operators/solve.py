"""Assignment and alignment on small groups, as kernels for applyInPandas.

A group is a disc or a set of discs, at most some hundred titles; scores come from columnar operators.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: What a forbidden pair costs, so that a solution without one is always preferred.
NEVER = 1e12
# Costs of ordering titles within a window, and of gaps between discs.
CARD_COST, MINUTE_COST, ORDER_COST, LEAST_SWAP, LEAST_FIT = 100.0, 0.5, 0.01, 1.0, 1.0
GAP = 0.05
MOST_EPISODES, MOST_DISCS = 2000, 100
LEAST_SPECIAL, SPECIAL_RUNTIME = 1.5, 0.5
#: Groups of so many titles are solved many at once, by all their ways; larger ones one by one.
FEW = 3


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row of a square matrix at the least total cost: shortest augmenting paths with potentials."""
    cost = np.where(np.isfinite(cost), cost, NEVER)
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.full(n + 1, -1)  # the last column is where a path begins
    for i in range(n):
        row_of[n], col = i, n
        best, via, done = np.full(n + 1, np.inf), np.full(n + 1, -1), np.zeros(n + 1, bool)
        while row_of[col] >= 0:
            done[col] = True
            r = row_of[col]
            slack = cost[r] - u[r] - v[:n]
            nearer = ~done[:n] & (slack < best[:n])
            best[:n][nearer], via[:n][nearer] = slack[nearer], col
            nxt = int(np.argmin(np.where(done[:n], np.inf, best[:n])))
            step = best[nxt]
            for c in np.flatnonzero(done):
                u[row_of[c]] += step
                v[c] -= step
            best[:n][~done[:n]] -= step
            col = nxt
        while col != n:
            row_of[col] = row_of[via[col]]
            col = int(via[col])
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def place_set(lengths: list[int], cost: np.ndarray, gap: float = GAP) -> tuple[list[int], float, float | None] | None:
    """(first episode of each disc, mean cost, runner-up) of discs in order over a list of episodes.

    `cost` is titles x episodes. Each disc takes as many neighbouring episodes as it has titles; skipped ones
    between discs cost `gap` each, those before the first and after the last nothing. The runner-up moves one
    disc at least. None if nothing fits. Of equal solutions the earliest is taken.
    """
    n, episodes = len(lengths), cost.shape[1]
    if not n or n > MOST_DISCS or episodes > MOST_EPISODES or min(lengths) == 0 or sum(lengths) > episodes:
        return None
    window, at = np.full((n, episodes + 1), np.inf), 0
    for i, k in enumerate(lengths):
        for s in range(episodes - k + 1):
            part = cost[at : at + k, s : s + k]
            total = part[np.arange(k), assign(part)].sum()
            window[i, s] = total if np.isfinite(total) else np.inf
        at += k
    place = np.arange(episodes + 1)
    # tail[i][s]: discs i.. once disc i - 1 ended before s; ahead[i][s]: discs ..i - 1 if disc i begins at s.
    tail, ahead, here = np.full((n + 1, episodes + 1), np.inf), np.full((n + 1, episodes + 1), np.inf), np.full((n, episodes + 1), np.inf)
    tail[n], ahead[0] = 0.0, 0.0
    for i in range(n - 1, -1, -1):
        k = lengths[i]
        here[i, : episodes - k + 1] = window[i, : episodes - k + 1] + tail[i + 1, k:]
        tail[i] = np.minimum.accumulate((here[i] + gap * place)[::-1])[::-1] - gap * place
    for i in range(n):
        k = lengths[i]
        ended = np.full(episodes + 1, np.inf)
        ended[k:] = (ahead[i] + window[i])[: episodes - k + 1]
        ahead[i + 1] = np.minimum.accumulate(ended - gap * place) + gap * place
    best = here[0].min()
    if not np.isfinite(best):
        return None
    starts, cursor = [], 0
    for i in range(n):
        score = here[i] + (gap * (place - cursor) if i else 0.0)
        goal = score[cursor:].min()
        starts.append(int(cursor + np.flatnonzero(np.abs(score[cursor:] - goal) < 1e-9)[0]))
        cursor = starts[-1] + lengths[i]
    runner = np.inf
    for i, k in enumerate(lengths):
        through = ahead[i] + here[i]
        through[starts[i]] = np.inf
        runner = min(runner, through.min())
    total = sum(lengths)
    return starts, best / total, float(runner / total) if np.isfinite(runner) else None


def order_titles(fit: np.ndarray, spoken: np.ndarray, minutes: np.ndarray, listed: np.ndarray, card: list, stories: list, prior: np.ndarray | None = None) -> tuple[list[int], list[str], list[int]] | None:
    """(episode, reason, doubtful titles) of titles within a window of as many episodes.

    Captions outweigh all; dialogue counts in standard deviations, runtime half a point a minute, disc order a
    hundredth a step. Parts of one story keep disc order among the places they got. A title is doubtful if a swap
    with another costs less than one, or if its dialogue fits weakly.
    """
    n = len(minutes)
    told = np.zeros((n, n))
    for t, place in enumerate(card):
        if place is not None:
            told[t] = CARD_COST
            told[t, place] = -CARD_COST
    off = np.abs(minutes[:, None] - listed[None]) * MINUTE_COST
    evidence = told - np.where(spoken[:, None], fit, 0.0) + np.where(np.isnan(off), 0.0, off) + (0.0 if prior is None else prior)
    cost = evidence + ORDER_COST * np.abs(np.arange(n)[:, None] - np.arange(n)[None])
    order = assign(cost)
    if not np.isfinite(cost[np.arange(n), order]).all():
        return None
    groups = defaultdict(list)
    for t in range(n):
        if card[t] is None and stories[order[t]] is not None:
            groups[stories[order[t]]].append(t)
    for members in groups.values():
        for t, slot in zip(members, sorted(order[members])):
            order[t] = slot
    reasons, doubtful = [], []
    own = evidence[np.arange(n), order]
    for t in range(n):
        swaps = evidence[t, order] + evidence[:, order[t]] - own[t] - own
        swaps[t] = np.inf
        near = bool((swaps < LEAST_SWAP).any())
        reason = "card" if card[t] == order[t] else "dialogue" if spoken[t] and fit[t, order[t]] >= LEAST_FIT else "weak dialogue" if spoken[t] else "disc order" if near else "runtime"
        reasons.append(reason)
        if reason != "card" and (near or reason == "weak dialogue"):
            doubtful.append(t)
    return [int(e) for e in order], reasons, doubtful


def order_small(fit: np.ndarray, minutes: np.ndarray, listed: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, reasons, doubtful, sound) of many windows at once, as order_titles() has them without stories.

    `fit` is (windows, n, n) with NaN for titles without dialogue, `told` the place that captions name or -1. Windows that aren't
    sound have costs that aren't finite.
    """
    n = fit.shape[1]
    place, spoken, fit = np.arange(n), ~np.isnan(fit).any(axis=2), np.nan_to_num(fit)
    named = np.where((told >= 0)[:, :, None], np.where(told[:, :, None] == place, -CARD_COST, CARD_COST), 0.0)
    off = np.abs(minutes[:, :, None] - listed[:, None]) * MINUTE_COST
    evidence = named - np.where(spoken[:, :, None], fit, 0.0) + np.where(np.isnan(off), 0.0, off)
    cost = evidence + ORDER_COST * np.abs(place[:, None] - place)
    order = least_pairings(cost)
    own = np.take_along_axis(evidence, order[:, :, None], 2)[:, :, 0]
    got = np.take_along_axis(evidence, np.repeat(order[:, None], n, 1), 2)  # of title t the evidence for what u has
    swaps = got + got.transpose(0, 2, 1) - own[:, :, None] - own[:, None]
    swaps[:, place, place] = np.inf
    near = (swaps < LEAST_SWAP).any(axis=2)
    fits = np.take_along_axis(fit, order[:, :, None], 2)[:, :, 0] >= LEAST_FIT
    is_card = told == order
    reasons = np.select([is_card, spoken & fits, spoken, near], ["card", "dialogue", "weak dialogue", "disc order"], "runtime").astype(object)
    return order, reasons, ~is_card & (near | spoken & ~fits), np.isfinite(cost).all(axis=(1, 2))


def match_specials(score: np.ndarray, barred: np.ndarray, least: float = LEAST_SPECIAL) -> list[tuple[int | None, float | None, bool]]:
    """(special, margin, accepted) of each title: one to one, or none at no cost. Unknown scores are NaN."""
    n, m = score.shape
    cost = np.zeros((n + m, n + m))
    cost[:n, :m] = np.where(barred, np.inf, -np.nan_to_num(score))
    found, open_ = assign(cost)[:n], np.where(barred, np.nan, score)
    out = []
    for t, e in enumerate(found):
        if e >= m:
            out.append((None, None, False))
            continue
        if np.isnan(open_[t, e]):
            out.append((int(e), None, False))
            continue
        others = np.delete(open_[t], e)
        others = others[~np.isnan(others)]
        margin = float(open_[t, e] - others.max()) if len(others) else float(open_[t, e])
        out.append((int(e), margin, margin >= least))
    return out


def greedy_unique(scores: list[tuple[int, int, float]]) -> dict[int, tuple[int, float]]:
    """Title to (episode, score), the best pairs first, each title and episode once."""
    out, used = {}, set()
    for t, e, s in sorted(scores, key=lambda x: -x[2]):
        if t not in out and e not in used:
            out[t] = (e, s)
            used.add(e)
    return out


def _matrix(got: pd.DataFrame, row: str, col: str, value: str) -> tuple[np.ndarray, list, list]:
    rows, cols = sorted(got[row].unique()), sorted(got[col].unique())
    out = np.full((len(rows), len(cols)), np.inf)
    out[got[row].map({r: i for i, r in enumerate(rows)}), got[col].map({c: i for i, c in enumerate(cols)})] = got[value].to_numpy(float)
    return out, rows, cols


def by_groups(rows: DataFrame, by: str, order: list[str], kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """`kernel(frame, first)` over frames of many whole groups, sorted by `by` and `order`; first: where each group begins.

    A call a group costs milliseconds of Spark and pandas, a batch of small groups little more than one of them.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            got = pd.concat([*rest, batch], ignore_index=True) if rest else batch
            first = _begins(got[by])
            if len(first) > 1:
                yield kernel(got.iloc[: first[-1]], first[:-1])
            rest = [got.iloc[first[-1] :]] if len(first) else []
        if rest:
            yield kernel(rest[0].reset_index(drop=True), np.zeros(1, np.int64))

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


def _begins(*keys: pd.Series) -> np.ndarray:
    """Where runs of equal keys begin; nulls are equal."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        x = key.to_numpy()
        new[1:] |= (x[1:] != x[:-1]) & ~(pd.isna(x[1:]) & pd.isna(x[:-1]))
    return np.flatnonzero(new)


def least_pairings(cost: np.ndarray) -> np.ndarray:
    """(groups, n): assign() of each of some square matrices (groups, n, n) of at most FEW rows, the first of equals in order."""
    ways = np.array(list(permutations(range(cost.shape[1]))))
    cost = np.where(np.isfinite(cost), cost, NEVER)
    total = np.zeros((len(cost), len(ways)))
    for t in range(cost.shape[1]):
        total += cost[:, t, ways[:, t]]
    return ways[total.argmin(axis=1)]


def assign_groups(pairs: DataFrame, by: str, row: str, col: str, cost: str) -> DataFrame:
    """(by, row, col, cost): the least-cost one-to-one assignment of each group of (by, row, col, cost).

    A group with more rows than columns leaves the dearest rows out; pairs that aren't given are forbidden.
    """
    def one(got: pd.DataFrame) -> pd.DataFrame:
        matrix, rows, cols = _matrix(got, row, col, cost)
        size = max(matrix.shape)
        square = np.zeros((size, size))
        square[: len(rows), : len(cols)] = matrix
        found = [(got[by].iloc[0], rows[i], cols[j], matrix[i, j]) for i, j in enumerate(assign(square)[: len(rows)]) if j < len(cols) and np.isfinite(matrix[i, j])]
        return pd.DataFrame(found, columns=[by, row, col, cost])

    types = dict(pairs.dtypes)
    return pairs.select(by, row, col, cost).groupBy(by).applyInPandas(one, ", ".join(f"{c} {types[c]}" for c in (by, row, col, cost)))


def place_sets(pairs: DataFrame, by: str, disc: str, title: str, episode: str, cost: str) -> DataFrame:
    """(by, disc, start, mean_cost, runner_up, reason): each set's discs along its episodes, from (by, disc, title, episode, cost).

    A set that can't be placed has one row a disc, without a start, that says why.
    """
    def one(got: pd.DataFrame) -> pd.DataFrame:
        got = got.assign(_t=list(zip(got[disc], got[title])))
        matrix, rows, cols = _matrix(got, "_t", episode, cost)
        discs = sorted(got[disc].unique())
        lengths = [sum(r[0] == d for r in rows) for d in discs]
        found = place_set(lengths, matrix)
        if found is None:
            why = "too many discs" if len(discs) > MOST_DISCS else "too many episodes" if len(cols) > MOST_EPISODES else "fewer episodes than titles" if len(rows) > len(cols) else "no pairing is allowed"
            return pd.DataFrame({by: got[by].iloc[0], disc: discs, "start": None, "mean_cost": None, "runner_up": None, "reason": why})
        starts, mean, runner = found
        return pd.DataFrame({by: got[by].iloc[0], disc: discs, "start": [cols[s] for s in starts], "mean_cost": mean, "runner_up": runner, "reason": None})

    types = dict(pairs.dtypes)
    return pairs.select(by, disc, title, episode, cost).groupBy(by).applyInPandas(one, f"{by} {types[by]}, {disc} {types[disc]}, start {types[episode]}, mean_cost double, runner_up double, reason string")


def order_groups(pairs: DataFrame, by: str, title: str, episode: str, fit: str, minutes: str, listed: str, card: str | None = None, story: str | None = None) -> DataFrame:
    """(by, title, episode, reason, doubtful): titles of each window in order, from (by, title, episode, fit, minutes, listed).

    A null fit is a title without dialogue, a null `listed` an unknown runtime. Windows with as many episodes as titles count.
    `card` is the episode that a title's captions name, of those in the window; `story` names the parts of one story.
    """
    def one(got: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(got[title].unique()), sorted(got[episode].unique())
        empty = pd.DataFrame(columns=[by, title, episode, "reason", "doubtful"])
        if len(rows) != len(cols):
            return empty
        at = (got[title].map({r: i for i, r in enumerate(rows)}), got[episode].map({c: i for i, c in enumerate(cols)}))
        grid, mins, known = np.full((len(rows), len(rows)), np.nan), np.zeros(len(rows)), np.full(len(rows), np.nan)
        grid[at], mins[at[0]], known[at[1]] = got[fit].to_numpy(float), got[minutes].to_numpy(float), got[listed].to_numpy(float)
        spoken = ~np.isnan(grid).any(axis=1)
        told, parts = [None] * len(rows), [None] * len(rows)
        for i, j, name, part in zip(*at, got[card] if card else told * len(rows), got[story] if story else parts * len(rows)):
            told[i] = cols.index(name) if not pd.isna(name) and name in cols else told[i]
            parts[j] = part if not pd.isna(part) else parts[j]
        found = order_titles(np.nan_to_num(grid), spoken, mins, known, told, parts)
        if found is None:
            return empty
        order, reasons, doubtful = found
        return pd.DataFrame({by: got[by].iloc[0], title: rows, episode: [cols[e] for e in order], "reason": reasons, "doubtful": [t in doubtful for t in range(len(rows))]})

    def many(got: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        length = np.diff(np.append(first, len(got)))
        out, alone = [], np.ones(len(first), bool)
        for n in range(1, 0 if story else FEW + 1):
            groups = np.flatnonzero(length == n * n)
            at = first[groups, None] + np.arange(n * n)
            grid = lambda name: got[name].to_numpy()[at].reshape(-1, n, n)  # noqa: B023, E731
            t, e = grid(title), grid(episode)
            square = (t == t[:, :, :1]).all(axis=(1, 2)) & (e == e[:, :1]).all(axis=(1, 2)) & (np.diff(t[:, :, 0], axis=1) > 0).all(axis=1) & (np.diff(e[:, 0], axis=1) > 0).all(axis=1)
            groups, at, t, e = groups[square], at[square], t[square][:, :, 0], e[square][:, 0]
            if len(groups):
                told = np.full((len(groups), n), -1)
                for j in range(n if card else 0):
                    name = grid(card)[:, :, j]
                    for k in range(n):
                        told = np.where(name == e[:, k, None], k, told)
                order, reasons, doubtful, sound = order_small(grid(fit).astype(float), grid(minutes)[:, :, -1].astype(float), grid(listed)[:, -1].astype(float), told)
                alone[groups[sound]] = False
                rows = got.iloc[at[sound][:, :: n + 1].ravel() if n > 1 else at[sound].ravel()]
                out.append(pd.DataFrame({by: rows[by].to_numpy(), title: t[sound].ravel(), episode: np.take_along_axis(e, order, 1)[sound].ravel(), "reason": reasons[sound].ravel(), "doubtful": doubtful[sound].ravel()}))
        out += [one(got.iloc[first[g] : first[g] + length[g]]) for g in np.flatnonzero(alone)]
        out = [x for x in out if len(x)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[by, title, episode, "reason", "doubtful"])

    types = dict(pairs.dtypes)
    wanted = [by, title, episode, fit, minutes, listed, *[x for x in (card, story) if x]]
    return by_groups(pairs.select(*dict.fromkeys(wanted)), by, [title, episode], many, f"{by} {types[by]}, {title} {types[title]}, {episode} {types[episode]}, reason string, doubtful boolean")


def special_groups(pairs: DataFrame, by: str, title: str, special: str, score: str) -> DataFrame:
    """(by, title, special, margin, accepted): bonus titles and specials one to one, from (by, title, special, score); pairs not given are barred.

    Of a few titles and specials all ways are summed in the order of the titles, and the first of the greatest is taken.
    """
    def one(got: pd.DataFrame) -> pd.DataFrame:
        matrix, rows, cols = _matrix(got, title, special, score)
        found = match_specials(np.where(np.isinf(matrix), np.nan, matrix), np.isinf(matrix))
        return pd.DataFrame([(got[by].iloc[0], rows[i], cols[e], m, ok) for i, (e, m, ok) in enumerate(found) if e is not None], columns=[by, title, special, "margin", "accepted"])

    def many(got: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        length = np.diff(np.append(first, len(got)))
        group = np.repeat(np.arange(len(first)), length)
        names, values = [got[title].to_numpy(), got[special].to_numpy()], got[score].to_numpy(float)
        places, sizes = [], []
        for x in names:  # of each row its title's and its special's place in the group
            order = np.lexsort((x, group))
            g, v = group[order], x[order]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
            rank = np.cumsum(new) - 1
            place = np.empty(len(x), np.int64)
            place[order] = rank - rank[np.searchsorted(g, g)]
            places.append(place)
            sizes.append(np.maximum.reduceat(place, first) + 1)
        known = ~np.isnan(values) & ~np.isinf(values)
        small = (sizes[0] <= FEW) & (sizes[1] <= FEW) & np.logical_and.reduceat(known, first)
        out = [one(got.iloc[first[k] : first[k] + length[k]]) for k in np.flatnonzero(~small)]
        grid = np.full((len(first), FEW, FEW + 1), np.nan)
        grid[:, :, FEW] = 0.0  # no special
        own = small[group]
        grid[group[own], places[0][own], places[1][own]] = values[own]
        row = np.full((len(first), FEW, FEW), -1)
        row[group[own], places[0][own], places[1][own]] = np.flatnonzero(own)
        ways = np.array([w for w in product(range(FEW + 1), repeat=FEW) if all(w.count(e) < 2 for e in range(FEW))])
        total = grid[:, 0, ways[:, 0]]
        for t in range(1, FEW):
            total = total + grid[:, t, ways[:, t]]
        way = ways[np.where(np.isnan(total), -np.inf, total).argmax(axis=1)]
        for t in range(FEW):
            at = np.flatnonzero(small & (way[:, t] < FEW))
            e = way[at, t]
            chosen, others = grid[at, t, e], grid[at, t, :FEW].copy()
            others[np.arange(len(at)), e] = np.nan
            best = np.where(np.isnan(others), -np.inf, others).max(axis=1, initial=-np.inf)
            margin = np.where(np.isinf(best), chosen, chosen - best)
            rows = got.iloc[row[at, t, e]]
            out.append(pd.DataFrame({by: rows[by].to_numpy(), title: rows[title].to_numpy(), special: rows[special].to_numpy(), "margin": margin, "accepted": margin >= LEAST_SPECIAL}))
        out = [x for x in out if len(x)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[by, title, special, "margin", "accepted"])

    types = dict(pairs.dtypes)
    return by_groups(pairs.select(by, title, special, score), by, [title, special], many, f"{by} {types[by]}, {title} {types[title]}, {special} {types[special]}, margin double, accepted boolean")


def greedy_groups(pairs: DataFrame, by: str, title: str, episode: str, score: str) -> DataFrame:
    """(by, title, episode, score): the best pairs first, each title and episode once in a group."""
    def one(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values([score, title, episode], ascending=[False, True, True])
        found = greedy_unique(list(zip(got[title], got[episode], got[score])))
        return pd.DataFrame([(got[by].iloc[0], t, e, s) for t, (e, s) in found.items()], columns=[by, title, episode, score])

    types = dict(pairs.dtypes)
    return pairs.select(by, title, episode, score).groupBy(by).applyInPandas(one, ", ".join(f"{c} {types[c]}" for c in (by, title, episode, score)))
