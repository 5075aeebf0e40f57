"""Kernels against enumeration."""

import itertools

import numpy as np
import pandas as pd
import pytest

from reelsleuth.operators import solve as V


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_least(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    cost = rng.random((n, n))
    cost[rng.random((n, n)) < 0.15] = np.inf
    price = lambda p: sum(min(cost[i, p[i]], V.NEVER) for i in range(n))
    found = V.assign(cost)
    assert sorted(found) == list(range(n))
    assert price(found) == pytest.approx(min(map(price, itertools.permutations(range(n)))), rel=1e-6)


@pytest.mark.parametrize("seed", range(25))
def test_set_placement_is_least_and_so_is_its_rival(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, 3, size=rng.integers(1, 4))]
    cost = rng.random((sum(lengths), sum(lengths) + int(rng.integers(0, 4))))
    solutions = []

    def extend(i, cursor, total, starts):
        if i == len(lengths):
            solutions.append((total, starts))
            return
        at = sum(lengths[:i])
        for s in range(cursor, cost.shape[1] - lengths[i] + 1):
            part = cost[at : at + lengths[i], s : s + lengths[i]]
            least = min(sum(part[k, q[k]] for k in range(len(part))) for q in itertools.permutations(range(len(part))))
            extend(i + 1, s + lengths[i], total + least + (V.GAP * (s - cursor) if i else 0), [*starts, s])

    extend(0, 0, 0.0, [])
    solutions.sort()
    starts, mean, runner = V.place_set(lengths, cost)
    assert starts == solutions[0][1] and mean * sum(lengths) == pytest.approx(solutions[0][0])
    others = [t for t, s in solutions if s != starts]
    assert runner is None if not others else runner * sum(lengths) == pytest.approx(min(others))


def test_set_placement_refuses_what_does_not_fit():
    assert V.place_set([2], np.zeros((2, 1))) is None
    assert V.place_set([], np.zeros((0, 3))) is None
    assert V.place_set([1], np.full((1, 2), np.inf)) is None


def test_titles_are_ordered_by_card_then_dialogue_then_runtime():
    none = [None, None, None]
    fit = np.array([[0, 3.0, 0], [2.5, 0, 0], [0, 0, 2.0]])
    order, reasons, doubtful = V.order_titles(fit, np.array([True] * 3), np.array([25.0] * 3), np.array([25.0] * 3), none, none)
    assert order == [1, 0, 2] and reasons == ["dialogue"] * 3 and doubtful == []
    order, reasons, _ = V.order_titles(fit, np.array([True] * 3), np.array([25.0] * 3), np.array([25.0] * 3), [0, None, None], none)
    assert order[0] == 0 and reasons[0] == "card"
    order, reasons, doubtful = V.order_titles(np.zeros((2, 2)), np.array([False, False]), np.array([24.0, 48.0]), np.array([48.0, 24.0]), [None, None], [None, None])
    assert order == [1, 0] and reasons == ["runtime", "runtime"] and not doubtful
    order, reasons, doubtful = V.order_titles(np.zeros((2, 2)), np.array([False, False]), np.array([24.0, 24.0]), np.array([24.0, 24.0]), [None, None], [None, None])
    assert order == [0, 1] and reasons == ["disc order"] * 2 and doubtful == [0, 1]


def test_parts_of_a_story_keep_disc_order():
    fit = np.array([[0, 3.0], [3.0, 0]])
    order, _, _ = V.order_titles(fit, np.array([True, True]), np.array([25.0, 25.0]), np.array([25.0, 25.0]), [None, None], ["Quest", "Quest"])
    assert order == [0, 1]


def test_forbidden_pairs_leave_no_order():
    prior = np.full((1, 1), np.inf)
    assert V.order_titles(np.zeros((1, 1)), np.array([False]), np.array([1.0]), np.array([1.0]), [None], [None], prior) is None


def test_specials_need_a_margin():
    score = np.array([[5.0, 1.0], [1.0, 2.0], [np.nan, np.nan]])
    found = V.match_specials(score, np.zeros((3, 2), bool))
    assert found[0] == (0, 4.0, True) and found[1][0] == 1 and not found[1][2] and found[2][2] is False


def test_greedy_takes_each_once():
    assert V.greedy_unique([(0, 1, 0.9), (1, 1, 0.8), (1, 2, 0.3), (0, 2, 0.85)]) == {0: (1, 0.9), 1: (2, 0.3)}


def test_groups_are_assigned_apart(spark):
    rows = [("a", 0, 0, 1.0), ("a", 0, 1, 0.1), ("a", 1, 0, 0.2), ("a", 1, 1, 1.0), ("b", 7, 3, 0.5)]
    found = V.assign_groups(spark.createDataFrame(rows, "g string, t long, e long, c double"), "g", "t", "e", "c").toPandas()
    assert set(map(tuple, found.itertuples(index=False))) == {("a", 0, 1, 0.1), ("a", 1, 0, 0.2), ("b", 7, 3, 0.5)}


def test_sets_are_placed(spark):
    rows = [("s", d, t, e, abs((d * 2 + t + 3) - e) / 10) for d in (0, 1) for t in (0, 1) for e in range(9)]
    found = V.place_sets(spark.createDataFrame(rows, "s string, d long, t long, e long, c double"), "s", "d", "t", "e", "c").toPandas()
    assert dict(zip(found.d, found.start)) == {0: 3, 1: 5}
    assert isinstance(found, pd.DataFrame)


def test_a_large_set_is_placed_in_seconds():
    """Twelve discs, thirty titles of 45 minutes, 400 episodes."""
    import time

    listed = np.array([30 + 10 * (n % 7) for n in range(400)], float)
    lengths = [3, 3, 2, 2, 3, 2, 2, 3, 3, 2, 3, 2]
    began = time.process_time()
    starts, mean, runner = V.place_set(lengths, np.abs(45.0 - np.tile(listed, (30, 1))))
    assert time.process_time() - began < 10 and len(starts) == 12 and mean <= runner + 1e-9
    assert all(b >= a + k for a, b, k in zip(starts, starts[1:], lengths))


def test_a_set_that_cannot_be_placed_says_why(spark):
    rows = [("a", 0, t, e, 1.0) for t in range(3) for e in range(2)] + [("b", 0, 0, 0, float("inf"))]
    found = {r["g"]: (r["start"], r["reason"]) for r in V.place_sets(spark.createDataFrame(rows, "g string, d long, t long, e long, c double"), "g", "d", "t", "e", "c").collect()}
    assert found == {"a": (None, "fewer episodes than titles"), "b": (None, "no pairing is allowed")}


def test_many_small_windows_as_one_by_one():
    """Many windows at once give what each gives alone; costs are drawn so that none tie."""
    import numpy as np

    from reelsleuth.operators import solve as V

    rng = np.random.default_rng(7)
    for n in (1, 2, 3):
        fit = np.where(rng.random((300, n, 1)) < 0.4, np.nan, rng.random((300, n, n)) * 3)
        minutes, listed = rng.random((300, n)) * 30, np.where(rng.random((300, n)) < 0.2, np.nan, rng.random((300, n)) * 30)
        told = rng.integers(-1, n, (300, n)) if n > 1 else np.zeros((300, 1), int)
        order, reasons, doubtful, sound = V.order_small(fit, minutes, listed, told)
        assert sound.all()
        for i in range(300):
            want = V.order_titles(np.nan_to_num(fit[i]), ~np.isnan(fit[i]).any(axis=1), minutes[i], listed[i], [None if t < 0 else int(t) for t in told[i]], [None] * n)
            assert (order[i].tolist(), reasons[i].tolist(), np.flatnonzero(doubtful[i]).tolist()) == want
        cost = rng.random((200, n, n))
        assert V.least_pairings(cost).tolist() == [V.assign(g).tolist() for g in cost]
