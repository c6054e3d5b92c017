"""The search by tiles against the plain comparison of all pairs."""

import numpy as np
import pytest

from chronogrid.operators import knn


@pytest.mark.parametrize("k", [1, 3, 70])
@pytest.mark.parametrize("case", ["everywhere", "one corner", "ties"])
def test_equal_to_all_pairs(k, case):
    rng = np.random.default_rng(k)
    x, y = (v.ravel() * 0.5 for v in np.meshgrid(np.arange(15), np.arange(300)))
    targets = np.column_stack([x, y, np.full(len(x), 12.0)])
    at = rng.integers(0, 400 if case == "one corner" else len(x), 3000)
    t = np.full(3000, 12.0) if case == "ties" else rng.integers(0, 13, 3000).astype(float)
    events = np.column_stack([x[at], y[at], t])
    for found, expected in zip(knn.nearest_by_tiles(targets, events, k), knn.nearest(targets, events, k), strict=True):
        assert (found == expected).all()


def test_pairs_grow_with_the_cells(monkeypatch):
    """Four times the cells and events: about four times the comparisons, where all pairs would be sixteen."""
    plain, pairs = knn.nearest, []
    monkeypatch.setattr(knn, "nearest", lambda a, b, k: pairs.append(len(a) * len(b)) or plain(a, b, k))
    done = []
    for high in (400, 1600):
        rng = np.random.default_rng(high)
        x, y = (v.ravel() * 0.5 for v in np.meshgrid(np.arange(15), np.arange(high)))
        pairs.clear()
        knn.nearest_by_tiles(np.column_stack([x, y, np.full(len(x), 20.0)]), np.column_stack([x, y, rng.integers(0, 20, len(x))]), 3)
        done.append(sum(pairs))
    assert done[1] < 5 * done[0]


def test_all_targets_once():
    """Numbers of targets that fill no whole tile, or no whole group of tiles."""
    rng = np.random.default_rng(5)
    events = rng.integers(0, 60, (700, 3)).astype(float)
    for n in (1, 63, 65, 4097):
        targets = rng.integers(0, 60, (n, 3)).astype(float)
        for found, expected in zip(knn.nearest_by_tiles(targets, events, 1), knn.nearest(targets, events, 1), strict=True):
            assert (found == expected).all()


def test_of_equally_near_events_the_first():
    """Whose size a weight takes: of copies of one event in several tiles, the first in the events' order."""
    rng = np.random.default_rng(6)
    events = np.repeat(rng.integers(0, 9, (20, 3)).astype(float), 50, 0)
    rng.shuffle(events)
    targets = rng.integers(0, 9, (500, 3)).astype(float)
    assert (knn.nearest_by_tiles(targets, events, 1)[1] == knn.nearest(targets, events, 1)[1]).all()
