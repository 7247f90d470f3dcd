"""Median of pairwise slopes and the Mann-Kendall sum of one series, without its pairs.

The slopes up to s are the pairs that y - s t puts in falling (or equal) order, and those are counted by merging. A sample of pairs brackets the
median; counts at the bracket's ends, and at interpolated points inside, narrow it until the pairs between are few, and only these are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Series of at most so many values are done by all pairs; pairs that are formed at once beyond, for each value of the series.
SHORT, AT_ONCE = 300, 8


def _levels(rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Merge levels of some ranks: (left halves, right halves) sorted inside blocks as rows, and what the ranks' places are."""
    n = len(rank)
    size = 1 << max(0, (n - 1).bit_length())
    value = np.concatenate([rank, np.arange(n, size) + rank.max(initial=0) + 1])  # the added ones rise and come last: in no falling pair
    place = np.arange(size)
    width = 1
    while width < size:
        blocks = value.reshape(-1, 2, width)
        yield blocks[:, 0], blocks[:, 1], place.reshape(-1, 2, width)
        both = value.reshape(-1, 2 * width)
        order = np.argsort(both, axis=1, kind="stable")
        value = np.take_along_axis(both, order, axis=1).ravel()
        place = np.take_along_axis(place.reshape(-1, 2 * width), order, axis=1).ravel()
        width *= 2


def _starts(left: np.ndarray, right: np.ndarray, strict: bool) -> np.ndarray:
    """For each of the right halves' elements where in its left half begin those not below (strict: above) it."""
    far = int(max(left.max(), right.max())) + 1
    base = np.arange(len(left))[:, None]
    at = np.searchsorted((left + base * far).ravel(), (right + base * far).ravel(), side="right" if strict else "left").reshape(right.shape)
    return at - base * left.shape[1]


def falling(z: np.ndarray, strict: bool = False) -> int:
    """How many pairs i < j have z[j] <= z[i] (strict: <)."""
    rank = np.unique(z, return_inverse=True)[1].astype(np.int64)
    return sum(int((left.shape[1] - _starts(left, right, strict)).sum()) for left, right, _ in _levels(rank))


def _between(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j that rise in ``low`` and don't in ``high``."""
    first = np.lexsort((-np.arange(len(low)), low))  # by low; of equals the later one first, as they don't rise
    rank = np.unique(high, return_inverse=True)[1].astype(np.int64)[first]
    out_i, out_j = [], []
    for left, right, place in _levels(rank):
        # an earlier one in low's order that is not below a later one in high's
        start = _starts(left, right, False)
        count = left.shape[1] - start
        total = int(count.sum())
        if total:
            block = np.repeat(np.arange(len(left)), right.shape[1])
            hit = np.repeat(np.arange(count.size), count.ravel())
            k = np.arange(total) - np.repeat(np.cumsum(count.ravel()) - count.ravel(), count.ravel()) + start.ravel()[hit]
            out_i.append(place[:, 0][block[hit], k])
            out_j.append(place[:, 1].ravel()[hit])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = first[np.concatenate(out_i)], first[np.concatenate(out_j)]
    kept = i < j
    return i[kept], j[kept]


def slope_and_s(t: np.ndarray, y: np.ndarray) -> tuple[float | None, int]:
    """The median slope of all pairs of different times (None without one), and how many pairs rise minus how many fall. Pairs of one time count for neither."""
    order = np.lexsort((y, t))
    t, y = t[order], y[order]
    n = len(t)
    pairs = n * (n - 1) // 2
    twice = lambda *c: int((k := np.unique(np.stack(c), axis=1, return_counts=True)[1].astype(np.int64), (k * (k - 1)).sum())[1] // 2)
    same_t, same_y, same = twice(t), twice(y), twice(t, y)
    fall = falling(y, strict=True)  # values of one time stand in rising order
    s = pairs - same_t - same_y + same - 2 * fall
    m = pairs - same_t
    if not m:
        return None, s
    wanted = sorted({(m - 1) // 2, m // 2})
    if n <= SHORT:
        i, j = np.triu_indices(n, 1)
        i, j = i[t[j] > t[i]], j[t[j] > t[i]]
        slopes = np.sort((y[j] - y[i]) / (t[j] - t[i]))
        return float(np.mean(slopes[wanted])), s
    upto = lambda v: falling(y - v * t) - same  # noqa: E731  pairs of one time and value are always counted
    rng = np.random.default_rng(n)
    i, j = rng.integers(0, n, 8 * n), rng.integers(0, n, 8 * n)
    i, j = i[t[i] != t[j]], j[t[i] != t[j]]
    sample = np.sort((y[j] - y[i]) / (t[j] - t[i]))
    reach = 3 * np.sqrt(len(sample)) / 2
    ends = [sample[int(min(len(sample) - 1, max(0, len(sample) / 2 + side * reach)))] for side in (-1, 1)]
    step = max(ends[1] - ends[0], 1e-12 * (abs(ends[0]) + abs(ends[1])) + 1e-300)
    low, high = ends[0] - step * 1e-6, ends[1] + step * 1e-6
    below, upper = upto(low), upto(high)
    while below > wanted[0]:
        low, step = low - step, step * 2
        below = upto(low)
    while upper <= wanted[-1]:
        high, step = high + step, step * 2
        upper = upto(high)
    at = [_slope_at(k, t, y, upto, (low, below), (high, upper)) for k in wanted]
    return float(np.mean(at)), s


def _slope_at(k: int, t: np.ndarray, y: np.ndarray, upto: Callable[[float], int], low: tuple[float, int], high: tuple[float, int]) -> float:
    """The slope of rank k (from 0), which lies above ``low`` and not above ``high``, both with their numbers of slopes up to them."""
    turn = 0
    while high[1] - low[1] > AT_ONCE * len(t):
        wide = high[0] - low[0]
        share = (0.5, (k - low[1]) / (high[1] - low[1]) * 0.98, 1 - (high[1] - k) / (high[1] - low[1]) * 0.98)[turn % 3]
        turn += 1
        mid = next((m for m in (low[0] + wide * min(0.999, max(0.001, share)), low[0] + wide / 2) if low[0] < m < high[0]), None)
        if mid is None:
            return high[0]  # so many equal slopes: no number lies between the ends
        count = upto(mid)
        if count <= k:
            low = (mid, count)
        else:
            high = (mid, count)
    i, j = _between(y - low[0] * t, y - high[0] * t)
    parts = t[j] > t[i]
    slopes = np.sort((y[j] - y[i])[parts] / (t[j] - t[i])[parts])
    return slopes[min(len(slopes) - 1, k - low[1])]
