"""Upper bounds of the weighted ratio from what is cheap to count, for all pairs of two lists at once.

No common subsequence has more characters than the strings have in common as multisets, and that number is
a product of two incidence matrices: a string has the feature (c, k) if it holds c at least k times. The
length of the tokens that two strings share is another such product. All parts of the weighted ratio
are bounded by these two and the strings' lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from linkloom.functions.fuzzy import lengths

#: Cells of an incidence matrix.
CELLS = 8_000_000


def counted(items: Iterable) -> list[tuple]:
    """Each item with the number of its occurrence."""
    times: dict = {}
    out = []
    for x in items:
        times[x] = times.get(x, 0) + 1
        out.append((x, times[x]))
    return out


def products(a: list[str], b: list[str], features: Callable[[str], Iterable], weight: Callable[[object], float]) -> np.ndarray:
    """For all pairs the summed weights of the features that both have. Features are taken some at a time, so matrices stay small."""
    place: dict = {}
    rows = [[[place.setdefault(f, len(place)) for f in features(s)] for s in strings] for strings in (a, b)]
    weights = np.fromiter(map(weight, place), np.float32, len(place))
    out = np.zeros((len(a), len(b)), np.float32)
    step = max(1, CELLS // max(1, len(a) + len(b)))
    for first in range(0, len(place), step):
        sides = []
        for strings in rows:
            m = np.zeros((len(strings), min(step, len(place) - first)), np.float32)
            at = [(i, f - first) for i, fs in enumerate(strings) for f in fs if first <= f < first + step]
            if at:
                m[tuple(np.asarray(at).T)] = 1
            sides.append(m)
        out += (sides[0] * weights[first : first + step]) @ sides[1].T
    return out


def weighted_bounds(a: list[str], b: list[str]) -> np.ndarray:
    """No weighted ratio of a pair, 0 to 1, is above its bound. Strings are normalised: single blanks, none at the ends."""
    common = products(a, b, counted, lambda f: 1.0).astype(np.float64)
    # A shared token counts with the blank behind it; tokens of over 2 ** 20 characters don't occur in titles.
    joined = products(a, b, lambda s: set(s.split()), lambda t: len(t) + 1.0).astype(np.float64)
    sets = [[set(s.split()) for s in strings] for strings in (a, b)]
    whole = [np.array([sum(map(len, t)) + max(0, len(t) - 1) for t in ts], np.float64) for ts in sets]
    la, lb = lengths(a)[:, None].astype(np.float64), lengths(b)[None, :].astype(np.float64)
    most = lambda c, total: np.where(total > 0, 200.0 * c / np.maximum(total, 1), 100.0)
    plain = most(common, la + lb)
    shared = joined > 0
    s = np.where(shared, joined - 1, 0)
    rest_a, rest_b = (np.where(shared, np.maximum(0, w - s - 1), w) for w in (whole[0][:, None], whole[1][None, :]))
    # What is left of two token sets has no more in common than the shorter has characters, nor than the strings have
    # besides the shared tokens, of whose blanks one is left over.
    left = np.minimum(np.minimum(rest_a, rest_b), np.maximum(0, common - s - 1))
    apart = lambda x, y: np.where(y > 0, 100.0 - 100.0 * x / np.maximum(y, 1), 100.0)
    partly = np.maximum(apart(rest_a + rest_b - 2 * left, 2 * (s + 1) + rest_a + rest_b), np.maximum(apart(1 + rest_a, 2 * s + 1 + rest_a), apart(1 + rest_b, 2 * s + 1 + rest_b)))
    # Joined sets hold a part of the strings' characters: tokens that repeat count once.
    wa, wb = whole[0][:, None], whole[1][None, :]
    fewest = np.minimum(common, np.minimum(wa, wb))
    by_set = np.where(shared, np.where((rest_a == 0) | (rest_b == 0), 100.0, partly), most(fewest, wa + wb))
    alike = np.maximum(plain, 0.95 * np.maximum(plain, by_set))
    short, times = np.minimum(la, lb), np.maximum(la, lb) / np.maximum(1, np.minimum(la, lb))
    scale = np.where(times <= 8, 0.9, 0.6)
    window = most(common, short + common)
    by_tokens = np.maximum(window, most(fewest, np.minimum(wa, wb) + fewest))
    unlike = np.maximum(plain, scale * np.maximum(window, 0.95 * np.where(shared, 100.0, by_tokens)))
    bound = np.minimum(100.0, np.where(times < 1.5, alike, unlike)) / 100 + 1e-9
    return np.where((la == 0) | (lb == 0), 0.0, bound)
