"""Fuzzy string ratios for batches of pairs.

The measure of two strings is ``2 * LCS / (len a + len b)``; the weighted ratio mixes it with
ratios of sorted tokens, of token sets and of the best window, as its public documentation says.

Longest common subsequences of a whole batch are computed at once, bit-parallel: the shorter
string of a pair is the bits of one or several 64-bit numbers, and each character of the longer one
updates the numbers of all pairs, with a carry from number to number.

All windows of a pair are had from one comb. A strand starts above each character of the longer string
and at each of the shorter; strands cross once at most, and never where the characters are equal.
A window's common subsequence is as long as the window less the strands that both start and end in it.
Cells on a diagonal don't depend on one another, so the steps of all pairs are taken by diagonals. Strings
are prepared once each, however many pairs they are in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs whose numbers are updated at a time.
LANES = 32_768
#: Characters of a pattern that one number holds.
BITS = 64
#: Characters of the pairs that are combed at a time.
COMBED = 100_000


def codes(strings: list[str], pad: int) -> np.ndarray:
    width = max(map(len, strings), default=0)
    out = np.full((len(strings), width), pad, np.int32)
    for row, s in zip(out, strings, strict=True):
        row[: len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def numbered(*lists: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The different strings of all lists, and each list as places among them."""
    place: dict[str, int] = {}
    out = [np.fromiter((place.setdefault(s, len(place)) for s in strings), np.int64, len(strings)) for strings in lists]
    return list(place), out


class Batch:
    """Different strings with their characters numbered from 1, and the bits at which each character stands in each pattern."""

    def __init__(self, strings: list[str], patterns: np.ndarray) -> None:
        raw = codes(strings, -1)
        letters, chars = np.unique(raw, return_inverse=True)
        chars = chars.reshape(raw.shape)
        # Number 0 is the padding; it stands in no pattern.
        self.chars = chars.astype(np.int64) if letters.size and letters[0] == -1 else chars + 1
        self.size = lengths(strings)
        self.width = int(self.chars.max(initial=0)) + 1
        self.row = np.full(len(strings), -1)
        self.row[patterns] = np.arange(len(patterns))
        longest = int(self.size[patterns].max(initial=0))
        self.bits = np.zeros((max(1, -(-longest // BITS)), len(patterns), self.width), np.uint64)
        for i in range(longest):
            at = np.flatnonzero(self.size[patterns] > i)
            self.bits[i // BITS, at, self.chars[patterns[at], i]] |= np.uint64(1) << np.uint64(i % BITS)


def common(batch: Batch, p: np.ndarray, t: np.ndarray, words: int) -> np.ndarray:
    """What pairs have in common, patterns having up to ``words`` numbers: the zeros among the bits, when all is read."""
    v = np.full((words, len(p)), 2**64 - 1, np.uint64)
    at = batch.row[p] * batch.width
    for j in range(int(batch.size[t].max(initial=0))):
        here, carry = at + batch.chars[t, j], None
        for k in range(words):
            u = v[k] & batch.bits[k].reshape(-1)[here]
            total = v[k] + u
            if words > 1:
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            v[k] = total | (v[k] - u)
    left = batch.size[p][None, :] - BITS * np.arange(words)[:, None]
    full = np.where(left >= BITS, np.uint64(2**64 - 1), (np.uint64(1) << np.clip(left, 0, BITS - 1).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & full).sum(axis=0, dtype=np.int64)


def lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Pairs are taken in order of length, so a batch has little padding."""
    strings, (ia, ib) = numbered(a, b)
    size = lengths(strings)
    p, t = np.where(size[ia] <= size[ib], ia, ib), np.where(size[ia] <= size[ib], ib, ia)
    out = np.zeros(len(a), np.int64)
    words = np.maximum(1, -(-size[p] // BITS))
    order = np.lexsort((size[t], words))
    for w in np.unique(words):
        own = order[words[order] == w]
        batch = Batch(strings, np.unique(p[own]))
        for at in range(0, len(own), LANES):
            part = own[at : at + LANES]
            out[part] = common(batch, p[part], t[part], int(w))
    return out


def share(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    """200 * common / total, 100 where both are empty."""
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def lengths(strings: list[str]) -> np.ndarray:
    return np.fromiter(map(len, strings), np.int64, len(strings))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    return share(lcs(a, b), lengths(a) + lengths(b)) if a else np.empty(0)


def combed(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each place in ``t`` the place in ``t`` at whose top the strand that ends there starts, below 0 if it starts in ``p``.

    A column is a pair. The strand from the left is kept for each character of p, from its last to its first.
    Strands are numbered in as few bytes as they need, most often one.
    """
    m, n = len(p), len(t)
    kind = np.uint8 if m + n <= 2**8 else np.int16 if m + n < 2**15 else np.int32
    left = np.repeat(np.arange(m, dtype=kind)[:, None], p.shape[1], axis=1)
    top = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], p.shape[1], axis=1)
    p = np.ascontiguousarray(p[::-1])
    for d in range(m + n - 1):
        first, last = max(0, d - n + 1), min(m - 1, d)
        i, j = slice(m - 1 - last, m - first), slice(d - last, d - first + 1)
        a, b = left[i], top[j]
        turned = (p[i] == t[j]) | (a > b)  # the strands don't cross here: equal characters, or they have crossed before
        change = (a ^ b) & -turned.view(np.uint8).astype(kind, copy=False)
        a ^= change
        b ^= change
    kind = np.int16 if kind == np.uint8 else kind
    return top.astype(kind) - kind(m)


def best_windows(p: np.ndarray, t: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best ratio of each pair over windows as long as p, or cut off at an end of t; ``m`` and ``n`` are the true lengths.

    The strands inside a window follow from those inside the window before: the one that starts at the
    character left behind may go, the one that ends at the new character may come.
    """
    starts, size = combed(p, t), len(t)
    kind = starts.dtype.type
    at, m, n = np.arange(size, dtype=kind)[:, None], m.astype(kind), n.astype(kind)
    ends = np.full((size + 1, p.shape[1]), 2 * size, np.int32)
    np.put_along_axis(ends, np.where(starts >= 0, starts, size).astype(np.int64), np.arange(size)[:, None], axis=0)
    new = np.full((size + len(p), p.shape[1]), -1, kind)
    new[:size] = starts
    # Windows that end after 1, 2, ... characters, then those that begin at 1, 2, ...
    within = np.cumsum(starts >= 0, axis=0, dtype=kind)
    change = (np.take_along_axis(new, (at + m).astype(np.int64), axis=0) > at).astype(kind) - (ends[:size] < at + m)
    moved = np.take_along_axis(within, m[None, :].astype(np.int64) - 1, axis=0) + np.cumsum(change, axis=0, dtype=kind)
    head = np.where(at < m, 200.0 * (at + 1 - within) / (m + at + 1), 0.0).max(axis=0)
    # What lies behind the end of t is common to nothing, so it may be in the window or not.
    begin = at[1:]
    shared, length = np.minimum(begin + m, kind(size)) - begin - moved[:-1], np.minimum(begin + m, n) - begin
    rest = np.where(length > 0, 200.0 * shared / (m + np.maximum(length, 1)), 0.0).max(axis=0, initial=0.0)
    return np.maximum(head, rest)


def window_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of the shorter string with any window of the longer one, windows at its ends included."""
    strings, (ia, ib) = numbered(a, b)
    size = lengths(strings)
    equal = np.flatnonzero((size[ia] == size[ib]) & (ia != ib))
    p, t = np.where(size[ia] <= size[ib], ia, ib), np.where(size[ia] <= size[ib], ib, ia)
    # Of strings of equal length either may be the pattern.
    p, t, owner = np.concatenate([p, t[equal]]), np.concatenate([t, p[equal]]), np.concatenate([np.arange(len(a)), equal])
    found = np.zeros(len(p))
    batch = Batch(strings, np.zeros(0, np.int64))
    kind = np.uint8 if batch.width < 2**8 else np.uint16 if batch.width < 2**16 - 1 else np.int32
    letters = batch.chars.astype(kind)
    order = np.flatnonzero(size[p] > 0)
    band = size[p[order]] // 8
    order = order[np.lexsort((size[t[order]], band))]
    band, at = np.sort(band), 0
    while at < len(order):
        first = int(size[p[order[at]]] + size[t[order[at]]])
        end = min(at + max(1, COMBED // first), int(np.searchsorted(band, band[at], "right")))
        part = order[at:end]
        # Titles of much greater length wait for a batch of their own.
        part = part[: int(np.searchsorted(size[t[part]], size[t[part[0]]] * 1.25 + 8, "right"))]
        at += len(part)
        pp, tt = p[part], t[part]
        pattern = letters[pp, : size[pp].max()].T.copy()
        pattern[np.arange(len(pattern))[:, None] >= size[pp]] = kind(batch.width)  # equal to nothing
        found[part] = best_windows(pattern, letters[tt, : size[tt].max()].T.copy(), size[pp], size[tt])
    out = np.zeros(len(a))
    np.maximum.at(out, owner, found)
    return out


class Tokens:
    """Sorted tokens of strings, made once for each."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[str, frozenset[str], str]] = {}

    def of(self, s: str) -> tuple[str, frozenset[str], str]:
        """All tokens sorted and joined, their set, and the set sorted and joined."""
        if s not in self.kept:
            words = sorted(s.split())
            self.kept[s] = " ".join(words), frozenset(words), " ".join(sorted(set(words)))
        return self.kept[s]


def set_ratios(a: list[tuple], b: list[tuple]) -> np.ndarray:
    """Token set ratios: what both share counts as one string, with and without what each has besides."""
    only_a, only_b, both = [], [], []
    for (_, x, joined_x), (_, y, joined_y) in zip(a, b, strict=True):
        if x.isdisjoint(y):
            both.append(0)
            only_a.append(joined_x)
            only_b.append(joined_y)
        else:
            both.append(len(" ".join(x & y)))
            only_a.append(" ".join(sorted(x - y)))
            only_b.append(" ".join(sorted(y - x)))
    if not both:
        return np.empty(0)
    s, la, lb = np.asarray(both), lengths(only_a), lengths(only_b)
    gap = (s > 0).astype(int)
    with_a, with_b = s + gap + la, s + gap + lb
    apart = la + lb - 2 * lcs(only_a, only_b)
    rest = lambda d, total: np.where(total > 0, 100.0 - 100.0 * d / np.maximum(total, 1), 100.0)
    out = rest(apart, with_a + with_b)
    partly = np.maximum(rest(gap + la, s + with_a), rest(gap + lb, s + with_b))
    out = np.where(s > 0, np.maximum(out, partly), out)
    return np.where((s > 0) & ((la == 0) | (lb == 0)), 100.0, out)


def weighted_ratios(a: list[str], b: list[str], tokens: Tokens | None = None) -> np.ndarray:
    """The weighted ratio of each pair, 0 to 100."""
    if not a:
        return np.empty(0)
    tokens = tokens or Tokens()
    la, lb = lengths(a), lengths(b)
    out = ratios(a, b)
    times = np.maximum(la, lb) / np.maximum(1, np.minimum(la, lb))
    pick = lambda xs, at: [xs[i] for i in at]
    alike = np.flatnonzero(times < 1.5)
    ta, tb = [tokens.of(a[i]) for i in alike], [tokens.of(b[i]) for i in alike]
    if len(alike):
        by_token = np.maximum(ratios([t[0] for t in ta], [t[0] for t in tb]), set_ratios(ta, tb))
        out[alike] = np.maximum(out[alike], 0.95 * by_token)
    unlike = np.flatnonzero(times >= 1.5)
    if len(unlike):
        scale = np.where(times[unlike] <= 8, 0.9, 0.6)
        ta, tb = [tokens.of(a[i]) for i in unlike], [tokens.of(b[i]) for i in unlike]
        common = np.fromiter((not x[1].isdisjoint(y[1]) for x, y in zip(ta, tb, strict=True)), bool, len(unlike))
        part = np.where(common, 100.0, 0.0)
        # With a token in common, a window counts only above 95, which strings under 11 characters reach by containment alone.
        short = np.minimum(la, lb)[unlike]
        windows = np.zeros(len(unlike))
        look = np.flatnonzero(~common | (short >= 11))
        windows[look] = window_ratios(pick(a, unlike[look]), pick(b, unlike[look]))
        inside = np.flatnonzero(common & (short < 11))
        windows[inside] = [100.0 if (a[i] in b[i] or b[i] in a[i]) else 0.0 for i in unlike[inside]]
        apart = np.flatnonzero(~common)
        part[apart] = window_ratios([ta[i][0] for i in apart], [tb[i][0] for i in apart])
        again = [i for i in apart if ta[i][0] != ta[i][2] or tb[i][0] != tb[i][2]]
        if again:
            part[again] = np.maximum(part[again], window_ratios([ta[i][2] for i in again], [tb[i][2] for i in again]))
        out[unlike] = np.maximum(out[unlike], np.maximum(scale * windows, 0.95 * scale * part))
    return np.where((la == 0) | (lb == 0), 0.0, out)


def _column(of):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
        distinct = list(dict.fromkeys(pairs))
        found = dict(zip(distinct, (of([p[0] for p in distinct], [p[1] for p in distinct]) / 100).tolist(), strict=True))
        return pd.Series([found[p] for p in pairs], dtype="float64")

    return run


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (len a + len b), 0 to 1; null counts as empty."""
    return _column(ratios)(a, b)


@F.pandas_udf(T.DoubleType())
def wratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The weighted ratio, 0 to 1; 0 if a side is empty or null."""
    return _column(weighted_ratios)(a, b)
