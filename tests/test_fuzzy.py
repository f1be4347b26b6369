"""The batch scorer against the plain definition, written out pair by pair."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.functions import bounds
from linkloom.functions.bounds import weighted_bounds
from linkloom.functions.fuzzy import lcs, ratios, weighted_ratios, window_ratios


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * plain_lcs(a, b) / n


def partial(a, b):
    p, t = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(p), len(t)
    if not m:
        return 0.0
    windows = [t[:i] for i in range(1, m)] + [t[i : i + m] for i in range(n - m)] + [t[i:] for i in range(n - m, n)]
    best = max(ratio(p, w) for w in windows)
    if m == n and best < 100:
        windows = [p[:i] for i in range(1, m)] + [p[i:] for i in range(m)]
        best = max([best, *(ratio(t, w) for w in windows)])
    return best


def plain(a, b):
    if not a or not b:
        return 0.0
    A, B = a.split(), b.split()
    x, y = set(A), set(B)
    both, ra, rb = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        if both and (not ra or not rb):
            token_set = 100.0
        else:
            s, gap = len(" ".join(both)), 1 if both else 0
            la, lb = s + gap + len(ra), s + gap + len(rb)
            token_set = 100 - 100 * (len(ra) + len(rb) - 2 * plain_lcs(ra, rb)) / (la + lb) if la + lb else 100.0
            if s:
                token_set = max(token_set, 100 - 100 * (gap + len(ra)) / (s + la), 100 - 100 * (gap + len(rb)) / (s + lb))
        return max(ratio(a, b), 0.95 * max(ratio(" ".join(sorted(A)), " ".join(sorted(B))), token_set))
    scale = 0.9 if times <= 8 else 0.6
    if both:
        token = 100.0
    else:
        token = partial(" ".join(sorted(A)), " ".join(sorted(B)))
        if len(A) > len(x) or len(B) > len(y):
            token = max(token, partial(" ".join(sorted(x)), " ".join(sorted(y))))
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * token)


TITLES = st.lists(st.text("abcde", min_size=1, max_size=6), min_size=0, max_size=6).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(TITLES, TITLES), min_size=1, max_size=20))
def test_equal_to_the_definition(pairs):
    a, b = zip(*pairs, strict=True)
    np.testing.assert_allclose(weighted_ratios(list(a), list(b)), [plain(x, y) for x, y in pairs], atol=1e-9)


def test_known_scores():
    assert weighted_ratios(["dune"], ["dune messiah"])[0] == 90.0
    assert round(weighted_ratios(["and then there were none"], ["hands on machine learning with scikit learn keras and tensorflow"])[0], 3) == 85.5
    assert list(weighted_ratios(["", "a"], ["a", ""])) == [0.0, 0.0]
    assert list(ratios(["", "ab"], ["", "b"])) == [100.0, 200 / 3]


def test_lcs_of_batches():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcé中") for _ in range(rnd.randint(0, 30)))
    a, b = [word() for _ in range(400)], [word() for _ in range(400)]
    assert list(lcs(a, b)) == [plain_lcs(x, y) for x, y in zip(a, b, strict=True)]


def test_long_strings():
    """Patterns around and beyond the 64 characters that one number holds."""
    rnd = random.Random(4)
    title = lambda n: " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(n))[: rnd.choice([63, 64, 65, 90, 130])]
    pairs = [(title(rnd.randint(1, 26)), title(rnd.randint(1, 26))) for _ in range(60)]
    pairs += [(a, a[5:] + "x") for a, _ in pairs[:10]] + [(a[:64], a[-64:]) for a, _ in pairs[:10]]
    a, b = zip(*pairs, strict=True)
    np.testing.assert_allclose(weighted_ratios(list(a), list(b)), [plain(x, y) for x, y in pairs], atol=1e-9)
    assert list(lcs(list(a), list(b))) == [plain_lcs(x, y) for x, y in pairs]


def test_windows_where_a_byte_ends():
    """Strands or letters that just fit a byte, and just don't."""
    rnd = random.Random(5)
    text = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    for letters in ("abcdé", "".join(map(chr, range(0x100, 0x100 + 60)))):
        for n in (154, 155, 156, 157, 158):
            a, b = [text(100, letters), text(100, letters)], [text(n, letters), text(n - 3, letters)]
            np.testing.assert_allclose(window_ratios(a, b), [partial(x, y) for x, y in zip(a, b, strict=True)], atol=1e-9)
    for size in (253, 254, 255, 256, 257):
        letters = list(map(chr, range(0x400, 0x400 + size)))
        rnd.shuffle(letters)
        a, b = ["".join(letters[-40:])], ["".join(letters)]
        assert window_ratios(a, b)[0] == 100.0
        changed = [a[0][:20] + a[0][22:] + a[0][:2]]
        np.testing.assert_allclose(window_ratios(changed, b), [partial(changed[0], b[0])], atol=1e-9)


LONG = st.lists(st.text("abcdeé", min_size=1, max_size=12), min_size=8, max_size=40).map(lambda ws: " ".join(ws)[:200]).filter(lambda t: len(t) >= 60)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(LONG, LONG | TITLES), min_size=1, max_size=4))
def test_long_titles_equal_the_definition(pairs):
    """60 to 200 characters: several numbers a pattern, with carries."""
    a, b = zip(*[(x.strip(), y.strip()) for x, y in pairs], strict=True)
    np.testing.assert_allclose(weighted_ratios(list(a), list(b)), [plain(x, y) for x, y in zip(a, b, strict=True)], atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(TITLES | LONG, min_size=1, max_size=6), st.lists(TITLES, min_size=1, max_size=6))
def test_bounds_are_never_below(a, b):
    a, b = [" ".join(x.split()) for x in a], [" ".join(x.split()) for x in b]
    exact = weighted_ratios([x for x in a for _ in b], b * len(a)).reshape(len(a), len(b)) / 100
    assert (weighted_bounds(a, b) >= exact).all()


def test_bounds_by_few_features_at_a_time(monkeypatch):
    a, b = ["red ring", "old rod", ""], ["old ring rod", "zz"]
    whole = weighted_bounds(a, b)
    monkeypatch.setattr(bounds, "CELLS", 10)
    np.testing.assert_allclose(weighted_bounds(a, b), whole)
