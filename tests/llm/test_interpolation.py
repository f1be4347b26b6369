import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkloom.llm.interpolation import FREQUENCIES, grams, packed, scores, unpacked
from tests.llm.conftest import ODD, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), " end"]


def counts(texts, order):
    gram, context = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for t in texts:
        ts = [" begin"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(ts)):
            for k in range(order):
                gram[k][tuple(ts[i - k : i + 1])] += 1
                context[k][tuple(ts[i - k : i])] += 1
    return gram, context


def estimates(text, gram, context, order):
    ts = [" begin"] * (order - 1) + tokens(text)
    for i in range(order - 1, len(ts)):
        seen = max([k for k in range(1, order) if context[k][tuple(ts[i - k : i])]], default=0)
        c = context[seen][tuple(ts[i - seen : i])]
        p = [gram[k][tuple(ts[i - k : i + 1])] / max(1, context[k][tuple(ts[i - k : i])]) for k in range(order)]
        yield seen * FREQUENCIES + (c.bit_length() if seen else 0), [1 / (len(gram[0]) + 1), *p]


def em(events, order):
    """The weights by the textbook: tokens' shares go to the estimates that explain them; the smoothing is the operator's."""
    can = {b: [k <= 1 + b // FREQUENCIES for k in range(order + 1)] for b in range(order * FREQUENCIES)}
    weights, before = {b: [x / sum(c) for x in c] for b, c in can.items()}, -math.inf
    for _ in range(40):
        share, fit = defaultdict(lambda: [0.0] * (order + 1)), []
        for b, p in events:
            parts = [w * x for w, x in zip(weights[b], p, strict=True)]
            fit.append(math.log(sum(parts)))
            share[b] = [s + x / sum(parts) for s, x in zip(share[b], parts, strict=True)]
        total = [sum(s[k] for s in share.values()) for k in range(order + 1)]
        for b, c in can.items():
            prior = [x / sum(c) * (t / sum(total) + 1e-9) for x, t in zip(c, total, strict=True)]
            new = [s + 10 * x / sum(prior) for s, x in zip(share[b], prior, strict=True)]
            weights[b] = [x / sum(new) for x in new]
        fit = math.fsum(fit) / len(fit)
        if fit - before < 1e-5:
            break
        before = fit
    return weights


def brute(docs, order, deleted):
    number = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    train = [(i, t) for i, t in docs if number(i) % 7 != 2]
    kept = counts([t for i, t in train if number(i) // 7 % deleted], order)
    weights = em([e for i, t in train if number(i) // 7 % deleted == 0 for e in estimates(t, *kept, order)], order)
    gram, context = counts([t for _, t in train], order)
    n, v = sum(gram[0].values()), len(gram[0])
    for i, t in docs:
        c = [gram[0][(x,)] for x in tokens(t)]
        score = math.fsum(math.log10(sum(w * x for w, x in zip(weights[b], p, strict=True))) for b, p in estimates(t, gram, context, order))
        yield (i, number(i) % 7 == 2, len(c), sum(x > 0 for x in c), n), math.fsum(math.log10((x + 1) / (n + v + 1)) for x in c), score


@pytest.mark.parametrize(("order", "size", "ranges"), [(2, 1 << 20, 1 << 21), (2, 50, 100), (3, 300, 1000), (1, 100, 1000)])
def test_equals_brute_force(make, rnd, order, size, ranges):
    common = prose(rnd, 60)
    docs = [*enumerate([*ODD, "A b\x85c É É \0end end \0begin", common, *[prose(rnd, rnd.choice([3, 40, 200])) + rnd.choice(["", common]) for _ in range(60)]], 1)]
    docs += [(5, docs[-1][1]), (None, "w1 w2")]
    got = scores(make(*docs, extra=True), order=order, deleted=4, size=size, range_size=ranges)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0][0] is not None, r[0][0] or 0, r[0])
    got = sorted(((tuple(r)[:5], r["base_score"], r["score"]) for r in got.collect()), key=key)
    want = sorted(brute(docs, order, 4), key=key)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9) and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-6)


def test_better_than_the_base_on_held_out_texts(make, rnd):
    phrases = [" ".join(f"p{i}x{j}" for j in range(6)) for i in range(80)]
    got = scores(make(*[" ".join(rnd.choices(phrases, k=20)) for _ in range(150)])).where("held_out").collect()
    assert len(got) > 10 and all(r["score"] > 0.6 * r["base_score"] for r in got)


def test_a_text_of_many_blocks(make):
    text = " ".join(f"w{i % 7919}" for i in range(400_000))
    whole = {r["doc_id"]: r for r in scores(make((1, text), (3, "w1 w2"))).collect()}
    parts = {r["doc_id"]: r for r in scores(make((1, text), (3, "w1 w2")), size=1000, range_size=10_000).collect()}
    assert whole[1]["n_tokens"] == 400_001 and whole[1]["train_tokens"] == parts[1]["train_tokens"]
    assert whole[1]["score"] == pytest.approx(parts[1]["score"]) and whole[3]["base_score"] == pytest.approx(parts[3]["base_score"])


def test_nothing_to_learn_from(make):
    assert scores(make()).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert [tuple(r) for r in scores(make((held, "a b"))).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_packing_numbers():
    for x in (np.zeros(0, np.uint64), np.array([1, 2**63, 5], np.uint64), np.arange(1000, dtype=np.int64) - 500):
        assert unpacked(packed(x), x.dtype).tolist() == x.tolist()


def test_different_runs_have_different_hashes():
    words, order = np.arange(1, 6, dtype=np.uint64), 3
    tokens_ = np.array([0, 0, 1, 2, 3, 1, 4], np.uint32)
    found = grams(words, tokens_, np.array([[1, 2, 5]]), order)
    assert len({int(h) for keys, _ in found for h in keys}) == sum(len(keys) for keys, _ in found)
