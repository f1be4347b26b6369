import math
import re
from collections import Counter

import pytest
import xxhash

from linkloom.llm.quality import BUCKETS, SMOOTHING, THRESHOLD, passing, quality
from tests.llm.conftest import ODD, prose


def brute(t):
    t = t or ""
    ws = t.split()
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def junk(rnd, n):
    return " ".join(t + rnd.choice(["###", "$$$", "&&&"]) for t in prose(rnd, n).split())


def test_counts_and_verdicts(spark, make, rnd):
    clean, bad = [prose(rnd, rnd.randint(60, 200)) for _ in range(40)], [junk(rnd, 120) for _ in range(15)]
    loop = ["é b c d " * 30, "the same line\n" * 20, "a|b <c> #1", "a b c a b c", "x y"]
    texts = [*clean, *bad, *loop, *ODD[:5], *ODD[6:]]
    docs = make(*texts, extra=True)
    got = {r["doc_id"]: r for r in quality(docs, spark.createDataFrame([(i,) for i in range(1, 31)], "doc_id long")).collect()}
    for i, t in enumerate(texts, 1):
        assert tuple(got[i][c] for c in COLUMNS) == brute(t), t
    assert all(got[i]["kept"] for i in range(1, 41)) and not any(got[i]["kept"] for i in range(41, len(texts) + 1))
    kept = passing(docs, spark.createDataFrame([(i,) for i in range(1, 31)], "doc_id long"))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(1, 41))


def test_odd_tables(spark, make):
    none = spark.createDataFrame([], "doc_id long")
    docs = make(*ODD, extra=True)
    assert not any(r["kept"] for r in quality(docs, none).collect())
    assert quality(docs.unionAll(docs), none).count() == 2 * len(ODD)
    assert quality(docs.limit(0), none).count() == 0
    long = quality(make("alpha beta gamma delta " + " ".join(f"w{i}" for i in range(30_000))), none).first()
    assert long["n_words"] == 30_004 and long["n_repeat_words"] == 0 and long["kept"]


def test_counts_of_long_texts(spark, make, rnd):
    """Of the 30,000-word text too, and of one that repeats windows here and there."""
    texts = [*ODD, prose(rnd, 8_000), ("a b c d e f g h i j " * 3 + prose(rnd, 500)) * 4]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in quality(make(*texts), spark.createDataFrame([], "doc_id long")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts, 1)}


def test_ratios_by_brute_force(spark, make, rnd):
    """n_grams, mean_ratio and the verdict from plain counts; buckets by the same public hash."""
    texts = [*(prose(rnd, 70) for _ in range(12)), *(junk(rnd, 70) for _ in range(6)), *ODD[:5], "é中 a1_b!? " * 20]
    trusted = set(range(1, 9))
    h = lambda data, seed: xxhash.xxh64_intdigest(data, seed)

    def buckets(t):
        tokens = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", t or "")
        for i, a in enumerate(tokens):
            yield h(a.encode(), 42)
            if i + 1 < len(tokens):
                yield h(tokens[i + 1].encode(), h((2).to_bytes(4, "little"), h(a.encode(), 42)))

    place = lambda x: (x - 2**64 if x >= 2**63 else x) % BUCKETS
    own = [[place(x) for x in buckets(t)] for t in texts]
    t, n = Counter(b for i, bs in enumerate(own, 1) if i in trusted for b in bs), Counter(b for bs in own for b in bs)
    share = t.total() / n.total()
    got = {r["doc_id"]: r for r in quality(make(*texts), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    for i, bs in enumerate(own, 1):
        mean = sum(math.log((t[b] + SMOOTHING) / (n[b] * share + SMOOTHING)) for b in bs) / len(bs) if bs else 0.0
        assert got[i]["n_grams"] == len(bs) and got[i]["mean_ratio"] == pytest.approx(mean, abs=1e-9)
        assert got[i]["kept"] == (not brute(texts[i - 1])[-1] and mean >= THRESHOLD)


def test_rows_without_an_id(spark, make, rnd):
    good = prose(rnd, 80)
    docs = make((None, good), (3, good), (3, "too short"), (None, None))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in passing(docs, spark.createDataFrame([(3,)], "doc_id long")).collect()) == [(0, good), (3, good)]
