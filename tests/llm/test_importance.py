import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from linkloom.llm.importance import ranked, resampled, runs
from tests.llm.conftest import ODD, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def brute(docs, aims, percent, least, run, buckets, seed):
    own = [(i, *features(t, run)) for i, t in docs]
    s, t = Counter(f % buckets for _, _, fs in own for f in fs), Counter(f % buckets for x in aims for f in features(x, run)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, fs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f % buckets] for f in fs)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = place
    return [(r[0], *r[2:]) for r in rows]


@pytest.mark.parametrize(("run", "buckets", "percent"), [(1, 10_000, 10), (2, 500, 50), (3, 65_536, 100)])
def test_equals_brute_force(spark, make, rnd, run, buckets, percent):
    texts = [*ODD, "ÀB cd-EF 12\0x", *[prose(rnd, rnd.choice([5, 19, 20, 21, 300])).replace("w1", "W1") for _ in range(80)]]
    docs = [*enumerate(texts, 1), (7, texts[-1]), (None, texts[-2]), (None, texts[-2])]
    aims = [prose(rnd, 200), None, "Ünï w1 w2"]
    got = resampled(make(*docs, extra=True), spark.createDataFrame([(i, a) for i, a in enumerate(aims)], "item_id long, text string"), percent=percent, run=run, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(brute(docs, aims, percent, 20, run, buckets, 2024), key=key)
    # Of rows that share a doc_id and a score either may come first.
    assert [r[:4] for r in got] == [r[:4] for r in want] and sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    assert [r for r in got if r[0] not in (7, None)] == [r for r in want if r[0] not in (7, None)]


def test_a_text_of_many_blocks(spark, make):
    text = " ".join(f"w{i % 977}" for i in range(500_000))
    aims = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = resampled(make((1, text), (2, "w1 w2 " * 20)), aims, run=2).collect()
    assert {(r["doc_id"], r["n_features"], r["weight"]) for r in got} == {(r[0], r[1], r[2]) for r in brute([(1, text), (2, "w1 w2 " * 20)], ["w1 w2 w3"], 10, 20, 2, 10_000, 2024)}


def test_empty(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampled(make(), none).collect() == []
    assert [tuple(r)[:3] for r in resampled(make("a b"), none).collect()] == [(1, 2, 2 * math.floor(1000 * math.log(10_002 / (2 * 10_000))))]


def test_runs():
    values, lengths = runs(np.array([5, 1, 5, 65_535, 5, 1], np.uint16))
    assert values.tolist() == [1, 5, 65_535] and lengths.tolist() == [2, 3, 1]
    assert [len(x) for x in runs(np.zeros(0, np.uint16))] == [0, 0]


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "(id * 7919) % 50 as score").repartition(7)
    got = {r["doc_id"]: r["rank"] for r in ranked(rows, "-score", "doc_id").collect()}
    assert got == {r: i for i, r in enumerate(sorted(range(5000), key=lambda r: (-((r * 7919) % 50), r)), 1)}
