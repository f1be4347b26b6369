import pytest

from linkloom.llm import minhash
from linkloom.llm.components import components
from linkloom.llm.minhash import near_duplicates
from tests.llm.conftest import ODD, prose


def brute(docs, words, similarity=80):
    sets = {}
    for i, t in docs:
        ws = (t or "").lower().split()
        k = min(words, len(ws))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, **how).collect()}


def family(rnd, n, rate):
    base = prose(rnd, 120).split()
    return [" ".join(rnd.choice("abc") + w if rnd.random() < rate else w for w in base) for _ in range(n)]


def test_equals_brute_force(make, rnd):
    texts = [t for rate in (0.0, 0.02, 0.04, 0.05, 0.06, 0.08) for t in family(rnd, 14, rate)] + [prose(rnd, 50) for _ in range(10)]
    docs = list(enumerate(texts))
    rnd.shuffle(docs)
    for words in (2, 5):
        assert result(make(*docs), words=words) == brute(docs, words)


def test_blocks_of_a_bucket(make, rnd, monkeypatch):
    """Links between components are found across the blocks of a large bucket too."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    docs = list(enumerate(family(rnd, 40, 0.05)))
    assert result(make(*docs), words=2) == brute(docs, 2)


def test_cases(make):
    got = result(make("A b\tc d", "a B c\nd", None, "", " ", "word", "WORD", "É", "é"), words=2)
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (1, 6, True), 7: (1, 6, False), 8: (1, 8, True), 9: (1, 9, True)}


def test_odd_tables(make):
    docs = make(*ODD, extra=True)
    got = result(docs)
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[6] == (1, 6, True)
    assert result(docs.limit(0)) == {}
    assert near_duplicates(docs.unionAll(docs)).count() == 2 * len(ODD)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100 + i, 100) for i in range(1, 40)] + [(60, 61), (62, 61), (61, 60), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in range(100, 140)} == {100} and {got[i] for i in (60, 61, 62)} == {60}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shared_and_missing_ids(make, rnd):
    """Rows of one doc_id are one document; rows without one stay unless a document has their set."""
    a, b, c = (prose(rnd, 40) for _ in range(3))
    docs = make((1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (None, b), (None, "no such text"), (None, "no such text"), (8, None))
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (8, 8, True), (9, 9, True), (9, 9, True)]
    kept = minhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(0, "no such text"), (1, a), (8, ""), (9, c)])
    two = make((4, a), (4, b))
    assert minhash.without_near_copies(two).count() == 1 and minhash.without_near_copies(make(*ODD, extra=True)).count() == len(ODD) - 1
