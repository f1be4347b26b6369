"""Search through the stored table of letter groups."""

import random

import pytest

from linkloom.operators.search import index_catalog, open_index, search_catalog


@pytest.fixture(scope="module")
def books():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    return [(i, "The " + " ".join(word() for _ in range(rnd.randint(0, 4))) if i % 9 else None, f"{word().upper()} {word()}" if i % 7 else "") for i in range(300)]


def test_equals_a_scan(spark, books, tmp_path):
    catalog = spark.createDataFrame(books, "book_id long, title string, author string")
    rnd = random.Random(9)
    texts = ["", "  ", None, "\t\n", "a", "É", "the", "THE ", "the a", "zzz", "the zz", "\u00a0abc\n", *["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 6))) for _ in range(60)]]
    texts += [b[1][2:9] for b in books[1:20] if b[1]] + [b[2] for b in books[20:30]]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")
    want = set()
    for i, q in enumerate(texts):
        q = (q or "").strip().lower()
        hits = [b for b, t, a in books if q and (q in (t or "").lower() or q in a.lower())]
        want |= {(i, r, b) for r, b in enumerate(hits[:5], 1)}
    index_catalog(catalog, str(tmp_path / "index"))
    for source in (catalog, open_index(spark, str(tmp_path / "index"))):
        assert {tuple(r) for r in search_catalog(queries, source, 5).collect()} == want


def test_reads_its_own_groups_only(spark, books, tmp_path, capsys):
    index = index_catalog(spark.createDataFrame(books, "book_id long, title string, author string"), str(tmp_path / "index"))
    found = search_catalog(spark.createDataFrame([(1, "the abé")], "query_id long, q string"), index)
    found.explain("formatted")
    plan = capsys.readouterr().out
    scan = plan[plan.index("index/postings") :]
    scan = scan[: scan.index("ReadSchema")]
    assert "PartitionFilters: [isnotnull(part" in scan or "PartitionFilters: [part" in scan
    assert "EqualTo(gram," in scan or "In(gram" in scan
    # The way in isn't a group that every title has.
    assert "EqualTo(gram,the)" not in scan and "EqualTo(gram, the)" not in scan
