import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.config import MatchConfig
from linkloom.functions.fuzzy import ratios, weighted_ratios
from linkloom.operators import matching
from linkloom.operators.lifecycle import apply_review_actions, auto_confirm, checked_actions, edit_library, retried, route_reads
from linkloom.operators.matching import match_reads
from linkloom.sources.catalog import RESPONSE

BOOK = "book_id long, title string, author string, alt_titles array<string>, year int, series string, spine_color string"
READ = "read_id long, title string, author string, spine_color string"


def catalog(spark, *rows):
    return spark.createDataFrame([(i, t, a, alts, None, "", color) for i, (t, a, alts, color) in enumerate(rows, 1)], BOOK)


def matched(spark, cat, *reads, **how):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(reads)], READ)
    return {r["read_id"]: r for r in match_reads(df, cat, **how).collect()}


DUNE = (("Dune", "Frank Herbert", [], ""), ("Dune Messiah", "Frank Herbert", [], ""))


def test_substring_trap(spark):
    got = matched(spark, catalog(spark, *DUNE), ("Dune", "Frank Herbert", None), ("Dune Messiah", "Frank Herbert", None))
    assert got[0]["candidates"][0]["title"] == "Dune" and got[0]["match_status"] == "needs_review" and got[0]["margin"] == pytest.approx(0.075)
    assert got[1]["candidates"][0]["title"] == "Dune Messiah"


def test_shared_titles_and_editions(spark):
    power = catalog(spark, ("The Power", "Naomi Alderman", [], ""), ("The Power", "Rhonda Byrne", None, ""))
    got = matched(spark, power, ("The Power", "Naomi Alderman", None), ("The Power", None, None))
    assert got[0]["match_status"] == "auto_added" and got[0]["margin"] >= 0.12 and got[0]["chosen_book"] == 1
    assert got[1]["match_status"] == "needs_review" and got[1]["margin"] == 0 and got[1]["candidates"][0]["book_id"] == 1
    twice = catalog(spark, ("Fahrenheit 451", "Ray Bradbury", [], ""), ("Fahrenheit 451", "Ray Bradbury", [], ""))
    got = matched(spark, twice, ("Fahrenheit 451", "Ray Bradbury", None))
    assert got[0]["match_status"] == "needs_review" and got[0]["margin"] == 0 and got[0]["confidence"] >= 0.9


def test_thresholds(spark):
    one = catalog(spark, ("Dune", "Frank Herbert", [], ""))
    got = matched(spark, one, ("Completely Different Title Xyz", "Nobody Real", None), ("", None, None), ("Dune", None, None), (None, None, None), ("  ", "x", None), ("!!", "Frank Herbert", None))
    assert got[0]["match_status"] == "unmatched" and got[0]["margin"] is None and got[0]["candidates"]
    for i in (1, 3, 4):
        assert got[i]["match_status"] == "unmatched" and got[i]["confidence"] is None and not got[i]["candidates"]
    assert got[2]["confidence"] == pytest.approx(0.85) and got[2]["match_status"] != "auto_added"
    assert got[5]["confidence"] == pytest.approx(0.25) and got[5]["candidates"]


def test_alternates(spark):
    cat = catalog(spark, ("Harry Potter and the Philosopher's Stone", "J.K. Rowling", ["Harry Potter and the Sorcerer's Stone"], ""), ("Northern Lights", "Philip Pullman", ["The Golden Compass"], ""))
    got = matched(spark, cat, ("Harry Potter and the Sorcerer's Stone", "Rowling, J. K.", None), ("The Golden Compass", "Philip Pullman", None))
    assert [got[i]["candidates"][0]["book_id"] for i in (0, 1)] == [1, 2]
    assert all(got[i]["candidates"][0]["title_score"] > 0.95 for i in (0, 1))


@pytest.mark.parametrize(("colors", "read", "first"), [(("black", "purple"), "purple", 2), (("black", "purple"), None, 1), (("purple", "purple"), "purple", 1), (("", ""), "purple", 1)])
def test_color_breaks_ties_only(spark, colors, read, first):
    cat = catalog(spark, ("Dune", "Frank Herbert", [], colors[0]), ("Dune", "Frank Herbert", [], colors[1]))
    got = matched(spark, cat, ("Dune", "Frank Herbert", read))[0]
    assert got["candidates"][0]["book_id"] == first and got["match_status"] == "needs_review" and got["margin"] == 0


def test_blocked_mode_decides_alike(spark):
    names = ["Ann Lee", "Lee, A.", "Bo Leigh", "Carla Månsson", "C. Manson", None, "Dee Moor", "D. Moore"]
    titles = ["The Long Road", "Long Road", "A Short Road Home", "Winter", "Winter Light", "Summer"]
    cat = catalog(spark, *[(t, a, [], "") for t in titles for a in names])
    reads = [(t, a, None) for t in [*titles, "Wintre", "Long Raod"] for a in [*names, "Ann Leee"]]
    exact, blocked = matched(spark, cat, *reads), matched(spark, cat, *reads, mode="blocked")
    auto = lambda got: {i: r["chosen_book"] for i, r in got.items() if r["match_status"] == "auto_added"}
    assert auto(exact) == auto(blocked)
    for i in auto(exact):
        assert blocked[i]["margin"] >= exact[i]["margin"] - 1e-12


def test_config_and_empty(spark):
    with pytest.raises(ValueError, match="two candidates"):
        match_reads(spark.createDataFrame([], READ), catalog(spark, *DUNE), MatchConfig(candidates=1))
    assert matched(spark, catalog(spark, *DUNE)) == {}
    got = matched(spark, spark.createDataFrame([], BOOK), ("Dune", "x", None))
    assert got[0]["match_status"] == "unmatched" and got[0]["candidates"] in (None, [])


def test_routing(spark):
    rows = [(1, "Dune", "Frank Herbert", "red", True, False, "ok"), (2, None, None, None, False, False, "unreadable"), (3, None, None, None, False, False, "failed"), (4, None, None, "blue", False, True, "not_a_book"), (5, "Dune", None, None, False, False, "duplicate"), (6, "Dune", None, None, None, False, "ok")]
    reads = spark.createDataFrame(rows, "read_id long, title string, author string, spine_color string, readable boolean, not_a_book boolean, status string")
    got = {r["read_id"]: r for r in route_reads(reads, catalog(spark, DUNE[0])).collect()}
    assert [got[i]["status"] for i in range(1, 7)] == ["auto_added", "unreadable", "failed", "discarded", "discarded", "needs_review"]
    assert got[4]["spine_color"] == "blue" and got[5]["title"] == "Dune" and got[4]["candidates"] == []


def test_retry(spark):
    """A crop with a picture is read and matched again; one without is refused."""
    actions = spark.createDataFrame([(1, 10, "retry", True), (2, 11, "retry", False)], "action_id long, detection_id long, action string, has_crop boolean").withColumns({c: F.lit(None).cast("string") for c in ("custom_title", "custom_author")}).withColumn("book_id", F.lit(None).cast("long"))
    cat = catalog(spark, DUNE[0])
    detections = spark.createDataFrame([(10, 1, None), (11, 1, None)], "detection_id long, scan_id long, created_at timestamp")
    reads = spark.createDataFrame([(i, "Dune", "Frank Herbert", None, True, False, "ok") for i in (10, 11)], "detection_id long, title string, author string, spine_color string, readable boolean, not_a_book boolean, status string")
    got = retried(detections, checked_actions(actions, cat), reads, cat)
    assert [(r["detection_id"], r["status"], r["chosen_book"]) for r in got.collect()] == [(10, "auto_added", 1)]
    assert auto_confirm(got).count() == 1


def test_spoilers_without_an_author_or_a_common_word(spark):
    """A row without an author comes close enough to stop an automatic match, though no word is the same."""
    cat = catalog(spark, ("abcdefghij", "Ann Lee", [], ""), ("abcdefghil", None, [], ""))
    for mode in ("exact", "blocked"):
        got = matched(spark, cat, ("abcdefghik", "Ann Lee", None), mode=mode)[0]
        assert got["match_status"] == "needs_review" and got["margin"] == pytest.approx(0.075), mode


def test_blocked_equals_exact_at_random(spark, monkeypatch):
    """Typos, swapped and near authors, rows without authors, hot titles and surnames, small blocks: the same matches."""
    import random

    monkeypatch.setattr(matching, "ROWS", 16)
    monkeypatch.setattr(matching, "READ_TITLES", 8)
    monkeypatch.setattr(matching, "BOOK_TITLES", 8)
    rnd = random.Random(6)
    words = ["the", "of", *("".join(rnd.choice("bcdfgklmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(60))]
    title = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    typo = lambda t: t if rnd.random() < 0.5 or len(t) < 4 else (t[: (i := rnd.randrange(len(t)))] + rnd.choice(["", "x"]) + t[i + 1 :])
    people = ["Ann Lee", "Lee, A.", "B. Lee", "Carla Månsson", "C. Manson", "D. Montgomery", "Dee Montgomerie", "E. Quist"]
    rows = [(title() if rnd.random() < 0.8 else "Hot Title", rnd.choice([*people, None]), [title()] if rnd.random() < 0.3 else [], "") for _ in range(90)]
    cat = catalog(spark, *rows)
    reads = [(typo(t), typo(a) if a else rnd.choice(people), None) for t, a, *_ in rows] + [(typo(t), None, None) for t, *_ in rows[:10]]
    exact, blocked = matched(spark, cat, *reads), matched(spark, cat, *reads, mode="blocked")
    auto = lambda got: {i: (r["chosen_book"], r["confidence"]) for i, r in got.items() if r["match_status"] == "auto_added"}
    assert auto(exact) == auto(blocked) and len(auto(exact)) > 15
    assert all(blocked[i]["margin"] >= exact[i]["margin"] for i in auto(exact))
    # The tiles of the exact mode against plain loops over all pairs.
    from linkloom.functions.fuzzy import weighted_ratios
    from linkloom.operators.matching import AuthorScores, names, prepare

    monkeypatch.undo()
    keys = prepare(cat).keys.toArrow()
    spelled = matching.spelled(spark.createDataFrame([(t, a) for t, a, _ in reads], "title string, author string")).toArrow()
    by = {(t, a): (n, who) for t, a, n, who in zip(*(spelled[c].to_pylist() for c in ("title", "author", "norm_title")), names(spelled["name"]), strict=True)}
    books = list(zip(keys["book_id"].to_pylist(), keys["book_title"].to_pylist(), names(keys["row_name"]), strict=True))
    for i, (t, a, _) in enumerate(reads):
        n, who = by[t, a]
        best = {}
        for (b, bt, person), w in zip(books, weighted_ratios([n] * len(books), [x[1] for x in books]) / 100, strict=True):
            y = AuthorScores([who], [person], MatchConfig()).row(0)[0]
            best[b] = max(best.get(b, -1), min(w, 0.85) if y != y else 0.75 * w + 0.25 * y)
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [(c["book_id"], pytest.approx(c["score"])) for c in exact[i]["candidates"]] == want


def test_readable_books_are_never_discarded(spark):
    """A model that contradicts itself doesn't lose a book that could be read; from its text to the detection."""
    from linkloom.operators.responses import align_reads

    text = '[{"index": 1, "title": "Dune", "author": "Frank Herbert", "readable": true, "not_a_book": true}, {"index": 2, "title": null, "readable": false, "not_a_book": true}]'
    reads = align_reads(spark.createDataFrame([(1, 2, text, False, None, False)], RESPONSE))
    got = {r["slot"]: r for r in route_reads(reads, catalog(spark, DUNE[0])).collect()}
    assert got[1]["status"] == "auto_added" and got[1]["chosen_book"] == 1 and got[1]["not_a_book"]
    assert got[2]["status"] == "discarded"


ACTION = "action_id long, detection_id long, action string, book_id long, custom_title string, custom_author string, has_crop boolean, ts long"


def test_actions_in_time_order(spark):
    """Discarding keeps the book that was confirmed; a retry replaces what was matched; the latest action names the status."""
    cat = catalog(spark, *DUNE)
    acts = [(1, 10, "confirm", 2), (2, 10, "discard", None), (3, 11, "discard", None), (4, 11, "confirm", 2), (5, 12, "confirm", 2), (6, 12, "retry", None), (7, 13, "retry", None), (8, 13, "discard", None), (9, 14, "retry", None), (10, 14, "confirm", 2), (11, 15, "discard", None), (12, 16, "confirm", 99)]
    rows = [(i, d, a, b, None, None, True, 5) for i, d, a, b in acts]
    checked = checked_actions(spark.createDataFrame(rows, ACTION), cat)
    read = "detection_id long, title string, author string, spine_color string, readable boolean, status string"
    reads = spark.createDataFrame([(i, "Dune Messiah", "Frank Herbert", None, True, "ok") for i in range(10, 18)], read)
    before = route_reads(spark.createDataFrame([(i, "Dune", None, "red", True, "ok") for i in range(10, 18)], read).withColumns({"scan_id": F.lit(1), "created_at": F.lit(None).cast("timestamp")}), cat)
    again = retried(before, checked, reads, cat)
    got = {r["detection_id"]: (r["status"], r["chosen_book"], r["title"]) for r in apply_review_actions(before, checked, again).collect()}
    messiah = again.first()["status"], again.first()["chosen_book"], "Dune Messiah"
    assert messiah[0] in ("auto_added", "needs_review")
    assert got == {10: ("discarded", 2, "Dune"), 11: ("confirmed", 2, "Dune"), 12: messiah, 13: ("discarded", messiah[1], "Dune Messiah"), 14: ("confirmed", 2, "Dune Messiah"), 15: ("discarded", None, "Dune"), 16: ("needs_review", None, "Dune"), 17: ("needs_review", None, "Dune")}


def test_edits_of_single_fields(spark):
    library = spark.createDataFrame([(i, 1, "", "", 7) for i in (1, 2, 3)], "entry_id long, book_id long, custom_title string, custom_author string, source_detection_id long")
    edits = [(1, 1, "edit", "T", None, 5), (2, 1, "edit", None, "A", 6), (3, 2, "edit", "old", "x", 5), (4, 2, "edit", "new", None, 5), (5, 3, "delete", None, None, 1), (6, 3, "edit", "late", None, 9)]
    df = spark.createDataFrame(edits, "action_id long, entry_id long, kind string, custom_title string, custom_author string, ts long")
    assert {(r["entry_id"], r["custom_title"], r["custom_author"]) for r in edit_library(library, df).collect()} == {(1, "T", "A"), (2, "new", "x")}


def test_near_pairs_equal_all_pairs(monkeypatch):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    bent = [w[:i] + rnd.choice("abcde") + w[i + rnd.randint(0, 1) :] for w in base for i in (rnd.randint(0, len(w)),)]
    a, b = list(dict.fromkeys(base)), list(dict.fromkeys(bent + base[:10]))
    monkeypatch.setattr(matching, "PAIRS", 7)
    i, j, score = matching.near_pairs(a, b, 0.85)
    every = ratios([x for x in a for _ in b], b * len(a)).reshape(len(a), len(b)) / 100
    want = {(x, y): every[x, y] for x, y in zip(*np.nonzero(every >= 0.85), strict=True)}
    assert len(i) == len(want) and {(x, y): s for x, y, s in zip(i, j, score, strict=True)} == pytest.approx(want)


@pytest.mark.parametrize(("scorer", "many"), [("wratio", 8), ("ratio", 8), ("wratio", 0)])
def test_skipped_pairs_change_nothing(monkeypatch, scorer, many):
    """The best books of a tile against those of all pairs, blank titles, ties and unknown authors included."""
    rnd = random.Random(12)
    words = ["red", "ring", "old", "rod", "the", "la", "gizmo", "anvil", "plate", "bolt", "kiesu", "fieed"]
    title = lambda: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 4, 9])))
    name = lambda: rnd.choice([None, {"surname": rnd.choice(["abcdefg", "abcdefgs", "other", "x"]), "initials": [rnd.choice("ab")]}])
    monkeypatch.setattr(matching, "MANY", many)
    left = pa.table({"read_key": pa.array([b"%d" % i for i in range(90)]), "norm_title": [title() for _ in range(90)], "name": pa.array([name() for _ in range(90)])})
    right = pa.table({"book_id": [i // 2 for i in range(240)], "book_title": [title() for _ in range(240)], "row_name": pa.array([x for _ in range(120) for x in [name()] for _ in range(2)])})
    counter = type("", (), {"n": 0, "add": lambda self, k: setattr(self, "n", self.n + k)})()
    got = sorted((r["read_key"], -r["score"], r["book_id"], r["title_score"], r["author_score"]) for r in matching.tile(MatchConfig(), scorer, counter)(left, right).to_pylist())
    score = ratios if scorer == "ratio" else weighted_ratios
    want = []
    rows = right.to_pylist()
    for read in left.to_pylist():
        best = {}
        who = matching.AuthorScores([read["name"] and (read["name"]["surname"], tuple(read["name"]["initials"]))], [r["row_name"] and (r["row_name"]["surname"], tuple(r["row_name"]["initials"])) for r in rows], MatchConfig()).row(0)
        titles = score([read["norm_title"]] * len(rows), [r["book_title"] for r in rows]) / 100
        for r, t, a in zip(rows, titles, who, strict=True):
            t = t if read["norm_title"] and r["book_title"] else 0.0
            s = min(t, 0.85) if np.isnan(a) else 0.75 * t + 0.25 * a
            if r["book_id"] not in best or t > best[r["book_id"]][1]:
                best[r["book_id"]] = (s, t, None if np.isnan(a) else a)
        want += sorted((read["read_key"], -s, b, t, a) for b, (s, t, a) in best.items())[:3]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=lambda w: w[:3])]
    assert counter.n <= len(set(left["norm_title"].to_pylist())) * len(set(right["book_title"].to_pylist()))


def test_a_full_tile_of_different_names_stays_small():
    rnd = random.Random(2)
    person = lambda: {"surname": "".join(rnd.choice("abcdefghijklmnoprstuvwz") for _ in range(rnd.randint(4, 10))), "initials": [rnd.choice("abc")]}
    n, title = 8192, lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(2))
    mine, theirs = [title() for _ in range(32)], [title() for _ in range(32)]
    left = pa.table({"read_key": pa.array([b"%d" % i for i in range(n)]), "norm_title": [mine[i % 32] for i in range(n)], "name": pa.array([person() for _ in range(n)])})
    right = pa.table({"book_id": list(range(n)), "book_title": [theirs[i % 32] for i in range(n)], "row_name": pa.array([person() for _ in range(n)])})
    tracemalloc.start()
    assert matching.tile(MatchConfig(), "wratio")(left, right).num_rows == 3 * n
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_blank_titles_of_any_kind(spark):
    got = matched(spark, catalog(spark, *DUNE), ("\t", "Frank Herbert", None), ("\u00a0 \n", None, None), ("!!", None, None))
    assert [(got[i]["match_status"], got[i]["confidence"], got[i]["candidates"] or []) for i in (0, 1)] == [("unmatched", None, [])] * 2
    assert got[2]["match_status"] == "unmatched" and got[2]["confidence"] == 0 and got[2]["candidates"]


def test_review_mode_gives_the_rest_its_candidates(spark):
    """Reads without an author, or whose author is unknown to the catalog, get those of the exact mode."""
    cat = catalog(spark, *DUNE, ("Emma", "Jane Austen", [], ""), ("The Trial", "Kafka, Franz", [], ""), ("Trial by Fire", "", [], ""))
    reads = (("Emma", "Jane Austen", None), ("Emma", None, None), ("Trial", "Nobody", None), ("Dune", "Frank Herbert", None), ("qqq", None, None), ("", None, None))
    exact, review = matched(spark, cat, *reads), matched(spark, cat, *reads, mode="review")
    assert exact[0]["match_status"] == "auto_added"
    for i in range(len(reads)):
        assert (review[i]["match_status"], review[i]["confidence"], review[i]["chosen_book"]) == (exact[i]["match_status"], exact[i]["confidence"], exact[i]["chosen_book"])
        if exact[i]["match_status"] != "auto_added":
            assert review[i]["candidates"] == exact[i]["candidates"] and review[i]["margin"] == exact[i]["margin"]
    with pytest.raises(KeyError):
        matched(spark, cat, *reads, mode="other")
