from linkloom.llm import substrings
from linkloom.llm.substrings import PART, RUN, repeated_spans, without_repeats
from tests.llm.conftest import ODD, prose


def test_planted_passages(make, rnd):
    passage = prose(rnd, 60, 9).replace("\n", " ")
    texts = [prose(rnd, 150, 11) for _ in range(20)]
    planted = {3, 7, 12}
    docs = [t if i not in planted else t[:200] + " " + passage + " " + t[200:] for i, t in enumerate(texts)]
    got = repeated_spans(make(*enumerate(docs))).collect()
    assert {r["doc_id"] for r in got} == planted - {3} and {r["first_doc_id"] for r in got} == {3}
    inner = passage[passage.index(".") + 1 : passage.rindex(".") - 1].strip()[:150]
    left = {r["doc_id"]: r["text"] for r in without_repeats(make(*enumerate(docs))).collect()}
    assert inner in left[3] and inner not in left[7] and inner not in left[12]
    assert all(left[i] == docs[i] for i in range(20) if i not in planted - {3})


def test_equals_brute_force(make, rnd):
    """Every run of three sentences, those of three words too."""
    pool = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randint(0, 3)}" for _ in range(rnd.randint(1, 9))) + "." for _ in range(30)]
    docs = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 25)))) for i in range(40)]
    first, covered = {}, set()
    split = {i: t.replace(". ", ".\0").split("\0") for i, t in docs}
    for i, ss in split.items():
        for p in range(len(ss) - RUN + 1):
            run = tuple(ss[p : p + RUN])
            if first.setdefault(run, (i, p)) != (i, p):
                covered |= {(i, p + j) for j in range(RUN)}
    got = {(r["doc_id"], s) for r in repeated_spans(make(*docs)).collect() for s in range(r["first_sentence"], r["last_sentence"] + 1)}
    assert got == covered


def test_long_sentences_are_cut_alike(make, rnd):
    passage = " ".join(rnd.choice(["alpha", "beta"]) + str(rnd.randint(0, 999)) for _ in range(200))
    docs = [prose(rnd, 90).replace(".", "") .replace("\n", " ") + " " + passage + " " + prose(rnd, 90).replace(".", "").replace("\n", " ") for _ in range(2)]
    assert {r["doc_id"] for r in repeated_spans(make(*docs)).collect()} == {2}


def test_odd_tables(make):
    docs = make(*ODD, (None, "no id. at all. here we are."), extra=True)
    assert {r["doc_id"] for r in repeated_spans(docs).collect()} <= {6}
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ODD) + 1
    assert repeated_spans(docs.limit(0)).count() == 0
    same = make(*[(1, "One two three four five. Six seven eight nine. Ten eleven twelve thirteen.")] * 2)
    assert repeated_spans(same).count() == 0


def test_every_passage_of_51_words_is_found(make, rnd):
    """Against a brute force of 51-word windows: each that stands in an earlier document too loses words."""
    fresh = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 10**6)}" for _ in range(n)]

    def told(lengths, end=". "):
        return end.join(" ".join(fresh(n)) for n in lengths)

    passages = [told([30, 30]) + ".", told([32, 32, 2, 3]), told([7, 5, 30, 27]), told([51]), told([1] * 51, "\n"), told([2] * 26, "\n"), told([11] * 5), told([1, 9, 1, 1] * 5), " ".join(["same"] * 60)]
    passages += [told([rnd.choice([1, 2, 3, 8, 11, 12, 25, 40]) for _ in range(30)]) for _ in range(15)]
    passages += [told([51]) for _ in range(15)]
    around = lambda p: " ".join(fresh(rnd.randint(0, 14))) + " " + p + " " + " ".join(fresh(rnd.randint(0, 14)))
    docs = [(i + 1000 * k, around(p)) for k in range(2) for i, p in enumerate(passages)]
    left = {r["doc_id"]: r["text"] for r in without_repeats(make(*docs)).collect()}
    windows = lambda t: {tuple(t[i : i + 51]) for i in range(len(t) - 50)}
    assert all(windows(dict(docs)[i + 1000].split()) & windows(dict(docs)[i].split()) for i in range(len(passages)))
    missed = [i for i in range(len(passages)) if windows(left[i + 1000].split()) & windows(left[i].split())]
    # Of a passage at most PART words at either end stay.
    assert not missed and all(len(left[i + 1000].split()) <= 2 * 14 + 2 * PART for i in range(len(passages)))


def test_hot_runs(make, rnd, monkeypatch):
    """Runs that most documents have are met by broadcast; the result is the same."""
    hot = "Alpha beta gamma. Delta. Epsilon zeta eta theta."
    docs = [(i, prose(rnd, 30).replace("\n", " ") + " " + (hot if i % 5 else prose(rnd, 20)) + " " + prose(rnd, 30)) for i in range(300)]
    both = []
    for most in (10_000, 1):
        monkeypatch.setattr(substrings, "HOT", most)
        both.append(sorted(map(tuple, repeated_spans(make(*docs)).select("doc_id", "first_sentence", "last_sentence", "first_doc_id").collect())))
    assert both[0] == both[1] and {r[0] for r in both[0]} == {i for i in range(2, 300) if i % 5}


def test_rows_that_share_an_id(make):
    """Each loses what stands elsewhere, and only that."""
    p, y = "One two three four. Five six seven eight. Nine ten eleven twelve.", "Red green blue black. White gray brown pink. Gold teal navy beige."
    left = sorted(tuple(r) for r in without_repeats(make((1, p), (2, p + " Tail of it."), (2, y))).select("doc_id", "text").collect())
    assert left == [(1, p), (2, " Tail of it."), (2, y)]
    spans = sorted(tuple(r) for r in repeated_spans(make((1, p + " " + y), (2, p), (2, y))).select("doc_id", "start", "end", "first_doc_id").collect())
    assert spans == [(2, 0, len(p), 1), (2, 0, len(y), 1)]
    # Of rows with the same id and a passage in common, one keeps it.
    texts = [r["text"] for r in without_repeats(make((3, p + " A."), (3, "B. " + p))).collect()]
    assert sum("Five six" in t for t in texts) == 1


def test_shared_ids_by_a_shuffle(make, monkeypatch):
    p = "One two three four. Five six seven eight. Nine ten eleven twelve."
    monkeypatch.setattr(substrings, "BROADCAST_IDS", 0)
    test_rows_that_share_an_id(make)
    assert repeated_spans(make((1, p), (2, p), (2, p))).count() == 1
