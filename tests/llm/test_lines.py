import random

from pyspark.sql import functions as F

from linkloom.llm.lines import cut_lines, without_lines
from tests.llm.conftest import ODD, prose


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, min_words=1, fuzzy=8):
    lines = [(i, n, line, line.split()) for i, t in docs for n, line in enumerate((t or "").split("\n"))]
    first = {}
    for i, n, line, ws in sorted(lines, key=lambda x: x[:2]):
        if len(ws) >= min_words:
            first.setdefault(line, ((i, n), ws))
    gone = {(i, n) for i, n, line, ws in lines if len(ws) >= min_words and first[line][0] < (i, n)}
    entries = [x for x in first.values() if len(x[1]) >= fuzzy]
    gone |= {p for p, ws in entries if any(q < p and near(ws, vs) for q, vs in entries)}
    return {i: None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}


def result(df):
    return {r["doc_id"]: r["text"] for r in without_lines(df).collect()}


def test_equals_brute_force(make, rnd):
    base = [prose(rnd, 60).split("\n") for _ in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for line in rnd.choice(base):
            ws = line.split()
            kind = rnd.randrange(6)
            at = rnd.randrange(len(ws))
            if kind == 0:
                ws[at] = rnd.choice(["new", "old"])
            elif kind == 1:
                ws.insert(at, "more")
            elif kind == 2:
                del ws[at]
            elif kind == 3:
                ws = ws[at:] + ws[:at]
            lines.append(("  " if kind == 4 else " ").join(ws))
        docs.append((i, "\n".join(lines)))
    assert result(make(*docs)) == brute(docs)


def test_cases(make):
    line = "one two three four five six seven eight nine"
    got = result(make(line, line.replace("five", "5"), line + " ten\nshort line", "short line", "a b c\n\na b c\n\n", "nine " + line[:-5], " \nx\nx\n "))
    assert got == {1: line, 2: "", 3: "short line", 4: "", 5: "a b c\n\n\n", 6: "nine " + line[:-5], 7: " \nx\n "}


def test_odd_tables(spark, make):
    docs = make(*ODD, extra=True)
    out = without_lines(docs)
    assert out.columns == [*docs.columns, "lines_report"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["text"] == "  \n\t " and got[6]["text"] == ODD[5]
    assert got[7]["text"] == ODD[6] and got[8]["text"] == "" and got[8]["lines_report"]["n_removed"] == 1
    assert without_lines(docs.limit(0)).count() == 0
    twice = without_lines(docs.where("doc_id = 7").unionAll(docs.where("doc_id = 7"))).collect()
    assert [r["text"] for r in twice] == [ODD[6]] * 2


def test_null_ids_and_clashing_names(make):
    """Rows without an id come first; an input column named lines_report is kept by ``cut_lines``."""
    line = "one two three four five six seven eight nine"
    docs = make((None, line), (None, line.replace("two", "2")), (4, line.replace("nine", "9")), (5, line)).withColumn("lines_report", F.lit("mine"))
    found = cut_lines(docs).select("d.*", F.col("lines_report.n_removed").alias("n")).collect()
    assert {r["lines_report"] for r in found} == {"mine"} and [r["text"] for r in found if r["doc_id"]] == ["", ""]
    assert sorted(r["text"] == "" for r in found if r["doc_id"] is None) == [False, True]
    assert without_lines(docs).columns == docs.columns
