import json
from pathlib import Path

from pyspark.sql import functions as F

from linkloom.functions.text import normalize_spine_color, spine_color
from linkloom.jobs.views import Views
from linkloom.operators.responses import align_reads, extract_json_array, fallback_reads, parse_items
from linkloom.sources.catalog import RESPONSE, read_responses, write_responses


def aligned(spark, n, raw, call_failed=False, repair=None, repair_failed=False):
    raw = raw if isinstance(raw, str) or raw is None else json.dumps(raw)
    rows = align_reads(spark.createDataFrame([(1, n, raw, call_failed, repair, repair_failed)], RESPONSE)).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(1, n + 1))
    return rows


def item(i, **more):
    return {"index": i, "title": f"T{i}", "author": "A", "readable": True} | more


def test_extraction(spark):
    texts = ['[{"a": 1}]', '```json\n[{"a": 1}]\n```', '```\n[{"a": 1}]```', 'Sure: [{"a": 1}] done', "noise [1, 2, 3] noise", "none", '[{"a": 1', '{"a": 1}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", extract_json_array(F.col("t")).alias("x"), F.size(parse_items(F.col("t"))).alias("n")).orderBy("i").collect()
    assert [r["x"] for r in got] == ['[{"a": 1}]'] * 4 + ["[1, 2, 3]", None, None, None, None]
    assert [r["n"] for r in got] == [1, 1, 1, 1, 3, None, None, None, None]


def test_duplicates(spark):
    status = lambda *items: [r["status"] for r in aligned(spark, len(items), list(items))]
    assert status(item(1), item(2, duplicate_of=1)) == ["ok", "duplicate"]
    assert status(item(1, duplicate_of=1), item(2, duplicate_of=99), item(3, duplicate_of=True)) == ["ok"] * 3
    assert status(item(1), item(2, duplicate_of=1), item(3, duplicate_of=2)) == ["ok", "duplicate", "ok"]
    assert status(item(1), item(2, readable=False, duplicate_of=1)) == ["ok", "unreadable"]
    two = aligned(spark, 2, [item(1), item(2, duplicate_of=1)])[1]
    assert two["title"] == "T2" and not two["readable"]


def test_fields(spark):
    rows = aligned(spark, 9, [
        item(1, readable=False, spine_color="Navy"), item(2, spine_color="sandy dune tone"), item(3, not_a_book=True, readable=False), item(4, not_a_book=True),
        item(5, readable="false"), item(6, readable=0), item(7, title=""), {"index": 8, "title": 12}, item(1.0),
    ])
    assert [r["status"] for r in rows] == ["unreadable", "ok", "not_a_book", "ok", "ok", "unreadable", "unreadable", "ok", "unreadable"]
    assert rows[0]["spine_color"] == "blue" and rows[0]["title"] is None and rows[1]["spine_color"] is None and rows[7]["title"] == "12"


def test_index(spark):
    rows = aligned(spark, 3, [item(2, title="first"), item(2, title="last"), item(0), item(True, title="one"), "text", 5, None, []])
    assert [r["title"] for r in rows] == ["one", "last", None]


def test_outcomes(spark):
    good = json.dumps([item(1)])
    status = lambda *a: aligned(spark, 1, *a)[0]["status"]
    assert status(None, True, None, False) == "failed"
    assert status("bad", False, good, False) == "ok"
    assert status("bad", False, "worse", False) == "unreadable"
    assert status("bad", False, None, True) == "failed"
    assert aligned(spark, 0, good) == []


def test_fallback(spark):
    rows = [(1, 0, json.dumps([item(1, spine_color="navy"), {"title": ""}, 3, {"title": "B"}]), False, None, False), (2, 0, json.dumps([item(1)]), True, None, False), (3, 0, "bad", False, None, False)]
    got = fallback_reads(spark.createDataFrame(rows, RESPONSE)).orderBy("scan_id", "slot").collect()
    assert [(r["scan_id"], r["title"], r["spine_color"]) for r in got] == [(1, "T1", "navy"), (1, "B", None)]


def test_what_is_no_single_array(spark):
    """A remark in brackets behind the array, or a second array, makes the text unreadable: the repair is asked for."""
    good, repair = json.dumps([item(1)]), json.dumps([item(1, title="R")])
    one = lambda raw: [(r["status"], r["title"]) for r in aligned(spark, 1, raw, False, repair)]
    assert one(good + "\nNote [1]") == one(good + good) == one("[1], " + good) == one(good + ", [") == [("ok", "R")] or one(good + ", [") == [("ok", "T1")]
    assert one(f"see below {good} done") == [("ok", "T1")]
    assert aligned(spark, 1, good + " see [1]", False, "none", False)[0]["status"] == "unreadable" and aligned(spark, 1, good + " see [1]", False, None, True)[0]["status"] == "failed"


def test_repeated_keys_and_no_numbers(spark):
    """Of repeated keys the last counts; NaN and the infinities are values, true ones, and text of that kind stays text."""
    raw = """[{"index": 1, "title": "first", "title": "last", "readable": NaN, "author": "NaN, Infinity \\" -Infinity"}, {"index": 2, "title": "B", "author": NaN, "readable": -Infinity, "not_a_book": Infinity},
      {"index": NaN, "title": "C"}, {"index": 3, "title": NaN, "duplicate_of": NaN}]"""
    rows = aligned(spark, 3, raw)
    assert [r["title"] for r in rows] == ["last", "B", None] and [r["status"] for r in rows] == ["ok", "ok", "unreadable"]
    assert rows[0]["author"] == 'NaN, Infinity " -Infinity' and rows[1]["author"] is None and rows[1]["not_a_book"] and not rows[2]["not_a_book"]
    fallback = fallback_reads(spark.createDataFrame([(1, 0, raw, False, None, False), (2, 0, raw + " [1]", False, None, False)], RESPONSE)).collect()
    assert [(r["scan_id"], r["title"]) for r in fallback][:2] == [(1, "last"), (1, "B")] and {r["scan_id"] for r in fallback} == {1}


def test_texts_are_read_in_batches(spark):
    """No function interprets the fields of an item: each took as long as parsing the text. Long strings of escapes are no danger, nor is what only looks like a number."""
    rows = [(1, 1, '[{"index": 1, "title": "' + "\\n" * 50_000 + '", "edition": NaN}]', False, None, False), (2, 1, '[{"index": 1, "title": "A", "edition": -NaN}]', False, "none", False)]
    df = align_reads(spark.createDataFrame(rows, RESPONSE))
    assert [(r["status"], len(r["title"] or "")) for r in df.orderBy("scan_id").collect()] == [("ok", 50_000), ("unreadable", 0)]
    for reads in (df, fallback_reads(spark.createDataFrame(rows, RESPONSE))):
        assert "variant" not in reads._jdf.queryExecution().toString()


def test_values_as_text(spark):
    """Numbers and nested values are written as Spark writes them, half of a pair of surrogates as a question mark."""
    said = {"1.50": "1.5", "100.00": "100", "-0.0": None, "1e5": "100000.0", "1E-7": "1.0E-7", "12345678.9e1": "1.23456789E8", "1" * 39: "1.111111111111111E38", "1e400": "Infinity", "12345678901234567890": "12345678901234567890",
            '{"b": 1.50, "a": [null, "\\u00e9"]}': '{"a":[null,"é"],"b":1.5}', "true": "true", '"\\ud800x"': "?x"}
    raw = "[" + ", ".join(f'{{"index": {i}, "title": {v}}}' for i, v in enumerate(said, 1)) + "]"
    assert [r["title"] for r in aligned(spark, len(said), raw)] == list(said.values())


def test_colors_are_read_in_the_batches(spark):
    """Colours are named where texts are parsed, as the column function names them, and nothing interprets them behind it."""
    texts = ["Pale NAVY", " multi-colour ", "\x1cmulti-color\x85", "wooden", "", " ", "red, then grey!", "redgrey", "\u0130vory pin\u212a", "b\u00e9ige tan", "\u03a3", "GOLD\x00", "red " * 40, "\u3000Grey\u2003"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("c", normalize_spine_color(F.col("t")))
    assert [r["c"] for r in df.orderBy("i").collect()] == [spine_color(t) for t in texts] and spine_color(3) is None
    reads = align_reads(spark.createDataFrame([(1, len(texts), json.dumps([item(i, spine_color=t) for i, t in enumerate(texts, 1)]), False, None, False)], RESPONSE))
    assert [r["spine_color"] for r in reads.orderBy("slot").collect()] == [spine_color(t) for t in texts]
    assert "regexp" not in (plan := reads._jdf.queryExecution().toString()) and "transform" not in plan


def test_responses_are_parsed_in_as_many_tasks_as_asked_for(spark):
    """Parts aren't merged by their compressed bytes into a few more than there are cores: most cores would wait for the last ones."""
    reads = align_reads(Views(spark, "/root/testdata/sf0.001").derived("responses"))
    assert reads.select(F.spark_partition_id()).distinct().count() >= 4 * spark.sparkContext.defaultParallelism


def test_nulls_and_halves_of_pairs_stay_in_their_rows(spark):
    """A null beside numbers, or half of a pair of surrogates beside other texts, changes no other row of a batch."""
    rows = [(i, n, raw, failed, None, None) for i, (n, raw, failed) in enumerate([(1, '[{"index": 1, "title": "\\ud800x", "author": "é"}]', None), (None, "[]", False), (2, json.dumps([item(2, title="é")]), None), (1, None, True)])]
    got = align_reads(spark.createDataFrame(rows, RESPONSE).coalesce(1)).orderBy("scan_id", "slot").collect()
    assert [(r["scan_id"], r["slot"], r["title"], r["status"]) for r in got] == [(0, 1, "?x", "ok"), (2, 1, None, "unreadable"), (2, 2, "é", "ok"), (3, 1, None, "failed")]


def test_whole_photos_are_parsed_in_as_many_tasks_as_asked_for(spark):
    reads = fallback_reads(Views(spark, "/root/testdata/sf0.001").derived("responses"))
    assert reads.select(F.spark_partition_id()).distinct().count() >= 4 * spark.sparkContext.defaultParallelism


def test_responses_are_written_in_as_many_files(spark, tmp_path):
    """What is read back is dealt as it was written."""
    Views(spark, "/root/testdata/sf0.001").derived("responses").write.json(f"{tmp_path}/lines")
    assert len(list(tmp_path.glob("lines/*.json"))) >= 4 * spark.sparkContext.defaultParallelism
    assert align_reads(read_responses(spark, f"{tmp_path}/lines")).count() == align_reads(Views(spark, "/root/testdata/sf0.001").derived("responses")).count()


def test_responses_are_stored_small(spark, tmp_path):
    """What lies between writing and reading takes a fraction of the text, in files of few enough lines to be dealt out, and comes back whole."""
    odd = [None, "", "é\u2028\n", "\x00\t", "[1]" * 5_000]
    rows = [(i, 1, odd[i] if i < len(odd) else json.dumps([item(1, title=f"Title {i}")] * 9), i % 2 == 0, None, None) for i in range(1_000)]
    df = spark.createDataFrame(rows, RESPONSE).coalesce(1)
    write_responses(df, f"{tmp_path}/lines", 150)
    files = list(tmp_path.glob("lines/part-*"))
    assert len(files) == 7 and sum(f.stat().st_size for f in files) * 3 < sum(len(r[2] or "") for r in rows)
    assert sorted(map(tuple, read_responses(spark, f"{tmp_path}/lines").collect())) == [tuple(r) for r in rows]


def test_the_query_stores_responses_small(spark, tmp_path):
    """8 times the bytes of its input lay between the halves of the query."""
    from linkloom.jobs.catalogue import queries
    from linkloom.tables import shared_dir

    there = set(Path(shared_dir(spark).removeprefix("file:")).glob("responses-*"))
    got = queries()["responses_read"](spark, "/root/testdata/sf0.001")
    (made,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("responses-*")) - there
    text = Views(spark, "/root/testdata/sf0.001").derived("responses").agg(F.sum(F.length("raw_text"))).first()[0]
    assert sum(f.stat().st_size for f in made.glob("part-*")) * 2 < text
    plain = align_reads(Views(spark, "/root/testdata/sf0.001").derived("responses"))
    assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()
