import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.jobs import catalogue
from linkloom.operators.lifecycle import apply_review_actions, checked_actions, confirmed_entries
from linkloom.operators.reports import catalog_coverage, catalog_profile, check_hexes
from linkloom.sources.catalog import current_catalog, read_catalog, replace_catalog, scan_documents, store_buckets, upsert_buckets, upsert_catalog, write_detections

CSV = '''"title","author","alt_titles","year","series","is_omnibus","contained_titles","spine_color","spine_hex"
"Northern Lights","Pullman, Philip","The Golden Compass|","1995","His Dark Materials","false",""," Yellow ","fce153"
"The ""Lord""","Tolkien","","","","TRUE","A| B","","purple"
'''


def written(tmp_path, text, name="c.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_reading(spark, tmp_path):
    a, b = read_catalog(spark, written(tmp_path, CSV)).orderBy("book_id").collect()
    assert (a["book_id"], a["alt_titles"], a["year"], a["is_omnibus"], a["spine_color"], a["spine_hex"]) == (1, ["The Golden Compass"], 1995, False, "yellow", "#FCE153")
    assert (b["title"], b["year"], b["series"], b["is_omnibus"], b["contained_titles"], b["spine_hex"]) == ('The "Lord"', None, "", True, ["A", "B"], "")
    short = read_catalog(spark, written(tmp_path, "title,author\nDune,Frank Herbert\n", "s.csv")).first()
    assert short["alt_titles"] == [] and short["spine_color"] == "" and short["year"] is None
    with pytest.raises(ValueError, match="author"):
        read_catalog(spark, written(tmp_path, "title\nDune\n", "t.csv"))


def test_replacing_and_updating(spark, tmp_path):
    one = read_catalog(spark, written(tmp_path, CSV))
    first = replace_catalog(one, str(tmp_path / "cat"))
    reader = current_catalog(spark, str(tmp_path / "cat"))
    second = replace_catalog(one.limit(1), str(tmp_path / "cat"))
    assert current_catalog(spark, str(tmp_path / "cat")).count() == 1 and reader.count() == 2
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):  # the folder itself isn't all versions
        spark.read.parquet(str(tmp_path / "cat"))
    with pytest.raises(FileNotFoundError):
        current_catalog(spark, str(tmp_path / "none"))
    assert first != second and spark.read.parquet(first).count() == 2 and spark.read.parquet(second).count() == 1
    new = read_catalog(spark, written(tmp_path, 'title,author,year,series\n"northern lights","Philip Pullman",1995,New\nDune,Frank Herbert,1965,\n', "n.csv"))
    got = {r["book_id"]: (r["title"], r["series"]) for r in upsert_catalog(one, new).collect()}
    assert got == {1: ("northern lights", "New"), 2: ('The "Lord"', ""), 3: ("Dune", "")}
    with pytest.raises(ValueError, match="same title"):
        upsert_catalog(one, new.unionAll(new))


def test_a_key_that_comes_twice(spark, tmp_path):
    """Where it is no error, each incoming row meets each stored one of its key, and new ones get ids of their own, whole or by buckets."""
    schema = "book_id long, title string, author string, alt_titles array<string>, year int, series string, is_omnibus boolean, contained_titles array<string>, spine_color string, spine_hex string"
    row = lambda i, title, series: (i, title, "", [], 1990, series, False, [], "", "")
    current = spark.createDataFrame([row(1, "Dune", "a"), row(2, "Dune", "b"), row(3, "Emma", "c")], schema)
    incoming = spark.createDataFrame([row(9, "Dune", "x"), row(8, "Dune", "y"), row(7, "Ivanhoe", "v"), row(6, "Ivanhoe", "u")], schema)
    want = [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "c"), (4, "u"), (5, "v")]
    assert sorted((r["book_id"], r["series"]) for r in upsert_catalog(current, incoming, twice="join").collect()) == want
    store_buckets(current, str(tmp_path / "stored"), 4)
    upsert_buckets(spark, str(tmp_path / "stored"), incoming, 4, twice="join")
    assert sorted((r["book_id"], r["series"]) for r in spark.read.parquet(str(tmp_path / "stored")).collect()) == want


@pytest.mark.parametrize("name", ["catalog_upserted", "catalog_upserted_buckets"])
def test_upserts_of_a_catalog_with_equal_keys(spark, name):
    """sf0.1 has books without an author that agree in title and year."""
    sf, columns = "/root/testdata/sf0.1", "book_id, series, title, author"
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from read_parquet('{sf}/part.parquet')")
    want = duck.execute(f"select {columns} from ({catalogue.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in catalogue.queries()[name](spark, sf).select(*columns.split(", ")).collect()]
    assert sorted(got) == sorted(want) and len({r[0] for r in got}) < len(got)


def test_profile_and_coverage(spark, tmp_path):
    cat = read_catalog(spark, written(tmp_path, CSV))
    assert catalog_profile(cat).first().asDict() == {"n_rows": 2, "with_alt": 1, "with_series": 1, "with_year": 1, "with_color": 1, "omnibus": 1}
    assert check_hexes(cat).count() == 0
    expected = spark.createDataFrame([("Northern Lights", "Pullman, Philip", "yellow", "#FCE153"), ("Dune", "x", None, None), ('the "lord"', "Somebody", None, None)], "title string, author string, spine_color string, spine_hex string")
    assert {r["title"]: r["problem"] for r in catalog_coverage(expected, cat).collect()} == {"Dune": "missing", 'the "lord"': "differs"}


ACTION = "action_id long, detection_id long, action string, book_id long, custom_title string, custom_author string, has_crop boolean, ts long"


def test_actions(spark):
    cat = spark.createDataFrame([(7,)], "book_id long")
    rows = [(1, 1, "confirm", 7, "x", "y", True, 1), (2, 1, "confirm", 7, None, None, True, 2), (3, 2, "confirm", 99, "kept?", None, True, 1), (4, 3, "confirm", None, " Own ", " Me ", True, 1), (5, 4, "confirm", None, "  ", None, True, 1), (6, 5, "discard", None, None, None, True, 1), (7, 6, "retry", None, None, None, False, 1), (8, 3, "discard", None, None, None, True, 5)]
    checked = checked_actions(spark.createDataFrame(rows, ACTION), cat)
    assert {r["action_id"] for r in checked.where("valid").collect()} == {1, 2, 4, 6, 8}
    entries = sorted((r["source_detection_id"], r["book_id"] or 0, r["custom_title"], r["custom_author"]) for r in confirmed_entries(checked).collect())
    assert entries == [(1, 7, "", ""), (1, 7, "", ""), (3, 0, "Own", "Me")]
    detections = spark.createDataFrame([(i, "needs_review", None) for i in range(1, 7)], "detection_id long, status string, chosen_book long")
    got = {r["detection_id"]: (r["status"], r["chosen_book"]) for r in apply_review_actions(detections, checked).collect()}
    assert got == {1: ("confirmed", 7), 2: ("needs_review", None), 3: ("discarded", None), 4: ("needs_review", None), 5: ("discarded", None), 6: ("needs_review", None)}


def test_documents(spark):
    scans = spark.createDataFrame([(1,), (2,)], "scan_id long")
    got = {r["scan_id"]: r for r in scan_documents(scans, spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "scan_id long, slot int, title string")).collect()}
    assert got[1]["document"] == '{"scan_id":1,"detections":[{"slot":1,"title":"a"},{"slot":2,"title":"b"}]}' and got[2]["document"] == '{"scan_id":2,"detections":[]}'
    null = scan_documents(scans.limit(1), spark.createDataFrame([(1, 1, None)], "scan_id long, slot int, chosen_book long")).first()
    assert null["document"] == '{"scan_id":1,"detections":[{"slot":1,"chosen_book":null}]}'


def test_white_space_in_titles_and_searches(spark):
    cat = spark.createDataFrame([(7,)], "book_id long")
    rows = [(1, 1, "confirm", None, "\t\u00a0", None, True, 1), (2, 2, "confirm", None, "\tOwn\n", "\u2003Me", True, 1)]
    checked = checked_actions(spark.createDataFrame(rows, ACTION), cat)
    assert [(r["custom_title"], r["custom_author"]) for r in confirmed_entries(checked).collect()] == [("Own", "Me")]


def test_detections_are_written_once(spark, tmp_path):
    rows = [(i, f"2024-01-0{i % 3 + 1} 10:00:00" if i < 9 else None, "ok") for i in range(10)]
    batch = spark.createDataFrame(rows, "detection_id long, created_at string, status string").withColumn("created_at", F.to_timestamp("created_at"))
    path = str(tmp_path / "detections")
    for part in (batch.limit(4), batch.limit(4), batch, batch.where("detection_id > 7")):
        write_detections(part, path)
    assert sorted(r["detection_id"] for r in spark.read.parquet(path).collect()) == list(range(10))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    rows = [(i, f"Title {i}", "" if i % 4 == 0 else f"A. Name{i}", 1900 + i, "") for i in range(1, 60)]
    catalog = spark.createDataFrame(rows, "book_id long, title string, author string, year int, series string")
    path = tmp_path / "buckets"
    store_buckets(catalog, str(path))
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    before = files()
    incoming = spark.createDataFrame([("TITLE 4", "", 1904, "New"), ("Title 7", "Name7, A.", 1907, "New"), ("Fresh", None, 2000, "New")], "title string, author string, year int, series string").withColumn("book_id", F.lit(0))
    touched = upsert_buckets(spark, str(path), incoming)
    after, own = files(), {f"bucket={b}" for b in touched}
    assert 1 <= len(touched) <= 3 and {f: t for f, t in before.items() if f.split("/")[0] not in own} == {f: t for f, t in after.items() if f.split("/")[0] not in own}
    got = {r["book_id"]: (r["title"], r["series"]) for r in spark.read.parquet(str(path)).collect()}
    whole = {r["book_id"]: (r["title"], r["series"]) for r in upsert_catalog(catalog, incoming).collect()}
    assert got == whole and got[4] == ("TITLE 4", "New") and got[60] == ("Fresh", "New")
    # A second time nothing is new; a catalog may also begin empty.
    upsert_buckets(spark, str(path), incoming)
    assert {r["book_id"] for r in spark.read.parquet(str(path)).collect()} == set(got)
    upsert_buckets(spark, str(tmp_path / "empty"), incoming)
    assert sorted(r["book_id"] for r in spark.read.parquet(str(tmp_path / "empty")).collect()) == [1, 2, 3]
