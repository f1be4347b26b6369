from datetime import datetime, timedelta
from pathlib import Path

from linkloom.jobs import catalogue
from linkloom.streaming.matching import match_stream
from linkloom.tables import shared_dir

READ = "scan_id long, slot int, created_at timestamp, read_id long, title string, author string, spine_color string, readable boolean, not_a_book boolean, status string"


NOW = datetime(2024, 1, 1, 12)


def test_stream_equals_batch(spark, tmp_path):
    cat = spark.createDataFrame([(1, "Dune", "Frank Herbert", [], None, "", ""), (2, "Emma", "Jane Austen", [], None, "", "")], "book_id long, title string, author string, alt_titles array<string>, year int, series string, spine_color string")
    rows = [(1, 1, NOW, 1, "Dune", "Frank Herbert", None, True, False, "ok"), (1, 2, NOW, 2, None, None, None, False, False, "failed"), (2, 1, NOW, 3, "Emma", None, None, True, False, "ok")]
    for r in rows:
        spark.createDataFrame([r], READ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(READ).parquet(str(tmp_path / "in"))
        match_stream(stream, cat, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["read_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "auto_added", 2: "failed", 3: "needs_review"}


def test_automatic_matches_enter_the_library(spark, tmp_path):
    cat = spark.createDataFrame([(1, "Dune", "Frank Herbert", [], None, "", ""), (2, "Emma", "Jane Austen", [], None, "", "")], "book_id long, title string, author string, alt_titles array<string>, year int, series string, spine_color string")
    schema = "detection_id long, " + READ
    rows = [(10, 1, 1, NOW, 1, "Dune", "Frank Herbert", None, True, False, "ok"), (11, 1, 2, NOW, 2, "Emma", None, None, True, False, "ok"), (12, 1, 3, NOW, 3, "Emma", "Austen, J.", None, True, True, "ok")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        match_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cat, str(tmp_path / "out"), str(tmp_path / "ck"), library=str(tmp_path / "library")).awaitTermination()
    got = sorted((r["source_detection_id"], r["book_id"]) for r in spark.read.parquet(str(tmp_path / "library")).collect())
    assert got == [(10, 1), (12, 2)]


def test_a_read_that_is_sent_again_counts_once(spark, tmp_path):
    """Also in a later batch and a later run; and no batch leaves tables behind."""
    cat = spark.createDataFrame([(1, "Dune", "Frank Herbert", [], None, "", "")], "book_id long, title string, author string, alt_titles array<string>, year int, series string, spine_color string")
    read = lambda slot, minutes=0: (5, slot, NOW + timedelta(minutes=minutes), slot, "Dune", "Frank Herbert", None, True, False, "ok")
    folders = lambda: {p.name for p in Path(shared_dir(spark)).iterdir() if not p.name.startswith("catalog-keys")}
    before = folders()
    for batch in ([read(1), read(1), read(2)], [read(2, 1), read(3, 1)], [read(1, 2), read(3, 2)]):
        spark.createDataFrame(batch, READ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        match_stream(spark.readStream.schema(READ).parquet(str(tmp_path / "in")), cat, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["slot"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    assert folders() == before


def test_the_files_of_the_query_come_from_many_tasks(spark):
    """Joined in one task, the reads of 1 GB took over 1 GB of its memory."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    folders = lambda: set(Path(shared_dir(spark)).glob("stream-*"))
    before, old = folders(), {k: spark.conf.get(k) for k in settings}
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        catalogue.queries()["stream_routed"](spark, "/root/testdata/sf0.001")
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)
    (folder,) = folders() - before
    assert len(list((folder / "in").glob("*.parquet"))) == 4  # two tasks, two times
