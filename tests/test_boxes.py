import pytest
from pyspark.sql import functions as F

from linkloom.operators.boxes import box_area, clean_boxes, containment, divider_decision, edge_runs, iou, merge_boxes, union_box, width_ratio

BOX = "scan_id long, ord long, cls string, conf double, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int"


def cleaned(spark, *boxes, edges=None, width=5000):
    rows = [(1, i, cls, conf, *map(float, xy), width, 6000) for i, (xy, conf, cls) in enumerate(boxes)]
    return [tuple(r[c] for c in ("x1", "y1", "x2", "y2")) for r in clean_boxes(spark.createDataFrame(rows, BOX), edges).orderBy("slot").collect()]


def b(*xy, conf=0.9, cls="book"):
    return xy, conf, cls


def test_geometry(spark):
    cases = [((1290, 1332, 2153, 5401), (1884, 1716, 2168, 5554)), ((0, 0, 100, 500), (200, 0, 300, 500)), ((10, 10, 10, 10), (0, 0, 5, 5)), ((10, 20, 30, 40), (25, 5, 60, 35)), ((0, 0, 300, 9), (0, 0, 100, 9))]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(cases)], "i int, a struct<x1:int,y1:int,x2:int,y2:int>, b struct<x1:int,y1:int,x2:int,y2:int>")
    a, c = F.col("a"), F.col("b")
    rows = df.select("i", iou(a, c).alias("iou"), containment(a, c).alias("in"), width_ratio(a, c).alias("w"), union_box(a, c).alias("u"), box_area(a).alias("area")).orderBy("i").collect()
    assert rows[0]["iou"] < 0.3 and rows[0]["in"] > 0.9
    assert (rows[1]["iou"], rows[1]["in"]) == (0, 0) and (rows[2]["iou"], rows[2]["in"], rows[2]["area"], rows[2]["w"]) == (0, 0, 0, 0)
    assert tuple(rows[3]["u"]) == (10, 5, 60, 40) and rows[4]["w"] == pytest.approx(1 / 3)


def test_merging(spark):
    assert cleaned(spark, b(100, 100, 300, 2000), b(110, 120, 305, 2010, conf=0.7)) == [(100, 100, 305, 2010)]
    assert cleaned(spark, b(100, 100, 300, 2000), b(120, 400, 290, 900, conf=0.8)) == [(100, 100, 300, 2000)]
    assert len(cleaned(spark, b(1290, 1332, 2153, 5401), b(1884, 1716, 2168, 5554, conf=0.6))) == 2


def test_divider(spark):
    two = (b(300, 0, 500, 2000), b(310, 10, 510, 1990, conf=0.8))
    assert len(cleaned(spark, *two)) == 1
    edges = lambda *runs: spark.createDataFrame([(1, *r) for r in runs], "scan_id long, x long, y1 long, y2 long")
    assert len(cleaned(spark, *two, edges=edges((400, 10, 1910)))) == 2
    # Too short, outside of the overlap, or one of many columns alike: no divider.
    assert len(cleaned(spark, *two, edges=edges((400, 10, 500)))) == len(cleaned(spark, *two, edges=edges((505, 0, 2000)))) == len(cleaned(spark, *two, edges=edges(*[(x, 0, 2000) for x in range(300, 520)]))) == 1
    assert len(cleaned(spark, *two, edges=edges((400, 0, 300), (400, 900, 1300)))) == 2
    df = spark.createDataFrame([([900] * 100, 1980), ([], 1980), ([5], 1), (None, 10)], "hits array<int>, height int")
    assert [r[0] for r in df.select(divider_decision(F.col("hits"), F.col("height"))).collect()] == [False] * 4


def test_filters(spark):
    assert cleaned(spark, b(100, 100, 300, 2000), b(400, 0, 600, 2000, cls="vase"), b(700, 0, 900, 2000, conf=0.1)) == [(100, 100, 300, 2000)]
    assert cleaned(spark, b(1502, 645, 2015, 4716), b(2857, 1540, 4280, 4349), b(2, 2392, 1572, 2871), b(10, 10, 10, 500)) == [(1502, 645, 2015, 4716)]
    assert len(cleaned(spark, b(100, 100, 2000, 600), b(100, 700, 2000, 1200))) == 2
    assert cleaned(spark, b(100, 100, 300, 2000), b(900, 100, 940, 2000)) == [(100, 100, 300, 2000)]
    assert cleaned(spark) == []


def test_order_and_crops(spark):
    got = cleaned(spark, *[b(x, 0, x + 200, 2000) for x in (2000, 100, 1000)])
    assert [g[0] for g in got] == [100, 1000, 2000]
    rows = [(1, 0, "book", 0.9, 2.0, 2.0, 202.0, 2000.0, 205, 2003)]
    plan = clean_boxes(spark.createDataFrame(rows, BOX)).first()
    assert (plan["cx1"], plan["cy1"], plan["cx2"], plan["cy2"], plan["rotate"]) == (0, 0, 205, 2003, True)


def test_greedy_order(spark):
    """Of boxes with equal confidence the first one is kept; kept order stays by confidence."""
    rows = [(1, 2, 0.9, 0, 0, 10, 100), (1, 1, 0.9, 1, 0, 11, 100), (1, 3, 0.95, 50, 0, 60, 100)]
    got = merge_boxes(spark.createDataFrame(rows, "scan_id long, ord long, conf double, x1 int, y1 int, x2 int, y2 int")).orderBy("kept_pos").collect()
    assert [(r["ord"], r["x1"], r["x2"], r["n_merged"]) for r in got] == [(3, 50, 60, 1), (1, 0, 11, 2)]


def test_a_grown_box_is_looked_at_as_it_is(spark):
    """An edge beside the first box divides what it has grown to from the third."""
    three = (b(100, 0, 300, 2000), b(120, 0, 330, 2000, conf=0.8), b(140, 0, 330, 2000, conf=0.7))
    edge = spark.createDataFrame([(1, 315, 0, 1900)], "scan_id long, x long, y1 long, y2 long")
    assert len(cleaned(spark, *three)) == 1
    # The first two overlap up to 300, so they merge; grown to 330, the box meets the edge at 315.
    assert cleaned(spark, *three, edges=edge) == [(100, 0, 330, 2000), (140, 0, 330, 2000)]
    assert len(cleaned(spark, three[0], three[2], edges=edge)) == 1


def test_runs_of_points(spark):
    points = spark.createDataFrame([(1, 5, y) for y in (3, 4, 5, 9, 4)] + [(1, 6, 0), (2, 5, 7)], "scan_id long, x int, y int")
    assert sorted(tuple(r) for r in edge_runs(points).collect()) == [(1, 5, 3, 6), (1, 5, 9, 10), (1, 6, 0, 1), (2, 5, 7, 8)]
