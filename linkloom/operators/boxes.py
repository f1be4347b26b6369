"""Cleaning detector boxes: shape, slivers, merging, reading order, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.config import BOXES, BoxConfig

SIDES = ("x1", "y1", "x2", "y2")


def filter_detections(boxes: DataFrame, config: BoxConfig = BOXES) -> DataFrame:
    """Boxes of the wanted class above the confidence floor, sides cut to whole numbers."""
    kept = boxes.where((F.col("cls") == config.kind) & (F.col("conf") >= config.min_conf))
    return kept.withColumns({c: F.col(c).cast("int") for c in SIDES})


def sides(c: Column) -> tuple[Column, ...]:
    return tuple(c[s] for s in SIDES)


def box_area(b: Column) -> Column:
    x1, y1, x2, y2 = sides(b)
    return F.greatest(x2 - x1, F.lit(0)).cast("long") * F.greatest(y2 - y1, F.lit(0))


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)).cast("long") * F.greatest(h, F.lit(0))


def over(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    common = intersection_area(a, b)
    return over(common, box_area(a) + box_area(b) - common)


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller box that lies in the other."""
    return over(intersection_area(a, b), F.least(box_area(a), box_area(b)))


def union_box(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))


def width_ratio(a: Column, b: Column) -> Column:
    wa, wb = a["x2"] - a["x1"], b["x2"] - b["x1"]
    return F.when(F.least(wa, wb) > 0, F.least(wa, wb) / F.greatest(wa, wb)).otherwise(F.lit(0.0))


def kept_or_all(boxes: DataFrame, ok: Column) -> DataFrame:
    """Rows that fulfil ``ok``; all rows of a scan that would lose every one."""
    some = F.max(ok.cast("int")).over(W.partitionBy("scan_id"))
    return boxes.withColumn("some", some).where(ok | (F.col("some") == 0)).drop("some")


def spine_shape_filter(boxes: DataFrame, config: BoxConfig = BOXES) -> DataFrame:
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return kept_or_all(boxes, F.when(width > 0, height / width >= config.min_aspect).otherwise(False))


def sliver_filter(boxes: DataFrame, config: BoxConfig = BOXES) -> DataFrame:
    return kept_or_all(boxes, (F.col("x2") - F.col("x1")) >= config.min_width_share * F.col("image_width"))


def divider_decision(hits: Column, height: Column, config: BoxConfig = BOXES) -> Column:
    """Does one column of an overlap hold an edge that divides it? ``hits``: edge points by column."""
    n, peak = F.size(hits), F.array_max(hits)
    ordered = F.array_sort(hits)
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.coalesce((n >= 2) & (height >= 2) & (peak >= config.divider_share * height) & (peak >= config.divider_peak * median), F.lit(False))


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edge_runs(points: DataFrame) -> DataFrame:
    """(scan_id, x, y1, y2): points of edges (scan_id, x, y) as runs from y1 up to y2, without y2, of one column."""
    place = F.row_number().over(W.partitionBy("scan_id", "x").orderBy("y"))
    islands = points.select("scan_id", "x", "y").distinct().withColumn("island", F.col("y") - place)
    return islands.groupBy("scan_id", "x", "island").agg(F.min("y").alias("y1"), (F.max("y") + 1).alias("y2")).drop("island")


def edge_columns(runs: DataFrame) -> DataFrame:
    """(scan_id, columns): the columns of each photo that have edges, each with its place and its runs."""
    columns = runs.groupBy("scan_id", F.col("x").cast("int").alias("x")).agg(F.collect_list(F.struct(F.col("y1").cast("int").alias("y1"), F.col("y2").cast("int").alias("y2"))).alias("runs"))
    return columns.groupBy("scan_id").agg(F.collect_list(F.struct("x", "runs")).alias("columns"))


def divides(columns: Column, a: Column, b: Column, config: BoxConfig = BOXES) -> Column:
    """Does an edge divide two boxes where they overlap? Each column's points in the overlap are added up from its runs; the other columns have none."""
    x1, y1, x2, y2 = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"])
    inside = lambda r: F.greatest(F.lit(0), F.least(r["y2"], y2) - F.greatest(r["y1"], y1))
    met = F.coalesce(F.filter(columns, lambda c: (c["x"] >= x1) & (c["x"] < x2)), F.slice(columns, 1, 0))
    hits = F.transform(met, lambda c: F.aggregate(c["runs"], F.lit(0), lambda n, r: n + inside(r)))
    decide = lambda found: divider_decision(F.concat(found, F.array_repeat(F.lit(0), x2 - x1 - F.size(found))), y2 - y1, config)
    return F.coalesce((x2 - x1 >= 2) & (y2 - y1 >= 2) & bound(hits, decide), F.lit(False))


def merge_boxes(boxes: DataFrame, edges: DataFrame | None = None, config: BoxConfig = BOXES) -> DataFrame:
    """Boxes by falling confidence join the first kept box that shows the same thing, which grows to hold them.

    ``edges``: (scan_id, x, y1, y2) runs of edge points in the columns of a photo, as ``edge_runs`` makes them; a divider
    in the overlap with a kept box, as far as it has grown, keeps a box apart. The order decides, so
    the boxes of one photo, a few dozen, are folded in one row.
    """
    rect = F.struct(*SIDES).alias("box")
    scans = boxes.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("rank"), "ord", "conf", rect))).alias("boxes"))
    apart = lambda k, x: F.lit(False)
    if edges is not None:
        scans = scans.join(edge_columns(edges), "scan_id", "left")
        apart = lambda k, x: divides(F.col("columns"), k["box"], x["box"], config)

    def same(k: Column, x: Column) -> Column:
        a, b = k["box"], x["box"]
        within = (containment(a, b) >= config.same_containment) & (width_ratio(a, b) >= config.same_width_ratio)
        return ((iou(a, b) >= config.same_iou) | within) & ~apart(k, x)

    def step(kept: Column, x: Column) -> Column:
        grown = lambda k: F.struct(k["ord"].alias("ord"), k["conf"].alias("conf"), union_box(k["box"], x["box"]).alias("box"), (k["n"] + 1).alias("n"))
        alone = F.struct(x["ord"].alias("ord"), x["conf"].alias("conf"), x["box"].alias("box"), F.lit(1).alias("n"))
        first = F.array_position(F.transform(kept, lambda k: same(k, x)), True)
        join = lambda at: F.when(at == 0, F.concat(kept, F.array(alone))).otherwise(F.transform(kept, lambda k, i: F.when(i + 1 == at, grown(k)).otherwise(k)))
        return bound(first, join)

    kind = dict(boxes.dtypes)
    none = F.array().cast(f"array<struct<ord:{kind['ord']},conf:{kind['conf']},box:struct<x1:int,y1:int,x2:int,y2:int>,n:int>>")
    kept = scans.select("scan_id", F.posexplode(F.aggregate("boxes", none, step)).alias("kept_pos", "k"))
    return kept.select("scan_id", "k.ord", "kept_pos", "k.conf", "k.box.*", F.col("k.n").alias("n_merged"))


def order_boxes(boxes: DataFrame) -> DataFrame:
    """Adds ``slot``: from left to right."""
    return boxes.withColumn("slot", F.row_number().over(W.partitionBy("scan_id").orderBy("x1", "kept_pos")))


def crop_plan(boxes: DataFrame, config: BoxConfig = BOXES) -> DataFrame:
    """Adds the padded, clamped rectangle of each crop and whether it is to be turned."""
    pad = config.padding
    out = boxes.withColumns({"cx1": F.greatest(F.col("x1") - pad, F.lit(0)), "cy1": F.greatest(F.col("y1") - pad, F.lit(0)), "cx2": F.least(F.col("x2") + pad, F.col("image_width")), "cy2": F.least(F.col("y2") + pad, F.col("image_height"))})
    width, height = F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1")
    return out.withColumn("rotate", F.when(width > 0, height / width >= config.rotate_aspect).otherwise(False))


def clean_boxes(boxes: DataFrame, edges: DataFrame | None = None, config: BoxConfig = BOXES) -> DataFrame:
    """Raw boxes to ordered spines: one shuffle by scan serves all steps."""
    kept = sliver_filter(spine_shape_filter(filter_detections(boxes, config), config), config)
    size = kept.groupBy("scan_id").agg(F.first("image_width").alias("image_width"), F.first("image_height").alias("image_height"))
    return crop_plan(order_boxes(merge_boxes(kept.select("scan_id", "ord", "conf", *SIDES), edges, config).join(size, "scan_id")), config)
