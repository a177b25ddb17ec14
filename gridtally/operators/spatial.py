"""Range joins and geometry between objects, points, boxes, runs and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.operators.components import has_bit, pixel_words, word_at
from gridtally.session import merged

CELL = 64


def centroid_distance(ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt((ay - by) * (ay - by) + (ax - bx) * (ax - bx))


def bbox_iou(a: tuple, b: tuple) -> Column:
    """IoU of end-exclusive boxes given as (y1, x1, y2, x2); 0 for an empty union."""
    (ay1, ax1, ay2, ax2), (by1, bx1, by2, bx2) = a, b
    h = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0))
    w = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0))
    inter = (h * w).cast("double")
    area = lambda y1, x1, y2, x2: F.greatest(y2 - y1, F.lit(0)) * F.greatest(x2 - x1, F.lit(0))
    union = area(ay1, ax1, ay2, ax2) + area(by1, bx1, by2, bx2) - inter
    return F.coalesce(F.try_divide(inter, union.cast("double")), F.lit(0.0))


def distance_pairs(left: DataFrame, right: DataFrame, keys: list[str], max_dist: float, strict: bool = False) -> DataFrame:
    """All pairs of the same unit whose points lie within ``max_dist``, by a grid join.

    ``left`` has cy, cx and ``right`` has ry, rx. Cells are ``2 * max_dist`` wide: a left point lies in one
    cell, a right point is copied to the at most four cells its circle touches, so every pair is met once.
    """
    e = F.lit(2.0 * float(max_dist))
    d = F.lit(float(max_dist))
    cells = lambda c: F.array_distinct(F.array(F.floor((c - d) / e), F.floor((c + d) / e)))
    a = left.withColumn("_gy", F.floor(F.col("cy") / e)).withColumn("_gx", F.floor(F.col("cx") / e))
    b = right.withColumn("_gy", F.explode(cells(F.col("ry")))).withColumn("_gx", F.explode(cells(F.col("rx"))))
    dist = centroid_distance(F.col("cy"), F.col("cx"), F.col("ry"), F.col("rx"))
    near = F.col("dist") < d if strict else F.col("dist") <= d
    return a.join(b, [*keys, "_gy", "_gx"]).withColumn("dist", dist).where(near).drop("_gy", "_gx")


def _x_cells(x0: Column, x1: Column) -> Column:
    return F.explode(F.sequence(F.floor(x0 / F.lit(CELL)), F.floor(x1 / F.lit(CELL))))


def run_overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of overlapping intervals on the same row, with the length ``len`` they share.

    ``a`` has y, ax0, ax1 and ``b`` has y, bx0, bx1 (inclusive ends). Intervals are copied to the cells of
    the row they touch and a pair is kept only in the cell where its overlap starts.
    """
    l = a.withColumn("_c", _x_cells(F.col("ax0"), F.col("ax1")))
    r = b.withColumn("_c", _x_cells(F.col("bx0"), F.col("bx1")))
    start = F.greatest("ax0", "bx0")
    stop = F.least("ax1", "bx1")
    return (
        l.join(r, [*keys, "y", "_c"])
        .where((start <= stop) & (F.floor(start / F.lit(CELL)) == F.col("_c")))
        .withColumn("len", (stop - start + 1).cast("bigint"))
        .drop("_c")
    )


def box_rows(boxes: DataFrame, frame: tuple[int, int] | None = None) -> DataFrame:
    """One row per image row of a box (y1, x1, y2, x2 end-exclusive), clipped to the frame: y, ax0, ax1."""
    y1, x1 = F.greatest(F.col("y1"), F.lit(0)), F.greatest(F.col("x1"), F.lit(0))
    y2, x2 = F.col("y2"), F.col("x2")
    if frame is not None:
        y2, x2 = F.least(y2, F.lit(frame[0])), F.least(x2, F.lit(frame[1]))
    b = boxes.withColumn("_y1", y1).withColumn("ax0", x1).withColumn("_y2", y2).withColumn("ax1", x2 - 1)
    b = b.where((F.col("_y2") > F.col("_y1")) & (F.col("ax1") >= F.col("ax0")))
    return b.withColumn("y", F.explode(F.sequence("_y1", F.col("_y2") - 1))).drop("_y1", "_y2")


def box_overlap_pairs(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of boxes that share area, by a grid join; ``gt`` has gy1, gx1, gy2, gx2."""
    cells = lambda lo, hi: F.sequence(F.floor(lo / F.lit(CELL)), F.floor((hi - 1) / F.lit(CELL)))
    a = pred.where("y2 > y1 and x2 > x1").withColumn("_by", F.explode(cells(F.col("y1"), F.col("y2")))).withColumn("_bx", F.explode(cells(F.col("x1"), F.col("x2"))))
    b = gt.where("gy2 > gy1 and gx2 > gx1").withColumn("_by", F.explode(cells(F.col("gy1"), F.col("gy2")))).withColumn("_bx", F.explode(cells(F.col("gx1"), F.col("gx2"))))
    ys, xs = F.greatest("y1", "gy1"), F.greatest("x1", "gx1")
    return a.join(b, [*keys, "_by", "_bx"]).where(
        (ys < F.least("y2", "gy2")) & (xs < F.least("x2", "gx2"))
        & (F.floor(ys / F.lit(CELL)) == F.col("_by")) & (F.floor(xs / F.lit(CELL)) == F.col("_bx"))
    ).drop("_by", "_bx")


def pairwise_geometry(
    pred: DataFrame,
    gt: DataFrame,
    max_dist: float,
    gt_runs: DataFrame | None = None,
    pred_runs: DataFrame | None = None,
    frame: tuple[int, int] | None = None,
) -> DataFrame:
    """E5 (and D10): one row per pair of a unit that is near or whose prediction box holds truth pixels.

    ``pred``: uid, model, obj_id, cy, cx, y1, x1, y2, x2, area; ``gt``: uid, obj_id, cy, cx (and its box
    without ``gt_runs``). ``dist`` is NULL beyond the cap. With truth runs, ``hit`` means a truth pixel in
    the box; the overlap is the IoU inside the box when prediction runs are given, and the share of the
    box otherwise. Without truth runs it is the box IoU. All parts meet in a single aggregation.
    """
    p = pred.select("uid", "model", F.col("obj_id").alias("pred_id"), "cy", "cx", "y1", "x1", "y2", "x2", "area")
    g = gt.select("uid", F.col("obj_id").alias("gt_id"), F.col("cy").alias("ry"), F.col("cx").alias("rx"), *([] if gt_runs is not None else [F.col(c).alias(f"g{c}") for c in ("y1", "x1", "y2", "x2")]))
    key = ["uid", "model", "pred_id", "gt_id"]
    null, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    box_area = lambda: _box_area(frame)
    near = distance_pairs(p, g, ["uid"], max_dist).select(*key, "dist", zero.alias("px"), zero.alias("inter"), F.lit(None).cast("bigint").alias("size"), F.lit(0.0).alias("iou"))
    if gt_runs is None:
        iou = bbox_iou(tuple(F.col(c) for c in ("y1", "x1", "y2", "x2")), tuple(F.col(f"g{c}") for c in ("y1", "x1", "y2", "x2")))
        touch = box_overlap_pairs(p, g, ["uid"]).select(*key, null.alias("dist"), zero.alias("px"), zero.alias("inter"), F.lit(None).cast("bigint").alias("size"), iou.alias("iou"))
        got = near.unionByName(touch).groupBy(*key).agg(F.max("dist").alias("dist"), F.max("iou").alias("overlap"))
        return got.withColumn("hit", F.col("overlap") > 0)
    gr = gt_runs.select("uid", F.col("obj_id").alias("gt_id"), "y", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    size = F.col("area").cast("bigint") if pred_runs is not None else box_area()
    rows = box_rows(p.withColumn("size", size), frame).select("uid", "model", "pred_id", "size", "y", "ax0", "ax1")
    inside = run_overlaps(rows, gr, ["uid"]).select(*key, null.alias("dist"), F.col("len").alias("px"), zero.alias("inter"), "size", F.lit(0.0).alias("iou"))
    parts = near.unionByName(inside)
    if pred_runs is not None:
        pr = pred_runs.select("uid", "model", F.col("obj_id").alias("pred_id"), "y", F.col("x0").alias("ax0"), F.col("x1").alias("ax1"))
        shared = run_overlaps(pr, gr, ["uid"]).select(*key, null.alias("dist"), zero.alias("px"), F.col("len").alias("inter"), F.lit(None).cast("bigint").alias("size"), F.lit(0.0).alias("iou"))
        parts = parts.unionByName(shared)
    got = parts.groupBy(*key).agg(F.max("dist").alias("dist"), F.sum("px").alias("px"), F.sum("inter").alias("inter"), F.max("size").alias("size"))
    if pred_runs is not None:
        score = F.when(F.col("inter") > 0, F.col("inter") / (F.col("size") + F.col("px") - F.col("inter"))).otherwise(0.0)
    else:
        score = F.when(F.col("px") > 0, F.col("px") / F.col("size")).otherwise(0.0)
    return got.select(*key, "dist", score.cast("double").alias("overlap"), (F.col("px") > 0).alias("hit"))


def _box_area(frame: tuple[int, int] | None) -> Column:
    y1, x1 = F.greatest(F.col("y1"), F.lit(0)), F.greatest(F.col("x1"), F.lit(0))
    y2, x2 = F.col("y2"), F.col("x2")
    if frame is not None:
        y2, x2 = F.least(y2, F.lit(frame[0])), F.least(x2, F.lit(frame[1]))
    return ((y2 - y1) * (x2 - x1)).cast("bigint")


def component_iou(a_runs: DataFrame, b_runs: DataFrame) -> DataFrame:
    """Plain IoU of whole objects from their runs, for pairs that share a pixel."""
    a = a_runs.select("uid", F.col("obj_id").alias("pred_id"), "y", F.col("x0").alias("ax0"), F.col("x1").alias("ax1"))
    b = b_runs.select("uid", F.col("obj_id").alias("gt_id"), "y", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    inter = run_overlaps(a, b, ["uid"]).groupBy("uid", "pred_id", "gt_id").agg(F.sum("len").alias("inter"))
    size_a = a.groupBy("uid", "pred_id").agg(F.sum(F.col("ax1") - F.col("ax0") + 1).alias("area_a"))
    size_b = b.groupBy("uid", "gt_id").agg(F.sum(F.col("bx1") - F.col("bx0") + 1).alias("area_b"))
    x = inter.join(size_a, ["uid", "pred_id"]).join(size_b, ["uid", "gt_id"])
    return x.select("uid", "pred_id", "gt_id", "inter", (F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter"))).alias("iou"))


def points_in_box(boxes: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs where a point (ry, rx) lies in a box, all four sides included, by a grid join."""
    c = F.lit(float(CELL))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / c), F.floor(hi / c)))
    a = boxes.where("y2 >= y1 and x2 >= x1").withColumn("_gy", cells(F.col("y1"), F.col("y2"))).withColumn("_gx", cells(F.col("x1"), F.col("x2")))
    b = points.withColumn("_gy", F.floor(F.col("ry") / c)).withColumn("_gx", F.floor(F.col("rx") / c))
    inside = F.col("ry").between(F.col("y1"), F.col("y2")) & F.col("rx").between(F.col("x1"), F.col("x2"))
    return a.join(b, [*keys, "_gy", "_gx"]).where(inside).drop("_gy", "_gx")


def point_in_region(points: DataFrame, region_a: DataFrame, region_b: DataFrame, frame: tuple[int, int]) -> DataFrame:
    """Per unit, how many rounded and clipped points fall in A, B, both, only A, only B."""
    layers = region_a.select("uid", "y", "x", F.lit(True).alias("_l")).unionByName(region_b.select("uid", "y", "x", F.lit(False).alias("_l")))
    return points_in_words(points, pixel_words(layers, ["uid"], a=F.col("_l"), b=~F.col("_l")), frame)


def points_in_words(points: DataFrame, words: DataFrame, frame: tuple[int, int]) -> DataFrame:
    """D11 on regions as words of pixels ``a`` and ``b``."""
    clip = lambda c, n: F.least(F.greatest(F.rint(F.col(c)), F.lit(0)), F.lit(n - 1)).cast("int")
    p = points.select("uid", clip("cy", frame[0]).alias("y"), clip("cx", frame[1]).alias("x"))
    cells = p.groupBy("uid", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    x = cells.withColumn("_w", word_at(F.col("x"))).join(merged(words.select("uid", "y", "_w", "a", "b")), ["uid", "y", "_w"], "left")
    ia, ib = [F.coalesce(has_bit(F.col(c), F.col("x")), F.lit(False)) for c in ("a", "b")]
    tot = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint").alias(name)
    return x.groupBy("uid").agg(
        F.sum("n").cast("bigint").alias("n_points"), tot(ia, "in_a"), tot(ib, "in_b"), tot(ia & ib, "in_both"), tot(ia & ~ib, "only_a"), tot(~ia & ib, "only_b")
    )
