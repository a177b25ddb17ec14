"""Objects, points, cells and regions of a frame."""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.operators.components import WORD, graph_components, has_bit, label_runs, merge_runs, object_attributes, pixel_words, runs_from_pixels, word_at
from gridtally.operators.ranks import first_n_per_group
from gridtally.operators.spatial import box_rows, distance_pairs, points_in_box, points_in_words, run_overlaps
from gridtally.session import cut_lineage, join_keys, merged, ratio

# ---- E1 -----------------------------------------------------------------------------------------


def binarise(pixels: DataFrame, rule: str, threshold: float = 0.5, channel: int | None = None, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Foreground pixels of a raw value table.

    Rules: ``integer`` (> 0), ``probability`` (divided by 255 when an image exceeds 1, then >= t), ``runner``
    (> t * 255) and ``raw`` (> t). With ``channel`` the ``values`` array column is indexed; a channel that does
    not exist raises an error.
    """
    x = pixels
    if channel is not None:
        bad = F.concat(F.lit(f"channel {channel} out of range for "), F.size("values").cast("string"), F.lit(" channels"))
        x = x.withColumn(value, F.when(F.size("values") > channel, F.try_element_at("values", F.lit(channel + 1))).otherwise(F.raise_error(bad)))
    v = F.col(value)
    if rule == "integer":
        return x.where(v > 0)
    if rule == "runner":
        return x.where(v > threshold * 255)
    if rule == "raw":
        return x.where(v > threshold)
    if rule != "probability":
        raise ValueError(f"unknown rule {rule!r}")
    scale = x.groupBy(*(keys or ["uid"])).agg(F.when(F.max(v) > 1.0, 255.0).otherwise(1.0).alias("_scale"))
    return x.join(scale, keys or ["uid"]).where(v / F.col("_scale") >= threshold).drop("_scale")


def gray(channels: Column) -> Column:
    """Grey value of a (blue, green, red) array, with the usual fixed weights."""
    return F.floor(0.114 * channels[0] + 0.587 * channels[1] + 0.299 * channels[2] + 0.5).cast("int")


# ---- E16-E19, E32: objects -----------------------------------------------------------------------

MAX_MERGE_OBJECTS = 2_000_000
OBJECT_COLS = ["obj_id", "cy", "cx", "y1", "x1", "y2", "x2", "area"]


def merge_in_order(rows: list[tuple], dist: float) -> list[tuple]:
    """Objects (id, cy, cx, y1, x1, y2, x2, area) after one greedy pass in the given order.

    Objects not yet merged lie in a grid of cells of side ``dist``; the next one to absorb is the first in order,
    after the one absorbed last, among the nine cells around the centroid.
    """
    cell = lambda y, x: (math.floor(y / dist), math.floor(x / dist))
    grid: dict[tuple[int, int], list[int]] = {}
    for n, o in enumerate(rows):
        grid.setdefault(cell(o[1], o[2]), []).append(n)
    alive = [True] * len(rows)
    out = []
    for start, (i, cy, cx, y1, x1, y2, x2, area) in enumerate(rows):
        if not alive[start]:
            continue
        grid[cell(cy, cx)].remove(start)
        alive[start] = False
        last, n = start, 1
        while True:
            r, c = cell(cy, cx)
            found = None
            for key in ((r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                near = grid.get(key, ())
                for k in near[bisect_right(near, last) :]:
                    if found is not None and k > found:
                        break
                    if math.dist((cy, cx), (rows[k][1], rows[k][2])) < dist:
                        found = k
                        break
            if found is None:
                break
            o = rows[found]
            grid[cell(o[1], o[2])].remove(found)
            alive[found] = False
            cy, cx = (cy + o[1]) / 2.0, (cx + o[2]) / 2.0
            y1, x1, y2, x2 = min(y1, o[3]), min(x1, o[4]), max(y2, o[5]), max(x2, o[6])
            area += o[7]
            last, n = found, n + 1
        out.append((i, cy, cx, y1, x1, y2, x2, area, n))
    return out


def _merge_bin(keys: list[str], dist: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.sort_values("obj_id").groupby([*keys, "_comp"], sort=False, dropna=False):
            head = tuple(part[k].iloc[0] for k in keys)
            out += [(*head, *r) for r in merge_in_order(list(part[OBJECT_COLS].itertuples(index=False, name=None)), dist)]
        return pd.DataFrame(out, columns=[*keys, *OBJECT_COLS, "n_merged"])

    return run


def merge_close_objects(objects: DataFrame, dist: float, keys: list[str], max_objects: int = MAX_MERGE_OBJECTS) -> DataFrame:
    """Greedy merge in id order; the centroid moves to the midpoint, boxes unite, areas add.

    An absorbed object lies within ``dist`` of the moving centroid, which lies within ``dist / 2`` of the
    object absorbed last, so all merges stay inside components of the graph with edges below ``1.5 * dist``.
    Objects without an edge pass through; components take the pass inside tasks, packed into bins. A component above
    ``max_objects`` is settled tile by tile instead, with the same result.
    """
    o = cut_lineage(objects.select(*keys, "obj_id", "cy", "cx", "y1", "x1", "y2", "x2", F.col("area").cast("double").alias("area")))
    key = F.struct(*keys)
    a = o.select(key.alias("_k"), "obj_id", "cy", "cx")
    b = o.select(key.alias("_k"), F.col("obj_id").alias("other"), F.col("cy").alias("ry"), F.col("cx").alias("rx"))
    e = distance_pairs(a, b, ["_k"], 1.5 * dist, strict=True).where("obj_id < other")
    node = lambda c: F.struct("_k", F.col(c).alias("id"))
    roots = graph_components(e.select(node("obj_id").alias("a"), node("other").alias("b")))
    comp = roots.select(*[F.col("node._k")[k].alias(k) for k in keys], F.col("node.id").alias("obj_id"), F.col("root.id").cast("bigint").alias("_comp"))
    x = join_keys(o, comp, [*keys, "obj_id"], "left")
    single = x.where("_comp is null").drop("_comp").withColumn("n_merged", F.lit(1).cast("bigint"))
    sizes = comp.groupBy(*keys, "_comp").agg(F.count(F.lit(1)).alias("_n"))
    group = cut_lineage(join_keys(x.where("_comp is not null"), sizes, [*keys, "_comp"]))
    tally = group.agg(F.count(F.lit(1)).alias("n"), F.max("_n").alias("m")).first()
    bins = max(1, -(-tally["n"] // 50_000), min(tally["n"] // 500, 64))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in single.schema.fields)
    merged = (
        group.where(F.col("_n") <= max_objects)
        .withColumn("_bin", F.pmod(F.xxhash64(*keys, "_comp"), F.lit(bins)))
        .groupBy("_bin")
        .applyInPandas(_merge_bin(keys, float(dist)), schema)
    )
    out = single.unionByName(merged)
    if tally["m"] is not None and tally["m"] > max_objects:
        from gridtally.operators.augment import merge_by_tiles

        out = out.unionByName(merge_by_tiles(group.where(F.col("_n") > max_objects).drop("_n"), [*keys, "_comp"], float(dist)).select(*single.columns))
    return out


def split_large_predictions(pred: DataFrame, gt: DataFrame, keys: list[str], size: int = 10) -> DataFrame:
    """A box that holds two or more truth centroids becomes one square per centroid."""
    half = max(1, int(size) // 2)
    p = pred.select(*keys, "obj_id", "y1", "x1", "y2", "x2")
    g = gt.select(*keys, F.col("obj_id").alias("gt_id"), F.col("cy").alias("ry"), F.col("cx").alias("rx"))
    held = points_in_box(p, g, keys).select(*keys, "obj_id", "gt_id", "ry", "rx")
    many = held.groupBy(*keys, "obj_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    ry, rx = F.rint("ry").cast("int"), F.rint("rx").cast("int")
    squares = held.join(many, [*keys, "obj_id"]).select(
        *keys, F.col("ry").alias("cy"), F.col("rx").alias("cx"), (ry - half).alias("y1"), (rx - half).alias("x1"), (ry + half).alias("y2"), (rx + half).alias("x2"),
        F.lit(float(size * size)).alias("area"), F.lit(True).alias("is_split"), F.col("obj_id").alias("split_from"),
    )
    kept = pred.join(many, [*keys, "obj_id"], "left_anti").select(
        *keys, "cy", "cx", "y1", "x1", "y2", "x2", F.col("area").cast("double").alias("area"), F.lit(False).alias("is_split"), F.lit(None).cast("bigint").alias("split_from")
    )
    return kept.unionByName(squares)


def objects_to_pixels(boxes: DataFrame, frame: tuple[int, int], object_pixels: DataFrame | None = None, keys: list[str] = ["uid"]) -> DataFrame:
    """Distinct pixels of the objects: their own pixels where given, else the clipped box."""
    plain = boxes
    if object_pixels is not None:
        plain = boxes.join(object_pixels.select(*keys, "obj_id").distinct(), [*keys, "obj_id"], "left_anti")
    filled = box_rows(plain.select(*keys, "y1", "x1", "y2", "x2"), frame).select(*keys, "y", F.explode(F.sequence("ax0", "ax1")).alias("x"))
    if object_pixels is not None:
        filled = filled.unionByName(object_pixels.select(*keys, "y", "x"))
    return filled.distinct()


def classify_by_region_mean(objects: DataFrame, cells: DataFrame, keys: list[str], value_min: float = 170.0, saturation_max: float = 50.0, labels: tuple[str, str] = ("bright", "coloured")) -> DataFrame:
    """First label when the mean value exceeds its limit and the mean saturation stays below; empty boxes get the second."""
    rows = box_rows(objects.select(*keys, "obj_id", "y1", "x1", "y2", "x2")).select(*keys, "obj_id", "y", "ax0", "ax1")
    c = cells.select(*keys, "y", F.col("x").alias("bx0"), F.col("x").alias("bx1"), "v", "s")
    means = run_overlaps(rows, c, keys).groupBy(*keys, "obj_id").agg(F.avg("v").alias("mean_v"), F.avg("s").alias("mean_s"))
    label = F.when((F.col("mean_v") > value_min) & (F.col("mean_s") < saturation_max), labels[0]).otherwise(labels[1])
    return objects.select(*keys, "obj_id").join(means, [*keys, "obj_id"], "left").withColumn("label", label)


def label_counts(labelled: DataFrame, keys: list[str], labels: tuple[str, str] = ("bright", "coloured")) -> DataFrame:
    """Objects per label and unit."""
    return labelled.groupBy(*keys).agg(*[F.count_if(F.col("label") == v).alias(f"n_{v}") for v in labels])


# ---- E20-E23: regions ----------------------------------------------------------------------------


def pixel_confusion(pixels: DataFrame, images: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """TP, FP, FN from sparse pixels of two layers and TN from the frame size.

    ``images``: uid, h, w and optionally pred_h, pred_w; a different prediction frame gives an error row.
    """
    side = lambda s: F.max(F.col("layer") == s)
    per = pixels.where(F.col("layer").isin(gt, pred)).groupBy("uid", "y", "x").agg(side(gt).alias("g"), side(pred).alias("p"))
    n = per.groupBy("uid").agg(
        F.count_if(F.col("g") & F.col("p")).alias("pix_tp"), F.count_if(~F.col("g") & F.col("p")).alias("pix_fp"), F.count_if(F.col("g") & ~F.col("p")).alias("pix_fn")
    )
    x = images.join(n, "uid", "left").fillna(0, ["pix_tp", "pix_fp", "pix_fn"])
    x = x.withColumn("pix_tn", F.col("h").cast("bigint") * F.col("w") - F.col("pix_tp") - F.col("pix_fp") - F.col("pix_fn"))
    if "pred_h" not in images.columns:
        return x.select("uid", "pix_tp", "pix_fp", "pix_fn", "pix_tn")
    same = (F.col("h") == F.col("pred_h")) & (F.col("w") == F.col("pred_w"))
    return x.select("uid", *[F.when(same, F.col(c)).alias(c) for c in ("pix_tp", "pix_fp", "pix_fn", "pix_tn")], F.when(~same, "shape mismatch").alias("error"))


def region_mask(pixels: DataFrame, roi: DataFrame, keys: list[str] = ["uid"]) -> DataFrame:
    """Pixels inside the region, which takes part as words of 64 pixels."""
    r = merged(pixel_words(roi, keys, _b=F.lit(True)).select(*[F.col(c).alias(f"_r_{c}") for c in (*keys, "y", "_w")], F.col("_b").alias("_r_bits")))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in (*keys, "y")])
    return pixels.join(r, same & (word_at(F.col("x")) == F.col("_r__w")) & has_bit(F.col("_r_bits"), F.col("x")), "left_semi")


def region_agreement(pixels: DataFrame, points: DataFrame, frame: tuple[int, int], a: str, b: str, gt: str) -> DataFrame:
    """Overlap of regions a (manual) and b (predicted), and what each keeps of the truth.

    ``pixels`` holds the three layers a, b and gt; ``points`` the truth centroids.
    """
    is_ = lambda s: F.col("layer") == s
    per = pixel_words(pixels.where(F.col("layer").isin(a, b, gt)), ["uid"], a=is_(a), b=is_(b), g=is_(gt))
    c = lambda *of: F.sum(F.bit_count(reduce(Column.bitwiseAND, [F.col(v) for v in of]))).cast("bigint")
    n = per.groupBy("uid").agg(
        c("a").alias("manual_px"), c("b").alias("pred_px"), c("a", "b").alias("intersection_px"), c("g").alias("gt_fg_px"), c("g", "b").alias("gt_fg_px_in_roi")
    )
    pts = points_in_words(points, pixel_words(pixels.where(F.col("layer").isin(a, b)), ["uid"], a=is_(a), b=is_(b)), frame)
    x = n.join(pts, "uid", "left")
    m, p, i = F.col("manual_px"), F.col("pred_px"), F.col("intersection_px")
    num = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint"))
    return x.select(
        "uid", m, p, i, ratio(i, m + p - i).alias("iou"), ratio(2 * i, m + p).alias("dice"), ratio(i, m).alias("frac_manual_covered"), ratio(p, m).alias("area_ratio"),
        (p - i).alias("pred_outside_manual_px"), (m - i).alias("manual_only_px"), (p == 0).alias("pred_roi_empty"), "gt_fg_px", "gt_fg_px_in_roi", ratio(F.col("gt_fg_px_in_roi"), F.col("gt_fg_px")).alias("pixel_retention"),
        num("n_points").alias("gt_objects"), num("in_b").alias("gt_objects_in_roi"), ratio(F.col("in_b"), F.col("n_points")).alias("object_retention"), num("in_a").alias("gt_objects_in_manual"),
        num("in_both").alias("gt_objects_in_both"), num("only_a").alias("gt_objects_manual_only"), num("only_b").alias("gt_objects_pred_only"), ratio(F.col("in_both"), F.col("in_a")).alias("retention_vs_manual"),
    )


def retention(units: DataFrame, gt_pixels: DataFrame, roi_pixels: DataFrame) -> DataFrame:
    """Truth pixels before and after masking by the region.

    ``units``: uid, h, w, roi_h, roi_w (NULL without a region mask).
    """
    tagged = gt_pixels.select("uid", "y", "x", F.lit(True).alias("_l")).unionByName(roi_pixels.select("uid", "y", "x", F.lit(False).alias("_l")))
    per = pixel_words(tagged, ["uid"], g=F.col("_l"), r=~F.col("_l"))
    n = per.groupBy("uid").agg(F.sum(F.bit_count("g")).cast("bigint").alias("gt_px"), F.sum(F.bit_count(F.col("g").bitwiseAND(F.col("r")))).cast("bigint").alias("kept_px"))
    x = units.join(n, "uid", "left").fillna(0, ["gt_px", "kept_px"])
    same = (F.col("h") == F.col("roi_h")) & (F.col("w") == F.col("roi_w"))
    status = (
        F.when(F.col("roi_h").isNull(), "no_mask")
        .when(~same & (F.col("h") == F.col("roi_w")) & (F.col("w") == F.col("roi_h")), "transposed")
        .when(~same, "shape")
        .when((F.col("gt_px") > 0) & (F.col("kept_px") == 0), "empty_after_mask")
        .otherwise("ok")
    )
    fine = status.isin("ok", "empty_after_mask")
    return x.select(
        "uid", status.alias("status"), F.when(fine, F.col("gt_px")).otherwise(0).alias("gt_px"), F.when(fine, F.col("kept_px")).otherwise(0).alias("kept_px"),
        F.when(fine, ratio(F.col("kept_px"), F.col("gt_px"))).alias("kept_frac"),
    )


# ---- E24-E31, E33: cells and points --------------------------------------------------------------


def local_maxima(cells: DataFrame, threshold: float, r: int, border: int = 0, frame: tuple[int, int] | None = None, keys: list[str] = ["uid"]) -> DataFrame:
    """Cells that equal the maximum of their (2r+1)-square window and reach the threshold; plateaus stay.

    Cells are copied to the 2r+1 rows their window reaches; the maximum along x is a range window over one
    image row, so nothing is paired. A cell below the threshold is no maximum and exceeds none, so only the others are copied.
    """
    copies = cells.where(F.col("p") >= threshold).select(*keys, "y", "x", "p", F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("_d")).withColumn("_row", F.col("y") + F.col("_d"))
    w = W.partitionBy(*keys, "_row").orderBy("x").rangeBetween(-r, r)
    top = copies.withColumn("_m", F.max("p").over(w)).where("_d = 0")
    got = top.where((F.col("p") == F.greatest("_m", F.lit(0.0))) & (F.col("p") >= threshold)).select(*keys, "y", "x", "p")
    if border > 0:
        if frame is None:
            raise ValueError("a border needs the frame size")
        got = got.where(F.col("y").between(border, frame[0] - border - 1) & F.col("x").between(border, frame[1] - border - 1))
    return got


#: Side of a suppression tile in multiples of the distance, and its least side in cells.
TILE_REACH, TILE_LEAST = 8, 128
#: Rows that the tiles of one task hold together, as far as whole tiles allow.
TILE_ROWS = 50_000


def settle_peaks(rows: list[tuple[float, float, float, bool, bool]], dist: float) -> list[int]:
    """State of each peak (s, y, x, own, kept) of a tile and its rim, given in order: 1 kept, 0 open, -1 dropped.

    A peak near a better kept one is dropped. One near a better open peak stays open, and so does a peak of the rim, whose
    other neighbours are not here. All others are kept. Kept and open peaks lie in a grid of cells of side ``dist``.
    """
    held: dict[tuple[int, int], list[tuple[float, float]]] = {}
    unsure: dict[tuple[int, int], list[tuple[float, float]]] = {}
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]

    def near(grid: dict, y: float, x: float) -> bool:
        r, c = math.floor(y / dist), math.floor(x / dist)
        return any(math.sqrt((y - v) * (y - v) + (x - w) * (x - w)) < dist for a, b in around for v, w in grid.get((r + a, c + b), ()))

    out = []
    for _, y, x, own, kept in rows:
        state = 1 if kept else -1 if near(held, y, x) else 0 if not own or near(unsure, y, x) else 1
        if state >= 0:
            (held if state else unsure).setdefault((math.floor(y / dist), math.floor(x / dist)), []).append((y, x))
        out.append(state)
    return out


def _settle_tiles(keys: list[str], dist: float):
    columns = [*keys, "y", "x", "s", "kept"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.sort_values(["s", "y", "x"]).groupby([*keys, "_ty", "_tx"], sort=False, dropna=False):
            if not part["own"].any():
                continue
            state = settle_peaks(list(part[["s", "y", "x", "own", "kept"]].itertuples(index=False, name=None)), dist)
            mine = part.assign(kept=[v > 0 for v in state])[[v >= 0 for v in state]]
            out.append(mine[mine["own"]][columns])
        return pd.concat(out) if out else pdf.iloc[:0][columns]

    return run


def greedy_nms(peaks: DataFrame, min_dist: float, keys: list[str] = ["uid"], max_points: int | None = None, tile: float | None = None) -> DataFrame:
    """By falling score, drop peaks closer than ``min_dist`` to a kept one; ties by row, then column.

    Of several peaks at one place only the best can stay, so they are reduced to it before anything is shuffled. Tiles
    (of side ``tile``) then take the ordered pass inside tasks, each with a rim of ``min_dist``, and leave open what hangs on
    an open peak of the rim. The next round has only the open peaks and the newly kept ones near a border, so no pair of
    peaks ever becomes a row, and rounds are as many as a chain of falling scores crosses borders. A tile holds one peak per place at
    most. Peaks without score or place are never compared and stay.
    """
    kept = peaks
    if min_dist > 0:
        dist, side = float(min_dist), float(tile or max(TILE_LEAST, TILE_REACH * min_dist))
        place = [*keys, "y", "x"]
        others = [c for c in peaks.columns if c not in place]
        known = F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("p").isNotNull()
        best = peaks.where(known).groupBy(*place).agg(F.max_by(F.struct(*others), F.struct("p", F.xxhash64(*others))).alias("_o"))
        best = cut_lineage(best.select(*place, *[F.col("_o")[c].alias(c) for c in others]))
        kinds = {f.name: f.dataType.simpleString() for f in best.schema.fields}
        schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", y double, x double, s double, kept boolean"
        at = lambda c: F.floor(F.col(c) / F.lit(side))
        reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.lit(dist)) / F.lit(side)), F.floor((F.col(c) + F.lit(dist)) / F.lit(side))))
        rows = best.select(*keys, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), (-F.col("p")).cast("double").alias("s"), F.lit(False).alias("kept"))
        done, n = [], best.count()
        while n:
            seen = rows.withColumn("_ty", reach("y")).withColumn("_tx", reach("x")).withColumn("own", (F.col("_ty") == at("y")) & (F.col("_tx") == at("x")) & ~F.col("kept"))
            seen = seen.where(F.col("own") | (F.col("_ty") != at("y")) | (F.col("_tx") != at("x")))
            bins = max(1, -(-n // TILE_ROWS), min(n // 500, 64))
            state = cut_lineage(seen.withColumn("_bin", F.pmod(F.xxhash64(*keys, "_ty", "_tx"), F.lit(bins))).groupBy("_bin").applyInPandas(_settle_tiles(keys, dist), schema))
            done.append(state.where("kept"))
            if len(done) == 16:  # a plan of bounded size, however many rounds there are
                done = [cut_lineage(reduce(DataFrame.unionByName, done))]
            rows, n = state, state.where(~F.col("kept")).count()
        if done:
            stay = reduce(DataFrame.unionByName, done).select(*keys, F.col("y").cast(kinds["y"]).alias("y"), F.col("x").cast(kinds["x"]).alias("x"), F.lit(True).alias("_stay"))
            best = join_keys(best, stay, place).drop("_stay")
        kept = best.select(*peaks.columns).unionByName(peaks.where(~known))
    if max_points:
        kept = first_n_per_group(kept, keys, [F.desc("p"), "y", "x"], max_points)
    return kept


def gauss_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised one-dimensional Gaussian weights of offsets -r..r."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [v / sum(w) for v in w]


#: Side of the tiles of a frame whose cells are made together, and cells that one task makes.
CELL_TILE, TASK_CELLS = 64, 500_000


def _dealt(points: DataFrame, keys: list[str], rows: Column, columns: Column, cells: int) -> DataFrame:
    """``points`` copied to the tiles (_ty, _tx) they reach, given as lists, and dealt to as many tasks as their ``cells`` need.

    Only points are shuffled: whatever is grouped by tile afterwards stays in its task.
    """
    copies = points.withColumn("_ty", F.explode(F.array_distinct(rows))).withColumn("_tx", F.explode(F.array_distinct(columns)))
    return copies.repartition(max(1, -(-cells // TASK_CELLS)), *keys, "_ty", "_tx")


def _tile(at: Column) -> Column:
    return F.floor(at / F.lit(CELL_TILE))


def _tiles(at: Column, rim: int) -> Column:
    """The tiles that hold ``at`` within themselves or ``rim`` cells around."""
    return F.array(*[_tile(at + o) for o in (*range(-rim, rim, CELL_TILE), rim)])


def _held(at: Column, tile: Column, rim: int) -> Column:
    """Whether ``tile`` with its rim holds ``at``; a missing place is held by the missing tile."""
    return F.coalesce((at >= tile * CELL_TILE - rim) & (at < (tile + 1) * CELL_TILE + rim), at.isNull())


def _own() -> Column:
    return _tile(F.col("y")).eqNullSafe(F.col("_ty")) & _tile(F.col("x")).eqNullSafe(F.col("_tx"))


def _places(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cut_lineage(cells.groupBy(*keys, "y", "x").agg(F.sum("p").alias("p")))


def _smoothed(places: DataFrame, weights: list[float], frame: tuple[int, int], keys: list[str], cells: int, rim: int = 0) -> DataFrame:
    """The smoothed cells of every tile (_ty, _tx) and of ``rim`` cells around it."""
    r = len(weights) // 2
    taps = F.array(*[F.struct(F.lit(i - r).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(weights)])
    tile = [*keys, "_ty", "_tx"]

    def folded(at: Column, n: int) -> Column:
        m = F.pmod(at, F.lit(2 * n))
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    def reached(axis: str, n: int) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda d: _tiles(folded(F.col(axis) + d, n), rim)))

    def blur(df: DataFrame, axis: str, n: int) -> DataFrame:
        other = "x" if axis == "y" else "y"
        t = df.withColumn("_t", F.explode(taps)).select(*tile, other, folded(F.col(axis) + F.col("_t.d"), n).alias(axis), (F.col("p") * F.col("_t.w")).alias("p"))
        return t.where(_held(F.col(axis), F.col(f"_t{axis}"), rim)).groupBy(*tile, "y", "x").agg(F.sum("p").alias("p"))

    dealt = _dealt(places, keys, reached("y", frame[0]), reached("x", frame[1]), cells)
    return blur(blur(dealt, "x", frame[1]), "y", frame[0])


def kernel_sum(cells: DataFrame, weights: list[float], frame: tuple[int, int], keys: list[str] = ["uid"]) -> DataFrame:
    """Smoothing of sparse cells by a separable symmetric kernel, one axis after the other.

    The image is mirrored at the frame edge: a tap that falls outside is folded back to where its mirror lies. Cells go to
    the tiles that their taps reach, and both axes are summed there.
    """
    one = _places(cells, keys)
    return _smoothed(one, weights, frame, keys, one.count() * len(weights) ** 2).select(*keys, "y", "x", "p")


def _region_boxes(roi: DataFrame, frame: tuple[int, int], keys: list[str]) -> DataFrame:
    """A region as boxes (y1, x1, y2, x2 end-exclusive): its own, clipped to the frame, or the runs of its pixels."""
    if "y1" not in roi.columns:
        runs = runs_from_pixels(roi, keys)
        return cut_lineage(runs.select(*keys, F.col("y").cast("bigint").alias("y1"), F.col("x0").alias("x1"), (F.col("y") + 1).cast("bigint").alias("y2"), (F.col("x1") + 1).alias("x2")))
    low, high = (lambda c: F.greatest(F.col(c), F.lit(0)).alias(c)), (lambda c, n: F.least(F.col(c), F.lit(n)).alias(c))
    whole = roi.dropna(subset=["y1", "x1", "y2", "x2"])
    return whole.select(*keys, low("y1"), low("x1"), high("y2", frame[0]), high("x2", frame[1])).where("y2 > y1 and x2 > x1")


def _in_region(cells: DataFrame, boxes: DataFrame, keys: list[str], n: int, rim: int) -> DataFrame:
    """Cells of tiles with a rim that lie in the boxes, which are dealt like the cells and become words of pixels in the tile.

    Only the tile is an equation for the join, so that it takes both sides as they were dealt; the place is a condition over the
    few words of a tile.
    """
    tile = [*keys, "_ty", "_tx"]
    reached = lambda a: F.sequence(_tile(F.col(f"{a}1") - rim), _tile(F.col(f"{a}2") - 1 + rim))
    low = lambda a: F.greatest(F.col(f"{a}1"), F.col(f"_t{a}") * CELL_TILE - rim)
    high = lambda a: F.least(F.col(f"{a}2"), (F.col(f"_t{a}") + 1) * CELL_TILE + rim) - 1
    rows = _dealt(boxes, keys, reached("y"), reached("x"), n).select(*tile, F.explode(F.sequence(low("y"), high("y"))).alias("_y"), low("x").alias("_x0"), high("x").alias("_x1"))
    words = rows.withColumn("_w", F.explode(F.sequence(word_at(F.col("_x0")), word_at(F.col("_x1")))))
    shift = lambda way, by: F.call_function(way, F.lit(-1).cast("bigint"), by.cast("int"))
    first, last = F.greatest(F.col("_x0") - F.col("_w") * WORD, F.lit(0)), F.least(F.col("_x1") - F.col("_w") * WORD, F.lit(WORD - 1))
    bits = shift("shiftleft", first).bitwiseAND(shift("shiftrightunsigned", WORD - 1 - last))
    words = words.groupBy(*tile, "_y", "_w").agg(F.bit_or(bits).alias("_bits"))
    words = merged(words.select(*[F.col(k).alias(f"_r_{k}") for k in tile], "_y", "_w", "_bits"))
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_r_{k}") for k in tile])
    here = (F.col("y") - F.col("_y") == 0) & (word_at(F.col("x")) - F.col("_w") == 0) & has_bit(F.col("_bits"), F.col("x"))
    return cells.join(words, same & here, "left_semi")


def detect_points(
    cells: DataFrame, frame: tuple[int, int], threshold: float, r: int, nms_dist: float, sigma: float = 0.0, roi: DataFrame | None = None, border: int = 0, max_points: int | None = None, keys: list[str] = ["uid"],
) -> DataFrame:
    """Smooth, apply the region, find maxima, suppress neighbours, in this order.

    Smoothed values are rounded to nine decimals, so that the order of a floating-point sum cannot break a plateau. The region
    is a table of pixels (y, x) or of boxes (y1, x1, y2, x2). Only unsmoothed cells and boxes are shuffled: a tile makes the smoothed cells of
    itself and of ``r`` cells around it, and takes the region and the maxima in the same task.
    """
    for name, v in (("sigma", sigma), ("threshold", threshold), ("distance", nms_dist), ("border", border)):
        if v < 0:
            raise ValueError(f"negative {name}: {v}")
    if r < 0:
        raise ValueError(f"a window needs at least one cell, its radius is {r}")
    weights = gauss_weights(sigma) if sigma > 0 else [1.0]
    places = _places(cells, keys) if sigma > 0 else cut_lineage(cells.select(*keys, "y", "x", "p").where(F.col("p") >= threshold))
    n = places.count() * len(weights) ** 2
    if roi is not None:
        boxes = _region_boxes(roi, frame, keys)
        words = (F.col("y2") - F.col("y1")) * (word_at(F.col("x2") - 1) - word_at(F.col("x1")) + 1)
        n += boxes.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
        n = max(n, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")) * TASK_CELLS)  # a join deals fewer tasks anew
    if sigma > 0:
        x = _smoothed(places, weights, frame, keys, n, r).withColumn("p", F.round("p", 9))
    else:
        x = _dealt(places, keys, _tiles(F.col("y"), r), _tiles(F.col("x"), r), n)
    if roi is not None:
        x = _in_region(x.where(F.col("p") >= threshold), boxes, keys, n, r)
    peaks = local_maxima(x, threshold, r, border, frame, [*keys, "_ty", "_tx"]).where(_own()).select(*keys, "y", "x", "p")
    return greedy_nms(cut_lineage(peaks), nms_dist, keys, max_points)


def rasterise_points(points: DataFrame, sigma: float, frame: tuple[int, int], merge: str = "max", normalise: bool = True, keys: list[str] = ["uid"]) -> DataFrame:
    """Gaussian stamps of radius int(3 sigma) + 1 around points (x, y), combined by max or sum.

    Points, not cells, go to the tiles that their stamps reach; for the scale of a unit the stamps are made twice.
    """
    if not sigma > 0:
        raise ValueError(f"a stamp of width {sigma} has no cells")
    r = int(3 * sigma) + 1
    span = F.sequence(F.lit(-r), F.lit(r))
    cy, cx = F.col("cy"), F.col("cx")
    near = cy.cast("int").between(-r, frame[0] - 1 + r) & cx.cast("int").between(-r, frame[1] - 1 + r)
    places = points.select(*keys, F.col("y").cast("double").alias("cy"), F.col("x").cast("double").alias("cx")).where(near)
    places = cut_lineage(places.groupBy(*keys, "cy", "cx").agg(F.count(F.lit(1)).alias("_m")))
    cells = places.count() * (2 * r + 1) ** 2
    reached = lambda c, n: F.sequence(_tile(F.greatest(c.cast("int") - r, F.lit(0))), _tile(F.least(c.cast("int") + r, F.lit(n - 1))))

    def stamped(src: DataFrame, *also: str) -> DataFrame:
        x = _dealt(src, keys, reached(cy, frame[0]), reached(cx, frame[1]), cells)
        x = x.withColumn("dy", F.explode(span)).withColumn("y", cy.cast("int") + F.col("dy")).where(F.col("y").between(0, frame[0] - 1) & (_tile(F.col("y")) == F.col("_ty")))
        x = x.withColumn("dx", F.explode(span)).withColumn("x", cx.cast("int") + F.col("dx")).where(F.col("x").between(0, frame[1] - 1) & (_tile(F.col("x")) == F.col("_tx")))
        g = F.exp(-(F.pow(F.col("x") - cx, F.lit(2.0)) + F.pow(F.col("y") - cy, F.lit(2.0))) / F.lit(2.0 * sigma * sigma))
        return x.withColumn("g", g).groupBy(*keys, *also, "_ty", "_tx", "y", "x").agg((F.max("g") if merge == "max" else F.sum(F.col("g") * F.col("_m"))).alias("p"))

    if not normalise:
        return stamped(places).select(*keys, "y", "x", "p")
    lim = stamped(places).groupBy(*keys).agg(F.min("p").alias("_lo"), F.max("p").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    lim = lim.select(*keys, F.when(F.col("_n") < frame[0] * frame[1], 0.0).otherwise(F.col("_lo")).alias("_lo"), "_hi")
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("p") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return stamped(places.join(merged(lim), keys), "_lo", "_hi").select(*keys, "y", "x", scaled.alias("p"))


def render_diamonds(points: DataFrame, radius: int, frame: tuple[int, int], keys: list[str] = ["uid"]) -> DataFrame:
    """Distinct cells within the L1 radius of a point inside the frame; a single cell for radius 0."""
    r = max(0, radius)
    offs = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dy) + abs(dx) <= r]
    x = points.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offs])))
    x = x.select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
    return x.where(F.col("y").between(0, frame[0] - 1) & F.col("x").between(0, frame[1] - 1)).distinct()


def rescale_points(points: DataFrame, sy: float, sx: float) -> DataFrame:
    """Scaled coordinates, rounded half to even; render them again at the new size."""
    return points.withColumn("y", F.rint(F.col("y") * sy).cast("int")).withColumn("x", F.rint(F.col("x") * sx).cast("int"))


def otsu_threshold(values: DataFrame, keys: list[str], factor: float = 1.0, value: str = "v") -> DataFrame:
    """The histogram value of largest between-class variance, times a factor, clipped to 0..255.

    The histogram of a unit has at most 256 rows, whatever the number of pixels.
    """
    h = values.groupBy(*keys, F.col(value).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    up = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    x = h.select(
        *keys, "v", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s")
    ).withColumn("w1", F.col("w") - F.col("w0"))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(F.col("w1"), F.lit(0))
    var = F.coalesce(F.col("w0").cast("double") / F.col("w") * (F.col("w1").cast("double") / F.col("w")) * gap * gap, F.lit(0.0))
    best = x.groupBy(*keys).agg(F.min(F.struct((-var).alias("s"), F.when(var > 0, F.col("v")).otherwise(0).alias("v"))).alias("b"))
    clipped = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("b.v") * float(factor))).cast("int")
    return best.select(*keys, F.col("b.v").alias("otsu"), clipped.alias("threshold"))


def fill_holes(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Background regions (edge-connected) that do not touch the frame become foreground.

    Background runs come from the gaps between foreground runs of a row, so no dense image is built.
    """
    full = _filled_runs(runs_from_pixels(pixels, ["uid"]), images)
    return full.select("uid", F.col("y").cast(pixels.schema["y"].dataType).alias("y"), F.explode(F.sequence("x0", "x1")).alias("x"))


def _filled_runs(runs: DataFrame, images: DataFrame) -> DataFrame:
    """The runs of ``fill_holes``."""
    runs = cut_lineage(runs)
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).select("uid", "y", "h", "w")
    w = W.partitionBy("uid", "y").orderBy("x0")
    edge = rows.select("uid", "y", "w", F.col("w").alias("x0"), F.col("w").alias("x1")).unionByName(runs.join(images.select("uid", "w"), "uid").select("uid", "y", "w", "x0", "x1"))
    gaps = edge.select("uid", "y", (F.coalesce(F.lag("x1").over(w), F.lit(-1)) + 1).alias("x0"), (F.col("x0") - 1).alias("x1")).where("x1 >= x0")
    lab = label_runs(gaps, ["uid"], connectivity=4)
    touching = lab.join(images, "uid").withColumn("t", (F.col("y") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1))
    open_ = touching.groupBy("uid", "comp").agg(F.max("t").alias("t")).where("t").drop("t")
    holes = lab.join(merged(open_), ["uid", "comp"], "left_anti").select("uid", "y", F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    return merge_runs(runs.select("uid", "y", "x0", "x1").unionByName(holes), ["uid"])


def keep_center_component(pixels: DataFrame, images: DataFrame, fill: bool = True) -> DataFrame:
    """The edge-connected component that holds the image centre, or everything where it is background."""
    runs = runs_from_pixels(pixels, ["uid"])
    lab = label_runs(_filled_runs(runs, images) if fill else runs, ["uid"], connectivity=4)
    mid = images.select("uid", F.floor(F.col("h") / 2).alias("my"), F.floor(F.col("w") / 2).alias("mx"))
    center = lab.join(mid, "uid").where((F.col("y") == F.col("my")) & F.col("mx").between(F.col("x0"), F.col("x1"))).select("uid", F.col("comp").alias("_c"))
    kept = lab.join(merged(center), "uid", "left").where("_c is null or comp = _c")
    return kept.select("uid", F.col("y").cast("int").alias("y"), F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"))
