"""The two end-to-end pipelines: scoring a benchmark and sweeping the matching parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.operators import components as C
from gridtally.operators import matching as X
from gridtally.operators import points as P
from gridtally.operators import rollups as R
from gridtally.operators import spatial as SP
from gridtally.session import cut_lineage


def objects_of(pixels: DataFrame, keys: list[str], min_area: int = 3) -> tuple[DataFrame, DataFrame]:
    """Objects of a pixel table and the runs of those objects (components below the limit dropped)."""
    lab = cut_lineage(C.label_runs(C.runs_from_pixels(pixels, keys), keys).withColumnRenamed("comp", "obj_id"))
    objs = C.object_attributes(lab, keys, comp="obj_id", min_area=min_area)
    return cut_lineage(objs), lab.join(objs.select(*keys, "obj_id"), [*keys, "obj_id"], "left_semi")


def geometry_of(gt_pixels: DataFrame, pred_pixels: DataFrame, frame: tuple[int, int] | None, cap: float, min_area: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prediction objects, truth objects and their pairs. ``gt_pixels``: uid, y, x; ``pred_pixels``: uid, model, y, x.

    Truth and predictions are labelled in one pass, as layers of their unit.
    """
    truth = gt_pixels.select("uid", F.lit(0).alias("side"), F.lit("").alias("model"), "y", "x")
    both = truth.unionByName(pred_pixels.select("uid", F.lit(1).alias("side"), "model", "y", "x"))
    objects, runs = objects_of(both, ["uid", "side", "model"], min_area)
    gt, gt_runs = (df.where("side = 0").drop("side", "model") for df in (objects, runs))
    pred, pred_runs = (df.where("side = 1").drop("side") for df in (objects, runs))
    return pred, gt, SP.pairwise_geometry(pred, gt, cap, gt_runs, pred_runs, frame)


def score_units(
    units: DataFrame, gt_pixels: DataFrame, pred_pixels: DataFrame, models: list[str], policies: list[str] = ["OR", "AND"], d_max: float = X.D_MAX, min_iou: float = X.IOU_MIN, alpha: float = X.ALPHA, min_area: int = 3,
) -> DataFrame:
    """F1 end to end: the fact table with one row per unit, model and policy.

    ``units``: uid, split, grp, h, w. Geometry is computed once and shared by the policies. A unit without
    predicted pixels counts as an empty prediction.
    """
    for p in policies:
        X.check_parameters(d_max, min_iou, alpha, p)
    pred, gt, pairs = geometry_of(gt_pixels, pred_pixels, None, d_max, min_area)
    pairs = cut_lineage(pairs)
    rows = X.sweep_matching(pairs, pred, gt, models, [d_max], [min_iou], policies, d_max, alpha)
    has = pred_pixels.select("uid", "model").distinct().withColumn("pred_exists", F.lit(1))
    both = gt_pixels.select("uid", "y", "x", F.lit(None).cast("string").alias("model")).unionByName(pred_pixels.select("uid", "y", "x", "model"))
    conf = _pixel_counts(both, units, models)
    facts = X.per_model(units, models).withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    zero = ["obj_tp", "obj_fp", "obj_fn", "obj_ignored", "pred_count", "gt_count", "cand_pairs", "cand_preds", "cand_gts", "pred_exists"]
    m = rows.select(
        "uid", "model", "policy", F.col("tp").alias("obj_tp"), F.col("fp").alias("obj_fp"), F.col("fn").alias("obj_fn"), F.col("ignored").alias("obj_ignored"), F.col("n_pred").alias("pred_count"), F.col("n_gt").alias("gt_count"),
        "cand_pairs", "cand_preds", "cand_gts",
    )
    k = ["uid", "model", "policy"]
    facts = facts.join(m, k, "left").join(conf, ["uid", "model"], "left").join(has, ["uid", "model"], "left").fillna(0, zero)
    return R.unit_metrics(facts)


def _pixel_counts(pixels: DataFrame, units: DataFrame, models: list[str]) -> DataFrame:
    """Pixel confusion of every unit and model from one aggregation over words of 64 positions, so no pixel is shuffled.

    Positions without a column are kept apart: each image row has one of them.
    """
    has = {f"p{i}": F.coalesce(F.col("model") == m, F.lit(False)) for i, m in enumerate(models)}
    placed = pixels.withColumn("_lone", F.col("x").isNull()).withColumn("x", F.coalesce("x", F.lit(0)))
    per = C.pixel_words(placed, ["uid", "_lone"], g=F.col("model").isNull(), **has)
    count = lambda word: F.sum(F.bit_count(word)).cast("bigint")
    aggs = []
    for i, _ in enumerate(models):
        p, g = F.col(f"p{i}"), F.col("g")
        aggs += [count(g.bitwiseAND(p)).alias(f"tp{i}"), count(p.bitwiseAND(F.bitwise_not(g))).alias(f"fp{i}"), count(g.bitwiseAND(F.bitwise_not(p))).alias(f"fn{i}")]
    n = units.select("uid", "h", "w").join(per.groupBy("uid").agg(*aggs), "uid", "left").fillna(0)
    long = n.select("uid", "h", "w", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"tp{i}").alias("pix_tp"), F.col(f"fp{i}").alias("pix_fp"), F.col(f"fn{i}").alias("pix_fn")) for i, m in enumerate(models)
    ])).alias("s")).select("uid", "h", "w", "s.*")
    return long.withColumn("pix_tn", F.col("h").cast("bigint") * F.col("w") - F.col("pix_tp") - F.col("pix_fp") - F.col("pix_fn")).drop("h", "w")


def sweep(gt_pixels: DataFrame, pred_pixels: DataFrame, models: list[str], d_max: list[float], min_iou: list[float], policies: list[str] = ["OR", "AND"], alpha: float = X.ALPHA, min_area: int = 3, units: DataFrame | None = None) -> DataFrame:
    """One row per unit, model and grid point, with the distance cap at the largest ``d_max``.

    ``units``: uid and columns to pass through, such as the split; units without any object then have rows too.
    """
    cap = max(d_max)
    pred, gt, pairs = geometry_of(gt_pixels, pred_pixels, None, cap, min_area)
    return X.sweep_matching(cut_lineage(pairs), pred, gt, models, d_max, min_iou, policies, cap, alpha, units)


# ---- K7 -----------------------------------------------------------------------------------------

# How the raw output of each kind of method becomes foreground (channel, threshold).
HARMONISE_RULES = {"multi_class": (3, 0.0), "binary": (None, 0.0), "soft": (None, 0.5)}


def harmonise(raw: DataFrame, units: DataFrame, kinds: dict[str, str], min_area: int = 3) -> tuple[DataFrame, DataFrame]:
    """K7: canonical foreground pixels (uid, model, y, x) and a status per unit and method.

    ``raw``: uid, model, y, x, value, values (channel array where a method writes several classes).
    """
    value = F.col("value").cast("double")
    keep = F.lit(False)
    for model, kind in kinds.items():
        channel, t = HARMONISE_RULES[kind]
        v = value if channel is None else F.try_element_at("values", F.lit(channel + 1)).cast("double")
        keep = keep | ((F.col("model") == model) & (F.coalesce(v, F.lit(0.0)) > t))
    fg = raw.where(keep).select("uid", "model", "y", "x").distinct()
    objs, runs = objects_of(fg, ["uid", "model"], min_area)
    px = runs.select("uid", "model", F.col("y").cast("int").alias("y"), F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"))
    seen = raw.select("uid", "model").distinct().withColumn("status", F.lit("ok"))
    status = X.per_model(units.select("uid"), list(kinds)).join(seen, ["uid", "model"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return px, status
