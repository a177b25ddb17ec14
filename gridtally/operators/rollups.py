"""Aggregations over unit metrics, sweeps, conditions and file tables (F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions import metrics as M
from gridtally.functions.keys import cut, density_bin
from gridtally.operators.ranks import agg_with_quantiles, exact_quantiles, ranked_histogram
from gridtally.session import cut_lineage, join_keys, ratio

OBJ = ["obj_tp", "obj_fp", "obj_fn"]
OBJ_ALL = [*OBJ, "obj_ignored"]
PIX = ["pix_tp", "pix_fp", "pix_fn", "pix_tn"]
SPLIT_ORDER = ["train", "val", "test"]
DENSITY_LABELS = ["0-9", "10-49", "50-149", "150-299", "300+"]


def _sums(cols: list[str]) -> list[Column]:
    return [F.sum(c).cast("bigint").alias(c) for c in cols]


def _with(df: DataFrame, cols: dict[str, Column], prefix: str = "") -> DataFrame:
    return df.select("*", *[c.alias(f"{prefix}{n}") for n, c in cols.items()])


def pooled_metrics(df: DataFrame, keys: list[str], undefined: float | None = 0.0, pixels: bool = False) -> DataFrame:
    """sum the counts, then take the ratios."""
    cols = [*OBJ_ALL, *(PIX if pixels else [])]
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), *_sums(cols))
    got = _with(got, M.pooled(*[F.col(c) for c in OBJ], undefined), "obj_")
    if pixels:
        got = _with(got, M.pixel_metrics(*[F.col(c) for c in PIX[:3]]), "pix_")
    return got


def macro_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """mean of the per-unit values."""
    per = _with(df, M.object_metrics_from_counts(*[F.col(c) for c in OBJ]), "u_")
    return per.groupBy(*keys).agg(*[F.avg(f"u_{m}").alias(f"macro_{m}") for m in ("precision", "recall", "f1")])


def _errors(df: DataFrame, pred: str, gt: str) -> DataFrame:
    err = F.col(pred).cast("double") - F.col(gt).cast("double")
    return df.withColumn("_err", err).withColumn("_ae", F.abs(err))


def error_metrics(df: DataFrame, keys: list[str], pred: str = "pred_count", gt: str = "gt_count") -> DataFrame:
    """MAE, bias, RMSE, median absolute and median signed error."""
    e = _errors(df, pred, gt)
    aggs = [
        F.avg("_ae").alias("count_mae"),
        F.avg("_err").alias("count_bias"),
        F.sqrt(F.avg(F.col("_err") * F.col("_err"))).alias("count_rmse"),
    ]
    return agg_with_quantiles(
        e, keys, aggs, {"count_median_ae": (F.col("_ae"), 0.5), "count_median_bias": (F.col("_err"), 0.5)}
    )


def _joint(df: DataFrame, keys: list[str], pred: str, gt: str, weight: str | None = None) -> DataFrame:
    """Joint histogram of (pred, gt) per group: all that count metrics need, and the source is read once."""
    h = df.groupBy(*keys, F.col(pred).cast("double").alias("_p"), F.col(gt).cast("double").alias("_g"))
    h = h.agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_w"))
    return cut_lineage(h.withColumn("_err", F.col("_p") - F.col("_g")).withColumn("_ae", F.abs("_err")))


def _trimmed(h: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    kept = F.col("_ae").between(F.col("_lo"), F.col("_hi"))
    return join_keys(h, q, keys).groupBy(*keys).agg(
        ratio(F.sum(F.when(kept, F.col("_ae") * F.col("_w"))), F.sum(F.when(kept, F.col("_w")))).alias("count_trimmed_mae")
    )


def trimmed_mae(df: DataFrame, keys: list[str], pred: str = "pred_count", gt: str = "gt_count", trim: float = 0.05) -> DataFrame:
    """F8: mean of the absolute errors between their inclusive ``trim`` and ``1 - trim`` quantiles."""
    h = _joint(df, keys, pred, gt)
    q = exact_quantiles(h, keys, {"_lo": (F.col("_ae"), trim), "_hi": (F.col("_ae"), 1.0 - trim)}, weight="_w")
    return _trimmed(h, q, keys)


def ape(pred: Column, gt: Column, zero_gt: str = "ignore") -> Column:
    """Absolute percentage error; with ``zero_gt='score'`` an empty truth scores 0 or 1000."""
    p, g = pred.cast("double"), gt.cast("double")
    regular = 100.0 * F.abs(p - g) / g
    if zero_gt == "ignore":
        return F.when(g != 0, regular)
    return F.when(g != 0, regular).when(p == 0, 0.0).otherwise(1000.0)


def mdape(df: DataFrame, keys: list[str], pred: str = "pred_count", gt: str = "gt_count", zero_gt: str = "ignore") -> DataFrame:
    """median absolute percentage error."""
    x = df.withColumn("_ape", ape(F.col(pred), F.col(gt), zero_gt))
    return agg_with_quantiles(x, keys, [F.count("_ape").alias("n_used")], {"count_mdape": (F.col("_ape"), 0.5)})


def _correlations(h: DataFrame, keys: list[str]) -> DataFrame:
    x = h.where(F.col("_p").isNotNull() & F.col("_g").isNotNull())
    long = x.select(*keys, "_w", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("_p").alias("x")), F.struct(F.lit(1).alias("v"), F.col("_g").alias("x")))).alias("s"))
    ranks = ranked_histogram(long.select(*keys, "_w", "s.v", "s.x"), [*keys, "v"], "x", weight="_w")
    for v, c in enumerate(("_p", "_g")):
        r = ranks.where(F.col("v") == v).select(*keys, F.col("x").alias(c), F.col("avg_rank").alias(f"_r{c}"))
        x = join_keys(x, r, [*keys, c])
    w = F.col("_w").cast("double")

    def pearson(a: str, b: str) -> Column:
        n, ma, mb = F.col("_n"), F.col(f"_m{a}"), F.col(f"_m{b}")
        da, db = F.col(a) - ma, F.col(b) - mb
        va, vb = F.sum(w * da * da) / F.sum(w), F.sum(w * db * db) / F.sum(w)
        return F.when((F.sum(w) >= 2) & (va > 1e-16) & (vb > 1e-16), F.sum(w * da * db) / F.sum(w) / F.sqrt(va * vb))

    means = x.groupBy(*keys).agg(F.sum("_w").alias("_n"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"_m{c}") for c in ("_p", "_g", "_r_p", "_r_g")])
    return join_keys(x, means, keys).groupBy(*keys).agg(pearson("_p", "_g").alias("count_pearson_r"), pearson("_r_p", "_r_g").alias("count_spearman_rho"))


def correlations(df: DataFrame, keys: list[str], pred: str = "pred_count", gt: str = "gt_count") -> DataFrame:
    """guarded Pearson and Spearman (Pearson of average ranks), NULL where undefined."""
    h = _joint(df, keys, pred, gt)
    return join_keys(h.select(*keys).distinct(), _correlations(h, keys), keys, "left")


def count_metrics(df: DataFrame, keys: list[str], pred: str = "pred_count", gt: str = "gt_count", weight: str | None = None) -> DataFrame:
    """every count metric of a group, all from one joint histogram."""
    h = _joint(df, keys, pred, gt, weight).withColumn("_ape", ape(F.col("_p"), F.col("_g")))
    w = F.col("_w")
    mean = lambda c: ratio(F.sum(c * w), F.sum(F.when(c.isNotNull(), w)))
    base = h.groupBy(*keys).agg(
        mean(F.col("_ae")).alias("count_mae"), F.sqrt(mean(F.col("_err") * F.col("_err"))).alias("count_rmse"), mean(F.col("_err")).alias("count_bias")
    )
    q = exact_quantiles(h, keys, {"count_mdape": (F.col("_ape"), 0.5), "_lo": (F.col("_ae"), 0.05), "_hi": (F.col("_ae"), 0.95)}, weight="_w")
    out = join_keys(base, q.drop("_lo", "_hi"), keys, "left")
    out = join_keys(out, _trimmed(h, q, keys), keys, "left")
    return join_keys(out, _correlations(h, keys), keys, "left")


def unit_metrics(counts: DataFrame) -> DataFrame:
    """complete the fact row of (uid, model) from its object and pixel tallies."""
    got = counts
    got = _with(got, M.object_metrics_from_counts(*[F.col(c) for c in OBJ]), "obj_")
    got = _with(got, M.pixel_metrics(*[F.col(c) for c in PIX[:3]]), "pix_")
    return (
        got.withColumn("density_bin", density_bin(F.col("gt_count")))
        .withColumn("count_abs_error", F.abs(F.col("pred_count") - F.col("gt_count")).cast("double"))
        .withColumn("count_ape", ape(F.col("pred_count"), F.col("gt_count")))
    )


SUMMARY_SETS = {"overall": [], "by_split": ["split"], "by_group": ["grp"], "by_density_bin": ["density_bin"]}


def aggregate_benchmark(df: DataFrame) -> DataFrame:
    """the overall, by-split, by-group and by-bin summaries as one table keyed by ``scope``.

    The rows are repeated once per scope before a single aggregate, so sums, quantiles and ranks of all
    scopes share their shuffles.
    """
    facts = df if "density_bin" in df.columns else df.withColumn("density_bin", density_bin(F.col("gt_count")))
    scopes = F.array(
        *[
            F.struct(F.lit(s).alias("scope"), (F.col(c[0]) if c else F.lit("ALL")).alias("scope_value"))
            for s, c in SUMMARY_SETS.items()
        ]
    )
    long = (
        facts.select("model", *OBJ_ALL, *PIX, "pred_count", "gt_count", F.explode(scopes).alias("_s"))
        .select("*", "_s.*")
        .drop("_s")
        .where(F.col("scope_value").isNotNull())
    )
    long = cut_lineage(long.groupBy("model", "scope", "scope_value", "pred_count", "gt_count").agg(F.count(F.lit(1)).alias("_k"), *_sums([*OBJ_ALL, *PIX])))
    keys = ["model", "scope", "scope_value"]
    many = [F.sum(F.col(c) * F.col("_k")).cast("bigint").alias(c) for c in ("pred_count", "gt_count")]
    counts = long.groupBy(*keys).agg(F.sum("_k").alias("n_units"), *_sums([*OBJ_ALL, *PIX]), *many)
    counts = _with(counts, M.pooled(*[F.col(c) for c in OBJ]), "obj_")
    counts = _with(counts, M.pixel_metrics(*[F.col(c) for c in PIX[:3]]), "pix_")
    return join_keys(counts, count_metrics(long, keys, weight="_k"), keys)


def rank_models(overall: DataFrame) -> DataFrame:
    """F1 descending, MAE ascending, Dice descending."""
    return overall.orderBy(F.desc("obj_f1"), F.asc("count_mae"), F.desc("pix_dice"))


def describe_by_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """size, mean, quartiles, extremes and per-split counts per group, with a Total row."""
    both = df.withColumn(key, F.explode(F.array(F.col(key), F.lit("Total"))))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLIT_ORDER],
    ]
    v = F.col(value)
    return agg_with_quantiles(both, [key], aggs, {"median": (v, 0.5), "q25": (v, 0.25), "q75": (v, 0.75)})


def composition(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """crosstab with fixed columns and zero fill, counts and row percentages."""
    counts = [F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values]
    total = reduce(lambda a, b: a + b, [F.col(f"n_{v}") for v in values])
    got = df.groupBy(row).agg(*counts)
    return got.select("*", *[ratio(100.0 * F.col(f"n_{v}"), total).alias(f"pct_{v}") for v in values])


def bin_summary(df: DataFrame, count_col: str = "gt_count") -> DataFrame:
    """per count bin n, share, mean, median, min, max; empty bins stay."""
    v = F.col(count_col)
    binned = df.select(v, density_bin(v).alias("density_bin"))
    got = agg_with_quantiles(
        binned, ["density_bin"],
        [F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")],
        {"median": (v, 0.5)},
    )
    dim = df.sparkSession.createDataFrame([(b, i) for i, b in enumerate(DENSITY_LABELS)], "density_bin string, ord int")
    total = binned.agg(F.count(F.lit(1)).alias("_all")).scalar()
    return (
        dim.join(got, "density_bin", "left")
        .withColumn("_all", total)
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("pct", ratio(100.0 * F.col("n"), F.col("_all")))
        .drop("_all")
    )


def condition_errors(df: DataFrame, keys: list[str], min_n: int = 8) -> DataFrame:
    """F16: error summary per condition, for conditions with at least ``min_n`` units."""
    e = _errors(df, "pred_count", "gt_count").withColumn("_rec", ratio(F.col("pred_count"), F.col("gt_count")))
    aggs = [
        F.count(F.lit(1)).alias("n_units"),
        F.avg("gt_count").alias("gt_mean"),
        F.avg("pred_count").alias("pred_mean"),
        F.avg("_ae").alias("count_mae"),
        F.avg("_err").alias("count_bias"),
        ratio(100.0 * F.avg("_err"), F.avg("gt_count")).alias("relative_bias_pct"),
        ratio(100.0 * F.avg("_ae"), F.avg("gt_count")).alias("mae_pct_of_gt"),
    ]
    specs = {
        "gt_median": (F.col("gt_count"), 0.5), "pred_median": (F.col("pred_count"), 0.5),
        "count_median_ae": (F.col("_ae"), 0.5), "count_median_bias": (F.col("_err"), 0.5),
        "recovery_median": (F.col("_rec"), 0.5),
    }
    return agg_with_quantiles(e, keys, aggs, specs).where(F.col("n_units") >= min_n)


def weighted_pool(cells: DataFrame, keys: list[str], n: str = "n_units", gt: str = "gt_mean", bias: str = "count_bias", mae: str = "count_mae", gt_med: str = "gt_median", bias_med: str = "count_median_bias") -> DataFrame:
    """candidate rules that merge per-condition rows into one bias in percent."""
    rel = ratio(100.0 * F.col(bias), F.col(gt))
    w = F.col(n).cast("double")
    return cells.groupBy(*keys).agg(
        F.sum(n).alias("n_pooled"),
        ratio(F.sum(w * F.col(mae)), F.sum(w)).alias("mae_weighted"),
        ratio(100.0 * F.sum(w * F.col(bias)), F.sum(w * F.col(gt))).alias("pct_ratio_of_sums"),
        F.avg(rel).alias("pct_unweighted"),
        ratio(F.sum(w * rel), F.sum(F.when(rel.isNotNull(), w))).alias("pct_weighted_mean"),
        ratio(100.0 * F.sum(w * F.col(bias_med)), F.sum(w * F.col(gt_med))).alias("pct_weighted_medians"),
        F.max_by(rel, F.struct(F.col(n), rel)).alias("pct_largest_only"),
    )


def bias_range_summary(df: DataFrame, key: str, value: str, band: float) -> DataFrame:
    """range of a bias over conditions and how many stay within the band."""
    v = F.col(value)
    aggs = [
        F.count(v).alias("n_conditions"), F.min(v).alias("bias_min"), F.max(v).alias("bias_max"),
        F.max(F.abs(v)).alias("max_abs"), F.count_if(F.abs(v) <= band).alias("n_within"),
    ]
    return agg_with_quantiles(df, [key], aggs, {"bias_median": (v, 0.5)})


def recovery_by_bin(df: DataFrame, models: list[str], min_gt: int = 10) -> DataFrame:
    """median pred/gt by truth bin, one column per model, for units with enough truth."""
    x = df.where(F.col("gt_count") >= min_gt)
    x = x.withColumn("gt_bin", cut(F.col("gt_count"), [9, 49, 149, 299, None], ["10-49", "50-149", "150-299", "300+"]))
    x = x.withColumn("_rec", ratio(F.col("pred_count"), F.col("gt_count")))
    med = exact_quantiles(x, ["gt_bin", "model"], {"rec": (F.col("_rec"), 0.5)})
    return med.groupBy("gt_bin").agg(*[F.max(F.when(F.col("model") == m, F.col("rec"))).alias(f"rec_{m}") for m in models])


def recovery_ratio(by_bin: DataFrame, models: list[str], top: str, low: str) -> DataFrame:
    """recovery of the top bin over the low bin per model."""
    at = lambda b, m: F.max(F.when(F.col("gt_bin") == b, F.col(f"rec_{m}")))
    return by_bin.agg(*[ratio(at(top, m), at(low, m)).alias(f"ratio_{m}") for m in models])


def region_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """overlap quartiles, pooled and per-unit retention, empties, area and density shares of regions.

    Expects ``iou, dice, gt_count, kept, area_ratio, empty, px_in, px_out, n_missed``.
    """
    x = df.withColumn("_ret", ratio(F.col("kept"), F.col("gt_count")))
    aggs = [
        F.count(F.lit(1)).alias("n_units"),
        F.avg("iou").alias("iou_mean"), F.avg("dice").alias("dice_mean"),
        F.avg("_ret").alias("retention_mean"),
        ratio(F.sum("kept"), F.sum("gt_count")).alias("retention_pooled"),
        F.sum("gt_count").cast("bigint").alias("gt_total"), F.sum("kept").cast("bigint").alias("kept_total"),
        F.count_if("empty").alias("n_empty"),
        ratio(100.0 * F.count_if(F.col("area_ratio") > 1.2), F.count(F.lit(1))).alias("pct_area_gt_1_2"),
        ratio(1e6 * F.sum("kept"), F.sum("px_in")).alias("density_covered"),
        ratio(1e6 * F.sum("n_missed"), F.sum("px_out")).alias("density_missed"),
    ]
    q = {}
    for c in ("iou", "dice"):
        q.update({f"{c}_q25": (F.col(c), 0.25), f"{c}_median": (F.col(c), 0.5), f"{c}_q75": (F.col(c), 0.75)})
    q["retention_median"] = (F.col("_ret"), 0.5)
    return agg_with_quantiles(x, keys, aggs, q)


def loss_by_burden(df: DataFrame, edges: list, labels: list[str]) -> DataFrame:
    """objects lost per bin of truth size."""
    x = df.withColumn("burden", cut(F.col("gt_count"), edges, labels)).withColumn("_lost", F.col("gt_count") - F.col("kept"))
    x = x.withColumn("_ret", ratio(F.col("kept"), F.col("gt_count")))
    aggs = [
        F.count(F.lit(1)).alias("n_units"), F.avg("_lost").alias("mean_lost"),
        ratio(100.0 * F.sum("_lost"), F.sum("gt_count")).alias("pct_lost_pooled"),
    ]
    return agg_with_quantiles(x, ["burden"], aggs, {"median_retention": (F.col("_ret"), 0.5)})


def burden_correlation(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson and Spearman correlation of retention and truth size, and the spread of retention."""
    x = df.withColumn("_ret", ratio(F.col("kept"), F.col("gt_count")))
    cor = correlations(x.where(F.col("_ret").isNotNull()), keys, "_ret", "gt_count")
    spread = x.groupBy(*keys).agg(F.stddev_samp("_ret").alias("retention_sd"))
    return join_keys(cor, spread, keys)


def subset_bands(df: DataFrame, subsets: dict[str, Column], value: str) -> DataFrame:
    """n, median, p10, p1 and empty count of overlapping subsets."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    x = df.withColumn("subset", F.explode(tags))
    v = F.col(value)
    return agg_with_quantiles(
        x, ["subset"], [F.count(F.lit(1)).alias("n"), F.count_if(v == 0).alias("n_empty")],
        {"median": (v, 0.5), "p10": (v, 0.10), "p1": (v, 0.01)},
    )


def group_metrics_block(df: DataFrame, keys: list[str]) -> DataFrame:
    """pooled and macro metrics, count errors relative to the truth, missing predictions."""
    e = _errors(df, "pred_count", "gt_count")
    e = _with(e, M.object_metrics_from_counts(*[F.col(c) for c in OBJ]), "u_")
    got = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), *_sums(OBJ),
        F.avg("u_f1").alias("macro_f1"), F.avg("u_precision").alias("macro_precision"), F.avg("u_recall").alias("macro_recall"),
        F.avg("_ae").alias("count_mae"), F.avg("gt_count").alias("mean_gt"), F.avg("_err").alias("count_bias"),
        ratio(F.avg("_ae"), F.avg("gt_count")).alias("rel_mae"),
        F.sum("gt_count").cast("bigint").alias("gt_objects"), F.count_if(F.col("pred_count") == 0).alias("n_missing"),
    )
    return _with(got, M.pooled(*[F.col(c) for c in OBJ]), "pooled_")


def sweep_summary(rows: DataFrame) -> DataFrame:
    """pooled ratios per model, split, policy and grid point."""
    keys = [k for k in ("model", "split", "policy", "d_max", "min_iou") if k in rows.columns]
    got = rows.groupBy(*keys).agg(*_sums(["tp", "fp", "fn", "ignored"]))
    return _with(got, M.pooled(F.col("tp"), F.col("fp"), F.col("fn")))


def sensitivity_range(grid: DataFrame, canonical: dict[str, float]) -> DataFrame:
    """spread of F1 over the grid per model and the canonical cell; uneven grids raise an error."""
    is_canon = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in canonical.items()])
    f = F.col("f1")
    got = agg_with_quantiles(
        grid, ["model"],
        [F.count(F.lit(1)).alias("n_grid"), F.min(f).alias("f1_min"), F.max(f).alias("f1_max"), F.max(F.when(is_canon, f)).alias("f1_canonical")],
        {"f1_q25": (f, 0.25), "f1_median": (f, 0.5), "f1_q75": (f, 0.75)},
    )
    sizes = grid.groupBy("model").agg(F.count(F.lit(1)).alias("k")).agg(F.countDistinct("k").alias("kinds")).scalar()
    same = F.when(F.col("_kinds") == 1, F.col("n_grid")).otherwise(F.raise_error(F.lit("models cover different grids")).cast("bigint"))
    return (
        got.withColumn("_kinds", sizes).withColumn("n_grid", same).drop("_kinds")
        .withColumn("f1_range", F.col("f1_max") - F.col("f1_min"))
        .withColumn("canonical_minus_median", F.col("f1_canonical") - F.col("f1_median"))
    )


def sweep_heatmap(grid: DataFrame, keys: list[str], ious: list[float]) -> DataFrame:
    """mean F1 with one row per distance and one column per overlap threshold."""
    return grid.groupBy(*keys, "d_max").agg(
        *[F.avg(F.when(F.col("min_iou") == v, F.col("f1"))).alias("iou_" + str(v).replace(".", "_")) for v in ious]
    )


def rank_combos(rows: DataFrame, key: str) -> DataFrame:
    """pooled metrics, cap hits and the histogram of cap reasons per parameter combination."""
    per = _with(rows, M.object_metrics_from_counts(*[F.col(c) for c in OBJ]), "u_")
    got = per.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_units"), *_sums(OBJ), F.avg("u_f1").alias("mean_unit_f1"),
        F.count("cap_reason").alias("n_capped"), F.max("pred_count").alias("max_pred"),
    )
    got = _with(got, M.pooled(*[F.col(c) for c in OBJ])).withColumn("cap_rate", ratio(F.col("n_capped"), F.col("n_units")))
    reasons = (
        rows.where(F.col("cap_reason").isNotNull()).groupBy(key, "cap_reason").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(key)
        .agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cap_reason", "n"))))).alias("cap_reasons"))
    )
    got = join_keys(got, reasons, [key], "left").withColumn("cap_reasons", F.coalesce("cap_reasons", F.lit("{}")))
    return got.orderBy(F.desc("f1"), F.asc("n_capped"), F.asc("obj_fp"))


def cap_penalty(rows: DataFrame, max_objects: int | None = None, max_pairs: int | None = None) -> DataFrame:
    """units above a limit that the caller sets keep a zero-score row with the reason; without limits nothing changes."""
    pairs = F.col("pred_count").cast("bigint") * F.col("gt_count").cast("bigint")
    above = lambda n, limit: F.lit(False) if limit is None else n > limit
    reason = F.when(above(F.col("pred_count"), max_objects), "too_many_objects").when(above(pairs, max_pairs), "too_many_pairs")
    hit = F.col("cap_reason").isNotNull()
    return (
        rows.withColumn("cap_reason", reason)
        .withColumn("obj_tp", F.when(hit, F.lit(0).cast("bigint")).otherwise(F.col("obj_tp")))
        .withColumn("obj_fp", F.when(hit, F.col("pred_count")).otherwise(F.col("obj_fp")))
        .withColumn("obj_fn", F.when(hit, F.col("gt_count")).otherwise(F.col("obj_fn")))
        .withColumn("obj_ignored", F.when(hit, F.lit(0).cast("bigint")).otherwise(F.col("obj_ignored")))
    )


def select_best(rows: DataFrame, keys: list[str], order: str, metric: str = "val_f1", fallback: str = "test_f1") -> DataFrame:
    """the row with the best metric per key, the fallback metric where it is missing, first on ties."""
    score = F.coalesce(F.col(metric), F.col(fallback))
    x = rows.withColumn("score", score)
    best = x.where(F.col("score").isNotNull()).groupBy(*keys).agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col(order))).alias("_b")
    )
    picked = best.select(*keys, F.col(f"_b.{order}").alias(order))
    return join_keys(x, picked, [*keys, order])


def grid_score(values: DataFrame, params: list[str], default: dict) -> DataFrame:
    """mean prediction, mean truth and MAE per parameter set, the default marked, best first."""
    is_default = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in default.items()])
    e = _errors(values, "pred_count", "gt_count")
    return (
        e.groupBy(*params)
        .agg(F.avg("pred_count").alias("mean_pred"), F.avg("gt_count").alias("mean_gt"), F.avg("_ae").alias("mae"))
        .withColumn("is_default", is_default)
        .orderBy("mae", *params)
    )


def morphology_audit(components: DataFrame, units: DataFrame, min_area: int = 3) -> DataFrame:
    """F32: component counts and areas per unit against the counts of the table."""
    a = F.col("area")
    got = components.groupBy("uid").agg(
        F.count_if(a >= min_area).alias("n_components"), F.min(a).alias("area_min"), F.max(a).alias("area_max"), F.avg(a).alias("area_mean"),
    )
    return (
        join_keys(units, got, ["uid"], "left")
        .withColumn("n_components", F.coalesce("n_components", F.lit(0)))
        .withColumn("matches_table", F.col("n_components") == F.col("gt_count"))
        .withColumn("delta_points", F.col("point_count") - F.col("n_components"))
    )


def flag_summary(df: DataFrame, flags: list[str], delta: str | None = None) -> DataFrame:
    """how many rows carry each flag; absent columns are skipped."""
    have = [c for c in flags if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in have])
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("n_true"), F.col("_n").alias("n_total")) for c in have])).alias("s")
    ).select("s.*")


def delta_summary(df: DataFrame, delta: str) -> DataFrame:
    """median, mean and maximum of a difference column."""
    d = F.col(delta)
    x = df.withColumn("_g", F.lit(1))
    return agg_with_quantiles(x, ["_g"], [F.avg(d).alias("delta_mean"), F.max(d).alias("delta_max")], {"delta_median": (d, 0.5)}).drop("_g")


def master_summary(df: DataFrame, flags: list[str]) -> DataFrame:
    """one long table of totals, value counts, flags and duplicates."""
    top = df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("unique_id").alias("distinct_ids"),
        *[F.count_if(F.col(f)).alias(f) for f in flags],
    )
    names = ["rows", "distinct_ids", *flags]
    parts = [
        top.select(F.explode(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(n).alias("item"), F.col(n).alias("n")) for n in names])).alias("s")).select("s.*")
    ]
    for section, c in (("split", "split"), ("group", "cell_line")):
        parts.append(df.groupBy(F.col(c).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "item", "n"))
    dup = df.groupBy("unique_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    parts.append(dup.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit("duplicate_ids").alias("item"), "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def label_audit(df: DataFrame, raw: str, canonical: Column) -> DataFrame:
    """how often each raw label maps to each canonical one."""
    return df.groupBy(F.col(raw).alias("raw"), canonical.alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


def resource_composition(df: DataFrame, group: str, in_benchmark: Column) -> DataFrame:
    """totals, benchmark and extension units and split counts per group."""
    b = F.coalesce(in_benchmark, F.lit(False))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(b).alias("benchmark"), F.count_if(~b).alias("extension"),
        *[F.count_if(b & (F.col("split") == s)).alias(f"n_{s}") for s in SPLIT_ORDER],
    )


def condition_inventory(full: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """units per condition in the resource and in the benchmark."""
    v = F.col("gt_count")
    a = agg_with_quantiles(full, keys, [F.count(F.lit(1)).alias("n_full"), F.avg(v).alias("gt_mean")], {"gt_median": (v, 0.5)})
    b = benchmark.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_benchmark"))
    return (
        join_keys(a, b, keys, "left")
        .withColumn("n_benchmark", F.coalesce("n_benchmark", F.lit(0)))
        .withColumn("n_only_full", F.col("n_full") - F.col("n_benchmark"))
        .orderBy(F.desc("n_full"), *keys)
    )


def agreement_summary(df: DataFrame) -> DataFrame:
    """how often a method calls a contrast like the truth does."""
    err = F.abs(F.col("log2fc_error"))
    return agg_with_quantiles(
        df, ["subset", "model"],
        [
            F.countDistinct("contrast").alias("n_contrasts"), F.count_if("sig_agrees").alias("sig_correct"),
            F.count_if("direction_agrees").alias("direction_correct"),
        ],
        {"median_abs_log2fc_error": (err, 0.5)},
    )


def verdict_flips(df: DataFrame) -> DataFrame:
    """per contrast, how many methods reach another verdict than the truth."""
    return df.groupBy("subset", "contrast").agg(
        F.count_if(~F.col("sig_agrees")).alias("n_sig_flips"), F.count_if(~F.col("direction_agrees")).alias("n_direction_flips")
    )


def census(files: DataFrame, keys: list[str]) -> DataFrame:
    """files and bytes at every level of a rollup, with the largest file."""
    return files.rollup(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").cast("bigint").alias("bytes"),
        F.max_by("path", F.struct("size_bytes", "path")).alias("largest"),
    )


def dir_stats(files: DataFrame, top: int = 5) -> DataFrame:
    """files, sub-folders, bytes and most frequent extensions of every folder."""
    base = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").cast("bigint").alias("bytes"))
    parents = files.select("dir").distinct().select(F.regexp_extract("dir", r"^(.*)/[^/]+$", 1).alias("dir"), F.col("dir").alias("sub"))
    subs = parents.where("dir <> ''").groupBy("dir").agg(F.countDistinct("sub").alias("n_subdirs"))
    from gridtally.operators.ranks import first_n_per_group

    exts = files.groupBy("dir", "ext").agg(F.count(F.lit(1)).alias("n"))
    best = first_n_per_group(exts, ["dir"], [F.desc("n"), F.asc("ext")], top)
    lists = best.groupBy("dir").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "ext", "n"))).alias("l"))
    text = F.array_join(F.transform("l", lambda s: F.concat(s["ext"], F.lit(":"), s["n"].cast("string"))), ", ")
    got = join_keys(base, subs, ["dir"], "left").withColumn("n_subdirs", F.coalesce("n_subdirs", F.lit(0)))
    return join_keys(got, lists.select("dir", text.alias("top_exts")), ["dir"], "left")


def completeness_audit(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """filled and blank cells of every column in one scan."""
    cols = cols or df.columns
    filled = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(filled(c)).alias(c) for c in cols])
    long = one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_filled"), (F.col("_n") - F.col(c)).alias("n_blank")) for c in cols])).alias("s")
    ).select("s.*")
    state = F.when(F.col("n_filled") == 0, "empty").when(F.col("n_blank") == 0, "complete").otherwise("partial")
    return long.withColumn("state", state)


def arm_shift(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """treated minus control for groups present in both arms."""
    at = lambda a: F.avg(F.when(F.col("arm") == a, F.col(value)))
    return (
        df.groupBy(*keys).agg(at("treated").alias("treated"), at("control").alias("control"))
        .where(F.col("treated").isNotNull() & F.col("control").isNotNull())
        .withColumn("shift", F.col("treated") - F.col("control"))
    )


def count_disclosure(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """how two counts of the same unit differ."""
    d = F.col(a) - F.col(b)
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("n_equal"), F.count_if(d > 0).alias("n_larger"), F.count_if(d < 0).alias("n_smaller"),
        ratio(100.0 * F.count_if(d == 0), F.count(F.lit(1))).alias("pct_equal"),
        F.avg(F.abs(d)).alias("mean_abs_delta"), F.max(F.abs(d)).alias("max_abs_delta"), M.guarded_corr(F.col(a), F.col(b)).alias("pearson_r"),
    ]
    return agg_with_quantiles(df, keys, aggs, {"median_a": (F.col(a), 0.5), "median_b": (F.col(b), 0.5), "median_abs_delta": (F.abs(d), 0.5)})


def single_or_mixed(col: Column) -> Column:
    """The only value of a column in a group, or ``'mixed'``."""
    return F.when(F.min(col) == F.max(col), F.min(col)).otherwise(F.lit("mixed"))


def condition_matrix(df: DataFrame, column_by: str, value: str, columns: list[str], models: list[str]) -> DataFrame:
    """a truth row and one row per method, one column per condition with the mean value."""
    truth = df.where(F.col("model") == models[0]).select(F.lit("truth").alias("model"), column_by, F.col("gt_count").alias(value))
    both = df.select("model", column_by, value).unionByName(truth)
    clean = lambda c: "".join(ch if ch.isalnum() else "_" for ch in c)
    return both.groupBy("model").agg(*[F.avg(F.when(F.col(column_by) == c, F.col(value))).alias(clean(c)) for c in columns])


def median_with_iqr(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median with the distances to the quartiles, floored at 0."""
    v = F.col(value)
    q = exact_quantiles(df, keys, {"median": (v, 0.5), "_q25": (v, 0.25), "_q75": (v, 0.75)})
    return q.select(
        *keys, "median",
        F.greatest(F.col("median") - F.col("_q25"), F.lit(0.0)).alias("below"),
        F.greatest(F.col("_q75") - F.col("median"), F.lit(0.0)).alias("above"),
    )


def pooled_ratio(df: DataFrame, keys: list[str], num: str, den: str) -> DataFrame:
    """a ratio of sums, without spread."""
    return df.groupBy(*keys).agg(ratio(F.sum(num), F.sum(den)).alias("pooled"))


def roi_cost_summary(a: DataFrame, b: DataFrame, keys: list[str], p: bool = True) -> DataFrame:
    """two runs of the same units (uid, keys, f1, err) compared per subset, with a signed-rank test."""
    from gridtally.operators.joins import paired_runs
    from gridtally.operators.stats import wilcoxon_signed_rank

    x = paired_runs(a, b, ["uid", *keys])
    got = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("f1_a").alias("f1_a"), F.avg("f1_b").alias("f1_b"), F.avg(F.col("f1_b") - F.col("f1_a")).alias("d_f1"),
        F.avg(F.abs("err_a")).alias("mae_a"), F.avg(F.abs("err_b")).alias("mae_b"), F.avg("err_a").alias("bias_a"), F.avg("err_b").alias("bias_b"),
    )
    if not p:
        return got
    t = wilcoxon_signed_rank(x, keys, F.col("f1_b"), F.col("f1_a")).select(*keys, F.col("p_value").alias("p_f1"))
    return join_keys(got, t, keys, "left")
