"""Rank tests, corrections, effect sizes and treated-versus-control contrasts (H).

Tests read the ranked histogram of a group, so tied observations cost one row and no group is ranked in a
single task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.functions import pvalues as PV
from gridtally.operators.joins import paired_wide
from gridtally.operators.ranks import agg_with_quantiles, exact_quantiles, group_min_compare, ranked_histogram, running
from gridtally.session import cut_lineage, join_keys

TIES = lambda: F.sum(F.pow(F.col("cnt").cast("double"), F.lit(3.0)) - F.col("cnt"))


def finite(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def signed_rank_statistics(df: DataFrame, keys: list[str], diff: Column) -> DataFrame:
    """Everything the signed-rank test needs per group: pairs, non-zero pairs, rank sums, ties, z."""
    x = df.select(*keys, diff.cast("double").alias("_d")).where(finite(F.col("_d")))
    x = cut_lineage(x.groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_w")))
    base = x.groupBy(*keys).agg(
        F.sum("_w").alias("n_pairs"), F.sum(F.when(F.col("_d") == 0, F.col("_w")).otherwise(0)).alias("n_zero"), F.max(F.abs("_d")).alias("_top")
    )
    nz = x.where("_d <> 0").withColumn("_a", F.abs("_d"))
    h = ranked_histogram(nz, keys, "_a", {"_pos": F.when(F.col("_d") > 0, F.col("_w")).otherwise(0)}, weight="_w")
    r = h.groupBy(*keys).agg(
        F.sum("cnt").alias("n_used"), F.sum(F.col("avg_rank") * F.col("_pos")).alias("r_plus"),
        F.sum(F.col("avg_rank") * (F.col("cnt") - F.col("_pos"))).alias("r_minus"), TIES().alias("ties"),
    )
    out = join_keys(base, r, keys, "left")
    n = F.col("n_used").cast("double")
    var = (n * (n + 1) * (2 * n + 1) - F.col("ties") / 2.0) / 24.0
    return out.withColumn("z", F.when(var > 0, (F.col("r_plus") - n * (n + 1) / 4.0) / F.sqrt(var)))


def wilcoxon_signed_rank(df: DataFrame, keys: list[str], x: Column, y: Column | None = None, alternative: str = "two-sided") -> DataFrame:
    """H1: statistic, p and pairs used; paired with ``y`` or one-sample without it.

    Fewer than two pairs give NULL; only zero differences give (0, 1.0, pairs).
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"unknown alternative {alternative!r}")
    s = signed_rank_statistics(df, keys, x if y is None else x - y)
    few, flat = F.col("n_pairs") < 2, F.col("_top") <= 1e-8
    stat = F.least("r_plus", "r_minus") if alternative == "two-sided" else F.col("r_plus")
    p = PV.signed_rank_p_col(F.col("r_plus"), F.col("n_used"), F.col("ties"), F.col("n_zero") > 0, alternative)
    return s.withColumn("_p", p).select(
        *keys, "n_pairs", F.when(few | flat, F.col("n_pairs")).otherwise(F.col("n_used")).alias("n_used"),
        F.when(~few, F.when(flat, 0.0).otherwise(stat)).alias("statistic"), F.when(~few & ~flat, F.col("z")).alias("z"),
        F.when(~few, F.when(flat, 1.0).otherwise(F.col("_p"))).alias("p_value"),
    )


def friedman_statistics(df: DataFrame, keys: list[str], block: str, treatment: str, value: str, k: int) -> DataFrame:
    """Tie-corrected chi-square over complete blocks; a block holds at most one row per treatment."""
    if k < 3:
        raise ValueError(f"at least 3 treatments are needed, got {k}")
    x = df.where(finite(F.col(value).cast("double"))).select(*keys, block, treatment, F.col(value).cast("double").alias("_v"))
    per = W.partitionBy(*keys, block)
    tie = W.partitionBy(*keys, block, "_v")
    x = x.withColumn("_k", F.count(F.lit(1)).over(per)).where(F.col("_k") == k)
    x = x.withColumn("_t", F.count(F.lit(1)).over(tie)).withColumn("_r", F.rank().over(per.orderBy("_v")) + (F.col("_t") - 1) / 2.0)
    t = F.col("_t").cast("double")
    sums = x.groupBy(*keys, treatment).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum(t * t - 1).alias("_ties"))
    got = sums.groupBy(*keys).agg(F.max("_n").alias("n_used"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum("_ties").alias("_ties"))
    n = F.col("n_used").cast("double")
    raw = F.lit(12.0) / (n * k * (k + 1)) * F.col("_ss") - 3.0 * n * (k + 1)
    corr = 1.0 - F.col("_ties") / (n * k * (k * k - 1))
    return got.select(*keys, "n_used", F.when(F.col("n_used") >= 2, F.try_divide(raw, corr)).alias("statistic"))


def friedman_test(df: DataFrame, keys: list[str], block: str, treatment: str, value: str, k: int) -> DataFrame:
    """H2: the statistic with its chi-square tail."""
    s = friedman_statistics(df, keys, block, treatment, value, k)
    return s.withColumn("p_value", PV.chi_square_sf_col(F.col("statistic"), F.lit(k - 1)))


def rank_sum_statistics(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """Sizes, U of sample a, ties, z and Cliff's delta of two samples per group (H3, H6)."""
    x = df.select(*keys, F.col(value).cast("double").alias("_v"), is_a.cast("int").alias("_a"))
    h = ranked_histogram(x, keys, "_v", {"_na": F.col("_a")})
    s = h.groupBy(*keys).agg(
        F.sum("_na").alias("n_a"), (F.sum("cnt") - F.sum("_na")).alias("n_b"), F.sum(F.col("avg_rank") * F.col("_na")).alias("_ra"), TIES().alias("ties")
    )
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    s = s.withColumn("u", F.col("_ra") - a * (a + 1) / 2.0).drop("_ra")
    n = a + b
    var = a * b / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    top = F.greatest(F.col("u"), a * b - F.col("u"))
    return s.withColumn("z", F.when(var > 0, (top - a * b / 2.0 - 0.5) / F.sqrt(var))).withColumn("cliffs_delta", F.try_divide(2.0 * F.col("u"), a * b) - 1.0)


def mann_whitney_u(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """H3: U with its two-sided p."""
    s = rank_sum_statistics(df, keys, value, is_a)
    return s.withColumn("p_value", PV.rank_sum_p_col(F.col("u"), F.col("n_a"), F.col("n_b"), F.col("ties")))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """H4: adjusted p-values and rejections; NULLs stay NULL and still count in the number of tests."""
    df = cut_lineage(df)
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    h = join_keys(ranked_histogram(df, keys, p), m, keys)
    h = h.withColumn("_raw", F.col("_m") / (F.col("cum_before") + F.col("cnt")).cast("double") * F.col(p))
    q = running(h, keys, [p], {"_q": ("min", "_raw")}, descending=True).select(*keys, p, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_q")).alias("q_value"))
    return join_keys(df, q, [*keys, p], "left").withColumn("rejected", F.coalesce(F.col("q_value") <= alpha, F.lit(False)))


def holm(df: DataFrame, keys: list[str], p: str, out: str = "q_holm") -> DataFrame:
    """H5: step-down adjustment within a group; a missing p counts as 1."""
    x = cut_lineage(df.withColumn("_p1", F.coalesce(F.col(p), F.lit(1.0))))
    h = ranked_histogram(x, keys, "_p1").withColumn("_raw", (F.col("n_total") - F.col("cum_before")) * F.col("_p1"))
    q = running(h, keys, ["_p1"], {"_q": ("max", "_raw")}).select(*keys, "_p1", F.least(F.lit(1.0), "_q").alias(out))
    return join_keys(x, q, [*keys, "_p1"], "left").drop("_p1")


def cliffs_delta(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """H6: dominance of sample a over sample b, from ranks."""
    return rank_sum_statistics(df, keys, value, is_a).select(*keys, "cliffs_delta")


def log2fc_medians(a: Column, b: Column, pseudo: float = 0.5) -> Column:
    """H7: log2 ratio of two medians with a pseudo-count."""
    return F.log2((a + pseudo) / (b + pseudo))


def _median_draws(n_boot: int, seed: int):
    """Order positions of resampled medians.

    The median of n draws with replacement is the value at an order statistic of n uniforms, whose
    position has a beta distribution. Drawing that position is the same law as resampling n values.
    """

    def draw(batches):
        for pdf in batches:
            out = []
            for key, arm, n, mark in pdf[["_key", "_arm", "n", "_mark"]].itertuples(index=False):
                n = int(n)
                rng = np.random.default_rng([seed, int(mark) & 0x7FFFFFFF, (int(mark) >> 31) & 0x7FFFFFFF])
                k = (n + 1) // 2
                lo = rng.beta(k, n - k + 1, n_boot)
                hi = lo if n % 2 else lo + (1 - lo) * rng.beta(1, n - k, n_boot)
                at = lambda u: np.minimum((u * n).astype(np.int64), n - 1)
                out.append(pd.DataFrame({"_key": key, "_arm": arm, "rep": np.arange(n_boot), "lo": at(lo), "hi": at(hi)}))
            if out:
                yield pd.concat(out)

    return draw


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, is_a: Column, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """H8: percentile interval of the log2 ratio of resampled medians, the same for the same seed.

    Each replicate costs two positions per arm whatever the sample size; the positions are looked up in the
    ranked histogram by a running maximum along the order.
    """
    x = df.select(F.to_json(F.struct(*keys)).alias("_key"), *keys, is_a.cast("int").alias("_arm"), F.col(value).cast("double").alias("_v"))
    x = cut_lineage(x)
    names = x.groupBy("_key").agg(*[F.first(k).alias(k) for k in keys])
    h = ranked_histogram(x.select("_key", "_arm", "_v"), ["_key", "_arm"], "_v")
    sizes = h.groupBy("_key", "_arm").agg(F.sum("cnt").alias("n")).withColumn("_mark", F.xxhash64("_key", "_arm"))
    draws = cut_lineage(sizes.mapInPandas(_median_draws(n_boot, seed), "_key string, _arm int, rep bigint, lo bigint, hi bigint"))
    ask = draws.select("_key", "_arm", "rep", F.explode(F.array("lo", "hi")).alias("pos"))
    null_rep = F.lit(None).cast("bigint")
    track = h.select("_key", "_arm", null_rep.alias("rep"), F.col("cum_before").alias("pos"), "_v", F.lit(0).alias("kind")).unionByName(
        ask.groupBy("_key", "_arm", "rep", "pos").agg(F.count(F.lit(1)).alias("_w")).select("_key", "_arm", "rep", "pos", F.lit(None).cast("double").alias("_v"), F.col("_w").cast("int").alias("kind"))
    )
    found = running(track, ["_key", "_arm"], ["pos", "kind", "rep"], {"x": ("max", "_v")}).where("rep is not null")
    med = found.groupBy("_key", "_arm", "rep").agg((F.sum(F.col("x") * F.col("kind")) / F.sum("kind")).alias("m"))
    fc = med.groupBy("_key", "rep").agg(F.max(F.when(F.col("_arm") == 1, F.col("m"))).alias("a"), F.max(F.when(F.col("_arm") == 0, F.col("m"))).alias("b"))
    fc = fc.where("a is not null and b is not null").withColumn("fc", log2fc_medians(F.col("a"), F.col("b")))
    q = exact_quantiles(fc, ["_key"], {"log2_fc_lo": (F.col("fc"), 0.025), "log2_fc_hi": (F.col("fc"), 0.975)})
    return q.join(names, "_key").select(*keys, "log2_fc_lo", "log2_fc_hi")


def contrast_rows(df: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Rows of ``df`` (cell_line, cond, model, ...) that take part in a contrast, with their arm.

    ``contrasts``: contrast, cell_line, treated[], control[], batch_matched; a short table, so the token
    bridge is a dimension join.
    """
    side = lambda c, arm: contrasts.select("contrast", "cell_line", "batch_matched", F.explode(c).alias("cond"), F.lit(arm).alias("arm"))
    bridge = side("treated", "treated").unionByName(side("control", "control"))
    return df.drop("arm").join(bridge, ["cell_line", "cond"])


CONTRAST_KEYS = ["contrast", "cell_line", "batch_matched", "model"]


def run_contrasts(df: DataFrame, contrasts: DataFrame, min_n: int = 8, n_boot: int | None = 2000, seed: int = 42) -> DataFrame:
    """H9: sizes, medians, fold change with interval, Cliff's delta and rank-sum test per contrast and method."""
    x = cut_lineage(contrast_rows(df.select("cell_line", "cond", "model", "pred_count"), contrasts))
    k = CONTRAST_KEYS
    v = F.col("pred_count")
    tre = F.col("arm") == "treated"
    med = exact_quantiles(x, k, {"median_treated": (F.when(tre, v), 0.5), "median_control": (F.when(~tre, v), 0.5)})
    t = rank_sum_statistics(x, k, "pred_count", tre)
    got = join_keys(t, med, k).where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    got = got.withColumn("p_mwu", PV.rank_sum_p_col(F.col("u"), F.col("n_a"), F.col("n_b"), F.col("ties")))
    out = got.select(
        *k, F.col("n_a").alias("n_treated"), F.col("n_b").alias("n_control"), "median_treated", "median_control",
        (F.col("median_treated") - F.col("median_control")).alias("median_diff"), log2fc_medians(F.col("median_treated"), F.col("median_control")).alias("log2_fc"),
        "cliffs_delta", "u", "z", "p_mwu", (F.col("p_mwu") < 0.05).alias("sig_005"),
    )
    return out if not n_boot else join_keys(out, bootstrap_ci(x, k, "pred_count", tre, n_boot, seed), k, "left")


def compare_to_truth(res: DataFrame, truth: str = "truth", keys: list[str] = ["contrast"]) -> DataFrame:
    """Fold-change error, direction and significance agreement with the truth series."""
    t = res.where(F.col("model") == truth).select(*keys, F.col("log2_fc").alias("gt_log2fc"), F.col("sig_005").alias("gt_sig"))
    x = join_keys(res, t, keys, "left")
    return (
        x.withColumn("log2fc_error", F.col("log2_fc") - F.col("gt_log2fc"))
        .withColumn("direction_agrees", F.signum("log2_fc") == F.signum("gt_log2fc"))
        .withColumn("sig_agrees", F.col("sig_005") == F.col("gt_sig"))
    )


def bias_shift(df: DataFrame, contrasts: DataFrame, min_n: int = 8) -> DataFrame:
    """Shift of the mean signed error between arms, with its test and Holm correction per contrast."""
    x = df.withColumn("_e", (F.col("pred_count") - F.col("gt_count")).cast("double")).select("cell_line", "cond", "model", "_e")
    x = cut_lineage(contrast_rows(x, contrasts))
    k, tre = CONTRAST_KEYS, F.col("arm") == "treated"
    m = lambda c, cond: F.avg(F.when(cond, c))
    means = x.groupBy(*k).agg(
        m(F.col("_e"), tre).alias("bias_treated"), m(F.col("_e"), ~tre).alias("bias_control"), m(F.abs("_e"), tre).alias("mae_treated"), m(F.abs("_e"), ~tre).alias("mae_control")
    )
    t = mann_whitney_u(x, k, "_e", tre).where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    out = join_keys(t, means, k).select(
        *k, F.col("n_a").alias("n_treated"), F.col("n_b").alias("n_control"), "bias_treated", "bias_control", (F.col("bias_treated") - F.col("bias_control")).alias("bias_shift"),
        "mae_treated", "mae_control", "u", "z", F.col("p_value").alias("p_bias_shift"),
    )
    out = holm(out, ["contrast"], "p_bias_shift", "q_bias_shift")
    return out.withColumn("shift_significant", F.col("q_bias_shift") < 0.05)


def error_significance(df: DataFrame, keys: list[str], label: str, reference: str, min_n: int = 8) -> DataFrame:
    """Is a method's bias different from zero, and its absolute error different from the reference's?

    ``keys`` identify a condition (``label`` is one of them); Holm correction runs within ``label``.
    """
    k = [*keys, "model"]
    x = df.withColumn("_e", (F.col("pred_count") - F.col("gt_count")).cast("double")).withColumn("_a", F.abs("_e"))
    x = cut_lineage(x.select(*k, "uid", "_e", "_a"))
    ref = x.where(F.col("model") == reference).select(*keys, "uid", F.col("_a").alias("_ref"))
    base = x.groupBy(*k).agg(F.count(F.lit(1)).alias("n_units"), F.avg("_a").alias("mean_abs_error"), F.avg("_e").alias("mean_signed_error")).where(F.col("n_units") >= min_n)
    bias = wilcoxon_signed_rank(x, k, F.col("_e")).select(*k, F.col("p_value").alias("p_bias_vs_zero"))
    pair = join_keys(x.where(F.col("model") != reference), ref, [*keys, "uid"])
    vs = wilcoxon_signed_rank(pair, k, F.col("_a"), F.col("_ref")).select(*k, F.col("p_value").alias("p_ae_vs_ref"))
    out = join_keys(join_keys(base, bias, k, "left"), vs, k, "left")
    out = holm(holm(out, [label], "p_bias_vs_zero", "q_bias_vs_zero"), [label], "p_ae_vs_ref", "q_ae_vs_ref")
    out = group_min_compare(out, [label], "mean_abs_error", "_above")
    return out.withColumn("bias_significant", F.col("q_bias_vs_zero") < 0.05).withColumn("worse_than_ref", (F.col("q_ae_vs_ref") < 0.05) & F.col("_above")).drop("_above")


def paired_summary(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Direction counts, medians, means and both signed-rank tests of paired values."""
    b, a = F.col(before), F.col(after)
    x = cut_lineage(df.where(b.isNotNull() & a.isNotNull()).select(*keys, before, after))
    base = agg_with_quantiles(
        x, keys,
        [
            F.count(F.lit(1)).alias("n_pairs"), F.count_if(a > b).alias("n_up"), F.count_if(a < b).alias("n_down"), F.count_if(a == b).alias("n_equal"),
            F.avg(b).alias("mean_before"), F.avg(a).alias("mean_after"), F.avg(a - b).alias("mean_delta"),
        ],
        {"median_before": (b, 0.5), "median_after": (a, 0.5), "median_delta": (a - b, 0.5)},
    )
    two = wilcoxon_signed_rank(x, keys, a, b).select(*keys, F.col("statistic").alias("w_two_sided"), F.col("p_value").alias("p_two_sided"))
    one = wilcoxon_signed_rank(x, keys, a, b, "greater").select(*keys, F.col("statistic").alias("w_greater"), F.col("p_value").alias("p_greater"))
    return join_keys(join_keys(base, two, keys), one, keys)
