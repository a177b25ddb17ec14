"""Queries for aggregations and windows (F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtally.functions import keys as K
from gridtally.functions import metrics as M
from gridtally.operators import ranks as G
from gridtally.operators import rollups as R
from gridtally.operators import select as S
from gridtally.plans.registry import query
from gridtally.session import ratio
from gridtally.sources.views import MODELS, obj_view, page_files, supp_view, table, unit_view, with_views

U = with_views("unit_view")
SU = with_views("supp_view")

BIN = """case when gt_count >= 300 then '300+' when gt_count >= 150 then '150-299' when gt_count >= 50 then '50-149'
 when gt_count >= 10 then '10-49' else '0-9' end"""


def med(x, p=0.5):
    return f"quantile_cont(cast({x} as double), {p})"


def ok(num, den, undefined="0.0"):
    return f"coalesce(cast({num} as double) / nullif(cast({den} as double), 0), {undefined})"


def pooled_sql(prefix="obj_", undefined="0.0", tp="obj_tp", fp="obj_fp", fn="obj_fn"):
    return (
        f"{ok(tp, f'({tp} + {fp})', undefined)} as {prefix}precision, {ok(tp, f'({tp} + {fn})', undefined)} as {prefix}recall, "
        f"{ok(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})', undefined)} as {prefix}f1"
    )


PIX_SQL = f"""{ok('pix_tp', '(pix_tp + pix_fp)')} as pix_precision, {ok('pix_tp', '(pix_tp + pix_fn)')} as pix_recall,
 coalesce(2 * ({ok('pix_tp', '(pix_tp + pix_fp)')}) * ({ok('pix_tp', '(pix_tp + pix_fn)')}) /
  nullif(({ok('pix_tp', '(pix_tp + pix_fp)')}) + ({ok('pix_tp', '(pix_tp + pix_fn)')}), 0), 0) as pix_f1,
 {ok('pix_tp', '(pix_tp + pix_fp + pix_fn)')} as pix_iou, {ok('2 * pix_tp', '(2 * pix_tp + pix_fp + pix_fn)')} as pix_dice"""


def sums_sql(*cols):
    return ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in cols)


OBJ_COLS = ("obj_tp", "obj_fp", "obj_fn", "obj_ignored")
PIX_COLS = ("pix_tp", "pix_fp", "pix_fn", "pix_tn")
UNIT_OBJ = "cast(obj_tp as double) / (obj_tp + obj_fp + 1e-9) as u_precision, cast(obj_tp as double) / (obj_tp + obj_fn + 1e-9) as u_recall, " + ok("2 * obj_tp", "(2 * obj_tp + obj_fp + obj_fn)") + " as u_f1"
E = "cast(pred_count - gt_count as double)"
R6 = 9


def corr_sql(x, y):
    """Guarded Pearson correlation of two expressions."""
    return f"""case when count(*) >= 2 and stddev_pop(cast({x} as double)) > 1e-8 and stddev_pop(cast({y} as double)) > 1e-8
 then covar_pop(cast({x} as double), cast({y} as double)) / (stddev_pop(cast({x} as double)) * stddev_pop(cast({y} as double))) end"""


def count_ctes(src, keys):
    """CTEs ``cm`` (count metrics per keys) over table ``src`` with the given key columns."""
    k = ", ".join(keys)
    on = " and ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""
 q as (select {k}, quantile_cont(abs({E}), 0.05) as lo, quantile_cont(abs({E}), 0.95) as hi from {src} group by {k}),
 rk as (select {k}, pred_count, gt_count,
   rank() over (partition by {k} order by pred_count) + (count(*) over (partition by {k}, pred_count) - 1) / 2.0 as rp,
   rank() over (partition by {k} order by gt_count) + (count(*) over (partition by {k}, gt_count) - 1) / 2.0 as rg from {src}),
 sp as (select {k}, {corr_sql('rp', 'rg')} as count_spearman_rho from rk group by {k}),
 tm as (select {", ".join("a." + c for c in keys)}, avg(abs(cast(a.pred_count - a.gt_count as double)))
   filter (where abs(cast(a.pred_count - a.gt_count as double)) between b.lo and b.hi) as count_trimmed_mae
   from {src} a join q b on {on} group by {", ".join("a." + c for c in keys)}),
 cm0 as (select {k}, avg(abs({E})) as count_mae, sqrt(avg({E} * {E})) as count_rmse, avg({E}) as count_bias,
   quantile_cont(case when gt_count <> 0 then 100.0 * abs({E}) / gt_count end, 0.5) as count_mdape, {corr_sql('gt_count', 'pred_count')} as count_pearson_r
   from {src} group by {k}),
 cm as (select * from cm0 join tm using ({k}) join sp using ({k}))"""


# ---- F ----------------------------------------------------------------------------------------


@query("f1_unit_metrics", U + f""" select *, cast(obj_tp as double) / (obj_tp + obj_fp + 1e-9) as obj_precision,
 cast(obj_tp as double) / (obj_tp + obj_fn + 1e-9) as obj_recall, {ok('2 * obj_tp', '(2 * obj_tp + obj_fp + obj_fn)')} as obj_f1,
 {PIX_SQL}, {BIN} as density_bin, abs({E}) as count_abs_error,
 case when gt_count <> 0 then 100.0 * abs({E}) / gt_count end as count_ape from unit_view""")
def _(spark, sf):
    return R.unit_metrics(unit_view(spark, sf))


@query("f2_object_metrics_from_counts", U + f" select uid, model, {UNIT_OBJ} from unit_view")
def _(spark, sf):
    m = M.object_metrics_from_counts(F.col("obj_tp"), F.col("obj_fp"), F.col("obj_fn"))
    return unit_view(spark, sf).select("uid", "model", *[c.alias(f"u_{n}") for n, c in m.items()])


@query("f3_pixel_metrics", U + f""", e as (select *, pix_tp / (pix_tp + pix_fp + 1e-9) as p, pix_tp / (pix_tp + pix_fn + 1e-9) as r from unit_view)
 select uid, model, {PIX_SQL}, p as eps_precision, r as eps_recall, 2 * p * r / (p + r + 1e-9) as eps_f1,
 pix_tp / (pix_tp + pix_fp + pix_fn + 1e-9) as eps_iou, 2.0 * pix_tp / (2.0 * pix_tp + pix_fp + pix_fn + 1e-9) as eps_dice from e""")
def _(spark, sf):
    args = [F.col(c) for c in PIX_COLS[:3]]
    exact, eps = M.pixel_metrics(*args), M.pixel_metrics(*args, convention="eps")
    return unit_view(spark, sf).select(
        "uid", "model", *[c.alias(f"pix_{n}") for n, c in exact.items()], *[c.alias(f"eps_{n}") for n, c in eps.items()]
    )


@query("f4_pooled_metrics", U + f", s as (select model, split, count(*) as n_units, {sums_sql(*OBJ_COLS, *PIX_COLS)} from unit_view group by model, split) select *, {pooled_sql()}, {PIX_SQL} from s")
def _(spark, sf):
    return R.pooled_metrics(unit_view(spark, sf), ["model", "split"], pixels=True)


@query("f5_macro_metrics", U + f", s as (select model, split, {UNIT_OBJ} from unit_view) select model, split, avg(u_precision) as macro_precision, avg(u_recall) as macro_recall, avg(u_f1) as macro_f1 from s group by 1, 2")
def _(spark, sf):
    return R.macro_metrics(unit_view(spark, sf), ["model", "split"])


@query("f6_count_metrics", U + "," + count_ctes("unit_view", ["model", "split"]) + " select * from cm")
def _(spark, sf):
    return R.count_metrics(unit_view(spark, sf), ["model", "split"])


@query("f7_error_metrics", U + f" select model, grp, avg(abs({E})) as count_mae, avg({E}) as count_bias, sqrt(avg({E} * {E})) as count_rmse, {med(f'abs({E})')} as count_median_ae, {med(E)} as count_median_bias from unit_view group by model, grp")
def _(spark, sf):
    return R.error_metrics(unit_view(spark, sf), ["model", "grp"])


@query("f8_trimmed_mae", SU + "," + count_ctes("supp_view", ["model"]) + " select model, count_trimmed_mae from tm")
def _(spark, sf):
    return R.trimmed_mae(supp_view(spark, sf), ["model"])


@query("f9_mdape", U + f""" select model, count(*) as n_used, quantile_cont(case when gt_count <> 0 then 100.0 * abs({E}) / gt_count when pred_count = 0 then 0.0 else 1000.0 end, 0.5) as count_mdape
 from unit_view group by model""")
def _(spark, sf):
    return R.mdape(unit_view(spark, sf), ["model"], zero_gt="score")


@query("f10_correlations", SU + "," + count_ctes("supp_view", ["model", "split"]) + " select model, split, count_pearson_r, count_spearman_rho from cm")
def _(spark, sf):
    return R.correlations(supp_view(spark, sf), ["model", "split"])


AGG = U + f""", facts as (select *, {BIN} as density_bin from unit_view),
 lng as (select model, 'overall' as scope, 'ALL' as scope_value, * exclude (model) from facts
  union all select model, 'by_split', split, * exclude (model) from facts union all select model, 'by_group', grp, * exclude (model) from facts
  union all select model, 'by_density_bin', density_bin, * exclude (model) from facts),
 s as (select model, scope, scope_value, count(*) as n_units, {sums_sql(*OBJ_COLS, 'pred_count', 'gt_count', *PIX_COLS)} from lng group by 1, 2, 3),
 {count_ctes('lng', ['model', 'scope', 'scope_value'])}, agg as (select s.*, {pooled_sql()}, {PIX_SQL}, cm.* exclude (model, scope, scope_value) from s join cm using (model, scope, scope_value))"""


@query("f11_aggregate_benchmark", AGG + " select * from agg")
def _(spark, sf):
    return R.aggregate_benchmark(unit_view(spark, sf))


@query("f12_rank_models", AGG + " select model, n_units, obj_f1, count_mae, pix_dice, row_number() over (order by obj_f1 desc, count_mae, pix_dice desc) as pos from agg where scope = 'overall'")
def _(spark, sf):
    u = unit_view(spark, sf)
    overall = R.pooled_metrics(u, ["model"], pixels=True).join(R.error_metrics(u, ["model"]).select("model", "count_mae"), "model")
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.orderBy(F.desc("obj_f1"), F.asc("count_mae"), F.desc("pix_dice")))
    return R.rank_models(overall).select("model", "n_units", "obj_f1", "count_mae", "pix_dice").withColumn("pos", pos)


@query("f13_describe_by_group", U + f""", b as (select grp, split, gt_count from unit_view union all select 'Total', split, gt_count from unit_view)
 select grp, count(*) as n, avg(gt_count) as mean, min(gt_count) as min, max(gt_count) as max, count(*) filter (where split = 'train') as n_train,
 count(*) filter (where split = 'val') as n_val, count(*) filter (where split = 'test') as n_test, {med('gt_count')} as median, {med('gt_count', .25)} as q25, {med('gt_count', .75)} as q75 from b group by grp""")
def _(spark, sf):
    return R.describe_by_group(unit_view(spark, sf), "grp", "gt_count")


@query("f14_composition", U + ", c as (select grp, " + ", ".join(f"count(*) filter (where split = '{s}') as n_{s}" for s in R.SPLIT_ORDER) + " from unit_view group by grp) select *, " + ", ".join(f"100.0 * n_{s} / (n_train + n_val + n_test) as pct_{s}" for s in R.SPLIT_ORDER) + " from c")
def _(spark, sf):
    return R.composition(unit_view(spark, sf), "grp", "split", R.SPLIT_ORDER)


@query("f15_bin_summary", SU + f""", b as (select {BIN} as density_bin, gt_count from supp_view),
 s as (select density_bin, count(*) as n, avg(gt_count) as mean, min(gt_count) as min, max(gt_count) as max, {med('gt_count')} as median from b group by 1)
 select d.density_bin, d.ord, coalesce(n, 0) as n, mean, min, max, median, 100.0 * coalesce(n, 0) / (select count(*) from b) as pct
 from (values ('0-9', 0), ('10-49', 1), ('50-149', 2), ('150-299', 3), ('300+', 4)) as d(density_bin, ord) left join s using (density_bin)""")
def _(spark, sf):
    return R.bin_summary(supp_view(spark, sf))


COND = f""" select cond, arm, model, count(*) as n_units, avg(gt_count) as gt_mean, avg(pred_count) as pred_mean, avg(abs({E})) as count_mae, avg({E}) as count_bias,
 100.0 * avg({E}) / nullif(avg(gt_count), 0) as relative_bias_pct, 100.0 * avg(abs({E})) / nullif(avg(gt_count), 0) as mae_pct_of_gt,
 {med('gt_count')} as gt_median, {med('pred_count')} as pred_median, {med(f'abs({E})')} as count_median_ae, {med(E)} as count_median_bias,
 quantile_cont(cast(pred_count as double) / nullif(gt_count, 0), 0.5) as recovery_median from unit_view group by cond, arm, model having count(*) >= 8"""


@query("f16_condition_errors", U + COND)
def _(spark, sf):
    return R.condition_errors(unit_view(spark, sf), ["cond", "arm", "model"])


@query("f17_weighted_pool", U + f""", c as ({COND}), r as (select *, 100.0 * count_bias / nullif(gt_mean, 0) as rel from c)
 select arm, model, cast(sum(n_units) as bigint) as n_pooled, sum(n_units * count_mae) / sum(n_units) as mae_weighted, 100.0 * sum(n_units * count_bias) / sum(n_units * gt_mean) as pct_ratio_of_sums,
 avg(rel) as pct_unweighted, sum(n_units * rel) / sum(n_units) as pct_weighted_mean, 100.0 * sum(n_units * count_median_bias) / nullif(sum(n_units * gt_median), 0) as pct_weighted_medians,
 arg_max(rel, struct_pack(n := n_units, r := rel)) as pct_largest_only from r group by arm, model""")
def _(spark, sf):
    return R.weighted_pool(R.condition_errors(unit_view(spark, sf), ["cond", "arm", "model"]), ["arm", "model"])


@query("f18_bias_range_summary", U + f", c as ({COND}) select model, count(relative_bias_pct) as n_conditions, min(relative_bias_pct) as bias_min, max(relative_bias_pct) as bias_max, max(abs(relative_bias_pct)) as max_abs, count(*) filter (where abs(relative_bias_pct) <= 60.0) as n_within, {med('relative_bias_pct')} as bias_median from c group by model")
def _(spark, sf):
    return R.bias_range_summary(R.condition_errors(unit_view(spark, sf), ["cond", "arm", "model"]), "model", "relative_bias_pct", 60.0)


@query("f19_recovery_by_bin", SU + """, x as (select model, case when gt_count > 9 and gt_count <= 49 then '10-49' when gt_count > 49 and gt_count <= 149 then '50-149'
 when gt_count > 149 and gt_count <= 299 then '150-299' when gt_count > 299 then '300+' end as gt_bin, cast(pred_count as double) / gt_count as rec from supp_view where gt_count >= 10)
 select gt_bin, """ + ", ".join(f"quantile_cont(rec, 0.5) filter (where model = '{m}') as rec_{m}" for m in MODELS) + " from x group by gt_bin")
def _(spark, sf):
    return R.recovery_by_bin(supp_view(spark, sf), MODELS)


REGION = SU + """, r as (select grp, split, model, gt_count, obj_tp as kept, cast(pix_tp as double) / nullif(pix_tp + pix_fp + pix_fn, 0) as iou,
 2.0 * pix_tp / nullif(2 * pix_tp + pix_fp + pix_fn, 0) as dice, cast(pix_tp + pix_fp as double) / nullif(pix_tp + pix_fn, 0) as area_ratio,
 pix_tp + pix_fp = 0 as empty, pix_tp + pix_fp as px_in, pix_fn + pix_tn as px_out, obj_fn as n_missed from supp_view)"""


def region_rows(spark, sf):
    t, p, n = F.col("pix_tp"), F.col("pix_fp"), F.col("pix_fn")
    return supp_view(spark, sf).select(
        "grp", "split", "model", "gt_count", F.col("obj_tp").alias("kept"), ratio(t, t + p + n).alias("iou"), ratio(2 * t, 2 * t + p + n).alias("dice"),
        ratio(t + p, t + n).alias("area_ratio"), (t + p == 0).alias("empty"), (t + p).alias("px_in"), (n + F.col("pix_tn")).alias("px_out"),
        F.col("obj_fn").alias("n_missed"),
    )


@query("f20_region_summary", REGION + f""" select model, count(*) as n_units, avg(iou) as iou_mean, avg(dice) as dice_mean, avg(cast(kept as double) / nullif(gt_count, 0)) as retention_mean,
 cast(sum(kept) as double) / nullif(sum(gt_count), 0) as retention_pooled, cast(sum(gt_count) as bigint) as gt_total, cast(sum(kept) as bigint) as kept_total, count(*) filter (where empty) as n_empty,
 100.0 * count(*) filter (where area_ratio > 1.2) / count(*) as pct_area_gt_1_2, 1e6 * sum(kept) / nullif(sum(px_in), 0) as density_covered, 1e6 * sum(n_missed) / nullif(sum(px_out), 0) as density_missed,
 {med('iou', .25)} as iou_q25, {med('iou')} as iou_median, {med('iou', .75)} as iou_q75, {med('dice', .25)} as dice_q25, {med('dice')} as dice_median, {med('dice', .75)} as dice_q75,
 quantile_cont(cast(kept as double) / nullif(gt_count, 0), 0.5) as retention_median from r group by model""")
def _(spark, sf):
    return R.region_summary(region_rows(spark, sf), ["model"])


@query("f21_loss_by_burden", REGION + f""", b as (select *, case when gt_count > 0 and gt_count <= 250 then 'low' when gt_count > 250 and gt_count <= 300 then 'mid' when gt_count > 300 then 'high' end as burden from r)
 select burden, count(*) as n_units, avg(gt_count - kept) as mean_lost, 100.0 * sum(gt_count - kept) / nullif(sum(gt_count), 0) as pct_lost_pooled,
 quantile_cont(cast(kept as double) / nullif(gt_count, 0), 0.5) as median_retention from b group by burden""")
def _(spark, sf):
    return R.loss_by_burden(region_rows(spark, sf), [0, 250, 300, None], ["low", "mid", "high"])


@query("f21_burden_correlation", REGION + f""", x as (select model, cast(kept as double) / nullif(gt_count, 0) as ret, gt_count from r),
 y as (select *, rank() over (partition by model order by ret) + (count(*) over (partition by model, ret) - 1) / 2.0 as rr, rank() over (partition by model order by gt_count) + (count(*) over (partition by model, gt_count) - 1) / 2.0 as rg from x where ret is not null)
 select model, {corr_sql('gt_count', 'ret')} as count_pearson_r, {corr_sql('rg', 'rr')} as count_spearman_rho, stddev_samp(ret) as retention_sd from y group by model""")
def _(spark, sf):
    return R.burden_correlation(region_rows(spark, sf), ["model"])


@query("f22_subset_bands", REGION + f""", t as (select 'all' as subset, iou from r union all select 'held_out', iou from r where split in ('val', 'test') union all select 'dense', iou from r where gt_count >= 280)
 select subset, count(*) as n, count(*) filter (where iou = 0) as n_empty, {med('iou')} as median, {med('iou', 0.1)} as p10, {med('iou', 0.01)} as p1 from t group by subset""")
def _(spark, sf):
    subsets = {"all": F.lit(True), "held_out": F.col("split").isin("val", "test"), "dense": F.col("gt_count") >= 280}
    return R.subset_bands(region_rows(spark, sf), subsets, "iou")


@query("f24_group_metrics_block", U + f""", e as (select *, {UNIT_OBJ} from unit_view),
 s as (select grp, model, count(*) as n_units, {sums_sql(*OBJ_COLS[:3])}, avg(u_f1) as macro_f1, avg(u_precision) as macro_precision, avg(u_recall) as macro_recall, avg(abs({E})) as count_mae,
 avg(gt_count) as mean_gt, avg({E}) as count_bias, avg(abs({E})) / nullif(avg(gt_count), 0) as rel_mae, cast(sum(gt_count) as bigint) as gt_objects, count(*) filter (where pred_count = 0) as n_missing from e group by grp, model)
 select *, {pooled_sql('pooled_')} from s""")
def _(spark, sf):
    return R.group_metrics_block(unit_view(spark, sf), ["grp", "model"])


@query("f28_rank_combos", U + f""", c as (select *, case when pred_count > 10 then 'too_many_objects' when pred_count * gt_count > 80 then 'too_many_pairs' end as cap_reason from unit_view),
 z as (select cond, pred_count, cap_reason, case when cap_reason is null then obj_tp else 0 end as obj_tp, case when cap_reason is null then obj_fp else pred_count end as obj_fp, case when cap_reason is null then obj_fn else gt_count end as obj_fn from c),
 s as (select cond, count(*) as n_units, {sums_sql(*OBJ_COLS[:3])}, avg({ok('2 * obj_tp', '(2 * obj_tp + obj_fp + obj_fn)')}) as mean_unit_f1, count(cap_reason) as n_capped, max(pred_count) as max_pred from z group by cond),
 h as (select cond, '{{' || string_agg('"' || cap_reason || '":' || n, ',' order by cap_reason) || '}}' as cap_reasons from (select cond, cap_reason, count(*) as n from c where cap_reason is not null group by 1, 2) group by cond)
 select s.*, {pooled_sql('')}, cast(n_capped as double) / n_units as cap_rate, coalesce(cap_reasons, '{{}}') as cap_reasons from s left join h using (cond)""")
def _(spark, sf):
    return R.rank_combos(R.cap_penalty(unit_view(spark, sf), 10, 80), "cond")


@query("f29_cap_penalty", U + """ select uid, model, case when pred_count > 10 then 'too_many_objects' when pred_count * gt_count > 80 then 'too_many_pairs' end as cap_reason,
 case when pred_count > 10 or pred_count * gt_count > 80 then 0 else obj_tp end as obj_tp, case when pred_count > 10 or pred_count * gt_count > 80 then pred_count else obj_fp end as obj_fp,
 case when pred_count > 10 or pred_count * gt_count > 80 then gt_count else obj_fn end as obj_fn from unit_view""")
def _(spark, sf):
    return R.cap_penalty(unit_view(spark, sf), 10, 80).select("uid", "model", "cap_reason", "obj_tp", "obj_fp", "obj_fn")


BEST = U + f""", s as (select cond, arm, split, {sums_sql(*OBJ_COLS[:3])} from unit_view group by 1, 2, 3), f as (select *, {ok('2 * obj_tp', '(2 * obj_tp + obj_fp + obj_fn)')} as f1 from s),
 w as (select arm, cond, max(f1) filter (where split = 'val') as val_f1, max(f1) filter (where split = 'test') as test_f1 from f group by 1, 2)"""


@query("f30_select_best", BEST + " select arm, cond, val_f1, test_f1, coalesce(val_f1, test_f1) as score from w qualify row_number() over (partition by arm order by coalesce(val_f1, test_f1) desc, cond) = 1")
def _(spark, sf):
    f = R.pooled_metrics(unit_view(spark, sf), ["arm", "cond", "split"])
    at = lambda s: F.max(F.when(F.col("split") == s, F.col("obj_f1")))
    wide = f.groupBy("arm", "cond").agg(at("val").alias("val_f1"), at("test").alias("test_f1"))
    return R.select_best(wide, ["arm"], "cond")


@query("f31_grid_score", U + f" select cond, arm, avg(pred_count) as mean_pred, avg(gt_count) as mean_gt, avg(abs({E})) as mae, cond = 'ECONOMY' and arm = 'control' as is_default from unit_view group by cond, arm")
def _(spark, sf):
    return R.grid_score(unit_view(spark, sf), ["cond", "arm"], {"cond": "ECONOMY", "arm": "control"})


AUDIT = """select count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic_n, count(*) as n from labels"""


@query("f33_flag_summary", """select flag, n_true, n_total from (select count(*) as n_total, count(*) filter (where quality = 1) as q, count(*) filter (where toxic = 1) as t from labels)
 cross join lateral (values ('quality', q), ('toxic', t)) as v(flag, n_true)""")
def _(spark, sf):
    lab = table(spark, sf, "labels").select((F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    return R.flag_summary(lab, ["quality", "toxic", "absent_flag"])


@query("f33_delta_summary", U + f" select avg(pred_count - gt_count) as delta_mean, max(pred_count - gt_count) as delta_max, {med('pred_count - gt_count')} as delta_median from unit_view")
def _(spark, sf):
    return R.delta_summary(unit_view(spark, sf).withColumn("d", F.col("pred_count") - F.col("gt_count")), "d")


@query("f34_master_summary", """with m as (select 'doc_' || d.doc_id as unique_id, case when d.doc_id % 20 < 14 then 'train' when d.doc_id % 20 < 17 then 'val' else 'test' end as split, lang as cell_line, l.doc_id is not null as has_label from documents d left join labels l using (doc_id))
 select 'total' as section, 'rows' as item, count(*) as n from m union all select 'total', 'distinct_ids', count(distinct unique_id) from m union all select 'total', 'has_label', count(*) filter (where has_label) from m
 union all select 'split', split, count(*) from m group by split union all select 'group', cell_line, count(*) from m group by cell_line
 union all select 'total', 'duplicate_ids', count(*) from (select unique_id from m group by 1 having count(*) > 1)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lab = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has_label"))
    m = d.join(lab, "doc_id", "left").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("unique_id"),
        F.when(F.col("doc_id") % 20 < 14, "train").when(F.col("doc_id") % 20 < 17, "val").otherwise("test").alias("split"),
        F.col("lang").alias("cell_line"), F.coalesce("has_label", F.lit(False)).alias("has_label"),
    )
    return R.master_summary(m, ["has_label"])


@query("f35_label_audit", """select n.name as raw, coalesce(m.v, trim(n.name)) as canonical, count(*) as n
 from (select (['COLO320DM', 'snu16', 'NCI_H2170', 'sum159pt', 'NCIH716', 'skgt2', 'ctrl'])[p_size % 7 + 1] as name from part) n
 left join (values ('COLO320DM', 'COLO320DM'), ('SNU16', 'SNU16'), ('NCIH716', 'NCI-H716'), ('NCIH2170', 'NCI-H2170'), ('SUM159PT', 'SUM159PT'), ('H716', 'NCI-H716'), ('H2170', 'NCI-H2170')) as m(k, v)
 on regexp_replace(upper(n.name), '[-_ ]', '', 'g') = m.k group by 1, 2""")
def _(spark, sf):
    from gridtally.sources.views import NAME_TOKENS

    tok = F.element_at(F.array(*[F.lit(t) for t in NAME_TOKENS]), (F.col("p_size") % 7 + 1).cast("int"))
    df = table(spark, sf, "part").select(tok.alias("name"))
    return R.label_audit(df, "name", K.canonical_label(F.col("name")))


@query("f36_resource_composition", """with m as (select lang, case when d.doc_id % 20 < 14 then 'train' when d.doc_id % 20 < 17 then 'val' else 'test' end as split, l.doc_id is not null as b from documents d left join labels l using (doc_id))
 select lang, count(*) as total, count(*) filter (where b) as benchmark, count(*) filter (where not b) as extension, count(*) filter (where b and split = 'train') as n_train, count(*) filter (where b and split = 'val') as n_val, count(*) filter (where b and split = 'test') as n_test from m group by lang""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lab = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("b"))
    m = d.join(lab, "doc_id", "left").withColumn("split", F.when(F.col("doc_id") % 20 < 14, "train").when(F.col("doc_id") % 20 < 17, "val").otherwise("test"))
    return R.resource_composition(m, "lang", F.col("b"))


@query("f37_condition_inventory", U + f", a as (select cond, count(*) as n_full, avg(gt_count) as gt_mean, {med('gt_count')} as gt_median from unit_view group by cond), b as (select cond, count(*) as n_benchmark from unit_view where arm = 'treated' group by cond) select a.*, coalesce(n_benchmark, 0) as n_benchmark, n_full - coalesce(n_benchmark, 0) as n_only_full from a left join b using (cond)")
def _(spark, sf):
    u = unit_view(spark, sf)
    return R.condition_inventory(u, u.where("arm = 'treated'"), ["cond"])


@query("f39_census", with_views("page_files") + """, f as (select *, split_part(path, '/', 1) as root, case when path like '%/%' then split_part(path, '/', 2) else '' end as dir from page_files)
 select root, dir, count(*) as n_files, cast(sum(size_bytes) as bigint) as bytes, arg_max(path, struct_pack(s := size_bytes, p := path)) as largest from f group by rollup (root, dir)""")
def _(spark, sf):
    f = page_files(spark, sf).withColumn("root", F.split_part("path", F.lit("/"), F.lit(1))).withColumn("dir", F.split_part("path", F.lit("/"), F.lit(2)))
    return R.census(f, ["root", "dir"])


@query("f40_dir_stats", with_views("page_files") + r""", f as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, lower(regexp_extract(regexp_replace(path, '^.*/', ''), '[^.].*\.([^.]*)$', 1)) as ext from page_files),
 b as (select dir, count(*) as n_files, cast(sum(size_bytes) as bigint) as bytes from f group by dir),
 s as (select regexp_extract(dir, '^(.*)/[^/]+$', 1) as dir, count(distinct dir) as n_subdirs from f group by 1),
 e as (select dir, ext, count(*) as n, row_number() over (partition by dir order by count(*) desc, ext) as rn from f group by 1, 2),
 t as (select dir, string_agg(ext || ':' || n, ', ' order by n desc, ext) as top_exts from e where rn <= 5 group by dir)
 select b.*, coalesce(n_subdirs, 0) as n_subdirs, top_exts from b left join s on b.dir = s.dir and s.dir <> '' left join t on b.dir = t.dir""")
def _(spark, sf):
    f = page_files(spark, sf).withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("ext", K.extension(F.col("path")))
    return R.dir_stats(f)


@query("f41_completeness_audit", """with d as (select d.doc_id, d.lang, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id)),
 c as (select count(*) as n, count(doc_id) as a, count(nullif(trim(lang), '')) as b, count(nullif(trim(source), '')) as c, count(quality) as d, count(toxic) as e from d)
 select "column", n_filled, n - n_filled as n_blank, case when n_filled = 0 then 'empty' when n_filled = n then 'complete' else 'partial' end as state
 from c cross join lateral (values ('doc_id', a), ('lang', b), ('source', c), ('quality', d), ('toxic', e)) as v("column", n_filled)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.completeness_audit(d)


@query("f42_arm_shift", U + f" select grp, model, avg({E}) filter (where arm = 'treated') as treated, avg({E}) filter (where arm = 'control') as control, avg({E}) filter (where arm = 'treated') - avg({E}) filter (where arm = 'control') as shift from unit_view group by grp, model having count(distinct arm) = 2")
def _(spark, sf):
    u = unit_view(spark, sf).withColumn("err", (F.col("pred_count") - F.col("gt_count")).cast("double"))
    return R.arm_shift(u, ["grp", "model"], "err")


@query("f43_count_disclosure", U + f""", d as (select grp, gt_count as a, pred_count as b from unit_view)
 select grp, count(*) as n, count(*) filter (where a = b) as n_equal, count(*) filter (where a > b) as n_larger, count(*) filter (where a < b) as n_smaller, 100.0 * count(*) filter (where a = b) / count(*) as pct_equal,
 avg(abs(a - b)) as mean_abs_delta, max(abs(a - b)) as max_abs_delta, {corr_sql('a', 'b')} as pearson_r, {med('a')} as median_a, {med('b')} as median_b, {med('abs(a - b)')} as median_abs_delta from d group by grp""")
def _(spark, sf):
    return R.count_disclosure(unit_view(spark, sf), ["grp"], "gt_count", "pred_count")


@query("f44_condition_matrix", U + """, b as (select model, cond, pred_count as v from unit_view union all select 'truth', cond, gt_count from unit_view where model = 'A')
 select model, """ + ", ".join(f"avg(v) filter (where cond = '{c}') as {c}" for c in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) + " from b group by model")
def _(spark, sf):
    return R.condition_matrix(unit_view(spark, sf), "cond", "pred_count", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], MODELS)


@query("f44_column_attributes", U + " select cond, case when min(grp) = max(grp) then min(grp) else 'mixed' end as grp, case when min(model) = max(model) then min(model) else 'mixed' end as model from unit_view where model = 'A' group by cond")
def _(spark, sf):
    return unit_view(spark, sf).where("model = 'A'").groupBy("cond").agg(R.single_or_mixed(F.col("grp")).alias("grp"), R.single_or_mixed(F.col("model")).alias("model"))


@query("f45_median_with_iqr", REGION + f" select grp, {med('iou')} as median, greatest({med('iou')} - {med('iou', .25)}, 0) as below, greatest({med('iou', .75)} - {med('iou')}, 0) as above from r group by grp")
def _(spark, sf):
    return R.median_with_iqr(region_rows(spark, sf), ["grp"], "iou")


@query("f45_pooled_ratio", REGION + " select grp, cast(sum(kept) as double) / nullif(sum(gt_count), 0) as pooled from r group by grp")
def _(spark, sf):
    return R.pooled_ratio(region_rows(spark, sf), ["grp"], "kept", "gt_count")


# ---- G ----------------------------------------------------------------------------------------


@query("g1_average_rank", "select event_id, event_type, value, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0 as avg_rank from events")
def _(spark, sf):
    return G.average_rank(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value")


@query("g2_running_best", "select event_id, event_type, value, max(value) over (partition by event_type order by ts, event_id rows unbounded preceding) as best from events")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    return G.running_best(ev, ["event_type"], ["ts", "event_id"], "value").drop("ts")


@query("g3_share_of_total", U + ", c as (select grp, split, count(*) as n from unit_view group by 1, 2) select grp, split, n, 100.0 * n / sum(n) over (partition by grp) as pct from c")
def _(spark, sf):
    c = unit_view(spark, sf).groupBy("grp", "split").agg(F.count(F.lit(1)).alias("n"))
    return G.share_of_total(c, ["grp"], "n")


@query("g4_group_min_compare", U + f", c as (select cond, model, avg(abs({E})) as mae from unit_view group by 1, 2) select *, mae > min(mae) over (partition by cond) as above_min from c")
def _(spark, sf):
    c = R.error_metrics(unit_view(spark, sf), ["cond", "model"]).select("cond", "model", F.col("count_mae").alias("mae"))
    return G.group_min_compare(c, ["cond"], "mae")


@query("g5_first_per_key", "select o_custkey, o_orderdate, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return G.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("g5_first_n_per_group", U + " select grp, uid, model from unit_view where model = 'A' qualify row_number() over (partition by grp order by uid) <= 5")
def _(spark, sf):
    return G.first_n_per_group(unit_view(spark, sf).where("model = 'A'").select("grp", "uid", "model"), ["grp"], ["uid"], 5)


@query("g6_spread_check", U + " select uid, max(gt_count) - min(gt_count) as spread, max(gt_count) - min(gt_count) <= 0 as within_tol from unit_view group by uid")
def _(spark, sf):
    return G.spread_check(unit_view(spark, sf), ["uid"], "gt_count")


@query("g7_ordered_display", U + " select cond, arm, count(*) as n, row_number() over (order by case arm when 'control' then 1 else 2 end, count(*) desc, cond) as pos from unit_view group by cond, arm")
def _(spark, sf):
    from pyspark.sql import Window as W

    c = unit_view(spark, sf).groupBy("cond", "arm").agg(F.count(F.lit(1)).alias("n"))
    shown = G.ordered_display(c, {"arm": ["control", "treated"]}, [F.desc("n"), "cond"])
    return shown.withColumn("pos", F.row_number().over(W.orderBy(F.when(F.col("arm") == "control", 1).otherwise(2), F.desc("n"), "cond")))


@query("g8_decomposition_steps", U + f""", s as (select grp, case split when 'train' then 1 when 'val' then 2 else 3 end as step, {sums_sql(*OBJ_COLS[:3])} from unit_view group by 1, 2), f as (select grp, step, {ok('2 * obj_tp', '(2 * obj_tp + obj_fp + obj_fn)')} as f1 from s)
 select *, f1 - lag(f1) over (partition by grp order by step) as delta from f""")
def _(spark, sf):
    f = R.pooled_metrics(unit_view(spark, sf), ["grp", "split"])
    step = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(3)
    return G.decomposition_steps(f.select("grp", step.alias("step"), F.col("obj_f1").alias("f1")), ["grp"], "step", "f1")
