"""Queries for statistics, sweeps and contrast studies (H, F23, F25-F27, F38)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtally.operators import joins as D
from gridtally.operators import matching as X
from gridtally.operators import rollups as R
from gridtally.operators import select as S
from gridtally.operators import stats as H
from gridtally.plans.catalog_rollups import E, U, corr_sql, med, ok, sums_sql
from gridtally.plans.registry import query
from gridtally.session import cut_lineage, ratio
from gridtally.sources.views import MODELS, table, unit_view


def sr_sql(src, keys, d):
    """CTEs ``sr``: signed-rank sums of the differences ``d`` of table ``src`` per keys."""
    k = ", ".join(keys)
    on = f"using ({k})"
    return f"""dd as (select {k}, cast({d} as double) as d from {src} where {d} is not null),
 rr as (select *, rank() over (partition by {k} order by abs(d)) + (count(*) over (partition by {k}, abs(d)) - 1) / 2.0 as r, count(*) over (partition by {k}, abs(d)) as t from dd where d <> 0),
 s1 as (select {k}, count(*) as n, sum(r) filter (where d > 0) as rp0, sum(r) filter (where d < 0) as rm0, sum(cast(t as double) * t - 1) as ties from rr group by {k}),
 sr as (select {k}, b.n_pairs, n as n_used, coalesce(rp0, 0) as r_plus, coalesce(rm0, 0) as r_minus, ties, (coalesce(rp0, 0) - n * (n + 1) / 4.0) / sqrt((cast(n as double) * (n + 1) * (2 * n + 1) - ties / 2.0) / 24.0) as z from (select {k}, count(*) as n_pairs from dd group by {k}) b left join s1 {on})"""


def rs_sql(src, keys, v, a):
    """CTE ``rs``: rank-sum statistics of value ``v``, sample a where ``a`` holds."""
    k = ", ".join(keys)
    return f"""ru as (select {k}, {a} as is_a, rank() over (partition by {k} order by {v}) + (count(*) over (partition by {k}, {v}) - 1) / 2.0 as r, count(*) over (partition by {k}, {v}) as t from {src}),
 r0 as (select {k}, count(*) filter (where is_a) as n_a, count(*) filter (where not is_a) as n_b, coalesce(sum(r) filter (where is_a), 0) as ra, sum(cast(t as double) * t - 1) as ties from ru group by {k}),
 r1 as (select *, ra - n_a * (n_a + 1) / 2.0 as u from r0),
 rs as (select * exclude (ra), case when n_a * n_b > 0 and n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / (cast(n_a + n_b as double) * (n_a + n_b - 1))) > 0 then (greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / (cast(n_a + n_b as double) * (n_a + n_b - 1)))) end as z,
  2.0 * u / nullif(n_a * n_b, 0) - 1.0 as cliffs_delta from r1)"""


WIDE = U + """, w as (select uid, any_value(grp) as grp, max(pred_count) filter (where model = 'A') as a, max(pred_count) filter (where model = 'N') as n from unit_view group by uid)"""


def wide(spark, sf):
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("pred_count")))
    return unit_view(spark, sf).groupBy("uid").agg(F.first("grp").alias("grp"), at("A").alias("a"), at("N").alias("n"))


@query("h1_wilcoxon_statistics", WIDE + f", {sr_sql('w', ['grp'], '(a - n)')} select grp, n_pairs, n_used, r_plus, r_minus, ties, z from sr")
def _(spark, sf):
    s = H.signed_rank_statistics(wide(spark, sf), ["grp"], F.col("a") - F.col("n"))
    return s.select("grp", "n_pairs", "n_used", "r_plus", "r_minus", "ties", "z")


@query("h1_wilcoxon_signed_rank")
def _(spark, sf):
    return H.wilcoxon_signed_rank(wide(spark, sf), ["grp"], F.col("a"), F.col("n"))


@query("h2_friedman_statistics", U + """, x as (select grp, uid, model, pred_count as v, count(*) over (partition by uid) as k from unit_view), y as (select *, count(*) over (partition by uid, v) as t, rank() over (partition by uid order by v) + (count(*) over (partition by uid, v) - 1) / 2.0 as r from x where k = 3),
 s as (select grp, model, sum(r) as s, count(*) as n, sum(t * t - 1.0) as ties from y group by 1, 2), g as (select grp, max(n) as n_used, sum(s * s) as ss, sum(ties) as ties from s group by grp)
 select grp, n_used, case when n_used >= 2 then (12.0 / (n_used * 3.0 * 4) * ss - 3.0 * n_used * 4) / nullif(1.0 - ties / (n_used * 3.0 * 8), 0) end as statistic from g""")
def _(spark, sf):
    return H.friedman_statistics(unit_view(spark, sf), ["grp"], "uid", "model", "pred_count", 3)


@query("h2_friedman_test")
def _(spark, sf):
    return H.friedman_test(unit_view(spark, sf), ["grp"], "uid", "model", "pred_count", 3)


EV = "with ev as (select *, user_id % 5 as g from events where event_type in ('click', 'view'))"


def samples(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type", "value", (F.col("user_id") % 5).alias("g"))


@query("h3_mann_whitney_statistics", EV + f""", {rs_sql('ev', ['g'], 'value', "event_type = 'click'")} select g, n_a, n_b, u, ties, z, cliffs_delta from rs""")
def _(spark, sf):
    return H.rank_sum_statistics(samples(spark, sf), ["g"], "value", F.col("event_type") == "click").select("g", "n_a", "n_b", "u", "ties", "z", "cliffs_delta")


@query("h3_mann_whitney_u")
def _(spark, sf):
    return H.mann_whitney_u(samples(spark, sf), ["g"], "value", F.col("event_type") == "click")


PV = "with pv as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as g, case when l_linenumber = 7 then null else pow(l_extendedprice / 110000.0, 4) end as p from lineitem)"


def p_values(spark, sf):
    p = F.when(F.col("l_linenumber") != 7, F.pow(F.col("l_extendedprice") / 110000.0, F.lit(4.0)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("g"), p.alias("p"))


@query("h4_benjamini_hochberg", PV + """, n as (select g, count(*) as m from pv group by g), h as (select g, p, count(*) as c from pv where p is not null group by g, p),
 r as (select g, p, sum(c) over (partition by g order by p rows unbounded preceding) as rk from h), q as (select r.g, p, min(m / cast(rk as double) * p) over (partition by r.g order by p desc rows unbounded preceding) as q from r join n using (g))
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, pv.g, pv.p, case when q is not null then least(1.0, q) end as q_value, coalesce(q <= 0.05, false) as rejected from pv left join q on q.g = pv.g and q.p = pv.p""")
def _(spark, sf):
    return H.benjamini_hochberg(p_values(spark, sf), ["g"], "p")


@query("h5_holm", PV + """, o as (select * exclude (p), coalesce(p, 1.0) as p1, p from pv), r as (select *, rank() over (partition by g order by p1) - 1 as i, count(*) over (partition by g) as n from o)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, g, p, least(1.0, max((n - i) * p1) over (partition by g order by p1 range unbounded preceding)) as q_holm from r""")
def _(spark, sf):
    return H.holm(p_values(spark, sf), ["g"], "p")


@query("h6_cliffs_delta", "with ev as (select *, user_id % 5 as g from events where event_type in ('click', 'view')), c as (select a.g, cast(sum(case when a.value > b.value then 1 when a.value < b.value then -1 else 0 end) as double) as s, count(*) as n from ev a join ev b on a.g = b.g and a.event_type = 'click' and b.event_type = 'view' group by a.g) select g, s / n as cliffs_delta from c")
def _(spark, sf):
    return H.cliffs_delta(samples(spark, sf), ["g"], "value", F.col("event_type") == "click")


@query("h7_log2fc_medians", EV + " select g, log2((quantile_cont(value, 0.5) filter (where event_type = 'click') + 0.5) / (quantile_cont(value, 0.5) filter (where event_type = 'view') + 0.5)) as log2_fc from ev group by g")
def _(spark, sf):
    a = F.col("event_type") == "click"
    q = H.exact_quantiles(samples(spark, sf), ["g"], {"a": (F.when(a, F.col("value")), 0.5), "b": (F.when(~a, F.col("value")), 0.5)})
    return q.select("g", H.log2fc_medians(F.col("a"), F.col("b")).alias("log2_fc"))


@query("h8_bootstrap_ci")
def _(spark, sf):
    return H.bootstrap_ci(samples(spark, sf), ["g"], "value", F.col("event_type") == "click")


def contrasts(df):
    """Every group with two part types contrasted, derived from the groups that occur."""
    return df.select(F.col("grp").alias("cell_line")).distinct().select(
        F.concat(F.lit("ECONOMY+PROMO vs STANDARD in "), "cell_line").alias("contrast"), "cell_line",
        F.array(F.lit("ECONOMY"), F.lit("PROMO")).alias("treated"), F.array(F.lit("STANDARD")).alias("control"), F.lit(True).alias("batch_matched"),
    )


def counts_with_truth(spark, sf):
    u = unit_view(spark, sf).select("uid", F.col("grp").alias("cell_line"), "cond", "split", "model", "pred_count", "gt_count")
    return S.append_truth_series(u, "A"), contrasts(unit_view(spark, sf))


CR = U + """, al as (select uid, grp, cond, split, model, pred_count, gt_count from unit_view union all select uid, grp, cond, split, 'truth', gt_count, gt_count from unit_view where model = 'A'),
 cr as (select 'ECONOMY+PROMO vs STANDARD in ' || grp as contrast, grp as cell_line, true as batch_matched, model, cond <> 'STANDARD' as tr, pred_count as v, cast(pred_count - gt_count as double) as e from al where cond in ('ECONOMY', 'PROMO', 'STANDARD'))"""
CK = ["contrast", "cell_line", "batch_matched", "model"]
CKS = ", ".join(CK)
CON = CR + f", {rs_sql('cr', CK, 'v', 'tr')}, md as (select {CKS}, quantile_cont(cast(v as double), 0.5) filter (where tr) as mt, quantile_cont(cast(v as double), 0.5) filter (where not tr) as mc from cr group by {CKS}), res as (select {CKS}, n_a as n_treated, n_b as n_control, mt as median_treated, mc as median_control, mt - mc as median_diff, log2((mt + 0.5) / (mc + 0.5)) as log2_fc, cliffs_delta, u, z from rs join md using ({CKS}) where n_a >= 8 and n_b >= 8)"


@query("h9_contrast_effects", CON + " select * from res")
def _(spark, sf):
    df, con = counts_with_truth(spark, sf)
    return H.run_contrasts(df, con, n_boot=None).drop("p_mwu", "sig_005")


@query("h9_run_contrasts")
def _(spark, sf):
    df, con = counts_with_truth(spark, sf)
    return H.run_contrasts(df, con, n_boot=200)


@query("h10_compare_to_truth", CON + f""", s as (select *, z > 2.0 as sig_005 from res), t as (select contrast, log2_fc as gt_log2fc, sig_005 as gt_sig from s where model = 'truth')
 select s.contrast, s.model, log2_fc, sig_005, gt_log2fc, gt_sig, log2_fc - gt_log2fc as log2fc_error, sign(log2_fc) = sign(gt_log2fc) as direction_agrees, sig_005 = gt_sig as sig_agrees from s left join t using (contrast)""")
def _(spark, sf):
    df, con = counts_with_truth(spark, sf)
    res = H.run_contrasts(df, con, n_boot=None).select("contrast", "model", "log2_fc", (F.col("z") > 2.0).alias("sig_005"))
    return H.compare_to_truth(res)


AGREE = CON + """, s as (select *, z > 2.0 as sig_005 from res), t as (select contrast, log2_fc as g, sig_005 as gs from s where model = 'truth'), c as (select 'all' as subset, s.contrast, s.model, log2_fc - g as err, sign(log2_fc) = sign(g) as dir, sig_005 = gs as sig from s left join t using (contrast))"""


def agreements(spark, sf):
    df, con = counts_with_truth(spark, sf)
    res = H.run_contrasts(df, con, n_boot=None).select(F.lit("all").alias("subset"), "contrast", "model", "log2_fc", (F.col("z") > 2.0).alias("sig_005"))
    return H.compare_to_truth(res)


@query("f38_agreement_summary", AGREE + f" select subset, model, count(distinct contrast) as n_contrasts, count(*) filter (where sig) as sig_correct, count(*) filter (where dir) as direction_correct, {med('abs(err)')} as median_abs_log2fc_error from c group by 1, 2")
def _(spark, sf):
    return R.agreement_summary(agreements(spark, sf))


@query("f38_verdict_flips", AGREE + " select subset, contrast, count(*) filter (where not sig) as n_sig_flips, count(*) filter (where not dir) as n_direction_flips from c group by 1, 2")
def _(spark, sf):
    return R.verdict_flips(agreements(spark, sf))


@query("h11_bias_shift_effects", CR + f", {rs_sql('cr', CK, 'e', 'tr')}, mm as (select {CKS}, avg(e) filter (where tr) as bias_treated, avg(e) filter (where not tr) as bias_control, avg(abs(e)) filter (where tr) as mae_treated, avg(abs(e)) filter (where not tr) as mae_control from cr group by {CKS}) select {CKS}, n_a as n_treated, n_b as n_control, bias_treated, bias_control, bias_treated - bias_control as bias_shift, mae_treated, mae_control, u, z from rs join mm using ({CKS}) where n_a >= 8 and n_b >= 8")
def _(spark, sf):
    df, con = counts_with_truth(spark, sf)
    return H.bias_shift(df, con).drop("p_bias_shift", "q_bias_shift", "shift_significant")


@query("h11_bias_shift")
def _(spark, sf):
    df, con = counts_with_truth(spark, sf)
    return H.bias_shift(df, con)


@query("h12_error_significance")
def _(spark, sf):
    return H.error_significance(unit_view(spark, sf), ["grp", "cond", "arm"], "grp", "A")


@query("h12_error_means", U + f" select grp, cond, arm, model, count(*) as n_units, avg(abs({E})) as mean_abs_error, avg({E}) as mean_signed_error from unit_view group by 1, 2, 3, 4 having count(*) >= 8")
def _(spark, sf):
    return H.error_significance(unit_view(spark, sf), ["grp", "cond", "arm"], "grp", "A").select("grp", "cond", "arm", "model", "n_units", "mean_abs_error", "mean_signed_error")


@query("h13_paired_effects", WIDE + f""", {sr_sql('w', ['grp'], '(n - a)')}, b as (select grp, count(*) as n_pairs, count(*) filter (where n > a) as n_up, count(*) filter (where n < a) as n_down, count(*) filter (where n = a) as n_equal, avg(a) as mean_before, avg(n) as mean_after, avg(n - a) as mean_delta,
 {med('a')} as median_before, {med('n')} as median_after, {med('n - a')} as median_delta from w group by grp) select b.*, least(r_plus, r_minus) as w_two_sided, r_plus as w_greater from b join sr using (grp)""")
def _(spark, sf):
    return H.paired_summary(wide(spark, sf), ["grp"], "a", "n").drop("p_two_sided", "p_greater")


@query("h13_paired_summary")
def _(spark, sf):
    return H.paired_summary(wide(spark, sf), ["grp"], "a", "n")


# ---- F23: cost of a region run against a base run --------------------------------------------------


@query("f23_roi_cost_summary", U + f""", f as (select uid, split, model, {ok('2 * obj_tp', '(2 * obj_tp + obj_fp + obj_fn)')} as f1, cast(pred_count - gt_count as double) as e from unit_view), j as (select a.split, a.f1 as fa, b.f1 as fb, a.e as ea, b.e as eb from f a join f b on a.uid = b.uid and a.model = 'A' and b.model = 'R')
 select split, count(*) as n_units, avg(fa) as f1_a, avg(fb) as f1_b, avg(fb - fa) as d_f1, avg(abs(ea)) as mae_a, avg(abs(eb)) as mae_b, avg(ea) as bias_a, avg(eb) as bias_b from j group by split""")
def _(spark, sf):
    return R.roi_cost_summary(*two_runs(spark, sf), ["split"], p=False)


@query("f23_roi_cost_test")
def _(spark, sf):
    return R.roi_cost_summary(*two_runs(spark, sf), ["split"])


def two_runs(spark, sf):
    from gridtally.functions.metrics import f1

    f = unit_view(spark, sf).select("uid", "split", "model", f1(F.col("obj_tp"), F.col("obj_fp"), F.col("obj_fn")).alias("f1"), (F.col("pred_count") - F.col("gt_count")).cast("double").alias("err"))
    return f.where("model = 'A'").drop("model"), f.where("model = 'R'").drop("model")


# ---- F25-F27: sweep tables -------------------------------------------------------------------------

SW = """with x as (select l_returnflag as model, case when l_linestatus = 'F' then 'OR' else 'AND' end as policy, l_linenumber * 5.0::double as d_max, cast(cast(round(l_tax * 100) as int) % 3 as double) / 10 as min_iou, 'test' as split,
 cast(l_quantity as bigint) as tp, l_partkey % 20 as fp, l_suppkey % 20 as fn, l_orderkey % 3 as ignored from lineitem),
 g as (select model, split, policy, d_max, min_iou, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(ignored) as bigint) as ignored from x group by 1, 2, 3, 4, 5),
 sw as (select *, coalesce(cast(tp as double) / nullif(tp + fp, 0), 0) as precision, coalesce(cast(tp as double) / nullif(tp + fn, 0), 0) as recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from g)"""


def sweep_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") == "F", "OR").otherwise("AND").alias("policy"), (F.col("l_linenumber") * 5.0).alias("d_max"),
        ((F.round(F.col("l_tax") * 100).cast("int") % 3).cast("double") / 10).alias("min_iou"), F.lit("test").alias("split"),
        F.col("l_quantity").cast("bigint").alias("tp"), (F.col("l_partkey") % 20).alias("fp"), (F.col("l_suppkey") % 20).alias("fn"), (F.col("l_orderkey") % 3).alias("ignored"),
    )


@query("f25_sweep_summary", SW + " select * from sw")
def _(spark, sf):
    return R.sweep_summary(sweep_rows(spark, sf))


@query("f26_sensitivity_range", SW + f""", o as (select * from sw where policy = 'OR') select model, count(*) as n_grid, min(f1) as f1_min, max(f1) as f1_max, max(f1) filter (where d_max = 20 and min_iou = 0.1) as f1_canonical, {med('f1', .25)} as f1_q25, {med('f1')} as f1_median, {med('f1', .75)} as f1_q75,
 max(f1) - min(f1) as f1_range, max(f1) filter (where d_max = 20 and min_iou = 0.1) - {med('f1')} as canonical_minus_median from o group by model""")
def _(spark, sf):
    return R.sensitivity_range(R.sweep_summary(sweep_rows(spark, sf)).where("policy = 'OR'"), {"d_max": 20.0, "min_iou": 0.1})


@query("f27_sweep_heatmap", SW + " select model, policy, d_max, avg(f1) filter (where min_iou = 0.0) as iou_0_0, avg(f1) filter (where min_iou = 0.1) as iou_0_1, avg(f1) filter (where min_iou = 0.2) as iou_0_2 from sw group by 1, 2, 3")
def _(spark, sf):
    return R.sweep_heatmap(R.sweep_summary(sweep_rows(spark, sf)), ["model", "policy"], [0.0, 0.1, 0.2])
