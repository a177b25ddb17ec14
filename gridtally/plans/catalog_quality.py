"""Queries for audits, reconciliation and splits (K, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtally.functions import keys as K
from gridtally.operators import quality as Q
from gridtally.operators import rollups as R
from gridtally.operators import splits as L
from gridtally.plans.catalog_rollups import E, SU, U, UNIT_OBJ, med, ok, pooled_sql, sums_sql
from gridtally.plans.registry import query
from gridtally.sources.views import page_files, supp_view, table, unit_view, with_views

PG = with_views("page_files")
F1 = ok("2 * obj_tp", "(2 * obj_tp + obj_fp + obj_fn)")


@query("k2_duplicate_rows", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(spark, sf):
    return Q.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def order_units(spark, sf):
    path = lambda i: F.concat(F.lit("f_"), F.col("o_orderkey").cast("string"), F.lit(f"_{i}"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("uid"), path(1).alias("rgb_path"), path(2).alias("dapi_path"), path(3).alias("roi_path"), path(4).alias("gt_path")
    )


def line_facts(spark, sf):
    li = table(spark, sf, "lineitem")
    return (
        li.withColumn("path", F.concat_ws("_", F.lit("f"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
        .select("path", "l_discount", "l_partkey", "l_quantity").repartition(Q.tasks_for(li.count()), "path")
        .groupBy("path")
        .agg(
            F.max(F.col("l_discount") < 0.09).alias("readable"), (100 + F.max(F.col("l_partkey") % 50).cast("int") / 49).cast("int").alias("h"),
            F.lit(100).alias("w"), F.greatest(F.max("l_quantity").cast("bigint") - 5, F.lit(0)).alias("nonzero"),
        )
    )


FACTS = """facts as (select 'f_' || l_orderkey || '_' || l_linenumber as path, max(l_discount < 0.09) as readable, cast(floor(100 + max(l_partkey % 50) / 49.0) as int) as h, 100 as w, greatest(max(cast(l_quantity as bigint)) - 5, 0) as nonzero from lineitem group by 1)"""


def _audit_sql():
    cols, joins = [], []
    for i, m in enumerate(Q.MODALITIES, 1):
        joins.append(f"left join facts f{i} on f{i}.path = 'f_' || o_orderkey || '_{i}'")
        r = f"coalesce(f{i}.readable, false)"
        cols.append(f"f{i}.path is not null as {m}_exists, {r} as {m}_read_ok, case when {r} then f{i}.h end as {m}_h, case when {r} then f{i}.w end as {m}_w, case when {r} then f{i}.nonzero end as {m}_nonzero")
    base = f"a0 as (select o_orderkey as uid, {', '.join(cols)} from orders {' '.join(joins)})"
    ok_all = " and ".join(f"{m}_read_ok" for m in Q.MODALITIES)
    same = " and ".join(f"rgb_h = {m}_h and rgb_w = {m}_w" for m in Q.MODALITIES[1:])
    a1 = f"""a1 as (select *, coalesce({ok_all} and {same}, false) as shapes_match_all, coalesce(roi_nonzero > 0, false) as roi_nonempty, coalesce(gt_nonzero > 0, false) as gt_nonempty,
 coalesce(rgb_read_ok and roi_read_ok and rgb_h = roi_h and rgb_w = roi_w, false) as masked_rgb_ok from a0)"""
    flags = " and ".join([*[f"{m}_exists" for m in Q.MODALITIES], *[f"{m}_read_ok" for m in Q.MODALITIES], "shapes_match_all", "roi_nonempty", "masked_rgb_ok"])
    return f"with {FACTS}, {base}, {a1}, a as (select *, {flags} as file_audit_pass from a1)"


AUDIT = _audit_sql()


@query("k3_file_audit", AUDIT + " select * from a")
def _(spark, sf):
    return Q.file_audit(order_units(spark, sf), line_facts(spark, sf))


CMC = """case when n = 0 and not f then true else false end as zero_count_empty_gt, case when n = 0 and f then true else false end as zero_count_nonempty_gt, case when n > 0 and not f then true else false end as positive_count_empty_gt,
 case when n > 0 and f then true else false end as positive_count_nonempty_gt, case when (n = 0 and not f) or (n > 0 and f) then true else false end as count_mask_consistent"""


@query("k4_count_mask_consistency", f"with x as (select doc_id, case when doc_id % 3 = 0 then 'bad' when doc_id % 3 = 1 then '0' else '7' end as c, case when l.doc_id is not null then quality = 1 end as ne from documents left join labels l using (doc_id)), y as (select *, try_cast(c as double) as n, coalesce(ne, false) as f from x) select doc_id, c, ne, {CMC} from y")
def _(spark, sf):
    i = F.col("doc_id")
    lab = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ne"))
    x = table(spark, sf, "documents").select("doc_id", F.when(i % 3 == 0, "bad").when(i % 3 == 1, "0").otherwise("7").alias("c")).join(lab, "doc_id", "left")
    return Q.count_mask_consistency(x, "c", "ne")


@query("k5_count_mismatches", "select o_orderkey as uid, cast(o_totalprice as bigint) as master_count, cast(floor(o_totalprice + 0.1) as bigint) as table_count from orders where cast(floor(o_totalprice) as bigint) <> cast(floor(o_totalprice + 0.1) as bigint)".replace("cast(o_totalprice as bigint) as master", "cast(floor(o_totalprice) as bigint) as master"))
def _(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("uid"), F.floor("o_totalprice").alias("gt_count"))
    return Q.count_mismatches(a, o.select(F.col("o_orderkey").alias("uid"), F.floor(F.col("o_totalprice") + 0.1).alias("gt_count")))


@query("k5_run_qc", AUDIT + f", y as (select a.*, cast(cast(floor(o_totalprice) as bigint) % 2 as bigint) as gt_count, cast(floor(o_totalprice) as bigint) % 2 as n, gt_nonempty as f from a join orders on uid = o_orderkey) select * exclude (n, f), {CMC} from y")
def _(spark, sf):
    counts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), (F.floor("o_totalprice") % 2).alias("gt_count"))
    return Q.run_qc(order_units(spark, sf), counts, line_facts(spark, sf))


STATUS = "select lang as model, case when l.doc_id is null then 'missing' when toxic = 1 then 'error' else 'ok' end as status from documents left join labels l using (doc_id)"


def statuses(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("s"))
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model")).join(lab, "doc_id", "left").select("model", F.coalesce("s", F.lit("missing")).alias("status"))


@query("k6_coverage_check", f"""with s as ({STATUS}), g as (select model, count(*) as n, count(*) filter (where status = 'ok') as n_ok, count(*) filter (where status = 'missing') as n_missing, count(*) filter (where status = 'error') as n_error from s group by model)
 select *, n_missing / n as missing_share, case when n_missing / n > 0.6 then 'error' when n_missing > 0 then 'warn' else 'ok' end as verdict from g""")
def _(spark, sf):
    return Q.coverage_check(statuses(spark, sf), 0.6)


LISTING = PG + """, l0 as (select page_id, case when page_id % 40 = 7 then '' when page_id % 40 = 9 then path || chr(9) || 'x' else path || chr(9) || case when page_id % 11 = 0 then ' ' else 'img/' || page_id end || chr(9) || size_bytes end as line from page_files),
 lines as (select 1 as line_no, 'Files' || chr(9) || 'source' || chr(9) || 'size' as line union all select page_id + 2, line from l0),
 r as (select *, string_split(line, chr(9)) as c from lines where line_no > 1 and trim(line) <> ''), fit as (select *, c[1] as p, c[2] as s from r where len(c) = 3)"""


def listing_lines(spark, sf):
    k, tab = F.col("page_id"), "\t"
    src = F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("img/"), k.cast("string")))
    line = F.when(k % 40 == 7, "").when(k % 40 == 9, F.concat("path", F.lit("\tx"))).otherwise(F.concat_ws(tab, "path", src, F.col("size_bytes").cast("string")))
    body = page_files(spark, sf).select((k + 2).alias("line_no"), line.alias("line"))
    head = body.agg(F.lit(1).cast("bigint").alias("line_no"), F.lit("Files\tsource\tsize").alias("line"))
    return head.unionByName(body)


@query("k8_validate_listing", LISTING + r""" select 'blank_line' as rule, line_no, line from lines where line_no > 1 and trim(line) = '' union all select 'ragged', line_no, line from r where len(c) <> 3
 union all select 'illegal_path', line_no, line from fit where contains(p, '\') or regexp_matches(p, '^(/|\./|\.\./)') or ends_with(p, '/') union all select 'disallowed_character', line_no, line from fit where regexp_matches(p, '[^A-Za-z0-9!\-_.*''()/ ]')
 union all select 'outside_prefix', line_no, line from fit where not (starts_with(p, 'm.') or starts_with(p, 'www.')) union all select 'empty_source', line_no, line from fit where trim(s) = ''
 union all select 'duplicate_path', line_no, line from fit qualify row_number() over (partition by p order by line_no) > 1 union all select 'row_count', 0, cast((select count(*) from r) as varchar) where (select count(*) from r) <> 100""")
def _(spark, sf):
    return Q.validate_listing(listing_lines(spark, sf), ["Files", "source", "size"], ["source"], "Files", ["m.", "www."], 100)


@query("k9_foreign_key_check", "select doc_id as value, count(*) as n from documents where doc_id not in (select doc_id from labels) group by 1")
def _(spark, sf):
    return Q.foreign_key_check(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id")


@query("k10_collision_check", "select l_partkey, count(distinct l_returnflag) as n_lists, min(l_returnflag) as first_list, max(l_returnflag) as last_list from lineitem group by 1 having count(distinct l_returnflag) > 1")
def _(spark, sf):
    return Q.collision_check(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag")


@query("k11_coverage_exactly_once", "with n as (select o_custkey as c_custkey, count(*) as n from orders group by 1) select c.c_custkey, coalesce(n, 0) as n, case when n is null then 'uncovered' else 'covered_twice' end as problem from customer c left join n using (c_custkey) where coalesce(n, 0) <> 1")
def _(spark, sf):
    return Q.coverage_exactly_once(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey")


@query("k12_total_check", "select source, count(*) as n, case when source is null then count(*) = 1000 end as matches from documents group by rollup (source)")
def _(spark, sf):
    return Q.total_check(table(spark, sf, "documents").select("source"), "source", 1000)


@query("k12_inventory_check", "select distinct doc_id as k from documents where doc_id not in (select doc_id from labels)")
def _(spark, sf):
    return Q.inventory_check(table(spark, sf, "documents").select(F.col("doc_id").alias("k")), table(spark, sf, "labels").select(F.col("doc_id").alias("k")), "k")


@query("k13_build_listings", """select 'd/' || doc_id as path, doc_id as uid, source as top_dir, case source when 'web' then 'images' when 'books' then 'points' else 'unrouted' end as listing, n_chars as gt_count,
 coalesce(case when quality = 1 then 'train' when quality = 0 then 'val' end, '') as split, case when l.doc_id is not null then 'benchmark' else 'extension' end as subset from documents left join labels l using (doc_id)""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    inv = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("uid"), F.col("source").alias("top_dir"))
    splits = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    return Q.build_listings(inv, d.select(F.col("doc_id").alias("uid"), F.col("n_chars").alias("gt_count")), splits, {"web": "images", "books": "points"})


@query("k14_verify_manifest", """with f as (select 'd/' || doc_id as relpath, length(text) as size_bytes, sha256(text) as sha from documents where doc_id % 50 <> 3),
 m as (select 'd/' || doc_id as relpath, length(text) + case when doc_id % 50 = 5 then 1 else 0 end as s, case when doc_id % 50 = 8 then 'x' else sha256(text) end as h from documents)
 select relpath, case when f.size_bytes is null then 'missing' when f.size_bytes <> s then 'size_mismatch' else 'digest_mismatch' end as reason from m left join f using (relpath) where f.size_bytes is null or f.size_bytes <> s or sha <> h""")
def _(spark, sf):
    i = F.col("doc_id")
    base = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d/"), i.cast("string")).alias("relpath"), F.length("text").cast("bigint").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    listed = base.select(
        F.col("relpath").alias("relative_path"), (F.col("size_bytes") + F.when(i % 50 == 5, 1).otherwise(0)).alias("size_bytes"), F.when(i % 50 == 8, "x").otherwise(F.col("sha256")).alias("sha256")
    )
    return Q.verify_manifest(listed, base.where(i % 50 != 3))


@query("k15_benchmark_invariants", U + """, g as (select grp, split, count(*) as n_units, cast(sum(gt_count) as bigint) as total from unit_view group by 1, 2), e as (select grp, split, count(*) as exp_units, cast(sum(gt_count) + case when grp = 'Brand#3' then 1 else 0 end as bigint) as exp_total from unit_view where grp <> 'Brand#5' group by 1, 2)
 select coalesce(g.grp, e.grp) as grp, coalesce(g.split, e.split) as split, n_units, total, exp_units, exp_total from g full join e on g.grp = e.grp and g.split = e.split where n_units is distinct from exp_units or total is distinct from exp_total""")
def _(spark, sf):
    u = unit_view(spark, sf)
    exp = u.where("grp <> 'Brand#5'").groupBy("grp", "split").agg(F.count(F.lit(1)).alias("n_units"), (F.sum("gt_count") + F.when(F.col("grp") == "Brand#3", 1).otherwise(0)).alias("total"))
    return Q.benchmark_invariants(u, exp, ["grp", "split"], "gt_count")


@query("k16_reconcile_counts", U + f", p as (select grp, {sums_sql('obj_tp', 'obj_fp')} from unit_view group by 1), l as (select grp, {sums_sql('obj_tp')}, cast(sum(obj_fp + case when split = 'val' and grp < 'Brand#2' then 1 else 0 end) as bigint) as obj_fp from unit_view group by 1) select p.*, l.obj_tp as locked_obj_tp, l.obj_fp as locked_obj_fp from p join l using (grp) where p.obj_tp <> l.obj_tp or p.obj_fp <> l.obj_fp")
def _(spark, sf):
    u = unit_view(spark, sf)
    pool = lambda d: d.groupBy("grp").agg(F.sum("obj_tp").alias("obj_tp"), F.sum("obj_fp").alias("obj_fp"))
    locked = u.withColumn("obj_fp", F.col("obj_fp") + F.when((F.col("split") == "val") & (F.col("grp") < "Brand#2"), 1).otherwise(0))
    return Q.reconcile_counts(pool(u), pool(locked), "grp", ["obj_tp", "obj_fp"])


PUB = U + f""", s as (select model, {sums_sql('obj_tp', 'obj_fp', 'obj_fn')}, avg(abs({E})) as mae from unit_view group by 1), f as (select model, {F1} as f1, mae from s)"""


@query("k17_verify_published", PUB + """, e as (select model, f1 + case model when 'A' then 0.0001 when 'N' then 0.002 else 0 end as pf, mae - 0.01 as pm from f)
 select f.model, metric, published, computed, case when abs(computed - published) <= tol then 'MATCH' else 'DIFFERS' end as verdict from f join e using (model) cross join lateral (values ('f1', pf, f1, 0.0005 + 1e-9), ('mae', pm, mae, 0.05 + 1e-9)) as v(metric, published, computed, tol)""")
def _(spark, sf):
    u = unit_view(spark, sf)
    s = R.pooled_metrics(u, ["model"]).select("model", F.col("obj_f1").alias("f1")).join(R.error_metrics(u, ["model"]).select("model", F.col("count_mae").alias("mae")), "model")
    e = s.select("model", (F.col("f1") + F.when(F.col("model") == "A", 0.0001).when(F.col("model") == "N", 0.002).otherwise(0.0)).alias("pub_f1"), (F.col("mae") - 0.01).alias("pub_mae"))
    return Q.verify_published(s, e, "model", {"f1": 3, "mae": 1})


@query("k18_detect_convention", U + f""", s as (select grp, {sums_sql('obj_tp', 'obj_fp', 'obj_fn')}, avg({F1}) as f1_mean from unit_view group by 1), f as (select *, {F1} as f1_pooled from s)
 select max(abs(f1_pooled - (f1_pooled + 1e-7))) as worst_pooled, max(abs(f1_mean - (f1_pooled + 1e-7))) as worst_mean, 'pooled' as convention from f""")
def _(spark, sf):
    u = unit_view(spark, sf)
    b = R.pooled_metrics(u, ["grp"]).select("grp", F.col("obj_f1").alias("f1_pooled")).join(R.macro_metrics(u, ["grp"]).select("grp", F.col("macro_f1").alias("f1_mean")), "grp")
    return Q.detect_convention(b.withColumn("f1_published", F.col("f1_pooled") + 1e-7), 1e-6)


@query("k19_rounding_audit", "select l_orderkey, l_linenumber, l_partkey, a, b, floor(a * 10.0 + 0.5) / 10.0 - floor(b * 10.0 + 0.5) / 10.0 as diff_of_rounded, floor((a - b) * 10.0 + 0.5) / 10.0 as rounded_diff, abs((floor(a * 10.0 + 0.5) / 10.0 - floor(b * 10.0 + 0.5) / 10.0) - floor((a - b) * 10.0 + 0.5) / 10.0) > 0.05 as disagrees from (select *, l_extendedprice / 7 as a, l_quantity / 7 as b from lineitem)")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 7).alias("a"), (F.col("l_quantity") / 7).alias("b"))
    return Q.rounding_audit(li, "a", "b", 1)


@query("k20_label_conflicts", "select o_custkey, count(distinct o_orderpriority) as n_labels, min(o_orderpriority) as label_a, max(o_orderpriority) as label_b from orders group by 1 having count(distinct o_orderpriority) > 1")
def _(spark, sf):
    return Q.label_conflicts(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("k20_route_conflicts", "select p_partkey, split_part(p_name, ' ', 1) as label_a, lower(p_type) as label_b from part where split_part(p_name, ' ', 1) <> lower(p_type)")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return Q.route_conflicts(p, F.split_part("p_name", F.lit(" "), F.lit(1)), F.lower("p_type")).select("p_partkey", "label_a", "label_b")


@query("k21_comparator_check", U + f""", j as (select a.pred_count as x, b.pred_count as y from unit_view a join unit_view b on a.uid = b.uid and a.model = 'A' and b.model = 'N')
 select count(*) as n, count(*) filter (where x = y) / count(*) as exact_share, cast(sum(y) as double) / sum(x) as ratio, count(*) filter (where y > x) as n_larger, count(*) filter (where y < x) as n_smaller, {med('y - x')} as median_delta, count(*) filter (where x = y) / count(*) >= 0.95 as same_comparator from j""")
def _(spark, sf):
    u = unit_view(spark, sf).select("uid", "model", "pred_count")
    return Q.comparator_check(u.where("model = 'A'"), u.where("model = 'N'"), "uid", "pred_count")


@query("k22_subset_label", "select doc_id, lang, case when quality = 1 then 'train (seen)' when quality = 0 then 'val+test (held-out)' else 'extension' end as subset from documents left join labels using (doc_id)")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    return Q.subset_label(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", lab.where("quality = 1"), lab.where("quality = 0"))


@query("k23_missing_predictions", "select d.doc_id, d.lang, n_chars from documents d where doc_id not in (select doc_id from labels)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return Q.missing_predictions(d.select("doc_id", "lang"), table(spark, sf, "labels"), d.select("doc_id", "n_chars"), "doc_id")


@query("k24_foreground_audit", "select c_custkey as uid, coalesce(fg, -1) as fg from customer left join (select o_custkey, cast(sum(case when cast(floor(o_totalprice) as bigint) >= 100000 then cast(floor(o_totalprice) as bigint) else 0 end) as bigint) as fg from orders group by 1) on c_custkey = o_custkey")
def _(spark, sf):
    comp = table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.floor("o_totalprice").alias("area"))
    return Q.foreground_audit(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), comp, 100000)


@query("k25_usable_rows", "select doc_id, q, t, case when q is null and t is null then 'no q; no t' when q is null then 'no q' when t is null then 'no t' else '' end as dropped_for, q is not null and t is not null as usable from (select doc_id, quality as q, nullif(toxic, 1) as t from documents left join labels using (doc_id))")
def _(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("q"), F.nullif("toxic", F.lit(1)).alias("t"))
    return Q.usable_rows(table(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left"), ["q", "t"])


@query("k26_infer_scope", U + f""", t as (select * from unit_view where split = 'test'), s as (select model, count(*) as n, {sums_sql('obj_tp', 'obj_fp', 'obj_fn')} from t group by 1), f as (select model, n, {F1} as f1 from s),
 p as (select model, scope, count(*) - 1 as n_units, {sums_sql('obj_tp', 'obj_fp', 'obj_fn')} from (select model, 'all' as scope, obj_tp, obj_fp, obj_fn from unit_view union all select model, 'test', obj_tp, obj_fp, obj_fn from t) group by 1, 2), pf as (select model, scope, n_units, {F1} + 0.0001 as pub from p)
 select f.model, n, f1, scope, abs(f1 - pub) as f1_gap, abs(f1 - pub) > 0.002 as warn from f join pf using (model) qualify row_number() over (partition by f.model order by abs(f1 - pub), scope) = 1""")
def _(spark, sf):
    u = unit_view(spark, sf)
    both = u.withColumn("scope", F.lit("all")).unionByName(u.where("split = 'test'").withColumn("scope", F.lit("test")))
    pub = R.pooled_metrics(both, ["model", "scope"]).select("model", "scope", (F.col("n_units") - 1).alias("n_units"), (F.col("obj_f1") + 0.0001).alias("pub_f1"))
    return Q.infer_scope(u.where("split = 'test'"), pub)


# ---- L ----------------------------------------------------------------------------------------


@query("l1_leave_one_group_out", U + ", a as (select * from unit_view where model = 'A') select uid, grp, split, gt_count, case when grp = 'Brand#7' then 'eval' else split end as role from a where grp = 'Brand#7' or split in ('train', 'val')")
def _(spark, sf):
    a = unit_view(spark, sf).where("model = 'A'").select("uid", "grp", "split", "gt_count")
    return L.leave_one_group_out(a, "Brand#7")


@query("l1_role_info", U + ", r as (select grp, gt_count, case when grp = 'Brand#7' then 'eval' else split end as role from unit_view where model = 'A' and (grp = 'Brand#7' or split in ('train', 'val'))) select role, count(*) as n_units, cast(sum(gt_count) as bigint) as gt_objects, count(distinct grp) as n_groups from r group by role")
def _(spark, sf):
    return L.role_info(L.leave_one_group_out(unit_view(spark, sf).where("model = 'A'"), "Brand#7"), "gt_count")


def quota_sql(n, src="pool", part=""):
    return f"""cnt as (select grp, count(*) as cnt from {src} group by grp), tot as (select cast(sum(cnt) as bigint) as t from cnt),
 q0 as (select grp, cnt, ({n} * cnt) // t as q, ({n} * cnt) % t as r from cnt, tot), quota as (select grp, cnt, q + case when row_number() over (order by r desc, grp) <= {n} - sum(q) over () then 1 else 0 end as quota from q0)"""


@query("l2_quotas", U + f", pool as (select * from unit_view where model = 'A' and split = 'train'), {quota_sql(97)} select grp, cnt, cast(quota as bigint) as quota from quota")
def _(spark, sf):
    c = unit_view(spark, sf).where("model = 'A' and split = 'train'").groupBy("grp").agg(F.count(F.lit(1)).alias("cnt"))
    return L.quotas(c, "grp", 97)


@query("l2_stratified_sample", U + f", pool as (select uid, grp from unit_view where model = 'A' and split = 'train'), {quota_sql(97)}, n as (select *, row_number() over (partition by grp order by md5('42:' || uid), uid) as rn from pool) select uid, n.grp from n join quota using (grp) where rn <= quota")
def _(spark, sf):
    p = unit_view(spark, sf).where("model = 'A' and split = 'train'").select("uid", "grp")
    return L.stratified_sample(p, 97, 42)


@query("l3_size_matched_control", U + """, a as (select uid, grp, split, gt_count from unit_view where model = 'A'), sz as (select split, count(*) as want from a where grp <> 'Brand#7' group by split), pool as (select * from a where split in ('train', 'val')),
 c as (select split, grp, count(*) as cnt from pool group by 1, 2), t as (select c.*, want, cast(sum(cnt) over (partition by c.split) as bigint) as t from c join sz using (split)), q0 as (select *, (want * cnt) // t as q, (want * cnt) % t as r from t),
 qt as (select split, grp, q + case when row_number() over (partition by split order by r desc, grp) <= want - sum(q) over (partition by split) then 1 else 0 end as quota from q0),
 n as (select *, row_number() over (partition by split, grp order by md5(case when split = 'train' then '42' else '43' end || ':' || uid), uid) as rn from pool)
 select uid, n.grp, n.split, gt_count, n.split as role from n join qt on n.grp = qt.grp and n.split = qt.split where rn <= quota union all select uid, grp, split, gt_count, 'eval' from a where grp = 'Brand#7' and split = 'test'""")
def _(spark, sf):
    a = unit_view(spark, sf).where("model = 'A'").select("uid", "grp", "split", "gt_count")
    return L.size_matched_control(a, "Brand#7", 42)


ROLES = "r as (select grp, gt_count, case when grp = 'Brand#7' then 'eval' else split end as role from unit_view where model = 'A' and (grp = 'Brand#7' or split in ('train', 'val')))"


@query("l4_composition_table", U + f", {ROLES} select role, grp, count(*) as n_units, cast(sum(gt_count) as bigint) as gt_objects from r group by 1, 2")
def _(spark, sf):
    return L.composition_table(L.leave_one_group_out(unit_view(spark, sf).where("model = 'A'"), "Brand#7"), "gt_count")


def runs_of(u):
    """Every group held out once, as one long table of (run, grp, role, rows); groups are few, units are not paired."""
    a = u.where("model = 'A'").groupBy("grp", "split").agg(F.count(F.lit(1)).alias("n"))
    held = a.agg(F.collect_set("grp").alias("runs")).scalar()
    x = a.withColumn("run", F.explode(held))
    role = F.when(F.col("grp") == F.col("run"), "eval").when(F.col("split").isin("train", "val"), F.col("split"))
    return x.withColumn("role", role).where("role is not null").groupBy("run", "grp", "role").agg(F.sum("n").alias("n_units"))


RUNS = U + """, a as (select grp, split, count(*) as n from unit_view where model = 'A' group by 1, 2), x as (select h.run, a.grp, case when a.grp = h.run then 'eval' when split in ('train', 'val') then split end as role, n from a cross join (select distinct grp as run from a) h),
 runs as (select run, grp, role, cast(sum(n) as bigint) as n_units from x where role is not null group by 1, 2, 3)"""


@query("l5_run_role", RUNS + " select run, run as held_group, 'left-out' as condition from (select distinct run from runs)")
def _(spark, sf):
    return L.run_role(runs_of(unit_view(spark, sf)))


SCOPED = U + f""", x as (select model, grp, arm, 'all' as scope, obj_tp, obj_fp, obj_fn from unit_view union all select model, grp, arm, 'test', obj_tp, obj_fp, obj_fn from unit_view where split = 'test'),
 p as (select model, grp, arm, scope, count(*) as n_units, cast(sum(obj_tp) as bigint) as tp, cast(sum(obj_fp) as bigint) as fp, cast(sum(obj_fn) as bigint) as fn from x group by 1, 2, 3, 4), sp as (select *, {ok('2 * tp', '(2 * tp + fp + fn)')} as object_f1 from p)"""


@query("l6_scoped_pool", SCOPED + " select * from sp")
def _(spark, sf):
    return L.scoped_pool(unit_view(spark, sf), ["model", "grp", "arm"])


@query("l7_novelty_cost", SCOPED + """ select a.model, a.grp, a.scope, a.n_units as in_n_units, a.object_f1 as in_object_f1, a.tp as in_tp, a.fp as in_fp, a.fn as in_fn, b.n_units as out_n_units, b.object_f1 as out_object_f1, b.tp as out_tp, b.fp as out_fp, b.fn as out_fn,
 cast(a.tp as double) / nullif(a.tp + a.fp, 0) as in_precision, cast(a.tp as double) / nullif(a.tp + a.fn, 0) as in_recall, cast(b.tp as double) / nullif(b.tp + b.fp, 0) as out_precision, cast(b.tp as double) / nullif(b.tp + b.fn, 0) as out_recall,
 a.object_f1 - b.object_f1 as cost, round(a.object_f1, 3) - round(b.object_f1, 3) as cost_displayed from sp a join sp b on a.model = b.model and a.grp = b.grp and a.scope = b.scope and a.arm = 'treated' and b.arm = 'control'""")
def _(spark, sf):
    p = L.scoped_pool(unit_view(spark, sf), ["model", "grp", "arm"]).withColumn("condition", F.when(F.col("arm") == "treated", "in-distribution").otherwise("left-out"))
    return L.novelty_cost(p, ["model", "grp", "scope"])


@query("l8_restrict_to_shared", "select doc_id, 'a' as run from documents where lang = 'en' and doc_id in (select doc_id from labels) union all select doc_id, 'b' from labels where doc_id in (select doc_id from documents where lang = 'en')")
def _(spark, sf):
    a, b = L.restrict_to_shared(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])
    return a.withColumn("run", F.lit("a")).unionByName(b.withColumn("run", F.lit("b")))


def side(arm):
    return f"(select grp, model, count(*) as n_units, {sums_sql('obj_tp', 'obj_fp', 'obj_fn')}, avg(abs({E})) as count_mae from unit_view where arm = '{arm}' group by 1, 2)"


@query("l9_run_summary", U + f""", h as (select *, {F1} as obj_f1 from {side('treated')}), rf as (select grp, model, {F1} as rf1, count_mae as rmae from {side('control')} where grp <> 'Brand#4'), e as (select grp, count(distinct uid) + case when grp = 'Brand#9' then 1 else 0 end as n_expected from unit_view where arm = 'treated' group by grp)
 select h.grp, h.model, h.n_units, case when h.n_units is distinct from n_expected then 'unexpected unit count' when rf1 is null then 'no reference scoring' end as problem, case when h.n_units = n_expected then obj_f1 end as obj_f1_held_out, case when h.n_units = n_expected then rf1 end as obj_f1_reference,
 case when h.n_units = n_expected then round(rf1 - obj_f1, 4) end as obj_f1_gap, case when h.n_units = n_expected then round(count_mae - rmae, 2) end as count_mae_gap from h left join e using (grp) left join rf on h.grp = rf.grp and h.model = rf.model""")
def _(spark, sf):
    u = unit_view(spark, sf)

    def summary(d):
        x = R.pooled_metrics(d, ["grp", "model"]).select("grp", "model", "n_units", "obj_f1")
        m = d.groupBy("grp", "model").agg(F.avg(F.abs(F.col("pred_count") - F.col("gt_count"))).alias("count_mae"))
        return x.join(m, ["grp", "model"])

    exp = u.where("arm = 'treated'").groupBy("grp").agg((F.countDistinct("uid") + F.when(F.col("grp") == "Brand#9", 1).otherwise(0)).alias("n_expected"))
    return L.run_summary(summary(u.where("arm = 'treated'")), summary(u.where("arm = 'control' and grp <> 'Brand#4'")), exp, ["grp", "model"])


@query("l10_composition_from_runs", RUNS + " select grp, max(n_units) filter (where role = 'eval') as total, max(n_units) filter (where role = 'train') as train, max(n_units) filter (where role = 'val') as val, max(n_units) filter (where role = 'eval') - max(n_units) filter (where role = 'train') - max(n_units) filter (where role = 'val') as test from runs group by grp")
def _(spark, sf):
    return L.composition_from_runs(runs_of(unit_view(spark, sf)))


@query("l11_best_epoch", """with h as (select l_suppkey as run, l_linenumber as epoch, avg(l_extendedprice) as val_loss, avg(l_quantity) as train_loss from lineitem group by 1, 2), b as (select run, epoch from h qualify row_number() over (partition by run order by val_loss, epoch) = 1)
 select h.run, h.epoch, b.epoch is not null as is_best, series, value from h left join b on h.run = b.run and h.epoch = b.epoch cross join lateral (values ('val_loss', val_loss), ('train_loss', train_loss)) v(series, value)""")
def _(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.avg("l_extendedprice").alias("val_loss"), F.avg("l_quantity").alias("train_loss"))
    return L.best_epoch(h, ["run"], ["val_loss", "train_loss"])


@query("l12_capped_sample", U + " select uid from unit_view where model = 'A' and split = 'train' qualify row_number() over (order by md5('7:' || uid), uid) <= 200")
def _(spark, sf):
    return L.capped_sample(unit_view(spark, sf).where("model = 'A' and split = 'train'").select("uid"), 200, 7)
