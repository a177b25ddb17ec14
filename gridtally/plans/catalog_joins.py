"""Queries for equi, matching and wide joins (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtally.functions import keys as K
from gridtally.operators import joins as D
from gridtally.operators import rollups as R
from gridtally.plans.catalog_keys import BASE, CANON_SQL, N, group_sql, norm_sql, q, tok_sql
from gridtally.plans.catalog_rollups import U, ok, pooled_sql, sums_sql
from gridtally.plans.registry import query
from gridtally.sources.views import MODELS, name_view, table, unit_view, with_views


@query("d1_join_one_to_one", "select d.doc_id, lang, quality, toxic from documents d left join labels l using (doc_id)")
def _(spark, sf):
    return D.join_one_to_one(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


def doc_meta(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("unique_id"), F.col("lang").alias("cell_line"),
        F.when(i % 20 < 14, " Train").when(i % 20 < 17, "VAL ").otherwise("test").alias("split"),
        F.when(i % 7 != 0, F.concat(F.lit("img/"), i.cast("string"))).alias("rgb"), F.when(i % 5 == 0, " ").otherwise(F.col("source")).alias("roi"),
    )


def doc_counts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("unique_id"), F.col("n_chars").alias("gt_count"), (F.col("n_chars") + 1).alias("point_count"))


DOC_META = """with meta as (select doc_id as unique_id, lang as cell_line, case when doc_id % 20 < 14 then 'train' when doc_id % 20 < 17 then 'val' else 'test' end as split,
 case when doc_id % 7 <> 0 then 'img/' || doc_id end as rgb, case when doc_id % 5 = 0 then ' ' else source end as roi from documents)"""


@query("d2_build_master", DOC_META + """, f as (select doc_id as unique_id, quality = 1 as tr, quality = 0 as va, toxic = 1 as te from labels)
 select m.unique_id, cell_line, split, n_chars as gt_count, n_chars + 1 as point_count, rgb, roi, coalesce(tr, false) as in_train_ids, coalesce(va, false) as in_val_ids, coalesce(te, false) as in_test_ids,
 coalesce(tr, false)::int + coalesce(va, false)::int + coalesce(te, false)::int as n_split_flags, case when tr then 'train' when va then 'val' when te then 'test' else 'missing' end as split_from_id_csv,
 split = case when tr then 'train' when va then 'val' when te then 'test' else 'missing' end as split_consistent, rgb is not null and trim(rgb) <> '' as has_rgb, roi is not null and trim(roi) <> '' as has_roi
 from meta m join documents d on m.unique_id = d.doc_id left join f on f.unique_id = m.unique_id""")
def _(spark, sf):
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "unique_id")
    splits = {"train": lab.where("quality = 1"), "val": lab.where("quality = 0"), "test": lab.where("toxic = 1")}
    return D.build_master(doc_meta(spark, sf), doc_counts(spark, sf), splits, ["rgb", "roi"])


@query("d3_attach_authoritative_counts", """with m as (select doc_id as unique_id, case when doc_id % 4 = 0 then null else lang end as split from documents), l as (select doc_id as unique_id, case quality when 1 then 'train' else 'en' end as s from labels)
 select m.unique_id, coalesce(split, s) as split, n_chars as gt_count, split is not null and s is not null and split <> s as split_mismatch from m join documents d on m.unique_id = d.doc_id left join l using (unique_id)""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    m = d.select(F.col("doc_id").alias("unique_id"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("split"), F.lit(0).alias("gt_count"))
    lists = table(spark, sf, "labels").select(F.col("doc_id").alias("unique_id"), F.when(F.col("quality") == 1, "train").otherwise("en").alias("split"))
    return D.attach_authoritative_counts(m, doc_counts(spark, sf).drop("point_count"), lists, ["gt_count"])


@query("d4_lookup_join", "select d.doc_id, source, quality, toxic from documents d left join labels using (doc_id)")
def _(spark, sf):
    return D.lookup_join(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@query("d4_unmapped", "select doc_id, count(*) as n from documents where doc_id not in (select doc_id from labels) group by 1")
def _(spark, sf):
    return D.unmapped(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


UIDS = N + """, ids as (select p_partkey, case p_partkey % 4 when 0 then upper(left(name, length(name) - 4)) when 1 then regexp_replace(name, '_B.*$', '') when 2 then 'none_' || p_partkey else name end as uid from name_view), files as (select 'dir/' || name as path, name from name_view)"""


def stem_ids(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("name")
    uid = F.when(k == 0, F.upper(F.substring(n, F.lit(1), F.length(n) - 4))).when(k == 1, F.regexp_replace(n, "_B.*$", "")).when(k == 2, F.concat(F.lit("none_"), F.col("p_partkey").cast("string"))).otherwise(n)
    return name_view(spark, sf).select("p_partkey", uid.alias("uid"))


def name_files(spark, sf):
    return name_view(spark, sf).select(F.concat(F.lit("dir/"), "name").alias("path"))


STEM_TRIES = ["_B_DAPI", "_B_gt", "_B"]


@query("d5_match_by_stem", UIDS + f""", s as (select lower({BASE}) as k, min(path) as matched from files group by 1),
 t as (select distinct uid, i as tier, lower(uid || sfx) as k from ids cross join (values (0, ''), (1, '_B_DAPI'), (2, '_B_gt'), (3, '_B')) as v(i, sfx)),
 m as (select uid, tier, matched from t join s using (k) qualify row_number() over (partition by uid order by tier) = 1)
 select p_partkey, ids.uid, tier, matched from ids left join m using (uid)""")
def _(spark, sf):
    return D.match_by_stem(stem_ids(spark, sf), name_files(spark, sf), STEM_TRIES)


CK_IDS = N + f""", ids as (select p_partkey, case p_partkey % 4 when 0 then {BASE} when 1 then {BASE} || '_a' when 2 then lower(regexp_replace(name, '__.*$', '')) else 'none_' || p_partkey end as uid from name_view)"""


def ck_ids(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("name")
    b = K.drop_extension(n)
    uid = F.when(k == 0, b).when(k == 1, F.concat(b, F.lit("_a"))).when(k == 2, F.lower(F.regexp_replace(n, "__.*$", ""))).otherwise(F.concat(F.lit("none_"), F.col("p_partkey").cast("string")))
    return name_view(spark, sf).select("p_partkey", uid.alias("uid"))


@query("d6_match_by_canonical_key", CK_IDS + f""", ix as (select {CANON_SQL(BASE)} as k, min('dir/' || name) as matched from name_view group by 1), u as (select distinct uid, {CANON_SQL('uid')} as ck from ids),
 t as (select uid, 1 as tier, k, matched from u join ix on ck = k union all select uid, 2, k, matched from u join ix on regexp_matches(ck, '_[abfs]$') and left(ck, length(ck) - 2) = k
  union all select uid, 3, k, matched from u join ix on starts_with(k, lower(uid)) union all select uid, 4, uid || '_LE', 'dir/' || name from u join name_view on {BASE} = uid || '_LE'),
 m as (select * from t qualify row_number() over (partition by uid order by tier, k, matched) = 1) select p_partkey, ids.uid, tier, matched from ids left join m using (uid)""")
def _(spark, sf):
    return D.match_by_canonical_key(ck_ids(spark, sf), name_files(spark, sf))


TOK_FEAT = lambda src: f"select x, n, list_sort(list_distinct({tok_sql('n')})) as toks, list_filter(list_reverse({tok_sql('n')})[1:3], lambda t: t in ('a', 'b'))[1] as side, list_filter({tok_sql('n')}, lambda t: regexp_full_match(t, '[0-9]+'))[-1] as num from (select distinct x, {norm_sql('x')} as n from {src})"


@query("d7_match_by_tokens", N + f""", ids as (select p_partkey, case p_partkey % 3 when 0 then name when 1 then p_partkey || '_' || regexp_replace(name, '__[0-9]+', '') else 'zz ' || name end as uid from name_view),
 src as (select uid as x from ids), fls as (select 'dir/' || name as x from name_view), a as ({TOK_FEAT('src')}), b as ({TOK_FEAT('fls')}),
 c as (select a.x as u, b.x as p, case when a.n = b.n then 2.0 else len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) - 0.01 * abs(length(a.n) - length(b.n)) end as score
  from a join b on a.n = b.n or (a.num is not distinct from coalesce(b.num, a.num) and (a.num is null or b.num is not null) and (a.side is null or a.side = b.side) and len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.95)),
 m as (select u, p, score from c qualify row_number() over (partition by u order by score desc, p) = 1)
 select p_partkey, uid, p as matched, score from ids left join m on uid = u""")
def _(spark, sf):
    k, n = F.col("p_partkey") % 3, F.col("name")
    uid = F.when(k == 0, n).when(k == 1, F.concat_ws("_", F.col("p_partkey").cast("string"), F.regexp_replace(n, "__[0-9]+", ""))).otherwise(F.concat(F.lit("zz "), n))
    return D.match_by_tokens(name_view(spark, sf).select("p_partkey", uid.alias("uid")), name_files(spark, sf))


@query("d8_match_unique_contained", N + f""", ids as (select p_partkey, case p_partkey % 3 when 0 then {BASE} when 1 then '__' || p_partkey else 'none' || p_partkey end as uid from name_view), s as (select {BASE} as k, count(*) as nf from name_view group by 1),
 e as (select uid, case when nf = 1 then k end as matched, case when nf = 1 then 'exact' else 'ambiguous-exact' end as status from (select distinct uid from ids) join s on uid = k),
 c as (select uid, count(*) as c, min(k) as k, min(nf) as nf from (select distinct uid from ids where uid not in (select uid from e)) join s on contains(k, uid) group by uid),
 g as (select * from e union all select uid, case when c = 1 and nf = 1 then k end, case when c = 1 and nf = 1 then 'contained' else 'ambiguous' end from c)
 select p_partkey, uid, matched, coalesce(status, 'missing') as status from ids left join g using (uid)""")
def _(spark, sf):
    k, b = F.col("p_partkey") % 3, K.drop_extension(F.col("name"))
    pk = F.col("p_partkey").cast("string")
    ids = name_view(spark, sf).select("p_partkey", F.when(k == 0, b).when(k == 1, F.concat(F.lit("__"), pk)).otherwise(F.concat(F.lit("none"), pk)).alias("uid"))
    return D.match_unique_contained(ids, name_view(spark, sf).select(b.alias("stem")))


@query("d9_resolve_unit_files", N + f""", ids as (select p_partkey, regexp_replace(lower(name), '(_a|_b)?(_dapi|_merge|-merge| \\(rgb\\)|_gt|_mask|_bad)?[^_]*$', '') as uid from name_view), s as (select lower({BASE}) as k, 'dir/' || name as path from name_view),
 r as (select uid, min(path) filter (where tier = 0) as a, min(path) filter (where tier = 1) as b from (select distinct uid from ids) cross join (values (0, ''), (1, '_b')) v(tier, sfx) join s on k = uid || sfx group by uid),
 d as (select uid, min(path) filter (where tier = 0) as a, min(path) filter (where tier = 1) as b from (select distinct uid from ids) cross join (values (0, '_dapi'), (1, '_b_dapi')) v(tier, sfx) join s on k = uid || sfx group by uid)
 select p_partkey, uid, coalesce(r.a, r.b) as rgb_path, coalesce(d.a, d.b) as dapi_path, {group_sql('uid')} as grp from ids left join r using (uid) left join d using (uid)""")
def _(spark, sf):
    uid = F.regexp_replace(F.lower("name"), r"(_a|_b)?(_dapi|_merge|-merge| \(rgb\)|_gt|_mask|_bad)?[^_]*$", "")
    ids = name_view(spark, sf).select("p_partkey", uid.alias("uid"))
    files = name_files(spark, sf)
    return D.resolve_unit_files(ids, {"rgb": (files, ["_b"]), "dapi": (files, ["_dapi", "_b_dapi"])})


@query("d13_paired_wide", U + " select uid, any_value(pred_count) filter (where model = 'A') as v_A, any_value(pred_count) filter (where model = 'N') as v_N, any_value(pred_count) filter (where model = 'R') as v_R, any_value(pred_count) filter (where model = 'N') - any_value(pred_count) filter (where model = 'A') as delta from unit_view group by uid")
def _(spark, sf):
    return D.paired_wide(unit_view(spark, sf), "uid", "model", "pred_count", MODELS)


@query("d14_paired_runs", U + f""", f as (select uid, model, gt_count, pred_count, {ok('2 * obj_tp', '(2 * obj_tp + obj_fp + obj_fn)')} as f1 from unit_view)
 select a.uid, a.f1 as f1_a, a.pred_count as pred_count_a, a.gt_count as gt_count_a, b.f1 as f1_b, b.pred_count as pred_count_b, b.gt_count as gt_count_b, b.f1 - a.f1 as d_f1, b.pred_count - a.pred_count as d_pred_count, b.gt_count - a.gt_count as d_gt_count from f a join f b on a.uid = b.uid and a.model = 'A' and b.model = 'R'""")
def _(spark, sf):
    from gridtally.functions.metrics import f1

    f = unit_view(spark, sf).select("uid", "model", f1(F.col("obj_tp"), F.col("obj_fp"), F.col("obj_fn")).alias("f1"), "pred_count", "gt_count")
    return D.paired_runs(f.where("model = 'A'").drop("model"), f.where("model = 'R'").drop("model"), ["uid"], deltas=["f1", "pred_count", "gt_count"])


@query("d15_outer_compare", U + f""", a as (select grp, split, {sums_sql('obj_tp', 'obj_fp')} from unit_view where model = 'A' group by 1, 2), b as (select grp, split, {sums_sql('obj_tp', 'obj_fp')} from unit_view where model = 'A' and arm = 'treated' group by 1, 2),
 j as (select abs(cast(a.obj_tp as double) - b.obj_tp) as dt, abs(cast(a.obj_fp as double) - b.obj_fp) as df, a.grp is null or b.grp is null as one from a full join b on a.grp = b.grp and a.split = b.split),
 s as (select count(*) filter (where one) as o, max(dt) as mt, count(*) filter (where dt is null) as nt, max(df) as mf, count(*) filter (where df is null) as nf from j)
 select "column", max_abs_delta, n_missing, n_one_sided, coalesce(max_abs_delta <= 200 and n_missing = 0, false) as ok from s cross join lateral (values ('obj_tp', mt, nt, o), ('obj_fp', mf, nf, o)) as v("column", max_abs_delta, n_missing, n_one_sided)""")
def _(spark, sf):
    u = unit_view(spark, sf).where("model = 'A'")
    agg = lambda d: d.groupBy("grp", "split").agg(F.sum("obj_tp").alias("obj_tp"), F.sum("obj_fp").alias("obj_fp"))
    return D.outer_compare(agg(u), agg(u.where("arm = 'treated'")), ["grp", "split"], ["obj_tp", "obj_fp"], 200.0)


@query("d16_cross_grid", U + ", u as (select distinct uid from unit_view) select uid, d_max, min_iou, policy from u cross join (values (5.0::double), (10.0), (20.0)) a(d_max) cross join (values (0.0::double), (0.1)) b(min_iou) cross join (values ('OR'), ('AND')) c(policy)")
def _(spark, sf):
    u = unit_view(spark, sf).select("uid").distinct()
    return D.cross_grid(u, d_max=[5.0, 10.0, 20.0], min_iou=[0.0, 0.1], policy=["OR", "AND"])


@query("d17_grid_permutations", """with recursive o as (select p_type as op, row_number() over (order by p_type) as ord from (select distinct p_type from part)),
 c as (select 1 as k, [op] as combo from o union all select k + 1, list_append(combo, op) from c join o on not list_contains(combo, op) where k < 3)
 select k, combo, array_to_string(combo, '__') as combo_id from c where k >= 2""")
def _(spark, sf):
    from pyspark.sql import Window as W

    ops = table(spark, sf, "part").select(F.col("p_type").alias("op")).distinct().withColumn("ord", F.row_number().over(W.orderBy("op")))
    return D.grid_permutations(ops, 2, 3)
