"""Queries for readers, writers and end-to-end pipelines (A, B21, K1, K7, K14, F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtally.functions import keys as K
from gridtally.operators import quality as Q
from gridtally.operators import rollups as R
from gridtally.plans import evaluate as EV
from gridtally.plans.catalog_keys import U
from gridtally.plans.catalog_rollups import AGG, BIN, E, PIX_SQL, ok
from gridtally.plans.catalog_spatial import CC, CONF, DIST, images, match_sql
from gridtally.plans.registry import query
from gridtally.session import scratch_path
from gridtally.sources import tables as A
from gridtally.sources.views import object_pixel_view, page_files, pixel_view, table, unit_view, with_views
from gridtally.streaming.resume import skip_completed


@query("a1_read_table", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "a1")
    A.write_table(df, path, "csv")
    return A.read_table(spark, path, df.schema)


@query("a2_read_text_table", "select cast(doc_id as varchar) as doc_id, case when doc_id % 3 = 0 then '' else lang end as lang, case when doc_id % 4 = 0 then '007' else ' x ' end as code from documents")
def _(spark, sf):
    i = F.col("doc_id")
    df = table(spark, sf, "documents").select("doc_id", F.when(i % 3 == 0, "").otherwise(F.col("lang")).alias("lang"), F.when(i % 4 == 0, "007").otherwise(" x ").alias("code"))
    path = scratch_path(spark, "a2")
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return A.read_text_table(spark, path)


@query("a3_read_id_list", "select distinct trim(lang || '_' || source) as unique_id from documents")
def _(spark, sf):
    path = scratch_path(spark, "a3")
    df = table(spark, sf, "documents").select(F.concat(F.lit("  "), F.concat_ws("_", "lang", "source"), F.lit(" ")).alias("id"), "doc_id")
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return A.read_id_list(spark, path, "id", clean=True)


KEYED = with_views("page_files") + r""", k as (select path, regexp_replace(path, '^.*/', '') as name from page_files), kk as (select lower(regexp_replace(name, '^(.*[^./][^/]*)\.[^./]*$', '\1')) as key, path from k where not starts_with(name, '.') and '.' || lower(regexp_extract(name, '[^.].*\.([^.]*)$', 1)) in ('.', '.html'))"""


@query("a4_index_files", KEYED + " select key, min(path) as path from kk group by key")
def _(spark, sf):
    return A.index_files(page_files(spark, sf), [".", ".html"])


@query("a5_duplicate_keys", KEYED + ", m as (select key, count(*) as n_files from kk group by key having count(*) > 1) select key, path, n_files from kk join m using (key)")
def _(spark, sf):
    return A.duplicate_keys(page_files(spark, sf), [".", ".html"])


@query("a6_count_point_rows", "select event_type, count(*) as n_points from events group by 1")
def _(spark, sf):
    path = scratch_path(spark, "a6")
    table(spark, sf, "events").select("event_type", "event_id", "value").write.option("header", True).partitionBy("event_type").csv(path)
    n = A.count_point_rows(spark, path)
    return n.groupBy(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("event_type")).agg(F.sum("n_points").alias("n_points"))


@query("a6_count_point_lines", "select lang, cast(sum(len(list_filter(regexp_split_to_array(text, '\\n'), lambda t: trim(t, E' \\t\\r') <> ''))) as bigint) as n_points from documents group by 1")
def _(spark, sf):
    path = scratch_path(spark, "a6t")
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("value"))
    lines.withColumn("value", F.regexp_replace("value", "[\r\t]", " ")).write.partitionBy("lang").text(path)
    n = A.count_point_lines(spark, path)
    return n.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).agg(F.sum("n_points").alias("n_points"))


@query("a6_count_point_documents", "select doc_id, case when doc_id % 4 in (0, 1) then len(string_split(text, ' ')) end as n_points from documents")
def _(spark, sf):
    i = F.col("doc_id")
    words = F.split("text", " ")
    content = F.when(i % 4 == 0, F.to_json(words)).when(i % 4 == 1, F.to_json(F.struct(words.alias("points")))).when(i % 4 == 2, F.to_json(F.struct(words.alias("other")))).otherwise("not json")
    return A.count_point_documents(table(spark, sf, "documents").select("doc_id", content.alias("content"))).select("doc_id", "n_points")


@query("a7_write_table", "select s_suppkey, s_name, s_acctbal from supplier")
def _(spark, sf):
    path = scratch_path(spark, "a7") + ".parquet"
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    A.write_table(df, path)
    return A.read_table(spark, path)


@query("a8_write_tsv", "select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment from customer")
def _(spark, sf):
    path = scratch_path(spark, "a8")
    A.write_tsv(table(spark, sf, "customer"), path, ["c_custkey", "c_name", "c_mktsegment"])
    return A.read_text_table(spark, path, sep="\t")


@query("a9_write_frozen_results", AGG + " select model, scope_value, n_units, obj_tp, obj_f1 from agg where scope = 'by_split'")
def _(spark, sf):
    paths = A.write_frozen_results(R.aggregate_benchmark(unit_view(spark, sf)), scratch_path(spark, "a9"), "or")
    return A.read_table(spark, paths["summary_by_split"]).select("model", "scope_value", F.col("n_units").cast("bigint").alias("n_units"), F.col("obj_tp").cast("bigint").alias("obj_tp"), "obj_f1")


@query("a10_read_param_payloads", """select p_brand as grp, p_type || '_' || p_size as combo_id, max(p_partkey) as best from part where p_partkey % 2 = 0 group by 1, 2
 union all select 'file_' || p_size, p_type || '_' || p_size, max(p_partkey) from part where p_partkey % 2 = 1 group by 1, 2""")
def _(spark, sf):
    """Payload documents in both layouts, one per part; later file names win."""
    p = table(spark, sf, "part")
    payload = F.struct(F.array("p_type").alias("combo"), F.struct(F.lit(1).alias("t")).alias("best_theta"), F.col("p_partkey").alias("best"))
    combo = F.concat_ws("_", "p_type", F.col("p_size").cast("string"))
    block = F.create_map(combo, payload)
    seq = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    nested = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("/params/"), seq, F.lit("/all.json")).alias("path"), F.to_json(F.create_map(F.col("p_brand"), block)).alias("content"))
    flat = p.where("p_partkey % 2 = 1").select(F.concat(F.lit("/params/"), seq, F.lit("/file_"), F.col("p_size").cast("string"), F.lit(".json")).alias("path"), F.to_json(block).alias("content"))
    got = A.merge_param_payloads(nested.unionByName(flat))
    return got.select("grp", "combo_id", F.get_json_object("payload", "$.best").cast("bigint").alias("best"))


@query("a11_read_runs", U + " select model as run, uid, obj_tp, model <> 'R' as preferred from unit_view")
def _(spark, sf):
    root = scratch_path(spark, "a11")
    u = unit_view(spark, sf).select("uid", "obj_tp", F.col("model").alias("run"))
    both = u.where("run <> 'R'").withColumn("policy", F.lit("or")).unionByName(u.withColumn("policy", F.lit("and")).withColumn("obj_tp", F.when(F.col("run") == "R", F.col("obj_tp")).otherwise(-1)))
    both.write.option("header", True).partitionBy("run", "policy").csv(root)
    return A.read_runs(spark, root, "or", "uid string, obj_tp bigint").select("run", "uid", "obj_tp", "preferred")


@query("a12_skip_completed", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def _(spark, sf):
    return skip_completed(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query("b21_format_from_magic", """with x as (select doc_id, case doc_id % 6 when 0 then 'PNG' when 1 then 'TEXT' when 2 then 'PDF' when 3 then 'EMPTY' when 4 then 'UNKNOWN' else 'ZIP' end as format, (['png', 'csv', 'npz', 'xyz'])[doc_id % 4 + 1] as ext from documents)
 select doc_id, format, ext, case ext when 'png' then case when format = 'PNG' then 'yes' else 'NO' end when 'csv' then case when format = 'TEXT' then 'yes' else 'NO' end when 'npz' then case when format = 'ZIP' then 'yes' else 'NO' end else '' end as format_ok from x""")
def _(spark, sf):
    i = F.col("doc_id")
    body = F.encode(F.lit("plain words "), "utf-8")
    head = (
        F.when(i % 6 == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), body)).when(i % 6 == 1, F.concat(body, F.encode("lang", "utf-8")))
        .when(i % 6 == 2, F.encode(F.concat(F.lit("%PDF-1.4 "), "lang"), "utf-8")).when(i % 6 == 3, F.encode(F.lit(""), "utf-8"))
        .when(i % 6 == 4, F.concat(F.unhex(F.lit("0001FF")), body)).otherwise(F.concat(F.unhex(F.lit("504B0304")), body))
    )
    ext = F.element_at(F.array(*[F.lit(e) for e in ["png", "csv", "npz", "xyz"]]), (i % 4 + 1).cast("int"))
    x = table(spark, sf, "documents").select("doc_id", K.format_from_magic(head).alias("format"), ext.alias("ext"))
    return x.withColumn("format_ok", K.format_ok(F.col("ext"), F.col("format")))


@query("k1_require_columns", "select doc_id, lang from documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return Q.require_columns(d, ["doc_id", "lang"]).select("doc_id", Q.find_column(d, ["language", "LANG"]))


@query("k2_assert_unique", "select o_orderkey from orders")
def _(spark, sf):
    return Q.assert_unique(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("k14_build_manifest")
def _(spark, sf):
    return A.build_manifest(spark, sf, [".parquet"])


@query("k7_harmonise", CC + " select uid, layer as model, cast(sum(x1 - x0 + 1) as bigint) as fg from lr join (select uid, layer, obj_id as comp from obj where area >= 14) using (uid, layer, comp) group by 1, 2")
def _(spark, sf):
    raw = pixel_view(spark, sf).select("uid", F.col("layer").alias("model"), "y", "x", F.when(F.col("layer") == "gt", 200).otherwise(0).alias("value"), F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(9)).alias("values"))
    px, _ = EV.harmonise(raw, images(spark, sf), {"gt": "binary", "pred": "multi_class"}, 14)
    return px.groupBy("uid", "model").agg(F.count(F.lit(1)).alias("fg"))


def scored_units(spark, sf):
    u = images(spark, sf)
    s = F.when(F.col("uid") % 20 < 14, "train").when(F.col("uid") % 20 < 17, "val").otherwise("test")
    return u.withColumn("split", s).withColumn("grp", F.concat(F.lit("g"), (F.col("uid") % 5).cast("string")))


# Pairs of labelled objects in SQL: the pixels of each component, its centroid distance, box hits and overlap.
LABELLED = CC + f""", {CONF}, ob as (select * from obj where area >= 3), ol as (select lr.uid, lr.layer, lr.comp as obj_id, lr.y, unnest(range(lr.x0, lr.x1 + 1)) as x from lr join ob on lr.uid = ob.uid and lr.layer = ob.layer and lr.comp = ob.obj_id),
 p as (select * from ob where layer = 'pred'), g as (select * from ob where layer = 'gt'), og as (select * from ol where layer = 'gt'),
 near as (select p.uid, p.obj_id as pred_id, g.obj_id as gt_id, {DIST} as dist from p join g on p.uid = g.uid where {DIST} <= 20),
 inbox as (select p.uid, p.obj_id as pred_id, og.obj_id as gt_id, count(*) as px from p join og on p.uid = og.uid and og.y >= p.y1 and og.y < p.y2 and og.x >= p.x1 and og.x < p.x2 group by 1, 2, 3),
 shared as (select a.uid, a.obj_id as pred_id, og.obj_id as gt_id, count(*) as inter from ol a join og on a.uid = og.uid and a.y = og.y and a.x = og.x where a.layer = 'pred' group by 1, 2, 3),
 ks as (select uid, pred_id, gt_id from near union select uid, pred_id, gt_id from inbox),
 pa as (select ks.*, dist, case when inter > 0 then cast(inter as double) / (p.area + coalesce(px, 0) - inter) else 0.0 end as overlap, coalesce(px, 0) > 0 as hit
  from ks left join near using (uid, pred_id, gt_id) left join inbox using (uid, pred_id, gt_id) left join shared using (uid, pred_id, gt_id) join p on p.uid = ks.uid and p.obj_id = ks.pred_id),
 un as (select uid, 256 as h, 256 as w, case when uid % 20 < 14 then 'train' when uid % 20 < 17 then 'val' else 'test' end as split, 'g' || (uid % 5) as grp from im)"""


def gates_sql(points: list[tuple[float, float, str]]) -> str:
    """CTEs ending in tl: counts of every unit at every grid point, from pairs valid there and the largest matching."""
    grid = ", ".join(f"({i}, {d}::double, {o}::double, '{p}')" for i, (d, o, p) in enumerate(points))
    return f"""gp(pt, d_max, min_iou, policy) as (values {grid}),
 pg as (select uid * 64 + pt as u, uid, pt, pred_id, gt_id, dist from pa cross join gp where case when policy = 'OR' then coalesce(dist <= d_max, false) or (hit and overlap >= min_iou) else coalesce(dist <= d_max, false) and hit and overlap >= min_iou end),
 {match_sql('pg', 'u', '0.0')}, tp as (select u, count(*) as tp from mt group by u),
 cd as (select u, count(*) as cand_pairs, count(distinct pred_id) as cand_preds, count(distinct gt_id) as cand_gts from pg group by u),
 np as (select uid, count(*) as n_pred from p group by uid), ng as (select uid, count(*) as n_gt from g group by uid),
 tl as (select un.*, d_max, min_iou, policy, coalesce(tp, 0) as tp, coalesce(cand_preds, 0) - coalesce(tp, 0) as ignored, coalesce(n_pred, 0) - coalesce(cand_preds, 0) as fp, coalesce(n_gt, 0) - coalesce(tp, 0) as fn, coalesce(n_pred, 0) as n_pred, coalesce(n_gt, 0) as n_gt,
  coalesce(cand_pairs, 0) as cand_pairs, coalesce(cand_preds, 0) as cand_preds, coalesce(cand_gts, 0) as cand_gts from un cross join gp left join tp on tp.u = uid * 64 + pt left join cd on cd.u = uid * 64 + pt left join np using (uid) left join ng using (uid))"""


SCORED = LABELLED + f""", {gates_sql([(20.0, 0.1, "OR"), (20.0, 0.1, "AND")])}, px as (select uid, count(*) filter (where g and p) as a, count(*) filter (where p and not g) as b, count(*) filter (where g and not p) as c, max(cast(p as int)) as e from per group by uid),
 fa as (select uid, h, w, split, grp, 'm' as model, policy, tp as obj_tp, fp as obj_fp, fn as obj_fn, ignored as obj_ignored, n_pred as pred_count, n_gt as gt_count, cand_pairs, cand_preds, cand_gts,
  coalesce(a, 0) as pix_tp, coalesce(b, 0) as pix_fp, coalesce(c, 0) as pix_fn, 65536 - coalesce(a + b + c, 0) as pix_tn, coalesce(e, 0) as pred_exists from tl left join px using (uid))
 select *, cast(obj_tp as double) / (obj_tp + obj_fp + 1e-9) as obj_precision, cast(obj_tp as double) / (obj_tp + obj_fn + 1e-9) as obj_recall, {ok('2 * obj_tp', '(2 * obj_tp + obj_fp + obj_fn)')} as obj_f1,
 {PIX_SQL}, {BIN} as density_bin, cast(abs({E}) as double) as count_abs_error, case when gt_count <> 0 then 100.0 * abs({E}) / gt_count end as count_ape from fa"""


@query("f1_score_units", SCORED)
def _(spark, sf):
    px = object_pixel_view(spark, sf).withColumnRenamed("side", "layer")  # a pixel may repeat: words of pixels take it once
    pred = px.where("layer = 'pred'").select("uid", F.lit("m").alias("model"), "y", "x")
    return EV.score_units(scored_units(spark, sf), px.where("layer = 'gt'").select("uid", "y", "x"), pred, ["m"])


GRID = [(d, o, p) for d in (5.0, 10.0, 20.0) for o in (0.0, 0.1, 0.3) for p in ("OR", "AND")]


@query("f25_sweep", LABELLED + f""", {gates_sql(GRID)}, s as (select 'm' as model, split, policy, d_max, min_iou, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(ignored) as bigint) as ignored from tl group by 2, 3, 4, 5)
 select *, {ok('tp', '(tp + fp)')} as precision, {ok('tp', '(tp + fn)')} as recall, {ok('2 * tp', '(2 * tp + fp + fn)')} as f1 from s""")
def _(spark, sf):
    px = object_pixel_view(spark, sf).withColumnRenamed("side", "layer")  # a pixel may repeat: words of pixels take it once
    pred = px.where("layer = 'pred'").select("uid", F.lit("m").alias("model"), "y", "x")
    units = scored_units(spark, sf).select("uid", "split")
    return R.sweep_summary(EV.sweep(px.where("layer = 'gt'").select("uid", "y", "x"), pred, ["m"], [5.0, 10.0, 20.0], [0.0, 0.1, 0.3], units=units))
