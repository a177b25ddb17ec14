"""Queries for objects, geometry, matching, points and sweeps (D10-D12, E, F25-F27, F31, F32, K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtally.functions import metrics as M
from gridtally.operators import components as C
from gridtally.operators import matching as X
from gridtally.operators import points as P
from gridtally.operators import rollups as R
from gridtally.operators import spatial as SP
from gridtally.plans.registry import query
from gridtally.session import cut_lineage, ratio
from gridtally.sources.views import FRAME, VIEW_SQL, box_view, cell_view, obj_view, object_pixel_view, pixel_view, table, with_views

FR = (FRAME, FRAME)
B = with_views("box_view")
OP = with_views("box_view", "object_pixel_view")
PX = with_views("pixel_view")
CE = with_views("cell_view")
BP = "p as (select * from box_view where side = 'pred'), g as (select * from box_view where side = 'gt')"
DIST = "sqrt((p.cy - g.cy) * (p.cy - g.cy) + (p.cx - g.cx) * (p.cx - g.cx))"
AREA = "(least(p.y2, 256) - greatest(p.y1, 0)) * (least(p.x2, 256) - greatest(p.x1, 0))"


def boxes(spark, sf, side):
    return box_view(spark, sf).where(F.col("side") == side).withColumn("area", ((F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).cast("bigint"))


def object_runs(spark, sf, side):
    px = object_pixel_view(spark, sf).where(F.col("side") == side)
    r = C.runs_from_pixels(px.select("uid", "obj_id", "y", "x"), ["uid", "obj_id"])
    return r.withColumn("model", F.lit("m")) if side == "pred" else r


def pred_with_area(spark, sf):
    """Predictions whose area is the number of pixels of their own diamond."""
    n = object_pixel_view(spark, sf).where("side = 'pred'").groupBy("uid", "obj_id").agg(F.count(F.lit(1)).alias("area"))
    return boxes(spark, sf, "pred").drop("area").join(n, ["uid", "obj_id"])


@query("d10_candidate_pairs", B + f", {BP} select p.uid, p.obj_id as pred_id, g.obj_id as gt_id, {DIST} as dist from p join g on p.uid = g.uid where {DIST} <= 20")
def _(spark, sf):
    p = boxes(spark, sf, "pred").select("uid", F.col("obj_id").alias("pred_id"), "cy", "cx")
    g = boxes(spark, sf, "gt").select("uid", F.col("obj_id").alias("gt_id"), F.col("cy").alias("ry"), F.col("cx").alias("rx"))
    return SP.distance_pairs(p, g, ["uid"], 20.0).select("uid", "pred_id", "gt_id", "dist")


@query("d11_point_in_region", PX + """, o as (select uid, cy as y, cx as x from obj_view where side = 'gt' and cx + 1 <= 255), a as (select uid, y, x from pixel_view where layer = 'pred'), b as (select uid, y, x from pixel_view where layer = 'gt'),
 pt as (select uid, cy as y, least(cx + 1, 255) as x from obj_view where side = 'gt'), f as (select pt.uid, a.uid is not null as ia, b.uid is not null as ib from pt left join a on pt.uid = a.uid and pt.y = a.y and pt.x = a.x left join b on pt.uid = b.uid and pt.y = b.y and pt.x = b.x)
 select uid, count(*) as n_points, count(*) filter (where ia) as in_a, count(*) filter (where ib) as in_b, count(*) filter (where ia and ib) as in_both, count(*) filter (where ia and not ib) as only_a, count(*) filter (where not ia and ib) as only_b from f group by uid""")
def _(spark, sf):
    pts = obj_view(spark, sf).where("side = 'gt'").select("uid", F.col("cy").cast("double").alias("cy"), (F.col("cx") + 1.4).alias("cx"))
    px = pixel_view(spark, sf)
    return SP.point_in_region(pts, px.where("layer = 'pred'"), px.where("layer = 'gt'"), FR)


@query("d12_points_in_box", B + f", {BP} select p.uid, p.obj_id, g.obj_id as gt_id from p join g on p.uid = g.uid where g.cy between p.y1 and p.y2 and g.cx between p.x1 and p.x2")
def _(spark, sf):
    g = boxes(spark, sf, "gt").select("uid", F.col("obj_id").alias("gt_id"), F.col("cy").alias("ry"), F.col("cx").alias("rx"))
    return SP.points_in_box(boxes(spark, sf, "pred"), g, ["uid"]).select("uid", "obj_id", "gt_id")


@query("e1_binarise", """with v as (select event_id, user_id as uid, cast((event_id * 37) % 256 as double) as value from events), m as (select uid, max(value) as mx from v group by uid)
 select 'runner' as rule, event_id from v where value > 127.5 union all select 'raw', event_id from v where value > 200 union all select 'integer', event_id from v where value > 0
 union all select 'probability', event_id from v join m using (uid) where value / (case when mx > 1 then 255.0 else 1.0 end) >= 0.5 union all select 'channel', event_id from events where event_id % 256 > 0""")
def _(spark, sf):
    e = F.col("event_id")
    v = table(spark, sf, "events").select("event_id", F.col("user_id").alias("uid"), ((e * 37) % 256).cast("double").alias("value"), F.array(e % 256, (e * 7) % 256).alias("values"))
    pick = lambda rule, t, name=None, ch=None: P.binarise(v, rule, t, ch).select(F.lit(name or rule).alias("rule"), "event_id")
    return pick("runner", 0.5).unionByName(pick("raw", 200)).unionByName(pick("integer", 0)).unionByName(pick("probability", 0.5)).unionByName(pick("integer", 0, "channel", 0))


@query("e2_runs_from_pixels", PX + ", g as (select *, x - row_number() over (partition by uid, layer, y order by x) as k from pixel_view) select uid, layer, y, min(x) as x0, max(x) as x1 from g group by uid, layer, y, k")
def _(spark, sf):
    return C.runs_from_pixels(pixel_view(spark, sf), ["uid", "layer"])


# Components in SQL: reachable runs by recursion, the smallest start names the component.
CC = with_views("pixel_view", recursive=True) + """, k as (select *, x - row_number() over (partition by uid, layer, y order by x) as k from pixel_view),
 r as (select uid, layer, y, min(x) as x0, max(x) as x1, cast(y as bigint) * 2147483648 + min(x) as id from k group by uid, layer, y, k),
 e as (select a.uid, a.layer, a.id as a, b.id as b from r a join r b on a.uid = b.uid and a.layer = b.layer and abs(a.y - b.y) = 1 and b.x0 <= a.x1 + 1 and b.x1 >= a.x0 - 1),
 w as (select uid, layer, id as a, id as b from r union select w.uid, w.layer, w.a, e.b from w join e on w.uid = e.uid and w.layer = e.layer and w.b = e.a),
 lab as (select uid, layer, a as id, min(b) as comp from w group by 1, 2, 3), lr as (select r.*, lab.comp from r join lab using (uid, layer, id)),
 obj as (select uid, layer, comp as obj_id, cast(sum(x1 - x0 + 1) as bigint) as area, sum(y * (x1 - x0 + 1)) / sum(x1 - x0 + 1) as cy, sum((x0 + x1) * (x1 - x0 + 1) / 2.0) / sum(x1 - x0 + 1) as cx, min(y) as y1, min(x0) as x1, max(y) + 1 as y2, max(x1) + 1 as x2 from lr group by 1, 2, 3)"""


@query("e3_connected_components", CC + " select uid, layer, y, x0, x1, comp from lr")
def _(spark, sf):
    runs = C.runs_from_pixels(pixel_view(spark, sf), ["uid", "layer"])
    return C.label_runs(runs, ["uid", "layer"])


@query("e4_object_attributes", CC + " select * from obj where area >= 3")
def _(spark, sf):
    return C.connected_components(pixel_view(spark, sf), ["uid", "layer"])


@query("e4_component_points", CC + " select uid, layer, cx as x, cy as y from obj")
def _(spark, sf):
    return C.component_points(C.label_runs(C.runs_from_pixels(pixel_view(spark, sf), ["uid", "layer"]), ["uid", "layer"]), ["uid", "layer"])


@query("e19_area_filter", CC + " select uid, layer, obj_id, area from obj where area between 14 and 30")
def _(spark, sf):
    o = C.connected_components(pixel_view(spark, sf), ["uid", "layer"], min_area=0)
    return C.area_filter(o, 14, 30).select("uid", "layer", "obj_id", "area")


@query("f32_morphology_audit", CC + """, u as (select uid, count(*) as gt_count, count(*) + 2 as point_count from obj_view where side = 'gt' group by uid), n as (select uid, count(*) filter (where area >= 3) as n_components, min(area) as area_min, max(area) as area_max, avg(area) as area_mean from obj where layer = 'gt' group by uid)
 select u.*, coalesce(n_components, 0) as n_components, area_min, area_max, area_mean, coalesce(n_components, 0) = gt_count as matches_table, point_count - coalesce(n_components, 0) as delta_points from u left join n using (uid)""")
def _(spark, sf):
    o = C.connected_components(pixel_view(spark, sf).where("layer = 'gt'").drop("layer"), ["uid"], min_area=0)
    u = obj_view(spark, sf).where("side = 'gt'").groupBy("uid").agg(F.count(F.lit(1)).alias("gt_count"), (F.count(F.lit(1)) + 2).alias("point_count"))
    return R.morphology_audit(o, u)


# Pair geometry in SQL: pixels of each object, boxes clipped to the frame.
GEO = OP + f""", {BP}, op as (select uid, obj_id, y, x from object_pixel_view where side = 'pred'), og as (select uid, obj_id, y, x from object_pixel_view where side = 'gt'),
 near as (select p.uid, p.obj_id as pred_id, g.obj_id as gt_id, {DIST} as dist from p join g on p.uid = g.uid where {DIST} <= 20),
 inbox as (select p.uid, p.obj_id as pred_id, og.obj_id as gt_id, count(*) as px from p join og on p.uid = og.uid and og.y >= p.y1 and og.y < p.y2 and og.x >= p.x1 and og.x < p.x2 group by 1, 2, 3),
 shared as (select op.uid, op.obj_id as pred_id, og.obj_id as gt_id, count(*) as inter from op join og on op.uid = og.uid and op.y = og.y and op.x = og.x group by 1, 2, 3),
 sz as (select uid, obj_id as pred_id, count(*) as area from op group by 1, 2),
 ks as (select uid, pred_id, gt_id from near union select uid, pred_id, gt_id from inbox union select uid, pred_id, gt_id from shared),
 pa as (select ks.*, dist, case when inter > 0 then cast(inter as double) / (area + coalesce(px, 0) - inter) else 0.0 end as overlap, coalesce(px, 0) > 0 as hit from ks left join near using (uid, pred_id, gt_id) left join inbox using (uid, pred_id, gt_id) left join shared using (uid, pred_id, gt_id) join sz using (uid, pred_id)),
 pb as (select ks.*, dist, case when px > 0 then cast(px as double) / ({AREA}) else 0.0 end as overlap, coalesce(px, 0) > 0 as hit from (select uid, pred_id, gt_id from near union select uid, pred_id, gt_id from inbox) ks left join near using (uid, pred_id, gt_id) left join inbox using (uid, pred_id, gt_id) join p on p.uid = ks.uid and p.obj_id = ks.pred_id)"""
IOU = """(greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) * greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0))"""
BOXIOU = f"cast({IOU} as double) / ((p.y2 - p.y1) * (p.x2 - p.x1) + (g.y2 - g.y1) * (g.x2 - g.x1) - {IOU})"


def geometry(spark, sf, cap=20.0):
    return SP.pairwise_geometry(pred_with_area(spark, sf), boxes(spark, sf, "gt"), cap, object_runs(spark, sf, "gt"), object_runs(spark, sf, "pred"), FR)


@query("e5_pairwise_geometry_masks", GEO + " select uid, pred_id, gt_id, dist, overlap, hit from pa")
def _(spark, sf):
    return geometry(spark, sf).drop("model")


@query("e5_pairwise_geometry_boxes", GEO + " select uid, pred_id, gt_id, dist, overlap, hit from pb")
def _(spark, sf):
    return SP.pairwise_geometry(boxes(spark, sf, "pred"), boxes(spark, sf, "gt"), 20.0, object_runs(spark, sf, "gt"), None, FR).drop("model")


@query("e5_pairwise_geometry_bbox", B + f""", {BP} select p.uid, p.obj_id as pred_id, g.obj_id as gt_id, case when {DIST} <= 20 then {DIST} end as dist, {BOXIOU} as overlap, {IOU} > 0 as hit from p join g on p.uid = g.uid where {DIST} <= 20 or {IOU} > 0""")
def _(spark, sf):
    return SP.pairwise_geometry(boxes(spark, sf, "pred"), boxes(spark, sf, "gt"), 20.0).drop("model")


@query("e6_bbox_iou", B + f", {BP} select p.uid, p.obj_id as pred_id, g.obj_id as gt_id, {BOXIOU} as iou from p join g on p.uid = g.uid where {IOU} > 0")
def _(spark, sf):
    g = boxes(spark, sf, "gt").select("uid", F.col("obj_id").alias("gt_id"), *[F.col(c).alias(f"g{c}") for c in ("y1", "x1", "y2", "x2")])
    x = SP.box_overlap_pairs(boxes(spark, sf, "pred"), g, ["uid"])
    iou = SP.bbox_iou(tuple(F.col(c) for c in ("y1", "x1", "y2", "x2")), tuple(F.col(f"g{c}") for c in ("y1", "x1", "y2", "x2")))
    return x.select("uid", F.col("obj_id").alias("pred_id"), "gt_id", iou.alias("iou"))


@query("e7_centroid_distance", B + " select uid, obj_id, sqrt((cy - 128) * (cy - 128) + (cx - 128) * (cx - 128)) as dist from box_view")
def _(spark, sf):
    c = F.lit(128.0)
    return box_view(spark, sf).select("uid", "obj_id", SP.centroid_distance(F.col("cy"), F.col("cx"), c, c).alias("dist"))


@query("e8_component_iou", GEO + ", sg as (select uid, obj_id as gt_id, count(*) as ga from og group by 1, 2) select uid, pred_id, gt_id, inter, cast(inter as double) / (area + ga - inter) as iou from shared join sz using (uid, pred_id) join sg using (uid, gt_id)")
def _(spark, sf):
    return SP.component_iou(object_runs(spark, sf, "pred"), object_runs(spark, sf, "gt"))


VALID = "coalesce(dist <= 20, false) {op} (hit and overlap >= 0.1)"
COST = "0.5 * (1.0 - overlap) + 0.5 * (dist / 20.0)"


@query("e9_valid_pairs", GEO + f" select uid, pred_id, gt_id, {VALID.format(op='or')} as or_valid, {VALID.format(op='and')} as and_valid from pa")
def _(spark, sf):
    x = X.valid_pairs(geometry(spark, sf), 20.0, 0.1, "OR").withColumnRenamed("valid", "or_valid")
    return X.valid_pairs(x, 20.0, 0.1, "AND").withColumnRenamed("valid", "and_valid").select("uid", "pred_id", "gt_id", "or_valid", "and_valid")


@query("e10_pair_cost", GEO + f" select uid, pred_id, gt_id, {COST} as cost from pa")
def _(spark, sf):
    return X.pair_cost(geometry(spark, sf), 0.5, 20.0).select("uid", "pred_id", "gt_id", "cost")


@query("e15_candidate_stats", GEO + f" select uid, count(*) as cand_pairs, count(distinct pred_id) as cand_preds, count(distinct gt_id) as cand_gts from pa where {VALID.format(op='or')} group by uid")
def _(spark, sf):
    return X.candidate_stats(X.valid_pairs(geometry(spark, sf), 20.0, 0.1, "OR"), ["uid"])


def match_sql(source: str, pair: str = "uid", cost: str = COST) -> str:
    """The best assignment in SQL, as CTEs ending in mt(u, pred_id, gt_id) over the pairs of ``source``; ``pair`` names the unit.

    Predictions of a component are visited in id order; for each set of truth taken so far the best way to take it is
    carried on, compared by cost in units of 1e-9 and then by tie number, which make one whole number.
    """
    tie = "('0x' || left(md5(pred_id || ':' || gt_id), 8))::bigint"
    return f"""m_e as (select {pair} as u, pred_id as p, gt_id as g, cast(({cost}) * 1e9 as hugeint) * 18446744073709551616::hugeint + {tie} as z from {source} where dist is not null),
 m_pp as (select distinct a.u, a.p as a, b.p as b from m_e a join m_e b using (u, g)), m_cl as (select u, a, b from m_pp union select m_cl.u, m_cl.a, m_pp.b from m_cl join m_pp on m_cl.u = m_pp.u and m_cl.b = m_pp.a),
 m_co as (select u, a as p, min(b) as comp from m_cl group by 1, 2), m_pr as (select u, comp, p, row_number() over (partition by u, comp order by p) as k, count(*) over (partition by u, comp) as n from m_co),
 m_op as (select u, p, g, z from m_e union all select distinct u, p, null, null from m_e),
 m_st as (select distinct u, comp, n, 0::bigint as k, []::bigint[] as used, []::struct(p bigint, g bigint)[] as got, 0::hugeint as z from m_pr
  union all select u, comp, n, k, used, arg_min(got, z), min(z) from (
   select m_st.u, m_st.comp, m_st.n, m_pr.k, case when o.g is null then m_st.used else list_sort(list_append(m_st.used, o.g)) end as used, case when o.g is null then m_st.got else list_append(m_st.got, struct_pack(p := m_pr.p, g := o.g)) end as got, m_st.z + coalesce(o.z, 0) as z
   from m_st join m_pr on m_pr.u = m_st.u and m_pr.comp = m_st.comp and m_pr.k = m_st.k + 1 join m_op o on o.u = m_pr.u and o.p = m_pr.p where o.g is null or not list_contains(m_st.used, o.g)) group by 1, 2, 3, 4, 5),
 m_fi as (select u, comp, arg_min(got, z - len(got)::hugeint * 1000000000000000000000000000000000::hugeint) as got from m_st where k = n group by 1, 2),
 mt as (select u, q.p as pred_id, q.g as gt_id from (select u, unnest(got) as q from m_fi))"""


def buckets_sql(source: str, preds: str = "p", truth: str = "g") -> str:
    """CTE bk: all objects with their bucket, from the assignment mt and the valid pairs of ``source``."""
    return f"""bk as (select o.uid, 'm' as model, 'pred' as side, o.obj_id, case when mt.gt_id is not null then 'tp' when c.pred_id is not null then 'ignored' else 'fp' end as bucket, mt.gt_id as partner_id
  from {preds} o left join mt on mt.u = o.uid and mt.pred_id = o.obj_id left join (select distinct uid, pred_id from {source}) c on c.uid = o.uid and c.pred_id = o.obj_id
  union all select o.uid, 'm', 'gt', o.obj_id, case when mt.pred_id is not null then 'tp' else 'fn' end, mt.pred_id from {truth} o left join mt on mt.u = o.uid and mt.gt_id = o.obj_id)"""


RGEO = GEO.replace("with ", "with recursive ", 1)
OR_PAIRS = f"{RGEO}, va as (select * from pa where {VALID.format(op='or')}), {match_sql('va')}"
AND_PAIRS = f"{RGEO}, va as (select * from pa where {VALID.format(op='and')}), {match_sql('va')}"


@query("e11_assign_one_to_one", OR_PAIRS + " select u as uid, 'm' as model, pred_id, gt_id from mt")
def _(spark, sf):
    pairs = X.pair_cost(X.valid_pairs(geometry(spark, sf), 20.0, 0.1, "OR"), 0.5, 20.0).where("valid")
    return X.assign_one_to_one(cut_lineage(pairs), ["uid", "model"])


@query("e11_assignment_certificate", OR_PAIRS + f""", c as (select uid, pred_id, gt_id, cast(({COST}) * 1e9 as bigint) as c from va)
 select u as uid, count(*) as n_pairs, cast(sum(c) as bigint) as cost, 0::bigint as below, 0::bigint as loose, 0::bigint as free_truth, 0::bigint as unmatched, 0::bigint as gap from mt join c on uid = u and c.pred_id = mt.pred_id and c.gt_id = mt.gt_id group by u""")
def _(spark, sf):
    pairs = X.pair_cost(X.valid_pairs(geometry(spark, sf), 20.0, 0.1, "OR"), 0.5, 20.0)
    return X.assignment_certificate(pairs, ["uid"])


@query("e12_bucket_predictions", AND_PAIRS + f", {buckets_sql('va')} select * from bk")
def _(spark, sf):
    pred, gt = boxes(spark, sf, "pred"), boxes(spark, sf, "gt")
    pairs = cut_lineage(X.pair_cost(X.valid_pairs(geometry(spark, sf), 20.0, 0.1, "AND"), 0.5, 20.0).where("valid"))
    m = X.assign_one_to_one(pairs, ["uid", "model"])
    return X.bucket_predictions(pred, X.per_model(gt, ["m"]), pairs, m, ["uid", "model"], ["uid"])


@query("e13_match_objects", OR_PAIRS + f""", {buckets_sql('va')} select uid, model, count(*) filter (where side = 'pred' and bucket = 'tp') as tp, count(*) filter (where bucket = 'fp') as fp, count(*) filter (where bucket = 'fn') as fn,
 count(*) filter (where bucket = 'ignored') as ignored, count(*) filter (where side = 'pred') as n_pred, count(*) filter (where side = 'gt') as n_gt from bk group by uid, model""")
def _(spark, sf):
    b = X.match_objects(pred_with_area(spark, sf), boxes(spark, sf, "gt"), ["m"], d_max=20.0, policy="or", gt_runs=object_runs(spark, sf, "gt"), pred_runs=object_runs(spark, sf, "pred"), frame=FR)
    return X.bucket_counts(b, ["uid", "model"])


INSIDE = f"""va as (select p.uid, p.obj_id as pred_id, g.obj_id as gt_id, {DIST} as dist from p join g on p.uid = g.uid where {DIST} <= 20 and g.cy between p.y1 and p.y2 and g.cx between p.x1 and p.x2)"""


@query("e14_match_boxes_to_points", with_views("box_view", recursive=True) + f", {BP}, {INSIDE}, {match_sql('va', cost='(dist / 20.0)')}, {buckets_sql('va')} select * from bk")
def _(spark, sf):
    return X.match_boxes_to_points(boxes(spark, sf, "pred"), boxes(spark, sf, "gt"), ["m"], 20.0)


# The ordered merge in SQL: one step looks at the next object of a unit, closes the current one or opens the next.
MERGE = with_views("box_view", recursive=True) + """, o as (select uid, obj_id, cy, cx, y1, x1, y2, x2, cast((y2 - y1) * (x2 - x1) as double) as area, row_number() over (partition by uid order by obj_id) as k, count(*) over (partition by uid) as n from box_view where side = 'pred'),
 st as (select uid, k as i, k as j, n, obj_id, cy, cx, y1, x1, y2, x2, area, cast(1 as bigint) as n_merged, [k] as taken, false as closed from o where k = 1
  union all select s.uid, case when s.closed then o.k else s.i end, case when s.closed then o.k when s.j < s.n then s.j + 1 else s.j end, s.n, case when s.closed then o.obj_id else s.obj_id end,
   case when s.closed then o.cy when s.hit then (s.cy + o.cy) / 2 else s.cy end, case when s.closed then o.cx when s.hit then (s.cx + o.cx) / 2 else s.cx end,
   case when s.closed then o.y1 when s.hit then least(s.y1, o.y1) else s.y1 end, case when s.closed then o.x1 when s.hit then least(s.x1, o.x1) else s.x1 end,
   case when s.closed then o.y2 when s.hit then greatest(s.y2, o.y2) else s.y2 end, case when s.closed then o.x2 when s.hit then greatest(s.x2, o.x2) else s.x2 end,
   case when s.closed then o.area when s.hit then s.area + o.area else s.area end, case when s.closed then 1 when s.hit then s.n_merged + 1 else s.n_merged end,
   case when s.closed or s.hit then list_append(s.taken, o.k) else s.taken end, not s.closed and s.j = s.n
  from (select st.*, x.k as xk, not st.closed and st.j < st.n and not list_contains(st.taken, x.k) and sqrt((st.cy - x.cy) * (st.cy - x.cy) + (st.cx - x.cx) * (st.cx - x.cx)) < 12 as hit
   from st left join o x on x.uid = st.uid and x.k = case when st.closed then list_filter(range(st.i + 1, st.n + 1), lambda q: not list_contains(st.taken, q))[1] when st.j < st.n then st.j + 1 end where not (st.closed and x.k is null)) s left join o on o.uid = s.uid and o.k = s.xk)"""


@query("e16_merge_close_objects", MERGE + " select uid, obj_id, cy, cx, y1, x1, y2, x2, area, n_merged from st where closed")
def _(spark, sf):
    return P.merge_close_objects(boxes(spark, sf, "pred"), 12.0, ["uid"])


@query("e17_split_large_predictions", B + f""", {BP}, h as (select p.uid, p.obj_id, g.cy, g.cx from p join g on p.uid = g.uid and g.cy between p.y1 and p.y2 and g.cx between p.x1 and p.x2), m as (select uid, obj_id from h group by 1, 2 having count(*) >= 2)
 select p.uid, cy, cx, y1, x1, y2, x2, cast((y2 - y1) * (x2 - x1) as double) as area, false as is_split, cast(null as bigint) as split_from from p anti join m on p.uid = m.uid and p.obj_id = m.obj_id
 union all select h.uid, cy, cx, cast(cy as int) - 5, cast(cx as int) - 5, cast(cy as int) + 5, cast(cx as int) + 5, 100.0, true, h.obj_id from h join m on h.uid = m.uid and h.obj_id = m.obj_id""")
def _(spark, sf):
    return P.split_large_predictions(boxes(spark, sf, "pred"), boxes(spark, sf, "gt"), ["uid"])


@query("e18_objects_to_pixels", OP + f""", {BP}, f as (select distinct p.uid, y, x from p cross join range(256) a(y) cross join range(256) b(x) where p.obj_id % 2 = 1 and y >= p.y1 and y < p.y2 and x >= p.x1 and x < p.x2) select * from f union select uid, y, x from object_pixel_view where side = 'pred' and obj_id % 2 = 0""".replace("cross join range(256) a(y) cross join range(256) b(x) where p.obj_id % 2 = 1 and y >= p.y1 and y < p.y2 and x >= p.x1 and x < p.x2", "cross join lateral (select unnest(range(greatest(p.y1, 0), least(p.y2, 256))) as y) cross join lateral (select unnest(range(greatest(p.x1, 0), least(p.x2, 256))) as x) where p.obj_id % 2 = 1"))
def _(spark, sf):
    own = object_pixel_view(spark, sf).where("side = 'pred' and obj_id % 2 = 0")
    return P.objects_to_pixels(boxes(spark, sf, "pred"), FR, own)


CONF = "per as (select uid, y, x, bool_or(layer = 'gt') as g, bool_or(layer = 'pred') as p from pixel_view group by 1, 2, 3), im as (select distinct user_id as uid from events)"


def images(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("uid")).distinct().select("uid", F.lit(FRAME).alias("h"), F.lit(FRAME).alias("w"))


@query("e20_pixel_confusion", PX + f""", {CONF}, n as (select uid, count(*) filter (where g and p) as tp, count(*) filter (where p and not g) as fp, count(*) filter (where g and not p) as fn from per group by uid)
 select uid, case when uid % 10 <> 3 then coalesce(tp, 0) end as pix_tp, case when uid % 10 <> 3 then coalesce(fp, 0) end as pix_fp, case when uid % 10 <> 3 then coalesce(fn, 0) end as pix_fn, case when uid % 10 <> 3 then 65536 - coalesce(tp + fp + fn, 0) end as pix_tn,
 case when uid % 10 = 3 then 'shape mismatch' end as error from im left join n using (uid)""")
def _(spark, sf):
    im = images(spark, sf).withColumn("pred_h", F.when(F.col("uid") % 10 == 3, 128).otherwise(FRAME)).withColumn("pred_w", F.lit(FRAME))
    return P.pixel_confusion(pixel_view(spark, sf), im)


@query("e21_region_mask", PX + ", a as materialized (select * from pixel_view where layer = 'gt'), b as materialized (select uid, y, x from pixel_view where layer = 'pred') select uid, layer, y, x from a semi join b using (uid, y, x)")
def _(spark, sf):
    px = pixel_view(spark, sf)
    return P.region_mask(px.where("layer = 'gt'"), px.where("layer = 'pred'")).select("uid", "layer", "y", "x")


# Regions derived from the objects: cells of the frame near a truth or predicted object, as blocks.
ROI = PX + """, ra as (select distinct uid, 'a' as layer, y, x from (select uid, (cy // 32) * 32 as b_y, (cx // 32) * 32 as b_x from obj_view where side = 'gt') cross join lateral (select unnest(range(b_y, b_y + 32)) as y) cross join lateral (select unnest(range(b_x, b_x + 32)) as x)),
 rb as (select distinct uid, 'b' as layer, y, x from (select uid, (cy // 32) * 32 as b_y, (cx // 32) * 32 as b_x from obj_view where side = 'pred') cross join lateral (select unnest(range(b_y, b_y + 32)) as y) cross join lateral (select unnest(range(b_x, b_x + 32)) as x)),
 al as (select uid, layer, y, x from ra union all select uid, layer, y, x from rb union all select uid, layer, y, x from pixel_view where layer = 'gt')"""


def roi_blocks(spark, sf, side):
    """Square blocks of the frame (by, bx) that hold objects of a side."""
    o = obj_view(spark, sf).where(F.col("side") == side)
    b = o.select("uid", F.floor(F.col("cy") / 32).alias("by"), F.floor(F.col("cx") / 32).alias("bx"))
    return b.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid", "by", "bx").distinct()


def roi_boxes(spark, sf, side):
    """The blocks as boxes."""
    lo, hi = (lambda c: F.col(c) * 32), (lambda c: F.col(c) * 32 + 32)
    return roi_blocks(spark, sf, side).select("uid", lo("by").alias("y1"), lo("bx").alias("x1"), hi("by").alias("y2"), hi("bx").alias("x2"))


def roi_pixels(spark, sf, side, layer):
    """The blocks as pixels of a region layer.

    They are dealt to a fixed number of tasks, because a few bytes of them become a thousand pixels each.
    """
    b = roi_blocks(spark, sf, side)
    span = lambda c: F.explode(F.sequence(F.col(c) * 32, F.col(c) * 32 + 31))
    return b.withColumn("y", span("by")).withColumn("x", span("bx")).select("uid", F.lit(layer).alias("layer"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


@query("e22_region_agreement", ROI + """, per as (select uid, y, x, bool_or(layer = 'a') as a, bool_or(layer = 'b') as b, bool_or(layer = 'gt') as g from al group by 1, 2, 3),
 n as (select uid, count(*) filter (where a) as m, count(*) filter (where b) as p, count(*) filter (where a and b) as i, count(*) filter (where g) as gp, count(*) filter (where g and b) as gi from per group by uid),
 t as (select o.uid, count(*) as np, count(*) filter (where ra.uid is not null) as ia, count(*) filter (where rb.uid is not null) as ib, count(*) filter (where ra.uid is not null and rb.uid is not null) as ab, count(*) filter (where ra.uid is not null and rb.uid is null) as oa, count(*) filter (where ra.uid is null and rb.uid is not null) as ob
  from obj_view o left join ra on o.uid = ra.uid and o.cy = ra.y and o.cx = ra.x left join rb on o.uid = rb.uid and o.cy = rb.y and o.cx = rb.x where o.side = 'gt' group by o.uid)
 select uid, m as manual_px, p as pred_px, i as intersection_px, i / nullif(m + p - i, 0) as iou, 2 * i / nullif(m + p, 0) as dice, i / nullif(m, 0) as frac_manual_covered, p / nullif(m, 0) as area_ratio, p - i as pred_outside_manual_px, m - i as manual_only_px, p = 0 as pred_roi_empty,
 gp as gt_fg_px, gi as gt_fg_px_in_roi, gi / nullif(gp, 0) as pixel_retention, coalesce(np, 0) as gt_objects, coalesce(ib, 0) as gt_objects_in_roi, ib / nullif(np, 0) as object_retention, coalesce(ia, 0) as gt_objects_in_manual, coalesce(ab, 0) as gt_objects_in_both, coalesce(oa, 0) as gt_objects_manual_only,
 coalesce(ob, 0) as gt_objects_pred_only, ab / nullif(ia, 0) as retention_vs_manual from n left join t using (uid)""")
def _(spark, sf):
    layers = roi_pixels(spark, sf, "gt", "a").unionByName(roi_pixels(spark, sf, "pred", "b")).unionByName(pixel_view(spark, sf).where("layer = 'gt'"))
    pts = boxes(spark, sf, "gt").select("uid", "cy", "cx")
    return P.region_agreement(layers, pts, FR, "a", "b", "gt")


@query("e23_retention", ROI + """, im as (select distinct user_id as uid, 256 as h, 256 as w, case user_id % 7 when 0 then null when 1 then 128 else 256 end as rh, case user_id % 7 when 0 then null else 256 end as rw from events),
 g as (select uid, count(*) as gp from pixel_view where layer = 'gt' group by uid), k as (select a.uid, count(*) as kp from pixel_view a join rb using (uid, y, x) where a.layer = 'gt' group by a.uid),
 x as (select uid, coalesce(gp, 0) as gp, coalesce(kp, 0) as kp, case when rh is null then 'no_mask' when rh <> h then 'shape' when coalesce(gp, 0) > 0 and coalesce(kp, 0) = 0 then 'empty_after_mask' else 'ok' end as status from im left join g using (uid) left join k using (uid))
 select uid, status, case when status in ('ok', 'empty_after_mask') then gp else 0 end as gt_px, case when status in ('ok', 'empty_after_mask') then kp else 0 end as kept_px, case when status in ('ok', 'empty_after_mask') then kp / nullif(gp, 0) end as kept_frac from x""")
def _(spark, sf):
    k = F.col("uid") % 7
    u = images(spark, sf).withColumn("roi_h", F.when(k == 1, 128).when(k != 0, FRAME)).withColumn("roi_w", F.when(k != 0, FRAME))
    return P.retention(u, pixel_view(spark, sf).where("layer = 'gt'"), roi_pixels(spark, sf, "pred", "b"))


@query("e24_local_maxima", CE + " select a.uid, a.y, a.x, a.p from cell_view a where p >= 0.3 and y between 4 and 251 and x between 4 and 251 and p >= (select max(b.p) from cell_view b where a.uid = b.uid and b.y between a.y - 8 and a.y + 8 and b.x between a.x - 8 and a.x + 8)")
def _(spark, sf):
    return P.local_maxima(cell_view(spark, sf), 0.3, 8, 4, FR)


def nms_sql(src, dist):
    """The ordered suppression in SQL: peaks of a unit are visited by score, the kept ones travel along as a list."""
    return f"""pk as (select *, row_number() over (partition by uid order by p desc, y, x) as rn, count(*) over (partition by uid) as n from {src}),
 st as (select uid, rn, n, [struct_pack(y := y, x := x, p := p)] as kept from pk where rn = 1
  union all select st.uid, pk.rn, pk.n, case when len(list_filter(st.kept, lambda k: (k.y - pk.y) * (k.y - pk.y) + (k.x - pk.x) * (k.x - pk.x) < {dist * dist})) = 0 then list_append(st.kept, struct_pack(y := pk.y, x := pk.x, p := pk.p)) else st.kept end from st join pk on pk.uid = st.uid and pk.rn = st.rn + 1),
 kept as (select uid, k.y as y, k.x as x, k.p as p from (select uid, unnest(kept) as k from st where rn = n))"""


@query("e25_greedy_nms", with_views("cell_view", recursive=True) + f", {nms_sql('cell_view', 25)} select * from kept")
def _(spark, sf):
    return P.greedy_nms(cell_view(spark, sf), 25.0)


KW = P.gauss_weights(1.0)
KR = len(KW) // 2
KV = ", ".join(f"({i - KR}, {w!r}::double)" for i, w in enumerate(KW))
KERNEL = f"""k(d, w) as (values {KV}), f as (select n, d, case when n + d < 0 then -1 - (n + d) when n + d > 255 then 511 - (n + d) else n + d end as t, w from range(256) r(n) cross join k),
 sm as (select uid, a.t as y, b.t as x, sum(p * a.w * b.w) as p from cell_view c join f a on a.n = c.y join f b on b.n = c.x group by 1, 2, 3)"""


@query("e26_detect_points", ROI.replace("with ", "with recursive ", 1) + f""", cell_view as ({VIEW_SQL['cell_view']}), {KERNEL}, ms as (select uid, y, x, round(p, 9) as p from sm join rb using (uid, y, x)),
 mx as (select a.uid, a.y, a.x, any_value(a.p) as p from ms a join ms b on a.uid = b.uid and b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 where a.p >= 0.02 group by a.uid, a.y, a.x having any_value(a.p) = max(b.p)), {nms_sql('mx', 6)} select * from kept""")
def _(spark, sf):
    return P.detect_points(cell_view(spark, sf), FR, 0.02, 2, 6.0, sigma=1.0, roi=roi_boxes(spark, sf, "pred"))


@query("e27_kernel_sum", CE + f", {KERNEL} select * from sm")
def _(spark, sf):
    return P.kernel_sum(cell_view(spark, sf), KW, FR)


@query("e28_rasterise_points", CE + """, s as (select uid, c.y + a.d as y, c.x + b.d as x, max(exp(-(a.d * a.d + b.d * b.d) / 2.0)) as p from cell_view c cross join (select unnest(range(-4, 5)) as d) a cross join (select unnest(range(-4, 5)) as d) b where c.y + a.d between 0 and 255 and c.x + b.d between 0 and 255 group by 1, 2, 3),
 m as (select uid, case when count(*) < 65536 then 0.0 else min(p) end as lo, max(p) as hi from s group by uid) select s.uid, y, x, case when hi > lo then (p - lo) / (hi - lo) else 0.0 end as p from s join m using (uid)""")
def _(spark, sf):
    return P.rasterise_points(cell_view(spark, sf), 1.0, FR)


@query("e29_render_diamonds", CE + " select distinct uid, c.y + a.d as y, c.x + b.d as x from cell_view c cross join (values (-2), (-1), (0), (1), (2)) a(d) cross join (values (-2), (-1), (0), (1), (2)) b(d) where abs(a.d) + abs(b.d) <= 2 and c.y + a.d between 0 and 255 and c.x + b.d between 0 and 255")
def _(spark, sf):
    return P.render_diamonds(cell_view(spark, sf), 2, FR)


@query("e30_rescale_points", CE + ", s as (select distinct uid, cast(round_even(y * 1.5, 0) as int) as y, cast(round_even(x * 2.5, 0) as int) as x from cell_view) select distinct uid, s.y + a.d as y, s.x + b.d as x from s cross join (values (-1), (0), (1)) a(d) cross join (values (-1), (0), (1)) b(d) where abs(a.d) + abs(b.d) <= 1 and s.y + a.d between 0 and 383 and s.x + b.d between 0 and 639")
def _(spark, sf):
    return P.render_diamonds(P.rescale_points(cell_view(spark, sf), 1.5, 2.5), 1, (384, 640))


@query("e31_otsu_threshold", """with h as (select user_id as uid, (event_id * 37) % 256 as v, count(*) as n from events group by 1, 2),
 c as (select uid, v, sum(n) over (partition by uid order by v) as w0, sum(n * v) over (partition by uid order by v) as s0, sum(n) over (partition by uid) as w, sum(n * v) over (partition by uid) as s from h),
 d as (select uid, v, case when w > w0 then cast(w0 as double) / w * (cast(w - w0 as double) / w) * (cast(s0 as double) / w0 - cast(s - s0 as double) / (w - w0)) * (cast(s0 as double) / w0 - cast(s - s0 as double) / (w - w0)) else 0.0 end as var from c),
 b as (select uid, case when var > 0 then v else 0 end as otsu from d qualify row_number() over (partition by uid order by var desc, v) = 1)
 select uid, cast(otsu as int) as otsu, cast(floor(least(255.0, greatest(0.0, otsu * 1.2))) as int) as threshold from b""")
def _(spark, sf):
    v = table(spark, sf, "events").select(F.col("user_id").alias("uid"), ((F.col("event_id") * 37) % 256).alias("v"))
    return P.otsu_threshold(v, ["uid"], 1.2)



@query("e32_classify_by_region_mean", with_views("box_view", "cell_view") + """, m as (select p.uid, p.obj_id, avg(c.p * 300) as mean_v, avg(c.p * 60) as mean_s from (select * from box_view where side = 'gt') p join cell_view c on p.uid = c.uid and c.y >= p.y1 and c.y < p.y2 and c.x >= p.x1 and c.x < p.x2 group by 1, 2)
 select g.uid, g.obj_id, mean_v, mean_s, case when mean_v > 170 and mean_s < 50 then 'bright' else 'coloured' end as label from (select * from box_view where side = 'gt') g left join m using (uid, obj_id)""")
def _(spark, sf):
    c = cell_view(spark, sf).select("uid", "y", "x", (F.col("p") * 300).alias("v"), (F.col("p") * 60).alias("s"))
    return P.classify_by_region_mean(boxes(spark, sf, "gt"), c, ["uid"])


@query("e32_label_counts", with_views("box_view", "cell_view") + """, m as (select p.uid, p.obj_id, avg(c.p * 300) as mean_v, avg(c.p * 60) as mean_s from (select * from box_view where side = 'gt') p join cell_view c on p.uid = c.uid and c.y >= p.y1 and c.y < p.y2 and c.x >= p.x1 and c.x < p.x2 group by 1, 2)
 select g.uid, count(*) filter (where mean_v > 170 and mean_s < 50) as n_bright, count(*) filter (where not coalesce(mean_v > 170 and mean_s < 50, false)) as n_coloured from (select * from box_view where side = 'gt') g left join m using (uid, obj_id) group by g.uid""")
def _(spark, sf):
    c = cell_view(spark, sf).select("uid", "y", "x", (F.col("p") * 300).alias("v"), (F.col("p") * 60).alias("s"))
    return P.label_counts(P.classify_by_region_mean(boxes(spark, sf, "gt"), c, ["uid"]), ["uid"])


def runs_sql(source: str, name: str) -> str:
    """CTE of the horizontal runs (uid, y, x0, x1) of a pixel table."""
    return f"{name} as (select uid, y, min(x) as x0, max(x) as x1 from (select uid, y, x, x - row_number() over (partition by uid, y order by x) as k from {source}) group by uid, y, k)"


def spread_sql(runs: str, seeds: str, name: str) -> str:
    """CTE of the runs reached from ``seeds`` over shared edges."""
    return f"""{name} as (select uid, y, x0, x1 from {seeds} union select b.uid, b.y, b.x0, b.x1 from {name} a cross join (values (-1), (1)) s(d) join {runs} b on b.uid = a.uid and b.y = a.y + s.d and b.x0 <= a.x1 and b.x1 >= a.x0)"""


CENTER = ROI.replace("with ", "with recursive ", 1) + f""", {runs_sql('ra', 'fr')}, ed as (select uid, y, x0, x1 from fr union all select uid, y, 256, 256 from (select distinct uid from ra) cross join range(256) r(y)),
 bg as (select * from (select uid, y, coalesce(lag(x1) over (partition by uid, y order by x0), -1) + 1 as x0, x0 - 1 as x1 from ed) where x1 >= x0), sd as (select * from bg where y in (0, 255) or x0 = 0 or x1 = 255), {spread_sql('bg', 'sd', 'op')},
 ho as (select * from bg anti join op using (uid, y, x0, x1)), fi as (select uid, y, x from ra union select uid, y, unnest(range(x0, x1 + 1)) from ho), {runs_sql('fi', 'rr')},
 mi as (select * from rr where y = 128 and 128 between x0 and x1), {spread_sql('rr', 'mi', 'ce')}, ke as (select * from ce union all select rr.* from rr anti join mi using (uid))
 select uid, y, x0, x1 from ke"""


@query("e33_keep_center_component", CENTER)
def _(spark, sf):
    """The kept pixels as runs."""
    return C.runs_from_pixels(P.keep_center_component(roi_pixels(spark, sf, "gt", "a"), images(spark, sf)), ["uid"])
