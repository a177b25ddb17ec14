"""Views that give the driver tables the shape of an evaluation data set.

Each view exists twice: as a DataFrame builder and as SQL text for the comparison run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ["A", "N", "R"]
SPLITS = ["train", "val", "test"]
FRAME = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split_of(key):
    return F.when(key % 20 < 14, "train").when(key % 20 < 17, "val").otherwise("test")


def _fact(lineitem: DataFrame, key: str) -> DataFrame:
    """Per key and model: object and pixel tallies from the line items of that key."""
    on_f = F.col("l_linestatus") == "F"
    on_o = F.col("l_linestatus") == "O"
    px = F.col("l_quantity").cast("bigint")
    aggs = [
        F.count_if(on_f).alias("all_f"),
        F.sum(F.when(on_f, px).otherwise(0)).alias("px_f"),
        F.sum(px).alias("px_all"),
    ]
    for m in MODELS:
        mine = F.col("l_returnflag") == m
        aggs += [
            F.count_if(mine & on_f).alias(f"tp_{m}"),
            F.count_if(mine & on_o & (F.col("l_tax") >= 0.02)).alias(f"fp_{m}"),
            F.count_if(mine & on_o & (F.col("l_tax") < 0.02)).alias(f"ig_{m}"),
            F.sum(F.when(mine & on_f, px).otherwise(0)).alias(f"ptp_{m}"),
            F.sum(F.when(mine & on_o, px).otherwise(0)).alias(f"pfp_{m}"),
        ]
    per_key = lineitem.groupBy(key).agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("model"),
                    F.col(f"tp_{m}").alias("obj_tp"),
                    F.col(f"fp_{m}").alias("obj_fp"),
                    (F.col("all_f") - F.col(f"tp_{m}")).alias("obj_fn"),
                    F.col(f"ig_{m}").alias("obj_ignored"),
                    F.col(f"ptp_{m}").alias("pix_tp"),
                    F.col(f"pfp_{m}").alias("pix_fp"),
                    (F.col("px_f") - F.col(f"ptp_{m}")).alias("pix_fn"),
                    (F.col("px_all") - F.col("px_f") - F.col(f"pfp_{m}")).alias("pix_tn"),
                )
                for m in MODELS
            ]
        )
    ).alias("r")
    return (
        per_key.select(key, rows)
        .select(key, "r.*")
        .withColumn("pred_count", F.col("obj_tp") + F.col("obj_fp") + F.col("obj_ignored"))
        .withColumn("gt_count", F.col("obj_tp") + F.col("obj_fn"))
    )


def unit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and model; groups are brands, conditions are part types."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return (
        _fact(li, "l_partkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("uid"),
            F.col("p_brand").alias("grp"),
            F.col("p_type").alias("cond"),
            F.when(F.col("p_size") > 25, "treated").otherwise("control").alias("arm"),
            _split_of(F.col("l_partkey")).alias("split"),
            "model", "obj_tp", "obj_fp", "obj_fn", "obj_ignored",
            "pix_tp", "pix_fp", "pix_fn", "pix_tn", "pred_count", "gt_count",
        )
    )


def supp_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and model: the same tallies with larger counts per unit."""
    li = table(spark, sf_dir, "lineitem")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        _fact(li, "l_suppkey")
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("uid"),
            F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("grp"),
            _split_of(F.col("l_suppkey")).alias("split"),
            "model", "obj_tp", "obj_fp", "obj_fn", "obj_ignored",
            "pix_tp", "pix_fp", "pix_fn", "pix_tn", "pred_count", "gt_count",
        )
    )


def obj_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objects of a user's frame: purchases and signups are truth, clicks and views predictions."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "click", "view"))
    return ev.select(
        F.col("user_id").alias("uid"),
        F.col("event_id").alias("obj_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), "gt").otherwise("pred").alias("side"),
        ((F.col("event_id") * 37) % FRAME).cast("int").alias("cx"),
        (F.floor(F.col("value") * 10).cast("bigint") % FRAME).cast("int").alias("cy"),
        (2 + F.col("event_id") % 3).cast("int").alias("half"),
    )


def box_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with centroid (cy, cx) and an end-exclusive box."""
    o = obj_view(spark, sf_dir)
    return o.select(
        "uid", "side", F.when(F.col("side") == "pred", "m").alias("model"), "obj_id",
        F.col("cy").cast("double").alias("cy"), F.col("cx").cast("double").alias("cx"),
        (F.col("cy") - F.col("half")).alias("y1"), (F.col("cx") - F.col("half")).alias("x1"),
        (F.col("cy") + F.col("half") + 1).alias("y2"), (F.col("cx") + F.col("half") + 1).alias("x2"),
    )


_DIAMOND = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) <= 2]


def object_pixel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13-pixel diamond of every object, clipped to the frame (objects may share pixels)."""
    o = obj_view(spark, sf_dir)
    offs = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _DIAMOND])
    return (
        o.withColumn("o", F.explode(offs))
        .select("uid", "side", "obj_id", (F.col("cy") + F.col("o.dy")).alias("y"), (F.col("cx") + F.col("o.dx")).alias("x"))
        .where(F.col("y").between(0, FRAME - 1) & F.col("x").between(0, FRAME - 1))
    )


def pixel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_pixel_view(spark, sf_dir).select("uid", F.col("side").alias("layer"), "y", "x").distinct()


def cell_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cells of the predictions; several events on one cell keep the highest score."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return (
        ev.select(
            F.col("user_id").alias("uid"),
            ((F.col("event_id") * 37) % FRAME).cast("int").alias("x"),
            (F.floor(F.col("value") * 10).cast("bigint") % FRAME).cast("int").alias("y"),
            (((F.col("event_id") * 7919) % 1000).cast("double") / F.lit(1000.0)).alias("p"),
        )
        .groupBy("uid", "y", "x")
        .agg(F.max("p").alias("p"))
    )


# Spellings a name can carry, used to derive file-like names from parts.
NAME_TOKENS = ["COLO320DM", "snu16", "NCI_H2170", "sum159pt", "NCIH716", "skgt2", "ctrl"]
NAME_SUFFIXES = ["_DAPI.tif", "_Merge.tif (RGB).tif", "-merge_ROI.png", " (RGB).tif", "_gt.png", "_Mask_LE.png", ".png", "_bad.png"]


def name_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-like names built from the part rows."""
    p = table(spark, sf_dir, "part")
    tok = F.element_at(F.array(*[F.lit(t) for t in NAME_TOKENS]), (F.col("p_size") % 7 + 1).cast("int"))
    suf = F.element_at(F.array(*[F.lit(t) for t in NAME_SUFFIXES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    side = F.when(F.col("p_partkey") % 3 == 0, "_a").when(F.col("p_partkey") % 3 == 1, "_B").otherwise("")
    return p.select(
        "p_partkey",
        F.concat(tok, F.lit("_"), F.col("p_name"), F.lit("__"), F.col("p_partkey").cast("string"), side, suf).alias("name"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a file listing: path, size in bytes, digest source."""
    pg = table(spark, sf_dir, "pages")
    return pg.select(
        "page_id",
        F.regexp_replace(F.regexp_replace(F.col("url"), "^[a-z]+://", ""), "[?#].*$", "").alias("path"),
        F.length("html").cast("bigint").alias("size_bytes"),
    )


_FACT_SQL = """
  count(*) filter (where l_returnflag = m.model and l_linestatus = 'F') as obj_tp,
  count(*) filter (where l_returnflag = m.model and l_linestatus = 'O' and l_tax >= 0.02) as obj_fp,
  count(*) filter (where l_returnflag <> m.model and l_linestatus = 'F') as obj_fn,
  count(*) filter (where l_returnflag = m.model and l_linestatus = 'O' and l_tax < 0.02) as obj_ignored,
  cast(coalesce(sum(cast(l_quantity as bigint)) filter (where l_returnflag = m.model and l_linestatus = 'F'), 0) as bigint) as pix_tp,
  cast(coalesce(sum(cast(l_quantity as bigint)) filter (where l_returnflag = m.model and l_linestatus = 'O'), 0) as bigint) as pix_fp,
  cast(coalesce(sum(cast(l_quantity as bigint)) filter (where l_returnflag <> m.model and l_linestatus = 'F'), 0) as bigint) as pix_fn,
  cast(coalesce(sum(cast(l_quantity as bigint)) filter (where l_returnflag <> m.model and l_linestatus <> 'F'), 0) as bigint) as pix_tn,
  count(*) filter (where l_returnflag = m.model and l_linestatus in ('F', 'O')) as pred_count,
  count(*) filter (where l_linestatus = 'F') as gt_count
"""

VIEW_SQL = {
    "unit_view": f"""
 select 'part_' || cast(l_partkey as varchar) as uid, p_brand as grp, p_type as cond,
  case when p_size > 25 then 'treated' else 'control' end as arm,
  case when l_partkey % 20 < 14 then 'train' when l_partkey % 20 < 17 then 'val' else 'test' end as split, m.model, {_FACT_SQL}
 from lineitem join part on l_partkey = p_partkey cross join (values ('A'), ('N'), ('R')) as m(model)
 group by l_partkey, p_brand, p_type, p_size, m.model""",
    "supp_view": f"""
 select 'supp_' || cast(l_suppkey as varchar) as uid, 'nation_' || cast(s_nationkey as varchar) as grp,
  case when l_suppkey % 20 < 14 then 'train' when l_suppkey % 20 < 17 then 'val' else 'test' end as split, m.model, {_FACT_SQL}
 from lineitem join supplier on l_suppkey = s_suppkey cross join (values ('A'), ('N'), ('R')) as m(model)
 group by l_suppkey, s_nationkey, m.model""",
    "obj_view": """
 select user_id as uid, event_id as obj_id,
  case when event_type in ('purchase', 'signup') then 'gt' else 'pred' end as side,
  cast((event_id * 37) % 256 as int) as cx, cast(cast(floor(value * 10) as bigint) % 256 as int) as cy,
  cast(2 + event_id % 3 as int) as half
 from events where event_type in ('purchase', 'signup', 'click', 'view')""",
    "box_view": """
 select uid, side, obj_id, cast(cy as double) as cy, cast(cx as double) as cx,
  cy - half as y1, cx - half as x1, cy + half + 1 as y2, cx + half + 1 as x2 from obj_view""",
    "object_pixel_view": """
 select o.uid, o.side, o.obj_id, o.cy + a.d as y, o.cx + b.d as x
 from obj_view o cross join (values (-2), (-1), (0), (1), (2)) as a(d) cross join (values (-2), (-1), (0), (1), (2)) as b(d)
 where abs(a.d) + abs(b.d) <= 2 and o.cx + b.d between 0 and 255 and o.cy + a.d between 0 and 255""",
    "pixel_view": " select distinct uid, side as layer, y, x from object_pixel_view",
    "cell_view": """
 select user_id as uid, cast(cast(floor(value * 10) as bigint) % 256 as int) as y, cast((event_id * 37) % 256 as int) as x,
  max(cast((event_id * 7919) % 1000 as double) / 1000.0) as p
 from events where event_type in ('click', 'view') group by 1, 2, 3""",
    "name_view": """
 select p_partkey, (['COLO320DM', 'snu16', 'NCI_H2170', 'sum159pt', 'NCIH716', 'skgt2', 'ctrl'])[p_size % 7 + 1] || '_' || p_name || '__' ||
  cast(p_partkey as varchar) || case when p_partkey % 3 = 0 then '_a' when p_partkey % 3 = 1 then '_B' else '' end ||
  (['_DAPI.tif', '_Merge.tif (RGB).tif', '-merge_ROI.png', ' (RGB).tif', '_gt.png', '_Mask_LE.png', '.png', '_bad.png'])[p_partkey % 8 + 1] as name
 from part""",
    "page_files": """
 select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path, length(html) as size_bytes from pages""",
}

_NEEDS = {"box_view": ["obj_view"], "object_pixel_view": ["obj_view"], "pixel_view": ["object_pixel_view"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the named views and whatever they build on."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    body = ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in order)
    return f"with {'recursive ' if recursive else ''}{body}"
