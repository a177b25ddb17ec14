"""Splits, leave-one-group-out studies and their summaries (L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.functions import metrics as M
from gridtally.operators.ranks import row_numbers
from gridtally.session import cut_lineage, join_keys, ratio


def leave_one_group_out(df: DataFrame, held: str, group: str = "grp", split: str = "split") -> DataFrame:
    """L1: train and val rows of the other groups and every row of the held group, with a ``role``.

    A group that does not occur raises an error when the result is read.
    """
    g, s = F.col(group), F.col(split)
    role = F.when(g == held, "eval").when(s.isin("train", "val"), s)
    known = df.agg(F.coalesce(F.max(g == held), F.lit(False)).alias("_known")).scalar()
    checked = F.when(F.col("_known"), F.col("role")).otherwise(F.raise_error(F.lit(f"group {held!r} not present")))
    return df.withColumn("role", role).where("role is not null").withColumn("_known", known).withColumn("role", checked).drop("_known")


def role_info(roles: DataFrame, value: str, group: str = "grp") -> DataFrame:
    """L1: units, objects and groups per role."""
    return roles.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(value).cast("bigint").alias("gt_objects"), F.countDistinct(group).alias("n_groups")
    )


def quotas(counts: DataFrame, group: str, n: Column | int) -> DataFrame:
    """L2: seats per group by largest remainder, summing to ``n``; ``counts`` holds one row per group.

    Integer arithmetic throughout; equal remainders go to the first group by name.
    """
    n = F.lit(n) if isinstance(n, int) else n
    total = counts.agg(F.sum("cnt").alias("_total")).scalar()
    x = counts.withColumn("_total", total).withColumn("_n", n.cast("bigint"))
    x = x.withColumn("_n", F.when(F.col("_n") <= F.col("_total"), F.col("_n")).otherwise(F.raise_error(F.lit("sample larger than its pool")).cast("bigint")))
    x = x.withColumn("_q", F.expr("(_n * cnt) div _total")).withColumn("_r", F.expr("(_n * cnt) % _total"))
    left = F.col("_n") - F.sum("_q").over(W.partitionBy())
    pos = F.row_number().over(W.orderBy(F.desc("_r"), group))
    return x.select(group, "cnt", (F.col("_q") + F.when(pos <= left, 1).otherwise(0)).alias("quota"))


def seeded_hash(uid: str, seed: Column | int) -> Column:
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws(":", s, F.col(uid).cast("string")))


#: Hexadecimal digits of a digest by which rows are counted to find how far a sample reaches.
REACH_DIGITS = 4


def lowest_digests(df: DataFrame, groups: list[str], quota: DataFrame | int, uid: str) -> DataFrame:
    """The rows with the smallest (_h, uid) of each group, as many as its ``_quota``; ``quota`` is a number or one row per group.

    Counts by the first digits of the digest tell where each group reaches its quota, so only rows up to there are numbered,
    about a quota and one part in 65,536 of the group, and never the whole pool.
    """
    head = F.substring("_h", 1, REACH_DIGITS)
    counts = df.groupBy(*groups, head.alias("_head")).agg(F.count(F.lit(1)).alias("_c"))
    up = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy("_head").rowsBetween(W.unboundedPreceding, 0)
    # the heads before which the quota is not yet reached
    counts = counts.withColumn("_before", F.sum("_c").over(up) - F.col("_c"))
    if isinstance(quota, int):
        reach = counts.where(F.col("_before") < quota).agg(F.max("_head")).scalar()
        near = df.where(head <= reach).withColumn("_quota", F.lit(quota))
    else:
        reach = join_keys(counts, quota, groups).where("_before < _quota").groupBy(*groups).agg(F.max("_head").alias("_reach"), F.max("_quota").alias("_quota"))
        near = join_keys(df, reach, groups).where(head <= F.col("_reach")).drop("_reach")
    return row_numbers(cut_lineage(near), groups, ["_h", uid], "_rn").where("_rn <= _quota").drop("_h", "_rn", "_quota")


def stratified_sample(df: DataFrame, n: int, seed: int, group: str = "grp", uid: str = "uid") -> DataFrame:
    """L2: exactly ``n`` rows, proportional to group size, the same rows for the same seed.

    The rows of a group with the smallest seeded digests are drawn.
    """
    q = quotas(df.groupBy(group).agg(F.count(F.lit(1)).alias("cnt")), group, n).select(group, F.col("quota").alias("_quota"))
    return lowest_digests(df.withColumn("_h", seeded_hash(uid, seed)), [group], q, uid)


def size_matched_control(df: DataFrame, held: str, seed: int, group: str = "grp", uid: str = "uid") -> DataFrame:
    """L3: train and val sampled over all groups to the sizes of L1, evaluated on the held group's test rows."""
    sizes = df.where(F.col(group) != held).groupBy("split").agg(F.count(F.lit(1)).alias("_want"))
    pool = df.where(F.col("split").isin("train", "val"))
    counts = pool.groupBy("split", group).agg(F.count(F.lit(1)).alias("cnt"))
    x = counts.join(sizes, "split").withColumn("_total", F.sum("cnt").over(W.partitionBy("split")))
    x = x.withColumn("_q", F.expr("(_want * cnt) div _total")).withColumn("_r", F.expr("(_want * cnt) % _total"))
    seats = F.col("_want") - F.sum("_q").over(W.partitionBy("split"))
    pos = F.row_number().over(W.partitionBy("split").orderBy(F.desc("_r"), group))
    q = x.select("split", group, (F.col("_q") + F.when(pos <= seats, 1).otherwise(0)).alias("_quota"))
    seeded = F.when(F.col("split") == "train", seed).otherwise(seed + 1)
    fit = lowest_digests(pool.withColumn("_h", seeded_hash(uid, seeded)), ["split", group], q, uid).withColumn("role", F.col("split"))
    test = df.where((F.col(group) == held) & (F.col("split") == "test")).withColumn("role", F.lit("eval"))
    return fit.unionByName(test)


def composition_table(roles: DataFrame, value: str, group: str = "grp") -> DataFrame:
    """L4: units and objects per role and group."""
    return roles.groupBy("role", group).agg(F.count(F.lit(1)).alias("n_units"), F.sum(value).cast("bigint").alias("gt_objects"))


def run_role(composition: DataFrame, run: str = "run", group: str = "grp") -> DataFrame:
    """Which group a run held out, and whether it is a left-out run or a control."""
    g = F.col(group)
    per = composition.groupBy(run, group).agg(F.max(F.col("role") == "eval").alias("e"), F.max(F.col("role").isin("train", "val")).alias("f"))
    only = F.col("e") & ~F.col("f")
    got = per.groupBy(run).agg(
        F.count_if(only).alias("n_held"), F.min(F.when(only, g)).alias("held"), F.count_if("e").alias("n_eval"), F.min(F.when(F.col("e"), g)).alias("ev")
    )
    return got.select(
        run,
        F.when(F.col("n_held") == 1, F.col("held")).when(F.col("n_eval") == 1, F.col("ev")).alias("held_group"),
        F.when(F.col("n_held") == 1, "left-out").when(F.col("n_eval") == 1, "control").alias("condition"),
    )


def scoped_pool(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled F1 over all rows and over the test rows."""
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.lower(F.trim("split")) == "test", F.lit("test"))))
    x = runs.withColumn("scope", F.explode(scopes))
    got = x.groupBy(*keys, "scope").agg(
        F.count(F.lit(1)).alias("n_units"), *[F.sum(f"obj_{c}").cast("bigint").alias(c) for c in ("tp", "fp", "fn")]
    )
    return got.withColumn("object_f1", M.f1(F.col("tp"), F.col("fp"), F.col("fn"), 0.0))


def novelty_cost(pools: DataFrame, keys: list[str], a: str = "in-distribution", b: str = "left-out") -> DataFrame:
    """In-distribution minus left-out F1 per key, exact and as displayed, with both sides' ratios."""
    at = lambda cond, c: F.max(F.when(F.col("condition") == cond, F.col(c)))
    got = pools.groupBy(*keys).agg(
        *[at(cond, c).alias(f"{side}_{c}") for side, cond in (("in", a), ("out", b)) for c in ("n_units", "object_f1", "tp", "fp", "fn")]
    ).where("in_object_f1 is not null and out_object_f1 is not null")
    for side in ("in", "out"):
        tp, fp, fn = (F.col(f"{side}_{c}") for c in ("tp", "fp", "fn"))
        got = got.withColumn(f"{side}_precision", ratio(tp, tp + fp)).withColumn(f"{side}_recall", ratio(tp, tp + fn))
    return got.withColumn("cost", F.col("in_object_f1") - F.col("out_object_f1")).withColumn(
        "cost_displayed", F.round("in_object_f1", 3) - F.round("out_object_f1", 3)
    )


def restrict_to_shared(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both runs restricted to the units they share."""
    return a.join(b.select(*keys), keys, "left_semi"), b.join(a.select(*keys), keys, "left_semi")


def run_summary(held: DataFrame, reference: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Held-out against reference metrics; runs with an unexpected unit count keep only the problem."""
    x = held.join(expected, keys[:1], "left").join(
        reference.select(*keys, F.col("obj_f1").alias("ref_f1"), F.col("count_mae").alias("ref_mae")), keys, "left"
    )
    good = F.col("n_units").eqNullSafe(F.col("n_expected"))
    problem = F.when(~good, "unexpected unit count").when(F.col("ref_f1").isNull(), "no reference scoring")
    return x.select(
        *keys, "n_units", problem.alias("problem"),
        F.when(good, F.col("obj_f1")).alias("obj_f1_held_out"), F.when(good, F.col("ref_f1")).alias("obj_f1_reference"),
        F.when(good, F.round(F.col("ref_f1") - F.col("obj_f1"), 4)).alias("obj_f1_gap"),
        F.when(good, F.round(F.col("count_mae") - F.col("ref_mae"), 2)).alias("count_mae_gap"),
    )


def composition_from_runs(comp: DataFrame, group: str = "grp") -> DataFrame:
    """Total from a group's evaluation row, train and val from the other runs, test as the rest."""
    at = lambda r: F.max(F.when(F.col("role") == r, F.col("n_units")))
    got = comp.groupBy(group).agg(at("eval").alias("total"), at("train").alias("train"), at("val").alias("val"))
    return got.withColumn("test", F.col("total") - F.col("train") - F.col("val"))


def best_epoch(history: DataFrame, keys: list[str], metrics: list[str], loss: str = "val_loss", epoch: str = "epoch") -> DataFrame:
    """The history in long form, rows of the epoch with the smallest validation loss marked."""
    best = history.groupBy(*keys).agg(F.min(F.struct(F.col(loss), F.col(epoch))).alias("_b")).select(*keys, F.col(f"_b.{epoch}").alias("_best"))
    long = join_keys(history, best, keys).withColumn("is_best", F.col(epoch) == F.col("_best")).drop("_best")
    return long.unpivot([*keys, epoch, "is_best"], metrics, "series", "value")


def capped_sample(df: DataFrame, cap: int, seed: int, uid: str = "uid") -> DataFrame:
    """At most ``cap`` rows drawn without replacement, the same ones for the same seed."""
    return lowest_digests(df.withColumn("_h", seeded_hash(uid, seed)), [], cap, uid)
