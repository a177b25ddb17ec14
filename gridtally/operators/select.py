"""Filters, limits and set operations (C, I, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.operators.ranks import exact_quantiles, first_n_per_group
from gridtally.session import cut_lineage, join_keys


def filter_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def filter_group(df: DataFrame, groups: str | list[str], col: str = "grp") -> DataFrame:
    return df.where(F.col(col).isin(*([groups] if isinstance(groups, str) else groups)))


def filter_with_roi(df: DataFrame, col: str) -> DataFrame:
    """Rows that name a region."""
    return df.where(F.col(col).isNotNull() & (F.trim(F.col(col).cast("string")) != ""))


def filter_passing(df: DataFrame, flags: list[str]) -> DataFrame:
    """A missing flag counts as a pass."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(True)) for f in flags]))


def filter_consistent(df: DataFrame, flag: str) -> DataFrame:
    """A missing flag counts as a failure."""
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


#: Keys whose group one task finds.
GROUP_ROWS = 20_000


def bucket_by_group(df: DataFrame, uid: str, group: Column, unknown: str | None = None) -> DataFrame:
    """C4: membership of keys in groups as (grp, uid, n_in_group) rows.

    One row per member instead of one list per group: a group may hold a third of the data. Finding the group of a key is
    most of the work, so it is dealt by rows and done once.
    """
    g = group if unknown is None else F.coalesce(group, F.lit(unknown))
    dealt = df.repartition(max(8, -(-df.count() // GROUP_ROWS)))
    rows = cut_lineage(dealt.select(g.alias("grp"), F.col(uid).alias("uid"))).where(F.col("grp").isNotNull())
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n_in_group"))
    return join_keys(rows, sizes, ["grp"])


def select_subset(
    rows: DataFrame,
    criteria: Column,
    group: str,
    uid: str,
    path: str,
    max_per_group: int | None = None,
    wanted: Column | None = None,
    support: Column | None = None,
) -> DataFrame:
    """Choose units by criteria (first ids per group), then their rows in the wanted sections, plus support files."""
    units = rows.where(criteria).select(group, uid).distinct()
    if max_per_group is not None:
        units = first_n_per_group(units, [group], [uid], max_per_group)
    chosen = rows.join(units.select(uid).distinct(), uid, "left_semi")
    if wanted is not None:
        chosen = chosen.where(wanted)
    if support is not None:
        chosen = chosen.unionByName(rows.where(support))
    return chosen.dropDuplicates([path])


def scope_filter(df: DataFrame, keys: list[str], min_n: int) -> DataFrame:
    """Drop groups with fewer than ``min_n`` rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n).drop("_n")
    return join_keys(df, big, keys)


# ---- I: sorts and limits -----------------------------------------------------------------------


def top_k_models(df: DataFrame, k: int = 3, metric: str = "count_mae") -> DataFrame:
    """The best models by an error, smallest first."""
    return df.orderBy(F.asc(metric), "model").limit(k)


def worst_cases(df: DataFrame, value: str, uid: str, n: int = 15) -> DataFrame:
    """The rows with the smallest values."""
    return df.orderBy(F.asc(value), uid).limit(n)


def preview_violations(df: DataFrame, violation: Column, order: list[str], n: int = 10) -> DataFrame:
    """The first offending rows, for a message."""
    return df.where(violation).orderBy(*order).limit(n)


def representative_pick(df: DataFrame, group: str, value: str, uid: str) -> DataFrame:
    """I4: per group the unit closest to the group median; ties by value, then id."""
    med = exact_quantiles(df, [group], {"group_median": (F.col(value), 0.5)})
    x = join_keys(df.where(F.col(value).isNotNull()), med, [group])
    gap = F.abs(F.col(value) - F.col("group_median"))
    best = x.groupBy(group).agg(F.min(F.struct(gap.alias("gap"), F.col(value), F.col(uid), F.col("group_median"))).alias("b"))
    return best.select(group, f"b.{uid}", f"b.{value}", "b.group_median", "b.gap")


# ---- J: set operations -------------------------------------------------------------------------


def append_truth_series(df: DataFrame, reference_model: str, label: str = "truth") -> DataFrame:
    """The truth counts of one model's rows added as one more model."""
    truth = df.where(F.col("model") == reference_model).withColumn("model", F.lit(label)).withColumn("pred_count", F.col("gt_count"))
    return df.unionByName(truth)


def key_universe(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """Union, intersection or one-sided difference of two key sets."""
    if mode == "union":
        return a.union(b).distinct()
    if mode == "intersection":
        return a.intersect(b)
    if mode == "only_a":
        return a.subtract(b)
    if mode == "only_b":
        return b.subtract(a)
    raise ValueError(f"unknown mode {mode!r}")


def overlaps(lists: dict[str, DataFrame], uid: str) -> DataFrame:
    """Number of shared ids of every pair of lists, from one shuffle over all lists."""
    names = list(lists)
    tagged = reduce(
        lambda x, y: x.unionByName(y), [d.select(F.col(uid).alias("uid"), F.lit(i).alias("i")) for i, d in enumerate(lists.values())]
    )
    per = tagged.groupBy("uid").agg(*[F.max(F.col("i") == i).alias(f"in{i}") for i in range(len(names))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    one = per.agg(*[F.count_if(F.col(f"in{i}") & F.col(f"in{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    return one.select(
        F.explode(
            F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"p{i}_{j}").alias("n_shared")) for i, j in pairs])
        ).alias("s")
    ).select("s.*")


def assert_disjoint(lists: dict[str, DataFrame], uid: str) -> None:
    """Raise when any two lists share an id."""
    bad = [r for r in overlaps(lists, uid).collect() if r["n_shared"]]
    if bad:
        raise ValueError("lists overlap: " + ", ".join(f"{r['a']}/{r['b']}: {r['n_shared']}" for r in bad))


def set_diff_report(a: DataFrame, b: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """Keys in both, only in a, only in b, with the first few examples of each."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).distinct().withColumn("_b", F.lit(True))
    both = x.join(y, key, "full_outer")
    where = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    tagged = both.select(key, where.alias("where"))
    sizes = tagged.groupBy("where").agg(F.count(F.lit(1)).alias("n"))
    shown = first_n_per_group(tagged, ["where"], [key], examples)
    ex = shown.groupBy("where").agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ", ").alias("examples"))
    return sizes.join(ex, "where", "left")


def concat_tidy(parts: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(ids, values, variable, value)
