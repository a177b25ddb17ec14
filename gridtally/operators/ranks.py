"""Ranks, quantiles and running values that survive one dominating group.

Everything here starts from a histogram: rows are pre-aggregated to one row per (group, value), so a
value held by many rows costs one row. The histogram is checkpointed, which means the source is read once
however many results are taken from it. Groups up to ``BUCKET_ROWS`` distinct values are ranked by a plain
window. When a group is larger, it is cut into ordered buckets at values picked by hash from the group
itself: the cut depends on the data alone, so a lost task that is run again cuts at the same places. There are as many
cuts as the group needs, and a row finds its bucket among them by binary search. Windows then run per bucket; only the
bucket totals (one row per bucket) pass through a window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.session import cut_lineage, join_keys

BUCKET_ROWS = 200_000
#: Steps of the binary search, largest first: enough for a group of 2 ** 24 cuts.
STEPS = [1 << i for i in reversed(range(24))]


def order_buckets(df: DataFrame, keys: list[str], value: str, bucket_rows: int | None = None) -> DataFrame:
    """Add ``_b``, an ordered bucket number: rows of bucket i have smaller values than rows of bucket i+1.

    ``value`` may be any orderable column, also a struct. Rows with equal values share a bucket. Buckets of a large group hold half of
    ``bucket_rows`` values on average, however large the group is.
    """
    bucket_rows = bucket_rows or BUCKET_ROWS
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_rows)
    sizes = sizes.select(*keys, F.lit(max(1, bucket_rows // 2)).alias("_step"))
    narrow = df.select(*keys, value)
    stepped = join_keys(narrow, sizes, keys) if keys else narrow.withColumn("_step", sizes.scalar())
    cuts = (
        stepped.where(F.pmod(F.xxhash64(value), F.col("_step")) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set(value)).alias("_cuts"))
    )
    out = join_keys(df, cuts, keys, "left") if keys else df.withColumn("_cuts", cuts.scalar())
    fits = lambda at: F.coalesce(F.try_element_at("_cuts", at) <= F.col(value), F.lit(False))
    below = F.aggregate(F.array(*[F.lit(i) for i in STEPS]), F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))
    return out.withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def _over(keys: list[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def ranked_histogram(
    df: DataFrame,
    keys: list[str],
    value: str,
    counts: dict[str, Column] | None = None,
    weight: str | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """One row per (keys, value): ``cnt``, extra sums, rows before it, average rank, group size.

    ``counts`` names extra columns summed per value (for instance how many rows come from one arm), and
    ``weight`` a column that says how many observations a row stands for. NULL values are left out, as in
    a rank over observed values.
    """
    extra = counts or {}
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("cnt"), *[F.sum(c).alias(n) for n, c in extra.items()])
    hist = cut_lineage(hist)
    if _largest_group(hist, keys) <= (bucket_rows or BUCKET_ROWS):
        up = _over(keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        out = hist.withColumn("cum_before", F.sum("cnt").over(up) - F.col("cnt")).withColumn("n_total", F.sum("cnt").over(_over(keys)))
    else:
        hist = order_buckets(hist, keys, value, bucket_rows)
        per_bucket = hist.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_bn"))
        up = _over(keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
        offsets = per_bucket.select(*keys, "_b", (F.sum("_bn").over(up) - F.col("_bn")).alias("_off"), F.sum("_bn").over(_over(keys)).alias("n_total"))
        run = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        out = join_keys(hist, offsets, [*keys, "_b"])
        out = out.withColumn("cum_before", F.col("_off") + F.sum("cnt").over(run) - F.col("cnt")).drop("_off", "_b")
    return out.withColumn("avg_rank", F.col("cum_before") + (F.col("cnt") + 1) / F.lit(2.0))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """G1: tie-averaged rank of ``value`` within ``keys``; NULL values get no rank."""
    ranks = ranked_histogram(df, keys, value).select(*keys, value, F.col("avg_rank").alias(out))
    return join_keys(df, ranks, [*keys, value], "left")


def exact_quantiles(df: DataFrame, keys: list[str], specs: dict[str, tuple[Column, float]], weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles of several columns per group.

    ``specs`` maps an output name to (value column, probability). One pass serves all of them: equal value
    columns share a histogram and different ones travel as one long table.
    """
    variables: dict[str, int] = {}
    cols: list[Column] = []
    plan = []
    for name, (col, p) in specs.items():
        token = str(col)
        if token not in variables:
            variables[token] = len(cols)
            cols.append(col)
        plan.append((name, variables[token], float(p)))
    carried = [F.col(weight).alias("_w")] if weight else []
    long = df.select(
        *keys, *carried,
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("v"), c.cast("double").alias("x")) for i, c in enumerate(cols)])
        ).alias("_s"),
    ).select(*keys, *(["_w"] if weight else []), F.col("_s.v").alias("_v"), F.col("_s.x").alias("_x"))
    hist = ranked_histogram(long, [*keys, "_v"], "_x", weight="_w" if weight else None)
    aggs = []
    for i, (_, v, p) in enumerate(plan):
        pos = F.lit(p) * (F.col("n_total") - 1)
        mine = F.col("_v") == v
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("cum_before") <= at) & (at < F.col("cum_before") + F.col("cnt"))
            aggs.append(F.max(F.when(mine & inside, F.col("_x"))).alias(f"_{tag}{i}"))
        aggs.append(F.max(F.when(mine, pos - F.floor(pos))).alias(f"_f{i}"))
    got = hist.groupBy(*keys).agg(*aggs)
    return got.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name)
            for i, (name, _, _) in enumerate(plan)
        ],
    )


def agg_with_quantiles(
    df: DataFrame, keys: list[str], aggs: list[Column], specs: dict[str, tuple[Column, float]]
) -> DataFrame:
    """Plain aggregates and exact quantiles of the same groups, side by side."""
    if not specs:
        return df.groupBy(*keys).agg(*aggs)
    return join_keys(df.groupBy(*keys).agg(*aggs), exact_quantiles(df, keys, specs), keys, "left")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: dict[str, tuple[str, str]],
    descending: bool = False,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Running ``min``, ``max``, ``sum`` or ``count`` along a total order of the rows of a group.

    ``out`` maps an output column to (function name, input column). The order columns must identify a row.
    Descending runs from the last row back, which gives suffix aggregates.
    """
    fn = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    rows = cut_lineage(df.withColumn("_o", F.struct(*order)))
    turn = F.desc if descending else F.asc
    if _largest_group(rows, keys) <= (bucket_rows or BUCKET_ROWS):
        inside = _over(keys).orderBy(turn("_o")).rowsBetween(W.unboundedPreceding, 0)
        return rows.select("*", *[fn[f](c).over(inside).alias(n) for n, (f, c) in out.items()]).drop("_o")
    rows = order_buckets(rows, keys, "_o", bucket_rows)
    per = rows.groupBy(*keys, "_b").agg(*[fn[f](c).alias(f"_t_{n}") for n, (f, c) in out.items()])
    b_order = _over(keys).orderBy(turn("_b"))
    before = b_order.rowsBetween(W.unboundedPreceding, -1)
    merge = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
    offs = per.select(
        *keys, "_b", *[merge[f](f"_t_{n}").over(before).alias(f"_p_{n}") for n, (f, _) in out.items()]
    )
    inside = W.partitionBy(*keys, "_b").orderBy(turn("_o"))
    inside = inside.rowsBetween(W.unboundedPreceding, 0)
    join = {
        "min": lambda a, b: F.least(a, b),
        "max": lambda a, b: F.greatest(a, b),
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    }
    got = join_keys(rows, offs, [*keys, "_b"])
    for n, (f, c) in out.items():
        got = got.withColumn(n, join[f](fn[f](c).over(inside), F.col(f"_p_{n}")))
    return got.drop("_o", "_b", *[f"_p_{n}" for n in out])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "rn", bucket_rows: int | None = None) -> DataFrame:
    """Row number along a total order, computed per ordered bucket."""
    one = df.withColumn("_one", F.lit(1))
    return running(one, keys, order, {out: ("count", "_one")}, bucket_rows=bucket_rows).drop("_one")


# ---- G operators -------------------------------------------------------------------------------


def running_best(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "best") -> DataFrame:
    """Best value seen so far along the order."""
    return running(df, keys, order, {out: ("max", value)})


def share_of_total(df: DataFrame, keys: list[str], value: str, out: str = "pct") -> DataFrame:
    """Percentage of the group total that a row holds."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    joined = join_keys(df, totals, keys)
    return joined.withColumn(out, F.try_divide(100.0 * F.col(value), F.col("_total"))).drop("_total")


def group_min_compare(df: DataFrame, keys: list[str], value: str, out: str = "above_min") -> DataFrame:
    """Whether a row lies above the minimum of its group."""
    lows = df.groupBy(*keys).agg(F.min(value).alias("_low"))
    return join_keys(df, lows, keys).withColumn(out, F.col(value) > F.col("_low")).drop("_low")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; combines on the map side instead of sorting whole groups."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.min(F.struct(*[F.col(c) for c in order if c not in keys], *[F.col(c) for c in rest])).alias("_f")
    return df.groupBy(*keys).agg(pick).select(*keys, "_f.*").select(*df.columns)


def first_n_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows per group; the rank limit is applied before the shuffle as well."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def spread_check(df: DataFrame, keys: list[str], value: str, tol: float = 0.0) -> DataFrame:
    """Spread of a value within each group and whether it stays within ``tol``."""
    return (
        df.groupBy(*keys)
        .agg((F.max(value) - F.min(value)).alias("spread"))
        .withColumn("within_tol", F.col("spread") <= tol)
    )


def ordered_display(df: DataFrame, ranks: dict[str, list[str]], then: list) -> DataFrame:
    """Order rows by the listed position of category values, then by further columns."""
    first = [F.coalesce(F.array_position(F.array(*[F.lit(v) for v in vs]), F.col(c)), F.lit(0)) for c, vs in ranks.items()]
    return df.orderBy(*first, *then)


def decomposition_steps(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Difference of each step to the one before it (steps are few per key)."""
    w = W.partitionBy(*keys).orderBy(step)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))
