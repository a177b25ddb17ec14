"""Data-quality and reconciliation operators (K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions import keys as K
from gridtally.functions import metrics as M
from gridtally.operators.joins import join_one_to_one
from gridtally.operators.ranks import agg_with_quantiles, first_n_per_group, running
from gridtally.session import join_keys, merged, ratio

MODALITIES = ["rgb", "dapi", "roi", "gt"]
#: Rows of each side that one task of an audit joins and sorts.
TASK_ROWS = 500_000


def tasks_for(rows: int) -> int:
    """Tasks among which so many rows are dealt, so that what one of them holds does not grow with the tables."""
    return max(8, -(-rows // TASK_ROWS))


def require_columns(df: DataFrame, cols: list[str], what: str = "table") -> DataFrame:
    """K1: fail with the columns found when one is missing; looks at the schema only."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}; found {df.columns}")
    return df


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """K1: the first candidate that exists, compared without case."""
    lower = {c.lower(): c for c in df.columns}
    return next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def duplicate_rows(df: DataFrame, key: list[str], examples: int = 20) -> DataFrame:
    """K2: keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: list[str], examples: int = 20) -> DataFrame:
    """K2: raise with some of the repeated keys."""
    bad = duplicate_rows(df, key).orderBy(*key).limit(examples).collect()
    if bad:
        raise ValueError(f"duplicate {key}: " + ", ".join(str(tuple(r[k] for k in key)) for r in bad))
    return df


def file_audit(units: DataFrame, facts: DataFrame) -> DataFrame:
    """K3: existence, readability, shapes and emptiness of the four files of a unit.

    ``units``: uid and one path column per modality. ``facts``: path, readable, h, w, nonzero (and
    masked_nonzero for the colour image inside the region).
    """
    return _audited(units, facts, tasks_for(len(MODALITIES) * units.count()))


def _audited(units: DataFrame, facts: DataFrame, tasks: int) -> DataFrame:
    """``file_audit`` in so many tasks, by path and then by unit."""
    long = units.select(
        "uid", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"{m}_path").alias("path")) for m in MODALITIES])).alias("s")
    ).select("uid", "s.*")
    seen = long.repartition(tasks, "path").join(merged(facts.withColumn("_e", F.lit(True)).repartition(tasks, "path")), "path", "left")
    seen = seen.select("uid", "m", "_e", "readable", "h", "w", "nonzero").repartition(tasks, "uid")
    ok = F.coalesce(F.col("readable"), F.lit(False))
    wide = seen.groupBy("uid").agg(
        *[F.max(F.when(F.col("m") == m, F.coalesce("_e", F.lit(False)))).alias(f"{m}_exists") for m in MODALITIES],
        *[F.max(F.when(F.col("m") == m, ok)).alias(f"{m}_read_ok") for m in MODALITIES],
        *[F.max(F.when((F.col("m") == m) & ok, F.col(c))).alias(f"{m}_{c}") for m in MODALITIES for c in ("h", "w", "nonzero")],
    )
    ok_all = reduce(lambda a, b: a & b, [F.col(f"{m}_read_ok") for m in MODALITIES])
    same = reduce(lambda a, b: a & b, [(F.col("rgb_h") == F.col(f"{m}_h")) & (F.col("rgb_w") == F.col(f"{m}_w")) for m in MODALITIES[1:]])
    roi_fits = F.col("rgb_read_ok") & F.col("roi_read_ok") & (F.col("rgb_h") == F.col("roi_h")) & (F.col("rgb_w") == F.col("roi_w"))
    out = (
        wide.withColumn("shapes_match_all", F.coalesce(ok_all & same, F.lit(False)))
        .withColumn("roi_nonempty", F.coalesce(F.col("roi_nonzero") > 0, F.lit(False)))
        .withColumn("gt_nonempty", F.coalesce(F.col("gt_nonzero") > 0, F.lit(False)))
        .withColumn("masked_rgb_ok", F.coalesce(roi_fits, F.lit(False)))
    )
    flags = [*[f"{m}_exists" for m in MODALITIES], *[f"{m}_read_ok" for m in MODALITIES], "shapes_match_all", "roi_nonempty", "masked_rgb_ok"]
    return out.withColumn("file_audit_pass", reduce(lambda a, b: a & b, [F.col(f) for f in flags]))


def count_mask_consistency(df: DataFrame, count: str, nonempty: str) -> DataFrame:
    """K4: a zero count goes with an empty mask and a positive one with foreground."""
    n = F.expr(f"try_cast(`{count}` as double)")
    zero, pos = F.coalesce(n == 0, F.lit(False)), F.coalesce(n > 0, F.lit(False))
    full = F.coalesce(F.col(nonempty), F.lit(False))
    return (
        df.withColumn("zero_count_empty_gt", zero & ~full)
        .withColumn("zero_count_nonempty_gt", zero & full)
        .withColumn("positive_count_empty_gt", pos & ~full)
        .withColumn("positive_count_nonempty_gt", pos & full)
        .withColumn("count_mask_consistent", F.col("zero_count_empty_gt") | F.col("positive_count_nonempty_gt"))
    )


def count_mismatches(master: DataFrame, counts: DataFrame, col: str = "gt_count") -> DataFrame:
    """K5: units whose count in the master differs from the counts table."""
    both = join_one_to_one(master.select("uid", F.col(col).alias("master_count")), counts.select("uid", F.col(col).alias("table_count")), ["uid"], "inner")
    return both.where(~F.col("master_count").eqNullSafe(F.col("table_count")))


def run_qc(master: DataFrame, counts: DataFrame, facts: DataFrame) -> DataFrame:
    """K5: attach or cross-check the counts, then the file audit and the count/mask check."""
    tasks = tasks_for(len(MODALITIES) * master.count())
    if "gt_count" in master.columns:
        bad = count_mismatches(master, counts).orderBy("uid").limit(10).collect()
        if bad:
            raise ValueError("counts disagree: " + ", ".join(f"{r['uid']} {r['master_count']} vs {r['table_count']}" for r in bad))
        full = master
    else:
        full = join_one_to_one(master.repartition(tasks, "uid"), merged(counts.repartition(tasks, "uid")), ["uid"])
    unit = F.struct("uid")  # a null uid equals itself in it
    audited = _audited(full, facts, tasks).withColumn("_u", unit).repartition(tasks, "_u")
    counted = full.select(unit.alias("_u"), "gt_count").repartition(tasks, "_u")
    return count_mask_consistency(audited.join(merged(counted), "_u").drop("_u"), "gt_count", "gt_nonempty")


def coverage_check(status: DataFrame, tol: float = 0.10) -> DataFrame:
    """K6: ok, missing and error counts per method; above the tolerance is an error."""
    got = status.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "missing", "error")]
    )
    share = ratio(F.col("n_missing"), F.col("n"))
    return got.withColumn("missing_share", share).withColumn(
        "verdict", F.when(F.col("missing_share") > tol, "error").when(F.col("n_missing") > 0, "warn").otherwise("ok")
    )


def validate_listing(lines: DataFrame, header: list[str], required: list[str], path_col: str, prefixes: list[str], expected_rows: int | None = None) -> DataFrame:
    """K8: violations of a tab-separated listing given as (line_no, line) rows, one row per rule broken.

    All rules about a single line are tested in one pass; only repeated paths and the row count aggregate.
    """
    width = len(header)
    text = F.trim("line") != ""
    body = F.col("line_no") > 1
    x = lines.withColumn("_c", F.split("line", "\t")).withColumn("_fit", body & text & (F.size("_c") == width))
    field = {h: F.when(F.col("_fit"), F.get("_c", F.lit(i))) for i, h in enumerate(header)}
    p = field[path_col]
    tests = {
        "header": (F.col("line_no") == 1) & (F.col("line") != "\t".join(header)),
        "blank_line": body & ~text,
        "ragged": body & text & (F.size("_c") != width),
        "illegal_path": p.contains("\\") | p.rlike(r"^(/|\./|\.\./)") | p.endswith("/"),
        "disallowed_character": p.rlike(r"[^A-Za-z0-9!\-_.*'()/ ]"),
        "outside_prefix": ~reduce(lambda m, n: m | n, [p.startswith(v) for v in prefixes]),
        **{f"empty_{c}": F.trim(field[c]) == "" for c in required},
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in tests.items()]))
    parts = [x.select(F.explode(broken).alias("rule"), "line_no", "line")]
    fit = x.where("_fit").select("line_no", "line", p.alias(path_col))
    firsts = fit.groupBy(path_col).agg(F.min("line_no").alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts.append(fit.join(firsts, path_col).where("line_no > _f").select(F.lit("duplicate_path").alias("rule"), "line_no", "line"))
    if expected_rows is not None:
        n = x.agg(F.count_if(body & text).alias("n"))
        parts.append(n.where(F.col("n") != expected_rows).select(F.lit("row_count").alias("rule"), F.lit(0).cast("bigint").alias("line_no"), F.col("n").cast("string").alias("line")))
    return reduce(lambda a, b: a.unionByName(b), [x.withColumn("line_no", F.col("line_no").cast("bigint")) for x in parts])


def foreign_key_check(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """K9: referenced values absent from the parent, blanks ignored; values are counted before the join."""
    vals = child.where(F.col(fk).isNotNull() & (F.trim(F.col(fk).cast("string")) != "")).groupBy(F.col(fk).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return vals.join(parent.select(F.col(pk).alias("value")), "value", "left_anti")


def collision_check(lists: DataFrame, path: str, name: str) -> DataFrame:
    """Paths claimed by more than one list."""
    return lists.groupBy(path).agg(F.countDistinct(name).alias("n_lists"), F.min(name).alias("first_list"), F.max(name).alias("last_list")).where("n_lists > 1")


def coverage_exactly_once(parent: DataFrame, child: DataFrame, pk: str, fk: str) -> DataFrame:
    """Parents covered by no child or by several."""
    n = child.groupBy(F.col(fk).alias(pk)).agg(F.count(F.lit(1)).alias("n"))
    got = parent.select(pk).distinct().join(n, pk, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return got.where("n <> 1").withColumn("problem", F.when(F.col("n") == 0, "uncovered").otherwise("covered_twice"))


def total_check(lists: DataFrame, name: str, expected: int) -> DataFrame:
    """Rows per list and the overall total against an expectation."""
    return lists.rollup(name).agg(F.count(F.lit(1)).alias("n")).withColumn("matches", F.when(F.col(name).isNull(), F.col("n") == expected))


def inventory_check(listed: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """Listed but not on disk."""
    return listed.select(key).distinct().join(on_disk.select(key), key, "left_anti")


def build_listings(inventory: DataFrame, counts: DataFrame, splits: DataFrame, routes: dict[str, str], path_of: str = "path") -> DataFrame:
    """Route inventory rows to lists by directory and attach count, split and subset; others are unrouted."""
    route = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in routes.items() for x in kv]), F.col("top_dir")), F.lit("unrouted"))
    return (
        inventory.withColumn("listing", route)
        .join(counts, "uid", "left")
        .join(splits, "uid", "left")
        .withColumn("subset", F.when(F.col("split").isNotNull(), "benchmark").otherwise("extension"))
        .withColumn("split", F.coalesce("split", F.lit("")))
    )


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """First failing check per listed file: missing, size, digest. Accepts either path column name."""
    path = find_column(manifest, ["relpath", "relative_path"])
    if path is None:
        raise ValueError(f"manifest has no path column; found {manifest.columns}")
    m = manifest.select(F.col(path).alias("relpath"), F.col("size_bytes").cast("bigint").alias("_size"), F.col("sha256").alias("_sha"))
    x = m.join(found.select("relpath", "size_bytes", "sha256"), "relpath", "left")
    reason = (
        F.when(F.col("size_bytes").isNull(), "missing")
        .when(F.col("size_bytes") != F.col("_size"), "size_mismatch")
        .when(F.col("sha256") != F.col("_sha"), "digest_mismatch")
    )
    return x.withColumn("reason", reason).where("reason is not null").select("relpath", "reason")


def benchmark_invariants(df: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups whose size or object total differs from the expected table, either side missing included."""
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), F.sum(value).cast("bigint").alias("total"))
    x = join_keys(got, expected.withColumnRenamed("n_units", "exp_units").withColumnRenamed("total", "exp_total"), keys, "full_outer")
    return x.where(~(F.col("n_units").eqNullSafe(F.col("exp_units")) & F.col("total").eqNullSafe(F.col("exp_total"))))


def reconcile_counts(pooled: DataFrame, locked: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Integer differences of pooled counts to the locked ones, rows with any difference only."""
    x = pooled.select(key, *cols).join(locked.select(key, *[F.col(c).alias(f"locked_{c}") for c in cols]), key, "full_outer")
    diff = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"locked_{c}")) for c in cols])
    return x.where(diff)


def verify_published(summary: DataFrame, expected: DataFrame, key: str, digits: dict[str, int]) -> DataFrame:
    """MATCH when a value lies within half a unit of the last published digit."""
    x = expected.join(summary, key, "left")
    rows = [
        F.struct(
            F.lit(c).alias("metric"), F.col(f"pub_{c}").cast("double").alias("published"), F.col(c).cast("double").alias("computed"),
            F.when(F.abs(F.col(c) - F.col(f"pub_{c}")) <= 0.5 * 10.0 ** (-d) + 1e-9, "MATCH").otherwise("DIFFERS").alias("verdict"),
        )
        for c, d in digits.items()
    ]
    return x.select(key, F.explode(F.array(*rows)).alias("s")).select(key, "s.*")


def detect_convention(blocks: DataFrame, tol: float) -> DataFrame:
    """Whether pooled or mean F1 reproduces a published summary; both means pooled, neither is an error."""
    dev = blocks.agg(F.max(F.abs(F.col("f1_pooled") - F.col("f1_published"))).alias("worst_pooled"), F.max(F.abs(F.col("f1_mean") - F.col("f1_published"))).alias("worst_mean"))
    conv = F.when(F.col("worst_pooled") <= tol, "pooled").when(F.col("worst_mean") <= tol, "mean").otherwise(F.raise_error(F.lit("neither pooled nor mean F1 fits the summary")))
    return dev.withColumn("convention", conv)


def rounding_audit(df: DataFrame, a: str, b: str, digits: int) -> DataFrame:
    """Difference of the rounded values against the rounded difference (halves away from zero for positives)."""
    scale = 10.0**digits
    rounded = lambda x: F.floor(x * scale + 0.5) / scale
    x = df.withColumn("diff_of_rounded", rounded(F.col(a)) - rounded(F.col(b))).withColumn("rounded_diff", rounded(F.col(a) - F.col(b)))
    return x.withColumn("disagrees", F.abs(F.col("diff_of_rounded") - F.col("rounded_diff")) > 0.5 / scale)


def label_conflicts(df: DataFrame, uid: str, label: str) -> DataFrame:
    """Units with more than one label."""
    return df.groupBy(uid).agg(F.countDistinct(label).alias("n_labels"), F.min(label).alias("label_a"), F.max(label).alias("label_b")).where("n_labels > 1")


def route_conflicts(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows where two labelling routes disagree."""
    return df.withColumn("label_a", a).withColumn("label_b", b).where(~F.col("label_a").eqNullSafe(F.col("label_b")))


def comparator_check(a: DataFrame, b: DataFrame, key: str, col: str, share: float = 0.95) -> DataFrame:
    """How well the counts of two sources agree."""
    x = a.select(key, F.col(col).alias("_a")).join(b.select(key, F.col(col).alias("_b")), key).withColumn("_one", F.lit(1))
    d = F.col("_b") - F.col("_a")
    aggs = [
        F.count(F.lit(1)).alias("n"), ratio(F.count_if(d == 0), F.count(F.lit(1))).alias("exact_share"), ratio(F.sum("_b"), F.sum("_a")).alias("ratio"),
        F.count_if(d > 0).alias("n_larger"), F.count_if(d < 0).alias("n_smaller"),
    ]
    got = agg_with_quantiles(x, ["_one"], aggs, {"median_delta": (d, 0.5)}).drop("_one")
    return got.withColumn("same_comparator", F.col("exact_share") >= share)


def subset_label(df: DataFrame, uid: str, train: DataFrame, held: DataFrame) -> DataFrame:
    """Seen in training, held out or extension, from two id sets in one shuffle."""
    sets = train.select(F.col(uid), F.lit(True).alias("_t"), F.lit(False).alias("_h")).unionByName(held.select(F.col(uid), F.lit(False).alias("_t"), F.lit(True).alias("_h")))
    flags = sets.groupBy(uid).agg(F.max("_t").alias("_t"), F.max("_h").alias("_h"))
    lab = F.when(F.coalesce("_t", F.lit(False)), "train (seen)").when(F.coalesce("_h", F.lit(False)), "val+test (held-out)").otherwise("extension")
    return df.join(flags, uid, "left").withColumn("subset", lab).drop("_t", "_h")


def missing_predictions(gt: DataFrame, pred: DataFrame, facts: DataFrame, uid: str) -> DataFrame:
    """Truth units without a prediction, with what is known about them."""
    return gt.join(pred.select(uid), uid, "left_anti").join(facts, uid, "left")


def foreground_audit(units: DataFrame, components: DataFrame, min_area: int) -> DataFrame:
    """Foreground area after the area filter per unit, -1 where the mask is missing."""
    got = components.groupBy("uid").agg(F.sum(F.when(F.col("area") >= min_area, F.col("area")).otherwise(0)).cast("bigint").alias("fg"))
    return units.select("uid").join(got, "uid", "left").withColumn("fg", F.coalesce("fg", F.lit(-1).cast("bigint")))


def usable_rows(units: DataFrame, required: list[str], strict: bool = False) -> DataFrame:
    """Reasons why a unit cannot be used (an empty list means usable); strict mode raises instead."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    reasons = F.array_compact(F.array(*[F.when(blank(c), F.lit(f"no {c}")) for c in required]))
    out = units.withColumn("dropped_for", F.array_join(reasons, "; ")).withColumn("usable", F.size(reasons) == 0)
    if strict:
        out = out.withColumn("usable", F.when(F.col("usable"), True).otherwise(F.raise_error(F.col("dropped_for")).cast("boolean")))
    return out


def infer_scope(table: DataFrame, published: DataFrame, tol: float = 0.002) -> DataFrame:
    """Which published scope a table covers: by unit count if that is unique, else by the nearest pooled F1.

    ``published`` is a handful of rows (scope, model, n_units, pub_f1).
    """
    tot = table.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("obj_tp").alias("tp"), F.sum("obj_fp").alias("fp"), F.sum("obj_fn").alias("fn")
    ).withColumn("f1", M.f1(F.col("tp"), F.col("fp"), F.col("fn"), 0.0))
    gap = F.abs(F.col("f1") - F.col("pub_f1"))
    x = tot.select("model", "n", "f1").join(published, "model")
    got = x.groupBy("model", "n", "f1").agg(
        F.min(F.when(F.col("n") == F.col("n_units"), F.col("scope"))).alias("by_n"),
        F.min(F.struct(gap.alias("g"), F.col("scope"))).alias("near"),
    )
    return got.select("model", "n", "f1", F.coalesce("by_n", "near.scope").alias("scope"), F.col("near.g").alias("f1_gap"), (F.col("near.g") > tol).alias("warn"))
