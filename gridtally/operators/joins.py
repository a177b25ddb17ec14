"""Equi, one-to-one, name-matching, wide and grid joins."""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import perm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.functions import keys as K
from gridtally.operators.ranks import first_n_per_group
from gridtally.session import cut_lineage, join_keys, merged

SPLIT_ORDER = ["train", "val", "test"]


def _unique(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """The rows of ``df``; a repeated key raises an error when it is read.

    The key is aggregated away, so the check rides on the shuffle the join needs anyway.
    """
    rest = [c for c in df.columns if c not in on]
    body = F.struct(*rest) if rest else F.lit(1)
    one = df.groupBy(*on).agg(F.first(body).alias("_r"), F.count(F.lit(1)).alias("_n"))
    message = F.concat(F.lit(f"duplicate key on the {side} side: "), F.concat_ws("/", *[F.col(c).cast("string") for c in on]))
    keep = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(message))
    return one.select(*on, keep.alias("_r")).select(*on, *[F.col("_r")[c].alias(c) for c in rest])


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that fails when either side repeats a key."""
    return _unique(left, on, "left").join(_unique(right, on, "right"), on, how)


PREFERRED = ["unique_id", "cell_line", "split", "gt_count", "point_count"]


def build_master(meta: DataFrame, counts: DataFrame, splits: dict[str, DataFrame], paths: list[str]) -> DataFrame:
    """Metadata with counts, split flags and presence flags, known columns first."""
    tagged = reduce(lambda a, b: a.unionByName(b), [d.select("unique_id", F.lit(s).alias("_s")) for s, d in splits.items()])
    flags = tagged.groupBy("unique_id").agg(*[F.max(F.col("_s") == s).alias(f"in_{s}_ids") for s in SPLIT_ORDER])
    df = join_one_to_one(meta, counts, ["unique_id"]).join(flags, "unique_id", "left")
    for s in SPLIT_ORDER:
        df = df.withColumn(f"in_{s}_ids", F.coalesce(f"in_{s}_ids", F.lit(False)))
    listed = reduce(lambda acc, s: F.when(F.col(f"in_{s}_ids"), s).otherwise(acc), reversed(SPLIT_ORDER), F.lit("missing"))
    df = (
        df.withColumn("n_split_flags", reduce(lambda a, b: a + b, [F.col(f"in_{s}_ids").cast("int") for s in SPLIT_ORDER]))
        .withColumn("split_from_id_csv", listed)
        .withColumn("split", F.lower(F.trim("split")))
        .withColumn("split_consistent", F.col("split").eqNullSafe(F.col("split_from_id_csv")))
    )
    for p in paths:
        df = df.withColumn(f"has_{p}", F.col(p).isNotNull() & (F.trim(p) != ""))
    first = [c for c in PREFERRED if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def attach_authoritative_counts(df: DataFrame, counts: DataFrame, lists: DataFrame, stale: list[str]) -> DataFrame:
    """D3: replace stale count columns by the authoritative ones and fill the split from the lists."""
    got = join_one_to_one(df.drop(*stale), counts, ["unique_id"])
    listed = lists.groupBy("unique_id").agg(F.min("split").alias("_listed"))
    got = got.join(listed, "unique_id", "left")
    return (
        got.withColumn("split_mismatch", F.col("split").isNotNull() & F.col("_listed").isNotNull() & (F.col("split") != F.col("_listed")))
        .withColumn("split", F.coalesce("split", "_listed"))
        .drop("_listed")
    )


def lookup_join(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Attributes of a dimension; Spark broadcasts the dimension when its size allows."""
    return df.join(dim, on, "left")


def unmapped(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Keys without a dimension row, with their counts; keys are counted before the join."""
    return df.groupBy(on).agg(F.count(F.lit(1)).alias("n")).join(dim.select(on), on, "left_anti")


def match_by_stem(ids: DataFrame, files: DataFrame, suffixes: list[str], uid: str = "uid", path: str = "path") -> DataFrame:
    """Exact stem first, then stem plus suffix in list order, without regard to case."""
    stems = files.select(F.lower(K.drop_extension(K.basename(F.col(path)))).alias("_k"), F.col(path).alias("matched"))
    stems = stems.groupBy("_k").agg(F.min("matched").alias("matched"))
    tries = F.array(*[F.struct(F.lit(i).alias("tier"), F.lower(F.concat(F.col(uid), F.lit(s))).alias("k")) for i, s in enumerate(["", *suffixes])])
    hit = (
        ids.select(uid).distinct().select(uid, F.explode(tries).alias("t")).select(uid, "t.tier", F.col("t.k").alias("_k"))
        .join(merged(stems), "_k")
        .groupBy(uid)
        .agg(F.min(F.struct("tier", "matched")).alias("m"))
    )
    return ids.join(merged(hit.select(uid, "m.tier", "m.matched")), uid, "left")


def _first_with_prefix(uids: DataFrame, index: DataFrame) -> DataFrame:
    """The first key that starts with each uid (u, k, matched): a prefix is an interval whose first key is its successor.

    Distinct uids and keys are put in one order by range, and every uid takes the nearest key not below it, from its own
    range or the first key of a later one. No name is cut, and a uid that begins many keys costs one row.
    """
    none = F.lit(None).cast("struct<k:string,matched:string>")
    keys = index.where("k is not null").select(F.col("k").alias("o"), F.struct("k", "matched").alias("key"))
    both = keys.unionByName(uids.where("u is not null").select(F.col("u").alias("o"), none.alias("key")))
    dealt = cut_lineage(both.repartitionByRange(F.col("o")).withColumn("part", F.spark_partition_id()))
    # downwards, so that the frame only looks back
    down = W.partitionBy("part").orderBy(F.desc("o"), F.col("key").isNull()).rowsBetween(W.unboundedPreceding, 0)
    near = dealt.withColumn("next", F.last("key", True).over(down)).where("key is null")
    firsts = dealt.groupBy("part").agg(F.min("key").alias("low"))
    later = W.partitionBy(F.lit(0)).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select("part", F.last("low", True).over(later).alias("later"))
    hit = near.join(firsts, "part").select(F.col("o").alias("u"), F.coalesce("next", "later").alias("key"))
    return hit.where(F.col("key.k").startswith(F.col("u"))).select("u", "key.k", "key.matched")


def match_by_canonical_key(ids: DataFrame, files: DataFrame, uid: str = "uid", path: str = "path") -> DataFrame:
    """Canonical key, key without a trailing letter, first key starting with the uid, literal ``uid_LE``."""
    index = (
        files.select(K.canonical_key(K.drop_extension(K.basename(F.col(path)))).alias("k"), F.col(path).alias("matched"))
        .groupBy("k").agg(F.min("matched").alias("matched"))
    )
    u = ids.select(uid).distinct().withColumn("ck", K.canonical_key(F.col(uid)))
    tries = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("tier"), F.col("ck").alias("k")),
            F.when(F.col("ck").rlike("_[abfs]$"), F.struct(F.lit(2).alias("tier"), F.regexp_replace("ck", "_[abfs]$", "").alias("k"))),
        )
    )
    direct = u.select(uid, F.explode(tries).alias("t")).select(uid, "t.*").join(merged(index), "k").select(uid, "tier", "k", "matched")
    left = u.join(merged(direct.select(uid).distinct()), uid, "left_anti").select(uid, F.lower(uid).alias("u"))
    starts = _first_with_prefix(left.select("u").distinct(), index).join(merged(left), "u").select(uid, F.lit(3).alias("tier"), "k", "matched")
    literal = (
        files.select(K.drop_extension(K.basename(F.col(path))).alias("_stem"), F.col(path).alias("matched"))
        .join(merged(left.select(uid, F.concat(F.col(uid), F.lit("_LE")).alias("_stem"))), "_stem")
        .select(uid, F.lit(4).alias("tier"), F.col("_stem").alias("k"), "matched")
    )
    best = direct.unionByName(starts).unionByName(literal).groupBy(uid).agg(F.min(F.struct("tier", "k", "matched")).alias("m"))
    return ids.join(merged(best.select(uid, "m.tier", "m.matched")), uid, "left")


def match_by_tokens(ids: DataFrame, files: DataFrame, uid: str = "uid", path: str = "path", jaccard_min: float = 0.95) -> DataFrame:
    """Same file across naming styles by token similarity.

    Exact normalised names win. Otherwise the side tag and last number of the uid must agree and the token
    sets reach the Jaccard minimum. Sets too small to differ and still reach it are joined on equality;
    larger ones on their rarest tokens over both tables, as few as any partner must share one of, and only where the sizes
    and the places of the shared token leave room for the minimum. Features are computed once per table.
    """
    t = float(jaccard_min)

    def features(df: DataFrame, src: str, name: str) -> DataFrame:
        x = df.select(F.col(src).alias(name)).distinct().withColumn("n", K.normalise_uid(F.col(name)))
        x = x.withColumn("toks", F.array_sort(F.array_distinct(K.tokens(F.col("n"))))).withColumn("size", F.size("toks"))
        return cut_lineage(x.withColumn("side", K.side_tag(F.col("n"))).withColumn("num", K.last_number(F.col("n"))))

    size = F.col("size")
    rigid = (F.floor(size / F.lit(t) + 1e-9) == size) & (F.ceil(size * F.lit(t) - 1e-9) == size)

    def probes(x: DataFrame, name: str) -> DataFrame:
        """(name, probe, place): the whole set of a rigid name, else its rarest tokens by place."""
        whole = x.where(rigid).select(name, F.array_join("toks", " ").alias("probe"), F.lit(1).alias("place"))
        each = x.where(~rigid).select(name, "size", F.explode("toks").alias("probe")).join(merged(counts), "probe")
        ranked = each.groupBy(name, "size").agg(F.array_sort(F.collect_list(F.struct("c", "probe"))).alias("o"))
        prefix = F.slice("o", F.lit(1), F.greatest((size - F.ceil(size * F.lit(t) - 1e-9) + 1).cast("int"), F.lit(1)))
        return whole.unionByName(ranked.select(name, F.posexplode(prefix)).select(name, F.col("col.probe").alias("probe"), (F.col("pos") + 1).alias("place")))

    a, b = features(ids, uid, "u"), features(files, path, "p")
    renamed = b.select("p", *[F.col(c).alias(f"f_{c}") for c in ("n", "toks", "side", "num", "size")])
    exact = a.join(merged(renamed), F.col("n") == F.col("f_n")).groupBy("u").agg(F.min("p").alias("matched")).withColumn("score", F.lit(2.0))
    rest = a.join(merged(exact.select("u")), "u", "left_anti")
    held = [x.where(~rigid).select(F.explode("toks").alias("probe")) for x in (a, b)]
    counts = cut_lineage(held[0].unionByName(held[1]).groupBy("probe").agg(F.count(F.lit(1)).alias("c")))
    mine = rest.join(merged(probes(rest, "u")), "u")
    theirs = renamed.join(merged(probes(b, "p").withColumnRenamed("place", "f_place")), "p")
    least = lambda x, y: F.ceil((x + y) * F.lit(t / (1 + t)) - 1e-9)
    room = F.least(F.col("size") - F.col("place"), F.col("f_size") - F.col("f_place")) + 1 >= least(F.col("size"), F.col("f_size"))
    numbered = mine.where("num is not null").join(merged(theirs.withColumnRenamed("f_num", "num")), ["probe", "num"])
    bare = mine.where("num is null").drop("num").join(merged(theirs.drop("f_num")), "probe")
    cand = numbered.drop("num").unionByName(bare).where((rigid | room) & (F.col("side").isNull() | (F.col("side") == F.col("f_side"))))
    jac = F.size(F.array_intersect("toks", "f_toks")) / F.size(F.array_union("toks", "f_toks"))
    cand = cand.withColumn("jac", jac).where(F.col("jac") >= t)
    score = F.col("jac") - 0.01 * F.abs(F.length("f_n") - F.length("n"))
    best = cand.groupBy("u").agg(F.min(F.struct((-score).alias("s"), F.col("p"))).alias("m"))
    got = exact.select("u", "matched", "score").unionByName(best.select("u", F.col("m.p").alias("matched"), (-F.col("m.s")).alias("score")))
    return ids.join(merged(got.withColumnRenamed("u", uid)), uid, "left")


#: Letters of a piece in the index of names.
GRAM = 3


def match_unique_contained(ids: DataFrame, stems: DataFrame, uid: str = "uid", stem: str = "stem") -> DataFrame:
    """Exact stem if single, else the only stem that contains the uid; ambiguity is reported.

    An inverted index of the stems' GRAM-letter pieces is probed by each uid's rarest piece, and the hits are verified, so
    only pieces of one length are written and common ones are not probed. A uid of up to GRAM letters is a piece itself: the stems that hold it
    are only counted, with partial counts on the map side, so one that is in every stem stays cheap. An empty uid is contained in nothing.
    """
    s = stems.groupBy(F.col(stem).alias("k")).agg(F.count(F.lit(1)).alias("n_files"))
    u = ids.select(F.col(uid).alias("u")).distinct()
    exact = u.join(merged(s), F.col("u") == F.col("k")).select(
        "u", F.when(F.col("n_files") == 1, F.col("k")).alias("matched"), F.when(F.col("n_files") == 1, "exact").otherwise("ambiguous-exact").alias("status")
    )
    left = cut_lineage(u.join(merged(exact.select("u")), "u", "left_anti").where(F.length("u") > 0))
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n)))
    counted = lambda g: g.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("k"), F.min("n_files").alias("n_files"))
    found, lengths = [], {r[0] for r in left.select(F.least(F.length("u"), F.lit(GRAM + 1))).distinct().collect()}  # GRAM + 1 rows at most
    for n in sorted(lengths & set(range(1, GRAM + 1))):
        whole = left.where(F.length("u") == n).withColumnRenamed("u", "g")
        index = s.where(F.length("k") >= n).select("k", "n_files", F.explode(pieces("k", n)).alias("g"))
        found.append(counted(index.join(merged(whole), "g", "left_semi")).withColumnRenamed("g", "u"))
    if GRAM + 1 in lengths:
        long = left.where(F.length("u") > GRAM).select("u", F.explode(pieces("u", GRAM)).alias("g"))
        index = s.where(F.length("k") > GRAM).select("k", "n_files", F.explode(pieces("k", GRAM)).alias("g"))
        held = index.join(merged(long.select("g").distinct()), "g", "left_semi")
        sizes = held.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
        # A piece that no stem has settles the uid: it is missing.
        rarest = long.join(merged(sizes), "g", "left").groupBy("u").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "g")).alias("m"))
        probes = rarest.where("m.size > 0").select("u", F.col("m.g").alias("g"))
        hits = held.join(merged(probes), "g").where(F.contains("k", "u")).select("k", "n_files", F.col("u").alias("g"))
        found.append(counted(hits).withColumnRenamed("g", "u"))
    if not found:
        found.append(counted(s.limit(0).select("k", "n_files", F.col("k").alias("g"))).withColumnRenamed("g", "u"))
    inside = reduce(DataFrame.unionByName, found)
    only = (F.col("c") == 1) & (F.col("n_files") == 1)
    told = inside.select("u", F.when(only, F.col("k")).alias("matched"), F.when(only, "contained").otherwise("ambiguous").alias("status"))
    got = exact.unionByName(told).withColumnRenamed("u", uid)
    return ids.join(merged(got), uid, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def resolve_unit_files(ids: DataFrame, modalities: dict[str, tuple[DataFrame, list[str]]], uid: str = "uid") -> DataFrame:
    """One row per unit with the matched file of every modality and its group."""
    got, keys = ids, ids.select(uid).distinct()
    for name, (files, suffixes) in modalities.items():
        hit = match_by_stem(keys, files, suffixes, uid).select(uid, F.col("matched").alias(f"{name}_path"))
        got = got.join(merged(hit), uid, "left")
    return got.withColumn("grp", K.infer_group(F.col(uid)))


def paired_wide(df: DataFrame, key: str, by: str, value: str, values: list[str]) -> DataFrame:
    """One column per method, complete rows only, and the difference of the first two."""
    wide = df.groupBy(key).agg(*[F.first(F.when(F.col(by) == v, F.col(value)), ignorenulls=True).alias(f"v_{v}") for v in values])
    wide = wide.dropna(subset=[f"v_{v}" for v in values])
    return wide.withColumn("delta", F.col(f"v_{values[1]}") - F.col(f"v_{values[0]}"))


def paired_runs(a: DataFrame, b: DataFrame, keys: list[str], tags: tuple[str, str] = ("a", "b"), deltas: list[str] | None = None) -> DataFrame:
    """Two runs side by side, one-to-one, with differences of the chosen columns."""

    def tag(df: DataFrame, t: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{c}_{t}") for c in df.columns if c not in keys])

    got = join_one_to_one(tag(a, tags[0]), tag(b, tags[1]), keys, "inner")
    for c in deltas or []:
        got = got.withColumn(f"d_{c}", F.col(f"{c}_{tags[1]}") - F.col(f"{c}_{tags[0]}"))
    return got


def outer_compare(frozen: DataFrame, rebuilt: DataFrame, keys: list[str], cols: list[str], tol: float) -> DataFrame:
    """Largest difference per column over an outer join; a missing side or value fails."""
    a = frozen.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(True).alias("_ina"))
    b = rebuilt.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_inb"))
    both = a.join(b, keys, "full_outer")
    one_side = F.col("_ina").isNull() | F.col("_inb").isNull()
    aggs = []
    for c in cols:
        d = F.abs(F.col(f"_a_{c}").cast("double") - F.col(f"_b_{c}").cast("double"))
        aggs += [F.max(d).alias(f"m_{c}"), F.count_if(d.isNull()).alias(f"n_{c}")]
    one = both.agg(F.count_if(one_side).alias("_one"), *aggs)
    return one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.col(f"m_{c}").alias("max_abs_delta"), F.col(f"n_{c}").alias("n_missing"), F.col("_one").alias("n_one_sided"),
                        (F.coalesce(F.col(f"m_{c}") <= tol, F.lit(False)) & (F.col(f"n_{c}") == 0)).alias("ok"),
                    )
                    for c in cols
                ]
            )
        ).alias("s")
    ).select("s.*")


def parameter_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """The Cartesian product of parameter values as a table (built from the arguments, not from data)."""
    names = list(axes)
    rows = [tuple(v) for v in product(*axes.values())]
    kind = {float: "double", int: "int", str: "string"}
    return spark.createDataFrame(rows, ", ".join(f"{n} {kind[type(axes[n][0])]}" for n in names))


def cross_grid(units: DataFrame, **axes: list) -> DataFrame:
    """Every unit at every grid point, by exploding literal arrays in place: no join and no shuffle."""
    out = units
    for name, vals in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return out


def grid_permutations(ops: DataFrame, min_len: int, max_len: int, limit: int | None = None) -> DataFrame:
    """Ordered arrangements of distinct operations, in input order, as ``combo`` arrays.

    ``ops`` has ``op`` and its position ``ord``: a short list of names, whose arrangements are numbered. A range of numbers is dealt
    to the tasks, and each number is turned into its arrangement by division, so tasks are even and a ``limit`` makes no
    more rows than it asks for.
    """
    names = ops.orderBy("ord").collect()  # the parameter list, one row per operation
    n, lengths, total = len(names), [], 0
    for k in range(min_len, max_len + 1):
        count = perm(n, k) if k else 1
        if limit is not None:
            count = min(count, limit - total)
        if count > 0:
            lengths.append((k, count))
        total += max(count, 0)
    spark = ops.sparkSession
    table = F.array(*[F.lit(r["op"]) for r in names]) if n else F.array().cast("array<string>")
    parts = []
    for k, count in lengths:
        free, combo, rest = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>"), [], F.col("id")
        picks = spark.range(count)
        for i in range(k):  # digit i chooses among the n - i names that are left
            block = perm(n - i - 1, k - i - 1)
            at = F.floor(rest / F.lit(block)).cast("int")
            picks = picks.withColumn(f"at{i}", at).withColumn("free", free).withColumn(f"pick{i}", F.element_at("free", F.col(f"at{i}") + 1))
            picks = picks.withColumn("left", F.array_remove("free", F.col(f"pick{i}"))).withColumn("rest", F.pmod(rest, F.lit(block)))
            free, rest = F.col("left"), F.col("rest")
            combo.append(F.element_at(table, F.col(f"pick{i}") + 1))
        parts.append(picks.select(F.lit(k).alias("k"), (F.array(*combo) if combo else F.array().cast("array<string>")).alias("combo")))
    if not parts:
        return spark.range(0).select(F.lit(0).alias("k"), F.array().cast("array<string>").alias("combo"), F.lit("").alias("combo_id"))
    got = reduce(DataFrame.unionByName, parts)
    return got.select("k", "combo", K.combo_id(F.col("combo")).alias("combo_id"))
