"""Validity, cost, one-to-one assignment and buckets."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.operators.components import graph_components
from gridtally.operators.spatial import distance_pairs, pairwise_geometry, points_in_box
from gridtally.session import cut_lineage, join_keys

# Matching parameters.
D_MAX, IOU_MIN, ALPHA = 20.0, 0.1, 0.5

#: Pairs of one unit or component that a task solves at once; larger components are solved region by region.
MAX_SOLVER_EDGES = 200_000
BIN_EDGES = 50_000
#: Costs count in units of 1e-9; the tie number of a pair comes below the cost, a missing pair above all costs.
COST_UNITS, TIE_BITS, MISSING = 1e9, 64, 1 << 160


def check_parameters(d_max: float, min_iou: float, alpha: float, policy: str, cap: float | None = None) -> None:
    if policy not in ("OR", "AND"):
        raise ValueError(f"unknown gate policy {policy!r}")
    if not d_max > 0:
        raise ValueError(f"distance gate {d_max} is not positive")
    if cap is not None and d_max > cap + 1e-9:
        raise ValueError(f"pairs were only formed up to a distance of {cap}, below the gate {d_max}")
    for name, share in (("overlap gate", min_iou), ("cost blend", alpha)):
        if not 0.0 <= share <= 1.0:
            raise ValueError(f"{name} {share} is not a share between 0 and 1")


def valid_pairs(pairs: DataFrame, d_max: Column | float, min_iou: Column | float, policy: Column | str) -> DataFrame:
    """``valid`` by the OR or AND of the distance gate and the overlap gate."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    near = F.coalesce(F.col("dist") <= lit(d_max), F.lit(False))
    over = F.col("hit") & (F.col("overlap") >= lit(min_iou))
    return pairs.withColumn("valid", F.when(lit(policy) == "OR", near | over).otherwise(near & over))


def pair_cost(pairs: DataFrame, alpha: float, d_max: Column | float) -> DataFrame:
    """Blended cost; NULL where the distance is unknown, such a pair can never be assigned."""
    d = d_max if isinstance(d_max, Column) else F.lit(float(d_max))
    return pairs.withColumn("cost", float(alpha) * (1.0 - F.col("overlap")) + (1.0 - float(alpha)) * (F.col("dist") / d))


def candidate_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Valid pairs and objects with at least one of them."""
    return pairs.where("valid").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cand_pairs"), F.countDistinct("pred_id").alias("cand_preds"), F.countDistinct("gt_id").alias("cand_gts")
    )


def exact_costs(pairs: DataFrame) -> DataFrame:
    """``_c``, the cost in units of 1e-9, and ``_h``, a number from the digest of the ids that decides between equal sums.

    Comparing (number of pairs, sum of ``_c``, sum of ``_h``) makes the best assignment unique, so that every way to find it
    names the same partners on every run.
    """
    digest = F.md5(F.concat(F.col("pred_id").cast("string"), F.lit(":"), F.col("gt_id").cast("string")))
    return pairs.withColumn("_c", F.rint(F.col("cost") * F.lit(COST_UNITS)).cast("bigint")).withColumn("_h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"))


def settle(
    edges: list[list[tuple[int, int]]], sources: list[int], mate: list[int], owner: list[int], u: list[int], v: list[int], inside: list[bool] | None = None,
) -> list[int]:
    """Let predictions enter one by one, each along a cheapest alternating path; returns those that could not be settled here.

    ``edges[p]`` lists (truth, cost) with integer costs. Every prediction may also stay alone at the cost MISSING, so most pairs come
    first. ``mate`` and ``owner`` hold partners (-1: none, owner -2: a prediction that is not here), ``u`` and ``v`` potentials
    with u + v <= cost for every pair, equality for matched ones and v = 0 for free truth; all four are updated. A search
    that would leave the region, by a truth that is not ``inside`` or is owned elsewhere, changes nothing and is put off.
    """
    put_off = []
    for start in sources:
        dist: dict[int, int] = {}
        came: dict[int, int] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        p, base, alone, alone_at, end, left = start, 0, None, start, -1, False
        while True:
            stay = base + MISSING - u[p]
            if alone is None or stay < alone:
                alone, alone_at = stay, p
            gap = base - u[p]
            for g, c in edges[p]:
                d = gap + c - v[g]
                if g not in done and (g not in dist or d < dist[g]):
                    dist[g], came[g] = d, p
                    heapq.heappush(heap, (d, g))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                total = alone
                break
            base, g = heapq.heappop(heap)
            if (inside is not None and not inside[g]) or owner[g] == -2:
                left = True
                break
            if owner[g] < 0:
                total, end = base, g
                break
            done[g] = base
            p = owner[g]
        if left:
            put_off.append(start)
            continue
        u[start] += total
        for g, d in done.items():
            v[g] -= total - d
            u[owner[g]] += total - d
        if end < 0:
            end, mate[alone_at] = mate[alone_at], -1
            if alone_at == start:
                continue
        while True:
            p = came[end]
            owner[end] = p
            end, mate[p] = mate[p], end
            if p == start:
                break
    return put_off


def split_potential(x: int) -> tuple[int, int, int]:
    """A potential as (missing pairs, cost, tie) with x = missing * MISSING + cost * 2 ** TIE_BITS + tie."""
    missing = (x + (MISSING >> 1)) // MISSING
    x -= missing * MISSING
    cost = (x + (1 << (TIE_BITS - 1))) >> TIE_BITS
    return missing, cost, x - (cost << TIE_BITS)


def join_potential(missing: int, cost: int, tie: int) -> int:
    return missing * MISSING + (cost << TIE_BITS) + tie


def local_graph(part: pd.DataFrame) -> tuple:
    """(prediction ids, truth ids, truth index of each row, prediction index of each row, pairs of each prediction) of a table of pairs."""
    p_at, preds = pd.factorize(part["pred_id"].to_numpy(), sort=True)
    g_at, gts = pd.factorize(part["gt_id"].to_numpy(), sort=True)
    rows: list[list[tuple[int, int]]] = [[] for _ in preds]
    p_at, g_at = p_at.tolist(), g_at.tolist()
    for p, g, c, h in zip(p_at, g_at, part["_c"].tolist(), part["_h"].tolist()):
        rows[p].append((g, (c << TIE_BITS) + h))
    return preds, gts, g_at, p_at, rows


def _solve_bin(keys: list[str], potentials: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby([*keys, "_comp"], sort=False, dropna=False):
            preds, gts, _, _, rows = local_graph(part)
            mate, owner, u, v = [-1] * len(preds), [-1] * len(gts), [0] * len(preds), [0] * len(gts)
            settle(rows, list(range(len(preds))), mate, owner, u, v)
            head = [part[k].iloc[0] for k in keys]
            if potentials:
                out += [(*head, preds[p], gts[g] if g >= 0 else None, *split_potential(u[p])) for p, g in enumerate(mate)]
                out += [(*head, None, gts[g], *split_potential(x)) for g, x in enumerate(v)]
            else:
                out += [(*head, preds[p], gts[g]) for p, g in enumerate(mate) if g >= 0]
        if not potentials:
            return pd.DataFrame(out, columns=[*keys, "pred_id", "gt_id"])
        found = pd.DataFrame(out, columns=[*keys, "pred_id", "gt_id", "missing", "price", "tie"], dtype=object)  # ids may be None
        return found.assign(**{k: found[k].infer_objects() for k in keys})

    return run


def _component_labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the component ``_comp`` they belong to and its number of edges ``_n``."""
    node = lambda side, c: F.struct(*keys, F.lit(side).alias("side"), F.col(c).alias("id"))
    roots = graph_components(edges.select(node(0, "gt_id").alias("a"), node(1, "pred_id").alias("b")))
    of_gt = roots.where(F.col("node.side") == 0).select(
        *[F.col("node")[k].alias(k) for k in keys], F.col("node.id").alias("gt_id"), F.col("root.id").cast("bigint").alias("_comp")
    )
    labelled = join_keys(edges, of_gt, [*keys, "gt_id"])
    sizes = labelled.groupBy(*keys, "_comp").agg(F.count(F.lit(1)).alias("_n"))
    return join_keys(labelled, sizes, [*keys, "_comp"])


def assign_one_to_one(pairs: DataFrame, keys: list[str], max_solver_edges: int = MAX_SOLVER_EDGES) -> DataFrame:
    """(keys, pred_id, gt_id) with most valid pairs first, then the smallest total cost to nine decimals, then the tie numbers.

    These goals separate over the components of the graph of assignable pairs and have one best answer, whatever the way to
    it. Components that are a star around one object need only its cheapest pair and are settled by aggregates,
    whatever their size. Units with up to ``max_solver_edges`` remaining pairs are packed into bins and solved inside tasks. Larger
    units are first split into their components; a component that is still larger is solved in regions, side by
    side, that grow until every search ends inside of one.
    """
    e = exact_costs(pairs.where("valid and cost is not null").select(*keys, "pred_id", "gt_id", "cost")).drop("cost")
    pk, gk = [*keys, "pred_id"], [*keys, "gt_id"]
    p_deg = e.groupBy(*pk).agg(F.count(F.lit(1)).alias("pd"))
    e1 = join_keys(e, p_deg, pk)
    by_gt = e1.groupBy(*gk).agg(F.count(F.lit(1)).alias("gd"), F.max("pd").alias("gt_max"), F.min(F.struct("_c", "_h", "pred_id")).alias("gt_best"))
    e2 = join_keys(e1, by_gt.select(*gk, "gd", "gt_max"), gk)
    by_pred = e2.groupBy(*pk).agg(F.max("gd").alias("pred_max"), F.first("pd").alias("pd"), F.min(F.struct("_c", "_h", "gt_id")).alias("pred_best"))
    gt_stars = by_gt.where("gt_max = 1").select(*keys, F.col("gt_best.pred_id").alias("pred_id"), "gt_id")
    pred_stars = by_pred.where("pred_max = 1 and pd > 1").select(*keys, "pred_id", F.col("pred_best.gt_id").alias("gt_id"))
    stars = gt_stars.unionByName(pred_stars)
    rest = join_keys(e2.where("gt_max > 1"), by_pred.where("pred_max > 1").select(*pk, F.lit(True).alias("_open")), pk).select(*keys, "pred_id", "gt_id", "_c", "_h")
    solved = solve_pairs(cut_lineage(rest), keys, max_solver_edges)
    return stars if solved is None else stars.unionByName(solved)


def solve_pairs(rest: DataFrame, keys: list[str], max_solver_edges: int = MAX_SOLVER_EDGES, potentials: bool = False) -> DataFrame | None:
    """The best assignment of pairs (keys, pred_id, gt_id, _c, _h), which should be stored; None without pairs.

    With ``potentials`` all objects are returned, predictions with their partner or NULL, truth with a NULL prediction, and their
    potential as ``missing``, ``price`` and ``tie`` (see ``split_potential``).
    """
    if rest.isEmpty():
        return None
    units = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    labelled = join_keys(rest, units, keys).withColumn("_comp", F.lit(0).cast("bigint"))
    tally = units.agg(F.sum("_n").alias("n"), F.max("_n").alias("m")).first().asDict()
    if tally["m"] > max_solver_edges:
        small = labelled.where(F.col("_n") <= max_solver_edges)
        labelled = cut_lineage(small.unionByName(_component_labels(labelled.where(F.col("_n") > max_solver_edges).drop("_n", "_comp"), keys)))
        tally["m"] = labelled.agg(F.max("_n").alias("m")).first()["m"]
    bins = max(1, -(-tally["n"] // BIN_EDGES), min(tally["n"] // 2000, 64))
    kinds = {f.name: f.dataType.simpleString() for f in labelled.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "pred_id", "gt_id"]) + (", missing bigint, price bigint, tie bigint" if potentials else "")
    solved = (
        labelled.where(F.col("_n") <= max_solver_edges)
        .select(*keys, "pred_id", "gt_id", "_c", "_h", "_comp", F.pmod(F.xxhash64(*keys, "_comp"), F.lit(bins)).alias("_bin"))
        .groupBy("_bin")
        .applyInPandas(_solve_bin(keys, potentials), schema)
    )
    if tally["m"] > max_solver_edges:
        from gridtally.operators.augment import match_by_regions

        large = match_by_regions(labelled.where(F.col("_n") > max_solver_edges), [*keys, "_comp"], potentials)
        solved = solved.unionByName(large.select(*solved.columns))
    return solved


def assignment_certificate(pairs: DataFrame, keys: list[str], max_solver_edges: int = MAX_SOLVER_EDGES) -> DataFrame:
    """Proof per unit that the assignment is the best one.

    ``n_pairs`` and ``cost`` (sum of costs to nine decimals, in units of 1e-9) describe the assignment. It is the best if no pair costs
    less than the potentials of its ends (``below``), matched pairs cost as much (``loose``), free truth has potential 0
    (``free_truth``) and predictions without a partner that of a missing pair (``unmatched``): all four counts are 0. ``gap`` is
    the assignment's cost less the sum of potentials, 0 in both parts.
    """
    e = cut_lineage(exact_costs(pairs.where("valid and cost is not null").select(*keys, "pred_id", "gt_id", "cost")).drop("cost"))
    solved = solve_pairs(e, keys, max_solver_edges, potentials=True)
    if solved is None:
        counts = ", ".join(f"cast(0 as bigint) as {c}" for c in ("n_pairs", "cost", "below", "loose", "free_truth", "unmatched", "gap"))
        return e.select(*keys).distinct().selectExpr(*[f"`{k}`" for k in keys], *counts.split(", "))
    solved = cut_lineage(solved)
    p = solved.where("pred_id is not null").select(*keys, "pred_id", F.col("gt_id").alias("_mate"), *[F.col(c).alias(f"_u{i}") for i, c in enumerate(("missing", "price", "tie"))])
    g = solved.where("pred_id is null").select(*keys, "gt_id", *[F.col(c).alias(f"_v{i}") for i, c in enumerate(("missing", "price", "tie"))])
    x = join_keys(join_keys(e, p, [*keys, "pred_id"]), g, [*keys, "gt_id"])
    m, c, h = -F.col("_u0") - F.col("_v0"), F.col("_c") - F.col("_u1") - F.col("_v1"), F.col("_h") - F.col("_u2") - F.col("_v2")
    held = F.coalesce(F.col("_mate") == F.col("gt_id"), F.lit(False))
    zero = (m == 0) & (c == 0) & (h == 0)
    on_pairs = x.groupBy(*keys).agg(
        F.count_if(held).alias("n_pairs"), F.coalesce(F.sum(F.when(held, F.col("_c"))), F.lit(0)).alias("cost"),
        F.count_if((m < 0) | ((m == 0) & ((c < 0) | ((c == 0) & (h < 0))))).alias("below"), F.count_if(held & ~zero).alias("loose"),
        F.count(F.lit(1)).alias("_all"),
    )
    alone = (F.col("missing") == 1) & (F.col("price") == 0) & (F.col("tie") == 0)
    taken = p.where("_mate is not null").select(*keys, F.col("_mate").alias("gt_id"), F.lit(True).alias("_taken"))
    free = join_keys(g, taken, [*keys, "gt_id"], "left").where("_taken is null").groupBy(*keys).agg(F.count_if(F.expr("_v0 <> 0 or _v1 <> 0 or _v2 <> 0")).alias("free_truth"))
    on_preds = solved.where("pred_id is not null").groupBy(*keys).agg(F.count_if(F.col("gt_id").isNull() & ~alone).alias("unmatched"), F.count_if(F.col("gt_id").isNull()).alias("_out"))
    sums = solved.groupBy(*keys).agg(F.sum("price").alias("_price"), F.sum("missing").alias("_missing"))
    rows = join_keys(join_keys(join_keys(on_pairs, free, keys, "left"), on_preds, keys), sums, keys)
    gap = (F.col("cost") - F.col("_price")) + (F.col("_out") - F.col("_missing"))
    return rows.select(*keys, "n_pairs", "cost", "below", "loose", F.coalesce("free_truth", F.lit(0)).alias("free_truth"), "unmatched", gap.alias("gap"))


def bucket_predictions(pred: DataFrame, gt: DataFrame, pairs: DataFrame, matches: DataFrame, keys: list[str], gt_keys: list[str]) -> DataFrame:
    """Every object with its bucket: tp, ignored (has a valid pair but no partner), fp, and fn for truth.

    ``pred``/``gt``: keys plus obj_id; ``gt`` carries the full keys so that truth is repeated per method.
    """
    has = pairs.where("valid").select(*keys, "pred_id").distinct().withColumn("_c", F.lit(True))
    m = matches.select(*keys, "pred_id", "gt_id")
    p = join_keys(join_keys(pred.select(*keys, F.col("obj_id").alias("pred_id")), m, [*keys, "pred_id"], "left"), has, [*keys, "pred_id"], "left")
    bucket = F.when(F.col("gt_id").isNotNull(), "tp").when(F.col("_c"), "ignored").otherwise("fp")
    pp = p.select(*keys, F.lit("pred").alias("side"), F.col("pred_id").alias("obj_id"), bucket.alias("bucket"), F.col("gt_id").alias("partner_id"))
    g = join_keys(gt.select(*keys, F.col("obj_id").alias("gt_id")), m, [*keys, "gt_id"], "left")
    gg = g.select(*keys, F.lit("gt").alias("side"), F.col("gt_id").alias("obj_id"), F.when(F.col("pred_id").isNotNull(), "tp").otherwise("fn").alias("bucket"), F.col("pred_id").alias("partner_id"))
    return pp.unionByName(gg)


def bucket_counts(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the buckets per unit: tp, fp, fn, ignored, n_pred, n_gt."""
    is_pred = F.col("side") == "pred"
    hit = lambda b: F.count_if(is_pred & (F.col("bucket") == b))
    return buckets.groupBy(*keys).agg(
        hit("tp").alias("tp"), hit("fp").alias("fp"), F.count_if(F.col("bucket") == "fn").alias("fn"), hit("ignored").alias("ignored"),
        F.count_if(is_pred).alias("n_pred"), F.count_if(~is_pred).alias("n_gt"),
    )


def per_model(df: DataFrame, models: list[str]) -> DataFrame:
    """Every row once per method; the methods are a short list given by the caller."""
    return df.drop("model").withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def match_objects(
    pred: DataFrame,
    gt: DataFrame,
    models: list[str],
    d_max: float | None = None,
    max_dist: float | None = None,
    min_iou: float = IOU_MIN,
    alpha: float = ALPHA,
    policy: str = "OR",
    gt_runs: DataFrame | None = None,
    pred_runs: DataFrame | None = None,
    frame: tuple[int, int] | None = None,
) -> DataFrame:
    """Buckets of all objects of all units and models. The policy may be written in lower case."""
    if d_max is None and max_dist is None:
        raise TypeError("match_objects() needs d_max or max_dist")
    d = float(d_max if d_max is not None else max_dist)
    policy = policy.upper()
    check_parameters(d, min_iou, alpha, policy)
    pairs = pairwise_geometry(pred, gt, d, gt_runs, pred_runs, frame)
    pairs = cut_lineage(pair_cost(valid_pairs(pairs, d, min_iou, policy), alpha, d).where("valid"))
    matches = assign_one_to_one(pairs, ["uid", "model"])
    return bucket_predictions(pred, per_model(gt, models), pairs, matches, ["uid", "model"], ["uid"])


def match_boxes_to_points(pred: DataFrame, points: DataFrame, models: list[str], d_max: float, require_inside: bool = True) -> DataFrame:
    """Boxes against points; a pair must be within ``d_max`` and, on request, inside the box."""
    if d_max <= 0:
        raise ValueError(f"distance gate {d_max} is not positive")
    p = pred.select("uid", "model", F.col("obj_id").alias("pred_id"), "cy", "cx", "y1", "x1", "y2", "x2")
    g = points.select("uid", F.col("obj_id").alias("gt_id"), F.col("cy").alias("ry"), F.col("cx").alias("rx"))
    pairs = distance_pairs(p, g, ["uid"], d_max)
    if require_inside:
        pairs = pairs.where(F.col("ry").between(F.col("y1"), F.col("y2")) & F.col("rx").between(F.col("x1"), F.col("x2")))
    pairs = cut_lineage(pairs.select("uid", "model", "pred_id", "gt_id", F.lit(True).alias("valid"), (F.col("dist") / float(d_max)).alias("cost")))
    matches = assign_one_to_one(pairs, ["uid", "model"])
    return bucket_predictions(pred, per_model(points, models), pairs, matches, ["uid", "model"], ["uid"])


def enlarge(neighbours: list[list[int]], mate: list[int], owner: list[int]) -> None:
    """Makes the matching (``mate`` of each prediction, ``owner`` of each truth, -1: none) one of most pairs.

    Each turn seeks disjoint augmenting paths from all free predictions and marks a truth once; the last turn finds none.
    """
    grown = True
    while grown:
        grown, seen = False, set()
        for start, free in enumerate(mate):
            if free >= 0 or not neighbours[start]:
                continue
            path, tries = [(start, -1)], [iter(neighbours[start])]
            while path:
                g = next(tries[-1], None)
                if g is None:
                    path.pop()
                    tries.pop()
                elif g not in seen:
                    seen.add(g)
                    if owner[g] < 0:
                        for p, back in reversed(path):
                            mate[p], owner[g] = g, p
                            g = back
                        grown = True
                        break
                    path.append((owner[g], g))
                    tries.append(iter(neighbours[owner[g]]))


def _sweep_bin(keys: list[str], points: list[tuple[float, float, str]]):
    """Counts of each part of the graph at each grid point, from the tightest to the loosest gate.

    A pair that passes a gate passes every looser one, so the matching of a tighter gate is a start for the next.
    """
    order = sorted(range(len(points)), key=lambda i: (points[i][2] != "AND", points[i][0], -points[i][1]))

    def tighter(i: int, done: dict) -> tuple | None:
        d, o, policy = points[i]
        inner = [done[j] for j in done if points[j][0] <= d and points[j][1] >= o and points[j][2] in ("AND", policy)]
        return max(inner, key=lambda m: m[2], default=None)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby([*keys, "_comp"], sort=False, dropna=False):
            p_at, preds = pd.factorize(part["pred_id"].to_numpy())
            g_at, gts = pd.factorize(part["gt_id"].to_numpy())
            dist, overlap, hit = part["dist"].to_numpy("float64", na_value=np.nan), part["overlap"].to_numpy("float64", na_value=np.nan), part["hit"].to_numpy(bool)
            head, done = [part[k].iloc[0] for k in keys], {}
            for i in order:
                d, o, policy = points[i]
                near, over = dist <= d, hit & (overlap >= o)
                valid = near | over if policy == "OR" else near & over
                if not valid.any():
                    continue
                usable = valid & ~np.isnan(dist)
                neighbours: list[list[int]] = [[] for _ in preds]
                for p, g in zip(p_at[usable].tolist(), g_at[usable].tolist()):
                    neighbours[p].append(g)
                start = tighter(i, done)
                mate, owner = (start[0][:], start[1][:]) if start else ([-1] * len(preds), [-1] * len(gts))
                enlarge(neighbours, mate, owner)
                done[i] = (mate, owner, sum(g >= 0 for g in mate))
                out.append((*head, i, done[i][2], int(valid.sum()), len(np.unique(p_at[valid])), len(np.unique(g_at[valid]))))
        return pd.DataFrame(out, columns=[*keys, "_point", "tp", "cand_pairs", "cand_preds", "cand_gts"])

    return run


def sweep_counts(
    pairs: DataFrame, d_max: list[float], min_iou: list[float], policies: list[str], keys: list[str] = ["uid", "model"], max_solver_edges: int = MAX_SOLVER_EDGES,
) -> DataFrame:
    """(keys, d_max, min_iou, policy, tp, cand_pairs, cand_preds, cand_gts) where a pair passes the gates.

    Every pair is sent once, whatever the number of grid points: the gates are thresholds on one list of pairs, and all points of a
    unit, or of a component of a larger unit, are counted in its task. ``pairs`` should be stored. Only components of more than
    ``max_solver_edges`` pairs are matched per grid point, by ``assign_one_to_one``.
    """
    points = [(float(d), float(o), p) for d in d_max for o in min_iou for p in policies]
    near = F.coalesce(F.col("dist") <= max(float(d) for d in d_max), F.lit(False))
    over = F.col("hit") & (F.col("overlap") >= min(float(o) for o in min_iou))
    some = pairs.where(near | over if "OR" in policies else near & over).select(*keys, "pred_id", "gt_id", "dist", "overlap", "hit")
    sizes = cut_lineage(some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    tally = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.max("_n"), F.lit(0)).alias("m")).first().asDict()
    parts = join_keys(some, sizes, keys).withColumn("_comp", F.lit(0).cast("bigint"))
    if tally["m"] > max_solver_edges:
        small = parts.where(F.col("_n") <= max_solver_edges)
        parts = cut_lineage(small.unionByName(_component_labels(parts.where(F.col("_n") > max_solver_edges).drop("_n", "_comp"), keys)))
        tally["m"] = parts.agg(F.max("_n").alias("m")).first()["m"]
    bins = max(1, -(-tally["n"] // BIN_EDGES), min(tally["n"] // 500, 64))
    kinds = {f.name: f.dataType.simpleString() for f in some.schema.fields}
    counts = ["tp", "cand_pairs", "cand_preds", "cand_gts"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _point int, " + ", ".join(f"{c} bigint" for c in counts)
    found = (
        parts.where(F.col("_n") <= max_solver_edges)
        .select(*keys, "pred_id", "gt_id", "dist", "overlap", "hit", "_comp", F.pmod(F.xxhash64(*keys, "_comp"), F.lit(bins)).alias("_bin"))
        .groupBy("_bin")
        .applyInPandas(_sweep_bin(keys, points), schema)
    )
    table = F.array(*[F.struct(F.lit(d).alias("d_max"), F.lit(o).alias("min_iou"), F.lit(p).alias("policy")) for d, o, p in points])
    if tally["m"] > max_solver_edges:
        large = parts.where(F.col("_n") > max_solver_edges).select("*", F.posexplode(table).alias("_point", "_g"))
        large = pair_cost(valid_pairs(large, F.col("_g.d_max"), F.col("_g.min_iou"), F.col("_g.policy")), ALPHA, F.col("_g.d_max")).where("valid")
        large = cut_lineage(large.select(*keys, F.col("_comp").alias("_part"), "_point", "pred_id", "gt_id", "valid", "cost"))
        at = [*keys, "_part", "_point"]
        tp = assign_one_to_one(large, at, max_solver_edges).groupBy(*at).agg(F.count(F.lit(1)).alias("tp"))
        more = join_keys(candidate_stats(large, at), tp, at, "left").select(*keys, "_point", F.coalesce("tp", F.lit(0)).alias("tp"), *counts[1:])
        found = found.unionByName(more)
    total = found.groupBy(*keys, "_point").agg(*[F.sum(c).alias(c) for c in counts])
    return total.withColumn("_g", table[F.col("_point")]).select(*keys, "_g.*", *counts)


def sweep_matching(
    pairs: DataFrame, pred: DataFrame, gt: DataFrame, models: list[str], d_max: list[float], min_iou: list[float], policies: list[str], cap: float, alpha: float = ALPHA, units: DataFrame | None = None,
) -> DataFrame:
    """The parameter sweep: one row per unit, model and grid point, from pairs computed once.

    ``units`` (uid and columns to pass through) names all units; one without any object has a row of zero counts. Without it only
    units with objects have rows.
    """
    for d in d_max:
        for i in min_iou:
            for p in policies:
                check_parameters(d, i, alpha, p, cap)
    from gridtally.operators.joins import cross_grid

    axes = {"d_max": [float(d) for d in d_max], "min_iou": [float(i) for i in min_iou], "policy": policies}
    keys, counts = ["uid", "model", *axes], ["tp", "cand_pairs", "cand_preds", "cand_gts"]
    found = sweep_counts(pairs, d_max, min_iou, policies)
    n_gt = gt.groupBy("uid").agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = pred.groupBy("uid", "model").agg(F.count(F.lit(1)).alias("n_pred"))
    units = per_model(units if units is not None else pred.select("uid").union(gt.select("uid")).distinct(), models)
    units = units.join(n_pred, ["uid", "model"], "left").join(n_gt, ["uid"], "left").fillna(0, ["n_pred", "n_gt"])
    rows = cross_grid(units, **axes).join(found, keys, "left").fillna(0, counts)
    from gridtally.functions.metrics import object_metrics_from_counts

    rows = (
        rows.withColumn("ignored", F.col("cand_preds") - F.col("tp"))
        .withColumn("fp", F.col("n_pred") - F.col("cand_preds"))
        .withColumn("fn", F.col("n_gt") - F.col("tp"))
    )
    m = object_metrics_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.select("*", *[c.alias(n) for n, c in m.items()])
