"""Matching: invariants, policies, brute force and the join fallback."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gridtally.operators import matching as X
from gridtally.operators import spatial as SP
from gridtally.operators.augment import match_by_regions


def objects(spark, rows, half=2):
    """(uid, id, cy, cx) as objects with square boxes."""
    data = [(u, "m", i, float(y), float(x), int(y) - half, int(x) - half, int(y) + half + 1, int(x) + half + 1, (2 * half + 1) ** 2) for u, i, y, x in rows]
    return spark.createDataFrame(data, "uid string, model string, obj_id bigint, cy double, cx double, y1 int, x1 int, y2 int, x2 int, area bigint")


def runs(df):
    return df.select("uid", "model", "obj_id", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"), F.col("x1").alias("x0"), (F.col("x2") - 1).alias("x1"))


def counts(spark, pred, gt, **kw):
    p, g = objects(spark, pred), objects(spark, gt)
    kw.setdefault("d_max", 20.0)
    b = X.match_objects(p, g, ["m"], gt_runs=runs(g).drop("model"), pred_runs=runs(p), frame=(64, 64), **kw)
    return X.bucket_counts(b, ["uid"]).first().asDict()


def test_ignored_bucket(spark):
    c = counts(spark, [("a", 1, 16, 16), ("a", 2, 17, 17), ("a", 3, 15, 15)], [("a", 1, 16, 16)])
    assert (c["tp"], c["fp"], c["fn"], c["ignored"]) == (1, 0, 0, 2)


def test_isolated_prediction_is_false_positive(spark):
    c = counts(spark, [("a", 1, 5, 5), ("a", 2, 50, 50)], [("a", 1, 5, 5)])
    assert (c["tp"], c["fp"], c["ignored"]) == (1, 1, 0)


def test_policy_is_case_insensitive_and_or_finds_no_less(spark):
    pred, gt = [("a", 1, 10, 10), ("a", 2, 30, 30)], [("a", 1, 10, 12), ("a", 2, 30, 42)]
    assert counts(spark, pred, gt, policy="or")["tp"] >= counts(spark, pred, gt, policy="and")["tp"]


@pytest.mark.parametrize("kw", [{"policy": "XOR"}, {"d_max": 0.0}, {"min_iou": 1.5}, {"alpha": -0.1}])
def test_bad_parameters(spark, kw):
    with pytest.raises(ValueError):
        counts(spark, [("a", 1, 1, 1)], [("a", 1, 1, 1)], **kw)


def test_distance_is_required(spark):
    o = objects(spark, [("a", 1, 1, 1)])
    with pytest.raises(TypeError):
        X.match_objects(o, o, ["m"])


def test_partition_of_objects(spark):
    rnd = random.Random(3)
    pred = [("a", i, rnd.randrange(64), rnd.randrange(64)) for i in range(25)]
    gt = [("a", i, rnd.randrange(64), rnd.randrange(64)) for i in range(20)]
    for policy in ("OR", "AND"):
        c = counts(spark, pred, gt, policy=policy, d_max=9.0)
        assert c["tp"] + c["fp"] + c["ignored"] == 25 and c["tp"] + c["fn"] == 20


def random_graphs(n, seed):
    rnd = random.Random(seed)
    out = []
    for u in range(n):
        a, b = rnd.randint(1, 4), rnd.randint(1, 4)
        e = [(p, g, round(rnd.random(), 3)) for p in range(a) for g in range(b) if rnd.random() < 0.6]
        out.append((u, a, b, e))
    return out


def edge_table(spark, graphs):
    return spark.createDataFrame([(u, p, g, c, True) for u, _, _, e in graphs for p, g, c in e], "uid int, pred_id bigint, gt_id bigint, cost double, valid boolean")


def best_pairs(edges, n_pred, n_gt):
    """The one best set of pairs: most pairs, least cost in units of 1e-9, least sum of tie numbers."""
    cost = {(p, g): (round(c * 1e9), tie(p, g)) for p, g, c in edges}
    gts = list(range(n_gt)) + [None] * n_pred
    found = []
    for pick in set(itertools.permutations(gts, n_pred)):
        got = [(p, g) for p, g in enumerate(pick) if g is not None]
        if all(k in cost for k in got):
            found.append((-len(got), sum(cost[k][0] for k in got), sum(cost[k][1] for k in got), got))
    return sorted(min(found)[3])


def tie(p, g):
    return int(hashlib.md5(f"{p}:{g}".encode()).hexdigest()[:8], 16)


def solved(edges, n_pred, n_gt, order=None):
    rows = [[(g, (round(c * 1e9) << X.TIE_BITS) + tie(p, g)) for p2, g, c in edges if p2 == p] for p in range(n_pred)]
    mate, owner, u, v = [-1] * n_pred, [-1] * n_gt, [0] * n_pred, [0] * n_gt
    assert X.settle(rows, order or list(range(n_pred)), mate, owner, u, v) == []
    return rows, mate, owner, u, v


def test_solver_against_enumeration_in_any_order():
    rnd = random.Random(9)
    for _, a, b, e in random_graphs(300, 1):
        order = rnd.sample(range(a), a)
        rows, mate, owner, u, v = solved(e, a, b, order)
        assert [(p, g) for p, g in enumerate(mate) if g >= 0] == best_pairs(e, a, b)
        for p, pairs in enumerate(rows):
            assert u[p] <= X.MISSING and all(c >= u[p] + v[g] for g, c in pairs)
            assert mate[p] < 0 or dict(pairs)[mate[p]] == u[p] + v[mate[p]]
        assert all(v[g] == 0 for g in range(b) if owner[g] < 0) and all(u[p] == X.MISSING for p in range(a) if mate[p] < 0)


def test_searches_that_leave_the_region_change_nothing():
    rows = [[(0, 5), (1, 9)], [(0, 4)]]
    mate, owner, u, v = [-1, -1], [-1, -2], [0, 0], [0, 0]
    assert X.settle(rows, [0, 1], mate, owner, u, v) == [1]  # the way on would be by truth 1, owned elsewhere
    assert (mate, owner, u, v) == ([0, -1], [0, -2], [5, 0], [0, 0])
    assert X.settle(rows, [1], mate, [0, -1], u, v, [True, False]) == [1]
    owner[1] = -1
    assert X.settle(rows, [1], mate, owner, u, v) == [] and mate == [1, 0]


@pytest.mark.parametrize("x", [0, 5, -5, X.MISSING, X.MISSING - 3, -X.MISSING + (7 << 64) - 9, (1 << 64) - 1, -(1 << 63), (123 << 64) + (1 << 62)])
def test_potentials_survive_splitting(x):
    assert X.join_potential(*X.split_potential(x)) == x
    assert all(-(1 << 63) <= part < 1 << 63 for part in X.split_potential(x))


def test_assignment_against_enumeration(spark):
    graphs = random_graphs(120, 2)
    rows = X.assign_one_to_one(edge_table(spark, graphs), ["uid"]).collect()
    want = sorted((u, p, g) for u, a, b, e in graphs for p, g in best_pairs(e, a, b))
    assert sorted((r["uid"], r["pred_id"], r["gt_id"]) for r in rows) == want


@pytest.fixture(scope="module")
def crowd(spark):
    """Predictions and truth objects in one tangle, with many equal costs, and its best pairs."""
    rnd = random.Random(6)
    a, b = 70, 64
    at = [(rnd.random(), rnd.random()) for _ in range(a + b)]
    e = [(p, g, round(10 * math.dist(at[p], at[a + g]), 1)) for p in range(a) for g in range(b) if math.dist(at[p], at[a + g]) < 0.2]
    _, mate, _, _, _ = solved(e, a, b)
    table = edge_table(spark, [(1, a, b, e)])
    return table, sorted((p, g) for p, g in enumerate(mate) if g >= 0)


def test_growing_regions_give_the_same_pairs(spark, crowd):
    table, want = crowd
    e = X.exact_costs(table).drop("cost", "valid")
    assert e.count() > 400
    rows = match_by_regions(e, ["uid"], region_pairs=100).collect()
    assert sorted((r["pred_id"], r["gt_id"]) for r in rows) == want


def test_oversize_components_give_the_same_pairs(spark, crowd):
    table, want = crowd
    for limit in (100, 10**9):
        rows = X.assign_one_to_one(table, ["uid"], max_solver_edges=limit).collect()
        assert sorted((r["pred_id"], r["gt_id"]) for r in rows) == want


def test_predictions_enter_by_joins(spark):
    graphs = [(7, 3, 2, [(0, 0, 0.1), (1, 0, 0.2), (1, 1, 0.9), (2, 0, 0.15)])]
    e = X.exact_costs(edge_table(spark, graphs)).drop("cost", "valid")
    rows = match_by_regions(e, ["uid"], region_pairs=1, task_pairs=1).collect()
    assert sorted((r["uid"], r["pred_id"], r["gt_id"]) for r in rows) == sorted((u, p, g) for u, a, b, e in graphs for p, g in best_pairs(e, a, b))


def test_certificate(spark, crowd):
    table, want = crowd
    costs = {(r["pred_id"], r["gt_id"]): round(r["cost"] * 1e9) for r in table.collect()}
    for limit in (100, 10**9):
        row = X.assignment_certificate(table, ["uid"], max_solver_edges=limit).first()
        assert (row["n_pairs"], row["cost"]) == (len(want), sum(costs[k] for k in want))
        assert [row[c] for c in ("below", "loose", "free_truth", "unmatched", "gap")] == [0] * 5
    assert X.assignment_certificate(table.limit(0), ["uid"]).collect() == []


def test_pair_without_distance_is_candidate_but_never_matched(spark):
    pairs = spark.createDataFrame([("a", "m", 1, 1, None, 0.9, True)], "uid string, model string, pred_id bigint, gt_id bigint, dist double, overlap double, hit boolean")
    v = X.pair_cost(X.valid_pairs(pairs, 20.0, 0.1, "OR"), 0.5, 20.0)
    assert v.first()["valid"] and v.first()["cost"] is None
    assert X.assign_one_to_one(v, ["uid", "model"]).count() == 0


def test_distance_pairs_meet_once(spark):
    rnd = random.Random(4)
    a = [("u", i, rnd.uniform(0, 90), rnd.uniform(0, 90)) for i in range(80)]
    b = [("u", i, rnd.uniform(0, 90), rnd.uniform(0, 90)) for i in range(80)]
    da = spark.createDataFrame(a, "uid string, p int, cy double, cx double")
    db = spark.createDataFrame(b, "uid string, g int, ry double, rx double")
    got = sorted((r["p"], r["g"]) for r in SP.distance_pairs(da, db, ["uid"], 7.0).collect())
    want = sorted((i, j) for _, i, y, x in a for _, j, v, w in b if ((y - v) ** 2 + (x - w) ** 2) ** 0.5 <= 7.0)
    assert got == want


def test_boxes_to_points(spark):
    p, g = objects(spark, [("a", 1, 10, 10), ("a", 2, 40, 40)]), objects(spark, [("a", 1, 12, 12), ("a", 2, 46, 40)])
    c = X.bucket_counts(X.match_boxes_to_points(p, g, ["m"], 20.0), ["uid"]).first()
    assert (c["tp"], c["fp"], c["fn"]) == (1, 1, 1)
    c = X.bucket_counts(X.match_boxes_to_points(p, g, ["m"], 20.0, require_inside=False), ["uid"]).first()
    assert c["tp"] == 2


def test_units_with_like_joined_names_stay_apart(spark):
    units = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("a", None)]
    rows = [(u, m, p, g, 0.1 + 0.2 * (p != g), True) for u, m in units for p in (1, 2) for g in (1, 2)]
    df = spark.createDataFrame(rows, "uid string, model string, pred_id bigint, gt_id bigint, cost double, valid boolean")
    got = X.assign_one_to_one(df, ["uid", "model"]).collect()
    assert sorted((str(r["uid"]), str(r["model"]), r["pred_id"], r["gt_id"]) for r in got) == sorted((str(u), str(m), i, i) for u, m in units for i in (1, 2))


def most_pairs(edges):
    """Size of the largest matching, by trying augmenting paths one after the other."""
    owner = {}

    def grow(p, seen):
        for q, g in edges:
            if q == p and g not in seen:
                seen.add(g)
                if g not in owner or grow(owner[g], seen):
                    owner[g] = p
                    return True
        return False

    return sum(grow(p, set()) for p in sorted({p for p, _ in edges}))


@pytest.mark.parametrize("limit", [200_000, 12])
def test_sweep_counts_equal_plain_matching(spark, limit):
    rnd = random.Random(12)
    pairs = [(u, p, g, rnd.choice([None, rnd.uniform(0, 12)]), rnd.random(), rnd.random() < 0.7) for u in ("a", "b") for p in range(9) for g in range(8) if rnd.random() < (0.35 if u == "a" else 0.1)]
    df = spark.createDataFrame([(u, "m", *r) for u, *r in pairs], "uid string, model string, pred_id bigint, gt_id bigint, dist double, overlap double, hit boolean").repartition(3)
    got = {(r["uid"], r["d_max"], r["min_iou"], r["policy"]): (r["tp"], r["cand_pairs"], r["cand_preds"], r["cand_gts"]) for r in X.sweep_counts(df, [4.0, 9.0], [0.2, 0.6], ["OR", "AND"], max_solver_edges=limit).collect()}
    want = {}
    for u in ("a", "b"):
        for d in (4.0, 9.0):
            for o in (0.2, 0.6):
                for policy in ("OR", "AND"):
                    near = lambda r: r[3] is not None and r[3] <= d
                    over = lambda r: r[5] and r[4] >= o
                    valid = [r for r in pairs if r[0] == u and ((near(r) or over(r)) if policy == "OR" else (near(r) and over(r)))]
                    if valid:
                        want[u, d, o, policy] = (most_pairs([(r[1], r[2]) for r in valid if r[3] is not None]), len(valid), len({r[1] for r in valid}), len({r[2] for r in valid}))
    assert got == want and len(want) > 10
