import math
from collections import defaultdict

import pytest

from gridtally.operators import points as P


def found(df):
    rows = [(r["uid"], r["y"], r["x"], r["p"]) for r in df.collect()]
    got = {k[:3]: k[3] for k in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture
def crossing(monkeypatch):
    """Tiles and tasks so small that every stamp crosses some."""
    monkeypatch.setattr(P, "CELL_TILE", 3)
    monkeypatch.setattr(P, "TASK_CELLS", 100)


CELLS = [(1, 0, 0, 0.5), (1, 0, 0, 0.25), (1, 9, 3, 1.0), (1, 2, 2, 0.125), (2, 9, 6, 2.0), (2, 5, 6, 0.0), (3, 4, 4, 1.0)]


def test_kernel_sum_over_tiles_equals_folded_taps(spark, crossing):
    frame, w = (10, 7), P.gauss_weights(1.0)
    fold = lambda v, n: v % (2 * n) if v % (2 * n) < n else 2 * n - 1 - v % (2 * n)
    want = defaultdict(float)
    for uid, y, x, p in CELLS:
        for i, a in enumerate(w):
            for j, b in enumerate(w):
                want[uid, fold(y + i - 4, 10), fold(x + j - 4, 7)] += p * a * b
    out = P.kernel_sum(spark.createDataFrame(CELLS, "uid long, y int, x int, p double"), w, frame)
    got = found(out)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-15) for k in want)
    assert out.rdd.getNumPartitions() == 5  # six places of 81 cells each, 100 cells a task


POINTS = [(1, 0.5, 0.25), (1, 0.5, 0.25), (1, 9.75, 3.0), (1, 3.0, 3.0), (2, -2.5, 6.0), (2, 30.0, 3.0), (3, 12.0, 9.0), (None, 3.0, 3.0), (4, None, 1.0)]


@pytest.mark.parametrize("merge", ["max", "sum"])
@pytest.mark.parametrize("normalise", [True, False])
def test_stamps_over_tiles_equal_stamps_one_by_one(spark, crossing, merge, normalise):
    want = defaultdict(list)
    for uid, cy, cx in POINTS:
        for y in range(10) if cy is not None and (uid is not None or not normalise) else ():
            for x in range(7):
                if abs(y - int(cy)) <= 4 and abs(x - int(cx)) <= 4:
                    want[uid, y, x].append(math.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 2.0))
    want = {k: max(v) if merge == "max" else sum(v) for k, v in want.items()}
    if normalise:
        top = {u: max(v for k, v in want.items() if k[0] == u) for u in {k[0] for k in want}}
        full = {u for u in top if sum(k[0] == u for k in want) == 70}
        low = {u: min(v for k, v in want.items() if k[0] == u) if u in full else 0.0 for u in top}
        want = {k: (v - low[k[0]]) / (top[k[0]] - low[k[0]]) for k, v in want.items()}
    out = P.rasterise_points(spark.createDataFrame(POINTS, "uid long, y double, x double"), 1.0, (10, 7), merge, normalise)
    got = found(out)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_stamps_are_never_shuffled(spark):
    points = spark.range(50).selectExpr("id % 3 as uid", "cast(id * 5 % 256 as int) as y", "cast(id * 7 % 256 as int) as x")
    plan = P.rasterise_points(points, 1.0, (256, 256))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
    text = P.rasterise_points(points, 1.0, (256, 256), normalise=False)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") + text.count("Exchange(") <= 1


BOXES = [(1, 0, 0, 4, 4), (1, 2, 3, 10, 5), (1, -3, 5, 3, 90), (2, 0, 0, 10, 7), (2, 4, 4, 4, 7), (3, 5, 5, 7, 7), (3, None, 0, 9, 9), (None, 0, 0, 9, 9)]


@pytest.mark.parametrize("sigma", [0.0, 1.0])
@pytest.mark.parametrize("r", [0, 2, 5])
def test_detection_over_tiles_equals_whole_frames(spark, crossing, sigma, r):
    cells = [*CELLS, (1, 3, 4, 0.5), (2, 9, 1, 2.0), (None, 3, 3, 1.0), (2, 1, 1, None)]
    table = spark.createDataFrame(cells, "uid long, y int, x int, p double")
    smooth = P.kernel_sum(table, P.gauss_weights(sigma), (10, 7)) if sigma else table
    boxes = spark.createDataFrame(BOXES, "uid long, y1 int, x1 int, y2 int, x2 int")
    inside = {(u, y, x) for u, y1, x1, y2, x2 in BOXES if u is not None and y1 is not None for y in range(max(y1, 0), min(y2, 10)) for x in range(max(x1, 0), min(x2, 7))}
    pixels = spark.createDataFrame(sorted(inside) + [(1, 0, 0), (None, 3, 3), (1, 11, 2)], "uid long, y int, x int")
    for roi in (None, boxes, pixels):
        rows = [(c["uid"], c["y"], c["x"], round(c["p"], 9)) for c in smooth.collect() if c["p"] is not None]
        rows = [c for c in rows if roi is None or c[:3] in inside]
        want = [c for c in rows if c[3] >= 0.02 and c[3] == max(o[3] for o in rows if o[0] == c[0] and abs(o[1] - c[1]) <= r and abs(o[2] - c[2]) <= r)]
        got = P.detect_points(table, (10, 7), 0.02, r, 0.0, sigma, roi).collect()
        key = lambda c: (c[0] is None, *map(str, c))
        assert sorted(((c["uid"], c["y"], c["x"], round(c["p"], 9)) for c in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("sigma", [0.0, 1.0])
@pytest.mark.parametrize("region", ["boxes", "pixels"])
def test_detection_shuffles_cells_and_region_once(spark, monkeypatch, sigma, region):
    plans = []
    monkeypatch.setattr(P, "cut_lineage", lambda df, cut=P.cut_lineage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    cells = spark.createDataFrame([(1, y, x, 0.5) for y in range(0, 256, 9) for x in range(0, 256, 9)], "uid long, y int, x int, p double")
    roi = spark.createDataFrame([(1, y, 0, y + 16, 256) for y in range(0, 256, 32)], "uid long, y1 int, x1 int, y2 int, x2 int")
    if region == "pixels":
        roi = spark.createDataFrame([(1, y, x) for y in range(0, 256, 32) for x in range(256)], "uid long, y int, x int")
    assert P.detect_points(cells, (256, 256), 0.02, 2, 0.0, sigma, roi).count()
    dealt = [line for line in plans[-1].splitlines() if "Exchange " in line]
    assert len(dealt) == 2 and all("_ty#" in line for line in dealt)
