"""Components, suppression, merging and other frame operators against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridtally.operators import components as C
from gridtally.operators import points as P
from gridtally.operators.augment import merge_in_view
from gridtally.plans import evaluate as EV


def flood(pixels, conn):
    """Components of a pixel set by flood fill, as a set of frozen pixel sets."""
    left, out = set(pixels), set()
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (conn == 8 or abs(a) + abs(b) == 1)]
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            y, x = todo.pop()
            for a, b in steps:
                q = (y + a, x + b)
                if q in left:
                    left.remove(q)
                    part.add(q)
                    todo.append(q)
        out.add(frozenset(part))
    return out


def pixel_table(spark, pixels, uid="a"):
    return spark.createDataFrame([(uid, y, x) for y, x in pixels], "uid string, y int, x int")


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("tile", [8, 256])
def test_components_across_tiles(spark, conn, tile):
    rnd = random.Random(conn)
    px = {(y, x) for y in range(40) for x in range(40) if rnd.random() < 0.45}
    lab = C.label_runs(C.runs_from_pixels(pixel_table(spark, px), ["uid"]), ["uid"], conn, tile)
    got = {}
    for r in lab.collect():
        got.setdefault(r["comp"], set()).update((r["y"], x) for x in range(r["x0"], r["x1"] + 1))
    assert {frozenset(v) for v in got.values()} == flood(px, conn)


def test_min_area_boundary_and_bad_connectivity(spark):
    px = pixel_table(spark, [(0, 0), (0, 1), (0, 2), (5, 5), (5, 6)])
    assert C.connected_components(px, ["uid"], min_area=3).count() == 1
    assert C.connected_components(px, ["uid"], min_area=0).count() == 2
    with pytest.raises(ValueError):
        C.connected_components(px, ["uid"], connectivity=6)


def test_blob_attributes(spark):
    px = pixel_table(spark, [(y, x) for y in range(10, 16) for x in range(10, 16)])
    o = C.connected_components(px, ["uid"]).first()
    assert (o["area"], o["cy"], o["cx"], o["y1"], o["x2"]) == (36, 12.5, 12.5, 10, 16)


def peak_table(spark, pts):
    return spark.createDataFrame([("a", y, x, p) for y, x, p in pts], "uid string, y int, x int, p double")


def test_suppression_equals_the_ordered_pass(spark):
    rnd = random.Random(9)
    pts = list({(rnd.randrange(50), rnd.randrange(50)): round(rnd.random(), 2) for _ in range(200)}.items())
    pts = [(y, x, p) for (y, x), p in pts]
    kept = []
    for y, x, p in sorted(pts, key=lambda t: (-t[2], t[0], t[1])):
        if all(math.hypot(x - b, y - a) >= 6 for a, b, _ in kept):
            kept.append((y, x, p))
    got = sorted((r["y"], r["x"], r["p"]) for r in P.greedy_nms(peak_table(spark, pts), 6.0).collect())
    assert got == sorted(kept)
    assert P.greedy_nms(peak_table(spark, pts), 0.0).count() == len(pts)
    assert P.greedy_nms(peak_table(spark, pts), 6.0, max_points=5).count() == 5


def test_local_maxima_threshold_and_border(spark):
    cells = peak_table(spark, [(10, 10, 0.95), (10, 11, 0.5), (50, 50, 0.85), (0, 0, 0.9)])
    got = {(r["y"], r["x"]) for r in P.local_maxima(cells, 0.85, 2).collect()}
    assert got == {(10, 10), (50, 50), (0, 0)}
    assert P.local_maxima(cells, 0.85, 2, border=1, frame=(64, 64)).count() == 2
    plateau = peak_table(spark, [(5, 5, 0.7), (5, 6, 0.7)])
    assert P.local_maxima(plateau, 0.5, 2).count() == 2


def objects(spark, pts):
    return spark.createDataFrame([("a", i, float(y), float(x), y, x, y + 1, x + 1, 1) for i, (y, x) in enumerate(pts)], "uid string, obj_id bigint, cy double, cx double, y1 int, x1 int, y2 int, x2 int, area bigint")


def ordered_merge(pts, dist):
    taken, out = set(), []
    for i in range(len(pts)):
        if i in taken:
            continue
        cy, cx, n = float(pts[i][0]), float(pts[i][1]), 1
        for j in range(i + 1, len(pts)):
            if j not in taken and math.dist((cy, cx), pts[j]) < dist:
                cy, cx, n = (cy + pts[j][0]) / 2, (cx + pts[j][1]) / 2, n + 1
                taken.add(j)
        out.append((i, round(cy, 9), round(cx, 9), n))
    return out


@pytest.mark.parametrize("limit", [100_000, 4])
def test_merge_equals_the_ordered_pass(spark, limit):
    rnd = random.Random(11)
    pts = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(40 if limit > 10 else 16)]
    got = P.merge_close_objects(objects(spark, pts), 5.0, ["uid"], max_objects=limit).collect()
    assert sorted((r["obj_id"], round(r["cy"], 9), round(r["cx"], 9), r["n_merged"]) for r in got) == ordered_merge(pts, 5.0)


def test_center_component_and_holes(spark):
    ring = [(y, x) for y in range(2, 9) for x in range(2, 9) if y in (2, 8) or x in (2, 8)]
    px = pixel_table(spark, ring + [(0, 0)])
    im = spark.createDataFrame([("a", 11, 11)], "uid string, h int, w int")
    got = {(r["y"], r["x"]) for r in P.keep_center_component(px, im).collect()}
    assert got == {(y, x) for y in range(2, 9) for x in range(2, 9)}
    off = pixel_table(spark, [(0, 0), (0, 1), (9, 9)])
    assert P.keep_center_component(off, im).count() == 3


def test_diamonds(spark):
    assert P.render_diamonds(peak_table(spark, [(20, 20, 1.0)]), 2, (64, 64)).count() == 13
    assert P.render_diamonds(peak_table(spark, [(0, 0, 1.0)]), 0, (64, 64)).count() == 1


def test_gaussian_stamp(spark):
    pts = peak_table(spark, [(10, 10, 1.0)])
    got = P.rasterise_points(pts, 1.0, (64, 64)).orderBy(F.desc("p")).first()
    assert (got["y"], got["x"], got["p"]) == (10, 10, 1.0)
    with pytest.raises(ValueError):
        P.rasterise_points(pts, 0.0, (64, 64))


def test_wrong_channel_raises(spark):
    raw = spark.createDataFrame([("a", 0, 0, [1, 2])], "uid string, y int, x int, values array<int>")
    with pytest.raises(Exception, match="out of range"):
        P.binarise(raw, "raw", 0, channel=5).collect()


def test_scoring_end_to_end(spark):
    """Two frames: one predicted exactly, one without a prediction."""
    blob = lambda u, cy, cx: [(u, y, x) for y in range(cy - 3, cy + 4) for x in range(cx - 3, cx + 4)]
    gt = spark.createDataFrame(blob("a", 10, 10) + blob("a", 40, 40) + blob("b", 20, 20), "uid string, y int, x int")
    pred = gt.where("uid = 'a'").withColumn("model", F.lit("m"))
    units = spark.createDataFrame([("a", "test", "g", 64, 64), ("b", "test", "g", 64, 64)], "uid string, split string, grp string, h int, w int")
    rows = {(r["uid"], r["policy"]): r for r in EV.score_units(units, gt, pred, ["m"]).collect()}
    for p in ("OR", "AND"):
        a, b = rows[("a", p)], rows[("b", p)]
        assert (a["obj_tp"], a["obj_fp"], a["obj_fn"], a["obj_f1"], a["pix_dice"], a["pred_exists"]) == (2, 0, 0, 1.0, 1.0, 1)
        assert (b["obj_tp"], b["obj_fn"], b["pix_fn"], b["pix_tn"], b["pred_exists"]) == (0, 1, 49, 64 * 64 - 49, 0)
    sw = EV.sweep(gt, pred, ["m"], [5.0, 10.0], [0.0, 0.5])
    assert sw.count() == 2 * 2 * 2 * 2


def test_long_chain_of_falling_peaks(spark):
    pts = [(5, 4 * i, 1.0 - i / 5_000) for i in range(2_000)]
    got = P.greedy_nms(peak_table(spark, pts), 5.0).collect()
    assert {r["x"] for r in got} == {8 * i for i in range(1_000)}


@pytest.mark.parametrize("tile", [6.0, 17.0])
def test_chains_across_tiles_go_on_in_rounds(spark, tile):
    pts = [(5, 4 * i, 1.0 - i / 500) for i in range(12)] + [(50, 4 * i, 0.5 - i / 500) for i in range(7)]
    got = P.greedy_nms(peak_table(spark, pts), 5.0, tile=tile).collect()
    assert {(r["y"], r["x"]) for r in got} == {(5, 8 * i) for i in range(6)} | {(50, 8 * i) for i in range(4)}


def ordered_suppression(points, dist):
    """The kept (y, x, p) of one unit, by the ordered pass over a grid of kept peaks."""
    held = {}
    for p, y, x in sorted((-p, y, x) for y, x, p in points):
        r, c = int(y // dist), int(x // dist)
        if not any((y - v) ** 2 + (x - w) ** 2 < dist * dist for a in (-1, 0, 1) for b in (-1, 0, 1) for v, w, _ in held.get((r + a, c + b), ())):
            held.setdefault((r, c), []).append((y, x, -p))
    return {k for ks in held.values() for k in ks}


def test_crowded_unit_equals_the_ordered_pass(spark):
    """Most peaks share their place with others, and neighbouring tiles hang on each other."""
    rnd = random.Random(8)
    pts = [(rnd.randrange(200), rnd.randrange(200), round(rnd.random(), 3)) for _ in range(60_000)]
    extra = [(None, 3, 0.5), (4, 4, None)]
    got = P.greedy_nms(peak_table(spark, pts + extra), 6.0, tile=30.0).collect()
    assert {(r["y"], r["x"], r["p"]) for r in got} - set(extra) == ordered_suppression(pts, 6.0)
    assert len(got) == len(ordered_suppression(pts, 6.0)) + 2


def test_open_peaks_of_the_rim_leave_others_open():
    rows = [(-0.9, 0.0, 0.0, False, False), (-0.8, 3.0, 0.0, True, False), (-0.7, 6.0, 0.0, True, False), (-0.6, 30.0, 0.0, True, False), (-0.5, 32.0, 0.0, True, False), (-0.4, 60.0, 0.0, False, True), (-0.3, 61.0, 0.0, True, False)]
    assert P.settle_peaks(rows, 5.0) == [0, 0, 0, 1, -1, 1, -1]


def test_merge_of_a_large_component_equals_the_ordered_pass():
    rnd = random.Random(3)
    pts = [(rnd.uniform(0, 400), rnd.uniform(0, 400)) for _ in range(1_500)]
    rows = [(i, y, x, y, x, y, x, 1.0) for i, (y, x) in enumerate(pts)]
    assert [(r[0], round(r[1], 9), round(r[2], 9), r[8]) for r in P.merge_in_order(rows, 12.0)] == ordered_merge(pts, 12.0)
    many = [(i, *(rnd.uniform(0, 1_500) for _ in range(2)), 0, 0, 0, 0, 1.0) for i in range(20_000)]
    assert sum(r[8] for r in P.merge_in_order(many, 12.0)) == 20_000


def merged_in_tiles(rows, dist, side):
    """The rounds of the merge over tiles, without Spark: every round each tile decides what it can from what it sees."""
    known, spot = {r[0]: None for r in rows}, {r[0]: r[1:] for r in rows}
    span = lambda v: range(int((v - 3 * dist) // side), int((v + 3 * dist) // side) + 1)
    tiles = {}
    for i in sorted(spot):
        for ty in span(spot[i][0]):
            for tx in span(spot[i][1]):
                tiles.setdefault((ty, tx), []).append(i)
    while None in known.values():
        news = {}
        for (ty, tx), ids in tiles.items():
            view = [(i, spot[i], (spot[i][0] // side, spot[i][1] // side) == (ty, tx), *(known[i] or (None, None, 0))) for i in ids]
            news |= {i: d for i, d in zip(ids, merge_in_view(view, dist)) if d is not None}
        assert news
        known |= news
    return sorted({known[i][0]: (known[i][0], *known[i][1], known[i][2]) for i in sorted(known)}.values())


@pytest.mark.parametrize("seed", range(20))
def test_merge_in_tiles_equals_the_ordered_pass(seed):
    """Ids in any order in space, clusters that wander over tile borders."""
    rnd = random.Random(seed)
    pts = [(rnd.uniform(0, 90), rnd.uniform(0, 90)) for _ in range(200)] + [(200.0, 3.0 * i) for i in range(40)]
    if seed % 2:
        rnd.shuffle(pts)
    rows = [(i, y, x, y, x, y + 1, x + 1, 1.0) for i, (y, x) in enumerate(pts)]
    flat = lambda found: [tuple(round(v, 9) for v in r) for r in found]
    assert flat(merged_in_tiles(rows, 6.0, rnd.choice([25.0, 40.0, 70.0]))) == flat(sorted(P.merge_in_order(rows, 6.0)))


def test_merge_keeps_units_apart(spark):
    rows = [(a, b, i, 10.0 * i, 0.0, 0.0, 0.0, 0.0, 0.0, 1) for a, b in (("a|b", "c"), ("a", "b|c"), (None, "c"), ("a", None)) for i in (0, 0.1, 5)]
    df = spark.createDataFrame([(a, b, n % 3, *r) for n, (a, b, _, *r) in enumerate(rows)], "u string, v string, obj_id bigint, cy double, cx double, y1 double, x1 double, y2 double, x2 double, area long")
    got = P.merge_close_objects(df, 5.0, ["u", "v"]).collect()
    assert sorted((str(r["u"]), str(r["v"]), r["n_merged"]) for r in got) == sorted((str(a), str(b), n) for a, b in (("a|b", "c"), ("a", "b|c"), (None, "c"), ("a", None)) for n in (1, 2))


@pytest.mark.parametrize("frame", [(9, 7), (3, 2)])
def test_smoothing_mirrors_the_edge(spark, frame):
    rnd = random.Random(1)
    h, w = frame
    image = [[rnd.random() if rnd.random() < 0.5 else 0.0 for _ in range(w)] for _ in range(h)]
    weights = P.gauss_weights(1.2)
    r = len(weights) // 2

    def mirror(i, n):
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    def blur(rows):
        return [[sum(k * row[mirror(x + d - r, len(row))] for d, k in enumerate(weights)) for x in range(len(row))] for row in rows]

    both = list(zip(*blur(list(zip(*blur(image))))))
    cells = spark.createDataFrame([("a", y, x, p) for y, row in enumerate(image) for x, p in enumerate(row) if p], "uid string, y int, x int, p double")
    got = {(r_["y"], r_["x"]): r_["p"] for r_ in P.kernel_sum(cells, weights, frame).collect()}
    assert all(abs(got.get((y, x), 0.0) - both[y][x]) < 1e-12 for y in range(h) for x in range(w))


@pytest.mark.parametrize("bad", [{"sigma": -1.0}, {"threshold": -0.1}, {"nms_dist": -1.0}, {"border": -1}, {"r": -1}])
def test_detection_parameters(spark, bad):
    with pytest.raises(ValueError):
        P.detect_points(peak_table(spark, [(1, 1, 1.0)]), (9, 9), **({"threshold": 0.1, "r": 1, "nms_dist": 2.0} | bad))


def test_sweep_has_rows_for_units_without_objects(spark):
    gt = spark.createDataFrame([("a", y, x) for y in range(5) for x in range(5)], "uid string, y int, x int")
    units = spark.createDataFrame([("a", "val"), ("empty", "test")], "uid string, split string")
    rows = EV.sweep(gt, gt.withColumn("model", F.lit("m")), ["m"], [5.0, 10.0], [0.1], units=units).collect()
    assert len(rows) == 2 * 2 * 2 and {(r["uid"], r["split"], r["tp"], r["n_gt"]) for r in rows} == {("a", "val", 1, 1), ("empty", "test", 0, 0)}


def shuffled_by_pixel(df):
    """How many shuffles of the plan deal out single pixels."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("hashpartitioning(" in line and " x#" in line.split("hashpartitioning(")[1] for line in plan.splitlines())


def test_regions_are_shuffled_as_words(spark):
    rnd = random.Random(4)
    layer = lambda n: {(rnd.randrange(9), rnd.choice([0, 62, 63, 64, 65, 127, 128, 190]) + rnd.randrange(3)) for _ in range(n)}
    a, b, g = layer(90), layer(90), layer(60)
    table = lambda px: spark.createDataFrame([("u", y, x) for y, x in px for _ in range(2)], "uid string, y int, x int")
    layers = [table(px).withColumn("layer", F.lit(n)) for n, px in (("a", a), ("b", b), ("gt", g))]
    points = spark.createDataFrame([("u", float(y), float(x)) for y, x in sorted(g)], "uid string, cy double, cx double")
    got = P.region_agreement(layers[0].unionByName(layers[1]).unionByName(layers[2]), points, (9, 256), "a", "b", "gt")
    r = got.collect()[0]
    assert (r["manual_px"], r["pred_px"], r["intersection_px"], r["gt_fg_px"], r["gt_fg_px_in_roi"]) == (len(a), len(b), len(a & b), len(g), len(g & b))
    assert (r["gt_objects"], r["gt_objects_in_roi"], r["gt_objects_in_manual"], r["gt_objects_in_both"]) == (len(g), len(g & b), len(g & a), len(g & a & b))
    units = spark.createDataFrame([("u", 9, 256, 9, 256)], "uid string, h int, w int, roi_h int, roi_w int")
    kept = P.retention(units, table(g), table(b))
    assert [(k["gt_px"], k["kept_px"]) for k in kept.collect()] == [(len(g), len(g & b))]
    assert shuffled_by_pixel(got) <= 1 and not shuffled_by_pixel(kept)  # the points are counted by place


def test_runs_are_read_off_words(spark):
    rnd = random.Random(6)
    px = {(rnd.randrange(4), x) for x in range(-130, 330) for _ in range(3)} | {(9, x) for x in range(-70, 200)}
    runs = C.runs_from_pixels(spark.createDataFrame([("u", y, x) for y, x in px] * 2, "uid string, y int, x int"), ["uid"])
    want = {(y, x, next(e for e in range(x, 999) if (y, e + 1) not in px)) for y, x in px if (y, x - 1) not in px}
    got = [(r["y"], r["x0"], r["x1"]) for r in runs.collect()]
    assert len(got) == len(want) and set(got) == want
    assert not shuffled_by_pixel(runs)


def test_a_region_is_not_broadcast(spark):
    px = spark.createDataFrame([("u", y, x, 0.5) for y in range(4) for x in range(100)] + [(None, 1, 1, 0.5)], "uid string, y int, x int, p double")
    roi = spark.createDataFrame([("u", y, x) for y in range(3) for x in range(60, 70)], "uid string, y int, x int")
    got = P.region_mask(px, roi)
    assert {(r["y"], r["x"]) for r in got.collect()} == {(y, x) for y in range(3) for x in range(60, 70)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
