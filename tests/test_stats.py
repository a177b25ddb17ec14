"""Ranks, quantiles, tests and corrections, with published numbers where they can be recomputed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtally.functions import pvalues as PV
from gridtally.operators import ranks as G
from gridtally.operators import rollups as R
from gridtally.operators import splits as L
from gridtally.operators import stats as H


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(1)
    rows = [("hot", float(rnd.randrange(500)), i) for i in range(3000)] + [("cold", rnd.random(), i) for i in range(40)]
    return spark.createDataFrame(rows, "g string, v double, i int").cache()


def test_buckets_change_nothing(skewed):
    a = G.ranked_histogram(skewed, ["g"], "v").orderBy("g", "v").collect()
    b = G.ranked_histogram(skewed, ["g"], "v", bucket_rows=20)
    assert a == b.select(*a[0].asDict()).orderBy("g", "v").collect()
    one = G.running(skewed, ["g"], ["v", "i"], {"s": ("sum", "i"), "m": ("max", "v")}).orderBy("g", "v", "i").collect()
    many = G.running(skewed, ["g"], ["v", "i"], {"s": ("sum", "i"), "m": ("max", "v")}, bucket_rows=50).orderBy("g", "v", "i").collect()
    assert one == many
    back = G.running(skewed, ["g"], ["v", "i"], {"m": ("min", "i")}, descending=True, bucket_rows=50).orderBy("g", "v", "i").collect()
    assert back == G.running(skewed, ["g"], ["v", "i"], {"m": ("min", "i")}, descending=True).orderBy("g", "v", "i").collect()
    n = G.row_numbers(skewed, [], ["g", "v", "i"], bucket_rows=50).orderBy("g", "v", "i").select("rn").collect()
    assert [r["rn"] for r in n] == list(range(1, 3041))


def test_quantiles_interpolate(skewed):
    q = {r["g"]: r for r in G.exact_quantiles(skewed, ["g"], {"p5": (F.col("v"), 0.05), "med": (F.col("v"), 0.5)}).collect()}
    for g in ("hot", "cold"):
        v = [r["v"] for r in skewed.where(F.col("g") == g).collect()]
        assert q[g]["p5"] == pytest.approx(np.percentile(v, 5)) and q[g]["med"] == pytest.approx(np.median(v))


def test_published_tail_probabilities():
    mean = lambda n: n * (n + 1) / 4
    assert PV.signed_rank_p(118, 1144, 0, True, "two-sided") == pytest.approx(1.4973774353700685e-188, rel=1e-9)
    assert PV.signed_rank_p(3, 175, 0, True, "two-sided") == pytest.approx(1.9041181746482453e-30, rel=1e-9)
    assert PV.signed_rank_p(mean(10), 10, 0, False, "two-sided") == pytest.approx(1.0)
    assert PV.signed_rank_p(55, 10, 0, False, "greater") == pytest.approx(1 / 1024)
    assert PV.rank_sum_p(12, 3, 4, 0) == pytest.approx(2 / 35)
    assert PV.chi_square_sf(5.991464547107979, 2) == pytest.approx(0.05)
    assert PV.chi_square_sf(0.5, 3) == pytest.approx(0.9188914116, rel=1e-8)


def test_rank_sum_effect(spark):
    rnd = random.Random(2)
    a, b = [rnd.randrange(30) for _ in range(50)], [rnd.randrange(30) for _ in range(72)]
    df = spark.createDataFrame([("x", v, True) for v in a] + [("x", v, False) for v in b], "k string, v int, a boolean")
    s = H.rank_sum_statistics(df, ["k"], "v", F.col("a")).first()
    wins = sum((x > y) - (x < y) for x in a for y in b)
    assert s["cliffs_delta"] == pytest.approx(wins / (50 * 72)) and s["u"] == pytest.approx((wins / (50 * 72) + 1) * 50 * 72 / 2)


def test_holm_reproduces_published(spark):
    p = [1.1217021440171339e-05, 3.3618131364121636e-05, 0.3149591505789049, 0.0007077243116715887, 0.6942785013873001, 0.6209043604362481]
    q = [6.730212864102803e-05, 0.00016809065682060818, 0.9448774517367147, 0.0028308972466863547, 1.0, 1.0]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(p)], "c string, i int, p double")
    got = [r["q_holm"] for r in H.holm(df, ["c"], "p").orderBy("i").collect()]
    assert got == pytest.approx(q)


def test_benjamini_hochberg_counts_missing(spark):
    df = spark.createDataFrame([("c", 0, 0.01), ("c", 1, None), ("c", 2, 0.04), ("c", 3, 0.03)], "c string, i int, p double")
    got = {r["i"]: (r["q_value"], r["rejected"]) for r in H.benjamini_hochberg(df, ["c"], "p").collect()}
    assert got[0][0] == pytest.approx(0.04) and got[0][1] and got[1] == (None, False) and got[2][0] == pytest.approx(0.04 * 4 / 3)


def test_wilcoxon_edge_cases(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 2.0, 2.0), ("gap", None, 2.0), ("gap", 3.0, 1.0), ("gap", 3.0, 2.5)], "k string, x double, y double")
    got = {r["k"]: r for r in H.wilcoxon_signed_rank(df, ["k"], F.col("x"), F.col("y")).collect()}
    assert got["one"]["p_value"] is None and (got["flat"]["statistic"], got["flat"]["p_value"], got["flat"]["n_used"]) == (0.0, 1.0, 2)
    assert got["gap"]["n_used"] == 2 and got["gap"]["p_value"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        H.wilcoxon_signed_rank(df, ["k"], F.col("x"), F.col("y"), "sideways")


def test_friedman(spark):
    rows = [("k", b, t, float(v)) for b, vs in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 3), (2, 1, 3)]) for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows + [("k", 9, 0, 1.0)], "k string, b int, t int, v double")
    r = H.friedman_test(df, ["k"], "b", "t", "v", 3).first()
    assert r["n_used"] == 4 and r["statistic"] == pytest.approx(4.5) and r["p_value"] == pytest.approx(0.10539922, rel=1e-6)
    with pytest.raises(ValueError):
        H.friedman_test(df, ["k"], "b", "t", "v", 2)


def test_bootstrap_is_seeded_and_plausible(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([("k", float(rnd.randrange(100, 200)), True) for _ in range(61)] + [("k", float(rnd.randrange(50, 100)), False) for _ in range(80)], "k string, v double, a boolean")
    one, two = (H.bootstrap_ci(df, ["k"], "v", F.col("a"), 400, 3).first() for _ in range(2))
    assert one == two and one["log2_fc_lo"] < one["log2_fc_hi"]
    g = np.random.default_rng(0)
    a = [r["v"] for r in df.where("a").collect()]
    b = [r["v"] for r in df.where("not a").collect()]
    v = [np.log2((np.median(g.choice(a, 61)) + 0.5) / (np.median(g.choice(b, 80)) + 0.5)) for _ in range(2000)]
    assert one["log2_fc_lo"] == pytest.approx(np.percentile(v, 2.5), abs=0.06) and one["log2_fc_hi"] == pytest.approx(np.percentile(v, 97.5), abs=0.06)


def test_pooled_scores_of_published_counts(spark):
    rows = [("peaks", 211160, 9130, 16879, 8156, 0.9419867998724151), ("threshold mask", 200818, 8923, 27221, 5198, 0.917437982548312)]
    df = spark.createDataFrame(rows, "model string, obj_tp bigint, obj_fp bigint, obj_fn bigint, obj_ignored bigint, f1 double")
    for r in R.pooled_metrics(df, ["model", "f1"]).collect():
        assert r["obj_f1"] == pytest.approx(r["f1"], abs=1e-15)


def test_largest_remainder(spark):
    for pool, n, want in (([44, 621, 49, 86], 179, [10, 139, 11, 19]), ([9, 133, 10, 18], 37, [2, 29, 2, 4])):
        df = spark.createDataFrame([(f"g{i}", c) for i, c in enumerate(pool)], "grp string, cnt bigint")
        assert [r["quota"] for r in L.quotas(df, "grp", n).orderBy("grp").collect()] == want
    with pytest.raises(Exception, match="larger than its pool"):
        L.quotas(df, "grp", 10_000).collect()


def test_unknown_group_raises(spark):
    df = spark.createDataFrame([("a", "g", "train")], "uid string, grp string, split string")
    with pytest.raises(Exception, match="not present"):
        L.leave_one_group_out(df, "zzz").collect() or L.leave_one_group_out(df, "zzz").count()


@pytest.mark.parametrize("n1, n2", [(1, 5), (3, 4), (8, 9), (5, 40)])
def test_rank_sum_tail_by_counting(n1, n2):
    count = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]
    count[0][0] = 1
    for v in range(1, n1 + n2 + 1):
        for k in range(min(v, n1), 0, -1):
            for u in range(n1 * n2, v - k - 1, -1):
                count[k][u] += count[k - 1][u - (v - k)]
    whole = sum(count[n1])
    for top in range(n1 * n2 + 2):
        assert PV.rank_sum_tail(n1, n2, top) == pytest.approx(sum(count[n1][top:]) / whole, abs=1e-13)


def test_rank_sum_tail_of_a_long_sample_is_quick():
    import time

    t = time.time()
    half = PV.rank_sum_tail(8, 1_000_000, 4_000_000)
    assert 0.49 < half < 0.51 and time.time() - t < 5


def test_infinite_and_missing_values_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, -3.0, nan, inf, -inf, None)], "k string, d double")
    assert H.wilcoxon_signed_rank(df, ["k"], F.col("d")).first()["n_pairs"] == 3
    rows = [(b, t, float(b * t % 5 + t)) for b in range(1, 6) for t in range(3)] + [(9, 0, nan), (9, 1, 1.0), (9, 2, 2.0), (10, 0, inf), (10, 1, 1.0), (10, 2, 2.0)]
    got = H.friedman_test(spark.createDataFrame([("g", *r) for r in rows], "k string, b int, t int, v double"), ["k"], "b", "t", "v", 3).first()
    assert got["n_used"] == 5


def test_no_unit_is_zeroed_by_default(spark):
    df = spark.createDataFrame([("u", 10**6, 10**6, 5, 6, 7, 8)], "uid string, pred_count bigint, gt_count bigint, obj_tp bigint, obj_fp bigint, obj_fn bigint, obj_ignored bigint")
    r = R.cap_penalty(df).first()
    assert (r["cap_reason"], r["obj_tp"]) == (None, 5) and R.cap_penalty(df, max_pairs=9).first()["cap_reason"] == "too_many_pairs"
