"""Pixel confusion of the scoring pipeline: every position once, and no pixel shuffled."""

import random

from gridtally.plans import catalog
from gridtally.plans import evaluate as EV


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "hashpartitioning(" in line]


def test_counts_equal_sets(spark):
    rng = random.Random(3)
    at = lambda: (rng.randrange(3), rng.choice([None, *range(6)]), rng.choice([None, *range(0, 200, 3)]))
    rows = [(*at(), rng.choice([None, "a", "b", "c"])) for _ in range(900)]
    rows += rows[:200]
    units = spark.createDataFrame([(u, 50, 200) for u in range(4)], "uid long, h int, w int")
    got = EV._pixel_counts(spark.createDataFrame(rows, "uid long, y int, x int, model string"), units, ["a", "b"])
    assert not any("x#" in line for line in exchanges(got))
    found = {(r["uid"], r["model"]): (r["pix_tp"], r["pix_fp"], r["pix_fn"], r["pix_tn"]) for r in got.collect()}
    for u in range(4):
        truth = {r[1:3] for r in rows if r[0] == u and r[3] is None}
        for m in "ab":
            own = {r[1:3] for r in rows if r[0] == u and r[3] == m}
            a, b, c = len(truth & own), len(own - truth), len(truth - own)
            assert found[u, m] == (a, b, c, 50 * 200 - a - b - c)
    assert len(found) == 8


def test_scores_shuffle_no_pixel(spark, monkeypatch):
    made = []
    cut = EV.C.cut_lineage

    def counted(df):
        made.extend(exchanges(df))
        return cut(df)

    monkeypatch.setattr(EV.C, "cut_lineage", counted)
    made += exchanges(catalog.QUERIES["f1_score_units"](spark, "/root/testdata/sf0.001"))
    assert made and not any(" x#" in line.split("hashpartitioning(")[1].split("),")[0].replace("(", " ") for line in made)
