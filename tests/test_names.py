"""Name matching, numbered arrangements and samples against plain Python."""

import itertools
import random

from gridtally.functions import keys as K
from gridtally.operators import joins as D
from gridtally.operators import splits as S


def test_contained_names_equal_plain_search(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab1_") for _ in range(n))
    stems = [word(rnd.randint(0, 12)) for _ in range(300)] + ["dup_name", "dup_name"]
    ids = ["", "a", "ab1", "dup", "dup_name", "zz", None] + [word(rnd.randint(1, 9)) for _ in range(150)] + [s[1:-1] for s in stems[:40]]
    files = {k: stems.count(k) for k in stems}
    got = D.match_unique_contained(spark.createDataFrame([(i,) for i in ids], "uid string"), spark.createDataFrame([(k,) for k in stems], "stem string")).collect()
    assert len(got) == len(ids)
    for r in got:
        u = r["uid"]
        inside = [k for k in files if u and u in k]
        if u is not None and u in files:
            want = (u, "exact") if files[u] == 1 else (None, "ambiguous-exact")
        elif not inside:
            want = (None, "missing")
        else:
            want = (inside[0], "contained") if len(inside) == 1 and files[inside[0]] == 1 else (None, "ambiguous")
        assert (r["matched"], r["status"]) == want, u


def test_one_letter_id_in_every_name(spark):
    stems = spark.range(20_000).selectExpr("concat('x', id) as stem")
    got = D.match_unique_contained(spark.createDataFrame([("x",), ("x19999",), ("19998",)], "uid string"), stems)
    assert {r["uid"]: (r["matched"], r["status"]) for r in got.collect()} == {"x": (None, "ambiguous"), "x19999": ("x19999", "exact"), "19998": ("x19998", "contained")}


def test_arrangements_in_order(spark):
    ops = spark.createDataFrame([(2, "blur"), (0, "crop"), (1, "flip"), (3, "grey")], "ord int, op string")
    want = [list(c) for k in (1, 2, 3, 4) for c in itertools.permutations(["crop", "flip", "blur", "grey"], k)]
    assert [r["combo"] for r in D.grid_permutations(ops, 1, 4).collect()] == want
    for limit in (0, 1, 5, 30, 1000):
        assert [r["combo"] for r in D.grid_permutations(ops, 1, 4, limit).collect()] == want[:limit]
    assert D.grid_permutations(ops, 5, 6).collect() == []


def test_first_key_with_prefix_equals_plain_search(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ab_") for _ in range(n))
    keys = sorted({word(rnd.randint(0, 9)) for _ in range(400)} | {"hot" + str(i) for i in range(3000)})
    uids = sorted({word(rnd.randint(0, 7)) for _ in range(300)} | {"", "h", "hot", "hot2999", "hot29990", "zz"})
    index = spark.createDataFrame([(k, f"dir/{k}") for k in keys], "k string, matched string").repartition(5)
    got = D._first_with_prefix(spark.createDataFrame([(u,) for u in uids] + [(None,)], "u string"), index).collect()
    want = {u: next((k for k in keys if k.startswith(u)), None) for u in uids}
    assert {r["u"]: (r["k"], r["matched"]) for r in got} == {u: (k, f"dir/{k}") for u, k in want.items() if k is not None}
    assert D._first_with_prefix(spark.createDataFrame([("a",)], "u string"), index.limit(0)).collect() == []


def test_token_match_equals_plain_jaccard(spark):
    rnd = random.Random(9)
    words = ["common", "plate", "well"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(4)]
    name = lambda n: " ".join(["common", *rnd.sample(words[1:], n)])
    files = [name(rnd.randint(0, 9)) for _ in range(150)]
    uids = [name(rnd.randint(0, 9)) for _ in range(60)]
    for f in rnd.sample(files, 60):
        toks = f.split()
        uids += [" ".join(rnd.sample(toks, len(toks))), " ".join(toks[:-1] or toks), f + " wxx"]
    for least in (0.95, 0.8, 0.5):
        got = D.match_by_tokens(
            spark.createDataFrame([(u,) for u in dict.fromkeys(uids)], "uid string"), spark.createDataFrame([(f,) for f in files], "path string"), jaccard_min=least
        ).collect()
        for r in got:
            if r["score"] == 2.0:
                assert r["uid"].split() == r["matched"].split()
                continue
            a = set(r["uid"].split())
            near = {f: len(a & set(f.split())) / len(a | set(f.split())) for f in files}
            score = {f: j - 0.01 * abs(len(f) - len(r["uid"])) for f, j in near.items() if j >= least}
            best = min(score, key=lambda f: (-round(score[f], 12), f), default=None)
            assert (r["matched"] is None) == (best is None), r
            if best is not None:
                assert abs(r["score"] - score[best]) < 1e-9, r


def test_samples_take_the_lowest_digests(spark):
    import hashlib

    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", f"u{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "grp string, uid string")
    digest = lambda u: hashlib.md5(f"11:{u}".encode()).hexdigest()
    for cap in (0, 1, 37, 5000):
        got = sorted(r["uid"] for r in S.capped_sample(df, cap, 11).collect())
        assert got == sorted(sorted((u for _, u in rows), key=digest)[:cap])
    got = S.stratified_sample(df, 300, 11).collect()
    assert len(got) == 300
    for g in {g for g, _ in rows}:
        mine = sorted(r["uid"] for r in got if r["grp"] == g)
        assert mine == sorted(sorted((u for h, u in rows if h == g), key=digest)[: len(mine)])


def test_names_never_gather_a_table_on_the_driver(spark):
    """Sides made from small files grow beyond any driver, so their joins must not be broadcasts."""
    ids = spark.range(50).selectExpr("concat('a_b__', id) as uid")
    files = spark.range(50).selectExpr("concat('dir/a_b__', id, '_dapi.tif') as path")
    stems = spark.range(50).selectExpr("concat('a_b__', id, '_x') as stem")
    owners = spark.range(50).selectExpr("concat('a_b__', id) as token")
    results = {
        "b12": K.longest_token_owner(ids, "uid", owners),
        "d5": D.match_by_stem(ids, files, ["_dapi"]),
        "d7": D.match_by_tokens(ids, files),
        "d8": D.match_unique_contained(ids, stems),
        "d9": D.resolve_unit_files(ids, {"dapi": (files, ["_dapi"])}),
    }
    for name, df in results.items():
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
