"""Nested URL rules against plain matching, many rules of one host, and the rows that the bounds bring to the driver."""

import random
import time

import pytest
from gridtally.llm import ranges, urlfilter
from pyspark.sql import functions as F

RULES = "host string, path string, verdict string"


def plain(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, 0, 0, None, "allow"))[3:]


@pytest.mark.parametrize("parts", [1, 7])
def test_nested_rules_equal_plain_matching(spark, parts):
    rnd = random.Random(parts)
    word = lambda n: "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, n)))
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "ba.com", "net", "a.net"]
    rules = list({(rnd.choice(hosts), "/" + word(6)): rnd.choice(["allow", "block"]) for _ in range(400)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rules += [(h, p, "block") for h, p, _ in rules[:20]] + [("com", "", "block"), ("net", "/\U0001f600", "block"), ("net", "/\uffff", "allow")]
    urls = [f"http://{rnd.choice(hosts)}/{word(9)}" for _ in range(1500)] + ["http://a.net/\U0001f600x", "http://net/\uffff", "http://com", "x://org/a", None, ""]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, RULES)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(got) == len(urls)
    for r in got:
        assert (r["rule"], r["verdict"]) == plain(r["host"], r["path"], rules), r


def test_many_rules_of_one_host(spark):
    rules = spark.range(100_000).select(F.lit("big.com").alias("host"), F.concat(F.lit("/"), F.lpad("id", 6, "0")).alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.big.com/"), F.lpad(F.col("id") * 10, 6, "0"), F.lit("/x")).alias("url"))
    began = time.monotonic()
    got = urlfilter.judge(pages, rules).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("rule = concat('big.com/', lpad(page_id * 10, 6, '0'))")).alias("same")).collect()
    assert {r["verdict"]: (r["n"], r["same"]) for r in got} == {"allow": (10_000, 0), "block": (10_000, 10_000)}
    assert time.monotonic() - began < 60


def test_bounds_take_few_rows_and_cut_evenly(spark, monkeypatch):
    df = spark.range(0, 300_000, 1, 16).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 977)) as k", "xxhash64(id) as t")
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    cuts = ranges.bounds(df, F.col("k"), F.col("t"), per_part=200)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(map(len, seen)) < 2 * 200 * parts
    sizes = [r["count"] for r in collect(df.groupBy(ranges.part_of(F.col("k"), F.col("t"), cuts).alias("p")).count())]
    assert len(sizes) == parts and max(sizes) < 2 * 300_000 / parts
    assert ranges.bounds(df.limit(0), F.col("k"), F.col("t")) == []
