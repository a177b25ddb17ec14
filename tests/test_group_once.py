from pyspark.sql import functions as F

from gridtally.operators import select as S


def test_groups_are_found_once_and_dealt_by_rows(spark):
    names = spark.createDataFrame([(f"a{i % 3}_{i}",) for i in range(20)] + [("none",), (None,)], "name string")
    out = S.bucket_by_group(names, "name", F.nullif(F.regexp_extract("name", "^(a[0-9])_", 1), F.lit("")), "UNKNOWN")
    assert "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["grp"], r["uid"]): r["n_in_group"] for r in out.collect()}
    assert len(got) == 22 and got["a0", "a0_0"] == 7 and got["a2", "a2_2"] == 6 and got["UNKNOWN", None] == got["UNKNOWN", "none"] == 2
