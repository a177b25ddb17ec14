import pytest

from gridtally.operators import quality as Q

PATHS = "uid long, rgb_path string, dapi_path string, roi_path string, gt_path string"


@pytest.fixture
def tables(spark):
    units = spark.createDataFrame([(u, *(f"f_{u}_{i}" for i in range(4))) for u in [*range(30), None]], PATHS)
    facts = spark.createDataFrame([(f"f_{u}_{i}", i != 2 or u % 2 == 0, 10, 10, u % 3) for u in [*range(25), None] if u is not None for i in range(4)], "path string, readable boolean, h int, w int, nonzero long")
    return units, facts


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_tasks_of_an_audit_grow_with_its_rows(spark, tables, monkeypatch):
    units, facts = tables
    want = rows(Q.file_audit(units, facts))
    assert len(want) == 31
    monkeypatch.setattr(Q, "TASK_ROWS", 5)
    out = Q.file_audit(units, facts)
    assert out.rdd.getNumPartitions() == 25  # 31 units of four paths, five to a task
    assert rows(out) == want


def test_counts_of_a_null_unit_are_attached_in_as_many_tasks(spark, tables, monkeypatch):
    units, facts = tables
    counts = units.selectExpr("uid", "uid % 2 as gt_count")
    own = units.join(counts, units["uid"].eqNullSafe(counts["uid"])).select(units["*"], "gt_count")
    want = rows(Q.run_qc(own.where("uid is not null"), counts.where("uid is not null"), facts))
    monkeypatch.setattr(Q, "TASK_ROWS", 5)
    got = Q.run_qc(units.where("uid is not null"), counts.where("uid is not null"), facts)
    assert rows(got) == want and len(want) == 30 and got.rdd.getNumPartitions() == 24
    assert len(rows(Q.run_qc(units, counts.where("uid is not null"), facts))) == 31
