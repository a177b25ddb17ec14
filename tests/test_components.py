"""Rounds of the component search: how many there are, and what they gather on the driver."""

import pytest

from gridtally.operators import components as C


def roots(n, edges):
    at = list(range(n))
    for _ in range(n):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return {i: at[i] for e in edges for i in e if e[0] != e[1]}


@pytest.mark.parametrize(
    "n, edges, rounds",
    [
        (30, [(0, i) for i in range(1, 20)] + [(25, 21), (22, 21), (7, 7)], 0),
        (40, [(i, i + 1) for i in range(39)], None),
        (50, [(49, i) for i in range(20, 49)] + [(3, 4), (4, 5), (5, 3), (19, 48)], None),
        (1, [(0, 0)], 0),
    ],
)
def test_stars_take_no_round(spark, monkeypatch, n, edges, rounds):
    made, plans = [], []
    cut = C.cut_lineage

    def counted(df):
        made.append(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(C, "cut_lineage", counted)
    got = C.graph_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == roots(n, edges)
    assert got.count() == got.select("node").distinct().count()
    assert rounds is None or len(made) - 1 == rounds
    assert not any("BroadcastHashJoin" in p for p in plans)
