"""How the tables of the vector query grow, what they find, and blocks compared together."""

import numpy as np
import pandas as pd

from gridtally.llm import embeddings
from test_dedup import brute_vectors


def company(n, dim=24):
    """Rows a vector of unrelated ones sends to buckets that hold another."""
    x = embeddings.unit_rows(list(np.random.default_rng(1).standard_normal((n, dim))))
    width, tables, mean, project = embeddings.model(x[: embeddings.SAMPLE], n, 0.98)
    subs = embeddings.substrings(x, width, tables, mean, project)
    return sum(int(k[k > 1].sum()) for t in range(tables) for k in [np.unique(subs[:, t], return_counts=True)[1]]) / n


def test_company_does_not_grow_with_the_label():
    assert company(12_000) < max(1.0, 1.5 * company(1_500))


def test_concentrated_vectors_at_the_limit(spark):
    rng = np.random.default_rng(6)
    x = embeddings.unit_rows(list(2 + rng.standard_normal((700, 64))))
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, 0.9802 * x + np.sqrt(1 - 0.9802**2) * away]))]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    _, count = brute_vectors(rows)
    assert sum(count.values()) >= 1_400 and 0.99 * sum(count.values()) <= sum(r["n_links"] for r in got) <= sum(count.values())


def block_rows(rng, sizes):
    parts = []
    for b, n in enumerate(sizes):
        centre = rng.standard_normal(8)
        parts.append(pd.DataFrame({"key": b, "node": rng.permutation(n) + 1_000 * b, "mark": 0, "copies": rng.integers(1, 4, n), "vector": list(centre + rng.normal(0, 0.15, (n, 8))),
                                   "subs": list(rng.integers(0, 2, (n, 3))), "t": b % 3, "side": (np.arange(n) % 2) * (b % 2), "own": b % 2 == 0, "d": 8}))
    return pd.concat(parts, ignore_index=True)


def counted(pdf):
    out = {}
    for _, rows in pdf.groupby("key"):
        rows = list(rows.itertuples())
        for k, p in enumerate(rows):
            for q in rows[:k]:
                cos = p.vector @ q.vector / np.linalg.norm(p.vector) / np.linalg.norm(q.vector)
                if (p.own or p.side != q.side) and cos >= 0.98 and not (p.subs == q.subs)[: p.t].any():
                    out[p.node] = out.get(p.node, 0) + q.copies
                    out[q.node] = out.get(q.node, 0) + p.copies
    return out


def test_many_blocks_in_batches(monkeypatch):
    monkeypatch.setattr(embeddings, "STRIPE", 20)
    pdf = block_rows(np.random.default_rng(9), [2, 3, 1, 60, 2, 75, 1, 5, 4, 2, 2, 90, 3, 3])
    for batch in (1, 7, 64, 1_000):
        frames = [pdf.iloc[k : k + batch] for k in range(0, len(pdf), batch)]
        parts = list(embeddings.whole_blocks(iter(frames), ["key"]))
        assert sum(len(p) for p in parts) == len(pdf) and not set(np.concatenate([p["key"].unique() for p in parts])) ^ set(pdf["key"])
        found = pd.concat([embeddings._links(p, ["key"], 0.98) for p in parts])
        assert found[found["n"] > 0].groupby("a")["n"].sum().to_dict() == counted(pdf)
        edges = found[found["n"] == 0]
        assert {*edges["a"], *edges["b"]} == set(counted(pdf))
