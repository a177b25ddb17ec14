"""Near-duplicate documents and vectors, and benchmark items, against brute force."""

import numpy as np
import pytest

from gridtally.llm import decontaminate, embeddings, minhash


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_near(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    links = [(i, j) for n, (i, s) in enumerate(sets) for j, t in sets[:n] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return components({i for i, _ in sets}, links)


@pytest.fixture(scope="module")
def copies():
    """Groups of copies edited step by step, so that similarities lie on both sides of the limit and chains form."""
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(2_000)]
    rows = []
    for g in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 120))))
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), " ".join(base)))
            if rng.random() < 0.6:
                base = list(base)
                for _ in range(int(rng.integers(1, 5))):
                    base[int(rng.integers(len(base)))] = str(rng.choice(vocabulary))
    order = rng.permutation(len(rows))
    return [(int(order[i]), t) for i, t in rows]


@pytest.mark.parametrize("width", [1, 2, 5])
def test_near_duplicates(spark, copies, width):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), width, 80).collect()}
    expected = brute_near(copies, width, 80)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert all(r["n_shingles"] == len(shingles(t, width)) for i, t in copies for r in [got[i]])
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_one_large_group(spark):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        w[int(rng.integers(200))] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs, 2, 80).toPandas()
    by = got.dropna(subset=["doc_id"]).groupby("doc_id")["component_id"].first().to_dict()
    assert len(got) == odd_docs.count() and by[12] == 1 and by[6] == 5 and by[8] == 7 and by[2] == 2 and by[4] == 4
    assert got[got["doc_id"].isna()]["kept"].all() and got[got["doc_id"] == 2]["n_shingles"].tolist() == [0]
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.drop_near_duplicates(odd_docs, 5, 80)
    assert kept.schema == odd_docs.schema
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 2, 3, 4, 5, 7, 9, 10, 11] and sum(none for none, _ in ids) == 2


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(0)
    one = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    for share in (0.2, 0.5, 0.9):
        n = int(len(one) * 2 * share / (1 + share))
        two = np.unique(np.concatenate([one[:n], rng.integers(0, 1 << 63, len(one) - n, dtype=np.uint64)]))
        bits = [minhash.packed(minhash.minima(s)).view(np.int64).tolist() for s in (one, two)]
        df = spark.createDataFrame([tuple(bits)], "a array<long>, b array<long>")
        assert abs(df.select(minhash.estimate(df["a"], df["b"])).first()[0] - share) < 0.12


def brute_items(docs, items, width=5, percent=80):
    out = {}
    for i, t in docs:
        s = shingles(t, width)
        for j, u in items:
            q = shingles(u, width)
            if q and 100 * len(q & s) >= percent * len(q):
                key = (i, j, len(q))
                out[key] = max(out.get(key, 0), len(q & s))
    return {(*k, v) for k, v in out.items()}


def test_contaminated(spark):
    rng = np.random.default_rng(8)
    v = [f"v{i}" for i in range(400)]
    items = [(j, " ".join(rng.choice(v, int(rng.integers(1, 60))))) for j in range(60)] + [(60, None), (61, ""), (62, "a b c"), (3, "again another item with the same id as one above"), (None, "item without any id but with words")]
    docs = []
    for i in range(120):
        w = list(rng.choice(v, int(rng.integers(0, 900))))
        for _ in range(int(rng.integers(0, 3))):
            part = items[int(rng.integers(60))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                part[int(rng.integers(len(part)))] = "edited"
            at = int(rng.integers(len(w) + 1))
            w[at:at] = part
        docs.append((i, " ".join(w)))
    docs += [(500, "A  b\tC"), (501, None), (501, items[7][1]), (None, items[8][1]), (502, "xx item without ANY id but with words")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(d, b).collect()}
    expected = brute_items(docs, items)
    assert got == expected and len(expected) > 30
    left = sorted((r["doc_id"] or -1, r["text"] or "") for r in decontaminate.drop_contaminated(d, b).collect())
    assert left == sorted((i or -1, t or "") for i, t in docs if not brute_items([(i, t)], items))


def test_contaminated_in_blocks(spark, monkeypatch):
    docs = [(i, " ".join(f"a{(i * 7 + k) % 90}" for k in range(40))) for i in range(30)]
    items = [(i, " ".join(f"a{(i * 11 + k) % 90}" for k in range(20))) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4_000)
    assert {tuple(r) for r in decontaminate.contaminated(d, b).collect()} == brute_items(docs, items)


def test_contaminated_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "the cat sat on the mat and looked", "x")], "item_id long, text string, doc_id string")
    assert {r["doc_id"] for r in decontaminate.contaminated(odd_docs, b).collect()} == {1, 12}
    assert decontaminate.contaminated(no_docs, b).count() == 0 and decontaminate.contaminated(odd_docs, b.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, b).schema == odd_docs.schema


def brute_vectors(rows, cosine=0.98):
    good = []
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(e, dtype="float64")
        good.append((i, label, x / np.linalg.norm(x)))
    links = [(i, j) for n, (i, a, x) in enumerate(good) for j, b, y in good[:n] if a == b and len(x) == len(y) and float(x @ y) >= cosine]
    count = {}
    for p in links:
        for i in p:
            count[i] = count.get(i, 0) + 1
    return components({r[0] for r in rows if r[0] is not None}, links), count


def near_rows(seed, n=900):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(60):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), (centre + rng.normal(0, rng.choice([0.02, 0.12, 0.2]), 32)).astype("float32").tolist(), int(rng.integers(3))))
    return rows[:n]


def test_near_vectors(spark):
    rows = near_rows(1)
    rows += [(5_000 + k, rows[3][1], rows[3][2]) for k in range(40)] + [(6_000, [2 * x for x in rows[3][1]], rows[3][2]), (6_001, rows[3][1], (rows[3][2] + 1) % 3)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    component, count = brute_vectors(rows)
    found, all_ = sum(r["n_links"] for r in got.values()), sum(count.values())
    assert len(got) == len(rows) and found <= all_ and found >= 0.98 * all_
    assert sum(got[i]["component_id"] != c for i, c in component.items()) <= 0.01 * len(rows)


def test_near_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.normal(0, 0.05, 16)).tolist(), 1) for i in range(150)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    component, count = brute_vectors(rows)
    assert {i: r["n_links"] for i, r in got.items()} == {i: count.get(i, 0) for i in got}
    assert {i: r["component_id"] for i, r in got.items()} == component


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0] * 4, 1), (6, [1.0, None, 2.0, 3.0], 1), (7, [float("nan")] * 4, 1), (8, [float("inf"), 0.0, 0.0, 0.0], 1), (None, v, 1), (9, [1.0, 2.0], 1), (10, [], 1), (11, [1e300 * x for x in v], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, copies long")
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect())
    assert [(i, n) for i, n, _, _ in got if n] == [(1, 3), (2, 3), (2, 3), (11, 3)]
    assert {c for i, _, c, _ in got if i in (1, 2, 11)} == {1} and all(k for i, _, _, k in got if i not in (2, 11))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_codes_are_balanced():
    rng = np.random.default_rng(0)
    x = embeddings.unit_rows(list(rng.standard_normal((3_000, 64)) * np.linspace(0.2, 3, 64)))
    code = embeddings.codes(x, *embeddings.rotation(x))
    share = np.array([(code >> np.uint64(b) & np.uint64(1)).mean() for b in range(64)])
    assert np.abs(share - 0.5).max() < 0.1
