"""Quality and toxicity: held-out accuracy, counterfactual pairs, odd input."""

import zlib

import numpy as np
import pandas as pd
import pytest

from gridtally.llm import quality, toxicity
from gridtally.llm.features import Words, calibration, feature_sets, quality_ngrams

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module, label, call, folds, rest", [(quality, "quality", "quality_scores", 5, 0), (toxicity, "toxic", "toxicity_scores", 4, 2)])
def test_held_out_accuracy(spark, module, label, call, folds, rest):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = getattr(module, call)(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds == rest for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held[label]).mean() > 0.97
    assert held["score"].between(0, 1).all() and ((held["score"] >= 0.3) == (held["predicted"] == 1)).all()


@pytest.mark.parametrize("call", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows(odd_docs, no_docs, odd_labels, call):
    got = call(odd_docs, odd_labels).toPandas()
    assert len(got) == odd_docs.count() and got["score"].between(0, 1).all() and got["held_out"].notna().all()
    assert got[got["doc_id"] == 1]["score"].nunique() == 1
    assert call(no_docs, odd_labels).count() == 0
    bare = call(odd_docs, odd_labels.limit(0)).toPandas()
    assert (bare["score"] == 0.5).all()


def test_keeping_leaves_columns(odd_docs, odd_labels):
    for keep in (quality.keep_good, toxicity.keep_civil):
        assert keep(odd_docs, odd_labels).schema == odd_docs.schema


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(200)]
    y = np.array([1 if (r < 20).sum() >= 3 else 0 for r in rows])
    values = [np.ones(6) / np.sqrt(6) for _ in rows]
    w, b = quality.dual_coordinate_descent(rows, values, y, rounds=300)
    box = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    sign = np.where(y > 0, 1, -1)

    def loss(w, b):
        m = np.array([w[r] @ v + b for r, v in zip(rows, values)])
        return 0.5 * (w @ w + b * b) + (box * np.maximum(0, 1 - sign * m)).sum()

    best = loss(w, b)
    for _ in range(200):
        assert best <= loss(w + np.where(np.arange(len(w)) < 40, rng.normal(0, 0.05, len(w)), 0), b + rng.normal(0, 0.05)) + 1e-3


def test_log_count_ratios_by_hand():
    r = quality.log_count_ratios([np.array([3, 5]), np.array([3]), np.array([5, 9])], np.array([1, 1, 0]))
    assert r[3] == pytest.approx(np.log(3 / 4) - np.log(1 / 3)) and r[9] == 0.0


def test_counterfactual_pairs():
    pairs = list(toxicity.counterfactuals("We saw Muslims here. Nothing else! Two women spoke."))
    assert ("We saw Muslims here.", "We saw Jews here.") in pairs and all("Nothing" not in s for s, _ in pairs)
    assert {c for s, c in pairs if "women" in s} == {f" Two {t} spoke." for t in ("men", "girls", "boys")}


def test_penalty_lowers_false_positives_on_group_mentions():
    rng = np.random.default_rng(5)
    fill = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(1_200):
        toxic = i % 3 == 0
        words = list(rng.choice(fill, 20))
        if toxic:
            words[3] = str(rng.choice(["vile", "scumbag"]))
        if rng.random() < (0.6 if toxic else 0.03):
            words[9] = "muslims"
        elif rng.random() < 0.1:
            words[9] = str(rng.choice(["christians", "jews", "hindus"]))
        rows.append((i, int(toxic), " ".join(words)))
    pdf = pd.DataFrame(rows, columns=["_id", "y", "text"])
    neutral = [" ".join([*rng.choice(fill, 8), "muslims", *rng.choice(fill, 8)]) for _ in range(200)]
    plain = [t.replace("muslims", "christians") for t in neutral]

    def gap(fairness):
        f = toxicity.fit(pdf, fairness)
        w, r = (np.frombuffer(f[c][0], "float32") for c in ("weight", "ratio"))
        from gridtally.llm.features import margins, stem_ngrams

        return np.abs(margins(neutral, stem_ngrams, w, r, 0.0) - margins(plain, stem_ngrams, w, r, 0.0)).mean()

    assert gap(10.0) < 0.3 * gap(0.0)


def test_words_match_a_plain_split():
    texts = [b"The  CAT\tsat,", b"", b"\x0b ", "É cat THE ".encode(), b"a" * 200 + b" " + b"a" * 199 + b"b"]
    w = Words(texts)
    expected = [(i, x) for i, t in enumerate(texts) for x in t.lower().split()]
    assert w.text.tolist() == [i for i, _ in expected]
    seen = {}
    for h, (_, x) in zip(w.whole().tolist(), expected):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_feature_sets_do_not_depend_on_neighbours():
    texts = ["The THE cat", None, "", "cat"] * 3
    together = feature_sets(texts, quality_ngrams)
    assert all((a == feature_sets([t], quality_ngrams)[0]).all() for a, t in zip(together, texts))


def test_calibration_of_one_class():
    slope, offset = calibration(np.zeros(3), np.ones(3))
    assert slope == 0.0 and offset > 0
