"""Toxicity classifier with a counterfactual penalty (Garg et al., 2019).

A logistic model over word and stem indicators is trained together with pairs of sentences that differ only
in an identity term; the squared difference of their scores is penalised, so that neutral mentions of a group
do not raise the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import unused
from gridtally.llm.features import BITS, calibration, feature_sets, held_out, labelled_sample, logistic, margins, stem_ngrams
from gridtally.llm.quality import log_count_ratios, scaled
from gridtally.session import ship_package

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Training documents of each class at most; the one bound of the model, see README.
PER_CLASS = 3_000
#: Standard errors by which a feature's log-ratio is drawn towards zero.
SHRINK = 1.5
#: Weight of the counterfactual penalty.
FAIRNESS = 10.0
#: Terms of one line can stand for each other in a sentence.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives", "citizens"), ("african", "european", "american", "mexican", "chinese"),
    ("femmes", "hommes", "filles"), ("frauen", "männer", "mädchen"), ("mujeres", "hombres", "chicas"),
)
_GROUP = {t: g for g in IDENTITY_TERMS for t in g}
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


def counterfactuals(text: str) -> Iterator[tuple[str, str]]:
    """(sentence, swapped sentence) for each sentence with identity terms, one per alternative in its group."""
    for s in _SENTENCE.findall(text):
        terms = [m for m in _WORD.finditer(s) if m[0].lower() in _GROUP]
        if not terms:
            continue
        for shift in range(1, max(len(_GROUP[m[0].lower()]) for m in terms)):
            def swap(m: re.Match, shift: int = shift) -> str:
                group = _GROUP.get(m[0].lower())
                if group is None:
                    return m[0]
                other = group[(group.index(m[0].lower()) + shift) % len(group)]
                return other.capitalize() if m[0][:1].isupper() else other

            changed = _WORD.sub(swap, s)
            if changed != s:
                yield s, changed


def difference(one: np.ndarray, two: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and values by which the scaled indicators of two sentences differ."""
    x = np.union1d(one, two)
    d = np.zeros(len(x))
    d[np.searchsorted(x, one)] += scaled(one, r)
    d[np.searchsorted(x, two)] -= scaled(two, r)
    return x[d != 0], d[d != 0]


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], fairness: float, rounds: int = 6, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps over the documents; after each round over them the pairs' scores are drawn together.

    The step for a pair is the exact minimiser of its penalty, ``fairness`` times the squared score difference, plus the
    squared distance from the weights so far.
    """
    share = min(max((y > 0).mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w, g2, b, gb = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6
    order = np.random.default_rng(11)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            x, v = rows[i], r[rows[i]]
            norm = np.sqrt((v * v).sum()) or 1.0
            v = v / norm
            p = logistic(w[x] @ v + b)
            d = weight[i] * (p - y[i])
            g = d * v + decay * w[x]
            g2[x] += g * g
            w[x] -= 0.5 * g / np.sqrt(g2[x])
            gb += d * d
            b -= 0.5 * d / np.sqrt(gb)
        for x, d in pairs if fairness > 0 else ():
            w[x] -= fairness * (w[x] @ d) / (1 + fairness * (d @ d)) * d
    return w, b


def fit(pdf: pd.DataFrame, fairness: float = FAIRNESS) -> pd.DataFrame:
    """One row with the weights, bias and calibration learnt from (y, text) rows.

    The log-ratio of a feature's counts in the classes scales its indicator.
    """
    pdf = pdf.sort_values(["_id", "y", "text"], kind="stable")
    rows = feature_sets(list(pdf["text"]), stem_ngrams)
    y = pdf["y"].to_numpy().astype("float64")
    if not len(y) or y.min() == y.max():
        slope, offset = calibration(np.zeros(len(y)), y)
        return pd.DataFrame({"weight": [np.zeros(1 << BITS, "float32").tobytes()], "ratio": [np.zeros(1 << BITS, "float32").tobytes()], "fitted": [[0.0, slope, offset]]})
    r = log_count_ratios(rows, y, shrink=SHRINK)
    swaps = [p for t in pdf["text"] for p in counterfactuals(t)]
    sides = zip(feature_sets([s for s, _ in swaps], stem_ngrams), feature_sets([c for _, c in swaps], stem_ngrams))
    pairs = [difference(s, c, r) for s, c in sides]
    w, b = descend(rows, y, r, pairs, fairness)
    slope, offset = calibration(margins(list(pdf["text"]), stem_ngrams, w, r, b), y)
    return pd.DataFrame({"weight": [w.astype("float32").tobytes()], "ratio": [r.astype("float32").tobytes()], "fitted": [[b, slope, offset]]})


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fairness: float = FAIRNESS) -> dict:
    """The model learnt from the labelled rows outside the held-out fold, as plain arrays of fixed size."""
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class)
    found = sample.groupBy(F.lit(0).alias("g")).applyInPandas(lambda pdf: fit(pdf, fairness), "weight binary, ratio binary, fitted array<double>").first()
    if found is None:
        z = np.zeros(1 << BITS, dtype="float32")
        return {"ratio": z, "weight": z, "fitted": [0.0, 0.0, 0.0]}
    return {"ratio": np.frombuffer(found["ratio"], "float32"), "weight": np.frombuffer(found["weight"], "float32"), "fitted": list(found["fitted"])}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability that the whole text is toxic; null counts as empty.

    Every column of ``docs`` stays, but one of that name is replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        b, slope, offset = m["fitted"]
        for pdf in frames:
            for at in range(0, len(pdf), 1000):  # whole batches of texts would stand in memory once more on their way back
                part = pdf.iloc[at : at + 1000]
                yield part.assign(**{name: logistic(slope * margins(list(part["text"]), stem_ngrams, m["weight"], m["ratio"], b) + offset)})

    kept = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    return kept.mapInPandas(run, schema=kept.withColumn(name, F.lit(0.0)).schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if the score is at least 0.3).

    Null ids are scored and count as not held out; repeated rows are scored one by one; with no usable
    labels every score is 0.5; columns other than doc_id and text are never read.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), per_class)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_civil(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents not predicted to be toxic, with their columns unchanged."""
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), per_class)
    name = unused(docs, "_score")
    return score(docs, model, name).where(F.col(name) < THRESHOLD).select(*docs.columns)
