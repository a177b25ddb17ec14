"""Quality classifier: a linear support vector machine over Naive Bayes features (Wang and Manning, 2012).

Each n-gram indicator is scaled by the log-ratio of its smoothed counts in the two classes; a hinge-loss
model over the scaled, length-normalised indicators is fitted by dual coordinate descent (Hsieh et al., 2008).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import unused
from gridtally.llm.features import BITS, calibration, feature_sets, held_out, labelled_sample, logistic, margins, quality_ngrams
from gridtally.session import ship_package

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Training documents of each class at most; the one bound of the model, see README.
PER_CLASS = 3_000


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, shrink: float = 0.0) -> np.ndarray:
    """Log-ratio per feature of its share among the indicators of class 1 and of class 0.

    Each ratio is drawn towards zero by ``shrink`` of its standard errors, which mutes rare features.
    """
    counts = np.full((2, 1 << BITS), alpha)
    for x, label in zip(rows, y):
        counts[int(label)][x] += 1
    seen = counts.sum(axis=0) >= 2 * alpha + 2
    n1, n0 = max((y > 0).sum(), 1), max((y <= 0).sum(), 1)
    r = np.log(counts[1] / (n1 + 2 * alpha)) - np.log(counts[0] / (n0 + 2 * alpha))
    r = np.sign(r) * np.maximum(np.abs(r) - shrink * np.sqrt((1 / counts).sum(axis=0)), 0.0)
    return np.where(seen, r, 0.0)


def scaled(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = r[x]
    n = np.sqrt((v * v).sum())
    return v / n if n > 0 else v


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss; both classes weigh the same."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = max((y > 0).mean(), 1e-9)
    box = cost * np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-9))
    w, b, a = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    size = np.array([(v * v).sum() + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = sign[i] * (w[x] @ v + b) - 1.0
            new = min(max(a[i] - slope / size[i], 0.0), box[i])
            step = (new - a[i]) * sign[i]
            if step:
                w[x] += step * v
                b += step
                moved = max(moved, abs(step))
                a[i] = new
        if moved < 1e-4:
            break
    return w, b


def fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row with the scaled weights, bias and calibration learnt from (y, text) rows."""
    pdf = pdf.sort_values(["_id", "y", "text"], kind="stable")
    rows = feature_sets(list(pdf["text"]), quality_ngrams)
    y = pdf["y"].to_numpy()
    r = log_count_ratios(rows, y) if len(y) else np.zeros(1 << BITS)
    values = [scaled(x, r) for x in rows]
    w, b = dual_coordinate_descent(rows, values, y) if len(y) and y.min() != y.max() else (np.zeros(1 << BITS), 0.0)
    slope, offset = calibration(np.array([w[x] @ v + b for x, v in zip(rows, values)]), y)
    return pd.DataFrame({"ratio": [r.astype("float32").tobytes()], "weight": [w.astype("float32").tobytes()], "fitted": [[b, slope, offset]]})


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS, remainder: int = HELD_OUT) -> dict:
    """The model learnt from the labelled rows outside the held-out fold, as plain arrays of fixed size."""
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", folds, remainder, per_class)
    found = sample.groupBy(F.lit(0).alias("g")).applyInPandas(lambda pdf: fit(pdf), "ratio binary, weight binary, fitted array<double>").first()
    if found is None:
        z = np.zeros(1 << BITS, dtype="float32")
        return {"ratio": z, "weight": z, "fitted": [0.0, 0.0, 0.0]}
    return {"ratio": np.frombuffer(found["ratio"], "float32"), "weight": np.frombuffer(found["weight"], "float32"), "fitted": list(found["fitted"])}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of label 1 for the whole text; null counts as empty.

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
                yield part.assign(**{name: logistic(slope * margins(list(part["text"]), quality_ngrams, m["weight"], m["ratio"], b) + offset)})

    kept = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    return kept.mapInPandas(run, schema=kept.withColumn(name, F.lit(0.0)).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if the score is at least 0.3).

    Null ids are scored and count as not held out; repeated rows are scored one by one; with no usable
    labels every score is 0.5; columns other than doc_id and text are never read.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), per_class)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents predicted to be of good quality, with their columns unchanged."""
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), per_class)
    name = unused(docs, "_score")
    return score(docs, model, name).where(F.col(name) >= THRESHOLD).select(*docs.columns)
