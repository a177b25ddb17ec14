"""Metric formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtally.session import ratio

# Fixed value: the small constant in the per-unit denominators.
EPS = 1e-9


def f1(tp: Column, fp: Column, fn: Column, undefined: float | None = 0.0) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn, undefined)


def object_metrics_from_counts(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """F2: per-unit precision and recall with the small constant, exact F1 with 0 when empty."""
    tp, fp, fn = tp.cast("double"), fp.cast("double"), fn.cast("double")
    return {
        "precision": tp / (tp + fp + EPS),
        "recall": tp / (tp + fn + EPS),
        "f1": f1(tp, fp, fn, 0.0),
    }


def pooled(tp: Column, fp: Column, fn: Column, undefined: float | None = 0.0) -> dict[str, Column]:
    """ratios of summed counts; ``undefined`` is 0 in frozen summaries and NULL in analyses."""
    return {
        "precision": ratio(tp, tp + fp, undefined),
        "recall": ratio(tp, tp + fn, undefined),
        "f1": f1(tp, fp, fn, undefined),
    }


def pixel_metrics(tp: Column, fp: Column, fn: Column, convention: str = "exact") -> dict[str, Column]:
    """pixel precision, recall, F1, IoU, Dice, either exact with 0 when undefined or with ``eps``."""
    tp, fp, fn = tp.cast("double"), fp.cast("double"), fn.cast("double")
    if convention == "eps":
        p, r = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
        return {
            "precision": p,
            "recall": r,
            "f1": 2.0 * p * r / (p + r + EPS),
            "iou": tp / (tp + fp + fn + EPS),
            "dice": 2.0 * tp / (2.0 * tp + fp + fn + EPS),
        }
    if convention != "exact":
        raise ValueError(f"convention must be 'exact' or 'eps', got {convention!r}")
    p, r = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    return {
        "precision": p,
        "recall": r,
        "f1": ratio(2.0 * p * r, p + r, 0.0),
        "iou": ratio(tp, tp + fp + fn, 0.0),
        "dice": ratio(2.0 * tp, 2.0 * tp + fp + fn, 0.0),
    }


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL below two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    xd, yd = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(xd), F.stddev_pop(yd)
    ok = (F.count(xd) >= 2) & (sx > 1e-8) & (sy > 1e-8)
    return F.when(ok, F.covar_pop(xd, yd) / (sx * sy))
