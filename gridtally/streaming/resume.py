"""Idempotent resume (A12): run only what has no complete result yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skip_completed(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks that have no finished row."""
    return todo.join(done.select(*keys), keys, "left_anti")


def is_complete(done: DataFrame, expected_rows: int) -> bool:
    """Whether an output holds at least the expected rows and can be reused as it is."""
    return done.agg(F.count(F.lit(1)).alias("n")).first()["n"] >= expected_rows
