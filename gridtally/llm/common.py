"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.session import scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as one table in the shared folder and read back, which cuts its lineage."""
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that sums and products of codes spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(frames: Iterable[pd.DataFrame], keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply ``fn`` to each run of equal keys of sorted batches; only the open run is carried over."""
    rest: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        k = pdf[keys]
        new = (k != k.shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        if rest and (rest[-1][keys].iloc[-1] == k.iloc[0]).all():
            starts = starts[1:]
        done = []
        at = 0
        for s in starts:
            piece = pdf.iloc[at:s]
            if rest:
                piece = pd.concat([*rest, piece]) if len(piece) else pd.concat(rest)
                rest = []
            if len(piece):
                done.append(fn(piece.reset_index(drop=True)))
            at = s
        rest.append(pdf.iloc[at:])
        done = [d for d in done if len(d)]
        if done:
            yield pd.concat(done, ignore_index=True)
    if rest:
        yield fn(pd.concat(rest, ignore_index=True))
