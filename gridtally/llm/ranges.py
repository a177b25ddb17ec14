"""Splitting of rows into ordered parts of even size, also where one key holds a large share of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows looked at for each part to choose the bounds; it decides how even the parts are, never what they hold.
PER_PART = 100
#: Letters of a key that a bound keeps.
KEY_LETTERS = 2_000


def bounds(df: DataFrame, key: Column, tie: Column, per_part: int = PER_PART) -> list[tuple[str, int]]:
    """Ascending (key, tie) pairs that cut ``df`` into as many parts as there are shuffle partitions.

    Rows are counted once, and those whose hash falls below the share wanted come to the driver: some ``per_part`` a part
    over all tasks together, however many rows there are. Repeats of a row count as one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted, n = parts * per_part, df.count()
    picks = df.select(key.alias("k"), tie.alias("t"))
    if n > wanted:
        picks = picks.where(F.xxhash64("t", "k") < F.lit(int(wanted / n * 2**64) - 2**63))
    rows = sorted((r["k"], r["t"]) for r in picks.select(F.substring("k", 1, KEY_LETTERS).alias("k"), "t").distinct().collect())
    if not rows:
        return []
    found = [rows[len(rows) * i // parts] for i in range(1, parts)]
    return sorted(set(found))


def part_of(key: Column, tie: Column, cuts: list[tuple[str, int]]) -> Column:
    """Number of the part that (key, tie) falls into: how many cuts are not above it, by binary search."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        k, t = cuts[mid]
        return F.when((key > k) | ((key == k) & (tie >= t)), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(cuts))
