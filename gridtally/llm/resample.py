"""Target-distribution importance resampling: hashed n-gram weights, random keys, and an exact cut at the k-th key.

Buckets of word n-grams are counted over the corpus and over the target texts; the log-ratio of the two shares is a bucket's
gain, and a document's weight is the sum of gains over its n-grams. A Gumbel variable drawn from the id turns weights into
scores whose greatest k are a sample without replacement. The k-th score is found by weighted median-of-medians
selection: every partition names the median of its remaining keys, the median of these, weighted by how many keys remain, parts
all keys, and at least a quarter of them is settled in each round, until the cutoff is exact. Only the winners are sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.llm.common import stored
from gridtally.session import ship_package

BUCKETS, LONGEST = 10_000, 3
#: Documents of fewer words are scored but never drawn; this share in percent of the others is drawn.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20

_SAME = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Capitals A-Z become small; bytes of characters that no word has become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b in _SAME else 32 for b in range(256))


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    raw = (text or "").encode("utf-8").translate(WORD_BYTES)
    at = 0
    while at < len(raw):
        to = len(raw) if at + PIECE >= len(raw) else raw.find(b" ", at + PIECE)
        to = len(raw) if to < 0 else to
        words = raw[at:to].split()
        if words:
            yield words
        at = to


def buckets(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, bucket of every run of one to LONGEST words that ends in them) for some words at a time."""
    before: list[bytes] = []
    for new in word_lists(text):
        words, skip = before + new, len(before)
        spaced = [b" " + w for w in words]
        codes = list(map(crc32, words))
        found = codes[skip:]
        for n in range(1, LONGEST):  # runs of n + 1 words from those of n words
            codes = list(map(crc32, spaced[n:], codes))
            found += codes[max(skip - n, 0) :]
        yield len(new), np.array(found, dtype=np.int64) % BUCKETS
        before = words[-(LONGEST - 1) :]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all n-grams of all rows; every task sends one row per bucket at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in buckets(text.as_py()):
                    n += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["bucket", "n"])

    ship_package(texts.sparkSession)
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """A thousand times the log-ratio of each bucket's smoothed shares in ``target`` and in ``corpus``, rounded down."""
    both = bucket_counts(corpus).withColumn("side", F.lit(0)).unionByName(bucket_counts(target).withColumn("side", F.lit(1)))
    n = np.zeros((2, BUCKETS), dtype=np.int64)
    for r in both.collect():  # BUCKETS rows of each side at most
        n[r["side"], r["bucket"]] = r["n"]
    s, t = n.tolist()
    all_s, all_t = sum(s), sum(t)
    return np.array([floor(1000 * log((b + 1) * (all_s + BUCKETS) / ((a + 1) * (all_t + BUCKETS)))) for a, b in zip(s, t)], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """A thousandth-grained Gumbel variable drawn from the id; a null id draws like an empty one."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weights, scores = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = features = weight = 0
                for n, found in buckets(text.as_py()):
                    words, features, weight = words + n, features + len(found), weight + int(gains[found].sum())
                n_words.append(words)
                n_features.append(features)
                weights.append(weight)
                scores.append(weight + gumbel(doc_id, seed))
            columns = [pa.array(c, pa.int64()) for c in (n_words, n_features, weights, scores)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


KEY = ["a", "b", "c"]


def _below(bound: tuple[int, int, int], strict: bool):
    """Rows whose key is below ``bound``, or also equal to it."""
    last = F.col("c") < bound[2] if strict else F.col("c") <= bound[2]
    return (F.col("a") < bound[0]) | ((F.col("a") == bound[0]) & ((F.col("b") < bound[1]) | ((F.col("b") == bound[1]) & last)))


def _medians(keys: DataFrame, pivot: tuple[int, int, int] | None) -> list[tuple[int, int, tuple[int, int, int]]]:
    """(side, number, lower median) of each partition's keys up to ``pivot`` (side 0) and above it (side 1); one side without a pivot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches]
        out = []
        if parts:
            a, b, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
            if pivot is None:
                low = np.zeros(len(a), dtype=bool)
            else:
                low = (a < pivot[0]) | ((a == pivot[0]) & ((b < pivot[1]) | ((b == pivot[1]) & (c <= pivot[2]))))
            for side, mine in ((0, low), (1, ~low)):
                x, y, z = a[mine], b[mine], c[mine]
                if len(x):
                    m = np.lexsort((z, y, x))[(len(x) - 1) // 2]
                    out.append((side, len(x), int(x[m]), int(y[m]), int(z[m])))
        columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(columns, ["side", "n", *KEY])

    rows = keys.select(*KEY).mapInArrow(run, "side long, n long, a long, b long, c long").collect()  # two rows a partition at most
    return [(r["side"], r["n"], (r["a"], r["b"], r["c"])) for r in rows]


def weighted_median(medians: list[tuple[int, tuple[int, int, int]]]) -> tuple[int, int, int]:
    """The least key such that the keys up to it carry at least half of the weight."""
    total, seen = sum(n for n, _ in medians), 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> tuple[int, int, int]:
    """The k-th smallest of the distinct (a, b, c), found exactly; ``k`` is between 1 and the number of rows.

    Each round is one pass over the remaining keys, which are stored anew whenever three quarters of them are settled.
    Only two medians a partition reach the driver.
    """
    medians = [(n, key) for _, n, key in _medians(keys, None)]
    held = sum(n for n, _ in medians)
    while True:
        pivot = weighted_median(medians)
        sides = _medians(keys, pivot)
        low = sum(n for side, n, _ in sides if side == 0)
        if low == k:
            return pivot
        if low > k:
            keys, side = keys.where(_below(pivot, strict=False)), 0
        else:
            keys, side, k = keys.where(~_below(pivot, strict=False)), 1, k - low
        medians = [(n, key) for s, n, key in sides if s == side]
        left = sum(n for n, _ in medians)
        if 4 * left <= held:
            keys, held = stored(keys, "keys"), left


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Every row's doc_id, n_features, weight and score, with its rank among the drawn; ``percent`` of the long enough rows are drawn.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Greatest scores are drawn, ties go to the smaller
    doc_id, a null id comes last, and rows alike in both are told apart by their place in the stored scores. Null and
    empty texts have no features, weight 0, and are never drawn while ``least_words`` is positive. With no row to draw all ranks are null.
    """
    gains = bucket_gains(docs, target)
    rows = stored(scored(docs, gains, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    fit = rows.where(F.col("n_words") >= least_words)
    k = fit.count() * percent // 100
    plain = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*plain, F.lit(None).cast("long").alias("rank"))
    keyed = fit.select((-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("b"), F.col("row").alias("c"))
    winners = keyed.where(_below(cutoff(keyed, k), strict=False))
    # The number given by the sort is that of its partition and the place therein, so ranks need the sizes of the partitions only.
    sort = stored(winners.orderBy(*KEY).select(F.col("c").alias("row"), F.monotonically_increasing_id().alias("at")), "winners")
    placed = sort.select("row", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranks = placed.join(F.broadcast(starts), "part").select("row", (F.col("start") + F.col("place") + 1).alias("rank"))
    return rows.join(ranks, "row", "left").select(*plain, "rank")
