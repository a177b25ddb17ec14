"""Hashed n-gram indicators of whole texts, and the rows that train a classifier on them.

Texts are joined to one byte array a piece at a time, and words, shapes and leading parts are hashed by array
operations over it, so cost is in proportion to the bytes whatever the vocabulary. A text becomes the sorted
set of its hashed features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import fold, mix

BITS = 20
#: Bytes of text hashed at once; a longer text is a piece of its own.
PIECE = 1 << 19
PREFIXES = (5, 6, 7, 8, 10)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _LETTER[_a:_b] = True
#: Shape of a byte: digits, capitals, small letters and bytes beyond ASCII fold to one mark each.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)], dtype=np.uint64)


class Words:
    """The words of several texts as arrays: the text each belongs to and hashes of its parts."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        gap = _SPACE[raw]
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.stop = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        self.text = np.searchsorted(ends, self.start, side="left")
        self._raw, self._word = raw, np.cumsum(np.concatenate([[False], gap[:-1] & ~gap[1:]])) - 1
        self._word[self._word < 0] = 0

    def _kept(self, values: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the kept bytes, their place among the kept bytes of the word, and the running sum of terms."""
        at = np.flatnonzero(keep)
        word = self._word[at]
        first = np.searchsorted(at, self.start)
        place = np.arange(len(at)) - first[word]
        term = (values[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
        if len(place) and place.max() > 63:
            term *= (2 * (place >> 6) + 1).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        return first, np.searchsorted(at, self.stop), total

    def whole(self) -> np.ndarray:
        """Hash of each word with A-Z lower-cased."""
        first, last, total = self._kept(_LOW[self._raw], ~_SPACE[self._raw])
        return mix(total[last] - total[first])

    def shapes(self) -> np.ndarray:
        """Hash of each word's shape: its byte classes with runs folded."""
        kind = _CLASS[self._raw]
        keep = ~_SPACE[self._raw]
        keep[1:] &= kind[1:] != kind[:-1]
        first, last, total = self._kept(kind, keep)
        return mix(total[np.minimum(last, first + 24)] - total[first])

    def stems(self, lengths: tuple[int, ...] = PREFIXES) -> list[np.ndarray]:
        """Hashes of the word's letters and digits alone, whole and cut to each of ``lengths`` bytes."""
        low = _LOW[self._raw]
        first, last, total = self._kept(low, _LETTER[low])
        out = [mix(total[last] - total[first])]
        for n in lengths:
            out.append(mix(total[np.minimum(last, first + n)] - total[first] + np.uint64(n << 8)))
        return out


def quality_ngrams(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words, word pairs and shape 1- to 3-grams; a word equal to the one before has a shape of its own."""
    w, s, t = words.whole(), words.shapes(), words.text
    two, three = t[1:] == t[:-1], t[2:] == t[:-2]
    s[1:][(w[1:] == w[:-1]) & two] = np.uint64(61)
    u = np.uint64
    return [
        (t, w), (t, s + u(1 << 33)),
        (t[1:][two], (w[:-1] * u(3) + w[1:] * u(5) + u(1 << 40))[two]), (t[1:][two], (s[:-1] * u(7) + s[1:] * u(11) + u(1 << 41))[two]),
        (t[2:][three], (s[:-2] * u(13) + s[1:-1] * u(17) + s[2:] * u(19) + u(1 << 42))[three]),
    ]


def stem_ngrams(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words without punctuation and their leading parts."""
    return [(words.text, h) for h in words.stems()]


def indicators(texts: list[str | None], grams: Callable[[Words], list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, text index, feature) per piece; features of a text are distinct and sorted."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        size, to = len(raw[at]), at + 1
        while to < len(raw) and size + len(raw[to]) <= PIECE:
            size += len(raw[to])
            to += 1
        words = Words(raw[at:to])
        if len(words.start):
            key = np.concatenate([(t.astype(np.uint64) << np.uint64(BITS)) | (mix(h) >> np.uint64(64 - BITS)) for t, h in grams(words)])
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            yield at, to - at, (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
        else:
            yield at, to - at, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = to


def feature_sets(texts: list[str | None], grams: Callable) -> list[np.ndarray]:
    """The features of each text."""
    out: list[np.ndarray] = []
    for _, n, doc, x in indicators(texts, grams):
        out += np.split(x, np.searchsorted(doc, np.arange(1, n)))
    return out


def margins(texts: list[str | None], grams: Callable, weight: np.ndarray, ratio: np.ndarray, bias: float) -> np.ndarray:
    """Linear score of each text over its ratio-scaled indicators, brought to unit length."""
    out = np.zeros(len(texts))
    for at, n, doc, x in indicators(texts, grams):
        v = ratio[x]
        norm = np.sqrt(np.bincount(doc, v * v, minlength=n))
        dot = np.bincount(doc, v * weight[x], minlength=n)
        out[at : at + n] = np.divide(dot, norm, out=np.zeros(n), where=norm > 0) + bias
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """At most ``per_class`` training documents of each label as (y, text), picked by hash of the id.

    Rows whose fold is ``held_out`` and labels other than 0 and 1 take no part. A document with both labels
    counts under each. The bound makes the sample safe to broadcast and to train on in one task.
    """
    ids = docs.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("_id"), folds) != held_out))
        .distinct().join(ids, "_id", "left_semi")
    )
    picks = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picks = some if picks is None else picks.unionByName(some)
    return docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(picks), "_id").select(F.col("_y").alias("y"), F.coalesce("text", F.lit("")).alias("text"), "_id")


def calibration(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from scores to the label's probability (Platt, 1999)."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        return 0.0, float(np.log(p / (1 - p)))
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * scores).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (s * scores * scores).sum() + 1e-3, (s * scores).sum(), s.sum() + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500.0, 500.0)))


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == remainder, F.lit(False))
