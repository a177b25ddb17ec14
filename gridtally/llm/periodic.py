"""Periodic runs of words by block convolution.

At scale B = 1, 2, 4, ... the words are cut into blocks of B. A run of period q, B <= q < 2B, and of four periods or more
holds a whole block with its copy q words on, so every run shows as a place d in B..2B-1 words on where the block
occurs again. The sum of squared differences of word numbers between a block and all places of the window behind it
is a convolution, computed by number-theoretic transforms; a sum of zero is an occurrence. Each occurrence is a seed
(block, d), which is extended both ways as long as words d apart are equal.

Blocks that cannot occur in their window, because one of their words does not, are left out before the transform, as are
blocks deep inside of a run of smaller period, which would find that run again. Many short documents are searched as
one sequence with a word of its own behind each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.session import ship_package

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Primes p with a primitive root, p - 1 divisible by a high power of two. Sums below their product are exact.
PRIMES = [(998244353, 3), (469762049, 3), (2013265921, 31)]
#: Words searched as one sequence, unless one document has more, and numbers transformed at once.
SEQUENCE, BATCH = 100_000, 1 << 19

_roots: dict[tuple[int, int, bool], np.ndarray] = {}


def _modulo(x: np.ndarray, p: int) -> np.ndarray:
    x -= x // np.uint64(p) * np.uint64(p)
    return x


def _powers(size: int, p: int, root: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a ``size``-th root of unity modulo ``p``, or of its inverse."""
    if (size, p, inverse) not in _roots:
        w = pow(root, (p - 1) // size * (-1 if inverse else 1), p)
        powers = np.ones(max(1, size // 2), dtype=np.uint64)
        known = 1
        while known < len(powers):
            more = min(known, len(powers) - known)
            powers[known : known + more] = _modulo(powers[:more] * np.uint64(pow(w, known, p)), p)
            known += more
        _roots[size, p, inverse] = powers
    return _roots[size, p, inverse]


def transform(a: np.ndarray, p: int, root: int) -> np.ndarray:
    """Number-theoretic transform modulo ``p`` of each column of ``a`` in bit-reversed order; ``a`` is overwritten."""
    size, columns = a.shape
    half, m = size // 2, np.uint64(p)
    while half:
        v = a.reshape(size // (2 * half), 2, half, columns)
        x, y = v[:, 0], v[:, 1]
        low = x + y
        np.subtract(low, m, out=low, where=low >= m)
        v[:, 1] = _modulo((x + (m - y)) * _powers(2 * half, p, root, False)[None, :, None], p)
        v[:, 0] = low
        half //= 2
    return a


def back_transform(a: np.ndarray, p: int, root: int) -> np.ndarray:
    """Undoes ``transform``."""
    size, columns = a.shape
    half, m = 1, np.uint64(p)
    while half < size:
        v = a.reshape(size // (2 * half), 2, half, columns)
        x = v[:, 0].copy()
        y = _modulo(v[:, 1] * _powers(2 * half, p, root, True)[None, :, None], p)
        low = x + y
        np.subtract(low, m, out=low, where=low >= m)
        high = x + (m - y)
        np.subtract(high, m, out=high, where=high >= m)
        v[:, 0], v[:, 1] = low, high
        half *= 2
    return _modulo(a * np.uint64(pow(size, -1, p)), p)


def occurrences(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) wherever the ``size`` words from ``at`` on occur again ``size`` to ``2 * size - 1`` words on.

    ``words`` are numbers from 0 on; behind the last one follows as much filling, unequal to all of them, as is needed.
    The sums are exact while ``size`` times the square of the largest number is below 9e26.
    """
    filler = int(words.max()) + 1 if len(words) else 0
    padded = np.concatenate([words, np.full(3 * size, filler)])
    blocks, places = [], []
    step = max(1, BATCH // (2 * size))
    for first in range(0, len(at), step):
        some = at[first : first + step]
        block = padded[some + np.arange(size)[:, None]].astype(np.uint64)
        window = padded[some + np.arange(size, 3 * size)[:, None]].astype(np.uint64)
        zero, known = np.ones((size, len(some)), dtype=bool), 1
        for p, root in PRIMES:
            m = np.uint64(p)
            b, w = _modulo(block.copy(), p), _modulo(window.copy(), p)
            own = _modulo(_modulo(b * b, p).sum(axis=0), p)
            total = np.concatenate([np.zeros((1, len(some)), np.uint64), np.cumsum(_modulo(w * w, p), axis=0)])
            theirs = _modulo(total[size : 2 * size] - total[:size], p)
            mirrored = np.zeros_like(w)
            mirrored[:size] = b[::-1]
            product = _modulo(transform(mirrored, p, root) * transform(w, p, root), p)
            both = back_transform(product, p, root)[size - 1 : 2 * size - 1]
            zero &= _modulo(own + theirs + np.uint64(2) * (m - both), p) == 0
            known *= p
            if known > size * filler * filler or not zero.any():
                break
        d, i = np.nonzero(zero)
        blocks.append(some[i])
        places.append(d + size)
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    block, distance = np.concatenate(blocks), np.concatenate(places)
    order = np.lexsort((distance, block))
    return block[order], distance[order]


def _agreement(words: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from ``a`` and from ``b`` on agree, at most ``most``; ``step`` is 1 forwards and -1 backwards."""
    done, size = 0, 16
    while done < most:
        n = min(size, most - done)
        if step > 0:
            x, y = words[a + done : a + done + n], words[b + done : b + done + n]
        else:
            x, y = words[a - done - n + 1 : a - done + 1][::-1], words[b - done - n + 1 : b - done + 1][::-1]
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, size = done + n, size * 4
    return done


def find_runs(words: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs. ``words``: numbers from 0 on, where documents end at ``stops`` with a number of their own."""
    n, runs = len(words), {}
    longest = int(np.diff(np.concatenate([[0], stops + 1])).max()) - 1 if len(stops) else n
    counts = np.bincount(words) if n else np.zeros(0, np.int64)
    keys = np.sort(words * (n + 1) + np.arange(n))
    rare = counts[words] * n + np.arange(n)  # the rarest word of each block, by minima of pairs of blocks
    covered = np.zeros(n, dtype=np.int64)  # where the run ends that reaches furthest from here

    def recurs(pos: np.ndarray, lo: int, hi: int) -> np.ndarray:
        base = words[pos] * (n + 1)
        j = np.searchsorted(keys, base + np.minimum(pos + lo, n))
        return (j < n) & (keys[np.minimum(j, n - 1)] < base + np.minimum(pos + hi, n))

    size = 1
    while max(LEAST, TIMES * size) <= longest:
        at = np.flatnonzero(rare >= 2 * n)
        at = at[recurs(rare[at] % n, size, 2 * size)] * size
        for offset in sorted({0, size - 1, size // 2}):
            at = at[recurs(at + offset, size, 2 * size)]
        if len(at):
            stop = stops[np.searchsorted(stops, at)] if len(stops) else np.full(len(at), n)
            at = at[covered[at] < np.minimum(at + 3 * size - 1, stop)]
        reach: dict[int, int] = {}
        for i, d in zip(*(x.tolist() for x in occurrences(words, at, size))):
            if covered[i] >= i + size + d or reach.get(d, -1) >= i + size + d:
                continue
            right = i + size + _agreement(words, i + size, i + size + d, n - i - size - d, 1) + d
            left = i - _agreement(words, i - 1, i - 1 + d, i, -1)
            reach[d] = right
            if right - left >= max(LEAST, TIMES * d):
                runs.setdefault((left, right), d)
        for left, right in runs:
            if runs[left, right] >= size:
                np.maximum(covered[left:right], right, out=covered[left:right])
        even = len(rare) // 2 * 2
        rare = np.minimum(rare[0:even:2], rare[1:even:2])
        size *= 2
    return sorted((left, right - left, d) for (left, right), d in runs.items())


def search(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    numbers: dict[bytes, int] = {}
    sequence, stops, at = [], [], 0
    for words in documents:
        sequence.append([numbers.setdefault(w, len(numbers)) for w in words])
        at += len(words)
        stops.append(at)
        at += 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    flat = np.empty(at, dtype=np.int64)
    for i, (codes, stop) in enumerate(zip(sequence, stops)):
        flat[stop - len(codes) : stop] = codes
        flat[stop] = len(numbers) + i
    ends = np.array(stops, dtype=np.int64)
    for start, length, period in find_runs(flat, ends):
        i = int(np.searchsorted(ends, start))
        found[i].append((start - (stops[i] - len(documents[i])), length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat the first period of a run, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep))


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: every run of the text's words, by start, then period, and the text without repeats.

    Words are split at ASCII white space. A run is a stretch of words with smallest period q (words q apart are equal) of at
    least LEAST words and TIMES periods that no word beside it prolongs. ``prepare`` may change the words of a document
    first. Null and empty texts have no words, no runs and an empty collapsed text; null and repeated doc_id and
    other columns make no difference. Runs never join two documents.
    """

    def flush(ids: list, lists: list[list[bytes]]) -> pa.RecordBatch:
        runs = search(lists)
        flat = [r for rs in runs for r in rs]
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
        texts = [collapsed(w, r).decode("utf-8") for w, r in zip(lists, runs)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in lists], pa.int64()), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(RUNS.value_type))), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode("utf-8").split()
                if prepare is not None:
                    words = prepare(doc_id, words)
                if lists and size + len(words) > SEQUENCE:
                    yield flush(ids, lists)
                    ids, lists, size = [], [], 0
                ids.append(doc_id)
                lists.append(words)
                size += len(words) + 1
            if lists:
                yield flush(ids, lists)

    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, told by the crc32 of its id, repeats a stretch of its words up to its end; a null id never does."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, its longest run and digests of all runs and of the collapsed text, after ``repeat_tail``."""
    found = periodic_runs(docs, repeat_tail)
    runs = F.col("runs")
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    # The greatest of (length, -start, -period) is the longest run, among equals the first, then that of the smallest period.
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("under"))))
    rows = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("best.under")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.under)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
