"""Packing of documents into fixed windows by non-negative least squares over length combinations (Krell et al., 2021).

Documents are cut at full windows; what remains of each falls into a length bin. Shallow combinations of bins that
fill a window exactly are enumerated, their repeat counts are fitted to the histogram of bins, rounded down to what
is available, and dealt out by rank within each bin. The rest is packed greedily: one stream filling window
after window. Only the histogram (a fixed number of bins) reaches the driver; documents are placed by rank arithmetic.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.llm.common import stored
from gridtally.session import ship_package

WINDOW, END_ID = 4096, 2
#: Tokens of one length bin; a window is this many bins long at most.
GRAIN = 16
#: Distinct words, and distinct letter runs of words, whose ids one Python worker remembers.
WORD_CACHE, CORE_CACHE = 400_000, 600_000
#: A run of letters, ASCII or precomposed Latin-1, and the punctuation after it: two separate units to the tokenizer.
_CORE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
_known: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}
_tokenizers: dict = {}
_finals: dict[str, np.ndarray] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its words one after
    the other; a plain word is a run of letters in lower case and the punctuation behind it. Ids met before are
    remembered by the worker.
    """

    def __init__(self, path: str):
        if path not in _tokenizers:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            _tokenizers[path] = Tokenizer.from_file(path)
        self.tokenizer = _tokenizers[path]
        self.known, self.cores = _known.setdefault(path, ({}, {}))
        if path not in _finals:
            vocabulary = self.tokenizer.get_vocab()
            _finals[path] = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            _finals[path][[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.final = _finals[path]

    def _learn(self, words: set[bytes]) -> None:
        """Ids of new words, most of them put together from those of their parts."""
        plain, parts, other = [], set(), []
        for w in words:
            m = _CORE.fullmatch(w)
            if m:
                core, mark = m[1].lower(), m[2]
                plain.append((w, core, mark))
                parts.add(core)
                if mark:
                    parts.add(mark)
            else:
                other.append(w)
        if len(self.cores) > CORE_CACHE:
            self.cores.clear()
        new = [p for p in parts if p not in self.cores]
        for at in range(0, len(new), 2_000):
            self._learn_parts(new[at : at + 2_000])
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in other], add_special_tokens=False)):
            self.known[w] = array("I", e.ids).tobytes()
        cores = self.cores
        for w, core, mark in plain:
            self.known[w] = cores[core] + cores[mark] if mark else cores[core]

    def _learn_parts(self, parts: list[bytes]) -> None:
        """Ids of parts that are one unit each, told apart by the tokens that end a unit."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(parts).decode("utf-8")], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.final[ids]) + 1) * 4
        if len(ends) != len(parts):
            raise ValueError("the tokenizer does not mark the end of each word")
        raw, at = ids.tobytes(), 0
        for p, to in zip(parts, ends.tolist()):
            self.cores[p] = raw[at:to]
            at = to

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        end = np.array([END_ID], dtype="<u4").tobytes()
        split = [(t or "").encode("utf-8").split() for t in texts]
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(new)
        known = self.known
        for words in split:
            yield b"".join(map(known.__getitem__, words)) + end
        for w in new:
            if len(w) > 64:
                del known[w]


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of at most a window in document order: full windows (bin 0) and what remains (bin = its length, rounded up).

    (part, row) names a document, ``k`` counts the pieces of a bin within its part.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, row = Encoder(path), TaskContext.get().partitionId(), 0
        seen = np.zeros(WINDOW // GRAIN + 1, dtype=np.int64)
        for pdf in frames:
            for at in range(0, len(pdf), 128):
                some = pdf.iloc[at : at + 128]
                out = []
                for doc_id, ids in zip(some["doc_id"], encode(list(some["text"]))):
                    n = len(ids) // 4
                    for start in range(0, n, WINDOW):
                        piece = ids[4 * start : 4 * (start + WINDOW)]
                        length = len(piece) // 4
                        b = 0 if length == WINDOW else -(-length // GRAIN)
                        out.append((doc_id, part, row, start, length, n, b, int(seen[b]), zlib.crc32(piece), piece))
                        seen[b] += 1
                    row += 1
                f = pd.DataFrame(out, columns=["doc_id", "part", "row", "start", "length", "doc_tokens", "bin", "k", "ids_crc32", "ids"])
                f["doc_id"] = f["doc_id"].astype("Int64")
                yield f

    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, "doc_id long, part int, row long, start long, length long, doc_tokens long, bin int, k long, ids_crc32 long, ids binary")


def combinations(units: int) -> np.ndarray:
    """Columns of bin counts that fill ``units`` bins: up to three lengths, or one length repeated and a filler."""
    seen = set()
    for a in range(1, units + 1):
        for n in range(1, units // a + 1):
            rest = units - n * a
            seen.add(tuple(sorted([a] * n + ([rest] if rest else []))))
        for b in range(a, units):
            c = units - a - b
            if c >= b:
                seen.add((a, b, c))
    table = np.zeros((units + 1, len(seen)), dtype=np.float32)
    for i, s in enumerate(sorted(seen)):
        for u in s:
            table[u, i] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x that minimises ||a x - b||, by the active set method (Lawson and Hanson, 1974)."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    gap = b.copy()
    for _ in range(3 * a.shape[0]):
        w = a.T @ gap
        w[on] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        on[j] = True
        while True:
            at = np.flatnonzero(on)
            some = a[:, at]
            s = np.linalg.solve(some.T @ some + 1e-9 * np.eye(len(at)), some.T @ b)
            if len(s) and s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)) if low.any() else 0.0
            x[at] += step * (s - x[at])
            on[at[x[at] <= 1e-12]] = False
            x[~on] = 0
            if not on.any():
                break
        gap = b - a @ x
    return x


def plan(histogram: dict[int, int], units: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Per bin the ranges (first rank, end rank, copies per sequence, first sequence), and the number of sequences."""
    have = np.zeros(units + 1)
    for u, n in histogram.items():
        have[u] = n
    if not have.any():
        return {}, 0
    table = combinations(units)
    keep = (table[have == 0].sum(axis=0) == 0) if (have == 0).any() else np.ones(table.shape[1], bool)
    table = table[:, keep].astype("float64")
    if not table.shape[1]:
        return {}, 0
    want = nnls(table, have)
    left, ranges, base = have.astype(np.int64), {}, 0
    used = np.zeros(units + 1, dtype=np.int64)
    for s in np.argsort(-want, kind="stable"):
        need = table[:, s].astype(np.int64)
        bins = np.flatnonzero(need)
        n = int(min(np.floor(want[s] + 1e-9), (left[bins] // need[bins]).min()))
        if n <= 0:
            continue
        for u in bins:
            ranges.setdefault(int(u), []).append((int(used[u]), int(used[u] + n * need[u]), int(need[u]), base))
            used[u] += n * need[u]
            left[u] -= n * need[u]
        base += n
    return ranges, base


def tail_sizes(tokens: int) -> list[int]:
    """Powers of two that sum to the last, unfilled window of the stream, largest first."""
    rest = tokens % WINDOW
    return [1 << i for i in reversed(range(WINDOW.bit_length())) if rest >> i & 1]


def pack(docs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, tokens): where each piece of each document lies, and the stored pieces with their ids.

    Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every id lies in exactly one piece, pieces follow one
    another in a sequence without gaps. Null and empty texts are one end id; null and repeated ids are packed like others.
    """
    tokens = stored(tokenised(docs.select("doc_id", "text"), path or tokenizer_path()), "tokens")
    light = tokens.select("doc_id", "part", "row", "start", "length", "doc_tokens", "bin", "k", "ids_crc32")
    counts = stored(light.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = W.partitionBy("bin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(0, None)
    ranges, filled = plan(histogram, WINDOW // GRAIN)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seq = np.full(len(pdf), -1, dtype=np.int64)
            bins, rank = pdf["bin"].to_numpy(), pdf["rank"].to_numpy()
            for b in np.unique(bins):
                known = ranges.get(int(b))
                if not known:
                    continue
                first, end, copies, base = (np.array(c) for c in zip(*known))
                at = np.flatnonzero(bins == b)
                i = np.searchsorted(end, rank[at], side="right")
                ok = i < len(end)
                at, i = at[ok], i[ok]
                seq[at] = base[i] + (rank[at] - first[i]) // copies[i]
            yield pdf.assign(sequence_id=seq)

    ranked = light.join(offsets, ["part", "bin"]).withColumn("rank", F.col("first") + F.col("k")).drop("first", "k")
    schema = ranked.withColumn("sequence_id", F.lit(0).cast("long")).schema
    placed = stored(ranked.mapInPandas(place, schema), "placed")
    order = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "bin", "rank").rowsBetween(W.unboundedPreceding, -1)
    combined = placed.where("bin > 0 and sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))

    rest = placed.where("bin > 0 and sequence_id < 0").select("part", "row", "start", "length")
    sums = stored(rest.groupBy("part").agg(F.sum("length").alias("n")), "sums")
    earlier = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("head"))
    total = int(sums.agg(F.sum("n")).first()[0] or 0)
    inside = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    stream = rest.join(earlier, "part").select("part", "row", "start", (F.col("head") + F.coalesce(F.sum("length").over(inside), F.lit(0))).alias("at"))
    stream = stored(stream, "stream")
    bounds = np.cumsum([total - total % WINDOW, *tail_sizes(total)])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc_id, start, n, ids, at in zip(pdf["doc_id"], pdf["start"], pdf["doc_tokens"], pdf["ids"], pdf["at"]):
                size, done = len(ids) // 4, 0
                while done < size:
                    p = at + done
                    if p < bounds[0]:
                        seq, begin, end = p // WINDOW, p // WINDOW * WINDOW, (p // WINDOW + 1) * WINDOW
                    else:
                        i = int(np.searchsorted(bounds, p, side="right"))
                        seq, begin, end = int(bounds[0]) // WINDOW + i - 1, int(bounds[i - 1]), int(bounds[i])
                    take = min(size - done, end - p)
                    piece = ids[4 * done : 4 * (done + take)]
                    out.append((doc_id, start + done, take, zlib.crc32(piece), n, filled + seq, p - begin))
                    done += take
            f = pd.DataFrame(out, columns=_COLUMNS)
            f["doc_id"] = f["doc_id"].astype("Int64")
            yield f

    left = tokens.select("doc_id", "part", "row", "start", "doc_tokens", "ids").join(stream, ["part", "row", "start"])
    poured = left.select("doc_id", "start", "doc_tokens", "ids", "at").mapInPandas(cut, ", ".join(f"{c} long" for c in _COLUMNS))
    after = filled + total // WINDOW + len(tail_sizes(total))
    windows = placed.where("bin = 0").withColumn("sequence_id", F.lit(after) + F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    same = [F.col(c).cast("long").alias(c) for c in _COLUMNS]
    return windows.select(*same).unionByName(combined.select(*same)).unionByName(poured), tokens


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of ``pack``."""
    return pack(docs, path)[0]
