"""Near-duplicate documents by b-bit MinHash (Li and König, 2010).

Banded minima propose pairs, the packed low bits of all minima estimate each pair's similarity, corrected for chance
collisions, and the pairs that may qualify are confirmed on their full shingle sets. Equal sets form one class
first, so copies never meet each other. Within a bucket every class meets the bucket's leader; only buckets
that still hold several components afterwards compare the classes of different components with each other, in blocks of
bounded size that return a spanning forest of the links they find, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import grouped, mix, stored, unused
from gridtally.llm.shingles import shingle_sets
from gridtally.operators.components import graph_components, smallest_labels
from gridtally.session import cut_lineage, merged, ship_package

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40, about 1e-7.
BANDS, ROWS = 40, 5
LOW_BITS = 4
#: Minima whose low bits are packed; 16 fit one 64-bit word.
PACKED = 192
#: Standard errors by which an estimate may fall short before the pair is given up.
SLACK = 6.0
#: Classes of each side of a block, and pairs of a block from which their sets are compared as a matrix.
BLOCK, DENSE = 512, 4_000
_RNG = np.random.default_rng(20240917)
_FACTORS = _RNG.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def minima(codes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the smallest value of each hash function over a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(codes), 2048):
        part = codes[None, at : at + 2048] * _FACTORS[:, None]
        part += _OFFSETS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low >> np.uint64(32)


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of the first minima, 16 to a word."""
    bits = (low[:PACKED] & np.uint64((1 << LOW_BITS) - 1)).reshape(-1, 64 // LOW_BITS)
    return np.bitwise_or.reduce(bits << (np.arange(64 // LOW_BITS, dtype=np.uint64) * np.uint64(LOW_BITS)), axis=1)


def band_keys(low: np.ndarray) -> np.ndarray:
    code = np.zeros(BANDS, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        code = mix(code + np.uint64(0x9E3779B97F4A7C15)) + low[i::ROWS]
    return mix(code)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per document: doc_id, size and two fingerprints of its shingle set, band keys and packed bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                out = []
                for s in shingle_sets(list(part["text"]), width):
                    if not len(s):
                        out.append((0, 0, 0, [], []))
                        continue
                    low = minima(s)
                    one, two = int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1))))
                    out.append((len(s), one, two, band_keys(low).view(np.int64), packed(low).view(np.int64)))
                f = pd.DataFrame(out, columns=["n", "f1", "f2", "bands", "bits"])
                for c in ("f1", "f2"):
                    f[c] = f[c].astype("uint64").to_numpy().view("int64")
                f.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield f

    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, "doc_id long, n long, f1 long, f2 long, bands array<long>, bits array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed bits: the share of equal low bits less what chance gives."""
    mask = int("1" * (64 // LOW_BITS), 16)
    words = PACKED * LOW_BITS // 64
    off = None
    for i in range(words):
        d = a[i].bitwiseXOR(b[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        n = F.bit_count(d.bitwiseAND(F.lit(mask)))
        off = n if off is None else off + n
    chance = 1.0 / (1 << LOW_BITS)
    return (1.0 - off / F.lit(float(PACKED)) - chance) / (1.0 - chance)


def lowest_estimate(percent: int) -> float:
    """Estimates below this are given up."""
    t = percent / 100
    return t - SLACK * (t * (1 - t) / PACKED) ** 0.5 * 1.1


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of node ids that may reach ``percent`` by their sizes and packed bits."""
    floor = lowest_estimate(percent)
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate(F.col("ba"), F.col("bb")) >= floor))
        .select("a", "b").distinct()
    )


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, codes): the shingle sets of the documents named in ``ids``, which may be many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                sets = [s.view(np.int64) for s in shingle_sets(list(part["text"]), width)]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "codes": sets})

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(ids, "node", "left_semi")
    return texts.mapInPandas(run, "node long, codes array<long>")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent``, as edges."""
    full_a = sets.select(F.col("node").alias("a"), F.col("codes").alias("ca"))
    full_b = sets.select(F.col("node").alias("b"), F.col("codes").alias("cb"))
    shared = F.size(F.array_intersect("ca", "cb"))
    return pairs.join(full_a, "a").join(full_b, "b").where(100 * shared >= percent * (F.size("ca") + F.size("cb") - shared)).select("a", "b").distinct()


def block_pairs(x: pd.DataFrame, y: pd.DataFrame, key: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of a block that may be links, each in the first band that its classes share.

    Side x holds classes outside the bucket's main component, side y all classes; pairs within a component are left out.
    """
    a, b = (np.stack(list(f["bits"])).view(np.uint64) for f in (x, y))
    cx, cy = x["comp"].to_numpy()[:, None], y["comp"].to_numpy()[None, :]
    nx, ny = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
    fit = (cx != cy) & ((cy == y["main"].to_numpy()[None, :]) | (x["node"].to_numpy()[:, None] < y["node"].to_numpy()[None, :]))
    fit &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    if not fit.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    off = np.zeros(fit.shape, dtype=np.int32)
    mask = np.uint64(int("1" * (64 // LOW_BITS), 16))
    for w in range(a.shape[1]):
        d = a[:, w, None] ^ b[None, :, w]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        off += np.bitwise_count(d & mask)
    chance = 1.0 / (1 << LOW_BITS)
    i, j = np.nonzero(fit & ((1.0 - off / PACKED - chance) / (1.0 - chance) >= lowest_estimate(percent)))
    bx, by = (np.stack(list(f["bands"])) for f in (x, y))
    first = np.ones(len(i), dtype=bool)
    for band in range(int(np.flatnonzero(bx[0] == key)[0])):
        first &= bx[i, band] != by[j, band]
    return i[first], j[first]


def shared_sizes(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets x[i] and y[j]; many pairs at once as products of incidence matrices."""
    if len(i) < DENSE:
        return np.array([len(np.intersect1d(x[p], y[q], assume_unique=True)) for p, q in zip(i, j)], dtype=np.int64)
    parts = [*x, *y]
    owner = np.repeat(np.arange(len(parts)), [len(s) for s in parts])
    _, column = np.unique(np.concatenate(parts), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(x), len(y)), dtype=np.float32)
    width = 4_096
    for at in range(0, int(column[-1]) + 1, width):
        s = slice(*np.searchsorted(column, [at, at + width]))
        m = np.zeros((len(parts), width), dtype=np.float32)
        m[owner[s], column[s] - at] = 1
        total += m[: len(x)] @ m[len(x) :].T
    return total[i, j].astype(np.int64)


def across_components(comp: DataFrame, nodes: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what the links between different components of a bucket connect.

    ``comp`` has the classes of the shared buckets with their component so far.
    """
    main = comp.groupBy("key").agg(F.min_by("comp", "node").alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "main")
    open_ = stored(comp.join(main, "key"), "open")
    size = open_.groupBy("key").agg(F.ceil(F.count(F.when(F.col("comp") != F.col("main"), 1)) / BLOCK).cast("int").alias("cx"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cy"))
    sized = open_.join(size, "key").withColumn("h", F.xxhash64("node"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    x = sized.where("comp <> main").select("key", "node", "comp", "main", F.lit(0).alias("side"), F.pmod("h", "cx").cast("int").alias("i"), F.explode(upto(F.col("cy"))).alias("j"))
    y = sized.select("key", "node", "comp", "main", F.lit(1).alias("side"), F.explode(upto(F.col("cx"))).alias("i"), F.pmod("h", "cy").cast("int").alias("j"))
    block = ["key", "i", "j"]
    rows = x.select(*block, "side", "node", "comp", "main").unionByName(y.select(*block, "side", "node", "comp", "main"))
    light = rows.join(nodes.select("node", "n", "bits", "bands"), "node").repartition(*block).sortWithinPartitions(*block)

    columns = light.columns

    def sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.drop_duplicates(["side", "node", "n"])
        p, q = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(p) or not len(q):
            return p, q, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return p, q, *block_pairs(p, q, int(pdf["key"].iloc[0]), percent)

    def active(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, i, j = sides(pdf)
        return pd.concat([p.iloc[np.unique(i)], q.iloc[np.unique(j)]])[columns]

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, i, j = sides(pdf)
        cp, cq = list(p["codes"]), list(q["codes"])
        shared = shared_sizes(cp, cq, i, j)
        union = np.array([len(s) for s in cp])[i] + np.array([len(s) for s in cq])[j] - shared if len(i) else shared
        ok = 100 * shared >= percent * union
        ids, place = np.unique(np.concatenate([p["node"].to_numpy(), q["node"].to_numpy()]), return_inverse=True)
        root = smallest_labels(len(ids), place[: len(p)][i[ok]], place[len(p) :][j[ok]])
        at = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[root[at]], "b": ids[at]})

    found = stored(light.mapInPandas(lambda frames: grouped(frames, block, active), light.schema), "active")
    lacking = stored(found.select("node").distinct().join(sets.select("node"), "node", "left_anti"), "lacking")
    known = sets.unionByName(stored(full_sets(docs, lacking, width), "sets"))
    full = found.join(known, "node").repartition(*block).sortWithinPartitions(*block)
    return full.mapInPandas(lambda frames: grouped(frames, block, links), "a long, b long")


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of the rows, (f1, f2, n, node) of the classes of equal sets, (node, root) of nodes with links."""
    sk = stored(sketches(docs, width), "sketches")
    classes = cut_lineage(sk.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node")))
    nodes = stored(sk.join(classes.withColumnRenamed("node", "doc_id"), ["f1", "f2", "n", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "bits", "bands"), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = stored(members.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "a"), "buckets")
    held = stored(members.join(shared, "key"), "members")

    # every class of a bucket meets the bucket's leader; its first likely partner is confirmed at once
    stars = likely(held.where("a <> node").select("a", F.col("node").alias("b")).distinct(), nodes, percent)
    first = stored(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "stars")
    sets = stored(full_sets(docs, ends(first).hint("merge"), width), "sets")
    edges = stored(confirmed(first, sets, percent), "edges")
    roots = stored(graph_components(edges), "roots")

    comp = held.join(merged(roots), "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    more = stored(across_components(comp, nodes, docs, sets, width, percent), "edges")
    return sk, classes, graph_components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their ``width``-word shingle sets is at least
    ``percent`` in a hundred; ``component_id`` is the smallest id reachable over links and ``kept`` marks it.
    Documents without words, and rows with a null id, link with nothing and are kept. Rows that share an id count as
    one document: a link of any of them is a link of all. Only doc_id and text are read.
    """
    sk, classes, roots = _linked(docs.select("doc_id", "text"), width, percent)
    named = classes.join(merged(roots), "node", "left").select("f1", "f2", "n", F.coalesce("root", "node").alias("root"))
    ids = sk.select("doc_id", "n", "f1", "f2")
    found = ids.join(merged(named), ["f1", "f2", "n"], "left")
    component = F.coalesce("root", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one of smallest id, all columns unchanged.

    Every row is judged by its own text: rows that share an id are documents of their own, and of equal ones the first stored
    stays. Rows with a null id and documents without words all stay.
    """
    row = unused(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    known = rows.select(F.col(row).alias("_at"), F.col("doc_id").cast("long").alias("doc_id"))
    named_rows = rows.select(F.col(row).alias("_at"), F.col("doc_id").alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = cut_lineage(known.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not shared.isEmpty():  # rows that share an id go by a number of their own, below all ids
        least = known.agg(F.min("doc_id")).first()[0]
        own = known.join(shared, "doc_id", "left_semi").select("_at", (F.lit(least - 1) - F.col("_at")).alias("_node"))
        named_rows = named_rows.join(own, "_at", "left").select("_at", "_id", F.coalesce("_node", "doc_id").alias("doc_id"), "text")
    near = near_duplicates(named_rows, width, percent)
    by_node = named_rows.where("doc_id is not null").select(F.col("doc_id").alias("_node"), F.col("_at").alias(row), F.col("_id").alias("doc_id"))
    named = near.where("doc_id is not null").select(F.col("doc_id").alias("_node"), "component_id").join(merged(by_node), "_node")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col("first")[row].alias(row))
    stay = first.unionByName(rows.where("doc_id is null").select(row))
    return rows.join(merged(stay), row, "left_semi").select(*docs.columns)
