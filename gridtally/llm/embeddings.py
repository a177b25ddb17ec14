"""Near-duplicate vectors by iterative quantisation (Gong et al., 2013) and multi-index Hamming tables.

Rotations learnt on a bounded sample turn each vector into a balanced binary code. The code is cut into substrings,
one table each, and vectors with an equal substring in some table are compared by their cosine in double precision.
Substrings lengthen with the logarithm of the largest label, so that chance company stays rare, and there are as many
tables as pairs at the limit need to meet. Equal vectors form one class first. Crowded buckets are cut into blocks of
bounded size, and a batch of blocks returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import stored
from gridtally.operators.components import graph_components, smallest_labels
from gridtally.session import cut_lineage, merged, ship_package

#: Classes the rotations are learnt from, picked by hash.
SAMPLE = 4_096
#: Bits of one rotation and rounds of its learning; below LOW dimensions further rotations stay random, as learning would repeat the first.
BITS, ROUNDS, LOW = 64, 40, 16
#: Share of the pairs at the limit that may meet in no table.
MISS = 0.001
#: Cost of a vector sent to a bucket with company, and of a pair compared, in rows of a table.
SENT, PAIR = 16, 0.04
#: Vectors of each side of a block, which STRIPE of them at a time are compared; blocks up to FEW rows are compared together.
BLOCK, STRIPE, FEW = 2_048, 512, 48


def unit_rows(vectors: list) -> np.ndarray:
    """Rows in double precision scaled to length 1; safe for very large and very small components."""
    x = np.array([np.asarray(v, dtype="float64") for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(x: np.ndarray, seed: int = 3, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) of iterative quantisation; bits is at most the dimension."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(BITS, x.shape[1])]
    v = centred @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1], axes.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
        r = left @ right
    return mean, axes @ r


def codes(x: np.ndarray, mean: np.ndarray, project: np.ndarray) -> np.ndarray:
    """The binary code of each row, unused bits zero."""
    on = (x - mean) @ project >= 0
    return (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def agreement(x: np.ndarray, mean: np.ndarray, project: np.ndarray, cosine: float) -> float:
    """Share of equal bits between rows and partners planted at the limit in random directions."""
    away = np.random.default_rng(5).standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), 1e-300)
    partner = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * away
    return float((((x - mean) @ project >= 0) == ((partner - mean) @ project >= 0)).mean())


def layout(n: int, agree: float) -> tuple[int, int]:
    """Substring width and number of tables for ``n`` vectors of a label, of the least cost that misses at most MISS."""
    agree = min(max(agree, 0.5), 1 - 1e-9)

    def tables(width: int) -> int:
        return 1 if width == 0 else math.ceil(math.log(MISS) / math.log1p(-(agree**width)))

    def cost(width: int) -> float:
        company = n / 2**width
        return tables(width) * (1 + SENT * min(1.0, company) + PAIR * company)

    width = min(range(63), key=cost)
    return width, tables(width)


def model(x: np.ndarray, n: int, cosine: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Width, tables, mean and the projections of all tables side by side."""
    mean, first = rotation(x)
    width, tables = layout(n, agreement(x, mean, first, cosine))
    turns = [first]
    while len(turns) * first.shape[1] < width * tables:
        turns.append(rotation(x, 3 + len(turns), ROUNDS if x.shape[1] >= LOW else 0)[1])
    return width, tables, mean, np.hstack(turns)[:, : width * tables]


def unlearnt(d: int, n: int, cosine: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The model of a dimension that the sample did not meet: random rotations about the origin."""
    width, tables = layout(n, 1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi)
    rng = np.random.default_rng(3)
    turns = [np.linalg.qr(rng.standard_normal((d, d)))[0][:, :BITS] for _ in range(max(1, -(-width * tables // min(d, BITS))))]
    return width, tables, np.zeros(d), np.hstack(turns)[:, : width * tables]


def substrings(x: np.ndarray, width: int, tables: int, mean: np.ndarray, project: np.ndarray) -> np.ndarray:
    """The substring of each row (rows x tables)."""
    return np.stack([codes(x, mean, project[:, t * width : (t + 1) * width]) for t in range(tables)], axis=1).view(np.int64)


def learn(classes: DataFrame, n: int, cosine: float, sample: int = SAMPLE) -> dict[int, tuple[int, int, np.ndarray, np.ndarray]]:
    """Per dimension met in the sample, its model."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        width, tables, mean, project = model(unit_rows(list(pdf.sort_values("node")["vector"])), n, cosine)
        return pd.DataFrame({"d": [int(pdf["d"].iloc[0])], "width": [width], "tables": [tables], "mean": [mean.tobytes()], "project": [project.tobytes()]})

    picks = classes.select("node", "d", "vector").orderBy(F.xxhash64("node"), "node").limit(sample)
    rows = picks.groupBy("d").applyInPandas(fit, "d int, width int, tables int, mean binary, project binary").collect()
    return {r["d"]: (r["width"], r["tables"], np.frombuffer(r["mean"]), np.frombuffer(r["project"]).reshape(r["d"], -1)) for r in rows}


def _few_pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of rows within blocks of these sizes, which lie one after another."""
    after = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1
    i = np.repeat(np.arange(len(after)), after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def _unmet(subs: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that meet in table t of their block and in none before."""
    for k in range(int(t.max(initial=0))):
        stay = (t[i] <= k) | (subs[i, k] != subs[j, k])
        i, j = i[stay], j[stay]
    return i, j


def _links(pdf: pd.DataFrame, block: list[str], cosine: float) -> pd.DataFrame:
    """Link counts (a, mark, n) and forest edges (a, b) of whole blocks of one dimension, which lie one after another.

    ``side`` 0 and 1 are the two sides of a block. Rows of side 0 meet each other if ``own``; a pair is counted in the first
    table that it shares.
    """
    pdf = pdf.reset_index(drop=True)
    x, subs, t = unit_rows(list(pdf["vector"])), np.stack(list(pdf["subs"])), pdf["t"].to_numpy()
    node, mark, copies, side, own = (pdf[c].to_numpy() for c in ("node", "mark", "copies", "side", "own"))
    start = np.flatnonzero((pdf[block] != pdf[block].shift()).any(axis=1).to_numpy())
    size = np.diff(np.append(start, len(pdf)))
    few = size <= FEW
    at = np.flatnonzero(np.repeat(few, size))
    i, j = _few_pairs(size[few])
    i, j = at[i], at[j]
    meet = own[i] | (side[i] != side[j])
    i, j = _unmet(subs, t, i[meet], j[meet])
    step = max(1, (1 << 20) // x.shape[1])
    near = [np.einsum("ij,ij->i", x[i[k : k + step]], x[j[k : k + step]]) >= cosine for k in range(0, len(i), step)]
    near = np.concatenate([*near, np.zeros(0, bool)])
    n, forest = np.zeros(len(pdf)), []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        np.add(n, np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf)), out=n)
        root = smallest_labels(len(pdf), i, j)
        edge = np.flatnonzero(root != np.arange(len(pdf)))
        forest.append((root[edge], edge))

    take(i[near], j[near])
    for lo, rows in zip(start[~few], size[~few]):
        left, right = (lo + np.flatnonzero(side[lo : lo + rows] == s) for s in (0, 1))
        for k in range(0, len(left), STRIPE):
            part = left[k : k + STRIPE]
            if own[lo]:
                i, j = np.nonzero(np.triu(x[part] @ x[left].T >= cosine, k + 1))
                take(*_unmet(subs, t, part[i], left[j]))
            if len(right):
                i, j = np.nonzero(x[part] @ x[right].T >= cosine)
                take(*_unmet(subs, t, part[i], right[j]))
    root = smallest_labels(len(pdf), *(np.concatenate(p) for p in zip(*forest)))
    at = np.flatnonzero(n > 0)
    edge = np.flatnonzero(root != np.arange(len(pdf)))
    return pd.DataFrame({
        "a": np.concatenate([node[at], node[edge]]), "mark": np.concatenate([mark[at], np.zeros(len(edge), "int64")]),
        "b": np.concatenate([np.full(len(at), -1), node[root[edge]]]), "n": np.concatenate([n[at].astype("int64"), np.zeros(len(edge), "int64")]),
    })


def whole_blocks(frames: Iterator[pd.DataFrame], block: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut at block ends; only the open block is carried over."""
    rest: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        last = int(np.flatnonzero((pdf[block] != pdf[block].shift()).any(axis=1).to_numpy())[-1])
        goes_on = bool(rest) and (rest[-1][block].iloc[-1] == pdf[block].iloc[0]).all()
        if goes_on and last == 0:
            rest.append(pdf)
            continue
        done = [*rest, pdf.iloc[:last]] if last else rest
        rest = [pdf.iloc[last:]]
        if done:
            yield pd.concat(done, ignore_index=True)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component and not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class hashes, and one row per class of equal vectors of a label."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    good = F.coalesce(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(good, F.col("v")).alias("vector"), F.when(good, F.xxhash64("label", "v")).alias("h1"), F.when(good, F.xxhash64(F.lit(7), "v", "label")).alias("mark"))
    classes = rows.where("h1 is not null").groupBy("label", "h1", "mark").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    return rows.drop("vector"), classes.withColumn("d", F.size("vector"))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, known label are linked when found with a cosine of at least ``cosine``; vectors of different
    length never are. Null, zero and non-finite vectors, and rows without id or label, link with nothing and are kept.
    Repeated rows count as vectors of their own; rows that share an id share a component.
    """
    ship_package(vectors.sparkSession)
    rows, classes = _classes(vectors.select("vec_id", "label", "embedding"))
    classes = stored(classes, "vectors")
    largest = classes.groupBy("label", "d").count().agg(F.max("count")).first()[0] or 1
    shared = vectors.sparkSession.sparkContext.broadcast(learn(classes, largest, cosine, sample))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for pdf in frames:
            parts = []
            for d, part in pdf.groupby("d"):
                if d not in models:
                    models[d] = unlearnt(d, largest, cosine)
                parts.append(part.assign(subs=list(substrings(unit_rows(list(part["vector"])), *models[d]))))
            if parts:
                yield pd.concat(parts)

    plain = classes.select("label", "d", "node", "mark", "copies", "vector")
    coded = stored(plain.mapInPandas(encode, plain.withColumn("subs", F.array(F.lit(0).cast("long"))).schema), "codes")
    key = ["label", "d", "t", "sub"]
    held = coded.select("label", "d", "node", "mark", F.posexplode("subs").alias("t", "sub"))
    size = held.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = held.join(merged(size), key).select(*key, "node", "mark", F.ceil(F.col("size") / BLOCK).cast("int").alias("chunks"))
    full = placed.join(merged(coded), ["label", "d", "node", "mark"])
    # a chunk meets itself and every other one, after the join: rows of one bucket are spread by then
    c = F.pmod(F.xxhash64("node", "mark"), F.col("chunks")).cast("int")
    spot = lambda j: F.struct(F.least(c, j).alias("i"), F.greatest(c, j).alias("j"), F.when(c > j, 1).otherwise(0).alias("side"), (c == j).alias("own"))
    spots = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), spot))
    block = [*key, "i", "j"]
    full = full.select(*key, "node", "mark", "copies", "vector", "subs", spots.alias("s")).select("*", "s.i", "s.j", "s.side", "s.own").drop("s")
    dealt = full.repartition(*block).sortWithinPartitions(*block)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_blocks(frames, block):
            for _, part in pdf.groupby("d"):
                yield _links(part, block, cosine)

    found = stored(dealt.mapInPandas(run, "a long, mark long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node"), "mark").agg(F.sum("n").alias("n"))
    roots = graph_components(found.where("n = 0").select("a", "b"))
    known = classes.select("label", "h1", "mark", "node", "copies").join(counts, ["node", "mark"], "left").join(roots, "node", "left")
    known = cut_lineage(known.select("label", "h1", "mark", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    out = rows.join(known, ["label", "h1", "mark"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
