"""Connected components: of a graph, and of foreground pixels or runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.session import cut_lineage, merged

TILE = 256
BIN_RUNS = 60_000


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of the component of each of ``n`` items joined by pairs (a, b)."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        nxt = lab.copy()
        for ends in (a, b):
            np.minimum.at(nxt, lab[ends], low)
            np.minimum.at(nxt, ends, low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, lab):
            break
        lab = nxt
    return lab


def unsettled(e: DataFrame) -> bool:
    """Whether some component of the edges u > v is not yet a star around its smallest node, which a round would leave as it is."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    found = e.select(F.inline(F.array(end("u", 1), end("v", 0)))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(found.agg(F.max(F.expr("up + down > 1 and up > 0"))).first()[0])


def graph_components(edges: DataFrame) -> DataFrame:
    """Component of every node of an edge table (a, b), as (node, root) with the smallest node as root.

    Alternates large-star and small-star rounds (Kiveris et al., 2014). Neighbourhoods are only ever
    reduced by ``min``, so a node of any degree stays an ordinary aggregate. Each round is checkpointed, and rounds go
    on until all components are stars; their number grows with the logarithm of the diameter. Both joins merge what is shuffled
    anyway: gathered on the driver, the minima of every round would cost it a job and a table each.
    """
    edge = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    while unsettled(e):
        both = e.select(F.inline(F.array(edge("u", "v"), edge("v", "u"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(merged(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(low), "u")
        e = cut_lineage(small.select(F.inline(F.array(edge("v", "m"), edge("u", "m")))).where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


# ---- pixels and runs ---------------------------------------------------------------------------


WORD = 64


def word_at(x: Column) -> Column:
    """The word of an image row that holds column ``x``."""
    return F.floor(x / F.lit(WORD))


def has_bit(word: Column, x: Column) -> Column:
    """Whether the word of column ``x`` has its pixel."""
    return F.getbit(word, F.pmod(x, F.lit(WORD)).cast("int")) == 1


def pixel_words(pixels: DataFrame, keys: list[str], **layers: Column) -> DataFrame:
    """Sets of pixels as (keys, y, _w) rows with one word of 64 bits per layer, 0 where the layer has none.

    A layer is a condition on the pixels. The words are made before the shuffle, so full rows cost a 64th of their pixels.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("x"), F.lit(WORD)).cast("int"))
    return pixels.groupBy(*keys, "y", word_at(F.col("x")).alias("_w")).agg(*[F.bit_or(F.when(c, bit).otherwise(F.lit(0).cast("bigint"))).alias(n) for n, c in layers.items()])


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that touch or overlap in an image row become one; the window is one row, which the frame width bounds."""
    w = W.partitionBy(*keys, "y").orderBy("x0")
    far = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.select(*keys, "y", "x0", "x1", F.when(F.col("x0") <= far + 1, 0).otherwise(1).alias("_s"))
    grouped = marked.withColumn("_g", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def runs_from_pixels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal horizontal runs (x0, x1 inclusive) of distinct foreground pixels.

    Runs are read off words of 64 pixels and joined where they touch, so no pixel is shuffled.
    """
    kind = pixels.schema["x"].dataType
    b = F.col("_b")
    ends = lambda m: F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(m, i) == 1)
    first = ends(b.bitwiseAND(F.bitwise_not(F.shiftleft(b, 1))))
    last = ends(b.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(b, 1))))
    words = pixel_words(pixels.where("x is not null"), keys, _b=F.lit(True))
    parts = words.select(*keys, "y", "_w", F.explode(F.arrays_zip(first.alias("f"), last.alias("l"))).alias("r"))
    at = lambda c: (F.col("_w") * WORD + F.col(c)).cast(kind)
    return merge_runs(parts.select(*keys, "y", at("r.f").alias("x0"), at("r.l").alias("x1")), keys)


def _label_tiles(tile_keys: list[str], k: int):
    """Labels the runs of a batch of tiles by the position of the first run of their component in the tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_t=pdf.groupby(tile_keys, sort=False, dropna=False).ngroup()).sort_values(["_t", "y", "x0"], kind="stable")
        y, x0, x1, t = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1", "_t"))
        wide, tall = int(x1.max()) + 4, int(y.max()) + 3
        row = t * tall + y
        lo = np.searchsorted(row * wide + x1, (row + 1) * wide + np.maximum(x0 - k, 0), "left")
        hi = np.searchsorted(row * wide + x0, (row + 1) * wide + x1 + k, "right")
        n = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(y)), n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        lab = smallest_labels(len(y), a, b)
        return pdf.assign(node=y[lab] * np.int64(1 << 31) + x0[lab]).drop(columns=["_t", "_bin"])

    return run


def label_runs(runs: DataFrame, keys: list[str], connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """Runs cut at tile borders, each with the label ``comp`` of its component.

    A tile holds at most ``tile * tile / 2`` runs, so labelling inside tiles is bounded work however large
    an image or a group of images is. Tiles are packed into bins of about ``BIN_RUNS`` runs, as many bins as
    the data needs. Only pixels on tile borders enter the graph that joins the tiles.
    """
    if connectivity not in (4, 8):
        raise ValueError(f"connectivity must be 4 or 8, got {connectivity}")
    t = F.lit(tile)
    tiles = F.sequence(F.floor(F.col("x0") / t), F.floor(F.col("x1") / t))
    pieces = runs.select(
        *keys, F.col("y").cast("bigint").alias("y"), "x0", "x1", F.floor(F.col("y") / t).alias("ty"), F.explode(tiles).alias("tx")
    ).select(
        *keys, "ty", "tx", "y",
        F.greatest(F.col("x0").cast("bigint"), F.col("tx") * t).alias("x0"),
        F.least(F.col("x1").cast("bigint"), F.col("tx") * t + t - 1).alias("x1"),
    )
    group = [*keys, "ty", "tx"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", node bigint"
    pieces = cut_lineage(pieces)
    bins = max(1, -(-pieces.count() // BIN_RUNS))
    labelled = (
        pieces.withColumn("_bin", F.pmod(F.xxhash64(*group), F.lit(bins)))
        .groupBy("_bin")
        .applyInPandas(_label_tiles(group, 1 if connectivity == 8 else 0), schema)
    )
    labelled = cut_lineage(labelled)

    on_edge = (F.col("y") % t).isin(0, tile - 1) | (F.col("x0") % t == 0) | (F.col("x1") % t == tile - 1)
    sides = F.array_distinct(F.array_compact(F.array(F.when(F.col("x0") % t == 0, F.col("x0")), F.when(F.col("x1") % t == tile - 1, F.col("x1")))))
    border = F.when((F.col("y") % t).isin(0, tile - 1), F.sequence("x0", "x1")).otherwise(sides)
    cells = labelled.where(on_edge).select(*group, "node", "y", F.explode(border).alias("x"))
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if connectivity == 8 else [(0, 1), (1, 0)]
    look = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    seek = (
        cells.withColumn("s", look)
        .select(*keys, "ty", "tx", F.col("node").alias("n1"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
        .where((F.floor(F.col("y") / t) != F.col("ty")) | (F.floor(F.col("x") / t) != F.col("tx")))
        .drop("ty", "tx")
    )
    pairs = seek.join(cells.select(*keys, "y", "x", F.col("node").alias("n2")), [*keys, "y", "x"]).select(*keys, "n1", "n2").distinct()
    pairs = cut_lineage(pairs)
    if pairs.isEmpty():
        return labelled.select(*keys, "y", "x0", "x1", F.col("node").alias("comp"))
    edges = pairs.select(F.struct(*keys, F.col("n1").alias("n")).alias("a"), F.struct(*keys, F.col("n2").alias("n")).alias("b"))
    roots = graph_components(edges).select(*[F.col("node")[k].alias(k) for k in keys], F.col("node")["n"].alias("node"), F.col("root")["n"].alias("_root"))
    return labelled.join(roots, [*keys, "node"], "left").select(*keys, "y", "x0", "x1", F.coalesce("_root", "node").alias("comp"))


def object_attributes(labelled: DataFrame, keys: list[str], comp: str = "comp", min_area: int = 3) -> DataFrame:
    """Area, centroid and end-exclusive box per component, from closed forms over runs."""
    n = F.col("x1") - F.col("x0") + 1
    got = labelled.groupBy(*keys, comp).agg(
        F.sum(n).cast("bigint").alias("area"),
        F.sum(F.col("y") * n).alias("_sy"),
        F.sum((F.col("x0") + F.col("x1")) * n / F.lit(2.0)).alias("_sx"),
        F.min("y").cast("int").alias("y1"), F.min("x0").cast("int").alias("x1"),
        (F.max("y") + 1).cast("int").alias("y2"), (F.max("x1") + 1).cast("int").alias("x2"),
    )
    got = got.select(
        *keys, F.col(comp).alias("obj_id"), (F.col("_sy") / F.col("area")).alias("cy"), (F.col("_sx") / F.col("area")).alias("cx"),
        "y1", "x1", "y2", "x2", "area",
    )
    return area_filter(got, min_area)


def component_points(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """The (x, y) centroids of all components, without an area limit."""
    return object_attributes(labelled, keys, min_area=0).select(*keys, F.col("cx").alias("x"), F.col("cy").alias("y"))


def connected_components(pixels: DataFrame, keys: list[str], connectivity: int = 8, min_area: int = 3, tile: int = TILE) -> DataFrame:
    """Objects of a pixel table."""
    runs = runs_from_pixels(pixels, keys)
    return object_attributes(label_runs(runs, keys, connectivity, tile), keys, min_area=min_area)


def area_filter(objects: DataFrame, min_area: int = 3, max_area: int | None = None) -> DataFrame:
    """Keep areas from ``min_area`` to ``max_area``, both included; no lower limit at 0 or below."""
    out = objects if min_area <= 0 else objects.where(F.col("area") >= min_area)
    return out if max_area is None else out.where(F.col("area") <= max_area)
