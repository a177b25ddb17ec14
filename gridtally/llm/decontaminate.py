"""Benchmark decontamination by containment sketches, with DataFrame functions only.

A short item inside a long document has a tiny Jaccard similarity with it, so the document's own minima say
nothing about the item. Therefore only the items are sketched: an item of q distinct shingles keeps its
``q - need + 1`` smallest shingle hashes, where ``need`` is how many of its shingles a document must hold. Any
document that holds ``need`` of them misses at most ``q - need`` and so holds at least one sketched hash. The sketch
length depends on the item's size alone, and items are partitioned by size. Documents probe the sketches with all their
shingles, and every candidate is verified on the exact shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import LOWER, UPPER, unused
from gridtally.session import cut_lineage

WIDTH, PERCENT = 5, 80
#: Bytes of items broadcast at once; more items are matched block by block.
BLOCK_BYTES = 32_000_000
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; an empty array for null and blank texts."""
    trimmed = F.btrim(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingles(ws: Column, width: int) -> Column:
    """Hashes of the ``width``-word shingles in order; a shorter text is one shingle, no words give none."""
    whole = F.array(F.xxhash64(F.lit(-1).cast("long"), F.concat_ws(" ", ws)))
    runs = F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
    return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).when(F.size(ws) < width, whole).otherwise(runs)


def item_sketches(benchmark: DataFrame, width: int, percent: int) -> DataFrame:
    """Per distinct item: item_id, its set, its size q, need, its size class and its sketch."""
    sets = benchmark.select("item_id", F.array_distinct(shingles(words(F.col("text")), width)).alias("item"))
    sets = sets.withColumn("q", F.size("item")).where("q > 0").select("item_id", "q", F.array_sort("item").alias("item")).distinct()
    need = F.expr(f"cast((q * {percent} + 99) div 100 as int)")
    return sets.withColumn("need", need).withColumn("size_class", F.ceil(F.log2("q")).cast("int")).withColumn("sketch", F.slice("item", F.lit(1), F.col("q") - F.col("need") + 1))


def _matches(docs: DataFrame, benchmark: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, _mark, item_id, item_shingles, shared_shingles) rows; _mark is a hash of the document's text."""
    items = cut_lineage(item_sketches(benchmark, width, percent).withColumn("key", F.xxhash64("item_id", "item")))
    total = items.agg(F.sum(F.col("q") * 8 + F.size("sketch") * 40 + 64).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ws = texts.select("doc_id", F.xxhash64("text").alias("_mark"), words(F.col("text")).alias("ws"))
    sets = ws.select("doc_id", "_mark", shingles(F.col("ws"), width).alias("sh"))
    probes = sets.select("doc_id", "_mark", "sh", F.explode_outer("sh").alias("code"))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("size_class", "key"), F.lit(blocks)) == b)
        sketch = part.select(F.explode("sketch").alias("code"), "key", "need")
        full = part.select("key", "item_id", "item", "q")
        hits = probes.join(F.broadcast(sketch), "code").where(F.size("sh") >= F.col("need")).join(F.broadcast(full), "key")
        shared = hits.withColumn("shared", F.size(F.array_intersect("item", "sh"))).where("shared >= need")
        found = shared.select("doc_id", "_mark", "item_id", F.col("q").cast("long").alias("item_shingles"), F.col("shared").cast("long").alias("shared_shingles"))
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, item_shingles, shared_shingles.

    An item is contained when at least ``percent`` in a hundred of its distinct ``width``-word shingles occur anywhere in
    the document. Items and documents without words match nothing; an item of fewer words is one shingle of all
    of them and only matches a document of the same words. Rows that share an id are reported together, with the
    most shared shingles of any; null ids are reported as null.
    """
    found = _matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), width, percent)
    return found.groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared_shingles").alias("shared_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that contain an item, columns unchanged; each row is judged by its own text."""
    found = _matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), width, percent)
    bad_id, bad_mark = unused(docs, "_bad_id"), unused(docs, "_bad_mark")
    bad = cut_lineage(found.select(F.col("doc_id").alias(bad_id), F.col("_mark").alias(bad_mark)).distinct())
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (mark == F.col(bad_mark)), "left_anti")
