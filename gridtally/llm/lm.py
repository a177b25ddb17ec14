"""Language-model scores of whole texts from an Elias-Fano bigram trie learnt on the corpus itself.

Texts are cut into chunks of whole documents. Each chunk sends its distinct words to shards by hash, which count them and
give known words dense ids. With ids and counts back, a chunk sends its distinct pairs of neighbouring words to shards
by context; a shard counts the pairs, builds and writes its trie, memory-maps it and answers the pairs of every chunk from it.
What is shuffled is one compressed array per chunk and shard. A context that holds more than its share of all tokens is
spread over several shards by its successors.

The model: p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and p(w | v) = (c(v w) + M p(w)) / (c(v) + M), with one end token per text that
also is the context of the first word.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import grouped, mix, stored
from gridtally.llm.eliasfano import Trie, dequantise, quantise
from gridtally.llm.features import PIECE, Words
from gridtally.llm.warc import file_system
from gridtally.session import scratch_path, ship_package

FOLDS, HELD_OUT = 5, 1
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 8_000_000
#: Weight M of the word's own probability in its probability after a context.
MASS = 4.0
END = np.uint64(0x656E64)
#: Lowest log10 value that the byte codes reach.
FLOOR = -12.0


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed byte planes behind its length."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes() if len(raw) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = pa.decompress(bytes(data[8:]), decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(dtype).reshape(n)


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, each text followed by the end token, and the number of tokens of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    codes, sizes, at = [], [], 0
    while at < len(raw):
        size, to = len(raw[at]), at + 1
        while to < len(raw) and size + len(raw[to]) <= PIECE:
            size += len(raw[to])
            to += 1
        words = Words(raw[at:to])
        n = np.bincount(words.text, minlength=to - at)
        out = np.full(len(words.start) + to - at, END, dtype=np.uint64)
        out[np.arange(len(words.start)) + words.text] = words.whole()
        codes.append(out)
        sizes.append(n + 1)
        at = to
    return np.concatenate(codes), np.concatenate(sizes)


_CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, words binary, trained binary, stream binary, sizes binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks: ids and folds of their documents, sorted distinct words, training counts, and the text as word places."""

    def close(ids: list, held: list, texts: list, number: int) -> pd.DataFrame:
        codes, sizes = word_codes(texts)
        words, stream = np.unique(codes, return_inverse=True)
        train = np.repeat(~np.array(held), sizes)
        trained = np.bincount(stream[train], minlength=len(words))
        return pd.DataFrame({
            "chunk": [number], "doc_ids": [ids], "held": [held], "words": [squeeze(gaps(words))], "trained": [squeeze(trained.astype("uint32"))],
            "stream": [squeeze(stream.astype("uint32"))], "sizes": [squeeze(sizes.astype("uint32"))],
        })

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for pdf in frames:
            for i, h, t in zip(pdf["doc_id"], pdf["held"], pdf["text"]):
                if texts and size + len(t or "") > CHUNK:
                    yield close(ids, held, texts, number)
                    ids, held, texts, size = [], [], [], 0
                    number += 1
                ids.append(None if pd.isna(i) else int(i))
                held.append(bool(h))
                texts.append(t)
                size += len(t or "")
        if texts:
            yield close(ids, held, texts, number)

    ship_package(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, _CHUNKS)


def count_words(chunks: DataFrame, shards: int) -> DataFrame:
    """Per chunk and shard the place of each word among the shard's known words (from 1, 0: unknown) and its count.

    Rows of chunk -1 hold a shard's number of known words and of tokens.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
        for pdf in frames:
            for chunk, words, trained in zip(pdf["chunk"], pdf["words"], pdf["trained"]):
                w, c = np.cumsum(unsqueeze(words, "u8"), dtype=np.uint64), unsqueeze(trained, "u4")
                cut = [0, *np.searchsorted(w, edges).tolist(), len(w)]
                out = [(s, chunk, squeeze(gaps(w[a:b])), squeeze(c[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
                yield pd.DataFrame(out, columns=["shard", "chunk", "words", "trained"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in frames for r in zip(pdf["shard"], pdf["chunk"], pdf["words"], pdf["trained"])]
        for shard in sorted({r[0] for r in rows}):
            mine = [r for r in rows if r[0] == shard]
            words = [np.cumsum(unsqueeze(r[2], "u8"), dtype=np.uint64) for r in mine]
            _, which = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(which, np.concatenate([unsqueeze(r[3], "u4") for r in mine])).astype(np.int64)
            place = np.where(total > 0, np.cumsum(total > 0), 0)
            at, out = 0, []
            for r, w in zip(mine, words):
                own = which[at : at + len(w)]
                at += len(w)
                out.append((shard, r[1], squeeze(place[own].astype("u4")), squeeze(total[own].astype("u8"))))
            out.append((shard, -1, int((total > 0).sum()).to_bytes(8, "little"), int(total.sum()).to_bytes(8, "little")))
            yield pd.DataFrame(out, columns=["shard", "chunk", "places", "counts"])

    sent = chunks.select("chunk", "words", "trained").mapInPandas(send, "shard int, chunk long, words binary, trained binary")
    return sent.repartitionById(shards, F.col("shard")).mapInPandas(count, "shard int, chunk long, places binary, counts binary")


class Chunk:
    """A chunk with the ids and counts of its words."""

    def __init__(self, row: dict, base: np.ndarray, known: int, tokens: int):
        self.held, self.sizes = np.array(row["held"], dtype=bool), unsqueeze(row["sizes"], "u4").astype(np.int64)
        stream = unsqueeze(row["stream"], "u4")
        parts = sorted(row["back"], key=lambda p: p["shard"])
        ids = np.concatenate([np.where((p_ := unsqueeze(p["places"], "u4").astype(np.int64)) > 0, p_ + base[p["shard"]], 0) for p in parts])
        counts = np.concatenate([unsqueeze(p["counts"], "u8") for p in parts]).astype("float64")
        self.id, self.count = ids[stream], counts[stream]
        self.log_p = np.log10((counts + 0.5) / (tokens + 0.5 * (known + 1)))[stream]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        last = first + self.sizes - 1
        before = np.arange(len(stream)) - 1
        before[first] = last
        self.context, self.context_count = self.id[before], self.count[before]
        self.paired = (self.id > 0) & (self.context > 0)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, values, minlength=len(self.sizes))


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in frames:
        yield from pdf.to_dict("records")


def score(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; tries are written to ``folder``.

    Texts whose fold is the held-out one are scored only. Null and empty texts are a single end token. Null ids are trained on;
    repeated rows are counted and scored one by one. Without training text no word is known and every token has the
    probability of an unknown word.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = folder or scratch_path(spark, "tries")
    name = f"lm_chunks_{uuid.uuid4().hex}"
    path = scratch_path(spark, "chunks")
    # bucketed by chunk, so that what comes back for a chunk is joined without moving the chunk
    chunked(docs.select("doc_id", "text")).write.bucketBy(shards, "chunk").option("compression", "zstd").option("path", path).saveAsTable(name)
    chunks = spark.table(name)
    counted = stored(count_words(chunks, shards), "counts")
    stats = counted.where("chunk = -1").select("shard", "places", "counts").collect()
    size = {r["shard"]: int.from_bytes(r["places"], "little") for r in stats}
    base = np.concatenate([[0], np.cumsum([size.get(s, 0) for s in range(shards)])])[:-1]
    known, tokens = sum(size.values()), sum(int.from_bytes(r["counts"], "little") for r in stats)
    if known >= 1 << 32:
        raise ValueError("more than 2 ** 32 distinct words: raise the width of word ids")
    back = counted.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("shard", "places", "counts")).alias("back"))
    joined = chunks.drop("words", "trained").join(back.hint("merge"), "chunk")

    def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(frames):
            c = Chunk(row, base, known, tokens)
            alone = np.where(c.context > 0, np.log10(MASS / (c.context_count + MASS)), 0.0) + c.log_p
            yield pd.DataFrame({
                "chunk": row["chunk"], "i": np.arange(len(c.sizes)), "doc_id": pd.array(list(row["doc_ids"]), dtype="Int64"), "held_out": c.held, "n_tokens": c.sizes,
                "n_known": c.sums(c.id > 0).astype("int64"), "base_score": c.sums(c.log_p), "rest": c.sums(np.where(c.paired, 0.0, alone)),
            })

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(frames):
            c = Chunk(row, base, known, tokens)
            at = np.flatnonzero(c.paired)
            key = c.context[at].astype(np.uint64) << np.uint64(32) | c.id[at].astype(np.uint64)
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            run = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (c.doc[at][1:] != c.doc[at][:-1])])) if len(key) else np.zeros(0, np.int64)
            times, doc, key, at = np.diff(np.append(run, len(key))), c.doc[at[run]], key[run], at[run]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            width = np.diff(np.append(new, len(key)))
            pair, p = key[new], at[new]
            spread = np.minimum(np.ceil(c.context_count[p] * 2 * shards / max(tokens, 1)), shards).astype(np.uint64)
            sub = mix(pair & np.uint64(0xFFFFFFFF)) % np.maximum(spread, np.uint64(1))
            shard = ((mix(pair >> np.uint64(32)) + sub) % np.uint64(shards)).astype(np.int64)
            place = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[place], np.arange(shards + 1))
            code = quantise(c.log_p[p], FLOOR)
            out = []
            for s in range(shards):
                mine = place[cut[s] : cut[s + 1]]
                if not len(mine):
                    continue
                entry = np.repeat(new[mine] - np.concatenate([[0], np.cumsum(width[mine])[:-1]]), width[mine]) + np.arange(width[mine].sum())
                context = pair[mine] >> np.uint64(32)
                fresh = np.concatenate([[True], context[1:] != context[:-1]])
                out.append((
                    s, row["chunk"], squeeze(gaps(pair[mine])), squeeze(c.context_count[p[mine]][fresh].astype("u8")), squeeze(code[mine]), squeeze(width[mine].astype("u4")),
                    squeeze(doc[entry].astype("u4")), squeeze(times[entry].astype("u4")), squeeze(c.held),
                ))
            yield pd.DataFrame(out, columns=["shard", "chunk", "pair", "contexts", "code", "width", "doc", "times", "held"])

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for r in _rows(frames)]
        for shard in sorted({r["shard"] for r in rows}):
            mine = [r for r in rows if r["shard"] == shard]
            asked = [np.cumsum(unsqueeze(r["pair"], "u8"), dtype=np.uint64) for r in mine]
            pair, which = np.unique(np.concatenate(asked), return_inverse=True)
            seen, lower, total = np.zeros(len(pair)), np.zeros(len(pair), np.uint8), np.zeros(len(pair))
            at = 0
            for r, q in zip(mine, asked):
                own = which[at : at + len(q)]
                at += len(q)
                width = unsqueeze(r["width"], "u4").astype(np.int64)
                train = ~unsqueeze(r["held"], "?")[unsqueeze(r["doc"], "u4")]
                seen[own] += np.add.reduceat(unsqueeze(r["times"], "u4") * train, np.cumsum(width) - width)
                lower[own] = unsqueeze(r["code"], "u1")
                context = q >> np.uint64(32)
                fresh = np.concatenate([[True], context[1:] != context[:-1]])
                total[own] = unsqueeze(r["contexts"], "u8")[np.cumsum(fresh) - 1]
            below = dequantise(lower, FLOOR)
            kept = np.flatnonzero(seen > 0)
            context, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = kept[np.concatenate([[True], context[kept][1:] != context[kept][:-1]])] if len(kept) else kept
            value = np.log10((seen[kept] + MASS * 10.0 ** below[kept]) / (total[kept] + MASS))
            data = Trie.encode(context[kept], word[kept], value, np.log10(MASS / (total[first] + MASS)), FLOOR)
            # a context seen only in held-out text is not in the trie; its back-off weight follows from its count
            log_p = _mapped(data, where, shard).log10(context, word, below)
            unseen = np.isin(context, context[first], invert=True)
            log_p[unseen] += np.log10(MASS / (total[unseen] + MASS))
            at, out = 0, []
            for r, q in zip(mine, asked):
                own = log_p[which[at : at + len(q)]]
                at += len(q)
                held = unsqueeze(r["held"], "?")
                sums = np.bincount(unsqueeze(r["doc"], "u4"), np.repeat(own, unsqueeze(r["width"], "u4")) * unsqueeze(r["times"], "u4"), minlength=len(held))
                out.append((r["chunk"], squeeze(sums)))
            yield pd.DataFrame(out, columns=["chunk", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        part = sum(unsqueeze(s, "f8") for s in pdf["sums"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "i": np.arange(len(part)), "part": part})

    sent = joined.mapInPandas(pairs, "shard int, chunk long, pair binary, contexts binary, code binary, width binary, doc binary, times binary, held binary")
    answers = sent.repartitionById(shards, F.col("shard")).mapInPandas(answer, "chunk long, sums binary")
    dealt = answers.repartition("chunk").sortWithinPartitions("chunk")
    parts = dealt.mapInPandas(lambda frames: grouped(frames, ["chunk"], add), "chunk long, i long, part double")
    each = joined.mapInPandas(plain, "chunk long, i long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rest double")
    return each.join(parts, ["chunk", "i"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", (F.col("rest") + F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def _mapped(data: bytes, folder: str, shard: int) -> Trie:
    """Write a shard's trie to the folder and map it into memory."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    draft, name = f"{root}/.{shard:06d}.{uuid.uuid4().hex}", f"{root}/{shard:06d}.trie"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(data)
    fs.move(draft, name)
    if os.path.exists(name):
        return Trie(np.memmap(name, dtype=np.uint8, mode="r"))
    with tempfile.TemporaryFile() as local:  # a folder that cannot be mapped: a copy that goes with its handle
        local.write(data)
        local.flush()
        return Trie(np.memmap(local, dtype=np.uint8, mode="r"))
