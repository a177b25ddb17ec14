"""Readers, writers and file listings (A, K14)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions import keys as K
from gridtally.functions.digests import Sha256, resumable
from gridtally.session import cut_lineage, scratch_path, ship_package

# Fields of an annotation document that hold its points.
POINT_FIELDS = ["coords", "coordinates", "points", "centroids", "xy"]


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A1: parquet, or CSV with a header; give a schema for CSV to avoid a second pass over the data."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A2: every cell a string, blank cells stay empty strings."""
    return (
        spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("nullValue", "\u0000").option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path).na.fill("")
    )


def read_id_list(spark: SparkSession, path: str, column: str | None = None, clean: bool = False) -> DataFrame:
    """A3: one id column, the first if none is named; ``clean`` trims, drops blanks and repeats."""
    df = read_text_table(spark, path)
    if column is not None and column not in df.columns:
        raise ValueError(f"column {column!r} not found in {df.columns}")
    ids = df.select(F.col(column or df.columns[0]).alias("unique_id"))
    if not clean:
        return ids
    return ids.select(F.trim(F.regexp_replace("unique_id", "\r", "")).alias("unique_id")).where("unique_id <> ''").distinct()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive file listing: path, size and time. The content column is never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size_bytes"), "modificationTime")
    )


def index_files(listing: DataFrame, suffixes: list[str]) -> DataFrame:
    """A4: visible files with an allowed extension by lower-cased stem, with the first path per stem."""
    keyed = keyed_files(listing, suffixes)
    return keyed.groupBy("key").agg(F.min("path").alias("path"))


def keyed_files(listing: DataFrame, suffixes: list[str]) -> DataFrame:
    name = K.basename(F.col("path"))
    seen = ~name.startswith(".") & (F.lower(name) != "thumbs.db")
    allowed = F.concat(F.lit("."), K.extension(F.col("path"))).isin(*suffixes)
    return listing.where(seen & allowed).select(F.lower(K.drop_extension(name)).alias("key"), "path")


def duplicate_keys(listing: DataFrame, suffixes: list[str]) -> DataFrame:
    """A5: every file of a key that has more than one, with the number of files of the key."""
    keyed = keyed_files(listing, suffixes)
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1")
    return keyed.join(many, "key")


def count_point_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Data rows per CSV or TSV file; files with only a header count 0."""
    rows = (
        spark.read.option("header", True).option("sep", sep).option("recursiveFileLookup", True).csv(path)
        .groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_points"))
    )
    return _with_empty_files(spark, path, rows)


def count_point_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines per text file."""
    rows = (
        spark.read.option("recursiveFileLookup", True).text(path)
        .groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count_if(F.trim("value") != "").alias("n_points"))
    )
    return _with_empty_files(spark, path, rows)


def _with_empty_files(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    rows = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "n_points")
    return list_files(spark, path).where(~K.basename(F.col("path")).rlike("^[._]")).select("path").join(rows, "path", "left").fillna(0, ["n_points"])


def count_point_documents(docs: DataFrame, content: str = "content") -> DataFrame:
    """Points per JSON document: a list's length, or the first listed field that is a list; else NULL."""
    c = F.col(content)
    sizes = [F.json_array_length(F.get_json_object(c, f"$.{f}")) for f in POINT_FIELDS]
    return docs.withColumn("n_points", F.coalesce(F.json_array_length(c), *sizes))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at ``path``; the committer publishes the files only when the job has succeeded."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_tsv(df: DataFrame, path: str, cols: list[str]) -> None:
    """Raw tab-separated rows; a field with a tab or a line break makes the job fail, nothing is published."""

    def plain(c: str) -> Column:
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        bad = F.raise_error(F.lit(f"field {c} holds a tab or a line break"))
        return F.when(s.rlike("[\t\n\r]"), bad).otherwise(s).alias(c)

    df.select(*[plain(c) for c in cols]).write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


FROZEN = {"summary_overall": "overall", "summary_by_split": "by_split", "summary_by_group": "by_group", "summary_by_density_bin": "by_density_bin"}


def write_frozen_results(agg: DataFrame, root: str, mode: str) -> dict[str, str]:
    """The summary tables of one policy under ``{mode}_matching``, ranked models included."""
    base = f"{root.rstrip('/')}/{mode}_matching"
    agg = cut_lineage(agg)
    out = {}
    for name, scope in FROZEN.items():
        out[name] = f"{base}/{name}"
        write_table(agg.where(F.col("scope") == scope).drop("scope"), out[name], "csv")
    from gridtally.operators.rollups import rank_models

    out["ranked_models"] = f"{base}/ranked_models"
    write_table(rank_models(agg.where("scope = 'overall'").drop("scope", "scope_value")), out["ranked_models"], "csv")
    return out


def read_payload_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole JSON documents of a folder as (path, content)."""
    return spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def merge_param_payloads(files: DataFrame) -> DataFrame:
    """A10: (group, combo_id, payload) from JSON documents in either layout.

    A document whose values all carry ``combo`` and ``best_theta`` belongs to the group named by its file
    stem; any other maps groups to such blocks. The file later by name wins; unreadable documents are skipped.
    """
    top = F.from_json("content", "map<string,string>", {"mode": "PERMISSIVE"})
    x = files.select(F.col("path"), top.alias("_top")).where("_top is not null")
    is_payload = lambda v: F.get_json_object(v, "$.combo").isNotNull() & F.get_json_object(v, "$.best_theta").isNotNull()
    x = x.withColumn("_flat", F.forall(F.map_values("_top"), is_payload))
    stem = K.drop_extension(K.basename(F.col("path")))
    flat = x.where("_flat").select("path", stem.alias("grp"), F.explode("_top").alias("combo_id", "payload"))
    nested = x.where("not _flat").select("path", F.explode("_top").alias("grp", "_block"))
    nested = nested.select("path", "grp", F.explode(F.from_json("_block", "map<string,string>")).alias("combo_id", "payload"))
    return flat.unionByName(nested).groupBy("grp", "combo_id").agg(F.max_by("payload", "path").alias("payload"))


def read_runs(spark: SparkSession, root: str, policy: str, schema: T.StructType | str, pattern: str = r"/run=([^/]+)/") -> DataFrame:
    """Unit metrics of every run under ``root`` tagged with the run; files on the policy path win over others."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root).withColumn("_path", F.col("_metadata.file_path"))
    rows = rows.withColumn("run", F.regexp_extract("_path", pattern, 1)).withColumn("_rank", F.when(F.col("_path").contains(f"policy={policy}/"), 0).otherwise(1))
    best = rows.groupBy("run").agg(F.min("_rank").alias("_best"))
    return rows.join(best, "run").where("_rank = _best").withColumn("preferred", F.col("_rank") == 0).drop("_path", "_rank", "_best")


#: Files above so many bytes are read in blocks by several tasks. A block is what Spark reads as one split.
WHOLE_BYTES = 64 << 20
#: Bytes of the pieces that a block is stored in.
PIECE_BYTES = 1 << 20
#: Files that Spark's text reader would unpack; they are read whole.
PACKED = "(?i)\\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"
BOM = b"\xef\xbb\xbf"


def _whole() -> Column:
    """Which files are read whole. It names properties of files only, so the others are not opened."""
    meta = F.col("_metadata")
    return (meta["file_size"] <= WHOLE_BYTES) | meta["file_path"].rlike(PACKED)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, seq, bytes) from the lines of blocks: each line with its line feed, joined to pieces."""
    at, seq, held, n = None, 0, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([b"\n".join(held) + b"\n"], pa.binary())], ["path", "start", "seq", "bytes"])

    for batch in batches:
        for path, start, line in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "line"))):
            if at != (path, start) or n > PIECE_BYTES:
                if held:
                    yield piece()
                seq, held, n, at = (seq + 1 if at == (path, start) else 0), [], 0, (path, start)
            held.append(line)
            n += len(line) + 1
    if held:
        yield piece()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, left, bytes): the states after a block, from rows sorted by path and seq whose first is the state before it."""
    path = digest = None
    left = 0

    def state() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([left], pa.int64()), pa.array([digest.state], pa.binary())], ["path", "left", "bytes"])

    for batch in batches:
        for i in range(batch.num_rows):
            p, seq, more, data = (batch.column(c)[i].as_py() for c in ("path", "seq", "left", "bytes"))
            if seq < 0:
                if path is not None:
                    yield state()
                path, left, digest = p, more, Sha256(data)
            else:  # the last line of a file gets a line feed that the file may not have
                digest.update(data[:left])
                left -= min(left, len(data))
    if path is not None:
        yield state()


def hash_in_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256), by ``_metadata.file_path``, of the files above ``WHOLE_BYTES``: their blocks are read side by side, and the state of each digest goes from block to block.

    A digest is a chain, so there are as many rounds as the largest file has blocks, but a round reads one block of each file only. Blocks hold
    whole lines, as Spark's text reader cuts them; a stretch without a line feed is held by one task.
    """
    ship_package(spark)
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(folder)
    lines = lines.where(~_whole())
    lines = lines.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("line"))
    root = scratch_path(spark, "blocks")
    lines.mapInArrow(_pieces, "path string, start long, seq long, bytes binary").write.partitionBy("start").parquet(root)
    pieces = spark.read.schema("path string, seq long, bytes binary, start long").parquet(root)
    read = pieces.groupBy("path").agg(F.sum(F.length("bytes")).alias("_read"))
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(~_whole()).select(meta["file_path"].alias("path"), F.col("length").alias("size_bytes"))
    # Spark's reader leaves out a byte order mark at the start of a file, which shows in the number of bytes; a last line may get a line feed.
    size, got = F.col("size_bytes"), F.col("_read")
    left = F.when(got.isin(size, size + 1), size).when(got.isin(size - 3, size - 2), size - 3)
    left = F.coalesce(left, F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("path"))).cast("long"))
    begun = read.join(sizes, "path").select("path", left.alias("left"), F.udf(_begun, "binary")(got < size).alias("bytes"))
    state = cut_lineage(begun)
    files = max(1, state.count())
    for (start,) in sorted(pieces.select("start").distinct().collect()):
        block = pieces.where(F.col("start") == start).select("path", "seq", F.lit(0).cast("long").alias("left"), "bytes")
        rows = block.unionByName(state.select("path", F.lit(-1).cast("long").alias("seq"), "left", "bytes"))
        state = cut_lineage(rows.repartition(files, "path").sortWithinPartitions("path", "seq").mapInArrow(_hashed, "path string, left long, bytes binary"))
    return state.select("path", F.udf(lambda b: Sha256(b).hexdigest(), "string")("bytes").alias("sha256"))


def _begun(marked: bool) -> bytes:
    digest = Sha256()
    if marked:
        digest.update(BOM)
    return digest.state


def build_manifest(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """Relative path, size and SHA-256 of every file, sorted by path; large files are hashed block by block."""
    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rel = lambda p: F.regexp_replace(F.regexp_replace(p, "^file:/+", "/"), "^.*?" + root.lstrip("/"), "")
    digested = lambda df: df.select(rel("path").alias("relpath"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    parts = [digested(files.where(_whole()) if resumable() else files)]
    long = files.where(~_whole()).select("path", F.col("length").alias("size_bytes"), F.col("_metadata.file_path").alias("_at"))
    if resumable() and not long.isEmpty():
        parts.append(long.join(hash_in_blocks(spark, folder).withColumnRenamed("path", "_at"), "_at").select(rel("path").alias("relpath"), "size_bytes", "sha256"))
    got = reduce(DataFrame.unionByName, parts)
    if suffixes is not None:
        got = got.where(F.concat(F.lit("."), K.extension(F.col("relpath"))).isin(*suffixes))
    return got.orderBy("relpath")
