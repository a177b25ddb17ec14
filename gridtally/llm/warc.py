"""WARC archives and an ordered capture index by external merge.

Pages are written as gzip members of WARC files in the shared folder, one file per task, and read back. Each reading
task sorts its captures by URL key and time into a run; runs are cut at common keys and the slices of each key range
are merged by a loser tree, which gives capture histories in global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import stored
from gridtally.llm.ranges import bounds, part_of
from gridtally.session import scratch_path, ship_package

#: Captures carry no time in the page table; this one is written unless a ``captured`` text column is there.
EPOCH = "2024-01-01T00:00:00Z"


def file_system(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: str, url: str, when: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the payload's digest and length but not the payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        body += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _line(text: str) -> str:
    """A header value on one line: control characters and % are escaped."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _unline(text: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    names = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    return names, rest[: int(names["content-length"])]


def url_key(url: str) -> str:
    """Sortable form of a URL: reversed host, then path and query in lower case; scheme, www. and fragment dropped."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    m = re.match(r"[^/?]*", rest)
    host = m[0].lower().rsplit("@", 1)[-1].split(":", 1)[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[m.end():].lower() or "/")


def deduplicated(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with payload digest, size, type and the page a revisit refers to."""

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raw = [(h or "").encode("utf-8") for h in pdf["html"]]
            yield pdf.assign(payload_bytes=[len(r) for r in raw], payload_digest=[payload_digest(r) for r in raw])

    when = F.col("captured").cast("string") if "captured" in pages.columns else F.lit(EPOCH)
    src = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(when, F.lit(EPOCH)).alias("captured"), F.col("html").cast("string").alias("html"),
    )
    known = src.mapInPandas(digests, "page_id long, url string, captured string, html string, payload_bytes long, payload_digest string")
    first = known.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
    first = stored(first.where("copies > 1 and original is not null").select("payload_digest", "original"), "originals")
    revisit = F.coalesce((F.col("payload_bytes") >= min_bytes) & (F.col("page_id") != F.col("original")), F.lit(False))
    return known.join(first, "payload_digest", "left").select(
        "page_id", "url", "captured", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write one WARC file per task into ``folder``; returns (file, records, bytes).

    A file is written under the name of the attempt and moved to its final name when complete, so a repeated task leaves
    one whole file.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        records = size = 0
        with fs.open_output_stream(draft, compression=None) as out:
            for pdf in frames:
                for page, url, when, html, digest, kind, other in zip(*(pdf[c] for c in ("page_id", "url", "captured", "html", "payload_digest", "record_type", "refers_to"))):
                    page, other = ("" if pd.isna(x) else str(int(x)) for x in (page, other))
                    member = gzip.compress(record(kind, page, url, when, (html or "").encode("utf-8"), digest, other), 1, mtime=0)
                    out.write(member)
                    records, size = records + 1, size + len(member)
        fs.move(draft, f"{root}/{name}")
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

    ship_package(pages.sparkSession)
    return stored(deduplicated(pages, min_bytes).mapInPandas(write, "file string, records long, bytes long"), "archives")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream."""
    data, offset, more = b"", 0, True
    while True:
        unzip, parts, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not data:
                data = stream.read(chunk) if more else b""
                more = bool(data)
                if not data:
                    return
            parts.append(unzip.decompress(data))
            used += len(data) - len(unzip.unused_data)
            data = unzip.unused_data
        yield offset, used, b"".join(parts)
        offset += used


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record of the archives, each file sorted by (url_key, captured) as one run."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path in pdf["file"]:
                fs, name = file_system(path)
                out = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for offset, length, data in members(stream):
                        head, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
                            raise ValueError(f"damaged record at {path}:{offset}")
                        url = _unline(head["warc-target-uri"]) if "warc-target-uri" in head else ""
                        ids = [re.search(r":(-?\d*)>$", head.get(k, ":>"))[1] for k in ("warc-record-id", "warc-refers-to")]
                        out.append((*(int(i) if i else None for i in ids), url, url_key(url), head["warc-date"], size, digest, head["warc-type"], path, offset, length))
                f = pd.DataFrame(out, columns=["page_id", "refers_to", "url", "url_key", "captured", "payload_bytes", "payload_digest", "record_type", "file", "at", "bytes"])
                f = f.sort_values(["url_key", "captured", "at"], kind="stable", ignore_index=True)
                f["page_id"], f["refers_to"], f["place"] = f["page_id"].astype("Int64"), f["refers_to"].astype("Int64"), range(len(f))
                yield f

    n = max(1, files.count())
    each = files.select("file").repartitionByRange(n, "file")
    return stored(each.mapInPandas(read, _RUN), "runs")


_RUN = "page_id long, refers_to long, url string, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, file string, at long, bytes long, place long"


class LoserTree:
    """K-way merge: inner nodes hold the loser of each match, so the next winner costs one path to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.lost = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int):
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _before(self, i: int, j: int) -> bool:
        a, b = self._head(i), self._head(j)
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _play(self, i: int) -> None:
        """Move run ``i`` up from its leaf; while the tree is being built an empty node takes it."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.lost[node] == -1:
                self.lost[node] = winner
                return
            if self._before(self.lost[node], winner):
                self.lost[node], winner = winner, self.lost[node]
            node //= 2
        self.lost[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self._head(self.lost[0])) is not None:
            i = self.lost[0]
            self.at[i] += 1
            self._play(i)
            yield head


def capture_histories(runs: DataFrame) -> DataFrame:
    """The captures of all runs in order of (part, position): sorted by URL key, time and file position over the whole."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        keys = list(zip(pdf["url_key"], pdf["captured"], pdf["file"], pdf["at"], range(len(pdf))))
        new = (pdf["file"] != pdf["file"].shift()).to_numpy().nonzero()[0].tolist() + [len(pdf)]
        order = [key[-1] for key in LoserTree([keys[a:b] for a, b in zip(new[:-1], new[1:])])]
        yield pdf.iloc[order].assign(position=range(len(pdf)))

    # a key that fills several parts is split by time, file and offset, the order of the merge
    tie = F.concat_ws("|", "captured", "file", F.lpad(F.col("at").cast("string"), 20, "0"))
    cuts = bounds(runs, F.col("url_key"), tie)
    dealt = runs.withColumn("part", part_of(F.col("url_key"), tie, cuts)).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "file", "place")
    return dealt.mapInPandas(merge, _RUN + ", part int, position long")


def archived_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write, read back and index: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, part, position.

    Of records with equal payloads of at least ``min_bytes`` bytes the one of the largest page id is the response, the others revisit
    it; of rows that share that id all are responses. Null html is an empty payload. A null page id is written as an
    empty one and never referred to; if all copies have null ids all are responses.
    """
    where = folder or scratch_path(pages.sparkSession, "warc")
    files = write_archives(pages, where, min_bytes)
    return capture_histories(read_archives(files)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "part", "position")
