"""URL rules by a sort-merge range join over reversed-host keys and paths.

A host is turned round label by label and closed by a dot (``www.example.com`` to ``com.example.www.``), so that
a host and all its subdomains are one interval of keys; a path prefix likewise is an interval of paths. URLs and rules are
sorted by key and path and swept once per part. A stack holds the hosts whose interval covers the current key; each
holds its rules in order of path, linked to the rule whose interval encloses theirs, so a URL finds the longest
one by binary search and a walk outwards. The longest over all open hosts wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import LOWER, UPPER
from gridtally.llm.ranges import bounds, part_of
from gridtally.session import ship_package

DEFAULT = "allow"
_LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def reverse_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class HostRules:
    """Rules of one host, added in order of path; ``outer`` is the rule whose interval of paths encloses each."""

    def __init__(self, key: str):
        self.key = key
        self.paths: list[str] = []
        self.rules: list[tuple[str, str]] = []
        self.outer: list[int] = []
        self._open: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.rules[-1] = (rule, verdict)
            return
        while self._open and not path.startswith(self.paths[self._open[-1]]):
            self._open.pop()
        self.outer.append(self._open[-1] if self._open else -1)
        self._open.append(len(self.paths))
        self.paths.append(path)
        self.rules.append((rule, verdict))

    def longest(self, path: str) -> tuple[str, str] | None:
        """The last rule not above ``path`` in order, or else the nearest one around it whose interval holds ``path``."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return self.rules[at] if at >= 0 else None


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key, rule before URL, path): the verdict of each URL by the stack of open hosts."""
    stack: list[HostRules] = []
    part = None
    for pdf in frames:
        out = []
        for p, key, is_url, row, host, path, rule, verdict in zip(*(pdf[c] for c in ("part", "key", "is_url", "page_id", "host", "path", "rule", "verdict"))):
            if p != part:
                stack, part = [], p
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if not is_url:
                if not stack or stack[-1].key != key:
                    stack.append(HostRules(key))
                stack[-1].add(path, rule, verdict)
                continue
            found = [r for open_host in reversed(stack) if (r := open_host.longest(path))]
            best = max(found, key=lambda r: len(r[0]), default=(None, DEFAULT))
            out.append((row, host, path, *best))
        f = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])
        f["page_id"] = f["page_id"].astype("Int64")
        yield f


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (allow or block); a rule is written host + path and fits its host and all
    subdomains where the URL's path starts with the rule's. The longest fitting rule wins; of two equally long ones that with
    the longer host; of two equal ones a block. Without a fitting rule the verdict is allow and the rule null. Null URLs
    have empty host and path. Rules of null host or path are ignored. A part holds the rules of the hosts that are open at once. Repeated and null page ids stay as they are.
    """
    ship_package(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_host(F.col("host"))).withColumn("tie", F.xxhash64("page_id", "path"))
    cuts = bounds(urls, F.col("key"), F.col("tie"))
    urls = urls.withColumn("part", part_of(F.col("key"), F.col("tie"), cuts)).withColumn("is_url", F.lit(True))
    clean = F.translate(F.col("host"), UPPER, LOWER)
    known = rules.where("host is not null and path is not null").select(clean.alias("host"), "path", "verdict").distinct().withColumn("key", reversed_host(F.col("host")))
    low = part_of(F.col("key"), F.lit(-(1 << 63)), cuts)
    high = part_of(F.concat("key", F.lit(_LAST)), F.lit((1 << 63) - 1), cuts)
    spread = known.withColumn("part", F.explode(F.sequence(low, high))).withColumn("is_url", F.lit(False))
    nothing = F.lit(None)
    both = urls.select("part", "key", "is_url", "page_id", "host", "path", nothing.cast("string").alias("rule"), nothing.cast("string").alias("verdict")).unionByName(
        spread.select("part", "key", "is_url", nothing.cast("long").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    )
    dealt = both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "key", "is_url", "path", "verdict")
    return dealt.mapInPandas(sweep, "page_id long, host string, path string, rule string, verdict string")
