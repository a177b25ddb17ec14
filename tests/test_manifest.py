import hashlib
import os
import random

import pytest

from gridtally.functions.digests import Sha256
from gridtally.sources import tables as A


def test_digest_is_handed_over():
    state = Sha256().state
    for part in (b"a" * 3, b"", b"b" * 200, b"c" * 63):
        digest = Sha256(state)
        digest.update(part)
        state = digest.state
    assert Sha256(state).hexdigest() == hashlib.sha256(b"a" * 3 + b"b" * 200 + b"c" * 63).hexdigest()


def test_large_files_are_hashed_block_by_block(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    raw = r.randbytes(60_000)
    files = {
        "a.parquet": raw, "ends.parquet": raw + b"\n", "feeds.parquet": b"\n" * 9_000, "none.parquet": bytes(9_000), "mark.parquet": b"\xef\xbb\xbf" + raw, "crlf.parquet": b"x\r\n" * 5_000,
        "sub/a [1] b.parquet": raw[::-1], "packed.parquet.gz": raw, "small.parquet": b"\xef\xbb\xbfab\n", "other.txt": raw,
        "mark feed.parquet": b"\xef\xbb\xbf" + raw + b"\n",
    }
    os.makedirs(tmp_path / "sub")
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(A, "WHOLE_BYTES", 5_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    read = []
    hashed = A.hash_in_blocks
    monkeypatch.setattr(A, "hash_in_blocks", lambda *a: read.append(hashed(*a)) or read[0])
    try:
        got = A.build_manifest(spark, str(tmp_path)).collect()
        assert read[0].count() == 9
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in sorted(files.items())]
    assert sorted(tuple(x) for x in got) == want


@pytest.mark.parametrize("suffixes, n", [([".parquet"], 1), (None, 2)])
def test_small_files_stay_whole(spark, tmp_path, suffixes, n):
    (tmp_path / "a.parquet").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert A.build_manifest(spark, str(tmp_path), suffixes).count() == n
