"""Resampling, periodic runs and byte-level BPE against brute force and the plain tokenizer."""

import math
import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridtally.llm import bpe, periodic, resample

SF = "/root/testdata/sf0.001"


# ---- resampling ---------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, percent=5, least=20):
    count = lambda texts: np.bincount([crc32(g.encode()) % 10_000 for t in texts for g in plain_features(t)[1]] or [0], minlength=10_000) - (0 if any(plain_features(t)[1] for t in texts) else np.eye(1, 10_000, dtype=int)[0])
    s, t = count([x for _, x in rows]).tolist(), count(target).tolist()
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for at, (doc_id, text) in enumerate(rows):
        n, grams = plain_features(text)
        weight = sum(gain[crc32(g.encode()) % 10_000] for g in grams)
        h = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        ranks.setdefault((r[0], r[3]), []).append(i + 1)
    drawn = sorted((key, i) for key, found in ranks.items() for i in found)
    return sorted(tuple(r[:4]) for r in out if r[0] is not None), drawn


def drawn_of(got):
    return sorted(((r["doc_id"], r["score"]), r["rank"]) for r in got if r["rank"] is not None)


def test_resample_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, drawn = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], percent=30)
    got = resample.resample(docs.repartition(7), target, percent=30).collect()
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == rows
    assert drawn_of(got) == drawn and len(drawn) > 20


def test_resample_of_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, "the cat sat on the moon", "x"), (2, None, "y"), (3, "", "z")], "item_id long, text string, score string")
    rows, drawn = plain_resample([(r["doc_id"], r["text"]) for r in odd_docs.collect()], ["the cat sat on the moon", None, ""], percent=50, least=5)
    got = resample.resample(odd_docs, target, percent=50, least_words=5).collect()
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got if r["doc_id"] is not None) == rows
    assert drawn_of(got) == drawn and len(got) == odd_docs.count()
    assert resample.resample(no_docs, target).collect() == []
    none = resample.resample(odd_docs, target.limit(0)).collect()
    assert len(none) == odd_docs.count() and {r["weight"] for r in none if r["doc_id"] in (2, 3, 4)} == {0}


def test_pieces_of_a_text_give_the_same_features(monkeypatch):
    text = " ".join(f"W{i % 7}ord-{i} é{i}" for i in range(200))
    whole = sorted(np.concatenate([f for _, f in resample.buckets(text)]).tolist())
    for piece in (1, 5, 64):
        monkeypatch.setattr(resample, "PIECE", piece)
        parts = list(resample.buckets(text))
        assert len(parts) > 2 and sorted(np.concatenate([f for _, f in parts]).tolist()) == whole
    assert whole == sorted(crc32(g.encode()) % 10_000 for g in plain_features(text)[1])


def test_cutoff_is_the_kth_key(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0, 1, 5, 9, rnd.randrange(1000)]), rnd.randrange(4), i) for i in range(700)]
    keys = spark.createDataFrame(rows, "a long, b long, c long").repartition(9)
    for k in (1, 2, 350, 699, 700):
        assert resample.cutoff(keys, k) == sorted(rows)[k - 1]
    assert resample.cutoff(keys.limit(1), 1) == tuple(keys.limit(1).first())


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 20)), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_weighted_median_has_half_the_weight_below(medians):
    key = resample.weighted_median([(n, (m, 0, 0)) for n, m in medians])
    total = sum(n for n, _ in medians)
    assert 2 * sum(n for n, m in medians if m <= key[0]) >= total
    assert 2 * sum(n for n, m in medians if m >= key[0]) >= total


# ---- periodic runs ------------------------------------------------------------------------------


def plain_runs(words):
    """Every stretch of words that equal those q words on, for every q; the first q that gives a stretch is its smallest period."""
    numbers, found = {}, {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], dtype=int)
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], w[q:] == w[:-q], [0]])
        step = np.diff(same)
        for i, j in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("prime, root", periodic.PRIMES)
def test_transform_convolves(prime, root):
    rnd = np.random.default_rng(2)
    for size in (2, 4, 64):
        a, b = rnd.integers(0, prime, (2, size, 3)).astype(np.uint64)
        assert (periodic.back_transform(periodic.transform(a.copy(), prime, root), prime, root) == a).all()
        both = periodic.transform(a.copy(), prime, root).astype(object) * periodic.transform(b.copy(), prime, root).astype(object) % prime
        got = periodic.back_transform(both.astype(np.uint64), prime, root)
        want = [sum(int(a[i, 1]) * int(b[(k - i) % size, 1]) for i in range(size)) % prime for k in range(size)]
        assert got[:, 1].tolist() == want


def test_occurrences_are_those_of_plain_comparison():
    rnd = np.random.default_rng(4)
    for size in (1, 2, 4, 8, 32):
        words = rnd.integers(0, 2, 400)
        words[100:300] = np.tile(words[100 : 100 + size + 3], 200)[:200]
        at = np.arange(0, 400 - size + 1, size)
        block, d = periodic.occurrences(words, at, size)
        want = [(i, k) for i in at.tolist() for k in range(size, 2 * size) if i + k + size <= 400 and (words[i : i + size] == words[i + k : i + k + size]).all()]
        assert list(zip(block.tolist(), d.tolist())) == want


@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=5), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_equal_plain_search(documents):
    lists = [[b"%d" % w for words, times in parts for w in words * times] for parts in documents]
    assert periodic.search(lists) == [plain_runs(w) for w in lists]


def test_runs_of_long_and_regular_texts():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 3000:
        a, b = b, b + a  # a Fibonacci word has no run of four periods
    assert periodic.search([b, [b"x"] * 5000, [b"%d" % (i % 777) for i in range(9000)]]) == [[], [(0, 5000, 1)], [(0, 9000, 777)]]


def test_run_rows_of_odd_documents(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(1000 + i, " ".join(f"w{j % 11}" for j in range(60 + i))) for i in range(30)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "score", "key").unionByName(extra, allowMissingColumns=True)
    planted = 0
    want = []
    for r in docs.collect():
        words = periodic.repeat_tail(r["doc_id"], (r["text"] or "").encode().split())
        planted += words != (r["text"] or "").encode().split()
        runs = plain_runs(words)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        text = b" ".join(w for i, w in enumerate(words) if i not in drop)
        want.append((r["doc_id"], len(runs), *four, sha256(lines.encode()).hexdigest(), sha256(text).hexdigest()))
    got = [tuple(r) for r in periodic.run_digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and planted
    assert periodic.run_digests(no_docs).collect() == []


def test_repeated_tail_follows_its_rule():
    words = [b"%d" % i for i in range(50)]
    changed = [i for i in range(200) if periodic.repeat_tail(i, words) != words]
    assert changed and all(crc32(str(i).encode()) % 10 == 0 for i in changed)
    assert periodic.repeat_tail(None, words) == words and periodic.repeat_tail(changed[0], []) == []
    h = crc32(str(changed[0]).encode()) // 10
    a, p = h % 50, 1 + (50 - h % 50) // (3 + h % 8)
    assert periodic.repeat_tail(changed[0], words) == [words[i if i < a else a + (i - a) % p] for i in range(50)]


# ---- byte-level BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_path()), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    import public_tokenizers

    tokens = bpe.encoder(bpe.vocabulary_path(), public_tokenizers.PATTERN)
    return lambda text: np.frombuffer(b"".join(tokens(text)), dtype="<u4")


SYLLABLES = st.sampled_from(["the", "ing", "tion", "er", "re", "ción", "ñ", "que", " ", "  ", "\n", "a", "aa", "=", "0", "'s", "日本", "ال", "\U0001f600", " ", "\x1c"])


@given(st.one_of(st.text(max_size=60), st.lists(SYLLABLES, max_size=40).map("".join), st.text(alphabet="etaoin", max_size=90)), st.integers(1, 7))
@settings(max_examples=800, deadline=None)
def test_ids_and_stream_equal_the_plain_tokenizer(plain, ours, text, step):
    text = text.encode("utf-8", "ignore").decode()
    ids = ours(text)
    assert ids.tolist() == plain.encode_ordinary(text)
    stream, out = bpe.StreamDecoder(bpe.vocabulary_path()), b""
    for i in range(0, len(ids), step):
        piece = stream.feed(ids[i : i + step])
        piece.decode("utf-8")  # handed out between characters only
        out += piece
    assert out + stream.close() == text.encode() and stream.valid


def test_forgetting_changes_nothing(plain, monkeypatch):
    for name, bound in (("STATES", 50), ("PAIRS", 20), ("MATCHES", 3), ("CHUNK", 7), ("LONG", 2)):
        monkeypatch.setattr(bpe, name, bound)
    monkeypatch.setattr(bpe, "_encoders", {})
    import public_tokenizers

    tokens = bpe.encoder(bpe.vocabulary_path(), public_tokenizers.PATTERN)
    text = "Thorti ensttion of eahe onnthaly and. " * 20 + "=" * 500 + " señor 日本語 " + "ab" * 300
    assert np.frombuffer(b"".join(tokens(text)), "<u4").tolist() == plain.encode_ordinary(text)


def test_byte_states_are_those_of_utf8():
    moves = bpe.byte_moves()

    def state_of(raw):
        state = 0
        for b in raw:
            state = int(moves[state, b])
        return state

    for point in [*range(0, 0xD800, 97), *range(0xE000, 0x110000, 997), 0x7F, 0x80, 0x7FF, 0x800, 0xD7FF, 0xFFFF, 0x10000, 0x10FFFF]:
        raw = chr(point).encode()
        assert state_of(raw) == 0 and all(state_of(raw[:i]) not in (0, bpe.BROKEN) for i in range(1, len(raw)))
    for raw in (b"\x80", b"\xc0\x80", b"\xc1\xbf", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf0\x80\x80\x80", b"\xf4\x90\x80\x80", b"\xf5", b"\xc3("):
        assert state_of(raw) == bpe.BROKEN


def test_stream_of_broken_bytes_is_handed_out_and_reported():
    ranks = bpe.read_ranks(bpe.vocabulary_path())
    for raw in (b"a\xffb", b"\xc3", b"x\xe6\x97"):
        stream = bpe.StreamDecoder(bpe.vocabulary_path())
        ids = np.array([ranks[bytes([b])] for b in raw])
        assert stream.feed(ids) + stream.close() == raw and not stream.valid


def test_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Transducer({b"a": 0})


def test_round_trip_of_odd_documents(spark, odd_docs, no_docs, plain):
    got = sorted((tuple(r) for r in bpe.round_trip(odd_docs).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(no_docs).collect() == []
    assert all(r["valid"] for r in bpe.decode(bpe.encode(odd_docs)).collect())
