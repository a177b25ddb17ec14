"""Language model, main text, URL rules, archives and packing against brute force."""

import base64
import gzip
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gridtally.llm import htmltext, lm, packing, urlfilter, warc
from gridtally.llm.eliasfano import EliasFano, Trie


# ---- language model ------------------------------------------------------------------------------


@pytest.mark.parametrize("n, top", [(1, 1), (5, 10), (700, 1 << 40), (700, 750), (20_000, 1 << 30)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    e = EliasFano(np.frombuffer(EliasFano.encode(v), np.uint8))
    assert (e.get(np.arange(n)) == v).all()
    asked = np.concatenate([v, rng.integers(0, top + 5, 500).astype(np.uint64)])
    place = np.searchsorted(v, asked)
    assert (e.successor(asked) == place).all()
    there = (place < n) & (v[np.minimum(place, n - 1)] == asked)
    assert ((e.find(asked) >= 0) == there).all()


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 30, 100_000)).astype(np.uint64)
    assert len(EliasFano.encode(v)) * 8 / len(v) < 2 + 15 + 2


def test_trie_look_up():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 300, 5_000) << 32 | rng.integers(0, 500, 5_000))
    context, word = key >> 32, key & 0xFFFFFFFF
    value, backoff = -rng.random(len(key)) * 5, -rng.random(len(np.unique(context))) * 3
    trie = Trie(np.frombuffer(Trie.encode(context, word, value, backoff, -8.0), np.uint8))
    asked = np.sort(rng.integers(0, 320, 9_000)), rng.integers(0, 520, 9_000)
    lower = -rng.random(9_000) * 6
    pairs, weights = dict(zip(zip(context.tolist(), word.tolist()), value)), dict(zip(np.unique(context).tolist(), backoff))
    expected = [pairs.get((c, w), weights.get(c, 0.0) + x) for c, w, x in zip(asked[0].tolist(), asked[1].tolist(), lower)]
    assert np.abs(trie.log10(*asked, lower) - expected).max() <= 8 / 255 / 2 + 1e-9
    empty = Trie(np.frombuffer(Trie.encode(key[:0], key[:0], value[:0], backoff[:0], -8.0), np.uint8))
    assert (empty.log10(*asked, lower) == lower).all()


def brute_lm(rows):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    one, two = Counter(), Counter()
    for (_, t), h in zip(tokens, held):
        if not h:
            one.update(t)
            two.update(zip([None, *t[:-1]], t))
    n = sum(one.values())
    z = n + 0.5 * (len(one) + 1)
    out = []
    for (i, t), h in zip(tokens, held):
        p = [(one[w] + 0.5) / z for w in t]
        s = [(two[v, w] + lm.MASS * q) / (one[v] + lm.MASS) if one[v] else q for v, w, q in zip([None, *t[:-1]], t, p)]
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, p)), sum(map(math.log10, s))))
    return out


def check_lm(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, expected = sorted(map(tuple, lm.score(df).collect()), key=key), sorted(brute_lm(rows), key=key)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9) and abs(g[6] - e[6]) <= 0.03 * e[2]


def test_language_model(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    monkeypatch.setattr(lm, "CHUNK", 60_000)
    check_lm(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_language_model_odd_rows(spark, odd_docs, no_docs):
    check_lm(odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()])
    assert lm.score(no_docs).count() == 0
    only_held = [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    check_lm(spark.createDataFrame(only_held, "doc_id long, text string"), only_held)


# ---- main text -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script></head><body class="page"><header>Site</header>
<div id="cookie-notice">We use <b>cookies</b></div><div class="sidebar"><div>x</div>y</div><main><article class="post"><header><h1>Ti&amp;tle</h1></header>
<p>Hello&nbsp;w<i>or</i>ld <p>two<br>three<form>mail<input></form><aside>rel</aside><!-- ad --><ul><li>one</li><li>t&#119;o</ul>
<section class="comments"><article>bad comment</article></section></article></main><footer>f</footer>"""


def test_main_text_of_one_page():
    assert htmltext.main_text(PAGE, frozenset()) == "Ti&tle Hello world two three one two"
    assert htmltext.main_text(None, frozenset()) == htmltext.main_text("<p> <br>", frozenset()) == ""
    assert htmltext.main_text('<div class="ad">x<article>real', frozenset()) == "real"
    assert htmltext.main_text("a < b &lt;i&gt; <", frozenset()) == "a < b <i> <"


def test_fixed_text_of_a_host_is_dropped(spark):
    body = '<div class="top">Our site</div><div>Story {0} is about {0}.</div><p>Call us now</p>'
    rows = [(i, f"http://h.example/{i}", body.format(i)) for i in range(8)] + [(20, "http://alone.example/", body.format(20))]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 is about 3." and got[20] == "Our site Story 20 is about 20. Call us now"


def test_articles_stay_whole_where_pages_repeat(spark):
    rows = [(i, "http://h.example/", "<nav>x</nav><article><p>same line</p></article>") for i in range(9)]
    assert {r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"same line"}


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>t", "x"), (3, "http://h/", "", "x"), (4, "http://h/", "<p>" + "long " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(((r["page_id"] or 0), r["text"][:4], r["n_chars"]) for r in htmltext.extract_text(df).collect())
    assert got == [(0, "t", 1), (1, "", 0), (1, "", 0), (3, "", 0), (4, "long", 499_999)] and htmltext.extract_text(df.limit(0)).count() == 0


def test_extracted_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in htmltext.extract_text(pages).collect():
        inside = re.search("<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())


# ---- URL rules -----------------------------------------------------------------------------------


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda r: (r[0], r[1], r[3] == "block"), default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark):
    rng = np.random.default_rng(6)
    labels, paths = ["a", "b", "www", "x-1", "com", "net", "B"], ["/", "/en/", "/en", "/fr/1", ""]
    hosts = [".".join(rng.choice(labels, int(rng.integers(1, 5)))) for _ in range(80)]
    rules = list({(h.lower(), p): (h.lower(), p, str(rng.choice(["allow", "block"]))) for h, p in zip(rng.choice(hosts, 40), rng.choice(paths, 40))}.values())
    urls = [f"http{'s' * (i % 2)}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '/more'])}" for i in range(700)]
    urls += ["http://hot.a.com/en/"] * 900 + [None, "", "no scheme", "://", "http://", "http://A.COM:80/x?y#z", "x://y://z/q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = urlfilter.judge(pages, spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: brute_rule(u, rules) for i, u in enumerate(urls)} and len(got) == len(urls)


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a/"), (1, "http://a/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert sorted(r["verdict"] for r in urlfilter.judge(pages, rules).collect()) == ["allow", "block", "block"]
    assert {r["rule"] for r in urlfilter.judge(pages, rules.limit(0)).collect()} == {None}


# ---- archives ------------------------------------------------------------------------------------


def brute_records(rows, min_bytes):
    raw = [(i, (h or "").encode()) for i, h in rows]
    top = {}
    for i, b in raw:
        if i is not None:
            top[b] = max(i, top.get(b, i))
    out = []
    for i, b in raw:
        other = top.get(b)
        again = i is not None and len(b) >= min_bytes and other != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives(spark, min_bytes):
    rows = [(i, f"http://{'abc'[i % 3]}.example/{i % 7}", ["same page", None, "", f"page {i} é\x00\r\n\r\n", "x" * 50_000][i % 5]) for i in range(60)]
    rows += [(3, "http://A.example/3", "same page"), (None, None, "same page"), (None, "u\r\nWARC-Type: x %41", "lonely")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.archived_pages(df.repartition(4), min_bytes).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_records([(r[0], r[2]) for r in rows], min_bytes)
    order = [r["url_key"] for r in sorted(got, key=lambda r: (r["part"], r["position"]))]
    assert order == sorted(order)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_archive_files_are_readable(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "one"), (2, "http://b/", "one")], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages, str(tmp_path / "w")).collect()
    data = b"".join(gzip.open(r["file"]).read() for r in files)
    assert data.count(b"WARC/1.1\r\n") == 2 and b"WARC-Type: revisit" in data and sum(r["records"] for r in files) == 2


def test_histories_are_ordered_by_time(spark):
    rows = [(i, "http://www.A.example/p", f"v{i}", f"2024-01-{1 + (i * 7) % 28:02d}T00:00:00Z") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured string").repartition(5)
    files = warc.write_archives(df, warc.scratch_path(spark, "w"))
    got = sorted(warc.capture_histories(warc.read_archives(files)).collect(), key=lambda r: (r["part"], r["position"]))
    assert [r["captured"] for r in got] == sorted(r[3] for r in rows) and {r["url_key"] for r in got} == {"example,a)/p"}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted(map(int, rng.integers(0, 50, int(rng.integers(0, 30))))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# ---- packing -------------------------------------------------------------------------------------


def check_packing(got, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = sorted((i is None, i or 0, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, x in rows)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"] is None, r["doc_id"] or 0), []).append(r)
    for none, i, data in ids:
        n = len(data) // 4
        mine = by[none, i]
        at = 0
        while at < n:  # a document of the same id may have pieces of the same start: take one that fits
            p = next(r for r in mine if r["start"] == at and r["doc_tokens"] == n and r["ids_crc32"] == zlib.crc32(data[4 * at : 4 * (at + r["length"])]))
            mine.remove(p)
            at += p["length"]
        assert at == n
    assert not any(by.values())
    total = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == total.get(r["sequence_id"], 0) and r["length"] > 0
        total[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(total.values()) <= 4096 and sorted(total) == list(range(len(total)))
    waste = sum(0 if n & (n - 1) == 0 else 4096 - n for n in total.values())
    return waste / (sum(total.values()) + waste)


def test_packing_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check_packing(packing.packed_pieces(docs.repartition(3)).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()]) < 0.02


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    check_packing(packing.packed_pieces(odd_docs).collect(), rows)
    assert packing.packed_pieces(no_docs).count() == 0


def test_packing_of_like_lengths(spark):
    rows = [(i, " ".join(["cat"] * 2_600)) for i in range(40)]
    assert check_packing(packing.packed_pieces(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows) < 0.02


def test_least_squares():
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    b = a @ np.maximum(rng.normal(0, 1, 30), 0) + rng.normal(0, 0.1, 12)
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert x.min() >= 0 and gradient.min() > -1e-5 and np.abs(gradient[x > 0]).max() < 1e-5


def test_plan_never_takes_more_than_there_is():
    rng = np.random.default_rng(3)
    have = {int(u): int(n) for u, n in zip(rng.integers(1, 257, 90), rng.integers(0, 500, 90))}
    ranges, n = packing.plan(have, 256)
    load = np.zeros(n)
    for u, parts in ranges.items():
        assert sum(e - s for s, e, _, _ in parts) <= have[u]
        for s, e, copies, first in parts:
            for rank in range(s, e):
                load[first + (rank - s) // copies] += u
    assert n and (load == 256).all()
