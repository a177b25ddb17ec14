"""Driver queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridtally.llm import bpe, decontaminate, embeddings, htmltext, lm, minhash, packing, periodic, quality, resample, toxicity, urlfilter, warc
from gridtally.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return wrap


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def shingle_sql(table_name: str, key: str, width: int) -> str:
    """CTE body (key, ws, sh): words and distinct ``width``-word shingles; a shorter text is one shingle."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
        SELECT {key}, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i : i + {width - 1}], ' '))) END AS sh
        FROM (SELECT {key}, {words} AS ws FROM {table_name})"""


def near_duplicate_sql(source: str, width: int) -> str:
    """CTEs ending in near(doc_id, n_shingles, component_id, kept) over the table ``source``."""
    return f"""
        s AS ({shingle_sql(source, "doc_id", width)}),
        e AS (SELECT doc_id, unnest(sh) AS g FROM s),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.sh) + len(y.sh) - n)),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
        near AS (SELECT doc_id, len(sh) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
            FROM s LEFT JOIN c ON a = doc_id)"""


def contaminated_sql(source: str) -> str:
    """CTEs ending in hit(doc_id, item_id, item_shingles, shared_shingles) over the table ``source``."""
    return f"""
        bs AS ({shingle_sql("benchmark", "item_id", 5)}),
        ds AS ({shingle_sql(source, "doc_id", 5)}),
        be AS (SELECT item_id, len(sh) AS q, unnest(sh) AS g FROM bs),
        de AS (SELECT doc_id, unnest(sh) AS g FROM ds),
        hit AS (SELECT doc_id, item_id, q AS item_shingles, count(*) AS shared_shingles FROM be JOIN de USING (g) GROUP BY 1, 2, 3 HAVING 100 * count(*) >= 80 * q)"""


@query("op2_benchmark_decontamination", f"WITH {contaminated_sql('documents')} SELECT * FROM hit")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""


@query("op3_embedding_near_dedup", EMBEDDING_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


#: On these pages the article element holds the main text; its tags and the two references that occur are undone.
HTML_SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""


@query("op5_html_extraction", HTML_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


#: (host, path, verdict) of the rules that the query applies.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URL_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS i
    FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE i = 1"""


@query("op6_url_filters", URL_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


@query("op7_warc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"), min_bytes=0)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


@query("op9_minhash_near_dedup", f"WITH RECURSIVE {near_duplicate_sql('documents', 2)} SELECT * FROM near")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def resampled_sql() -> str:
    """The draw in SQL; crc32 is folded over the bytes of each distinct n-gram with a table made bit by bit."""
    def words(name: str) -> str:
        lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {name}"

    grams = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
    return f"""
WITH RECURSIVE bits AS (SELECT n, n AS v, 0 AS i FROM range(256) t(n)
    UNION ALL SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(v ORDER BY n) AS tab FROM bits WHERE i = 8),
d AS (SELECT doc_id, {words("documents")}), b AS (SELECT {words("benchmark")}),
dg AS (SELECT doc_id, unnest({grams}) AS g FROM d), bg AS (SELECT unnest({grams}) AS g FROM b),
k AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM dg UNION SELECT g FROM bg)),
u AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i : i + 1])::BIGINT)),
    lambda c, y: xor(c // 256, tab[1 + (xor(c, y) & 255)])), 4294967295) % 10000 AS bucket FROM k, crc),
s AS (SELECT bucket, count(*) AS n FROM dg JOIN u USING (g) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bg JOIN u USING (g) GROUP BY bucket),
gain AS (SELECT r.b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g
    FROM range(10000) r(b) LEFT JOIN s ON s.bucket = r.b LEFT JOIN t ON t.bucket = r.b),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain.g)::BIGINT AS weight FROM dg JOIN u USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS i, count(*) OVER () AS of FROM e WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN i <= of * 5 // 100 THEN i END AS rank FROM e LEFT JOIN o USING (doc_id)"""


@query("op11_importance_resampling", resampled_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))
