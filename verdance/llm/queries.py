"""The queries of this subpackage and, where SQL can express one, its equivalent for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score_documents

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, _table(spark, sf_dir, "labels")))


#: (verdict, host and path)
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every page that was reached through a feed. Any variant of a listed URL is blocked."""
    from .urls import judge

    pages = _table(spark, sf_dir, "pages")
    return judge(pages, pages.select("url").where("url LIKE '%utm_source=feed%'"), RULES)


OP2_SQL = r"""
WITH seen AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
canon AS (
  SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') END AS canonical
  FROM seen),
known AS (SELECT DISTINCT canonical AS c FROM canon WHERE url LIKE '%utm_source=feed%' AND canonical IS NOT NULL),
rules(verdict, rule, h, p) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
listed AS (SELECT canon.*, known.c IS NOT NULL AS listed FROM canon LEFT JOIN known ON canon.canonical = known.c),
fit AS (
  SELECT l.page_id, l.host, l.path, l.canonical, l.listed, r.rule, r.verdict
  FROM listed l LEFT JOIN LATERAL (
    SELECT rule, verdict FROM rules
    WHERE (l.host = h OR ends_with(l.host, '.' || h)) AND starts_with(l.path, p)
    ORDER BY length(rule) DESC LIMIT 1) r ON true)
SELECT page_id, host, path, canonical, rule, listed, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict_documents

    docs = _table(spark, sf_dir, "documents")
    return predict_documents(docs, fit(docs))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import span_digests

    return span_digests(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, k, s FROM (
  SELECT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0)),
ds AS (SELECT DISTINCT r, doc_id, k, s FROM (
  SELECT r, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / CAST(n AS DOUBLE) AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
GROUP BY r, doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import deletions

    return deletions(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(text, '[ \t\r\f\x0B\x{A0}]+', ' ', 'g'), chr(10)) AS a FROM documents),
u AS (SELECT r, doc_id, unnest(list_transform(a, lambda x: trim(x, ' '))) AS l, unnest(range(0, len(a))) AS i FROM t),
v AS (SELECT *, len(l) - len(replace(l, ' ', '')) + 1 AS w FROM u WHERE l <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY r ORDER BY i) AS upto FROM v),
ends AS (
  SELECT s.r, s.i AS first, min(e.i) AS last FROM c s JOIN c e ON s.r = e.r AND e.i >= s.i AND e.upto - s.upto + s.w >= 50 GROUP BY s.r, s.i
  UNION
  SELECT e.r, max(s.i) AS first, e.i AS last FROM c s JOIN c e ON s.r = e.r AND e.i >= s.i AND e.upto - s.upto + s.w >= 50 GROUP BY e.r, e.i),
win AS (SELECT n.r, c.doc_id, n.first, n.last, string_agg(c.l, chr(10) ORDER BY c.i) AS content FROM ends n JOIN c ON c.r = n.r AND c.i BETWEEN n.first AND n.last GROUP BY n.r, c.doc_id, n.first, n.last),
later AS (SELECT r, first, last FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(first, last + 1)) AS i FROM later),
islands AS (SELECT r, min(i) AS a, max(i) AS b FROM (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS g FROM gone) GROUP BY r, g),
per AS (SELECT r, sum(b - a + 1) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS deleted FROM islands GROUP BY r)
SELECT t.doc_id, CAST(len(t.a) AS BIGINT) AS n_lines, CAST(coalesce(per.n, 0) AS BIGINT) AS n_deleted, coalesce(per.deleted, '') AS deleted
FROM t LEFT JOIN per USING (r)
"""


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS ns FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (ns + 2 * v) AS BIGINT) AS p, CAST(1 + 1000000000 * (total + 2) // (nl + 2 * v) AS BIGINT) AS q
  FROM s JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    return mine(_table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS k FROM s WHERE alike),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history: the documents up to the middle of the ids."""
    from .exactdup import deduplicate

    docs = _table(spark, sf_dir, "documents")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).collect()[0]
    return deduplicate(docs, F.col("doc_id") <= F.lit(None if lo is None else lo + (hi - lo) // 2))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, min(doc_id) OVER () AS lo, max(doc_id) OVER () AS hi FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256,
       coalesce(bool_or(doc_id <= lo + (hi - lo) // 2) OVER (PARTITION BY text_sha256), false) AS member
FROM r
"""


QUERIES = {"op1_quality": op1_quality, "op2_urls": op2_urls, "op3_language": op3_language, "op4_neardup": op4_neardup, "op5_secrets": op5_secrets, "op6_media": op6_media, "op7_bpe": op7_bpe, "op8_warc": op8_warc, "op9_decontamination": op9_decontamination, "op10_lines": op10_lines, "op11_divergence": op11_divergence, "op12_negatives": op12_negatives, "op13_exact": op13_exact}
ORACLES: dict[str, str] = {"op2_urls": OP2_SQL, "op9_decontamination": OP9_SQL, "op10_lines": OP10_SQL, "op11_divergence": OP11_SQL, "op12_negatives": OP12_SQL, "op13_exact": OP13_SQL}
