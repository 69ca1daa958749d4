"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from postlens.llm import (
    bpe, decontaminate, jaccard, personal, quality, search, shards, spelling, suffixes, topk, toxicity, urls, warc,
)
from postlens.llm.common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encoded(table(spark, sf_dir, "documents"), path, ["doc_id"], ids=False)


def op5_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_sharding(spark, sf_dir):
    return shards.assign(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark, sf_dir):
    return jaccard.similar_sets(table(spark, sf_dir, "documents"), 3, 90, 100)


def op9_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark, sf_dir):
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_pii(spark, sf_dir):
    return personal.digests(table(spark, sf_dir, "documents"))


def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_exact_topk, op3_decontamination, op4_bpe, op5_warc, op6_url_filter, op7_sharding,
    op8_ngram_jaccard, op9_quality, op10_suffix_dedup, op11_lexical_search, op12_pii, op13_spelling,
)}

TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), m AS (SELECT html, max(page_id) AS stored FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM p JOIN m ON p.html = m.html
"""

SPANS = """
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS s FROM t)),
d AS (SELECT doc_id, s FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM d),
k AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS b FROM k GROUP BY ALL),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
e AS (
  SELECT t.doc_id, any_value(n) AS n, any_value(h) AS h, coalesce(sum(b - a), 0) AS removed, count(a) AS spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM t LEFT JOIN c ON c.doc_id = t.doc_id GROUP BY t.doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, removed::BIGINT AS n_removed, spans::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM e
"""

SQL = {
    "op2_exact_topk": TOP_K,
    "op3_decontamination": decontaminate.SQL,
    "op5_warc": WARC,
    "op6_url_filter": urls.SQL,
    "op8_ngram_jaccard": jaccard.sql(3, 90, 100),
    "op10_suffix_dedup": SPANS,
    "op11_lexical_search": search.SQL,
    "op12_pii": personal.SQL,
    "op13_spelling": spelling.SQL,
}

__all__ = ["QUERIES", "SQL"]
