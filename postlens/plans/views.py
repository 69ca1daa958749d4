"""Derived views: the given tables mapped onto our schemas.

Each text runs unchanged in Spark SQL and in DuckDB, so a check reads the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

VIEWS = {
    "v_crawl": """
SELECT page_id, url, html,
  lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host,
  page_id % 5 AS page_no, page_id % 40 AS company_id
FROM pages""",
    "v_companies": """
SELECT c_custkey AS company_id, c_name AS name, c_acctbal AS weight,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'greenhouse' WHEN 'BUILDING' THEN 'lever'
    WHEN 'MACHINERY' THEN 'workday' WHEN 'AUTOMOBILE' THEN 'generic_html' ELSE 'unknown' END AS ats_type,
  c_custkey % 11 <> 0 AS is_active,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
    ELSE TIMESTAMP '2024-01-31 00:00:00' + (c_custkey % 13 - 6) * INTERVAL 1 HOUR END AS next_scan_at,
  concat('site', CAST(c_nationkey AS STRING), '.example.com') AS website
FROM customer""",
    "v_runs": f"""
SELECT event_id AS run_id, user_id AS company_id, ts AS started_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status,
  CASE {_K} % 6 WHEN 0 THEN 'api' WHEN 1 THEN 'embedded_json' WHEN 2 THEN 'css_selector'
    WHEN 3 THEN 'xpath' WHEN 4 THEN 'llm' ELSE NULL END AS extraction_tier,
  {_K} AS jobs_found, {_K} % 7 AS jobs_new, {_K} - {_K} % 7 AS jobs_duplicate,
  CAST(floor(value * 100) AS INT) AS total_ms,
  CASE WHEN {_K} % 6 = 4 THEN 1 ELSE 0 END AS llm_calls,
  CASE WHEN {_K} % 6 = 4 THEN CAST(floor(value) AS INT) ELSE 0 END AS llm_cost_e4
FROM events""",
    "v_attempts": f"""
SELECT event_id AS attempt_id, concat('site', CAST(user_id % 25 AS STRING), '.example.com') AS website, ts,
  event_type <> 'error' AS ok, {_K} AS confidence_pct
FROM events""",
    "v_postings": """
SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq,
  l_suppkey AS company_id,
  concat(CASE l_partkey % 9 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Staff '
    WHEN 3 THEN 'Principal ' WHEN 4 THEN 'Lead ' WHEN 5 THEN 'Director of ' WHEN 6 THEN 'Associate ' ELSE '' END,
    p_name, CASE l_partkey % 4 WHEN 0 THEN ' Engineer' WHEN 1 THEN ' Analyst' WHEN 2 THEN ' Engineer 4' ELSE ' Developer (m/f/d)' END) AS title,
  concat('https://Board', CAST(l_suppkey AS STRING), '.example.com/jobs/', CAST(l_partkey AS STRING),
    CASE l_linenumber % 3 WHEN 0 THEN '?utm_source=li&b=2&a=1' WHEN 1 THEN '?a=1&b=2#apply' ELSE '/?gh_src=x' END) AS url,
  CASE l_linenumber % 6 WHEN 0 THEN 'Remote - US' WHEN 1 THEN concat(n_name, ', CA, USA')
    WHEN 2 THEN concat('Hybrid, ', n_name) WHEN 3 THEN concat(n_name, ', Germany')
    WHEN 4 THEN 'Multiple Locations' ELSE NULL END AS location,
  CASE l_partkey % 5 WHEN 0 THEN concat('$', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), ' per year')
    WHEN 1 THEN '$60/hour' WHEN 2 THEN 'USD 150000 to 120000' WHEN 3 THEN 'Competitive' ELSE NULL END AS salary,
  CASE l_linenumber % 4 WHEN 0 THEN 'Posted 3 Days Ago' WHEN 1 THEN 'Yesterday'
    WHEN 2 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) ELSE '1753000000000' END AS posted_at,
  CASE WHEN l_partkey % 3 = 0 THEN concat('R-', CAST(l_partkey AS STRING)) ELSE NULL END AS external_id,
  CASE l_returnflag WHEN 'R' THEN 'We want 7+ years of experience in Python and AWS.'
    WHEN 'A' THEN '3+ years of Django; founded 12 years ago.' ELSE NULL END AS description,
  l_shipdate AS seen_at
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey""",
    "v_notifications": """
SELECT o_orderkey AS notification_id, o_orderkey AS job_id, o_custkey % 50 AS user_id,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'email' WHEN '2' THEN 'resend' WHEN '3' THEN 'slack' ELSE 'telegram' END AS channel,
  CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status,
  CAST(o_custkey % 5 AS INT) AS attempts, o_orderdate AS created_at
FROM orders""",
    "v_selectors": """
SELECT concat('site', CAST(s_nationkey AS STRING), '.example.com') AS website,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS version,
  s_suppkey % 3 = 0 AS is_active, round(s_acctbal / 10000, 4) AS confidence
FROM supplier""",
    "v_site_selectors": """
SELECT website, version, version = 2 AS is_active, CASE WHEN kind IN (1, 3, 5) THEN 'xpath' ELSE 'css' END AS strategy,
  CASE WHEN version <> 2 AND kind IN (1, 3, 5) THEN '//none' WHEN version <> 2 THEN 'div.none' WHEN kind = 0 THEN 'nav li' WHEN kind = 1 THEN '//nav//li' WHEN kind = 2 THEN 'nav > ul > li'
    WHEN kind = 3 THEN '//nav/ul/li[2]' WHEN kind = 4 THEN 'li[[[broken' WHEN kind = 5 THEN '//a[contains(@href, ''a'')]'
    ELSE 'article, li:first-child' END AS container,
  CASE kind WHEN 2 THEN 'self' WHEN 5 THEN '.' WHEN 6 THEN 'h1, a:first-child' WHEN 1 THEN './/a' WHEN 3 THEN './a' ELSE 'h3 a, a' END AS title,
  CASE kind WHEN 0 THEN 'a' WHEN 1 THEN './/a/@href' WHEN 5 THEN './@href' ELSE NULL END AS url,
  CASE kind WHEN 0 THEN 'span.place, [data-place]' WHEN 1 THEN 'span::before' ELSE NULL END AS location,
  CAST(NULL AS STRING) AS description, CAST(NULL AS STRING) AS department, CAST(NULL AS STRING) AS posted_at
FROM (SELECT host AS website, length(host) % 7 AS kind, version FROM
  (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages) AS h
  CROSS JOIN (SELECT DISTINCT CAST(r_regionkey AS INT) + 1 AS version FROM region WHERE r_regionkey < 3) AS v) AS s""",
    "v_profiles": """
SELECT * FROM (VALUES
  (1, 'mid',    1, 'any',         true,  0.6),
  (2, 'junior', 1, 'remote_only', true,  0.5),
  (3, 'senior', 0, 'any',         false, 0.75)) AS t(profile_id, seniority, max_gap, remote_preference, include_unknown, threshold)""",
}


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view (or a given table) over the parquet files in ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables(spark, sf_dir)
    return spark.sql(VIEWS[name])


def with_views(*names: str) -> str:
    """``WITH`` clause (no trailing comma) that inlines views into a check query."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
