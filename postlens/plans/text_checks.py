"""Text, URL, date, location, salary and field columns over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.functions import dates, fields, fixed_values as V, labels, location, plausibility, salary
from postlens.functions import text as T, urls
from postlens.functions.hashing import content_hash_of
from postlens.operators.postings import skill_token_join
from postlens.plans import sql as S
from postlens.plans.sources import CAPTURE_DAY, raw_postings, spread
from postlens.plans.views import view, with_views
from postlens.session import prepare

col = F.col
TODAY = F.lit
DAY = f"DATE '{CAPTURE_DAY}'"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(view(prepare(spark), sf, "documents"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(view(prepare(spark), sf, "pages"))


def _today():
    return F.lit(CAPTURE_DAY).cast("date")


def clean_text(spark, sf):
    return _documents(spark, sf).select("doc_id", T.clean_text(col("text")).alias("cleaned"))


def strip_html(spark, sf):
    return _pages(spark, sf).select("page_id", F.md5(T.strip_html(col("html"))).alias("text_md5"))


def normalize_key(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(T.normalize_key(col("text"))).alias("key_md5"))


WORDS = ("the", "of the", "Ünion", "data", "not a phrase here")


def find_keywords(spark, sf):
    words = F.array(*[F.lit(w) for w in WORDS])
    return _documents(spark, sf).select(
        "doc_id",
        T.contains_keyword(col("text"), F.lit("the")).alias("has_the"),
        F.array_join(T.find_keywords(col("text"), words), "|").alias("found"),
    )


def truncate(spark, sf):
    return _documents(spark, sf).select("doc_id", T.truncate(col("text"), 80).alias("short"))


def registrable_domain(spark, sf):
    return _pages(spark, sf).select("page_id", urls.registrable_domain(col("url")).alias("domain"))


def canonicalize_url(spark, sf):
    pages = _pages(spark, sf).select("page_id", urls.canonicalize_url(col("url")).alias("canonical"))
    links = raw_postings(spark, sf).select(
        col("seq").alias("page_id"), urls.canonicalize_url(col("url")).alias("canonical")
    )
    return pages.unionByName(links)


def same_site(spark, sf):
    return _pages(spark, sf).select(
        "page_id",
        urls.same_site(col("url"), F.lit("https://www.example.org/jobs")).alias("same"),
    )


def absolutize(spark, sf):
    """Every link of every page, resolved against the page it stands on."""
    hrefs = F.regexp_extract_all(col("html"), F.lit('<a href="([^"]*)"'), F.lit(1))
    links = _pages(spark, sf).select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    return links.select("page_id", "pos", urls.absolutize(col("href"), col("url")).alias("link"))


def parse_posted_date(spark, sf):
    return raw_postings(spark, sf).select(
        "seq", "posted_at", dates.parse_posted_date(col("posted_at"), _today()).alias("posted_date")
    )


def parse_posted_datetime(spark, sf):
    now = F.lit("2026-07-30 00:00:00").cast("timestamp")
    stamped = F.concat(F.date_format("seen_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return raw_postings(spark, sf).select(
        "seq",
        dates.parse_posted_datetime(col("posted_at"), now).cast("timestamp_ntz").alias("from_text"),
        dates.parse_posted_datetime(stamped, now).cast("timestamp_ntz").alias("from_stamp"),
    )


def days_since(spark, sf):
    return raw_postings(spark, sf).select(
        "seq", dates.days_since(F.to_date("seen_at"), _today()).alias("days")
    )


def humanize_age(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    runs = view(prepare(spark), sf, "v_runs")
    moment = F.when(col("run_id") % 3 != 0, col("started_at").cast("timestamp"))
    day = F.when(col("run_id") % 5 != 0, F.to_date("started_at"))
    return runs.select("run_id", dates.humanize_age(moment, day, now).alias("age"))


def parse_location(spark, sf):
    place = location.parse_location(col("location"))
    return (
        raw_postings(spark, sf).withColumn("location", T.clean_text(col("location")))
        .select("seq", place.alias("p"))
        .select(
            "seq", col("p.city").alias("location_city"), col("p.region").alias("location_region"),
            col("p.country").alias("location_country"), col("p.remote_type").alias("remote_type"),
            location.has_geography(col("p")).alias("has_geography"),
        )
    )


PREFERRED = ("NATION_3", "United States", "Remote")


def location_preferences(spark, sf):
    wanted = F.array(*[F.lit(p) for p in PREFERRED])
    rows = raw_postings(spark, sf).withColumn("location", T.clean_text(col("location"))).select(
        "seq", location.parse_location(col("location")).alias("p")
    )
    return rows.select(
        "seq",
        location.matches_preferred(col("p"), wanted).alias("matches"),
        location.location_is_acceptable(col("p"), wanted, F.lit(True)).alias("acceptable"),
        location.location_is_acceptable(col("p"), wanted, F.lit(False)).alias("acceptable_strict"),
    )


def parse_salary(spark, sf):
    rows = raw_postings(spark, sf).withColumn("salary", T.clean_text(col("salary"))).select(
        "seq", salary.parse_salary(col("salary")).alias("s")
    )
    return rows.select(
        "seq", col("s.minimum").alias("salary_min"), col("s.maximum").alias("salary_max"),
        col("s.currency").alias("salary_currency"), col("s.period").alias("salary_period"),
        salary.to_annual(col("s.minimum"), col("s.period")).alias("annual"),
    )


def parse_employment_type(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", fields.parse_employment_type(col("source"), col("text")).alias("employment_type")
    )


def parse_seniority(spark, sf):
    return raw_postings(spark, sf).select(
        "seq", fields.parse_seniority(col("title"), col("description")).alias("seniority")
    )


def parse_years_required(spark, sf):
    counted = F.concat(
        (col("l_linenumber") + 1).cast("string"), F.lit("+ years; "), (col("l_orderkey") % 60).cast("string"),
        F.when(col("l_linenumber") % 2 == 0, F.lit(" years of hands on experience"))
        .otherwise(F.lit(" years ago we began")),
    )
    lines = spread(view(prepare(spark), sf, "lineitem"))
    return lines.select(
        "l_orderkey", "l_linenumber", fields.parse_years_required(counted).alias("years")
    ).withColumn("level", fields.seniority_from_years(col("years"))).withColumns({
        "level_rank": fields.seniority_rank(col("level")),
        "gap": fields.years_gap(col("years"), F.lit(4)),
    })


def detect_skills(spark, sf):
    return raw_postings(spark, sf).select(
        "seq", F.array_join(fields.detect_skills(col("title"), col("description")), "|").alias("skills")
    )


def skill_tokens(spark, sf):
    texts = _documents(spark, sf).select("doc_id", "text")
    talks = view(prepare(spark), sf, "conversations").select(
        (col("conv_id") * 1000 + col("turn") + 1_000_000_000).alias("doc_id"), "text"
    )
    found = skill_token_join(texts.unionByName(talks), "doc_id", "text")
    return found.select("doc_id", F.array_join("skills", "|").alias("skills"))


def content_hash(spark, sf):
    return raw_postings(spark, sf).select(
        "seq",
        content_hash_of(
            col("company_id"), col("title"), col("location"), col("url"), col("external_id")
        ).alias("content_hash"),
    )


def looks_like_title(spark, sf):
    docs = _documents(spark, sf).select(
        col("doc_id").alias("id"), plausibility.looks_like_title(col("text")).alias("plausible")
    )
    posts = raw_postings(spark, sf).select(
        col("seq").alias("id"), plausibility.looks_like_title(col("title")).alias("plausible")
    )
    return docs.unionByName(posts)


def page_flags(spark, sf):
    return _pages(spark, sf).select(
        "page_id", plausibility.looks_like_spa(col("html")).alias("spa"),
        plausibility.looks_blocked(col("html")).alias("blocked"),
        plausibility.text_volume(col("html")).alias("volume"),
    )


def infer_name(spark, sf):
    return _pages(spark, sf).select("page_id", urls.infer_name(col("url")).alias("name"))


def label_fields(spark, sf):
    rows = view(prepare(spark), sf, "v_selectors")
    return rows.select(
        "website", "version",
        labels.humanise(F.concat_ws("_", F.lit("full_time"), col("website"))).alias("label"),
        labels.score_percent(col("confidence")).alias("percent"),
        labels.score_class(col("confidence")).alias("css"),
    )


def enum_coerce(spark, sf):
    rows = view(prepare(spark), sf, "v_runs")
    known = ("running", "success", "partial", "failed", "skipped")
    return rows.select("run_id", labels.enum_coerce(col("status"), known, "status").alias("status"))


QUERIES = {
    "clean_text": clean_text, "strip_html": strip_html, "normalize_key": normalize_key,
    "find_keywords": find_keywords, "truncate": truncate,
    "registrable_domain": registrable_domain, "canonicalize_url": canonicalize_url,
    "same_site": same_site, "absolutize": absolutize,
    "parse_posted_date": parse_posted_date, "parse_posted_datetime": parse_posted_datetime,
    "days_since": days_since, "humanize_age": humanize_age, "parse_location": parse_location,
    "location_preferences": location_preferences, "parse_salary": parse_salary,
    "parse_employment_type": parse_employment_type, "parse_seniority": parse_seniority,
    "parse_years_required": parse_years_required, "detect_skills": detect_skills,
    "skill_token_join": skill_tokens, "content_hash": content_hash,
    "looks_like_title": looks_like_title, "page_flags": page_flags, "infer_name": infer_name,
    "label_fields": label_fields, "enum_coerce": enum_coerce,
}


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S.BLANKS}', ' ', 'g'))"


def _marks(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {S.text(w)})" for w in words) + ")"


def _unescape(x: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {S.text(entity)}, {S.text(char)})"
    return x


def _sql() -> dict[str, str]:
    v = with_views
    title_key = _flat("lower(x)")
    geo = "(location_city IS NOT NULL OR location_region IS NOT NULL OR location_country IS NOT NULL)"
    hay = ("[location, location_city, location_region, location_country]")
    place_hit = (
        f"len(list_filter(list_transform({hay}, lambda h: {S.key('h')}), "
        "lambda h: contains(h, 'nation 3') OR contains(h, 'united states'))) > 0"
    )
    plausible = (
        f"length({title_key}) BETWEEN 3 AND 160 AND NOT {_marks(title_key, V.CHROME_PHRASES)} "
        f"AND ({_marks(title_key, V.ROLE_WORDS)} OR contains({title_key}, ' '))"
    )
    lines = r"list_filter(list_transform(string_split(body, chr(10)), lambda l: " + _flat("l") + "), lambda l: l <> '')"
    volume = "(length(html) - 12 * (length(html) - length(replace(html, '<', ''))))"
    counted = (
        "(CAST(l_linenumber + 1 AS VARCHAR) || '+ years; ' || CAST(l_orderkey % 60 AS VARCHAR) || "
        "CASE WHEN l_linenumber % 2 = 0 THEN ' years of hands on experience' ELSE ' years ago we began' END)"
    )
    words = " , ".join(
        f"CASE WHEN contains(' ' || k || ' ', ' ' || {S.key(S.text(w))} || ' ') THEN {S.text(w)} END" for w in WORDS
    )
    ref = "TIMESTAMP '2024-01-31 00:00:00'"
    n = S.title_level
    return {
        "clean_text": f"SELECT doc_id, {_flat('nfkc_text')} AS cleaned FROM (SELECT doc_id, {_unescape('text')} AS nfkc_text FROM documents)",
        "strip_html": f"""SELECT page_id, md5(array_to_string({lines}, chr(10))) AS text_md5 FROM (
            SELECT page_id, regexp_replace(regexp_replace({_unescape('html')}, '(?i)</(p|div|li|br|tr|h[1-6])\\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS body FROM pages)""",
        "normalize_key": f"SELECT doc_id, md5({S.key('text')}) AS key_md5 FROM documents",
        "find_keywords": f"""SELECT doc_id, contains(' ' || k || ' ', ' the ') AS has_the,
            array_to_string(list_filter([{words}], lambda w: w IS NOT NULL), '|') AS found
            FROM (SELECT doc_id, {S.key('text')} AS k FROM documents)""",
        "truncate": f"""SELECT doc_id, CASE WHEN length(text) > 80 THEN regexp_replace(substring(text, 1, 79), '{S.BLANKS}$', '') || '…' ELSE text END AS short FROM documents""",
        "registrable_domain": f"SELECT page_id, {S.domain('url')} AS domain FROM pages",
        "canonicalize_url": f"""{v('v_postings')} SELECT page_id, {S.canonical('url')} AS canonical FROM pages
            UNION ALL SELECT seq AS page_id, {S.canonical('url')} AS canonical FROM v_postings""",
        "same_site": f"SELECT page_id, {S.domain('url')} = 'example.org' AS same FROM pages",
        "absolutize": r"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, CASE WHEN h = '' OR regexp_matches(h, '^(#|javascript:|mailto:|tel:)') THEN NULL
              WHEN regexp_matches(h, '^[a-z]+:') THEN h ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h END AS link
            FROM (SELECT page_id, url, trim(unnest(hs)) AS h, generate_subscripts(hs, 1) AS pos
                  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages))""",
        "parse_posted_date": f"{v('v_postings')} SELECT seq, posted_at, {S.posted_date('posted_at', DAY)} AS posted_date FROM v_postings",
        "parse_posted_datetime": f"""{v('v_postings')} SELECT seq,
            CASE WHEN regexp_matches(posted_at, '^\\d{{13}}$') THEN make_timestamp(CAST(posted_at AS BIGINT) * 1000) END AS from_text,
            date_trunc('second', seen_at) - INTERVAL 2 HOUR AS from_stamp FROM v_postings""",
        "days_since": f"{v('v_postings')} SELECT seq, CAST({DAY} - CAST(seen_at AS DATE) AS INTEGER) AS days FROM v_postings",
        "humanize_age": f"""{v('v_runs')}, m AS (SELECT run_id, CASE WHEN run_id % 3 <> 0 THEN started_at END AS mo,
              CASE WHEN run_id % 5 <> 0 THEN CAST(started_at AS DATE) END AS d FROM v_runs),
            a AS (SELECT run_id, epoch_us({ref}) - epoch_us(mo) AS us, CAST(CAST({ref} AS DATE) - coalesce(CAST(mo AS DATE), d) AS BIGINT) AS days FROM m)
            SELECT run_id, CASE WHEN us < 120000000 THEN 'just now'
              WHEN us < 3600000000 THEN CAST(us // 60000000 AS VARCHAR) || ' minutes ago'
              WHEN us < 86400000000 THEN CASE WHEN us // 3600000000 = 1 THEN '1 hour ago' ELSE CAST(us // 3600000000 AS VARCHAR) || ' hours ago' END
              WHEN days IS NULL THEN '—' WHEN days < 0 THEN 'just now' WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday'
              WHEN days < 7 THEN CAST(days AS VARCHAR) || ' days ago'
              WHEN days < 30 THEN CASE WHEN days // 7 = 1 THEN '1 week ago' ELSE CAST(days // 7 AS VARCHAR) || ' weeks ago' END
              ELSE CASE WHEN days // 30 = 1 THEN '1 month ago' ELSE CAST(days // 30 AS VARCHAR) || ' months ago' END END AS age FROM a""",
        "parse_location": f"""{v('v_postings')}, {S.location_ctes('v_postings', 'location', 'placed')}
            SELECT seq, location_city, location_region, location_country, remote_type, {geo} AS has_geography FROM placed""",
        "location_preferences": f"""{v('v_postings')}, {S.location_ctes('v_postings', 'location', 'placed')},
            h AS (SELECT *, {place_hit} AS hit, {geo} AS geo,
              {place_hit.replace("contains(h, 'nation 3')", "contains(h, 'nation 3') OR contains(h, 'remote')")} AS any_hit FROM placed)
            SELECT seq, any_hit AS matches,
              CASE WHEN hit THEN true WHEN remote_type = 'remote' THEN NOT geo WHEN location IS NULL THEN true ELSE false END AS acceptable,
              CASE WHEN hit THEN true WHEN remote_type = 'remote' THEN NOT geo WHEN location IS NULL THEN false ELSE false END AS acceptable_strict FROM h""",
        "parse_salary": f"""{v('v_postings')}, {S.salary_ctes('v_postings', 'salary', 'paid')}
            SELECT seq, salary_min, salary_max, salary_currency, salary_period,
              CAST(salary_min AS BIGINT) * CASE salary_period WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'day' THEN 260 WHEN 'hour' THEN 2080 END AS annual FROM paid""",
        "parse_employment_type": f"""SELECT doc_id, {S.ladder(f"(' ' || k || ' ')", V.EMPLOYMENT_WORDS, 'unknown')} AS employment_type
            FROM (SELECT doc_id, {S.key("concat_ws(' ', source, text)")} AS k FROM documents)""",
        "parse_seniority": f"{v('v_postings')} SELECT seq, {S.seniority('title', 'description')} AS seniority FROM v_postings",
        "parse_years_required": f"""WITH y AS (SELECT l_orderkey, l_linenumber, {S.years(counted)} AS years FROM lineitem),
            z AS (SELECT *, {S.level_of_years('years')} AS level FROM y)
            SELECT l_orderkey, l_linenumber, years, level, {S.case_of('level', V.SENIORITY_RANK)} AS level_rank, greatest(0, years - 4) AS gap FROM z""",
        "detect_skills": f"""{v('v_postings')} SELECT seq, array_to_string({S.skills("concat_ws(' ', title, description)")}, '|') AS skills FROM v_postings""",
        "skill_token_join": f"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL
              SELECT conv_id * 1000 + turn + 1000000000, text FROM conversations),
            s AS (SELECT doc_id, array_to_string({S.skills('text')}, '|') AS skills FROM t) SELECT doc_id, skills FROM s WHERE skills <> ''""",
        "content_hash": f"{S.posting_ctes()} SELECT seq, content_hash FROM postings",
        "looks_like_title": f"""{v('v_postings')} SELECT id, {plausible} AS plausible FROM (SELECT doc_id AS id, text AS x FROM documents
            UNION ALL SELECT seq AS id, title AS x FROM v_postings)""",
        "page_flags": f"""SELECT page_id, {_marks('lower(html)', V.SPA_MARKERS)} AND {volume} < 2000 AS spa,
            {_marks('lower(html)', V.BLOCK_MARKERS)} OR ({_marks('lower(html)', V.WEAK_BLOCK_MARKERS)} AND {volume} < 2000) AS blocked,
            CAST({volume} AS INTEGER) AS volume FROM pages""",
        "infer_name": f"""SELECT page_id, array_to_string(list_transform(string_split(replace(regexp_extract(regexp_replace({S.host('url')}, '^www\\.', ''), '^([^.]+)', 1), '-', ' '), ' '),
            lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM pages""",
        "label_fields": f"""{v('v_selectors')} SELECT website, version,
            'Full Time Site' || regexp_extract(website, '([0-9]+)', 1) || '.Example.Com' AS label,
            CAST(floor(confidence * 100) AS INTEGER) AS percent, CASE WHEN confidence >= 0.75 THEN 'score' ELSE 'score mid' END AS css FROM v_selectors""",
        "enum_coerce": f"{v('v_runs')} SELECT run_id, status FROM v_runs",
    }


SQL = _sql()
