"""Board payloads and embedded JSON made from the derived postings, then read back.

Each payload holds the postings of one (company, order); none is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.plans.sources import raw_postings, spread
from postlens.plans.views import view, with_views
from postlens.session import prepare
from postlens.sources import boards as B, embedded as E, intake

col = F.col


def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return raw_postings(spark, sf).withColumn("order_no", F.floor(col("seq") / 1_000_000))


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    """``_numbered`` brought together by (company, order), moved once for all payloads made of it.

    Whole rows are collected, so that every platform reads the same shuffle; grouping them again by
    the same keys moves nothing.
    """
    rows = _numbered(spark, sf)
    whole = F.collect_list(F.struct(*[c for c in rows.columns if c not in ("company_id", "order_no")]))
    return rows.groupBy("company_id", "order_no").agg(whole.alias("rows")).select("company_id", "order_no", F.inline("rows"))


def _payloads(
    spark: SparkSession, sf: str, platform: str, entry, root: str | None, rows: DataFrame | None = None
) -> DataFrame:
    rows = _numbered(spark, sf) if rows is None else rows
    grouped = rows.groupBy("company_id", "order_no").agg(F.sort_array(F.collect_list(F.struct("seq", entry.alias("e")))).alias("es"))
    items = F.transform("es", lambda x: x["e"])
    body = F.to_json(F.struct(items.alias(root))) if root else F.to_json(items)
    return grouped.select(
        "company_id", F.lit(platform).alias("platform"), F.lit(0).alias("page_no"), body.alias("body"),
        F.concat(F.lit("https://board"), "company_id", F.lit(".example.com/en/list?x=1")).alias("base_url"),
        F.concat(F.lit("t"), "company_id").alias("token"), F.lit("2026-07-30 00:00:00").cast("timestamp").alias("fetched_at"),
    )


def _named(name: str):
    return F.struct(col(name).alias("name"))


ESCAPED = "concat('&lt;p&gt;', description, '&lt;/p&gt;&lt;p&gt;R&amp;amp;D&lt;/p&gt;')"

ENTRIES = {
    "greenhouse": ("jobs", lambda: F.struct(
        col("seq").alias("id"), "title", col("url").alias("absolute_url"), _named("location").alias("location"),
        col("posted_at").alias("updated_at"), F.expr(ESCAPED).alias("content"),
        F.array(F.struct(F.concat(F.lit("Team "), "company_id").alias("name"))).alias("departments"),
        F.array(F.struct(F.lit("Salary Range").alias("name"), col("salary").alias("value")),
                F.struct(F.lit("Employment Type").alias("name"), F.lit("Full-time").alias("value"))).alias("metadata"))),
    "lever": (None, lambda: F.struct(
        col("seq").cast("string").alias("id"), col("title").alias("text"), col("url").alias("hostedUrl"),
        F.struct("location", F.lit("Core").alias("team"), F.lit("Contract").alias("commitment")).alias("categories"),
        col("description").alias("descriptionPlain"),
        F.array(F.struct(F.lit("Benefits").alias("text"), F.lit("<li>Food</li>").alias("content")),
                F.struct(F.lit("Key Requirements").alias("text"), F.concat(F.lit("<li>"), "title", F.lit("</li><li>B</li>")).alias("content"))).alias("lists"),
        F.lit(1753000000000).alias("createdAt"), F.lit("remote").alias("workplaceType"),
        F.struct(F.lit(100).alias("min"), (col("company_id") + 200).alias("max"), F.lit("USD").alias("currency")).alias("salaryRange"))),
    "ashby": ("jobs", lambda: F.struct(
        col("seq").cast("string").alias("id"), "title", col("url").alias("jobUrl"),
        F.when(col("company_id") % 3 == 0, False).when(col("company_id") % 3 == 1, True).alias("isListed"),
        (col("company_id") % 2 == 0).alias("isRemote"), "location", col("description").alias("descriptionPlain"),
        F.struct(col("salary").alias("compensationTierSummary")).alias("compensation"),
        _null().alias("publishedAt"), col("posted_at").alias("updatedAt"))),
    "workday": ("jobPostings", lambda: F.struct(
        "title", F.concat(F.lit("job/x_R-"), "seq").alias("externalPath"), col("location").alias("locationsText"),
        col("posted_at").alias("postedOn"),
        F.when(col("company_id") % 2 == 0, F.array(F.concat(F.lit("Q"), "seq"))).alias("bulletFields"), F.lit("Full time").alias("timeType"))),
    "smartrecruiters": ("content", lambda: F.struct(
        col("seq").cast("string").alias("id"), col("title").alias("name"),
        F.when(col("company_id") % 2 == 0, col("url")).otherwise("ftp://x").alias("ref"),
        F.struct(col("location").alias("city"), F.lit("").alias("region"), F.lit("de").alias("country"), (col("company_id") % 2 == 1).alias("remote")).alias("location"),
        col("posted_at").alias("releasedDate"))),
    "eightfold": ("positions", lambda: F.struct(
        col("title").alias("name"), F.concat(F.lit("/careers/job/"), "seq").alias("positionUrl"), col("seq").alias("id"),
        F.array(col("location"), F.lit(" "), F.lit("B"), F.lit("C"), F.lit("D")).alias("locations"),
        F.lit("").alias("workLocationOption"), F.lit(" Onsite ").alias("locationFlexibility"), F.lit(1753000000).alias("postedTs"))),
    "uber": ("jobs", lambda: F.struct(
        col("title").alias("Title"), col("seq").alias("Id"),
        F.when(col("company_id") % 2 == 0, F.array(F.struct(F.lit("/a").alias("Url"), F.lit(False).alias("IsDefault")), F.struct(F.lit("/b").alias("Url"), F.lit(True).alias("IsDefault")))).alias("Urls"),
        F.array(F.struct(F.lit("").alias("Address"), col("location").alias("City"), F.lit("").alias("Region"), F.lit("US").alias("Country"))).alias("Locations"),
        col("description").alias("Description"), F.array(F.lit("Ops")).alias("Teams"), (col("company_id") % 2 == 0).alias("Remote"),
        F.struct(F.when(col("company_id") % 2 == 0, 10).alias("MinValue"), F.when(col("company_id") % 2 == 0, 20).alias("MaxValue"), F.lit("EUR").alias("Currency"), col("salary").alias("Description")).alias("Salary"),
        col("posted_at").alias("DisplayDate"))),
    "taleo": ("requisitionList", lambda: F.struct(
        "title", F.when(col("company_id") % 2 == 0, col("seq")).alias("contestNo"), (col("seq") + 1).alias("jobId"), "location", col("posted_at").alias("postedDate"))),
}


def _board(platform: str):
    root, entry = ENTRIES[platform]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        payloads = _payloads(spark, sf, platform, entry(), root)
        return B.source_for(platform, B.greenhouse_postings)(payloads).select(
            "company_id", *B.RAW_FIELDS
        )

    return query


def phenom_postings(spark, sf):
    """State object inside a page script, with braces and quotes in its texts."""
    entry = F.struct(
        F.concat("title", F.lit(" {}")).alias("title"), col("url").alias("applyUrl"), col("seq").alias("jobId"),
        col("location").alias("cityState"), F.concat(F.lit('a "}" b; '), F.coalesce("description", F.lit(""))).alias("descriptionTeaser"),
        col("posted_at").alias("postedDate"),
    )
    payloads = _payloads(spark, sf, "phenom", entry, "jobs")
    page = F.concat(
        F.lit("<html><script>var phApp = {}; phApp.ddo = {\"refineSearch\": {\"totalHits\": 9, \"data\": "), "body",
        F.lit("}}; phApp.x = {\"y\": 1};</script></html>"),
    )
    pages = payloads.withColumn("html", page).withColumn("body", E.inline_state_object(col("html")))
    return B.phenom_postings(pages).select("company_id", *B.RAW_FIELDS)


def _pages_of(spark, sf, entry, wrap) -> DataFrame:
    payloads = _payloads(spark, sf, "html", entry, None)
    return payloads.select(
        F.xxhash64("company_id", "body").alias("page_id"), col("base_url").alias("url"), wrap(col("body")).alias("html")
    )


def _ld_entry():
    return F.struct(
        F.lit("JobPosting").alias("@type"), "title", F.concat(F.lit("/p/"), "seq").alias("url"),
        F.struct(col("seq").alias("value")).alias("identifier"), col("posted_at").alias("datePosted"),
        col("description"), F.struct(F.struct(
            col("location").alias("addressLocality"), F.struct(F.lit("DE").alias("name")).alias("addressCountry"),
        ).alias("address")).alias("jobLocation"),
        F.struct(F.lit("EUR").alias("currency"), F.struct(F.lit(5).alias("minValue"), F.lit(9).alias("maxValue")).alias("value")).alias("baseSalary"),
        F.when(col("company_id") % 2 == 0, "TELECOMMUTE").alias("jobLocationType"),
    )


def _ld_pages(spark, sf):
    def wrap(body):
        return F.concat(
            F.lit('<html><script type="application/ld+json">{"@graph": [{"@type": "Organization"}, {"itemListElement": '),
            body, F.lit("}]}</script><p>x</p></html>"),
        )

    return _pages_of(spark, sf, _ld_entry(), wrap)


def json_ld_postings(spark, sf):
    return E.json_ld_postings(_ld_pages(spark, sf)).select(
        "title", "url", "external_id", "location", "description", "posted_at", "salary", "remote"
    )


def _state_entry():
    return F.struct(
        col("seq").alias("id"), col("title").alias("name"), F.concat(F.lit("/j/"), "seq").alias("link"),
        F.struct(col("location").alias("name")).alias("location"), col("posted_at").alias("postedOn"),
    )


def _state_pages(spark, sf):
    def wrap(body):
        next_data = F.concat(
            F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"featured": [{"title": "x"}], "pageProps": {"jobs": '),
            body, F.lit("}}}</script>"),
        )
        blob = F.concat(F.lit('<script>window.__NUXT__ = {"a": {"results": '), body, F.lit("}};</script>"))
        return F.when(F.length(body) % 2 == 0, next_data).otherwise(blob)

    return _pages_of(spark, sf, _state_entry(), wrap)


def state_postings(spark, sf):
    return E.state_postings(_state_pages(spark, sf)).select("title", "url", "external_id", "location", "posted_at")


def embedded_postings(spark, sf):
    """Both kinds of page in one crawl; each is read by its first tier."""
    ld = _ld_pages(spark, sf)
    both = ld.unionByName(_state_pages(spark, sf).withColumn("page_id", col("page_id") + 1))
    found = E.embedded_postings(both)
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("external_id").alias("ids"), F.count("location").alias("placed")
    )


def posting_detail(spark, sf):
    """JSON-LD detail pages, one per (company, order), plus both detail payload shapes."""
    ld = E.posting_detail(_ld_pages(spark, sf)).groupBy("description").agg(F.count(F.lit(1)).alias("n"))
    rows = raw_postings(spark, sf).select(
        col("seq").alias("page_id"),
        F.to_json(F.struct(F.struct(
            F.concat(F.lit("<p>"), "title", F.lit("</p>")).alias("jobSummary"), "description",
            F.lit("<b>min</b>").alias("minimumQualifications"),
        ).alias("res"))).alias("body"),
        F.to_json(F.struct(F.struct(col("description").alias("job_description")).alias("data"))).alias("body8"),
    )
    apple = E.apple_detail(rows.select("page_id", "body")).groupBy("description").agg(F.count(F.lit(1)).alias("n"))
    eight = E.eightfold_detail(rows.select("page_id", col("body8").alias("body"))).groupBy("description").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        ld.withColumn("kind", F.lit("ld")).unionByName(apple.withColumn("kind", F.lit("apple")))
        .unionByName(eight.withColumn("kind", F.lit("eightfold")))
    )


def board_registry(spark, sf):
    """All platforms through the registry into one landed frame."""
    payloads, rows = None, _shared(spark, sf)
    for platform, (root, entry) in ENTRIES.items():
        part = _payloads(spark, sf, platform, entry(), root, rows)
        payloads = part if payloads is None else payloads.unionByName(part)
    landed = B.land_raw_postings(B.board_postings(payloads))
    return landed.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.count("location").alias("with_location"))


def raw_payload_trim(spark, sf):
    """Records that hold a whole document each."""
    docs = spread(view(prepare(spark), sf, "documents")).select(
        "doc_id", F.concat(F.lit("t"), "doc_id").alias("title"), col("source").alias("url"), _null().alias("posted_at"),
        F.create_map(F.lit("text"), "text", F.lit("_source_url"), F.lit("own")).alias("raw"),
    )
    out = B.raw_payload_trim(docs)
    return out.select(
        "doc_id", F.length(col("raw")["text"]).alias("kept_chars"), F.md5(col("raw")["text"]).alias("text_md5"),
        col("raw")["_source_title"].alias("source_title"), col("raw")["_source_url"].alias("source_url"), F.size("raw").alias("keys"),
    )


def seed_list(spark, sf):
    """Page links as a seed file: comments, blanks, names, repeats."""
    pages = view(prepare(spark), sf, "pages")
    lines = pages.select(
        (col("page_id") * 4).alias("line_no"), F.concat(F.lit("  "), "url", F.lit(" | Name "), "page_id", F.lit(" | x")).alias("line")
    ).unionByName(pages.select((col("page_id") * 4 + 1).alias("line_no"), F.concat(F.lit("# "), "url").alias("line"))
    ).unionByName(pages.select((col("page_id") * 4 + 2).alias("line_no"), col("url").alias("line"))
    ).unionByName(pages.select((col("page_id") * 4 + 3).alias("line_no"), F.lit("   ").alias("line")))
    return intake.seed_list(lines)


def skill_list(spark, sf):
    """All turns of all conversations as lines of a skill file."""
    talks = view(prepare(spark), sf, "conversations").select(
        (col("conv_id") * 1_000 + col("turn")).alias("line_no"), col("text").alias("line")
    )
    return intake.skill_list(talks)


def payload_pages(spark, sf):
    """Runs as payload pages: items per page and a stated total per board."""
    from pyspark.sql import Window

    runs = view(prepare(spark), sf, "v_runs")
    numbered = runs.select(
        "run_id", "company_id", (F.row_number().over(Window.partitionBy("company_id").orderBy("started_at", "run_id")) - 1).alias("page_no"),
        col("jobs_found").alias("n_items"), (col("company_id") * 7 + 50).alias("total"),
    )
    return intake.assemble_payload_pages(numbered, page_size=20).select("run_id", "page_no")


QUERIES = {f"{p}_postings": _board(p) for p in ENTRIES} | {
    "phenom_postings": phenom_postings, "json_ld_postings": json_ld_postings,
    "state_postings": state_postings, "embedded_postings": embedded_postings,
    "posting_detail": posting_detail, "land_raw_postings": board_registry,
    "raw_payload_trim": raw_payload_trim, "seed_list": seed_list, "skill_list": skill_list,
    "assemble_payload_pages": payload_pages,
}


def _sql() -> dict[str, str]:
    v = with_views("v_postings")
    loc0 = "coalesce(location, '')"
    base = "'https://board' || CAST(company_id AS VARCHAR) || '.example.com'"
    s = "CAST(seq AS VARCHAR)"
    even = "company_id % 2 = 0"

    def board(**f):
        names = ("title", "url", "external_id", "location", "description", "requirements", "department",
                 "employment_type", "salary", "posted_at", "remote")
        where = f.pop("where", "true")
        f.setdefault("title", "title")
        cols = ", ".join(f"CAST({f.get(n, 'NULL')} AS VARCHAR) AS {n}" for n in names)
        return f"{v} SELECT company_id, {cols} FROM v_postings WHERE {where}"

    desc0 = "coalesce(description, '')"
    out = {
        "greenhouse_postings": board(url="url", external_id=s, location=loc0, posted_at="posted_at", department="'Team ' || company_id",
                                     description="CASE WHEN description IS NULL THEN '' ELSE description || chr(10) || 'R&amp;D' END", salary="salary", employment_type="'Full-time'"),
        "lever_postings": board(url="url", external_id=s, location=loc0, description=desc0, requirements="title || chr(10) || 'B'", department="'Core'",
                                employment_type="'Contract'", salary="'USD 100-' || CAST(company_id + 200 AS VARCHAR)", posted_at="'1753000000000'", remote="'remote'"),
        "ashby_postings": board(url="url", external_id=s, location=loc0, description=desc0, department="''", employment_type="''", salary="salary", posted_at="posted_at",
                                remote=f"CASE WHEN {even} THEN 'remote' END", where="company_id % 3 <> 0"),
        "workday_postings": board(url=f"{base} || '/en/job/x_R-' || {s}", external_id=f"CASE WHEN {even} THEN 'Q' || {s} ELSE 'R-' || {s} END", location=loc0,
                                  posted_at="posted_at", employment_type="'Full time'"),
        "smartrecruiters_postings": board(url=f"CASE WHEN {even} THEN url ELSE 'https://jobs.smartrecruiters.com/t' || company_id || '/' || {s} END", external_id=s,
                                          location="concat_ws(', ', location, 'de')", department="''", employment_type="''", posted_at="posted_at", remote="CASE WHEN company_id % 2 = 1 THEN 'remote' END"),
        "eightfold_postings": board(url=f"{base} || '/careers/job/' || {s}", external_id=s, location="CASE WHEN location IS NULL THEN 'B; C; D' ELSE location || '; B; C; D' END",
                                    department="''", remote="'onsite'", posted_at="'1753000000'"),
        "uber_postings": board(url=f"{base} || CASE WHEN {even} THEN '/b' ELSE '/en/jobs/' || {s} || '/' END", external_id=s, location="concat_ws(', ', location, 'US')", description=desc0,
                               requirements="''", department="'Ops'", employment_type="''", remote=f"CASE WHEN {even} THEN 'remote' END", salary=f"CASE WHEN {even} THEN 'EUR 10-20' ELSE salary END", posted_at="posted_at"),
        "taleo_postings": board(url=f"{base} || '/careersection/jobdetail.ftl?job=' || CAST(CASE WHEN {even} THEN seq ELSE seq + 1 END AS VARCHAR)",
                                external_id=f"CASE WHEN {even} THEN seq ELSE seq + 1 END", location=loc0, department="''", posted_at="posted_at"),
        "phenom_postings": board(title="title || ' {}'", url="url", external_id=s, location=loc0, department="''", employment_type="''",
                                 description=f"trim('a \"}}\" b; ' || {desc0})", posted_at="posted_at"),
        "json_ld_postings": f"""{v} SELECT title, {base} || '/p/' || {s} AS url, {s} AS external_id, concat_ws(', ', location, 'DE') AS location, {desc0} AS description, posted_at,
            'EUR 5-9' AS salary, CASE WHEN {even} THEN 'remote' END AS remote FROM v_postings""",
        "state_postings": f"{v} SELECT title, {base} || '/j/' || {s} AS url, {s} AS external_id, location, posted_at FROM v_postings",
        "embedded_postings": f"""{v} SELECT 'json_ld' AS source, count(*) AS n, count(DISTINCT seq) AS ids, count(*) AS placed FROM v_postings
            UNION ALL SELECT 'state', count(*), count(DISTINCT seq), count(location) FROM v_postings""",
        "posting_detail": f"""{v}, g AS (SELECT company_id, seq // 1000000 AS o, arg_min(description, seq) FILTER (description IS NOT NULL) AS d FROM v_postings GROUP BY ALL)
            SELECT d AS description, count(*) AS n, 'ld' AS kind FROM g WHERE d IS NOT NULL GROUP BY 1
            UNION ALL SELECT title || CASE WHEN description IS NULL THEN '' ELSE chr(10) || chr(10) || description END, count(*), 'apple' FROM v_postings GROUP BY 1
            UNION ALL SELECT description, count(*), 'eightfold' FROM v_postings WHERE description IS NOT NULL GROUP BY 1""",
        "land_raw_postings": f"""{v} SELECT company_id, count(*) * CASE WHEN company_id % 3 = 0 THEN 7 ELSE 8 END AS n,
            count(*) * CASE WHEN company_id % 3 = 0 THEN 7 ELSE 8 END AS with_location FROM v_postings GROUP BY 1""",
        "raw_payload_trim": """SELECT doc_id, CAST(length(text) AS INTEGER) AS kept_chars, md5(text) AS text_md5,
            't' || CAST(doc_id AS VARCHAR) AS source_title, 'own' AS source_url, 4 AS keys FROM documents""",
        "seed_list": "SELECT min(page_id) * 4 AS line_no, url, 'Name ' || CAST(min(page_id) AS VARCHAR) || ' | x' AS name FROM pages GROUP BY url",
        "skill_list": """WITH t AS (SELECT conv_id * 1000 + turn AS line_no, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS skill FROM conversations),
            r AS (SELECT *, row_number() OVER (PARTITION BY lower(skill) ORDER BY line_no) AS rn FROM t WHERE skill <> '' AND NOT starts_with(skill, '#')) SELECT line_no, skill FROM r WHERE rn = 1""",
        "assemble_payload_pages": with_views("v_runs") + """, n AS (SELECT run_id, company_id, CAST(row_number() OVER w - 1 AS INTEGER) AS page_no, jobs_found, company_id * 7 + 50 AS total FROM v_runs WINDOW w AS (PARTITION BY company_id ORDER BY started_at, run_id)),
            m AS (SELECT *, coalesce(sum(jobs_found) OVER p, 0) AS got, coalesce(max(CASE WHEN jobs_found < 20 THEN 1 ELSE 0 END) OVER p, 0) AS short FROM n WINDOW p AS (PARTITION BY company_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
            SELECT run_id, page_no FROM m WHERE (page_no = 0 OR (short = 0 AND got < total))""",
    }
    return out


SQL = _sql()
