"""HTML nodes, selectors, page assembly and classification over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import fixed_values as V, labels
from postlens.operators import pages as G
from postlens.plans import sql as S
from postlens.plans.sources import spread
from postlens.plans.views import view, with_views
from postlens.session import prepare
from postlens.sources import intake, nodes, selectors
from postlens.sources.selectors import SelectorSet

col = F.col
HREF = '<a href="([^"]*)"'
LISTING = SelectorSet("nav li", "h3 a, a", url="a", location="span.place, [data-place]")


def _pages(spark, sf):
    return spread(view(prepare(spark), sf, "pages"))


def node_table(spark, sf):
    """Anchors with link and text, and the element counts of each page."""
    rows = nodes.node_table(_pages(spark, sf))
    links = rows.filter("tag = 'a'").select("page_id", F.element_at("attrs", "href").alias("href"), "text")
    counts = rows.filter(col("tag").isin("li", "nav", "h1", "article")).groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("n")
    )
    return links.select("page_id", "href", "text", F.lit(0).cast("bigint").alias("n")).unionByName(
        counts.select("page_id", col("tag").alias("href"), F.lit("").alias("text"), "n")
    )


def select_records(spark, sf):
    return selectors.select_records(_pages(spark, sf), LISTING).select("page_id", "title", "url", "location")


def select_records_path(spark, sf):
    paths = SelectorSet("//nav//li", ".//a", url=".//a/@href")
    return selectors.select_records_path(_pages(spark, sf), paths).select("page_id", "title", "url")


def collapse_by_url(spark, sf):
    """Links of a page, with their texts, collapsed to one record per link."""
    records = selectors.select_records_uncollapsed(_pages(spark, sf), SelectorSet("a", "self", url="self"))
    return selectors.collapse_by_url(records).select("page_id", "title", "url")


def selector_ladder(spark, sf):
    sets = [SelectorSet("div.job", "a"), SelectorSet("nav li", "a", url="a"), SelectorSet("a", "self", url="self")]
    return selectors.selector_ladder(_pages(spark, sf), sets).select("page_id", "set_index", "title", "url")


DRESSES = {
    "generic_html": '<li class="job-item">', "custom_react": '<li data-testid="job-row">', "successfactors": '<li class="jobTitle">',
    "taleo": '<li class="jobResultItem">', "apple": '<li><div class="job-list-item">', "other": '<li class="vacancy">',
}


def builtin_selector_ladder(spark, sf):
    """Page lists dressed as job lists of every platform in turn, so that a set of each applies."""
    names = list(DRESSES)
    dressed = _pages(spark, sf).withColumn("platform", F.element_at(
        F.array(*map(F.lit, names)), (col("page_id") % len(names) + 1).cast("int")
    ))
    html = F.lit(None)
    for name, item in DRESSES.items():
        html = F.when(col("platform") == name, F.replace("html", F.lit("<li>"), F.lit(item))).otherwise(html)
    dressed = dressed.withColumn("html", F.when(
        col("platform") == "apple",
        F.replace(F.replace(html, F.lit("</li>"), F.lit("</div></li>")), F.lit("<a href"), F.lit('<a class="link-inline" href')),
    ).otherwise(html))
    return selectors.builtin_selector_ladder(dressed, col("platform")).select("page_id", "set_index", "title", "url")


def _sites(spark, sf):
    """Pages with their website, and the stored sets of every website."""
    crawl = spread(view(prepare(spark), sf, "v_crawl"))
    return crawl.select("page_id", col("host").alias("website"), "url", "html"), view(spark, sf, "v_site_selectors")


def stored_selectors(spark, sf):
    return selectors.stored_records(*_sites(spark, sf)).select("page_id", "version", "strategy", "title", "url")


def stored_attempts(spark, sf):
    pages, sets = _sites(spark, sf)
    return selectors.stored_attempts(pages, sets, selectors.stored_records(pages, sets)).select(
        "page_id", "version", "tier", "jobs_found"
    )


def selector_faults(spark, sf):
    return selectors.selector_faults(_sites(spark, sf)[1]).select("website", "version", "field")


def assemble_pages(spark, sf):
    crawl = spread(view(prepare(spark), sf, "v_crawl"))
    from pyspark.sql import Window

    numbered = crawl.withColumn("page_no", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))
    links = numbered.select(
        F.xxhash64("host").alias("company_id"), "page_no", "page_id",
        F.explode_outer(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("url"),
    )
    kept = intake.assemble_pages(links.select("company_id", "page_no", "url"))
    return kept.join(links.select("company_id", "page_no", "page_id").distinct(), ["company_id", "page_no"]).select(
        "page_id", "n_links", "n_fresh"
    )


def platform_detect(spark, sf):
    return G.platform_detect(_pages(spark, sf)).select("page_id", "platform", "confidence", "evidence")


def board_tokens(spark, sf):
    """Pages under addresses of hosted boards, or with a board's script in them, and the token of the board."""
    n = col("page_id").cast("string")
    boards = F.array(
        F.concat(F.lit("https://boards.greenhouse.io/acme"), n, F.lit("/jobs/7")), F.concat(F.lit("https://jobs.lever.co/firm."), n),
        F.concat(F.lit("https://jobs.ashbyhq.com/org-"), n, F.lit("?x=1")), col("url"),
    )
    script = F.concat(F.lit('<script src="https://boards.greenhouse.io/embed/job_board/js?for=emb'), n, F.lit('"></script>'))
    moved = _pages(spark, sf).withColumns({
        "html": F.when(col("page_id") % 4 == 3, F.concat("html", script)).otherwise(col("html")),
        "url": F.element_at(boards, (col("page_id") % 4 + 1).cast("int")),
    })
    return G.platform_detect(moved).select("page_id", "platform", "board_token", "confidence")


def model_answers(spark, sf):
    """Documents as answers of a model: fenced, bare and inside other text, or without JSON; the text is read back."""
    body = F.to_json(F.struct(col("doc_id").alias("n"), F.array(col("lang"), col("source")).alias("tags")))
    fence = F.lit("```")
    answer = F.element_at(F.array(
        F.concat(F.lit("Sure:\n"), fence, F.lit("json\n"), body, F.lit("\n"), fence, F.lit("\nbye")), body,
        F.concat(F.lit("so it is "), body, F.lit(" .")), F.regexp_replace("text", r"[\[\]{}`0-9]", "x"),
    ), (col("doc_id") % 4 + 1).cast("int"))
    docs = spread(view(prepare(spark), sf, "documents"))
    parsed = docs.select("doc_id", labels.model_json(answer).alias("v"))
    read = parsed.select(
        "doc_id", F.try_variant_get("v", "$.n", "bigint").alias("n"),
        labels.as_text_list(F.try_variant_get("v", "$.tags", "array<string>")).alias("tags"),
    )
    return read.select("doc_id", "n", F.array_join("tags", "|").alias("tags"))


def robots_allow(spark, sf):
    """Rules per host made from the first words of its pages; every link is judged."""
    crawl = spread(view(prepare(spark), sf, "v_crawl"))
    text = F.concat(
        F.lit("User-agent: *\nDisallow: /fr/\nAllow: /fr/"), F.min(F.length("url")).cast("string"),
        F.lit("\nDisallow: /*.html$\nDisallow: /en/7 # private\n\nUser-agent: other\nDisallow: /\n"),
    )
    files = crawl.groupBy(col("host").alias("domain")).agg(text.alias("text"))
    urls = crawl.select("page_id", "url", col("host").alias("domain"))
    return G.robots_allow(urls, files, "reader").select("page_id", "allowed")


def listing_region(spark, sf):
    return G.listing_region(_pages(spark, sf), r"^/").select("page_id", "tag", "links", "score_e2")


QUERIES = {
    "node_table": node_table, "select_records": select_records,
    "select_records_path": select_records_path, "collapse_by_url": collapse_by_url,
    "selector_ladder": selector_ladder, "builtin_selector_ladder": builtin_selector_ladder,
    "stored_selectors": stored_selectors, "stored_attempts": stored_attempts, "selector_faults": selector_faults,
    "board_tokens": board_tokens, "model_answers": model_answers,
    "assemble_pages": assemble_pages, "platform_detect": platform_detect,
    "robots_allow": robots_allow, "listing_region": listing_region,
}


def _sql() -> dict[str, str]:
    items = r"""i AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS m FROM pages),
        l AS (SELECT page_id, url, regexp_extract(m, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(m, '>([^<>]*)</a>', 1)) AS t, generate_subscripts(list_value(1), 1) AS one FROM i)"""
    ordered = r"""i AS (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS ms FROM pages),
        x AS (SELECT page_id, url, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM i),
        l AS (SELECT page_id, url, pos, regexp_extract(m, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(m, '>([^<>]*)</a>', 1)) AS t FROM x)"""
    base = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
    link = f"CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href ELSE {base} || href END"
    firsts = f"""f AS (SELECT page_id, t, {link} AS u, row_number() OVER (PARTITION BY page_id, {link} ORDER BY pos) AS rn FROM l WHERE t <> '')"""
    stored = with_views("v_crawl") + f""", {ordered}, k AS (SELECT page_id, length(host) % 7 AS kind, host FROM v_crawl),
        r AS (SELECT page_id, kind, pos, t AS title, {link} AS url FROM l JOIN k USING (page_id)
              WHERE t <> '' AND (kind IN (0, 1, 2) OR kind = 3 AND pos = 2 OR kind = 5 AND contains(href, 'a') OR kind = 6 AND pos = 1)
          UNION ALL SELECT page_id, 6, 0, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), NULL FROM pages JOIN k USING (page_id)
              WHERE kind = 6 AND regexp_extract(html, '<article><h1>([^<]*)</h1>', 1) <> ''),
        c AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM r),
        f AS (SELECT page_id, kind, title, url FROM c WHERE rn = 1 OR url IS NULL OR kind IN (1, 3, 5))"""
    def marks(x, words):
        return "(" + " OR ".join(f"contains({x}, {S.text(w)})" for w in words) + ")"
    body = "lower(html)"
    hosts = " ".join(f"WHEN {marks('lower(url)', V.HOST_MARKERS[p])} THEN '{p}'" for p in V.REGISTRY_ORDER if p in V.HOST_MARKERS)
    bodies = " ".join(f"WHEN {marks(body, V.BODY_MARKERS[p])} THEN '{p}'" for p in V.REGISTRY_ORDER if p in V.BODY_MARKERS)
    volume = "(length(html) - 12 * (length(html) - length(replace(html, '<', ''))))"
    spa = f"({marks('lower(html)', V.SPA_MARKERS)} AND {volume} < 2000)"
    return {
        "node_table": f"""WITH {ordered} SELECT page_id, href, t AS text, CAST(0 AS BIGINT) AS n FROM l
            UNION ALL SELECT page_id, tag, '', n FROM (SELECT page_id, unnest(['li', 'nav', 'h1', 'article']) AS tag, unnest([len(regexp_extract_all(html, '<li[ >]')), len(regexp_extract_all(html, '<nav[ >]')), len(regexp_extract_all(html, '<h1[ >]')), len(regexp_extract_all(html, '<article[ >]'))]) AS n FROM pages) WHERE n > 0""",
        "select_records": f"WITH {ordered}, {firsts} SELECT page_id, t AS title, u AS url, CAST(NULL AS VARCHAR) AS location FROM f WHERE rn = 1",
        "select_records_path": f"WITH {ordered} SELECT page_id, t AS title, {link} AS url FROM l WHERE t <> ''",
        "collapse_by_url": f"WITH {ordered}, {firsts} SELECT page_id, t AS title, u AS url FROM f WHERE rn = 1",
        "selector_ladder": f"WITH {ordered}, {firsts} SELECT page_id, 1 AS set_index, t AS title, u AS url FROM f WHERE rn = 1",
        "builtin_selector_ladder": f"WITH {ordered}, {firsts} SELECT page_id, CASE WHEN page_id % 6 = 3 THEN 1 ELSE 0 END AS set_index, t AS title, u AS url FROM f WHERE rn = 1",
        "stored_selectors": stored + " SELECT page_id, CAST(2 AS BIGINT) AS version, CASE WHEN kind IN (1, 3, 5) THEN 'xpath' ELSE 'css' END AS strategy, title, url FROM f",
        "stored_attempts": stored + """ SELECT k.page_id, CAST(2 AS BIGINT) AS version, CASE WHEN k.kind IN (1, 3, 5) THEN 'xpath' ELSE 'css_selector' END AS tier,
            count(f.url) AS jobs_found FROM k LEFT JOIN f USING (page_id) GROUP BY ALL""",
        "selector_faults": with_views("v_site_selectors") + """ SELECT website, CAST(version AS BIGINT) AS version, unnest(CASE WHEN container = 'li[[[broken' THEN ['container'] WHEN location = 'span::before' THEN ['location'] ELSE [] END) AS field FROM v_site_selectors""",
        "board_tokens": """SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'greenhouse' END AS platform,
            CASE page_id % 4 WHEN 0 THEN 'acme' WHEN 1 THEN 'firm.' WHEN 2 THEN 'org-' ELSE 'emb' END || page_id AS board_token,
            CAST(CASE page_id % 4 WHEN 3 THEN 0.85 ELSE 0.95 END AS DOUBLE) AS confidence FROM pages""",
        "model_answers": """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN doc_id END AS n, CASE WHEN doc_id % 4 < 3 THEN lang || '|' || source END AS tags FROM documents""",
        "assemble_pages": with_views("v_crawl") + """, n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS no FROM v_crawl),
            l AS (SELECT host, no, page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS u FROM n),
            s AS (SELECT host, u, min(no) AS no FROM l GROUP BY ALL), f AS (SELECT host, no, count(*) AS n_fresh FROM s GROUP BY ALL),
            c AS (SELECT n.host, n.no, n.page_id, (SELECT count(*) FROM l WHERE l.page_id = n.page_id) AS n_links, coalesce(n_fresh, 0) AS n_fresh FROM n LEFT JOIN f ON f.host = n.host AND f.no = n.no),
            e AS (SELECT host, min(no) FILTER (n_fresh = 0) AS stop FROM c GROUP BY 1)
            SELECT page_id, n_links, n_fresh FROM c JOIN e USING (host) WHERE no = 1 OR no < coalesce(stop, 1000000000)""",
        "platform_detect": f"""SELECT page_id, coalesce(CASE {hosts} END, CASE {bodies} END, CASE WHEN {spa} THEN 'custom_react' ELSE 'generic_html' END) AS platform,
            CAST(CASE WHEN CASE {hosts} END IS NOT NULL THEN 0.95 WHEN CASE {bodies} END IS NOT NULL THEN 0.75 WHEN {spa} THEN 0.4 ELSE 0.5 END AS DOUBLE) AS confidence,
            CASE WHEN CASE {hosts} END IS NOT NULL THEN 'hostname' ELSE 'body' END AS evidence FROM pages""",
        "robots_allow": with_views("v_crawl") + r""", r AS (SELECT host, min(length(url)) AS m FROM v_crawl GROUP BY 1),
            t AS (SELECT page_id, m, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS p FROM v_crawl JOIN r USING (host))
            SELECT page_id, CASE WHEN regexp_matches(p, '\.html$') AND NOT starts_with(p, '/fr/' || CAST(m AS VARCHAR)) THEN false
              WHEN starts_with(p, '/fr/' || CAST(m AS VARCHAR)) THEN CASE WHEN regexp_matches(p, '\.html$') AND 7 > 4 + length(CAST(m AS VARCHAR)) THEN false ELSE true END
              WHEN starts_with(p, '/fr/') OR starts_with(p, '/en/7') THEN false ELSE true END AS allowed FROM t""",
        "listing_region": r"""SELECT page_id, 'ul' AS tag, CAST(n AS INTEGER) AS links, CAST(n * 100 AS INTEGER) AS score_e2
            FROM (SELECT page_id, len(regexp_extract_all(html, '<li><a href="/[^"]*">')) AS n FROM pages) WHERE n >= 2""",
    }


SQL = _sql()
