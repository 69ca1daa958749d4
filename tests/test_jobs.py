"""Literal frames for operators that work on tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postlens.functions import fixed_values as V
from postlens.operators import common
from postlens.operators import candidates as K, matchers as X, matching as M, notifications as N, pages as G, selectors as L, telemetry as TL
from postlens.operators.extraction import acceptable, extraction_score, ladder_choice
from postlens.operators.postings import KEY, new_postings, normalize_postings, skill_token_join, touched_by_second, two_loads
from postlens.operators.prices import price_lookup
from postlens.sources import boards as B, embedded as E, intake, selectors as S

TODAY = "2026-07-30"


def keys(spark, rows):
    return spark.createDataFrame(rows, "company_id bigint, content_hash string, seq bigint")


def test_new_postings(spark):
    stored = keys(spark, [(1, h, 0) for h in "abc"])
    batch = keys(spark, [(1, h, i) for i, h in enumerate("abcde")] + [(1, "d", 9), (2, "d", 5)])
    got = {tuple(r) for r in new_postings(batch, stored, [F.col("seq")]).collect()}
    assert got == {(1, "d", 3), (1, "e", 4), (2, "d", 5)}


def test_two_loads_read_each_row_once(spark):
    """What new_postings and touch_seen leave, by one aggregate (before: four readings of the rows)."""
    rows = spark.createDataFrame(
        [(1, "a", 2, 5, 10), (1, "a", 1, None, 11), (1, "a", 9, 1, 50), (1, "b", 3, 2, 12), (2, "a", 4, 3, 60), (2, "a", 4, None, 61), (3, "c", 0, 0, None)],
        "company_id bigint, content_hash string, seq bigint, place bigint, at bigint",
    )
    order = [F.col("seq"), F.col("place")]
    got = two_loads(rows, F.col("at") >= 50, order, F.col("at"), F.lit(99).cast("bigint"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", 11, 99), (1, "b", 12, 12), (2, "a", 61, 61)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_touch_by_second_load_reads_each_row_once(spark):
    rows = spark.createDataFrame(
        [(1, "a", 10), (1, "a", 11), (1, "a", 50), (1, "b", 12), (1, "b", None), (2, "a", 60), (3, "c", None)],
        "company_id bigint, content_hash string, at bigint",
    )
    got = touched_by_second(rows, F.col("at") >= 50, F.col("at"), F.lit(99).cast("bigint"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", 99), (1, "b", 12)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_json_ld_scripts_are_found_in_the_walk(spark):
    """Script texts are taken out beside the walk, as the pattern with a lazy middle took them."""
    ld = '<SCRIPT x type = "application/LD+json" y>'
    pages = [f"{ld}1</Script >2</script>{ld}\n3</SCRIPT>{ld}4", f"{ld}{ld}5</script>", "<script>6</script>", f"{ld}</script>", "", None]
    pattern = r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select(
        "html", F.coalesce(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), F.array().cast("array<string>")).alias("want"),
    ).collect()
    assert [list(E._ld_texts(r.html)) for r in rows] == [r.want for r in rows]


def profile(spark, **change):
    base = dict(
        profile_id=1, seniority="mid", remote_preference="any", max_seniority_gap=1, include_unknown_location=True,
        match_threshold=0.6, preferred_roles=["Software Engineer", "Backend Engineer"],
        preferred_locations=["Bangalore", "Bengaluru", "Remote"], preferred_skills=["Python"],
        excluded_keywords=["Sales", "Unpaid"],
    )
    base.update(change)
    return spark.createDataFrame([base], (
        "profile_id int, seniority string, remote_preference string, max_seniority_gap int, "
        "include_unknown_location boolean, match_threshold double, preferred_roles array<string>, "
        "preferred_locations array<string>, preferred_skills array<string>, excluded_keywords array<string>"
    ))


def job(spark, title, location="Bengaluru", description=None):
    raw = spark.createDataFrame(
        [(1, 1, title, "https://x.com/1", location, description)],
        "company_id bigint, seq bigint, title string, url string, location string, description string",
    )
    return normalize_postings(raw, F.lit(TODAY).cast("date"))


def test_rule_score(spark):
    good = M.rule_score(job(spark, "Backend Engineer", description="Python, 4 years"), profile(spark)).first()
    assert good.score == 1.0 and good.is_match and good.matched_skills == ["Python"]
    assert good.reasoning == "title matches a preferred role; mentions Python; location works; seniority is a direct fit"
    bad = M.rule_score(job(spark, "Enterprise Sales Engineer"), profile(spark)).first()
    assert bad.vetoed and bad.score == 0 and not bad.is_match
    high = M.rule_score(job(spark, "Staff Engineer"), profile(spark, seniority="junior")).first()
    assert "levels above" in high.veto_reason
    zero = M.rule_score(job(spark, "Backend Engineer"), profile(spark, match_threshold=0.0)).first()
    assert zero.threshold == 0.6


def test_every_profile_meets_every_posting(spark):
    many = spark.range(3000).select(F.col("id").cast("int").alias("profile_id")).crossJoin(profile(spark).drop("profile_id"))
    jobs = job(spark, "Backend Engineer").unionByName(job(spark, "Analyst"))
    got = M.rule_score(jobs, many).groupBy("title").agg(F.count_distinct("profile_id").alias("n"), F.count("*").alias("rows"))
    assert {tuple(r) for r in got.collect()} == {("Backend Engineer", 3000, 3000), ("Analyst", 3000, 3000)}


@pytest.fixture(scope="module")
def market(spark):
    """Postings and profiles that meet in every way a score can come about."""
    import random

    rng = random.Random(12)
    places = [None, "Berlin, Germany", "Remote", "Remote - US", "Bengaluru", "Hybrid, Oslo", "Paris", "Berlingen", "Multiple Locations"]
    titles = ["Backend Engineer", "Senior Data Analyst", "Engineers", "Staff Platform Engineer (m/f/d)", "QA", "Lead QA Tester", "!!!", "Sales Manager", "C Developer", "Junior Developer", "Data"]
    jobs = [(c, s, rng.choice(titles), f"https://x.com/{c}/{s}", rng.choice(places), rng.choice([None, "Sales team", "Unpaid python"]))
            for c in range(6) for s in range(40)] + [(9, 1, "Unpaid Sales", "https://x.com/z", "Paris", None)]
    raw = spark.createDataFrame(jobs, "company_id bigint, seq bigint, title string, url string, location string, description string")
    wants = [["Backend Engineer"], ["Engineer"], [], ["QA Tester", "Data"], ["Data Analyst II"], ["gine"], [""], ["Developer of things and more"]]
    where = [[], ["Berlin"], ["Remote"], ["Oslo", "Paris", "Remote"], ["a"], ["Berlin, Germany somewhere"]]
    rows = [(i, rng.choice(["junior", "mid", "senior", "unknown"]), rng.choice(["any", "remote_only"]), rng.randrange(3), rng.random() < 0.5,
             rng.choice([0.0, 0.3, 0.6, 0.9]), rng.choice(wants), rng.choice(where), ["python"], rng.choice([[], ["Unpaid"], ["Sales"]])) for i in range(60)]
    fields = profile(spark).columns
    schema = ("profile_id int, seniority string, remote_preference string, max_seniority_gap int, include_unknown_location boolean, "
              "match_threshold double, preferred_roles array<string>, preferred_locations array<string>, preferred_skills array<string>, excluded_keywords array<string>")
    assert len(fields) == len(rows[0])
    return normalize_postings(raw, F.lit(TODAY).cast("date"), keep=("seq",)).dropDuplicates(list(KEY)).cache(), spark.createDataFrame(rows, schema).cache()


PAIR = [*KEY, "profile_id"]


@pytest.mark.parametrize("least", [1, 3_600, 5_001, 8_500])
def test_candidates_lose_no_pair(spark, market, least):
    jobs, people = market
    every = M.rule_score(jobs, people).filter(~F.col("vetoed") & (F.col("score_e4") >= least))
    columns = [*PAIR, "score_e4", "reasoning", "is_match", "threshold"]
    got = {tuple(r) for r in K.scores_at_least(jobs, people, F.lit(least)).select(*columns).collect()}
    assert got == {tuple(r) for r in every.select(*columns).collect()} and got


def test_shortlists_without_all_pairs(spark, market):
    jobs, people = market
    every = M.rule_score(jobs, people).cache()

    def rows(df, *columns):
        return sorted(tuple(r) for r in df.select(*columns).collect())
    for size in (3,):
        assert rows(K.shortlists(jobs, people, size), *PAIR, "score_e4") == rows(M.semantic_shortlist(every, size), *PAIR, "score_e4")
    assert rows(K.matches(jobs, people), *PAIR) == rows(every.filter("is_match"), *PAIR)
    for size in (5, 1000):
        assert rows(K.enrichment_candidates(jobs, people, [*KEY, "seq"], size), *KEY, "best_e4") == rows(
            M.enrichment_shortlist(jobs, every, [*KEY, "seq"], size), *KEY, "best_e4")
    totals = ["company_id", "strong", "weak", "total", "best_score"]
    assert rows(K.company_totals(jobs, people), *totals) == rows(TL.match_counts(every), *totals)
    for jobs, people in ((jobs.limit(0), people), (jobs, people.limit(0))):
        assert K.shortlists(jobs, people, 3).count() == 0
    assert K.company_totals(jobs, people).count() == 0


def test_matcher_contract(spark):
    import pyarrow as pa

    jobs = job(spark, "Backend Engineer", description="Python and AWS").unionByName(job(spark, "Analyst", description="Excel"))
    people = profile(spark, preferred_skills=["Python", "Django"])
    pairs = jobs.select(*KEY).withColumn("profile_id", F.lit(1))
    by_skills = X.score_pairs("skills", jobs, people, pairs).orderBy("score_e4").collect()
    assert [(r.score_e4, r.is_match, r.matched_skills, r.missing_skills) for r in by_skills] == [
        (0, False, [], ["Python", "Django"]), (5_000, False, ["Python"], ["Django"])]
    by_rule = X.score_pairs("rule", jobs, people, pairs)
    assert by_rule.columns == X.score_pairs("skills", jobs, people, pairs).columns and by_rule.filter("is_match").count() == 1
    with pytest.raises(ValueError):
        X.score_pairs("none", jobs, people, pairs)
    with pytest.raises(ValueError):
        X.register_matcher(X.Matcher("skills", "2", (), lambda b: b))
    good = {"score_e4": [5], "vetoed": [False], "veto_reason": pa.nulls(1, pa.string()), "matched_skills": [[]], "missing_skills": [["a"]], "reasoning": [""]}
    assert len(X.checked("m", pa.table(good), 1)) == 6
    for bad in ({"score_e4": [10_001]}, {"score_e4": [None]}, {"vetoed": [None]}, {"score_e4": ["x"]}):
        with pytest.raises((ValueError, pa.ArrowInvalid)):
            X.checked("m", pa.table(good | bad), 1)
    with pytest.raises(ValueError):
        X.checked("m", pa.table(good), 2)
    with pytest.raises(ValueError):
        X.checked("m", pa.table(good).drop_columns(["reasoning"]), 1)


def batch(spark, titles, same_url=False):
    rows = [(1, "api", t, "https://x/1" if same_url else f"https://x/{i}", "Berlin", "today", None) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "company_id int, tier string, title string, url string, location string, posted_at string, description string")


@pytest.mark.parametrize("titles,same_url,good", [
    (["Backend Engineer"] * 6, False, False),
    (["View all", "Home", "Sign in", "Privacy policy"], False, False),
    (["A Engineer", "B Engineer", "C Engineer", "D Engineer"], True, False),
    ([f"{c} Engineer" for c in "ABCDE"], False, True),
])
def test_extraction_score(spark, titles, same_url, good):
    scores = extraction_score(batch(spark, titles, same_url), "company_id", "tier")
    row = scores.first()
    assert (acceptable(scores).count() == 1) == good
    assert row.confidence >= 0.8 if good else row.confidence < 0.6


def test_ladder_choice(spark):
    poor = batch(spark, ["Details"] * 3)
    fine = batch(spark, ["A Engineer", "B Analyst", "C Manager"]).withColumn("tier", F.lit("css_selector"))
    row = ladder_choice(extraction_score(poor.unionByName(fine), "company_id", "tier"), "company_id").first()
    assert row.tier == "css_selector" and row.trail == ["api:miss(3)", "css_selector:ok(3)"]


@pytest.fixture
def tiny_slices(monkeypatch):
    """Slices of a few rows and scans of three, so that small data has several levels."""
    monkeypatch.setattr(common, "SLICE_ROWS", 6)
    monkeypatch.setattr(common, "SCAN", 3)


def test_selector_health_equals_plain_fold(spark, tiny_slices):
    import random

    rnd = random.Random(7)
    rows = [("w", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 50), i, rnd.random() < 0.6, rnd.randrange(10_001)) for i in range(300)]
    c, streak = 10_000, 0
    for *_, ok, x in rows:
        c, streak = (7 * c + (3 * x if ok else 0) + 5) // 10, 0 if ok else streak + 1
    rows += [("v", dt.datetime(2024, 1, 1), 1, False, 0)]
    df = spark.createDataFrame(rows, "website string, ts timestamp, attempt_id int, ok boolean, confidence_e4 int")
    got = {r.website: (r.confidence_e4, r.consecutive_failures, r.success_count, r.failure_count) for r in L.selector_health(df).collect()}
    good = sum(ok for *_, ok, _ in rows)
    assert got == {"w": (c, streak, good, 300 - good), "v": (7_000, 1, 0, 1)}
    assert L.selector_health(df.limit(0)).count() == 0


def test_running_totals_over_slices(spark, tiny_slices):
    import random

    rnd = random.Random(3)
    at = dt.datetime(2024, 1, 1, 5)          # all calls of the first day in one second
    rows = [(at, i, rnd.randrange(9)) for i in range(200)] + [(at + dt.timedelta(days=1 + i // 7), 1000 + i, 1) for i in range(20)]
    calls = spark.createDataFrame(rows, "ts timestamp, call_id int, cost_e4 int")
    got = {r.call_id: (r.spent_e4, r.calls_today, r.exhausted) for r in TL.daily_spend(calls, 100).collect()}
    want, total = {}, {}
    for ts, i, cost in rows:
        spent, n = total.get(ts.date(), (0, 0))
        total[ts.date()] = spent + cost, n + 1
        want[i] = spent + cost, n + 1, spent + cost >= 100
    assert got == want
    slices = common.ordered_slices(calls, ["ts", "call_id"])
    assert slices.groupBy("slice").count().agg(F.max("count")).first()[0] < 60
    assert TL.daily_spend(calls.limit(0), 100).count() == 0


def test_breaker_episodes_equal_plain_fold(spark, tiny_slices):
    import random

    rnd = random.Random(9)
    ts, rows = dt.datetime(2024, 1, 1), []
    for i in range(300):
        ts += dt.timedelta(seconds=rnd.choice([0, 1, 30, 4000]))
        rows.append((ts, i, rnd.random() < 0.15))
    df = spark.createDataFrame(rows, "ts timestamp, call_id int, ok boolean")
    runs, last = [], None
    for ts, i, ok in rows:
        if not ok:
            if last is None or last[1] or (ts - last[0]).total_seconds() > V.BREAKER_COOLDOWN_SECONDS:
                runs.append([])
            runs[-1].append(ts)
        last = ts, ok
    want = sorted((r[V.BREAKER_FAILURES - 1], len(r)) for r in runs if len(r) >= V.BREAKER_FAILURES)
    got = sorted((r.opened_at, r.failures) for r in TL.breaker_episodes(df).collect())
    assert got == want and want
    assert TL.breaker_episodes(df.limit(0)).count() == 0


def test_schedule_next_caps_backoff(spark):
    rows = [(i, 1, dt.datetime(2024, 1, 1 + i), "failed", 0) for i in range(12)]
    df = spark.createDataFrame(rows, "run_id int, company_id int, started_at timestamp, status string, jobs_found int")
    got = TL.schedule_next(df, F.date_trunc("day", "started_at"), 60).orderBy("run_id").collect()
    waits = [(r.next_scan_at - r.started_at).total_seconds() / 60 for r in got]
    assert waits[:3] == [120, 240, 480] and waits[-1] == 10_080
    assert [r.deactivate for r in got].index(True) == 9


def test_unnotified_blocks_on_failed_rows(spark):
    old = spark.createDataFrame([(1, 1, "email", "failed")], "job_id int, user_id int, channel string, status string")
    want = spark.createDataFrame([(1, 1, "email"), (2, 1, "email"), (2, 1, "email")], "job_id int, user_id int, channel string")
    assert [tuple(r) for r in N.unnotified(want, old).collect()] == [(2, 1, "email")]
    assert N.already_notified(old).count() == 0
    assert TL.delivery_summary(old.limit(0)).first().success_rate is None


def test_mail_html(spark):
    schema = ("job_title string, company_name string, location string, employment_type string, remote_type string, salary string, "
              "posted_date date, reasoning string, matched_skills array<string>, missing_skills array<string>, score double, url string")
    full = ("<script>alert(1)</script>", "A & B", "Berlin, DE", "full_time", "remote", "50-60k EUR", dt.date(2024, 5, 6), "fits <you>",
            [f"s{k}" for k in range(10)], [f"m{k}" for k in range(9)], 0.8, 'https://x.org/?a="1"&b=2')
    bare = ("Eng", "C", "Rome", "full_time", "remote", None, None, None, [], None, 0.5, "https://x.org")
    rows = spark.createDataFrame([full, bare], schema)
    one, two = (r.html for r in N.render(rows).orderBy(F.desc("score")).collect())
    assert "<script>" not in one and "&lt;script&gt;alert(1)&lt;/script&gt;" in one and "A &amp; B" in one
    for part in ("80% match", "Berlin, DE", "50-60k EUR", "2024-05-06", "Why this matched", "fits &lt;you&gt;", "#1b5e20"):
        assert part in one
    assert 'href="https://x.org/?a=&quot;1&quot;&amp;b=2"' in one
    assert "s7" in one and "s8" not in one and "m5" in one and "m6" not in one
    for part in ("Salary", "Posted", "Why this matched", "mentioned", "#1b5e20"):
        assert part not in two
    assert "50% match" in two and N.render(rows.drop("missing_skills")).where("html like '%Not mentioned%'").isEmpty()
    assert N.render(rows.limit(0)).isEmpty()


def test_render(spark):
    row = spark.createDataFrame(
        [("Eng <b>", "Acme", "Berlin", "full_time", "remote", None, None, "fits", ["a"] * 9, 0.87, "https://x?a=1&b=2")],
        "job_title string, company_name string, location string, employment_type string, remote_type string, salary string, "
        "posted_date date, reasoning string, matched_skills array<string>, score double, url string",
    )
    out = N.render(row).first()
    assert "87%" in out.subject and "Salary" not in out.text and "Full Time" in out.text
    assert "&lt;b&gt;" in out.telegram and out.text.count("a, a") and len(out.text.split("mentioned: ")[1].split("\n")[0].split(", ")) == 8
    assert out.slack_blocks.startswith("[{") and '"style":"primary"' in out.slack_blocks


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\nAllow: /$\nAllow: /careers\nDisallow: /careers/*.pdf$\nDisallow:\n\nUser-agent: evil\nUser-agent: bot\nDisallow: /x\n"
    files = spark.createDataFrame([("h.com", text)], "domain string, text string")
    paths = ["/careers?x", "/candidate", "/", "/careers/a.pdf", "/careers/a.pdf?d=1"]
    urls = spark.createDataFrame([(i, f"https://h.com{p}", "h.com") for i, p in enumerate(paths)], "i int, url string, domain string")
    got = [r.allowed for r in G.robots_allow(urls, files, "reader").orderBy("i").collect()]
    assert got == [True, False, True, False, True]
    got = [r.allowed for r in G.robots_allow(urls, files, "MyBot/2").orderBy("i").collect()]
    assert got == [True] * 5


def test_robots_rules_equal_regular_expressions(spark):
    import random
    import re

    rng = random.Random(1)
    rules = ["".join(rng.choices("/ab*.", k=rng.randrange(0, 6))) + rng.choice(["", "$"]) for _ in range(60)] + ["/*$", "*", "$", "/a**b", "/[x](y)+"]
    targets = ["/" + "".join(rng.choices("/ab.", k=rng.randrange(0, 7))) for _ in range(60)] + ["/[x](y)+z"]
    files = spark.createDataFrame([(f"h{i}.com", f"User-agent: *\nDisallow: {r}") for i, r in enumerate(rules)], "domain string, text string")
    urls = spark.createDataFrame([(i, t, f"https://h{i}.com{t}", f"h{i}.com") for i in range(len(rules)) for t in targets], "i int, t string, url string, domain string")
    for r in G.robots_allow(urls, files, "x").collect():
        rule = rules[r.i]
        core = ".*".join(map(re.escape, rule.removesuffix("$").split("*"))) + ("$" if rule.endswith("$") else "")
        assert r.allowed == (rule == "" or re.match(core, r.t) is None), (rule, r.t)


def test_price_lookup(spark):
    prices = spark.createDataFrame([("m-1", 1.0, 2.0), ("m-1-x", 5.0, 6.0)], "model_prefix string, price_in double, price_out double")
    usage = spark.createDataFrame([("m-1-2026", 10**6, 10**6), ("m-1-x-9", 10**6, 0), ("other", 10**6, 0)], "model string, tokens_in bigint, tokens_out bigint")
    got = {r.model: r.cost_usd for r in price_lookup(usage, prices).collect()}
    assert got == {"m-1-2026": 3.0, "m-1-x-9": 5.0, "other": 3.0}


PAGE = """<html><body><ul class="job-list">
<li class="job-item"><a href="/jobs/1">Backend Engineer</a><span class="job-location"><span class="sr-only">Location</span> Berlin</span>
<time class="job-date" datetime="2026-07-28">3 days ago</time></li>
<li class="job-item"><a href="/jobs/2">Data Analyst</a><span class="job-location">Paris</span></li></ul></body></html>"""


def page(spark, html):
    return spark.createDataFrame([(1, "https://h.com/careers", html)], "page_id bigint, url string, html string")


def test_selectors(spark):
    found = S.builtin_selector_ladder(page(spark, PAGE), "generic_html").orderBy("pos").collect()
    assert [(r.title, r.url, r.location, r.posted_at) for r in found] == [
        ("Backend Engineer", "https://h.com/jobs/1", "Berlin", "3 days ago"),
        ("Data Analyst", "https://h.com/jobs/2", "Paris", None),
    ]
    path = S.SelectorSet("//li[@class='job-item']", ".//a", location=".//span[@class='job-location']", posted_at=".//time/@datetime")
    got = S.select_records_path(page(spark, PAGE), path).orderBy("pos").collect()
    assert [(r.title, r.url, r.posted_at) for r in got] == [
        ("Backend Engineer", "https://h.com/jobs/1", "2026-07-28"), ("Data Analyst", "https://h.com/jobs/2", None),
    ]
    region = G.listing_region(page(spark, PAGE)).first()
    assert (region.tag, region.links, region.score_e2) == ("ul", 2, 240)
    for bad in (S.SelectorSet("li::before", "a"), S.SelectorSet("li[[[broken", "a"), S.SelectorSet(None, "a"), S.SelectorSet("li", None)):
        assert S.select_records(page(spark, PAGE), bad).collect() == []


def test_hidden_elements(spark):
    from postlens.sources.nodes import node_table

    html = "<ul><li class='sr-only'>hid<li class='job'>A<b>x</b></ul><div>tail</div><table><tr><td class='sr-only'>h<td>1<td>2</table>"
    rows = node_table(page(spark, html)).orderBy("pre").collect()
    assert [(r.pre, r.post, r.parent, r.tag, r.text) for r in rows] == [
        (0, 2, -1, "ul", "A x"), (1, 2, 0, "li", "A x"), (2, 2, 1, "b", "x"), (3, 3, -1, "div", "tail"),
        (4, 7, -1, "table", "1 2"), (5, 7, 4, "tr", "1 2"), (6, 6, 5, "td", "1"), (7, 7, 5, "td", "2"),
    ]
    second = S.select_records(page(spark, html), S.SelectorSet("tr", "td:nth-of-type(2)")).first()
    assert second.title == "2"


def test_every_location_of_a_posting(spark):
    import json

    body = json.dumps({"positions": [{"name": "Eng", "positionUrl": "/x", "id": "1", "locations": list("ABCDE")}]})
    payload = spark.createDataFrame([(1, "eightfold", 0, body, "https://h.com")], "company_id int, platform string, page_no int, body string, base_url string")
    assert B.eightfold_postings(payload).first().location == "A; B; C; D; E"


def test_written_order_of_alternatives(spark):
    html = '<div class="job-card"><a href="/x">See full role</a><h3><a href="/y">Engineer</a></h3></div>'
    row = S.select_records(page(spark, html), S.SelectorSet("div.job-card", "h3 a, a", "h3 a, a")).first()
    assert (row.title, row.url) == ("Engineer", "https://h.com/y")


def test_embedded_sources(spark):
    ld = '<script type="application/ld+json">{"@graph":[{"@type":["JobPosting"],"title":"Eng","identifier":{"name":"x"},"description":"&lt;p&gt;Hi&lt;/p&gt;","qualifications":"Q"}]}</script>'
    row = E.embedded_postings(page(spark, ld)).first()
    assert (row.title, row.url, row.external_id, row.description, row.source) == ("Eng", "https://h.com/careers", None, "Hi", "json_ld")
    assert E.posting_detail(page(spark, ld)).first().requirements == "Q"
    state = '<script>window.__INITIAL_STATE__ = {"f":[{"title":"A","url":"/a"}],"x":{"jobs":[{"title":"B","url":"/b","location":{"city":"X","country":"Y"}},{"title":"C","url":"/c"}]}};</script>'
    rows = E.embedded_postings(page(spark, state)).orderBy("pos").collect()
    assert [(r.title, r.url, r.source) for r in rows] == [("B", "https://h.com/b", "state"), ("C", "https://h.com/c", "state")]


def test_embedded_trees_have_no_limit(spark):
    import json

    def posting(title):
        return {"@type": "JobPosting", "title": title, "description": f"About {title}"}

    deep = posting("deep")
    for _ in range(30):
        deep = {"@graph": [[deep]]}
    nested = [{"@graph": [posting("A")]}, posting("B"), deep]
    html = f'<script type="application/ld+json">{json.dumps(nested)}</script><script type="application/ld+json">{{bad</script>'
    assert [r.title for r in E.json_ld_postings(page(spark, html)).orderBy("pos").collect()] == ["A", "B", "deep"]
    assert E.posting_detail(page(spark, html)).first().description == "About A"
    assert E.json_ld_postings(page(spark, None)).count() == 0

    state = {"jobs": [{"title": f"T{i}", "url": f"/{i}"} for i in range(60)]}
    for _ in range(20):
        state = {"a": [state], "other": [{"title": "x", "url": "/x"}]}
    html = f'<script id="__NEXT_DATA__">{json.dumps(state)}</script>'
    rows = E.state_postings(page(spark, html)).orderBy("pos").collect()
    assert [r.title for r in rows] == [f"T{i}" for i in range(60)]


def test_inline_state_object(column):
    html = 'x; phApp.ddo = {"a": "}", "b": {"c": "\\"}"}}; more = {};'
    assert column([html, "none"], E.inline_state_object) == ['{"a": "}", "b": {"c": "\\"}"}}', None]


def test_inline_state_object_of_a_long_text(spark, column):
    long = '{"t": "' + 'a } \\" b ' * 20_000 + '", \'}\': {}}'
    cases = [f"phApp.ddo  =\n{long} }}", "phApp.ddo = {'a': 1", "phApp.ddo = [{}]", 'phApp.ddo = {"a} {', None, "phApp.ddo = x; phApp.ddo={}"]
    assert column(cases, E.inline_state_object) == [long, None, None, '{"a}', None, "{}"]
    payloads = spark.createDataFrame([(1, '{"jobs": [{"title": "a"}]}')], "company_id int, body string")
    plan = B.phenom_postings(payloads)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_seeds(spark):
    def lines(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "line_no int, line string")

    got = intake.seed_list(lines("# c", "", "https://a.com | A | x", "https://a.com", "http://b.com")).orderBy("line_no").collect()
    assert [(r.url, r.name) for r in got] == [("https://a.com", "A | x"), ("http://b.com", None)]
    with pytest.raises(Exception, match="not a URL"):
        intake.seed_list(lines("ftp://x")).collect()
    for nothing in (lines("# c", ""), lines("x").limit(0)):
        with pytest.raises(Exception, match="no links"):
            intake.seed_list(nothing).collect()
    assert [r.skill for r in intake.skill_list(lines("Go", "C#", "go", "# no")).collect()] == ["Go", "C#"]


def test_board_registry_falls_back(spark):
    assert B.source_for("lever", B.taleo_postings) is B.lever_postings
    assert B.source_for("new kind", B.taleo_postings) is B.taleo_postings


def test_reingest_adds_nothing(spark):
    rows = job(spark, "Backend Engineer")
    assert new_postings(rows, rows, [F.col("title")]).count() == 0
    assert rows.select(*KEY).distinct().count() == 1


def test_no_cut_hides_rows(spark):
    links = spark.createDataFrame([(1, p, f"https://a.com/{p}") for p in range(1, 41)], "company_id int, page_no int, url string")
    assert intake.assemble_pages(links).count() == 40
    assert intake.assemble_pages(links, max_pages=3).count() == 3
    pages = spark.createDataFrame([(1, p, 20, 10_000) for p in range(40)], "company_id int, page_no int, n_items int, total int")
    assert intake.assemble_payload_pages(pages, 20).count() == 40
    texts = spark.createDataFrame([(1, "Knows Very Long Skill Name well"), (2, "skill name")], "k int, t string")
    table = {"very long skill name": "VLSN", "skill": "S"}
    got = {r.k: r.skills for r in skill_token_join(texts, "k", "t", table).collect()}
    assert got == {1: ["VLSN", "S"], 2: ["S"]}
    raw = spark.createDataFrame([("t", "u", "p", {"text": "x" * 50_000})], "title string, url string, posted_at string, raw map<string,string>")
    assert len(B.raw_payload_trim(raw).collect()[0].raw["text"]) == 50_000


def test_unknown_platforms_are_read_as_pages(spark):
    from postlens.sources import boards

    page = "<ul><li class='job-row'><a href='/j/1'>Data Engineer</a><span class='location'>Oslo</span></li></ul>"
    lever = '[{"id": "7", "text": "Analyst", "hostedUrl": "https://x.com/7"}]'
    rows = [(1, 0, "homegrown", page), (2, 0, None, page), (3, 0, "lever", lever)]
    payloads = spark.createDataFrame(rows, "company_id bigint, page_no int, platform string, body string").selectExpr(
        "*", "'https://a.com/list' AS base_url", "'t' AS token", "TIMESTAMP '2024-01-01 00:00:00' AS fetched_at"
    )
    got = {(r.company_id, r.title, r.url, r.location, r.tier) for r in boards.board_postings(payloads).collect()}
    assert got == {
        (1, "Data Engineer", "https://a.com/j/1", "Oslo", "css_selector"),
        (2, "Data Engineer", "https://a.com/j/1", "Oslo", "css_selector"),
        (3, "Analyst", "https://x.com/7", "", "api"),
    }


def test_scoring_moves_only_what_it_reads(spark):
    from postlens.plans import matching_checks as Q

    rows = Q.distinct_postings(spark, "/root/testdata/sf0.001", "seq")
    assert rows.columns == [*Q.SCORING, "seq"]


def test_enrichment_reads_a_shared_detail_once(spark):
    """Postings that share a detail: terms across text borders, own texts beside it, no repeated reading."""
    from postlens.functions.fields import detect_skills, parse_seniority
    from postlens.operators.enrichment import enrich_update, enrichment_report

    filler = "and more words that say nothing at all " * 3
    posts = spark.createDataFrame([
        (1, "a", "Machine", None, None, "unknown"), (2, "a", "Clerk", None, "Ruby and SQL", "unknown"),
        (3, "b", "Clerk", "Kept text, 9 years of experience", None, "unknown"), (4, "b", "Senior Clerk", None, "", "senior"),
        (5, "c", "Clerk", "Own Python", None, "unknown"), (6, None, "Clerk", "Own Python", None, "unknown"), (7, "d", "Clerk", "x", None, "unknown"),
    ], "seq long, part string, title string, description string, requirements string, seniority string").withColumns({
        "detected_skills": F.array(F.lit("old")), "posted_at": F.lit(None).cast("timestamp")})
    details = spark.createDataFrame([
        ("a", f"Learning with Apache Kafka. {filler} as a senior backend engineer, Django. {filler}", None),
        ("b", None, f"{filler} Kubernetes"), ("c", f"{filler} machine", f"learning {filler} 3+ years"), ("d", " ", ""),
    ], "part string, description string, requirements string").withColumn("posted_at", F.lit("2024-05-01T10:00:00Z"))
    out = enrich_update(posts, details, ["part"], F.lit("2026-07-30").cast("timestamp"))
    body = F.concat(F.coalesce("requirements", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    told = out.select(
        "*", detect_skills(F.col("title"), F.col("description"), F.col("requirements")).alias("all_skills"),
        parse_seniority(F.col("title"), body).alias("all_level")).orderBy("seq").collect()
    for r in told:
        assert r.enriched == (r.seq <= 5)
        assert r.detected_skills == (r.all_skills if r.enriched else ["old"])
        assert r.seniority == (r.all_level if r.enriched else "unknown")
    assert "machine learning" in told[0].detected_skills and "django" in told[0].detected_skills
    report = enrichment_report(out).first()
    assert (report.considered, report.fetched, report.enriched) == (7, 6, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    scan, above = plan.split("Join LeftOuter")[1], plan.split("Join LeftOuter")[0]
    assert "__level" in scan and "__d_key" in scan and "__d_key" in above


def test_payloads_of_all_boards_share_one_shuffle(spark):
    """What all platforms' payloads are made of is moved once, not once per platform."""
    from postlens.plans import board_checks as C

    def moved():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    sf = "/root/testdata/sf0.001"
    root, entry = C.ENTRIES["lever"]
    before = moved()
    C._payloads(spark, sf, "lever", entry(), root).write.format("noop").mode("overwrite").save()
    one = moved() - before
    before = moved()
    assert C.board_registry(spark, sf).agg(F.sum("n")).first()[0] > 0
    assert moved() - before < 4 * one


def test_embedded_pages_are_read_in_place(spark):
    """Each page is settled by one tier in its own task: no join, no window, pages of one id told apart."""
    state = '<script id="__NEXT_DATA__">{"jobs": [{"title": "S", "url": "/s"}]}</script>'
    pages = spark.createDataFrame([
        (1, "https://a.com", '<script type="application/ld+json">{"@type": "JobPosting", "title": "&hairsp;"}</script>' + state),
        (2, "https://a.com", '<script type="application/ld+json">[{"@type": "JobPosting", "title": ""}, {"@type": "JobPosting", "name": "L"}]</script>' + state),
        (3, "https://a.com", '<script id="__NEXT_DATA__">{"x": 1}</script><script>window.__NUXT__ = {"r": [{"title": "N", "url": "/n"}]};</script>'),
        (None, "https://a.com", state), (4, "https://a.com", None),
    ], "page_id long, url string, html string")
    out = E.embedded_postings(pages)
    got = {(r.page_id, r.source, r.title) for r in out.collect()}
    assert got == {(1, "state", "S"), (2, "json_ld", "L"), (3, "state", "N"), (None, "state", "S")}
    for frame in (out, E.state_postings(pages)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan


def test_details_read_each_text_once(spark):
    """the filter on details does not repeat the steps that make them."""
    rows = spark.createDataFrame([(1, "{}")], "page_id bigint, body string")
    for read in (E.eightfold_detail, E.apple_detail):
        plan = read(rows)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        filters = [line for line in plan if line.lstrip(" +-:").startswith("Filter")]
        assert any("</(p|div" in line for line in plan) and not any("</(p|div" in line for line in filters)


@pytest.mark.parametrize("text, lines", [
    (None, ""), ("  plain text ", "plain text"), ("a\tb", "a b"), ("a \n\n b", "a\nb"), ("a\u00a0b", "a b"), ("x < y", "x < y"),
    ("R&amp;D", "R&D"), ("&lt;p&gt;a&lt;/p&gt;b", "a\nb"), ("<p>a</p><b>c</b>", "a\nc"), ("&amp;lt;i&amp;gt;z", "z"),
])
def test_strip_html_steps_left_out(column, text, lines):
    from postlens.functions.text import strip_html

    assert column([text, "<p>x</p>"], strip_html) == [lines, "x"]


def test_repeated_texts_are_parsed_once(spark, monkeypatch):
    """where texts repeat, no row folds or cleans one again; results are those of parsing row by row."""
    schema = "company_id bigint, seq bigint, title string, url string, location string, salary string, description string, posted_at string"
    kinds = [
        ("Senior R&amp;D Engineer", "Berlin, Germany", "$60/hour", None, "Yesterday"),
        ("Analyst", None, None, "7+ years of Python", "2026-07-01"), ("Ana lyst", "Remote - US", "", "", None),
        (" ", "x", "x", "x", "x"), (None, "x", None, None, None),
    ]
    rows = spark.createDataFrame([
        (i % 4, i, t, f"https://a.b/{i}?utm_source=x&b=1", place, pay, text, day)
        for i in range(60) for t, place, pay, text, day in [kinds[i % 5]]
    ], schema)

    def read():
        return normalize_postings(rows, F.lit(TODAY).cast("date"), keep=("seq", "salary"))

    apart = read()
    assert "[^a-z0-9]+" not in apart._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(common, "APART", -1)
    whole = read()
    assert apart.schema.names == whole.schema.names
    got, want = (sorted(map(str, df.collect())) for df in (apart, whole))
    assert got == want and len(got) == 36


def test_embedded_fields_are_taken_in_the_walk(spark):
    """texts leave the walk as they are, other scalars as a VARIANT wrote them; no object is written and parsed again."""
    import json

    def posting(number, **fields):
        return {"@type": "JobPosting", "title": f"T{number}", **fields}

    odd = [1, 1.5, 1.50e3, 1e30, 10**25, True, "", "a", "\0b", "ü", "\0é", None, [], {}, [7], {"name": "n"}, 12345678901234567890]
    objects = [posting(i, identifier=v, datePosted=v, description=v, baseSalary={"value": {"minValue": v, "maxValue": 2}}) for i, v in enumerate(odd)]
    objects.append(posting(99, jobLocation=[{"address": {"addressLocality": 1.5, "addressCountry": {"name": "DE"}}}], identifier={"value": 2.50}))
    objects.append(posting(98, jobLocation={"address": "Main Street"}, employmentType="\ud800"))
    html = f'<script type="application/ld+json">{json.dumps(objects)}</script>'
    out = E.embedded_postings(page(spark, html))
    got = {r.title: r for r in out.collect()}
    texts = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(odd)], "i int, t string").select("i", F.try_parse_json("t").alias("v"))
    scalar = F.col("v").try_cast("array<variant>").isNull() & F.col("v").try_cast("map<string,variant>").isNull()
    for i, want in texts.select("i", F.when(scalar, F.col("v").try_cast("string"))).collect():
        row = got[f"T{i}"]
        assert (row.external_id, row.posted_at, row.salary) == (want, want, f"{want or ''}-2"), odd[i]
    assert (got["T99"].location, got["T99"].external_id) == ("1.5, DE", "2.5")
    assert (got["T98"].location, got["T98"].employment_type) == ("Main Street", "?")
    # a number beyond a double took its whole posting along
    far = page(spark, '<script type="application/ld+json">{"@type": "JobPosting", "title": "Far", "baseSalary": {"value": {"value": 1e400}}}</script>')
    assert [r.title for r in E.embedded_postings(far).collect()] == ["Far"]
    for frame in (out, E.json_ld_postings(far), E.state_postings(far), E.posting_detail(far)):
        assert "variant_get" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_detail_texts_are_taken_in_the_walk(spark):
    """the first JobPosting that says something, its scalars as text; the object itself isn't handed on as JSON."""
    html = (
        '<script type="application/ld+json">[{"@type": "JobPosting", "description": " <br> "}, {"@type": "JobPosting", "description": {"a": 1}},'
        ' {"@type": "JobPosting", "description": "<p>D</p>", "experienceRequirements": 2.50, "employmentType": ["x"], "datePosted": 17530}]</script>'
    )
    out = E.posting_detail(page(spark, html))
    row = out.first()
    assert (row.description, row.requirements, row.employment_type, row.posted_at) == ("D", "2.5", None, "17530")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" not in plan and "transform(" not in plan


def test_first_per_key_in_place(spark, tmp_path):
    """only rows whose key may stand twice are moved whole; the firsts are those of ``first_per_key``."""
    rows = [(k % 7, f"h{k % 97}" if k % 5 else None, k * 31 % 100, "x" * 50) for k in range(300)]
    rows += [(1, f"alone{k}", k, "y" * 50) for k in range(2_000)] + [(1, "tie", 5, "a"), (1, "tie", 5, "b"), (None, "tie", 1, "c"), (None, "tie", 0, "d")]
    frame = spark.createDataFrame(rows, "company_id bigint, content_hash string, seq bigint, text string")
    order = [F.col("seq"), F.col("text")]
    got = common.first_per_key_in_place(frame, KEY, order)
    assert sorted(map(str, got.collect())) == sorted(map(str, common.first_per_key(frame, KEY, order).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_candidates_are_scored_where_they_stand(spark, market):
    """no posting meets another frame by its key."""
    jobs, people = market
    plan = K.scores_at_least(jobs, people, F.lit(5_000))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [line for line in plan if line.lstrip(" +-:").startswith("Join")]
    assert len(joins) == 3 and not any("content_hash" in line or "company_id" in line for line in joins)


def test_matched_postings_need_no_join(spark, market):
    """``results_of`` and ``scores_of`` give what the operators over stored matches give."""
    jobs, people = market
    jobs = jobs.withColumn("is_active", F.col("company_id") % 2 == 0)
    found = K.scores_at_least(jobs, people, F.lit(1)).cache()
    stored = found.select(*KEY, "profile_id", "score")
    one = found.groupBy("profile_id").count().orderBy(F.col("count").desc(), "profile_id").first().profile_id
    asked = dict(min_score=0.3, location="e", title="e", limit=7, order=[F.col("seq"), F.col("content_hash")])
    want = M.results_query(jobs, stored, list(KEY), one, **asked).select(*KEY, "score").collect()
    assert want and M.results_of(found, one, **asked).select(*KEY, "score").collect() == want
    want = M.posting_scores(jobs, stored, list(KEY), one, min_score=0.3).select(*KEY, "score").collect()
    assert want and sorted(M.scores_of(found, one, 0.3).select(*KEY, "score").collect()) == sorted(want)


def test_a_second_opinion_is_given_where_candidates_stand(spark, market):
    """candidates go on to the matcher; postings are not joined with the pairs found among them."""
    jobs, people = market
    pairs = K.scores_at_least(jobs, people, F.lit(5_000)).select(*PAIR)
    columns = [*PAIR, "score_e4", "is_match", "reasoning"]
    got = X.match("skills", jobs, people, 5_000).select(*columns)
    want = X.score_pairs("skills", jobs, people, pairs).select(*columns)
    assert sorted(got.collect()) == sorted(want.collect()) and not got.isEmpty()
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if x.lstrip(" +-:").startswith("Join")]
    assert joins and not any("content_hash" in x for x in joins)
