"""Literal rows with literal expectations for the column functions."""

import datetime as dt

from pyspark.sql import functions as F

from postlens.functions import dates, fields, hashing, labels, location, plausibility, salary
from postlens.functions import text as T, urls


def test_clean_text_and_strip_html(column):
    assert column(["Berlin,\xa0Germany ", "a&amp;b &eacute; ﬁ", None], T.clean_text) == [
        "Berlin, Germany", "a&b é fi", "",
    ]
    assert column(
        ["&lt;p&gt;We use &lt;strong&gt;Python&lt;/strong&gt; and AWS.&lt;/p&gt;", "<li>First</li><li>Second</li>", None],
        T.strip_html,
    ) == ["We use Python and AWS.", "First\nSecond", ""]


def test_normalize_key_and_keywords(column):
    assert column(["Sr. Software Engineer (m/f/d)", "Café ﬁ ½", "日本"], T.normalize_key) == [
        "sr software engineer m f d", "cafe fi 1 2", "",
    ]
    assert column([("Leadership skills", "lead"), ("Team Lead wanted", "lead"), ("x", "")], T.contains_keyword) == [
        False, True, False,
    ]


def test_clock_of_a_timestamp_is_read_once(column):
    now = F.lit("2026-07-30 00:00:00").cast("timestamp")
    read = dates.parse_posted_datetime(F.col("a0"), now)
    assert str(read).count(dates._CLOCK) <= 4
    values = ["2024-05-01T10:00:00+0200", "1 May 2024 9:05 pm", "2024-05-01 12:30 am utc", "2027-01-01 10:00", "10:00", "x", None]
    assert column(values, lambda c: dates.parse_posted_datetime(c, now).cast("string")) == [
        "2024-05-01 08:00:00", "2024-05-01 21:05:00", "2024-05-01 00:30:00", None, None, None, None,
    ]


def test_blanks_are_told_apart_behind_printable_letters(column):
    points = [chr(p) for p in range(1, 0x3100) if not 0xD800 <= p <= 0xDFFF]
    told = column(points, lambda c: c.rlike(f"^{T._BLANK}$"))
    old = column(points, lambda c: c.rlike(f"^[{T._BLANKS}]$"))
    assert told == old
    assert column(["a\u2003 b\u00a0c  d"], T.collapse_blanks) == ["a b c d"]


def test_keywords_fold_a_long_text_once(column):
    import time

    words = F.array(*[F.lit(f"word {n}") for n in range(20)])
    text = "größe naïve " * 30_000 + "Word 7"
    start = time.time()
    assert column([text], lambda c: T.find_keywords(c, words)) == [["word 7"]]
    assert time.time() - start < 12


def test_normalize_key_matches_unicode_definition(column):
    import re
    import unicodedata

    samples = ["Ǆ ǅ ① ⑩ ㎏ ŉ Ⅷ ＡＢＣ", "naïve Ångström K", "𝐁𝐨𝐥𝐝 ñ", "İstanbul straße"]

    def fold(v):
        parts = unicodedata.normalize("NFKD", v.lower())
        kept = "".join(c for c in parts if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9]+", " ", kept)).strip()

    assert column(samples, T.normalize_key) == [fold(s) for s in samples]


def test_truncate(column):
    assert column(["abcdef", "abc", "ab  cdef"], lambda c: T.truncate(c, 4)) == ["abc…", "abc", "ab…"]


def test_plain_links_have_the_general_form(spark):
    """The compiled form of plain links agrees with the general one, and is taken for no other link."""
    plain = [
        "https://H.com", "http://h.com/?", "https://h.com/a//b?b=2&a=1#x?y=1", "https://h.com?a=1&a1=2&a=0&a-=3&A=1&a.=4",
        "https://h.com/?utm_source=x&b=2&ref=1", "https://h.com/?xref=1&ref=2&_ga=3", "http://h.com/%20\u00e4/..?k=~._-#f\nx",
    ]
    other = [
        "https://h.com:443/", "ftp://h.com/", "//h.com", "https://u@h.com/", "https://h.com/a;p", "https://h.com/?a=%20", "https://h.com/?a=",
        "https://h.com/?=1", "https://h.com/?a=b=c", "https://h.com/?&a=1", "https://\u00e9.com/", "", "https://h.com/?" + "a=1&" * 60 + "b=1",
    ]
    rows = spark.createDataFrame([(u,) for u in [*plain, *other, None]], "u string").select(
        "u", F.col("u").rlike(urls._PLAIN_LINK).alias("p"), urls.canonicalize_url(F.col("u")).alias("got"),
        urls._canonical_any(F.col("u")).alias("want"),
    ).collect()
    assert [r.u for r in rows if r.p] == plain
    assert [r.got for r in rows] == [r.want for r in rows]


def test_clean_text_of_tidy_and_untidy(column):
    texts = ["a b", " a  b ", "a\tb", "a\x1fb", "a\u00a0b", "a &amp; b", "caf\u00e9", "\ufb01n", "", None, "&eacute;  x"]
    assert column(texts, T.clean_text) == ["a b", "a b", "a b", "a b", "a b", "a & b", "caf\u00e9", "fin", "", "", "\u00e9 x"]


def test_urls(column):
    assert column(["https://careers.acme.co.uk/jobs", "https://jobs.eu.lever.co/acme", "nohost"], urls.registrable_domain) == [
        "acme.co.uk", "lever.co", "",
    ]
    assert column(
        ["https://X.com/jobs/1/?utm_source=li&gh_src=a&id=7#apply", "https://x.com:443?b=2&a=1&c=", "http://x.com:8080/a;p?q=a%20b+c&z=~*%zz"],
        urls.canonicalize_url,
    ) == ["https://x.com/jobs/1/?id=7", "https://x.com/?a=1&b=2", "http://x.com:8080/a?q=a+b+c&z=~%2A%25zz"]
    base = F.lit("https://h.com/one/two/three?x=1#f")
    assert column(["../a/b", "/x", "?p=1", "#t", "mailto:x", "//q.com/2", "b.html", ""], lambda c: urls.absolutize(c, base)) == [
        "https://h.com/one/a/b", "https://h.com/x", "https://h.com/one/two/three?p=1", None, None,
        "https://q.com/2", "https://h.com/one/two/b.html", None,
    ]
    assert column(["https://jobs.lever.co/widget-co", "https://www.foo-bar.com/x"], urls.infer_name) == ["Widget Co", "Foo Bar"]
    assert column(
        ["https://boards.greenhouse.io/embed/job_board/js?for=acme", "https://job-boards.eu.greenhouse.io/acme/jobs"],
        lambda c: urls.board_token("greenhouse", c, F.lit("")),
    ) == ["acme", "acme"]


def test_posted_dates(column):
    today = F.lit("2026-07-30").cast("date")
    got = column(
        ["Posted 3 Days Ago", "2 weeks ago", "1 month ago", "July 28", "28 July 2026", "December 15",
         "1753000000000", "12345", "ASAP", "Posted within the last 30 days", "Feb 29, 2028", "1999-01-01"],
        lambda c: dates.parse_posted_date(c, today),
    )
    d = dt.date
    assert got == [d(2026, 7, 27), d(2026, 7, 16), d(2026, 6, 30), d(2026, 7, 28), d(2026, 7, 28), d(2025, 12, 15),
                   d(2025, 7, 20), None, None, d(2026, 7, 30), None, None]
    now = F.lit("2026-07-30 12:00:00").cast("timestamp")
    assert column(
        ["2026-07-28T10:00:00+05:30", "2026-08-28T10:00:00Z", "July 28", "July 28, 2026 10:30 PM"],
        lambda c: dates.parse_posted_datetime(c, now).cast("string"),
    ) == ["2026-07-28 04:30:00", None, None, "2026-07-28 22:30:00"]


def test_locations(column):
    got = column(
        ["Bengaluru, Karnataka, India", "Remote (India)", "Hybrid Remote, London", "Multiple Locations", "NYC, NY", "CA"],
        location.parse_location, prepare=T.clean_text,
    )
    assert [(r.city, r.region, r.country, r.remote_type) for r in got] == [
        ("Bengaluru", "Karnataka", "India", "unknown"), (None, None, "India", "remote"),
        ("Hybrid Remote", "London", None, "hybrid"), (None, None, None, "unknown"),
        ("NYC", "NY", None, "unknown"), (None, "CA", None, "unknown"),
    ]


def test_salaries(column):
    got = column(
        ["£45k–£60k per annum", "$60/hour", "€80.000 per year", "USD 150000 to 120000", "Competitive", "1250000",
         "45-60k", "120,000.50", "$60 /hour"],
        salary.parse_salary, prepare=T.clean_text,
    )
    assert [(r.minimum, r.maximum, r.currency, r.period) for r in got] == [
        (45000, 60000, "GBP", "year"), (60, None, "USD", "hour"), (80000, None, "EUR", "year"),
        (120000, 150000, "USD", "year"), (None, None, None, "unknown"), (1250000, None, None, "year"),
        (45, 60000, None, "unknown"), (12000050, None, None, "year"), (60, None, "USD", "unknown"),
    ]


def test_seniority_years_skills(column):
    assert column(
        [("Software Development Engineer 4 - Fullstack", None), ("Software Development Engineer.5", None),
         ("Member of Technical Staff II", None), ("Staff Backend Engineer", None), ("Software Engineer", None),
         ("Engineer", "we want a Senior Backend Engineer"), ("Engineer", "7+ years of Python")],
        fields.parse_seniority,
    ) == ["staff", "principal", "junior", "staff", "unknown", "senior", "senior"]
    assert column(
        ["5+ years overall, 3+ years of Python, 8 years preferred",
         "Founded 12 years ago. You have 4+ years of experience.", "We were founded 12 years ago."],
        fields.parse_years_required,
    ) == [3, 4, None]
    assert column(["Python, Go and C++/C#, Spring Boot, CI/CD, node.js"], fields.detect_skills) == [
        ["python", "go", "c++", "node.js", "spring", "spring boot", "ci/cd"]
    ]
    assert column([("intern", "Software Engineer"), ("", "Part-time Barista"), ("", "Engineer")], fields.parse_employment_type) == [
        "internship", "part_time", "unknown",
    ]


def test_content_hash(column):
    def of(company):
        return lambda title, place, ext: hashing.content_hash_of(F.lit(company), title, place, F.lit("https://x.com/1"), ext)

    one = column([("A", "Berlin", "R-1"), ("B", "Paris", "R-1"), ("A", "Berlin", None)], of(1))
    other = column([("A", "Berlin", "R-1")], of(2))
    assert one[0] == one[1] != one[2] and one[0] != other[0]


def test_plausible_titles_and_pages(column):
    assert column(["Backend Engineer", "View all jobs", "Analyst", "Careers", "ab"], plausibility.looks_like_title) == [
        True, False, True, False, False,
    ]
    assert column(["<div id='root'></div>", "<p>cf-browser-verification</p>", "captcha" + "x" * 3000], plausibility.looks_blocked) == [
        False, True, False,
    ]
    assert column(["<div id='root'></div>", "<p>plain</p>"], plausibility.looks_like_spa) == [True, False]


def test_model_json_and_scores(column):
    texts = ['{"a":1}', '```json\n{"a":1}\n```', "```\n[1]\n```", 'sure: {"a":1} ok', "x [1,2] y", "none"]
    assert column(texts, lambda c: F.to_json(labels.model_json(c))) == ['{"a":1}', '{"a":1}', "[1]", '{"a":1}', "[1,2]", None]
    assert column(["0.5", "85", "900", "x", "-1"], labels.as_score) == [0.5, 0.85, 1.0, 0.0, 0.0]
