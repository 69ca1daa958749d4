"""SQL text builders for the checks (DuckDB dialect)."""

from __future__ import annotations

from postlens.functions import fixed_values as V
from postlens.functions.fields import skill_dictionary
from postlens.plans.views import with_views

BLANKS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def key(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def has(padded_key: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({padded_key}, {text(f' {p} ')})" for p in phrases) + ")"


def ladder(padded_key: str, table, default: str | None) -> str:
    cases = " ".join(f"WHEN {has(padded_key, words)} THEN {text(level)}" for level, words in table)
    return f"CASE {cases} ELSE {text(default) if default else 'NULL'} END"


def case_of(x: str, table: dict) -> str:
    def lit(v):
        return text(v) if isinstance(v, str) else str(v)

    return f"CASE {x} " + " ".join(f"WHEN {text(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"


def domain(url: str) -> str:
    h = f"regexp_replace({host(url)}, '^www\\.', '')"
    labels = f"string_split({h}, '.')"
    two = f"array_to_string({labels}[-2:], '.')"
    return (
        f"CASE WHEN {two} IN {in_list(V.MULTI_PART_SUFFIXES)} "
        f"THEN array_to_string({labels}[-3:], '.') ELSE {two} END"
    )


def canonical(url: str) -> str:
    """For links with plain ASCII query strings, which is what the data has."""
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    kept = (
        f"list_sort(list_filter(string_split({query}, '&'), lambda p: split_part(p, '=', 2) <> '' "
        f"AND split_part(p, '=', 1) NOT IN {in_list(V.TRACKING_PARAMS)}))"
    )
    path = f"regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
    return (
        f"lower(regexp_extract({url}, '^([a-zA-Z]+)://', 1)) || '://' || {host(url)} || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END"
    )


def titleish(x: str) -> str:
    word = (
        "CASE WHEN length(w) <= 4 AND upper(w) = w AND lower(w) <> w THEN w "
        "ELSE upper(w[1]) || lower(w[2:]) END"
    )
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {word}), ' ')"


ARRANGEMENTS = V.REMOTE_WORDS + V.HYBRID_WORDS + V.ONSITE_WORDS


def remote_of(x: str) -> str:
    def any_in(words):
        return "(" + " OR ".join(f"contains({key(x)}, {text(w)})" for w in words) + ")"

    return (
        f"CASE WHEN {any_in(V.HYBRID_WORDS)} THEN 'hybrid' WHEN {any_in(V.REMOTE_WORDS)} THEN 'remote' "
        f"WHEN {any_in(V.ONSITE_WORDS)} THEN 'onsite' ELSE 'unknown' END"
    )


def location_ctes(source: str, loc: str, out: str) -> str:
    """CTE chain that adds city, region, country, remote_type to ``source``."""
    country = case_of("k", V.COUNTRY_ALIASES)
    return rf"""
{out}_1 AS (SELECT *, list_filter(list_transform(string_split_regex({loc}, '\s*(?:,|\||/|•|;|–|—| - )\s*'),
    lambda s: {{'t': trim(s), 'k': {key('s')}}}), lambda s: s.k <> '' AND s.k NOT IN {in_list(ARRANGEMENTS)}) AS segs
  FROM {source}),
{out}_2 AS (SELECT *, list_transform(segs, lambda s: {country.replace('CASE k', 'CASE s.k')}) AS ctry,
    len(list_filter(segs, lambda s: s.k NOT IN {in_list(V.PLACEHOLDER_LOCATIONS)})) > 0 AS real_place FROM {out}_1),
{out}_3 AS (SELECT *, list_max(list_transform(ctry, lambda c, i: CASE WHEN c IS NOT NULL THEN i END)) AS cpos FROM {out}_2),
{out}_4 AS (SELECT *, CASE WHEN real_place THEN list_filter(segs, lambda s, i: cpos IS NULL OR i <> cpos) END AS rest FROM {out}_3),
{out} AS (SELECT * EXCLUDE (segs, ctry, real_place, cpos, rest),
    CASE WHEN rest[2].t IS NULL AND rest[1].k IN {in_list(V.US_STATE_CODES)} THEN NULL ELSE {titleish('rest[1].t')} END AS location_city,
    CASE WHEN rest[2].t IS NULL AND rest[1].k IN {in_list(V.US_STATE_CODES)} THEN {titleish('rest[1].t')} ELSE {titleish('rest[2].t')} END AS location_region,
    CASE WHEN real_place THEN ctry[cpos] END AS location_country,
    {remote_of(loc)} AS remote_type FROM {out}_4)"""


def currency(x: str) -> str:
    codes = " ".join(
        f"WHEN regexp_matches(upper({x}), '\\b{c}\\b') THEN '{c}'" for c in V.CURRENCY_CODES
    )
    symbols = " ".join(f"WHEN contains({x}, {text(s)}) THEN '{c}'" for s, c in V.CURRENCY_SYMBOLS)
    return f"CASE {codes} {symbols} END"


def period(x: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({x}, {text('(?i)' + p)}) THEN '{n}'" for n, p in V.SALARY_PERIODS
    ) + " ELSE 'unknown' END"


def salary_ctes(source: str, sal: str, out: str) -> str:
    token = text(r"(?:\d{1,3}(?:[.,\s]\d{2,3})+|\d+(?:\.\d+)?)\s*[kKmM]?")
    number = r"regexp_replace(t, '\s*[kKmM]?$', '')"
    plain = (
        rf"CASE WHEN regexp_matches({number}, '[.,\s]\d{{3}}(?:\D|$)') "
        rf"THEN regexp_replace({number}, '[.,\s]', '', 'g') "
        rf"ELSE replace(replace({number}, ',', '.'), ' ', '') END"
    )
    factor = "CASE WHEN regexp_matches(t, '[kK]$') THEN 1000.0 WHEN regexp_matches(t, '[mM]$') THEN 1000000.0 ELSE 1.0 END"
    return f"""
{out}_1 AS (SELECT *, list_filter(list_transform(regexp_extract_all(coalesce({sal}, ''), {token}),
    lambda t: round_even(try_cast({plain} AS DOUBLE) * {factor}, 0)), lambda a: a > 0 AND a <= {V.MAX_AMOUNT}) AS amt,
    {currency(sal)} AS salary_currency, CASE WHEN {sal} IS NULL THEN 'unknown' ELSE {period(sal)} END AS stated FROM {source}),
{out}_2 AS (SELECT *, CASE WHEN amt[2] < amt[1] THEN amt[2] ELSE amt[1] END AS low,
    CASE WHEN amt[2] < amt[1] THEN amt[1] ELSE amt[2] END AS high FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN stated = 'unknown' AND low >= {V.MIN_IMPLIED_YEARLY} THEN 'year' ELSE stated END AS unit FROM {out}_2),
{out} AS (SELECT * EXCLUDE (amt, stated, low, high, unit),
    CASE WHEN unit = 'year' AND low < {V.MIN_YEARLY_AMOUNT} THEN NULL ELSE CAST(low AS INTEGER) END AS salary_min,
    CASE WHEN unit = 'year' AND low < {V.MIN_YEARLY_AMOUNT} THEN NULL ELSE CAST(high AS INTEGER) END AS salary_max,
    CASE WHEN unit = 'year' AND low < {V.MIN_YEARLY_AMOUNT} THEN 'unknown' ELSE unit END AS salary_period FROM {out}_3)"""


def posted_date(x: str, today: str) -> str:
    """For the shapes the derived postings have: relative, yesterday, ISO, epoch."""
    iso = f"try_cast(regexp_extract({x}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE)"
    return f"""CAST(CASE
      WHEN regexp_matches({x}, '^\\d{{9,}}$') THEN CAST(make_timestamp(CAST(CASE WHEN length({x}) >= 12 THEN CAST({x} AS BIGINT) * 1000 ELSE CAST({x} AS BIGINT) * 1000000 END AS BIGINT)) AS DATE)
      WHEN lower({x}) = 'yesterday' THEN {today} - 1
      WHEN regexp_matches(lower({x}), '\\d+ days? ago') THEN {today} - CAST(regexp_extract({x}, '(\\d+)', 1) AS INTEGER)
      WHEN {iso} > {today} THEN {iso} - INTERVAL 1 YEAR
      WHEN year({iso}) >= year({today}) - {V.MAX_AGE_YEARS} THEN {iso} END AS DATE)"""


def title_level(title: str) -> str:
    k = key(title)
    for family in V.STAFF_JOB_FAMILIES:
        k = f"replace({k}, {text(family)}, ' ')"
    words = ladder(f"(' ' || {k} || ' ')", V.SENIORITY_WORDS, None)
    suffix = (
        f"lower(regexp_extract({title}, '(?i)(?:engineer|developer|scientist|analyst|designer|sde|mts|swe)"
        r"\s*[.\-–]?\s*(\b[1-6]\b|\b(?:i{1,3}|iv|v)\b)', 1))"
    )
    return f"coalesce({words}, {case_of(suffix, V.LADDER_LEVELS)})"


def years(x: str) -> str:
    """Without lookaround: mentions followed by "ago" or "old" are removed first."""
    strict = (
        r"(\d{1,2})\s*(?:\+|-|–|—|to)?\s*(?:\d{1,2})?\s*\+?\s*(?:years?|yrs?)\s*(?:of\s+)?"
        r"(?:[a-z]+\s+){0,3}?(?:experience|exp)\b"
    )
    loose = r"(\d{1,2})\s*(?:\+|-|–|—|to)?\s*(?:\d{1,2})?\s*\+?\s*(?:years?|yrs?)\b"

    def smallest(pattern, source):
        return (
            f"list_min(list_filter(list_transform(regexp_extract_all({source}, {text('(?i)' + pattern)}, 1), "
            f"lambda y: CAST(y AS INTEGER)), lambda y: y <= {V.MAX_YEARS_ASKED}))"
        )

    left = f"regexp_replace({x}, {text('(?i)' + loose + r'[^a-zA-Z0-9_]{0,3}(?:ago|old)' + chr(92) + 'b')}, '', 'g')"
    return f"coalesce({smallest(strict, x)}, {smallest(loose, left)})"


def level_of_years(y: str) -> str:
    return (
        f"CASE WHEN {y} <= 0 THEN 'intern' WHEN {y} <= 2 THEN 'junior' WHEN {y} <= 5 THEN 'mid' "
        f"WHEN {y} <= 8 THEN 'senior' WHEN {y} IS NOT NULL THEN 'staff' END"
    )


def prose_level(x: str) -> str:
    phrase = (
        r"(?i)\b(senior|sr|staff|principal|lead|junior|jr|associate|entry[- ]level)\b[\s\w]{0,24}?"
        r"\b(?:engineer|developer|scientist|architect|analyst|designer|manager|programmer|consultant|specialist)\b"
    )
    return case_of(f"replace(lower(regexp_extract({x}, {text(phrase)}, 1)), '-', ' ')", V.PHRASE_LEVELS)


def seniority(title: str, description: str) -> str:
    return (
        f"coalesce({title_level(title)}, {prose_level(description)}, "
        f"{level_of_years(years(description))}, 'unknown')"
    )


def skills(x: str) -> str:
    """List of dictionary terms in a text, in dictionary order."""
    k = f"(' ' || {key(x)} || ' ')"
    items = ", ".join(
        f"CASE WHEN contains(hay, {text(f' {s} ')}) THEN {text(name)} END"
        for s, name in skill_dictionary().items()
    )
    return f"(SELECT list_filter([{items}], lambda s: s IS NOT NULL) FROM (SELECT {k} AS hay))"


def posting_ctes() -> str:
    """``WITH`` chain ending in ``postings``: typed postings over ``v_postings``."""
    joined = "concat_ws(' ', title, description)"
    return (
        with_views("v_postings") + ",\n"
        + "src AS (SELECT * FROM v_postings),"
        + location_ctes("src", "location", "placed") + ","
        + salary_ctes("placed", "salary", "paid") + f""",
postings AS (SELECT seq, seen_at, company_id, title, url AS raw_url, {canonical('url')} AS url,
    external_id AS external_job_id, location AS location_raw, location_city, location_region, location_country, remote_type,
    {ladder(f"(' ' || {key(joined)} || ' ')", V.EMPLOYMENT_WORDS, 'unknown')} AS employment_type,
    {seniority('title', 'description')} AS seniority,
    description, salary AS salary_raw, salary_min, salary_max, salary_currency, salary_period,
    {posted_date('posted_at', "DATE '2026-07-30'")} AS posted_date,
    CASE WHEN regexp_matches(posted_at, '^\\d{{13}}$') THEN make_timestamp(CAST(posted_at AS BIGINT) * 1000) END AS posted_at,
    sha256('1|' || CAST(company_id AS VARCHAR) || '|' || CASE WHEN external_id IS NOT NULL THEN 'id:' || external_id
      ELSE {key('title')} || '|' || {key('location')} || '|' || {canonical('url')} END) AS content_hash
  FROM paid)"""
    )
