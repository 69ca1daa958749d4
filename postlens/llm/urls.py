"""URL filter: prefix rules, then trust propagated over the host link graph.

A rule fits its host and all subdomains when the path starts with the rule's; the longest rule wins.
Hosts of allowed pages are trusted, hosts of blocked pages are distrusted, both in proportion to their
pages.  Trust follows links (personalised PageRank from the trusted hosts), distrust runs against them
(from the blocked hosts: who links to a blocked host is suspect).  A page without a rule is blocked when
its host's distrust is at least ``BLOCK_SHARE`` of what it has of both, and allowed otherwise.

All of it is DataFrame work.  Mass is a double, so none is lost however small a share gets; a walk goes on
until no host gains more than ``BOUND`` of what it has.  The share of distrust is compared when rounded to
nine digits, so the order of sums does not show in the verdict.
A null URL or one without ``://`` has an empty host and path and no rule; a null html has no links;
links to the own host (relative ones too) don't count.  Repeated rows are pages of their own, ties of
equally long rules go to block, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import written

KEEP = 85              # hundredths of the mass that go on over links
BOUND = 1e-6
BLOCK_SHARE = 500      # thousandths
ALLOW, BLOCK = "allow", "block"

#: (action, rule): host and path as one string
RULES = [
    (ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"), (BLOCK, "com/de/"),
]

LINKS = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def located(pages: DataFrame) -> DataFrame:
    rest = F.coalesce(after_scheme(F.col("url")), F.lit(""))
    return pages.withColumn("_rest", rest).withColumns({
        "host": host_of(F.col("_rest")),
        "path": F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1),
    }).drop("_rest")


def ruled(pages: DataFrame, rules=None) -> DataFrame:
    """Adds rule and action of the longest fitting rule, null without one."""
    chain_rule, chain_action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules or RULES, key=lambda r: (len(r[1]), r[0] == BLOCK)):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        chain_rule = F.when(fits, rule).otherwise(chain_rule)
        chain_action = F.when(fits, action).otherwise(chain_action)
    return pages.withColumns({"rule": chain_rule, "action": chain_action})


def host_links(pages: DataFrame) -> DataFrame:
    """(host, to, n): links between different hosts."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINKS), 1))).alias("link"))
    to = host_of(F.substring("link", F.instr("link", "//") + 2, F.length("link")))
    return (
        links.select("host", to.alias("to")).where("host != to and host != '' and to != ''")
        .groupBy("host", "to").agg(F.count("*").alias("n"))
    )


def propagate(links: DataFrame, seeds: DataFrame, bound: float = BOUND) -> DataFrame:
    """(host, mass): personalised PageRank of ``seeds`` (host, seed) over ``links`` (host, to, n).

    In each round a part of the flow stays where it is and the rest follows the links, in proportion to
    their number; the flow that is left shrinks by ``KEEP`` each round, so the rounds end.
    """
    out = links.groupBy("host").agg(F.sum("n").alias("all"))
    share = written(links.join(out, "host").select("host", "to", (F.col("n") / F.col("all")).alias("part")), "links")
    stays = 1 - KEEP / 100
    state = seeds.select("host", (F.col("seed") * stays).alias("mass"), F.col("seed").alias("flow"))
    if share.isEmpty():     # nothing moves: what stays at the seeds is the fixed point
        return state.select("host", "mass")
    while not state.where(F.col("flow") * stays > bound * F.col("mass")).isEmpty():
        sent = state.where("flow > 0").join(share, "host").groupBy(F.col("to").alias("host")).agg(
            (F.sum(F.col("flow") * F.col("part")) * (KEEP / 100)).alias("flow")
        )
        before = state.select("host", "mass", F.lit(0.0).alias("flow"))
        after = before.union(sent.select("host", (F.col("flow") * stays).alias("mass"), "flow"))
        state = written(after.groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("flow").alias("flow")), "mass")
    return state.select("host", "mass")


def seeded(pages: DataFrame, action: str) -> DataFrame:
    """(host, seed): the share of a host in the pages with this action."""
    counts = pages.where((F.col("action") == action) & (F.col("host") != "")).groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("host", (F.col("n") / F.col("total")).alias("seed"))


def host_masses(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) of located and ruled pages."""
    links = written(host_links(pages), "host-links")
    trust, distrust = (written(seeded(pages, a), "seeds") for a in (ALLOW, BLOCK))
    trust = propagate(links, trust).withColumnRenamed("mass", "trust")
    back = links.select(F.col("to").alias("host"), F.col("host").alias("to"), "n")
    distrust = propagate(back, distrust).withColumnRenamed("mass", "distrust")
    return trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])


def judge(pages: DataFrame, rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    known = ruled(located(pages.select("page_id", "url", "html")), rules)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    blocked = (F.col("distrust") > 0) & (share >= BLOCK_SHARE / 1000)
    hosts = host_masses(known).select("host", F.when(blocked, BLOCK).otherwise(ALLOW).alias("by_host"))
    return known.drop("html", "url").join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "by_host", F.lit(ALLOW)).alias("verdict")
    )


def _mass_sql(name: str, links: str, seeds: str) -> str:
    """Common tables for the rounds of ``propagate`` and, under ``name``, the masses of its last one."""
    stays, keep = 1 - KEEP / 100, KEEP / 100
    return f"""{name}_rounds AS (
      SELECT 0 AS k, host, seed * {stays} AS mass, CASE WHEN EXISTS (SELECT 1 FROM {links}) THEN seed ELSE 0 END AS flow FROM {seeds}
      UNION ALL
      SELECT k, host, sum(mass) AS mass, sum(flow) AS flow FROM (
        SELECT k + 1 AS k, host, mass, 0.0 AS flow FROM {name}_rounds
        UNION ALL
        SELECT m.k + 1, l.to_host, m.flow * l.part * {keep} * {stays}, m.flow * l.part * {keep}
        FROM {name}_rounds m JOIN {links} l ON l.host = m.host
      ) WHERE EXISTS (SELECT 1 FROM {name}_rounds WHERE flow * {stays} > {BOUND} * mass) GROUP BY k, host
    ), {name} AS MATERIALIZED (SELECT host, mass FROM {name}_rounds WHERE k = (SELECT max(k) FROM {name}_rounds))"""


def _rule_sql() -> str:
    cases = []
    for action, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[0] == ALLOW)):
        host, _, path = rule.partition("/")
        cases.append(
            f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') "
            f"THEN struct_pack(rule := '{rule}', action := '{action}')"
        )
    return "CASE " + " ".join(cases) + " END"


SQL = rf"""
WITH RECURSIVE rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), place AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), known AS MATERIALIZED (SELECT *, {_rule_sql()} AS hit FROM place),
found AS (
  SELECT host, unnest(list_distinct(regexp_extract_all(html, '(?i)(?:href|src|action)\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1))) AS link FROM known
), pairs AS (
  SELECT host, translate(regexp_extract(substr(link, instr(link, '//') + 2), '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS to_host FROM found
), counted AS (
  SELECT host, to_host, count(*) AS n FROM pairs WHERE host <> to_host AND host <> '' AND to_host <> '' GROUP BY ALL
), ahead AS MATERIALIZED (SELECT host, to_host, n::DOUBLE / sum(n) OVER (PARTITION BY host) AS part FROM counted),
back AS MATERIALIZED (SELECT to_host AS host, host AS to_host, n::DOUBLE / sum(n) OVER (PARTITION BY to_host) AS part FROM counted),
seeds AS (SELECT hit.action AS action, host, count(*) AS n FROM known WHERE hit IS NOT NULL AND host <> '' GROUP BY ALL),
share AS MATERIALIZED (SELECT action, host, n::DOUBLE / sum(n) OVER (PARTITION BY action) AS seed FROM seeds),
good AS (SELECT host, seed FROM share WHERE action = '{ALLOW}'), bad AS (SELECT host, seed FROM share WHERE action = '{BLOCK}'),
{_mass_sql('trust', 'ahead', 'good')},
{_mass_sql('distrust', 'back', 'bad')},
hosts AS (
  SELECT host, coalesce(t.mass, 0) AS trust, coalesce(d.mass, 0) AS distrust
  FROM trust t FULL JOIN distrust d USING (host)
)
SELECT page_id, k.host, path, hit.rule AS rule, coalesce(hit.action, CASE WHEN distrust > 0
  AND round(distrust / (trust + distrust), 9) >= {BLOCK_SHARE / 1000} THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict
FROM known k LEFT JOIN hosts h ON h.host = k.host
"""
