"""Page classification: platform, robots rules, listing region."""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.plausibility import looks_like_spa
from postlens.functions.text import bind, contains_any
from postlens.functions.urls import board_token, path, query
from postlens.sources.nodes import map_pages
from postlens.sources.paths import Tree

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def platform_detect(pages: DataFrame, rendered: bool = False) -> DataFrame:
    """Platform of each page by link markers, then by markers in the source.

    The markers are a fixed list of about thirty texts, so they are predicates in
    registry order, not a join.  ``rendered`` says that ``html`` is the rendered page.
    """
    url = F.lower("url")
    body = F.lower("html")
    by_host = F.coalesce(*[
        F.when(contains_any(url, V.HOST_MARKERS[p]), F.lit(p)) for p in V.REGISTRY_ORDER if p in V.HOST_MARKERS
    ])
    by_body = F.coalesce(*[
        F.when(contains_any(body, V.BODY_MARKERS[p]), F.lit(p)) for p in V.REGISTRY_ORDER if p in V.BODY_MARKERS
    ])
    marked = pages.withColumns({"__host": by_host, "__body": by_body})
    platform = F.coalesce("__host", "__body")
    token = F.coalesce(*[
        F.when(platform == p, board_token(p, F.col("url"), F.when(F.col("__host").isNull(), F.col("html")).otherwise("")))
        for p in V.BOARD_TOKEN_PATTERNS
    ])
    return marked.withColumn("board_token", token).select(
        *pages.columns,
        F.when(platform.isNotNull(), platform).when(F.col("html").isNull(), "generic_html")
        .when(looks_like_spa(F.col("html")), "custom_react").otherwise("generic_html").alias("platform"),
        "board_token",
        F.when(F.col("__host").isNotNull(), 0.95)
        .when(F.col("__body").isNotNull(), F.when(F.col("board_token").isNotNull(), 0.85).otherwise(0.75))
        .when(F.col("html").isNull(), 0.1)
        .when(looks_like_spa(F.col("html")), 0.6 if rendered else 0.4).otherwise(0.5).alias("confidence"),
        F.when(F.col("__host").isNotNull(), "hostname").when(F.col("html").isNull(), "fallback")
        .otherwise("rendered" if rendered else "body").alias("evidence"),
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """``files(domain, text)`` to one row per domain with its groups of rules.

    Consecutive user-agent lines open one group; an empty disallow is no rule.
    """
    lines = F.transform(
        F.split("text", "\r?\n"), lambda l: F.btrim(F.substring_index(l, "#", 1), F.lit(" \t"))
    )
    parsed = F.transform(
        F.filter(lines, lambda l: F.contains(l, F.lit(":"))),
        lambda l: F.struct(
            F.lower(F.trim(F.substring_index(l, ":", 1))).alias("key"),
            F.trim(F.regexp_extract(l, r":(.*)$", 1)).alias("value"),
        ),
    )
    used = F.filter(parsed, lambda p: p["key"].isin("user-agent", "allow", "disallow", "crawl-delay"))

    def number(state: Column, line: Column) -> Column:
        agent = line["key"] == "user-agent"
        group = state["group"] + F.when(agent & ~state["naming"], 1).otherwise(0)
        return F.struct(
            group.alias("group"), (agent | ((group == 0) & state["naming"])).alias("naming"),
            F.concat(state["lines"], F.array(F.struct(
                group.alias("group"), line["key"].alias("key"), line["value"].alias("value"),
            ))).alias("lines"),
        )

    start = F.struct(
        F.lit(0).alias("group"), F.lit(False).alias("naming"),
        F.array().cast("array<struct<group:int,key:string,value:string>>").alias("lines"),
    )
    return files.select("domain", F.aggregate(used, start, number)["lines"].alias("lines"))


def _rule_fits(target: Column, rule: Column) -> Column:
    """Whether ``target`` starts with the parts of a rule in their order, and ends with the last if it must."""
    parts, whole = rule["parts"], rule["whole"]
    first, last, n = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1), F.size(parts)
    plain = F.when(whole, target == first).otherwise(F.startswith(target, first))
    # between the first part and an anchored last one each part is taken where it comes first; 0 is "nowhere"
    middle = F.slice(parts, 2, F.greatest(F.when(whole, n - 2).otherwise(n - 1), F.lit(0)))
    after = F.aggregate(
        middle, F.when(F.startswith(target, first), F.length(first) + 1).otherwise(0),
        lambda at, part: F.when((at == 0) | (part == "") | part.isNull(), at).otherwise(
            bind(F.position(part, target, at), lambda found: F.when(found > 0, found + F.length(part)).otherwise(0))
        ),
    )
    ends = ~whole | (F.endswith(target, last) & (F.length(target) - F.length(last) + 1 >= after))
    return F.when(n == 1, plain).otherwise(bind(after, lambda at: at > 0) & ends)


def robots_allow(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """``allowed`` per ``urls(url, domain)``: named group before ``*``, longest rule wins.

    Rules of a domain are one small array that its links meet by an equi join; no
    link-rule pairs are made.  A rule is split at its stars once per domain, and its
    parts are looked up from left to right.  Domains without a file are open.
    """
    name = agent.lower()
    rules = robots_rules(files)

    agents = F.filter("lines", lambda l: l["key"] == "user-agent")
    named = F.filter(
        agents, lambda a: (a["value"] != "*") & (a["value"] != "") & F.contains(F.lit(name), F.lower(a["value"]))
    )
    best = F.aggregate(
        named, F.struct(F.lit(-1).alias("group"), F.lit(0).alias("size")),
        lambda acc, a: F.when(
            F.length(a["value"]) > acc["size"],
            F.struct(a["group"].alias("group"), F.length(a["value"]).alias("size")),
        ).otherwise(acc),
    )["group"]
    anyone = F.get(F.filter(agents, lambda a: a["value"] == "*"), F.lit(0))["group"]
    chosen = rules.withColumn("__group", F.when(best >= 0, best).otherwise(anyone))
    chosen = chosen.select("domain", F.transform(
        F.filter("lines", lambda l: (l["group"] == F.col("__group")) & l["key"].isin("allow", "disallow")
                 & ((l["key"] == "allow") | (l["value"] != ""))),
        lambda l: F.struct(
            F.length(l["value"]).alias("size"), (l["key"] == "allow").alias("allow"),
            F.split(F.regexp_replace(l["value"], r"\$$", ""), r"\*").alias("parts"), l["value"].endswith("$").alias("whole"),
        ),
    ).alias("rules"))
    target = F.concat(
        path(F.col("url")), F.when(query(F.col("url")) != "", F.concat(F.lit("?"), query(F.col("url")))).otherwise("")
    )
    decoded = F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)
    aimed = urls.withColumn("__target", F.when(decoded == "", "/").otherwise(decoded))
    hits = F.filter("rules", lambda r: _rule_fits(F.col("__target"), r))
    winner = F.array_max(F.transform(hits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    return aimed.join(chosen, "domain", "left").withColumn(
        "allowed", F.coalesce(winner["allow"], F.lit(True))
    ).drop("__target", "rules")


_posting_tags, _dropped_tags, _dropped_roles = V.LISTING_TAGS, V.DROPPED_TAGS, V.DROPPED_ROLES
_landmarks, _hints = V.LANDMARKS, V.HINT_ATTRIBUTES
_listing_hint = re.compile(V.LISTING_HINT)


def _region(tree: Tree, href: re.Pattern) -> tuple[int, int, int] | None:
    """(element, links, score_e2) of the most listing-like element; one pass up the tree and one down."""
    def listed(kind: str, names) -> np.ndarray:
        return np.concatenate([tree.listed(kind, n) for n in names])

    def alive(dropped: np.ndarray) -> np.ndarray:
        out = tree.cover(dropped) == 0
        out[dropped] = False
        return out

    def links_below(anchors: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.searchsorted(anchors, tree.post[of], "right") - np.searchsorted(anchors, of, "right")

    anchors = tree.listed("tag", "a")
    anchors = anchors[np.array([href.search(tree.attribute(a, "href") or "") is not None for a in anchors.tolist()], bool)]
    roles = tree.listed("attr", "role")
    roles = roles[np.array([tree.attribute(n, "role") in _dropped_roles for n in roles.tolist()], bool)]
    noise = np.concatenate([listed("tag", _dropped_tags), roles])
    anchors = anchors[alive(noise)[anchors]]
    marks = listed("tag", _landmarks)
    stays = alive(np.concatenate([noise, marks[links_below(anchors, marks) == 0]]))
    regions = np.sort(listed("tag", _posting_tags))
    links = links_below(anchors, regions)
    wanted = {e: n for e, n in zip(regions.tolist(), links.tolist()) if n >= 2 and stays[e]}
    children: dict[int, list[int]] = {}
    for node in np.flatnonzero(stays).tolist():
        parent = int(tree.parent[node])
        if parent in wanted:
            children.setdefault(parent, []).append(node)
    best = None
    for element, kids in sorted(children.items()):
        tag, n = Counter(tree.nodes[k]["tag"] for k in kids).most_common(1)[0]
        if n < max(2, len(kids) // 2):
            continue
        alike = Counter(" ".join(sorted(tree.nodes[k]["classes"])) for k in kids if tree.nodes[k]["tag"] == tag)
        node = tree.nodes[element]
        hints = " ".join([*node["classes"], node["id"], *(node["attrs"].get(a, "") for a in _hints)])
        score = alike.most_common(1)[0][1] * (10 if n <= 2 * wanted[element] <= 4 * n else 4) * (12 if _listing_hint.search(hints) else 10)
        if best is None or score > best[2]:
            best = element, wanted[element], score
    return best


def listing_region(pages: DataFrame, href_pattern: str = V.POSTING_HREF) -> DataFrame:
    """The most listing-like element of each page, if any, with its score.

    Noise (scripts, media, elements with the role of a landmark) and landmarks without posting links are left
    out first.  Score: children in the repeating pattern x shared class signature x link density x hint.  The
    product of the first two is the count of the most common signature, so ``score_e2`` is a whole number.
    """
    href = re.compile(href_pattern)

    def made(tree, row):
        best = _region(tree, href)
        return [(tree.nodes[best[0]]["tag"], *best)] if best else ()

    found = map_pages(pages, ["page_id"], made, "tag string, pre int, links int, score_e2 int")
    return found.select("page_id", "tag", "pre", "links", "score_e2")


__all__ = ["listing_region", "platform_detect", "robots_allow", "robots_rules"]
