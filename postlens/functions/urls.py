"""URL columns: parts, registrable domain, joining, canonical form."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.text import bind, blank_to_null, word_list

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_HOST = r"^(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host without credentials and port; "" when there is none."""
    return F.lower(F.regexp_extract(authority(url), _HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def registrable_domain(url: Column) -> Column:
    """Last two labels of the host, three under the listed two-part suffixes."""
    bare = F.regexp_replace(host(url), r"^www\.", "")
    last_two = F.substring_index(bare, ".", -2)
    return F.when(
        last_two.isin(*V.MULTI_PART_SUFFIXES), F.substring_index(bare, ".", -3)
    ).otherwise(last_two)


def same_site(a: Column, b: Column) -> Column:
    return registrable_domain(a) == registrable_domain(b)


def _resolve_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(part == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1))))
            .when(part == ".", stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    parts = F.split(p, "/")
    walked = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.slice(parts, 1, 1),
        step,
    )
    ends_in_dir = p.rlike(r"/\.\.?$")
    joined = F.concat(F.array_join(walked, "/"), F.when(ends_in_dir, "/").otherwise(""))
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), joined).otherwise(p)


def join_url(base: Column, href: Column) -> Column:
    """RFC 3986 reference resolution."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when((base == "") | base.isNull() | (scheme(base) == ""), href)
        .when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, _resolve_dots(href_path), tail))
        .when(href.startswith("?"), F.concat(origin, path(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(origin, _resolve_dots(F.concat(folder, href_path)), tail))
    )


NOT_FOLLOWED = r"^(?:#|javascript:|mailto:|tel:)"


def absolutize(href: Column, base: Column) -> Column:
    """A followable link, or null for blanks, anchors and non-web schemes."""
    link = F.btrim(href, F.lit(" \t\r\n\x0b\x0c"))
    return F.when(
        (link != "") & ~link.rlike(NOT_FOLLOWED), join_url(base, link)
    )


_ALL_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_parts(url: Column) -> Column:
    """``[scheme, authority, path, query]`` in one pass; absent parts are ""."""
    return F.split(F.regexp_replace(url, _ALL_PARTS, "$1\x01$2\x01$3\x01$4"), "\x01")


def _decode(c: Column) -> Column:
    fixed = F.regexp_replace(c, r"%(?![0-9a-fA-F]{2})", "%25")
    coded = F.contains(c, F.lit("%")) | F.contains(c, F.lit("+"))
    return F.when(coded, F.try_url_decode(fixed)).otherwise(c)


def _encode(c: Column) -> Column:
    encoded = F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )
    return F.when(c.rlike(r"^[A-Za-z0-9_.\-~]*$"), c).otherwise(encoded)


def query_pairs(q: Column) -> Column:
    """Decoded ``struct(k, v)`` of a query string, blank values dropped."""
    pairs = F.transform(
        F.split(q, "&"),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, F.lit("=")) + 1))).alias("v"),
        ),
    )
    return F.filter(pairs, lambda p: (p["v"] != "") & p["k"].isNotNull())


def _clean_query(q: Column) -> Column:
    tracking = word_list(V.TRACKING_PARAMS)
    kept = F.filter(query_pairs(q), lambda p: ~F.array_contains(tracking, p["k"]))
    encoded = F.array_join(
        F.transform(
            F.sort_array(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))
        ),
        "&",
    )
    return F.when(q == "", "").otherwise(
        bind(encoded, lambda e: F.when(e == "", "").otherwise(F.concat(F.lit("?"), e)))
    )


def canonicalize_url(url: Column, base: Column | None = None) -> Column:
    """Identity form of a link: no tracking, no fragment, sorted query, lower host.

    Plain web links, which are the bulk, are rewritten by compiled steps; only the others take their parts apart
    by an interpreted lambda.
    """
    full = F.btrim(join_url(base, url) if base is not None else url, F.lit(" \t\r\n\x0b\x0c"))
    return F.when(full.rlike(_PLAIN_LINK), _canonical_plain(full)).otherwise(_canonical_any(full))


# Letters one by one: such a class is a table in Java, one with ranges a chain of comparisons.
# The pairs are bounded, since Java keeps a frame for each; longer queries are no plain links.
_HOST_LETTER = string.ascii_letters + string.digits + r".\-"
_TOKEN = f"[{_HOST_LETTER}_~]+"
_PLAIN_LINK = (
    rf"(?s)\Ahttps?://[{_HOST_LETTER}]+(?:/[^;?#\x01]*+)?(?:\?(?:{_TOKEN}={_TOKEN}(?:&{_TOKEN}={_TOKEN}){{0,50}}+)?)?(?:#.*)?\z"
)
_TRACKED = "&(?:" + "|".join(V.TRACKING_PARAMS) + ")=[^&]*"


def _canonical_plain(url: Column) -> Column:
    """Canonical form of a link that has no port, credentials, path parameters or coded query.

    Each step reads the one before once.  The query is kept as ``&k=v&k=v``; pairs sort by key, then value, as
    ``=`` is lowered to the smallest character meanwhile.
    """
    server = F.lower(F.regexp_extract(url, "^[^/]*//[^/?#]*", 0))
    place = F.regexp_replace(F.regexp_extract(url, "^[^/]*//[^/?#]*([^?#]*)", 1), "^$", "/")
    pairs = F.replace(F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1), F.lit("?"), F.lit("&"))
    kept = F.replace(F.regexp_replace(pairs, _TRACKED, ""), F.lit("="), F.lit("\x01"))
    ordered = F.replace(F.array_join(F.sort_array(F.split(kept, "&")), "&"), F.lit("\x01"), F.lit("="))
    return F.concat(server, place, F.regexp_replace(ordered, "^&", "?"))


def _canonical_any(url: Column) -> Column:
    def canonical(parts: Column) -> Column:
        proto = F.when(parts[0] == "", "https").otherwise(F.lower(parts[0]))
        server = F.lower(
            F.when(F.contains(parts[1], F.lit("@")), F.substring_index(parts[1], "@", -1))
            .otherwise(parts[1])
        )
        server = (
            F.when(~F.contains(server, F.lit(":")), server)
            .when(proto == "https", F.regexp_replace(server, ":(?:443)?$", ""))
            .when(proto == "http", F.regexp_replace(server, ":(?:80)?$", ""))
            .otherwise(F.regexp_replace(server, ":$", ""))
        )
        place = F.when(
            F.contains(parts[2], F.lit(";")), F.regexp_replace(parts[2], r";[^/]*$", "")
        ).otherwise(parts[2])
        place = F.when(place == "", "/").otherwise(place)
        return F.concat(
            proto,
            F.when((server == "") & ~place.startswith("/"), ":").otherwise("://"),
            server,
            place,
            _clean_query(parts[3]),
        )

    return bind(url_parts(url), canonical)


def has_search_filter(url: Column) -> Column:
    """Does the query ask for a subset of the board?"""
    return F.exists(query_pairs(query(url)), lambda p: F.lower(p["k"]).isin(*V.FILTER_PARAMS))


def infer_name(url: Column) -> Column:
    """Display name: board slug on shared board hosts, else the first host label."""
    bare = F.regexp_replace(host(url), r"^www\.", "")
    first_segment = F.regexp_extract(path(url), r"^/*([^/]+)", 1)
    on_board_host = bare.rlike("|".join(h.replace(".", r"\.") for h in V.BOARD_HOSTS))
    label = F.when(bare == "", "Unknown").otherwise(F.substring_index(bare, ".", 1))
    named = F.when(
        on_board_host & (first_segment != ""), F.translate(first_segment, "-_", "  ")
    ).otherwise(F.replace(label, F.lit("-"), F.lit(" ")))
    return F.coalesce(blank_to_null(title_case(named)), F.lit("Unknown"))


def title_case(c: Column) -> Column:
    """A capital after every non-letter, lower case elsewhere."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")


def board_token(platform: str, url: Column, body: Column) -> Column:
    """Board slug by ordered patterns; each is tried on the URL, then on the page."""
    hits = [
        blank_to_null(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1))
        for pattern in _token_patterns(platform)
        for text in (url, body)
    ]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def _token_patterns(platform: str) -> tuple[str, ...]:
    return V.BOARD_TOKEN_PATTERNS.get(platform, ())
