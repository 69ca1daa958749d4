"""Text columns: cleaning, folding, keyword search, truncation."""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Python's notion of whitespace is wider than Java's ``\s``.
_BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# No printable ASCII letter is one; told first, it passes by the long class in one comparison.
_BLANK = f"[[^!-~]&&[{_BLANKS}]]"
_BLANK_RUN = f"{_BLANK}+"
_UNTIDY_BLANKS = f"{_BLANK}{{2,}}|[[^ -~]&&[{_BLANKS}]]"
_BLANK_RUN_IN_LINE = f"[[^!-~\\n]&&[{_BLANKS}]]+"
_SIMPLE_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
)
_RARE_ENTITY = r"&(?:amp;)*(?!(?:amp|lt|gt|quot|apos|nbsp|#39);)[a-zA-Z#]"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` under one name."""
    return F.transform(F.array(value), body)[0]


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _decode_simple(c: Column) -> Column:
    for entity, char in _SIMPLE_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@F.arrow_udf(T.StringType())
def _decode_and_compose(values: pa.Array) -> pa.Array:
    """HTML entities and Unicode NFKC have no Spark built-in; a batch of nulls, which is the rule, goes back as it came."""
    if values.null_count == len(values):
        return values
    return pa.array(
        [None if v is None else unicodedata.normalize("NFKC", html.unescape(v)) for v in values.to_pylist()], values.type
    )


@F.arrow_udf(T.StringType())
def _decode_twice(values: pa.Array) -> pa.Array:
    def decode(v: str) -> str:
        once = html.unescape(v)
        return html.unescape(once) if "&lt;" in once or "&gt;" in once else once

    if values.null_count == len(values):
        return values
    return pa.array([None if v is None else decode(v) for v in values.to_pylist()], values.type)


def word_list(words) -> Column:
    """A constant array of words; one literal, however long the list is."""
    return F.split(F.lit("|".join(words)), r"\|")


def word_map(pairs: dict) -> Column:
    """A constant text map; one literal, however long it is."""
    return F.str_to_map(
        F.lit("|".join(f"{k}={v}" for k, v in pairs.items())), F.lit(r"\|"), F.lit("=")
    )


def _may_be_untidy(c: Column) -> Column:
    """False only for printable ASCII without two spaces in a row, by one comparison a letter."""
    return F.contains(c, F.lit("  ")) | c.rlike("[^ -~]")


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.when(_may_be_untidy(c), F.regexp_replace(c, _UNTIDY_BLANKS, " ")).otherwise(c))


def clean_text(c: Column) -> Column:
    """Decode entities, NFKC, collapse whitespace, trim; null gives "".

    Plain ASCII without rare entities never leaves the JVM: the Arrow function
    only receives the values that need it, every other row ships a null.
    """
    has_entity = F.contains(c, F.lit("&"))
    needs_python = ~is_ascii(c) | (has_entity & c.rlike(_RARE_ENTITY))
    decoded = F.coalesce(
        _decode_and_compose(F.when(needs_python, c)),
        F.when(has_entity, _decode_simple(c)).otherwise(c),
        F.lit(""),
    )
    return collapse_blanks(decoded)


def is_blank(c: Column) -> Column:
    """Would ``clean_text`` leave nothing?  JVM only, so that it can be pushed down."""
    return c.isNull() | c.rlike(
        rf"^(?:[{_BLANKS}]|&(?:nbsp|ensp|emsp|thinsp|Tab|NewLine);"
        r"|&#0*(?:9|10|13|32|160);|&#[xX]0*(?:9|[aAdD]|20|[aA]0);)*$"
    )


def strip_html(c: Column) -> Column:
    """Markup to readable lines.  Entities are decoded before tags are removed.

    A step that would change nothing (no ``&``, no ``<``, no untidy blank) is told by one look and left out.
    """
    has_entity = F.contains(c, F.lit("&"))
    simple = _decode_simple(c)
    simple = F.when(
        simple.contains("&lt;") | simple.contains("&gt;"), _decode_simple(simple)
    ).otherwise(simple)
    text = F.coalesce(
        _decode_twice(F.when(has_entity & c.rlike(_RARE_ENTITY), c)),
        F.when(has_entity, simple).otherwise(c), F.lit(""),
    )
    lines = F.regexp_replace(text, r"(?i)</(p|div|li|br|tr|h[1-6])\s*>", "\n")
    text = F.when(F.contains(text, F.lit("<")), F.regexp_replace(lines, r"<[^>]+>", " ")).otherwise(text)
    tidy = F.regexp_replace(F.regexp_replace(text, _BLANK_RUN_IN_LINE, " "), r" ?\n[ \n]*", "\n")
    return F.btrim(F.when(_may_be_untidy(text) & text.rlike(_UNTIDY_BLANKS), tidy).otherwise(text), F.lit(" \n"))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Code points that decompose (NFKD) to ASCII letters and digits.

    Returns the two sides of a ``translate`` (one-to-one folds, then combining
    marks, which are deleted) and the folds that give several characters.
    """
    source, target, marks, wide = [], [], [], {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if char.lower() != char:
            continue  # the input of the fold is already lower-cased
        parts = unicodedata.normalize("NFKD", char)
        kept = "".join(p for p in parts if not unicodedata.combining(p))
        if not kept:
            marks.append(char)
        elif any(k.isascii() and k.isalnum() for k in kept):
            if len(kept) == 1:
                source.append(char)
                target.append(kept)
            else:
                wide[char] = kept
    return "".join(source + marks), "".join(target), wide


@lru_cache(maxsize=1)
def _wide_class() -> str:
    """Class of the code points with wide folds.

    As ranges, since a class tries its members one by one, and behind the first code point, so that
    the bulk of a text is told by one comparison.
    """
    points = sorted(map(ord, _folds()[2]))
    starts = [p for p in points if p - 1 not in set(points)]
    ends = [p for p in points if p + 1 not in set(points)]
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))
    return f"[\\x{{{points[0]:x}}}-\\x{{10ffff}}&&[{ranges}]]"


def normalize_key(c: Column) -> Column:
    """Lower case, no accents, only ``[a-z0-9]`` and single spaces; null gives ""."""
    source, target, wide = _folds()
    lowered = F.lower(F.coalesce(c, F.lit("")))
    wide_map = word_map(wide)
    wide_class = _wide_class()
    # NFKD may give capitals (a squared "MHz" sign has no lower form) which the
    # fold then treats as separators, so the folded text is not lowered again.
    folded = F.when(is_ascii(lowered), lowered).otherwise(
        F.translate(
            F.when(
                lowered.rlike(wide_class),
                F.array_join(
                    F.transform(
                        F.split(lowered, ""),
                        lambda ch: F.coalesce(F.try_element_at(wide_map, ch), ch),
                    ),
                    "",
                ),
            ).otherwise(lowered),
            source,
            target,
        )
    )
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def padded(key: Column) -> Column:
    """A folded text between spaces, so that ``contains`` means whole words."""
    return F.concat(F.lit(" "), key, F.lit(" "))


def contains_keyword(haystack: Column, keyword: Column) -> Column:
    key = normalize_key(keyword)
    return (key != "") & F.contains(padded(normalize_key(haystack)), padded(key))


def find_keys(padded_haystack: Column, keywords: Column) -> Column:
    """Keywords (array of ``struct(key, word)``) that occur in a padded key text.

    The text is bound, so that it is folded once and not once for each keyword.
    """
    return bind(
        padded_haystack,
        lambda text: F.transform(
            F.filter(keywords, lambda k: (k["key"] != "") & F.contains(text, padded(k["key"]))),
            lambda k: k["word"],
        ),
    )


def keyed(words: Column) -> Column:
    """Array of words to array of ``struct(key, word)``; do this once per table."""
    return F.transform(
        words, lambda w: F.struct(normalize_key(w).alias("key"), w.alias("word"))
    )


def find_keywords(haystack: Column, keywords: Column) -> Column:
    return find_keys(padded(normalize_key(haystack)), keyed(keywords))


def contains_any_phrase(padded_key: Column, phrases) -> Column:
    """Is any of these whole-word phrases in a padded key text?"""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(padded_key, F.lit(f" {phrase} "))
    return hit


def contains_any(text: Column, parts) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def truncate(c: Column, limit: int, suffix: str = "…") -> Column:
    keep = max(0, limit - len(suffix))
    cut = F.concat(
        F.regexp_replace(F.substring(c, 1, keep), f"{_BLANK_RUN}$", ""), F.lit(suffix)
    )
    return F.when(F.length(c) > limit, cut).otherwise(c)
