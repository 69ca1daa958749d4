"""Employment type, seniority, years of experience and skills."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.text import (
    bind, contains_any_phrase, find_keys, normalize_key, padded, word_list, word_map,
)


def _joined(*texts: Column) -> Column:
    """Non-blank texts in order, one space between."""
    return F.concat_ws(" ", *[F.when(t != "", t) for t in texts])


def _first_level(padded_key: Column, table) -> Column:
    return F.coalesce(
        *[F.when(contains_any_phrase(padded_key, words), F.lit(level)) for level, words in table]
    )


def parse_employment_type(*texts: Column) -> Column:
    key = padded(normalize_key(_joined(*texts)))
    return bind(key, lambda k: F.coalesce(_first_level(k, V.EMPLOYMENT_WORDS), F.lit("unknown")))


def seniority_from_title_key(title_key: Column) -> Column:
    """Level words of a folded title; "technical staff" names a family, not a level."""
    text = title_key
    for family in V.STAFF_JOB_FAMILIES:
        text = F.replace(text, F.lit(family), F.lit(" "))
    return bind(padded(text), lambda k: _first_level(k, V.SENIORITY_WORDS))


def seniority_from_ladder(title: Column) -> Column:
    """A numeric or roman ladder position, as in "Engineer 4"."""
    position = F.lower(F.regexp_extract(title, V.LADDER_SUFFIX, 1))
    return bind(position, lambda p: F.when(p != "", _lookup(p, V.LADDER_LEVELS)))


def seniority_from_prose(text: Column) -> Column:
    """A level word just before a role noun in running text."""
    phrase = F.replace(F.lower(F.regexp_extract(text, V.ROLE_PHRASE, 1)), F.lit("-"), F.lit(" "))
    return F.when(text.rlike(V.LEVEL_WORD), bind(phrase, lambda p: _lookup(p, V.PHRASE_LEVELS)))


def _lookup(key: Column, table: dict) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def parse_years_required(text: Column) -> Column:
    """Smallest number of years asked for; "years of experience" beats bare years."""

    def smallest(pattern: str) -> Column:
        years = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda y: y.try_cast("int")
        )
        return F.array_min(F.filter(years, lambda y: y <= V.MAX_YEARS_ASKED))

    mentioned = text.rlike("(?i)y(?:ea)?r")
    return F.when(
        mentioned, F.coalesce(smallest(V.YEARS_OF_EXPERIENCE), smallest(V.YEARS_MENTIONED))
    )


def seniority_from_years(years: Column) -> Column:
    return (
        F.when(years <= 0, "intern").when(years <= 2, "junior").when(years <= 5, "mid")
        .when(years <= 8, "senior").when(years.isNotNull(), "staff")
    )


def level_in_text(text: Column) -> Column:
    """Level that running text tells, by a role phrase or by years; null if it tells none."""
    return F.coalesce(seniority_from_prose(text), bind(parse_years_required(text), seniority_from_years))


def seniority_of(title: Column, level: Column, title_key: Column | None = None) -> Column:
    """Title words, ladder suffix, the ``level`` told elsewhere: the first that speaks wins."""
    key = normalize_key(title) if title_key is None else title_key
    return F.coalesce(seniority_from_title_key(key), seniority_from_ladder(title), level, F.lit("unknown"))


def parse_seniority(title: Column, description: Column, title_key: Column | None = None) -> Column:
    """Title words, ladder suffix, prose, years: the first that speaks wins."""
    return seniority_of(title, level_in_text(description), title_key)


def seniority_rank(level: Column) -> Column:
    """Ordinal of a level; null for a text that is no level."""
    return _lookup(level, V.SENIORITY_RANK).cast("int")


def skill_dictionary() -> dict[str, str]:
    """Folded key to spelling, first spelling per key, in dictionary order."""
    table: dict[str, str] = {}
    for skill in V.SKILLS:
        folded = unicodedata.normalize("NFKD", skill.lower())
        key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in folded).split())
        table.setdefault(key, skill)
    return table


def token_shingles(key: Column, longest: int) -> Column:
    """Runs of one to ``longest`` words of a folded text."""
    runs = [
        F.regexp_extract_all(key, F.lit(rf"(?=([a-z0-9]+(?: [a-z0-9]+){{{n - 1}}}))[a-z0-9]+"), F.lit(1))
        for n in range(2, longest + 1)
    ]
    return F.concat(F.split(key, " "), *runs)


def skills_in_key(key: Column) -> Column:
    """Dictionary terms in a folded text, in dictionary order, one per key."""
    table = {f" {key} ": name for key, name in skill_dictionary().items()}
    names = word_map(table)
    return bind(
        padded(key),
        lambda hay: F.transform(
            F.filter(word_list(table), lambda k: F.contains(hay, k)),
            lambda k: F.try_element_at(names, k),
        ),
    )


def detect_skills(*texts: Column) -> Column:
    return skills_in_key(normalize_key(_joined(*texts)))


def skill_digest(key: Column) -> Column:
    """A short text that holds the dictionary terms of a folded text and nothing else of it but its ends.

    The words at both ends stay, since a term may begin in one text and end in the next.
    """
    terms = list(skill_dictionary())
    edge = max(len(t.split(" ")) for t in terms) - 1

    def cut(words: Column) -> Column:
        hay = padded(F.array_join(words, " "))
        hits = bind(hay, lambda h: F.filter(word_list(terms), lambda t: F.contains(h, padded(t))))
        ends = [F.array_join(F.slice(words, 1, edge), " "), F.array_join(F.slice(words, -edge, edge), " ")]
        short = F.concat_ws(" \x01 ", ends[0], hits, ends[1])
        return F.when(F.size(words) <= 2 * edge, F.array_join(words, " ")).otherwise(short)

    return bind(F.split(key, " "), cut)


def years_gap(required: Column, years_experience: Column) -> Column:
    """Years a candidate is short of what is asked; null when either is unknown."""
    short = required - years_experience
    return F.when(short.isNotNull(), F.greatest(short, F.lit(0)))


def required_years(description: Column, requirements: Column) -> Column:
    return parse_years_required(F.when(description != "", description).otherwise(requirements))


__all__ = [
    "detect_skills", "find_keys", "level_in_text", "parse_employment_type", "parse_seniority",
    "parse_years_required", "required_years", "seniority_from_years", "seniority_of", "seniority_rank",
    "skill_dictionary", "skill_digest", "skills_in_key", "token_shingles", "years_gap",
]
