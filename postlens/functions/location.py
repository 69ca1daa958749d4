"""Location columns: parsing free text, and acceptance against preferences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.text import bind, blank_to_null, collapse_blanks, contains_any, normalize_key, word_list, word_map

_ALL_ARRANGEMENT_WORDS = V.REMOTE_WORDS + V.HYBRID_WORDS + V.ONSITE_WORDS
_PARENTHESES = r"\(([^)]*)\)"


def is_remote_word(word: Column) -> Column:
    return F.array_contains(word_list(_ALL_ARRANGEMENT_WORDS), normalize_key(word))


def remote_from_hint(hint: Column) -> Column:
    decided = bind(
        normalize_key(hint),
        lambda key: F.when(contains_any(key, V.HINT_REMOTE_WORDS), "remote")
        .when(contains_any(key, V.HINT_HYBRID_WORDS), "hybrid")
        .when(contains_any(key, V.HINT_ONSITE_WORDS), "onsite")
        .otherwise("unknown"),
    )
    return F.when(hint != "", decided).otherwise("unknown")


def remote_from_text(text: Column) -> Column:
    """Hybrid is tested first: "Hybrid Remote" is hybrid."""
    return bind(
        normalize_key(text),
        lambda key: F.when(contains_any(key, V.HYBRID_WORDS), "hybrid")
        .when(contains_any(key, V.REMOTE_WORDS), "remote")
        .when(contains_any(key, V.ONSITE_WORDS), "onsite")
        .otherwise("unknown"),
    )


def titleish(c: Column) -> Column:
    """Capitalise words, but leave all-caps words of up to four characters alone."""

    def word(w: Column) -> Column:
        is_acronym = (F.length(w) <= 4) & (w == F.upper(w)) & (w != F.lower(w))
        return F.when(is_acronym, w).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
        )

    return blank_to_null(F.array_join(F.transform(F.split(c, " "), word), " "))


def parse_location(text: Column, hint: Column | None = None) -> Column:
    """``struct(raw, city, region, country, remote_type)`` of a ``clean_text`` column."""
    raw = F.coalesce(text, F.lit(""))
    hint = F.lit(None).cast("string") if hint is None else hint
    countries = word_map(V.COUNTRY_ALIASES)

    def keyed_segment(segment: Column) -> Column:
        text = collapse_blanks(segment)
        return F.struct(text.alias("text"), normalize_key(text).alias("key"))

    def assemble(segments: Column) -> Column:
        states, placeholders = word_list(V.US_STATE_CODES), word_list(V.PLACEHOLDER_LOCATIONS)
        country_at = F.array_max(
            F.transform(
                segments, lambda s, i: F.when(F.map_contains_key(countries, s["key"]), i)
            )
        )
        only_placeholders = F.forall(segments, lambda s: F.array_contains(placeholders, s["key"]))

        def places(at: Column) -> Column:
            country = F.when(at.isNotNull(), F.try_element_at(countries, F.get(segments, at)["key"]))
            rest = F.filter(segments, lambda s, i: at.isNull() | (i != at))

            def split(left: Column) -> Column:
                city, region = F.get(left, F.lit(0)), F.get(left, F.lit(1))
                lone_state = region["text"].isNull() & F.array_contains(states, city["key"])
                return F.struct(
                    F.when(~F.coalesce(lone_state, F.lit(False)), titleish(city["text"])).alias("city"),
                    titleish(F.when(lone_state, city["text"]).otherwise(region["text"])).alias("region"),
                    country.alias("country"),
                )

            return bind(rest, split)

        return F.when(~only_placeholders, bind(country_at, places))

    outside = F.regexp_replace(raw, _PARENTHESES, " ")
    inside = F.regexp_extract_all(raw, F.lit(_PARENTHESES), F.lit(1))
    texts = F.when(
        F.contains(raw, F.lit("(")), F.concat(F.split(outside, V.LOCATION_SEPARATORS), inside)
    ).otherwise(F.split(raw, V.LOCATION_SEPARATORS))
    arrangements = word_list(_ALL_ARRANGEMENT_WORDS)
    segments = F.filter(
        F.transform(texts, keyed_segment),
        lambda s: (s["key"] != "") & ~F.array_contains(arrangements, s["key"]),
    )
    hinted = remote_from_hint(hint)
    remote = F.when((hinted == "unknown") & (raw != ""), remote_from_text(raw)).otherwise(hinted)
    return bind(
        F.when(raw != "", bind(segments, assemble)),
        lambda place: F.struct(
            blank_to_null(raw).alias("raw"),
            place["city"].alias("city"),
            place["region"].alias("region"),
            place["country"].alias("country"),
            remote.alias("remote_type"),
        ),
    )


def has_geography(location: Column) -> Column:
    return F.coalesce(location["city"], location["region"], location["country"]).isNotNull()


def split_preferences(preferred: Column) -> Column:
    """``struct(places, wants_remote)``: "Remote" states an arrangement, not a place."""
    places = F.filter(preferred, lambda p: ~is_remote_word(p))
    return F.struct(
        places.alias("places"), (F.size(places) != F.size(preferred)).alias("wants_remote")
    )


def location_keys(location: Column) -> Column:
    """Folded texts a preferred place is searched in."""
    parts = F.array(location["raw"], location["city"], location["region"], location["country"])
    return F.transform(F.array_compact(parts), normalize_key)


def matches_preferred(location: Column, preferred: Column) -> Column:
    keys = F.filter(F.transform(preferred, normalize_key), lambda k: k != "")
    return (F.size(preferred) == 0) | any_place_in(location_keys(location), keys)


def any_place_in(haystacks: Column, place_keys: Column) -> Column:
    """Is any folded place a substring of any folded location text?"""
    return F.exists(place_keys, lambda p: F.exists(haystacks, lambda h: F.contains(h, p)))


def location_is_acceptable(location: Column, preferred: Column, include_unknown: Column) -> Column:
    def decide(prefs: Column) -> Column:
        no_places = F.size(prefs["places"]) == 0
        return (
            F.when(F.size(preferred) == 0, True)
            .when(~no_places & matches_preferred(location, prefs["places"]), True)
            .when(
                location["remote_type"] == "remote",
                ~has_geography(location) & (prefs["wants_remote"] | no_places),
            )
            .when(location["raw"].isNull(), include_unknown)
            .otherwise(no_places)
        )

    return bind(split_preferences(preferred), decide)
