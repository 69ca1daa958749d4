"""Does a title read like a posting, and does a page look like a shell or a wall?"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.text import collapse_blanks


def title_key(title: Column) -> Column:
    return collapse_blanks(F.lower(F.coalesce(title, F.lit(""))))


def looks_like_title(title: Column) -> Column:
    text = title_key(title)
    low, high = V.TITLE_LENGTHS
    return (
        F.length(text).between(low, high)
        & ~text.rlike("|".join(V.CHROME_PHRASES))
        & (text.rlike("|".join(V.ROLE_WORDS)) | text.contains(" "))
    )


def _any_of(markers) -> str:
    return "|".join(re.escape(m) for m in markers)


def text_volume(html: Column) -> Column:
    """Rough count of visible characters: length less a fixed cost per tag."""
    tags = F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit("")))
    return F.length(html) - V.TEXT_COST_PER_TAG * tags


def looks_like_spa(html: Column) -> Column:
    return F.lower(html).rlike(_any_of(V.SPA_MARKERS)) & (text_volume(html) < V.LOW_TEXT_VOLUME)


def looks_blocked(html: Column) -> Column:
    text = F.lower(html)
    return text.rlike(_any_of(V.BLOCK_MARKERS)) | (
        text.rlike(_any_of(V.WEAK_BLOCK_MARKERS)) & (text_volume(html) < V.LOW_TEXT_VOLUME)
    )
