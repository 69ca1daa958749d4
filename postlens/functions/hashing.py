"""Content hash: the identity of a posting within a company."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlens.functions import fixed_values as V
from postlens.functions.text import normalize_key


def content_hash(
    company_id: Column, title_key: Column, location_key: Column, url: Column, external_id: Column
) -> Column:
    """SHA-256 over the external id when there is one, else over title, place and link.

    ``title_key`` and ``location_key`` are folded texts, ``url`` is canonical.
    """
    external = F.btrim(external_id, F.lit(" \t\r\n"))
    company = company_id.cast("string")
    by_id = F.concat_ws("|", F.lit(V.HASH_VERSION), company, F.concat(F.lit("id:"), external))
    by_text = F.concat_ws(
        "|", F.lit(V.HASH_VERSION), company, title_key,
        F.coalesce(location_key, F.lit("")), F.coalesce(url, F.lit("")),
    )
    return F.sha2(F.when(external != "", by_id).otherwise(by_text), 256)


def content_hash_of(
    company_id: Column, title: Column, location: Column, url: Column, external_id: Column
) -> Column:
    from postlens.functions.urls import canonicalize_url

    return content_hash(
        company_id, normalize_key(title), normalize_key(location),
        F.when(url != "", canonicalize_url(url)), external_id,
    )
