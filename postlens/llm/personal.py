"""Personal data by anchor expansion: anchors are found first, then read by local parsers.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, ``://`` and the cues
of identifiers (``CUES``, ``iban``).  At every anchor the parser of its kind expands to both sides as far
as the kind's characters go and validates what it got; text without anchors is never looked at.

* ``email``, ``ip``, ``card``, ``phone`` (base kinds): their spans are exactly the leftmost matches of

      email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
      ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)           parts at most 255
      card   [0-9]([\\x20-]?[0-9])+                            12 to 19 digits, Luhn
      phone  \\+[0-9][\\x20().0-9-]+[0-9]                      9 to 15 digits

* ``url``: scheme, ``://`` and the run after it without blanks, controls and ``"<>\\^`{|}``, less
  punctuation at its end; something must be left after ``://``.
* ``account``: the value after a cue that stands as a word of its own, in any case, and one to five of
  blank, ``:``, ``=``, ``#`` or quotes: a run of at least six ASCII letters, digits, ``_`` or ``-`` that
  begins with a letter or digit and holds a digit.
* ``iban``: after the cue ``iban``, two capitals, two digits and 11 to 30 capitals or digits, blanks
  between them allowed; the longest of its beginnings that ends where it or one of its blanks does, has
  15 to 34 characters without blanks and the remainder 1 modulo 97.

Within a kind, spans never overlap: what a parser has read is not read again, also if it is dropped.
Spans of different kinds may overlap.  Positions are code points, the end is exclusive.

Null is an empty text; it, and texts without personal data, have no spans.  Rows are judged one by one,
so repeated rows and null ids stay; an empty table gives an empty result.  ``find`` and ``redact`` keep
all columns, whatever their names; their own column's name is a parameter and replaces one of its name.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import small_batches, utf8

BASE = ["email", "ip", "card", "phone"]
ADDED = ["url", "account", "iban"]
KINDS = BASE + ADDED
CUES = [
    "account", "acct", "accountno", "userid", "user_id", "customerid", "customer_id", "passport", "ssn", "taxid", "tax_id",
    "token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "bearer",
]
SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SCHEME = _LETTERS | frozenset("0123456789+.-")
_IN_WORD = _LETTERS | frozenset("0123456789_")
_END = ".,;:!?)]'"
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_digits = re.compile(r"[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_rest = re.compile(r'[^\x00-\x20"<>\x5C^`{|}\x7F]+')
_value = re.compile(r"""[\x20:=#"']{1,5}([A-Za-z0-9][A-Za-z0-9_-]{5,})""")
_iban = re.compile(r"""[\x20:=#"']{1,5}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})""")


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    """Anchor -> (kind of anchor, its length)."""
    out = ahocorasick.Automaton()
    for text, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), ("iban", "iban")]:
        out.add_word(text, (kind, len(text)))
    for digit in "0123456789":
        out.add_word(digit, ("digit", 1))
    for cue in CUES:
        out.add_word(cue, ("cue", len(cue)))
    out.make_automaton()
    return out


# --- local parsers --------------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def iban_end(text: str) -> int:
    """Length of the longest valid beginning of ``text`` that ends before a blank or with it; 0 if none."""
    ends = [len(text)] + [k for k in range(len(text) - 1, 0, -1) if text[k] == " "]
    for end in ends:
        plain = text[:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return 0


def _left(text: str, at: int, least: int, allowed: frozenset) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _own_word(text: str, begin: int, end: int) -> bool:
    return (begin == 0 or text[begin - 1] not in _IN_WORD) and (end == len(text) or text[end] not in _IN_WORD)


def _address(text: str, at: int, done: int) -> tuple[int, int, int] | None:
    begin = _left(text, at, done, _SCHEME)
    while begin < at and text[begin] not in _LETTERS:
        begin += 1
    tail = _rest.match(text, at + 3) if begin < at else None
    if not tail:
        return None
    end = at + 3 + len(tail.group().rstrip(_END))
    return begin, end if end > at + 3 else begin, tail.end()


def spans_of(raw: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order; ``raw`` holds one character per byte of UTF-8."""
    out = []
    done = dict.fromkeys(KINDS, 0)

    def read(kind: str, begin: int, end: int, upto: int, valid: bool) -> None:
        done[kind] = upto
        if valid and end > begin:
            out.append((begin, KINDS.index(kind), end))

    for last, (anchor, size) in _anchors().iter(raw.encode("latin-1").lower().decode("latin-1")):
        at = last + 1 - size
        if anchor == "digit":
            if at >= done["ip"]:
                if m := _ip.match(raw, at):
                    valid = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())
                    read("ip", at, m.end(), m.end(), valid)
                else:
                    done["ip"] = _digits.match(raw, at).end()
            if at >= done["card"] and (m := _card.match(raw, at)):
                digits = m.group().replace(" ", "").replace("-", "")
                read("card", at, m.end(), m.end(), 12 <= len(digits) <= 19 and luhn(digits))
        elif anchor == "at":
            begin = _left(raw, at, done["email"], _LOCAL)
            if begin < at and (m := _domain.match(raw, at)):
                read("email", begin, m.end(), m.end(), True)
        elif anchor == "plus":
            if m := _phone.match(raw, at):
                read("phone", at, m.end(), m.end(), 9 <= sum(c.isdigit() for c in m.group()) <= 15)
        elif anchor == "scheme":
            if at >= done["url"] and (found := _address(raw, at, done["url"])):
                read("url", *found, True)
        elif _own_word(raw, at, last + 1):
            kind, value = ("iban", _iban) if anchor == "iban" else ("account", _value)
            if at >= done[kind] and (m := value.match(raw, last + 1)):
                begin, end = m.span(1)
                if kind == "iban":
                    read(kind, begin, begin + iban_end(m.group(1)), end, True)
                else:
                    read(kind, begin, end, end, any("0" <= c <= "9" for c in m.group(1)))
    return sorted(out)


def code_points(data: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte position."""
    if data.isascii():
        return {p: p for p in places}
    out, count, before = {}, 0, 0
    for place in sorted(set(places)):
        count += len(data[before:place].decode())
        out[place], before = count, place
    return out


# --- jobs -----------------------------------------------------------------------------------------

def find(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with ``name``: kind, start and end of every span, by start and kind."""
    kept = docs.drop(name)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = []
            for data in utf8(batch.column(text)):
                found = spans_of(data.decode("latin-1"))
                at = code_points(data, [p for begin, _, end in found for p in (begin, end)])
                rows.append([{"kind": KINDS[k], "start": at[b], "end": at[e]} for b, k, e in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, name])

    return small_batches(kept).mapInArrow(run, kept.select("*", F.lit(None).cast(SPANS).alias(name)).schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``[EMAIL]`` and the like in place of the spans; a null text stays null."""
    def run(batches):
        for batch in batches:
            old = batch.column(text)
            new = [_masked(data, spans_of(data.decode("latin-1"))) for data in utf8(old)]
            new = pa.array([n if o else None for n, o in zip(new, old.is_valid().to_pylist())], pa.string())
            columns = [new if name == text else c for name, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return small_batches(docs).mapInArrow(run, docs.schema)


def _masked(data: bytes, found: list[tuple[int, int, int]]) -> str:
    """The text with ``[KIND]`` for every span; overlapping spans become one, named after the first."""
    out, at = [], 0
    for begin, kind, end in found:
        if begin >= at:
            out += [data[at:begin], f"[{KINDS[kind].upper()}]".encode()]
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode()


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans (texts) of every document."""
    found = find(docs.select("doc_id", "text"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_listed(of(*BASE)), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


# The SQL marks every match with two characters of the private use area and adds up what stands between.
_PATTERNS = {
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    "ip": r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)",
    "card": r"([0-9](?:[\x20-]?[0-9])+)",
    "phone": r"(\+[0-9][\x20().0-9-]+[0-9])",
    "url": r'([A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"<>\x5C^`{|}\x7F]+)',
    "account": rf"""(\b(?i:{"|".join(CUES)})[\x20:=#"']{{1,5}}[A-Za-z0-9][A-Za-z0-9_-]{{5,}})""",
    "iban": r"""(\b(?i:iban)[\x20:=#"']{1,5}[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})""",
}


def _marked(kind: str, number: int) -> str:
    pattern = _PATTERNS[kind].replace("'", "''")
    split = f"string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344))"
    return f"SELECT r, {number} AS k, '{kind}' AS kind, {split} AS pieces FROM d"


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), p AS ({" UNION ALL ".join(_marked(k, n) for n, k in enumerate(KINDS))}
), m AS MATERIALIZED (
  SELECT r, k, kind, place, split_part(piece, chr(57345), 1) AS hit, length(replace(piece, chr(57345), '')) AS size FROM (
    SELECT r, k, kind, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS place FROM p WHERE len(pieces) > 1)
), s AS (
  SELECT *, sum(size) OVER (PARTITION BY r, k ORDER BY place) - size AS first FROM m
), v AS (
  SELECT r, k, kind, first, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits,
    CASE kind WHEN 'url' THEN rtrim(hit, '.,;:!?)]''')
      WHEN 'account' THEN regexp_extract(hit, '[\x20:=#"'']([A-Za-z0-9_-]+)$', 1)
      WHEN 'iban' THEN regexp_extract(hit, '[\x20:=#"'']{{1,5}}([A-Z]{{2}}[0-9]{{2}}.*)$', 1) ELSE hit END AS own
  FROM s WHERE place > 0
), o AS (
  SELECT r, first, own, e, replace(substr(own, 1, e), ' ', '') AS plain FROM (
    SELECT r, first, own, unnest(list_filter(range(1, length(own) + 1), lambda e: e = length(own) OR substr(own, e + 1, 1) = ' ')) AS e
    FROM v WHERE kind = 'iban')
), b AS (
  SELECT r, first, max(e) AS e FROM o WHERE length(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
      string_split(substr(plain, 5) || substr(plain, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)),
      lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97) = 1
  GROUP BY r, first
), g AS (
  SELECT r, k, kind, (CASE WHEN kind IN ('account') THEN first + length(hit) - length(own) ELSE first END)::BIGINT AS a,
    (CASE WHEN kind IN ('account') THEN first + length(hit) ELSE first + length(own) END)::BIGINT AS z
  FROM v WHERE CASE kind
    WHEN 'ip' THEN regexp_full_match(hit, '(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){{3}}0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])')
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i:
      CASE WHEN i % 2 = 0 THEN substr(digits, length(digits) - i, 1)::INT
           ELSE (substr(digits, length(digits) - i, 1)::INT * 2) // 10 + (substr(digits, length(digits) - i, 1)::INT * 2) % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'url' THEN regexp_matches(own, '://.')
    WHEN 'account' THEN regexp_matches(own, '[0-9]')
    WHEN 'iban' THEN false ELSE true END
  UNION ALL
  SELECT v.r, v.k, 'iban', (v.first + length(v.hit) - length(v.own))::BIGINT, (v.first + length(v.hit) - length(v.own) + b.e)::BIGINT
  FROM v JOIN b ON b.r = v.r AND b.first = v.first AND v.kind = 'iban'
), f AS (
  SELECT r, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (WHERE k < 4) AS base,
    {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)}
  FROM g GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON f.r = d.r
"""
