"""Benchmark decontamination by spaced seeds.

A mask names token offsets; a seed is the hash of the tokens at those offsets, so tokens between them
may differ.  Benchmark items are hashed at every position, documents at every ``STRIDE``-th one.  The
masks and the stride are such that any ``WINDOW`` aligned tokens with at most ``SUBSTITUTIONS``
differences contain a seed, whatever the phase (a test tries all placements).  Hits name (document,
item, shift); around each, document and item are compared token by token and the pair counts when
some window of ``WINDOW`` tokens differs in at most ``SUBSTITUTIONS`` places.  Items shorter than the
window must stand in the document as a whole; items of fewer than ``FEWEST`` tokens are no evidence.

Tokens are runs of letters and digits, lower case.  Everything is DataFrame work.  Benchmark seeds are
broadcast only after their number has been checked and join by a shuffle otherwise.

Only texts with a hit move: a bit map of the hit rows' keys (2 MB at most) meets the texts where they
are.  A row is told by its id and its text, so rows of one id are judged one by one.

Null or empty texts and items match nothing.  A null id is a value: its pair is reported with a null id.
Repeated rows give one pair; ties don't occur; an empty table gives an empty result; extra columns,
also of clashing names, are ignored.  Whole texts are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import BITMAP_BITS, written

MASKS = ((0, 1, 2, 3), (0, 1, 4, 5))
STRIDE = 3
WINDOW = 13
SUBSTITUTIONS = 2
FEWEST = 6
BROADCAST_SEEDS = 1_000_000     # about 40 MB
SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """The tokens of a text; a blank one stands at an end that has separators."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def seeds(words: Column, stride: int) -> Column:
    """Array of (pos, seed) at every ``stride``-th position; a mask's number is part of its hash.

    Words are hashed once; a mask then hashes a few numbers.  Past the end of a text a seed lacks
    numbers and equals none of the benchmark's, which are all whole.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def at_all(h):
        first = F.greatest(F.size(h) - (min(m[-1] for m in MASKS) + 1), F.lit(-1))
        return F.when(first >= 0, F.transform(
            F.sequence(F.lit(0), first, F.lit(stride)),
            lambda i: F.struct(i.alias("pos"), *[
                F.xxhash64(F.lit(k), *[F.get(h, i + c) for c in mask]).alias(f"seed{k}")
                for k, mask in enumerate(MASKS)
            ]),
        ))

    return F.flatten(F.transform(F.array(hashes), at_all))


def exploded(rows: DataFrame, ident: str, words: Column, stride: int) -> DataFrame:
    """(id, pos, seed): one row per seed."""
    at = rows.select(ident, F.explode(seeds(words, stride)).alias("at"))
    each = at.select(ident, "at.pos", F.explode(F.array(*[f"at.seed{k}" for k in range(len(MASKS))])).alias("seed"))
    return each


def row_key() -> Column:
    """64 bits of a row's id and text."""
    return F.xxhash64("doc_id", "text")


def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) and ``mark``: whether the bit of the key is set by a key of ``marks``.

    The map is a table of at most 512 rows of 4 kB, so it is broadcast.  It may mark other rows too.
    """
    spot = F.pmod(F.col("key"), F.lit(BITMAP_BITS)) + 1
    bits = marks.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")
    )
    placed = rows.withColumns({"at": F.bitmap_bit_position(spot), "bucket": F.bitmap_bucket_number(spot)})
    byte = "cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    mark = F.expr(f"coalesce(shiftright({byte}, cast(at % 8 as int)) & 1 = 1, false)")
    return placed.join(F.broadcast(bits), "bucket", "left").select(*rows.columns, mark.alias("mark"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words, n: items that can be evidence, each once."""
    words = F.filter(tokens(F.col("text")), lambda w: w != "")
    return (
        benchmark.select("item_id", words.alias("item_words")).distinct()
        .withColumn("n", F.size("item_words")).where(F.col("n") >= FEWEST)
    )


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, item_pos, seed) with every offset of the mask inside the item."""
    last = {k: m[-1] for k, m in enumerate(MASKS)}
    at = items.select("item_id", "n", F.explode(seeds(F.col("item_words"), 1)).alias("at"))
    parts = [
        at.where(F.col("at.pos") + last[k] < F.col("n"))
        .select("item_id", F.col("at.pos").alias("item_pos"), F.col(f"at.seed{k}").alias("seed"))
        for k in range(len(MASKS))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, shift): where a seed of an item stands in a row of (key, doc_id, text)."""
    own = written(item_seeds(items), "seeds")
    if own.count() <= BROADCAST_SEEDS:
        own = F.broadcast(own)
    rows = docs.select(F.struct("key", "doc_id").alias("row"), "text")
    found = exploded(rows, "row", tokens(F.col("text")), STRIDE)
    return found.join(own, "seed").select(
        "row.key", "row.doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")
    ).distinct()


def overlap(words: Column, item: Column, n: Column, shift: Column) -> Column:
    """Most equal tokens in a window of the item laid over the document at ``shift``."""
    def best(same):
        return F.array_max(F.transform(
            F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
            lambda k: F.aggregate(F.slice(same, k, WINDOW), F.lit(0), lambda a, b: a + b),
        ))
    same = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.when((k + shift >= 0) & (F.get(words, k + shift) == F.get(item, k)), 1).otherwise(0),
    )
    return F.element_at(F.transform(F.array(same), best), 1)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, item_id, matched: contaminated rows with the tokens matched in the best window."""
    items = written(items_of(benchmark), "items")
    rows = docs.select(row_key().alias("key"), "doc_id", "text")
    hit = written(hits(rows, items), "hits")
    found, items = hit.alias("h"), items.alias("i")
    texts = with_marks(rows, hit).where("mark").alias("d")
    laid = found.join(items, F.col("h.item_id").eqNullSafe(F.col("i.item_id"))).select(
        "h.key", "h.doc_id", "h.item_id", "h.shift", "i.item_words", "i.n"
    ).alias("p")
    same = (F.col("d.key") == F.col("p.key")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
    compared = texts.join(laid, same).select(
        "p.key", "p.doc_id", "p.item_id", "n",
        overlap(tokens(F.col("d.text")), F.col("p.item_words"), F.col("p.n"), F.col("p.shift")).alias("matched"),
    )
    enough = F.when(F.col("n") >= WINDOW, WINDOW - SUBSTITUTIONS).otherwise(F.col("n"))
    return compared.where(F.col("matched") >= enough).groupBy("key", "doc_id", "item_id").agg(F.max("matched").alias("matched"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched: pairs with the tokens matched in the best window."""
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a contaminated pair, all columns."""
    bad = written(matches(docs, benchmark).select("key", "doc_id").distinct(), "contaminated").alias("b")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("key"))
    rows = with_marks(rows, bad)
    same = (F.col("r.key") == F.col("b.key")) & F.col("r.row.doc_id").eqNullSafe(F.col("b.doc_id"))
    kept = rows.where("mark").alias("r").join(bad, same, "left_anti")
    return rows.where("not mark").select("row.*").union(kept.select("row.*"))


SQL = rf"""
WITH items AS MATERIALIZED (
  SELECT item_id, words, len(words) AS n FROM (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATORS}'), lambda w: w <> '') AS words FROM benchmark
  ) WHERE len(words) >= {FEWEST}
), item_tokens AS (SELECT item_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS item_pos FROM items),
doc_words AS (SELECT doc_id, regexp_split_to_array(lower(text), '{SEPARATORS}') AS words FROM documents),
doc_tokens AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM doc_words),
same AS (
  SELECT doc_id, item_id, n, pos - item_pos AS shift, item_pos FROM doc_tokens JOIN item_tokens USING (word)
), laid AS (
  SELECT doc_id, item_id, n, shift, list_distinct(list(item_pos)) AS spots FROM same GROUP BY doc_id, item_id, n, shift
  HAVING count(*) >= least(n, {WINDOW - SUBSTITUTIONS})
), best AS (
  SELECT doc_id, item_id, n, list_max(list_transform(range(0, greatest(n - {WINDOW - 1}, 1)),
    lambda k: len(list_filter(spots, lambda p: p >= k AND p < k + {WINDOW})))) AS matched FROM laid
)
SELECT doc_id, item_id, max(matched)::INT AS matched FROM best
WHERE matched >= CASE WHEN n >= {WINDOW} THEN {WINDOW - SUBSTITUTIONS} ELSE n END GROUP BY doc_id, item_id
"""
