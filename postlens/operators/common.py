"""Shared relational building blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.tables import written


def per_context(build: Callable):
    """Keep what ``build`` returns for the life of the Spark context.

    Column objects can be reused in any query; building a large one costs more
    than planning it.
    """
    kept: dict = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._active_spark_context), *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def computed(df: DataFrame) -> DataFrame:
    """``df`` whose columns are computed where they stand: a filter above reads them.

    Spark moves a filter below the columns that it names and computes them there a second time, without
    sharing common parts.  It does not move one below a generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key.

    ``row_number() = 1`` lets Spark cut every key to one row per map task before
    the shuffle, so a key with a third of all rows does not load one task.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


FILTER_WORDS = 1 << 18            # 64-bit words of a filter of keys: 4 MB at most


def key_filter(spots: DataFrame) -> DataFrame:
    """(__word, __bits): one bit per 64-bit number ``spot``; at most ``FILTER_WORDS`` rows whatever there is."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("spot")))
    return spots.select(_word(F.col("spot")).alias("__word"), one.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def _word(spot: Column) -> Column:
    return F.pmod(F.shiftright(spot, 6), F.lit(FILTER_WORDS))


def _bit(spot: Column) -> Column:
    return spot.bitwiseAND(F.lit(63)).cast("int")


def in_filter(bits: Column, spot: Column) -> Column:
    return F.coalesce(F.getbit(bits, _bit(spot)) == 1, F.lit(False))


def first_per_key_in_place(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``first_per_key`` of a table most of whose keys stand once: their rows are not moved.

    Of every row the 64-bit hash of its key is moved and counted.  A hash that is there once is a key that is there
    once; the rows of the others, and those that share their bit in a filter of 4 MB, are compared by key.
    """
    alone, again = apart_by_key(rows, keys)
    return alone.unionByName(written(first_per_key(again, keys, order), "firsts"))


def apart_by_key(rows: DataFrame, keys: Sequence[str], stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(alone, again) of a table: rows whose key is certainly in no other row, nor in ``stored``, and the others."""
    spot = F.xxhash64(*keys)
    spots = rows.select(spot.alias("spot"))
    if stored is not None:
        spots = spots.unionByName(stored.select(spot.alias("spot")))
    twice = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = written(key_filter(twice.select("spot")), "key-filter")
    told = rows.withColumn("__word", _word(spot)).join(F.broadcast(bits), "__word", "left")
    held = in_filter(F.col("__bits"), spot)
    return told.where(~held).select(*rows.columns), told.where(held).select(*rows.columns)


@dataclass(frozen=True)
class Part:
    """Columns made of ``inputs`` alone, step by step; a step may replace an input by its cleaned form."""

    inputs: tuple[str, ...]
    steps: tuple[dict[str, Column], ...]
    outputs: tuple[str, ...]


REPEATS = 4               # rows per distinct text from which texts are parsed apart
APART = 200_000           # distinct texts of a part at most, about


def with_parts(rows: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """``rows`` with the outputs of ``parts``.  Where texts repeat, each distinct one is parsed once.

    One pass counts the distinct inputs of each part.  A part with few is parsed over these as a table, which
    the rows meet by an equi join (its size is known, so a small one is broadcast); the others, and those of a
    stream, are parsed row by row.  Results are the same.
    """
    apart = [] if rows.isStreaming else _repeated(rows, parts)
    if apart:
        kinds = {f.name: f.dataType for f in rows.schema}
        names = list(dict.fromkeys(c for part in apart for c in part.inputs))
        stacked = F.array(*[F.struct(F.lit(i).alias("__part"), *[
            (F.col(c) if c in part.inputs else F.lit(None).cast(kinds[c])).alias(c) for c in names
        ]) for i, part in enumerate(apart)])
        texts = written(rows.select(F.inline(stacked)).distinct(), "texts")
        for i, part in enumerate(apart):
            made = texts.where(F.col("__part") == i).select(*part.inputs, *[F.col(c).alias(f"__of_{c}") for c in part.inputs])
            for step in part.steps:
                made = made.withColumns(step)
            made = written(made.select(*[f"__of_{c}" for c in part.inputs], *part.outputs), "parsed")
            same = F.lit(True)
            for c in part.inputs:
                same = same & F.col(f"rows.{c}").eqNullSafe(F.col(f"made.__of_{c}"))
            kept = [F.col(f"rows.`{c}`") for c in rows.columns if c not in part.outputs]
            rows = rows.alias("rows").join(made.alias("made"), same, "left").select(
                *kept, *[F.col(f"made.{c}") for c in part.outputs]
            )
    others = [p for p in parts if p not in apart]
    for n in range(max([len(p.steps) for p in others], default=0)):
        rows = rows.withColumns({k: v for p in others for k, v in (p.steps[n] if n < len(p.steps) else {}).items()})
    return rows


def _repeated(rows: DataFrame, parts: Sequence[Part]) -> list[Part]:
    counts = rows.agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.xxhash64(*p.inputs)) for p in parts]).first()
    return [p for p, n in zip(parts, counts[1:]) if n <= APART and n * REPEATS <= counts[0]]


def join_hot(rows: DataFrame, one: DataFrame, key: str, share: int = 100) -> DataFrame:
    """Inner equi join of many ``rows`` with ``one`` row per ``key``, whatever a key's share of the rows.

    A key with more than 1/``share`` of all rows is met by broadcast, of which there are fewer than ``share``
    by that very bound; the other keys by an ordinary join, in which none is hot.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNotNull())
    total = counts.agg(F.sum("n")).scalar()
    hot = [r[0] for r in counts.where(F.col("n") * share > total).select(key).limit(share).collect()]
    if not hot:
        return rows.join(one, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(one.where(~is_hot), key).unionByName(
        rows.where(is_hot).join(F.broadcast(one.where(is_hot)), key)
    )


def page_of(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page plus the unpaginated ``total`` of the same frame.

    The total is an aggregate, not a window over everything; the page is a top-k.
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


SLICE_ROWS = 250_000      # rows of a slice, about
SCAN = 256                # slices that one task scans


def ordered_slices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` as a table with ``slice``, in which slices of about ``SLICE_ROWS`` rows follow ``order``.

    The range partitioning splits any key or hour that is hot, as long as ``order`` tells rows apart.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLICE_ROWS))
    dealt = df.repartitionByRange(parts, *order)
    return written(dealt.withColumn("slice", F.spark_partition_id()), "slices")


def before_slice(parts: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), maxima: Sequence[str] = ()) -> DataFrame:
    """Per row (*keys, slice) of ``parts`` the sums and maxima over the earlier slices of its key, null at the first.

    A scan in levels: blocks of ``SCAN`` slices are scanned apart, then the totals of the blocks in the same
    way, so no task sees more than ``SCAN`` rows of a key.
    """
    columns = [*sums, *maxima]
    most = parts.agg(F.max("slice")).first()[0]

    def scan(level: DataFrame, last: int) -> DataFrame:
        block = F.floor(F.col("slice") / SCAN).cast("int")
        earlier = Window.partitionBy(*keys, "__block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        inside = level.withColumn("__block", block).select(
            *keys, "slice", "__block", *[F.sum(c).over(earlier).alias(c) for c in sums],
            *[F.max(c).over(earlier).alias(c) for c in maxima],
        )
        if last < SCAN:
            return inside.drop("__block")
        totals = level.groupBy(*keys, block.alias("slice")).agg(
            *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima]
        )
        above = scan(totals, last // SCAN).select(
            *keys, F.col("slice").alias("__block"), *[F.col(c).alias(f"__{c}") for c in columns]
        )
        joined = inside.join(above, [*keys, "__block"])
        both = {c: F.coalesce(F.col(c) + F.col(f"__{c}"), c, f"__{c}") for c in sums}
        both |= {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in maxima}     # later slices hold the greater values
        return joined.withColumns(both).drop("__block", *[f"__{c}" for c in columns])

    return scan(parts, most or 0)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Cumulative sums per key in ``order`` without sorting a whole key in one task.

    Rows are summed inside (key, slice); the totals of earlier slices, a small frame, are added by a join.
    """
    return totals_in_slices(ordered_slices(df, [*keys, *order]), keys, order, sums).drop("slice")


def totals_in_slices(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    groups = [*keys, "slice"]
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = written(rows.groupBy(*groups).agg(*[F.sum(v).alias(n) for n, v in sums.items()]), "slice-totals")
    carried = before_slice(totals, keys, list(sums))
    carried = carried.select(*groups, *[F.col(n).alias(f"__before_{n}") for n in sums])
    joined = rows.withColumns({n: F.sum(v).over(inside) for n, v in sums.items()}).join(carried, groups)
    return joined.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"__before_{n}"), F.lit(0)) for n in sums}
    ).drop(*[f"__before_{n}" for n in sums])
