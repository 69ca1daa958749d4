"""Sharding by fixed virtual slots.

A record's id and text hash choose one of ``SLOTS`` virtual slots for good.  Bytes are summed per slot, and a
versioned table maps slots to shards.  Rebalancing reads the newest version, moves a few slots and appends
the edited map as the next version, so records only move with their slot.

A slot may be too heavy for one shard (rows that are equal in all they are hashed by).  It is split into
parts of about 1/``PARTS`` of a shard by the bytes that stand before a record in the slot's order, and its parts are
placed like slots; the map keeps the part size, so a split slot stays split alike.  One record is never split.

The driver sees one row per slot or part: ``SLOTS`` and at most 2 * ``PARTS`` * shards more.  Rows that are
equal in id, size and checksum travel as one row with a count.

The law is ``bytes``: shards get nearly equal sizes.  ``slot`` is a row's place in its shard, gapless
from 0; ``virtual_slot`` is the virtual slot and ``part`` its part, 0 if it isn't split.  Equal texts (the groups)
of different ids have slots of their own.  A null text has no bytes, a null id is a value like any
other, repeated rows take one place each, an empty table gives an empty result, extra columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlens.llm.common import work_path

SLOTS = 4096
SHARDS = 40
OVERHEAD = 16         # bytes of a record besides its text
PARTS = 16            # parts of a split slot that would fill a shard
NEAR = 10_000         # shards are even when they differ by less than this part of their mean
RUN = 10_000          # repeats of a row that are written out at once
MAP = "version int, virtual_slot int, part int, part_bytes long, shard int"

Key = tuple[int, int]     # virtual slot, part


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(
        F.col("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOTS)).cast("int"))


def first_map(shards: int, slots: int = SLOTS) -> dict[Key, int]:
    return {(s, 0): s % shards for s in range(slots)}


def rebalance(current: dict[Key, int], load: dict[Key, int], shards: int) -> dict[Key, int]:
    """An edited map: slots move, or change places, from the fullest to the emptiest shards while that
    narrows the gap between them.  A shard that can't give (one heavy slot) is left to itself, the others go on."""
    after = dict(current)
    held: list[dict[Key, int]] = [{} for _ in range(shards)]
    for slot, shard in after.items():
        held[shard][slot] = load.get(slot, 0)
    total = [sum(h.values()) for h in held]
    enough = sum(total) // shards // NEAR
    givers = set(range(shards))
    while givers:
        high = max(givers, key=lambda k: (total[k], -k))
        lows = sorted((k for k in range(shards) if k != high), key=lambda k: (total[k], k))[:3]
        if not lows or total[high] - total[lows[0]] <= enough:
            break
        for low in lows:
            change = _change(held[high], held[low], total[high] - total[low])
            if change:
                for s, a, b in zip(change, (high, low), (low, high)):
                    if s is not None:
                        size = held[a].pop(s)
                        held[b][s] = size
                        total[a] -= size
                        total[b] += size
                        after[s] = b
                break
        else:
            givers.discard(high)
    return after


def _change(high: dict[Key, int], low: dict[Key, int], gap: int) -> tuple[Key, Key | None] | None:
    """The slot to give and the one to take back: the best change shifts half the gap, any must shift less than all."""
    best = min(
        ((abs(gap - 2 * size), slot, None) for slot, size in high.items() if 0 < size < gap),
        default=None, key=lambda g: g[:2],
    )
    if best is None or best[0] > gap // 50:
        ordered = sorted((size, slot) for slot, size in low.items())
        for slot, size in high.items():
            at = bisect.bisect_left(ordered, (size - gap // 2,))
            for other_size, other in ordered[max(0, at - 1) : at + 1]:
                shift = size - other_size
                if 0 < shift < gap and (best is None or abs(gap - 2 * shift) < best[0]):
                    best = (abs(gap - 2 * shift), slot, other)
    return best and best[1:]


def newest_map(spark: SparkSession, path: str) -> tuple[int, dict[Key, int], dict[int, int]]:
    """The newest stored version: its number (0 without any), the map, and the part size of each split slot."""
    try:
        stored = spark.read.schema(MAP).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}, {}
    version = stored.agg(F.max("version")).first()[0] or 0
    rows = stored.where(F.col("version") == version).collect()
    return (
        version, {(r.virtual_slot, r.part): r.shard for r in rows},
        {r.virtual_slot: r.part_bytes for r in rows if r.part_bytes},
    )


def placed(rows: DataFrame, split: dict[int, int]) -> DataFrame:
    """Distinct rows with their number ``n`` and the rows and bytes that stand before them in their slot."""
    groups = rows.groupBy("virtual_slot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    before = (
        Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    part_bytes = F.lit(None).cast("long")
    if split:
        sizes = F.create_map(*[F.lit(x) for pair in sorted(split.items()) for x in pair])
        part_bytes = F.element_at(sizes, F.col("virtual_slot")).cast("long")
    return groups.withColumns({
        "rows_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "bytes_before": F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)),
        "part_bytes": part_bytes,
    })


def each_row(groups: DataFrame) -> DataFrame:
    """One row for every repeat, with its part and its place ``inside`` the slot."""
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
    repeat = F.explode(F.sequence("first", F.least(F.col("first") + RUN, F.col("n")) - 1))
    rows = groups.withColumn("first", run).withColumn("k", repeat)
    part = F.floor((F.col("bytes_before") + F.col("k") * F.col("size")) / F.col("part_bytes")).cast("int")
    return rows.withColumns({
        "part": F.coalesce(part, F.lit(0)), "inside": F.col("rows_before") + F.col("k"),
    })


def part_loads(groups: DataFrame, split: dict[int, int]) -> dict[Key, tuple[int, int]]:
    """Bytes and rows of each part of the split slots."""
    some = each_row(groups.where(F.col("part_bytes").isNotNull()))
    sums = some.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return {(r.virtual_slot, r.part): (r.bytes, r.n) for r in sums.collect()}


def assign(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """The shard and place of every row.  ``path``: folder of the stored map, whose newest version is edited;
    without it a map is begun in the work folder."""
    spark, rows = docs.sparkSession, records(docs)
    path = path or work_path(spark, "slot-map")
    version, current, split = newest_map(spark, path)
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    loads = {(r.virtual_slot, 0): (r.bytes, r.n) for r in sums.collect()}          # SLOTS rows at most
    part_bytes = max(1, sum(b for b, _ in loads.values()) // (shards * PARTS))
    split = {s: part_bytes for (s, _), (b, _) in loads.items() if b > 2 * part_bytes} | split
    groups = placed(rows, split)
    if split:
        loads = {k: v for k, v in loads.items() if k[0] not in split} | part_loads(groups, split)
    start = {k: s for k, s in first_map(shards).items() if k[0] not in split}
    start |= {(s, p): (s + p) % shards for s, p in loads} | {k: s for k, s in current.items() if s < shards}
    newest = rebalance(start, {k: b for k, (b, _) in loads.items()}, shards)
    if newest != current:
        edited = [(version + 1, s, p, split.get(s), k) for (s, p), k in sorted(newest.items())]
        spark.createDataFrame(edited, MAP).coalesce(1).write.mode("append").parquet(path)
    # a slot's rows follow those of the shard's earlier slots
    begin, upto, ahead = [], [0] * shards, defaultdict(int)
    for slot, part in sorted(newest):
        shard, n = newest[slot, part], loads.get((slot, part), (0, 0))[1]
        begin.append((slot, part, shard, upto[shard] - ahead[slot]))
        upto[shard] += n
        ahead[slot] += n
    offsets = spark.createDataFrame(begin, "virtual_slot int, part int, shard int, offset long")
    return (
        each_row(groups).join(F.broadcast(offsets), ["virtual_slot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "part",
        )
    )
