"""Suffix-array dedup: remove every byte covered by a string of ``SPAN`` bytes that starts twice.

The suffixes of all texts are never sorted as a whole.  Sampling, naming and induction, the steps of
induced sorting, are spread over Spark's shuffles, which spill to disk and are re-run when lost:

* *Sampling.*  In every window of ``SPAN`` bytes the gram with the smallest hash (the last of equals) is
  the window's anchor.  Equal windows have equal anchors at equal offsets, so windows can only be equal
  when their anchors' grams are.  An anchor and the bytes of its windows are a suffix tuple.
* *Naming.*  Tuples are named by hashes and counted per name.  A tuple whose name occurs twice is a
  duplicate as a whole; one whose gram occurs once is none.  Neither is looked at again.
* *Induction.*  The other tuples of a gram meet in a shard, aligned at the anchor.  Going from the last
  byte to the first, the order of the suffixes at one offset is induced from the order at the next
  (stable buckets by one byte), and with it the common prefix of neighbours: one more than the smallest
  between them before.  A window is a duplicate when a neighbour has ``SPAN`` bytes in common.
* *Recursion.*  A gram with more than ``GROUP`` different tuples is not sorted in one place: its windows
  are cut into ever narrower zones, which are named and counted like whole tuples, down to one window.
  A shard therefore holds whole groups of at most ``GROUP`` tuples, whatever the input.

Tuples wait in written tables and shuffle files between the steps; a task keeps about ``SHARD_BYTES``.

Passages may also be measured in words (``repeated_words``): sampling and naming are the same over the
words of a text, and the windows of the tuples they leave open are named and counted one by one.  Words
are what ASCII white space splits, compared byte by byte; the white space between them is not compared.

Null is an empty text.  Texts shorter than ``SPAN`` have nothing removed, a text that repeats (also as
the same row twice) is removed whole, overlaps count, strings never cross texts and are judged on the
input.  A null id is a value like any other.  An empty table gives an empty result; extra columns, also
of clashing names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from postlens.llm.common import (
    has_bit, key_bits, mix, partitions, powers, running_hash, small_batches, span_hash, utf8, word_bounds, written,
)

SPAN = 400
GRAM = 32
GRAM_WORDS = 8
GROUP = 256
SHARD_BYTES = 12 << 20
ZONES = (96, 16, 4, 1)
PAD = 0xFF               # never a byte of UTF-8
_U = np.uint64


# --- sampling -----------------------------------------------------------------------------------

def row_key(doc_id: int | None, text: bytes) -> int:
    """64 bits that tell rows of one id apart by their text."""
    digest = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
    own = np.array([digest, 0 if doc_id is None else (doc_id + 1) & (1 << 64) - 1], _U)
    return int(mix(own[:1] + mix(own[1:]))[0].view(np.int64))


def anchors(b: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(position, first window, last window, running hash, gram hashes) of a text of at least ``span`` bytes."""
    running = running_hash(b)
    _, down = powers(len(running))
    gram = mix((running[GRAM:] - running[:-GRAM]) * down[: len(b) - GRAM + 1])
    return *smallest(gram, span - GRAM + 1), running, gram


def smallest(gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of the grams that are the smallest of a window of ``width`` grams."""
    n, at = len(gram), np.arange(len(gram))
    # the smallest of each window, by block-wise minima from both sides; on ties the last
    packed = (gram & ~_U((1 << 28) - 1)) | (_U((1 << 28) - 1) - at.astype(_U))
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(_U).max, _U)
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    chosen = ((1 << 28) - 1 - (best & _U((1 << 28) - 1)).astype(np.int64))
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen)) - 1
    return chosen[first], first, last


def suffix_tuples(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, key, pos, low, high, gram, name): anchors with the offsets of their windows."""
    def run(batches):
        for batch in batches:
            parts: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                if len(text) < span:
                    continue
                pos, first, last, running, gram = anchors(np.frombuffer(text, np.uint8), span)
                name = span_hash(running, first, last + span)
                name = mix(name + (pos - first).astype(_U))
                parts.append((doc_id, row_key(doc_id, text), pos, pos - last, pos - first, gram[pos], name))
                size += len(pos)
                if size > 50_000:
                    yield _tuples(parts)
                    parts, size = [], 0
            if parts:
                yield _tuples(parts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, key long, pos int, low int, high int, gram long, name long"
    )


def _tuples(parts):
    lengths = [len(p[2]) for p in parts]
    ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), lengths)))
    columns = [np.concatenate([p[k] for p in parts]) for k in range(2, 7)]
    return pa.RecordBatch.from_arrays([
        ids, pa.array(np.repeat([p[1] for p in parts], lengths), pa.int64()),
        *(pa.array(c.astype(np.int32)) for c in columns[:3]), *(pa.array(c.view(np.int64)) for c in columns[3:]),
    ], ["doc_id", "key", "pos", "low", "high", "gram", "name"])


def texts_of(docs: DataFrame, bits, wanted: bool) -> DataFrame:
    """(doc_id, key, text) of the rows whose key is in the bit map, or of the others."""
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), utf8(batch.column("text"))
            keys = np.array([row_key(i, t) for i, t in zip(ids.to_pylist(), texts)], np.int64)
            keep = pa.array(has_bit(bits.value, keys) == wanted)
            yield pa.RecordBatch.from_arrays(
                [ids.filter(keep), pa.array(keys).filter(keep), pa.array(texts, pa.binary()).filter(keep)],
                ["doc_id", "key", "text"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, text binary")


def with_texts(docs: DataFrame, lists: DataFrame, bits, how: str = "inner") -> DataFrame:
    """Rows of the bit map joined with one list per row; only those texts are shuffled."""
    texts, lists = texts_of(docs, bits, True).alias("t"), lists.alias("l")
    same = (F.col("t.key") == F.col("l.key")) & F.col("t.doc_id").eqNullSafe(F.col("l.doc_id"))
    return texts.join(lists, same, how).select("t.doc_id", "t.text", "l.items")


def contexts(docs: DataFrame, tuples: DataFrame, bits, span: int) -> DataFrame:
    """(gram, name, low, high, many, bytes): tuples with the bytes of their windows."""
    lists = tuples.groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("gram", "name", "pos", "low", "high", "many")).alias("items")
    )

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            size = 0
            for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist()):
                for r in items:
                    piece = text[r["pos"] - r["high"] : r["pos"] - r["low"] + span]
                    for o, v in zip(out, (r["gram"], r["name"], r["low"], r["high"], r["many"], piece)):
                        o.append(v)
                    size += len(piece)
                    if size > 4 << 20:
                        yield _contexts(out)
                        out, size = [[], [], [], [], [], []], 0
            if out[0]:
                yield _contexts(out)

    return with_texts(docs, lists, bits).mapInArrow(
        run, "gram long, name long, low int, high int, many boolean, bytes binary"
    )


def _contexts(out):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(o, k) for o, k in zip(out, kinds)], ["gram", "name", "low", "high", "many", "bytes"]
    )


# --- induction ----------------------------------------------------------------------------------

def induced(pieces: list[bytes], low: np.ndarray, high: np.ndarray, span: int) -> np.ndarray:
    """Which window offsets (tuples x offsets) are duplicates of another tuple's.

    The pieces are aligned at their anchors.  ``order`` lists the tuples by their suffix at a column and
    ``common`` is the common prefix of each with its predecessor; both are induced column by column.
    """
    m, reach = len(pieces), span - GRAM
    columns = np.full((reach + span, m), PAD, np.uint8)
    for k, piece in enumerate(pieces):
        columns[reach - high[k] : reach - high[k] + len(piece), k] = np.frombuffer(piece, np.uint8)
    order, common = np.arange(m), np.zeros(m, np.int32)
    out = np.zeros((reach + 1, m), bool)
    for c in range(reach + span - 1, -1, -1):
        byte = columns[c][order]
        by = np.argsort(byte, kind="stable")
        byte = byte[by]
        same = np.flatnonzero(byte[1:] == byte[:-1])
        after = np.zeros(m, np.int32)
        if len(same):
            # the smallest common prefix between both in the order before
            edges = np.stack([by[same] + 1, by[same + 1] + 1], 1).ravel()
            values = np.append(common, np.int32(0))
            after[same + 1] = np.minimum.reduceat(values, edges)[::2] + 1
        order, common = order[by], after
        if c <= reach:
            long = common >= span
            if long.any():
                hit = long.copy()
                hit[:-1] |= long[1:]
                out[reach - c, order[hit]] = True
    offsets = np.arange(reach + 1)[:, None]
    return (out & (offsets >= low) & (offsets <= high)).T


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first, last - 1


def shard_windows(rows: DataFrame, span: int) -> DataFrame:
    """(gram, name, from, to): duplicate windows within groups that fit a shard."""
    names = ["gram", "name", "low", "high", "bytes"]
    dealt = rows.select(*names).repartition(partitions(rows.sparkSession), "gram").sortWithinPartitions("gram", "name")

    def solve(held):
        gram, name, low, high, pieces = held
        low, high = np.array(low), np.array(high)
        row, first, last = runs(induced(pieces, low, high, span))
        return pa.RecordBatch.from_arrays([
            pa.array(np.array(gram, np.int64)[row]), pa.array(np.array(name, np.int64)[row]),
            pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
        ], ["gram", "name", "from", "to"])

    def run(batches):
        held, size = [[] for _ in names], 0
        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in names)):
                if size > SHARD_BYTES and r[0] != held[0][-1]:
                    yield solve(held)
                    held, size = [[] for _ in names], 0
                for h, v in zip(held, r):
                    h.append(v)
                size += 2 * span
        if held[0]:
            yield solve(held)

    return dealt.mapInArrow(run, "gram long, name long, from int, to int")


# --- recursion ----------------------------------------------------------------------------------

def zone_names(rows: DataFrame, width: int, span: int) -> DataFrame:
    """(gram, name, zone, low, high, core, whole): narrower zones of the windows ``low`` to ``high``.

    ``core`` names what all windows of the zone have in common, ``whole`` all of the tuple's bytes in it.
    """
    names = ["gram", "name", "low", "high", "top", "bytes"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for gram, name, low, high, top, piece in zip(*(batch.column(n).to_pylist() for n in names)):
                running = running_hash(np.frombuffer(piece, np.uint8))
                zone = np.arange(low // width, high // width + 1)
                a, b = np.maximum(zone * width, low), np.minimum(zone * width + width - 1, high)
                # an offset j starts at byte top - j of the piece
                last = np.minimum(zone * width + width - 1, span - GRAM)
                core = span_hash(running, top - zone * width, top + span - last)
                whole = mix(span_hash(running, top - b, top + span - a) + (b * 1024 + a).astype(_U))
                for o, v in zip(out, ([gram] * len(zone), [name] * len(zone), zone, a, b, core.view(np.int64), whole.view(np.int64))):
                    o.extend(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(o, np.int64)).cast(k) for o, k in zip(out, kinds)],
                ["gram", "name", "zone", "low", "high", "core", "whole"],
            )

    return rows.select(*names).mapInArrow(
        run, "gram long, name long, zone int, low int, high int, core long, whole long"
    )


def zone_windows(rows: DataFrame, span: int) -> DataFrame:
    """(gram, name, from, to): duplicate windows of groups of any size, by naming narrower and narrower zones."""
    pieces = rows.select("gram", "name", F.col("high").alias("top"), "bytes")
    open_ = rows.select("gram", "name", "low", "high")
    found = None
    for width in ZONES:
        named = written(zone_names(open_.join(pieces, ["gram", "name"]), width, span), "zones")
        kinds = written(
            named.groupBy("gram", "zone", "core", "whole").agg(F.count("*").alias("n")), "zone-names"
        )
        twice = kinds.where("n > 1").select("gram", "zone", "core", "whole")
        settled = named.join(twice, ["gram", "zone", "core", "whole"], "left_semi").select(
            "gram", "name", F.col("low").alias("from"), F.col("high").alias("to")
        )
        found = settled if found is None else found.union(settled)
        mixed = written(
            kinds.groupBy("gram", "zone", "core").agg(F.count("*").alias("kinds")).where("kinds > 1"), "zone-kinds"
        )
        # of a name that occurs twice one tuple goes on, as a partner for the others
        open_ = written(
            named.join(mixed, ["gram", "zone", "core"], "left_semi")
            .dropDuplicates(["gram", "zone", "core", "whole"]).select("gram", "name", "low", "high"), "open"
        )
    return found


# --- removal ------------------------------------------------------------------------------------

def duplicate_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, key, items): per row the byte ranges (start, end) whose windows are duplicates."""
    spark = small_batches(docs).sparkSession
    every = written(suffix_tuples(docs, span), "tuples")
    # counts are written before they are joined, so that AQE can split a frequent gram's rows
    again = written(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    some = written(every.join(again, "gram", "left_semi"), "candidates")
    # each name with one of its tuples: a name that occurs twice is a partner for the others
    one = F.min(F.struct("doc_id", "key", "pos", "low", "high")).alias("one")
    names = written(some.groupBy("gram", "name").agg(F.count("*").alias("n"), one), "names")
    kinds = written(names.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    open_ = written(
        names.join(kinds, "gram").select("one.*", "gram", "name", (F.col("kinds") > GROUP).alias("many")), "open"
    )
    twice = names.where("n > 1").select("gram", "name")
    settled = some.join(twice, ["gram", "name"], "left_semi").select(
        "doc_id", "key", F.array(F.struct(
            (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + span).alias("end")
        )).alias("parts"),
    )
    bits = spark.sparkContext.broadcast(key_bits(open_.select("key").distinct(), "key"))
    pieces = written(contexts(docs, open_, bits, span), "contexts")
    windows = shard_windows(pieces.where("not many"), span)
    large = pieces.where("many")
    if not large.isEmpty():
        windows = windows.union(zone_windows(large, span))
    # one row per tuple, with at most as many parts as it has windows; a name that occurs twice is settled
    once = names.where("n = 1").select("gram", "name")
    parts = windows.groupBy("gram", "name").agg(F.collect_set(F.struct("from", "to")).alias("windows"))
    parts = written(parts.join(once, ["gram", "name"], "left_semi"), "windows")
    solved = some.join(parts, ["gram", "name"]).select("doc_id", "key", F.transform(
        "windows", lambda w: F.struct((F.col("pos") - w["to"]).alias("start"), (F.col("pos") - w["from"] + span).alias("end"))
    ).alias("parts"))
    return settled.union(solved).groupBy("doc_id", "key").agg(F.flatten(F.collect_set("parts")).alias("items"))


def word_line(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, running hash over the words) of a text."""
    b = np.frombuffer(text, np.uint8)
    start, end = word_bounds(b)
    hashes = span_hash(running_hash(b), start, end)
    up, _ = powers(len(hashes) + 1)
    running = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[: len(hashes)], out=running[1:])
    return start, end, running


WORD_TUPLES = "doc_id long, key long, first int, last int, start int, end int, gram long, name long"


def word_tuples(docs: DataFrame, words: int) -> DataFrame:
    """Schema ``WORD_TUPLES``: per anchor its windows (``first`` to ``last``, by their first word) and their bytes."""
    names = [x.split(" ")[0] for x in WORD_TUPLES.split(", ")]

    def batch_of(parts):
        lengths = [len(p[2]) for p in parts]
        ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), lengths)))
        columns = [np.concatenate([p[k] for p in parts]) for k in range(2, 8)]
        return pa.RecordBatch.from_arrays([
            ids, pa.array(np.repeat([p[1] for p in parts], lengths), pa.int64()),
            *(pa.array(c.astype(np.int32)) for c in columns[:4]), *(pa.array(c.view(np.int64)) for c in columns[4:]),
        ], names)

    def run(batches):
        for batch in batches:
            parts: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                start, end, running = word_line(text)
                if len(start) < words:
                    continue
                at = np.arange(len(start) - GRAM_WORDS + 1)
                gram = span_hash(running, at, at + GRAM_WORDS)
                pos, first, last = smallest(gram, words - GRAM_WORDS + 1)
                name = mix(span_hash(running, first, last + words) + (pos - first).astype(_U))
                parts.append((doc_id, row_key(doc_id, text), first, last, start[first], end[last + words - 1], gram[pos], name))
                size += len(pos)
                if size > 50_000:
                    yield batch_of(parts)
                    parts, size = [], 0
            if parts:
                yield batch_of(parts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, WORD_TUPLES)


def word_windows(docs: DataFrame, tuples: DataFrame, bits, words: int) -> DataFrame:
    """(doc_id, key, start, end, name): the windows of some tuples, one by one."""
    lists = tuples.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("items"))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text, items in zip(ids, batch.column("text").to_pylist(), batch.column("items").to_pylist()):
                start, end, running = word_line(text)
                at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in items])
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_id] * len(at), pa.int64()), pa.array([row_key(doc_id, text)] * len(at), pa.int64()),
                    pa.array(start[at].astype(np.int32)), pa.array(end[at + words - 1].astype(np.int32)),
                    pa.array(span_hash(running, at, at + words).view(np.int64)),
                ], ["doc_id", "key", "start", "end", "name"])

    return with_texts(docs, lists, bits).mapInArrow(run, "doc_id long, key long, start int, end int, name long")


def repeated_words(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, items): per row the byte ranges of the runs of ``words`` words that stand twice."""
    spark = small_batches(docs).sparkSession
    every = written(word_tuples(docs, words), "word-tuples")
    again = written(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "word-grams")
    some = written(every.join(again, "gram", "left_semi"), "word-candidates")
    one = F.min(F.struct("doc_id", "key", "first", "last")).alias("one")
    names = written(some.groupBy("gram", "name").agg(F.count("*").alias("n"), one), "word-names")
    kinds = written(names.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "word-kinds")
    # of a name that occurs twice one tuple goes on, as a partner for the others
    open_ = written(names.join(kinds, "gram", "left_semi").select("one.*"), "word-open")
    bits = spark.sparkContext.broadcast(key_bits(open_.select("key").distinct(), "key"))
    windows = written(word_windows(docs, open_, bits, words), "word-windows")
    twice = written(windows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "word-twice")
    settled = some.join(names.where("n > 1").select("gram", "name"), ["gram", "name"], "left_semi")
    found = settled.select("doc_id", "key", "start", "end").union(
        windows.join(twice, "name", "left_semi").select("doc_id", "key", "start", "end")
    )
    return found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("items"))


def merged(items) -> list[tuple[int, int]]:
    """Maximal runs of sorted, possibly overlapping or touching ranges."""
    out: list[list[int]] = []
    for r in sorted((r["start"], r["end"]) for r in items or ()):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [tuple(r) for r in out]


def removed(docs: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, items) of the rows that may lose bytes, with their ranges; (doc_id, text) of the others."""
    spans = written(duplicate_spans(docs, span), "spans")
    bits = docs.sparkSession.sparkContext.broadcast(key_bits(spans.select("key"), "key"))
    rest = texts_of(docs, bits, False).select("doc_id", "text")
    return with_texts(docs, spans, bits, "left"), rest


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batches):
    for batch in batches:
        out = [[], [], [], []]
        items = batch.column("items").to_pylist() if "items" in batch.schema.names else [None] * batch.num_rows
        for text, own in zip(batch.column("text").to_pylist(), items):
            cut = merged(own)
            kept, at = hashlib.sha256(), 0
            for a, b in cut:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            for o, v in zip(out, (len(text), sum(b - a for a, b in cut), len(cut), kept.hexdigest())):
                o.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())],
            [x.split(" ")[0] for x in DIGESTS.split(", ")],
        )


def digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes of every row."""
    cut, rest = removed(docs, span)
    return cut.mapInArrow(_digest, DIGESTS).union(rest.mapInArrow(_digest, DIGESTS))


def without_duplicates(docs: DataFrame, span: int = SPAN, words: int | None = None) -> DataFrame:
    """All rows with the removed bytes gone; a letter that loses some of its bytes goes whole.

    With ``words``, runs of so many words that stand twice go too, however few bytes they have.
    Other columns stay; ``n_chars`` follows the text.  A null text stays null.
    """
    spans = duplicate_spans(docs, span)
    if words is not None:
        spans = spans.union(repeated_words(docs, words)).groupBy("doc_id", "key").agg(
            F.flatten(F.collect_list("items")).alias("items")
        )
    spans = written(spans, "spans")
    bits = docs.sparkSession.sparkContext.broadcast(key_bits(spans.select("key"), "key"))
    names, schema = docs.columns, docs.schema
    key, ranges = unused(names, "key"), unused(names, "items")

    def keyed(wanted):
        def run(batches):
            for batch in batches:
                texts = utf8(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                keys = np.array([row_key(i, t) for i, t in zip(ids, texts)], np.int64)
                keep = pa.array(has_bit(bits.value, keys) == wanted)
                yield pa.RecordBatch.from_arrays(
                    [*(c.filter(keep) for c in batch.columns), pa.array(keys).filter(keep)], [*batch.schema.names, key]
                )
        return docs.mapInArrow(run, _plus(schema, key))

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text, own in zip(texts, batch.column(ranges).to_pylist()):
                data, at, parts = (text or "").encode(), 0, []
                for a, b in merged(own):
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                out.append(None if text is None else b"".join(p for p in map(_letters, parts)).decode())
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(out, batch.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    some, lists = keyed(True).alias("t"), spans.alias("l")
    same = (F.col(f"t.{key}") == F.col("l.key")) & F.col("t.doc_id").eqNullSafe(F.col("l.doc_id"))
    joined = some.join(lists, same, "left").select(*[f"t.`{n}`" for n in names], F.col("l.items").alias(ranges))
    return joined.mapInArrow(cut, schema).union(keyed(False).drop(key))


def unused(names: list[str], name: str) -> str:
    """``name`` with underscores until no column has it, whatever its case."""
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name


def _plus(schema, name):
    return StructType([*schema.fields, StructField(name, LongType())])


def _letters(part: bytes) -> bytes:
    """Without broken letters at either end."""
    return part.decode("utf-8", "ignore").encode()
