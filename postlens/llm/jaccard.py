"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct word shingles; two sets link when their Jaccard similarity
reaches a threshold.  Equal sets are one class from the start, so copies never meet pairwise.

1. One pass counts shingles in a fixed-size sketch, which gives every task the same global order, rare
   shingles first (any fixed order is exact; a good one is fast).
2. Linked sets share a shingle among the first ``n - ceil(t n) + 1`` of either.  These prefixes form
   inverted lists, one entry (shingle, set, position) each, in the order of set size; parts with too
   small sets are skipped at once, then entries whose position leaves too few shingles.  Every list
   names as pivot its entry with the smallest position.
3. Sets are compared by signatures first: the parity of their shingles in 2^k fields.  Two signatures
   differ in at most as many fields as the sets do in shingles, so a pair that is too far apart is
   dropped without its sets; only sets of pairs that remain are fetched.
4. Each set is compared with its pivots.  Sets of a pivot that are then connected need no pair; only
   those outside the largest class of a pivot are joined with the rest, in blocks of bounded size.
5. A block is joined exactly.  The answers of one set bound those of a similar one: |y n z| lies between
   |x n z| - |x \\ y| and |x n z| + |y \\ x|, so most pairs of near copies are settled without looking
   at them, and pairs that are already connected are skipped.

Lists that may be longer than ``LONG`` by the sketch are counted; those that are find their pivots by an
aggregate and a join, one for each two neighbouring bands of set size, so no list has to fit into a
task.  No link between different sets is lost.

A text with fewer words than a shingle is one shingle; a null text or one without words has an empty
set and links with nothing.  A null id belongs to its class but names none: a component of null ids
only has a null id.  Rows that repeat have one component; an empty table gives an empty result; extra
columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import (
    components, has_bit, key_bits, mix, partitions, shingle_hashes, slices, small_batches, utf8, word_hashes, written,
)

SKETCH_BITS = 20
SKETCH_PARTS = 64
LONG = 5000            # entries; longer lists are handled by joins, whatever their length is
PART = 256             # entries; in longer parts of a list every entry stays a candidate
CHUNK = 140            # sets of a side of a block
SLICE = 280            # sets compared with a pivot at a time
_U = np.uint64


# --- sets ---------------------------------------------------------------------------------------

def text_sets(batches, size: int):
    """Per batch: (batch, row, sorted distinct shingle hashes) for every row."""
    for batch in batches:
        texts = utf8(batch.column("text"))
        for a, b in slices(texts):
            words, counts = word_hashes(texts[a:b])
            ends = np.cumsum(counts)
            for k in range(b - a):
                own = words[ends[k] - counts[k] : ends[k]]
                yield batch, a + k, np.unique(shingle_hashes(own, size))


def fingerprint(own: np.ndarray) -> str | None:
    """128 bits of a set, as text; null for the empty set."""
    if not len(own):
        return None
    total = [int(mix(own ^ _U(salt)).sum(dtype=_U)) for salt in (0x51ED270B, 0xA24BAED4963EE407)]
    return f"{int(mix(np.array([total[0] + len(own) & (1 << 64) - 1], _U))[0]):016x}{total[1]:016x}"


def set_key(fp: str) -> int:
    """48 bits of a fingerprint: only groups candidates, sets are told apart by the whole."""
    return int(fp[:12], 16)


def signature(own: np.ndarray, num: int, den: int) -> bytes:
    """Parity of a set's items in 2^k fields, k by its size; halves fold onto the signature of k - 1."""
    room = 8 * len(own) * (den - num) // (den + num)
    k = max(6, room.bit_length())
    return np.packbits((np.bincount((own >> _U(64 - k)).astype(np.int64), minlength=1 << k) & 1).astype(bool)).tobytes()


def folded(sig: np.ndarray) -> np.ndarray:
    """A signature (bytes) with half as many fields."""
    bits = np.unpackbits(sig).reshape(-1, 2)
    return np.packbits(bits[:, 0] ^ bits[:, 1])


def fields_apart(a: bytes, b: bytes) -> int:
    """In how many fields two signatures differ: never more than the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = folded(x)
    while len(y) > len(x):
        y = folded(y)
    return int(np.bitwise_count(x ^ y).sum())


def may_reach(n: int, a: bytes, m: int, b: bytes, num: int, den: int) -> bool:
    """Whether sets of sizes n and m with these signatures can link."""
    if num * max(n, m) > den * min(n, m):
        return False
    return fields_apart(a, b) <= n + m - 2 * least_overlap(n, m, num, den)


def row_id() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def profile(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, row, n_shingles, fp) of every row, and the sketch of shingle counts of all rows.

    ``row`` tells rows of one id apart by their text.
    """
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        rows: tuple[list, ...] = ([], [], [], [])

        def flush():
            n = len(rows[0])
            out = pa.RecordBatch.from_arrays([
                *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.string()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            ], ["doc_id", "row", "n_shingles", "fp", "part", "counts"])
            for r in rows:
                r.clear()
            return out

        ids, keys, last = [], [], None
        for batch, k, own in text_sets(batches, size):
            if batch is not last:
                ids, keys, last = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch
            np.add.at(sketch, (own >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
            for r, v in zip(rows, (ids[k], keys[k], len(own), fingerprint(own))):
                r.append(v)
            if len(rows[0]) == 5000:
                yield flush()
        yield flush()
        for part, counts in enumerate(np.split(np.minimum(sketch, 2**31 - 1).astype(np.int32), SKETCH_PARTS)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([
                    *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.string()),
                    pa.array([part], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary()),
                ], ["doc_id", "row", "n_shingles", "fp", "part", "counts"])

    def add(key, table):
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
        for data in table["counts"]:
            total += np.frombuffer(zlib.decompress(data.as_py()), np.int32)
        total = np.minimum(total, 2**31 - 1).astype(np.int32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": [zlib.compress(total.tobytes(), 1)]})

    rows = written(
        docs.select(F.col("doc_id").cast("long"), row_id().alias("row"), "text").mapInArrow(
            run, "doc_id long, row long, n_shingles long, fp string, part int, counts binary"
        ), "sets",
    )
    sketch = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int32)
    summed = rows.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary")
    for r in summed.collect():           # SKETCH_PARTS rows, 4 MB in all
        sketch[r.part] = np.frombuffer(zlib.decompress(r.counts), np.int32)
    return rows.where("part is null").select("doc_id", "row", "n_shingles", "fp"), sketch.ravel()


# --- candidates ---------------------------------------------------------------------------------

def prefix_length(n: int, num: int, den: int) -> int:
    return n + (num * n) // -den + 1


def prefixes(docs: DataFrame, size: int, num: int, den: int, sketch) -> DataFrame:
    """(token, set, n, pos, long, sig): the prefix entries of every set, once per task and set.

    The first entry of a set carries its signature.
    """
    longest = LONG

    def run(batches):
        counts, seen = sketch.value, set()
        tokens, sets, places, sizes, sigs = [], [], [], [], []

        def flush():
            token = np.concatenate(tokens)
            lengths = [len(t) for t in tokens]
            first = [x for sig, k in zip(sigs, lengths) for x in (sig, *[None] * (k - 1))]
            heavy = counts[(token >> _U(64 - SKETCH_BITS)).astype(np.int64)] >= longest
            out = pa.RecordBatch.from_arrays([
                pa.array(token.view(np.int64)), pa.array(np.repeat(np.array(sets, np.int64), lengths)),
                pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                pa.array(np.concatenate(places).astype(np.int32)), pa.array(heavy), pa.array(first, pa.binary()),
            ], ["token", "set", "n", "pos", "long", "sig"])
            for x in (tokens, sets, places, sizes, sigs):
                x.clear()
            return out

        for _, _, own in text_sets(batches, size):
            fp = fingerprint(own)
            if fp is None or fp in seen:
                continue
            seen.add(fp)
            order = np.argsort(counts[(own >> _U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
            first = own[order[: prefix_length(len(own), num, den)]]
            tokens.append(first)
            sets.append(set_key(fp))
            places.append(np.arange(len(first)))
            sizes.append(len(own))
            sigs.append(signature(own, num, den))
            if len(tokens) == 500:
                yield flush()
        if tokens:
            yield flush()

    return docs.select("text").mapInArrow(run, "token long, set long, n int, pos int, long boolean, sig binary")


def may_link(n: np.ndarray, room: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which entries of a list can link with another one, by sizes and by what follows their positions."""
    need = -(-num * (n[:, None] + n[None, :]) // (num + den))
    fits = np.minimum(room[:, None], room[None, :]) >= need
    np.fill_diagonal(fits, False)
    return fits.any(1)


def short_lists(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, set) from lists that fit a task.

    A list is kept in the order of size.  Where the next size is too large for a link the list is cut,
    and in a part, entries whose position leaves too few shingles for any partner are skipped.
    """
    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        token, own, n, pos = (table[c].to_numpy() for c in ("token", "set", "n", "pos"))
        order = np.lexsort((own, n, token))
        token, own, n, pos = token[order], own[order], n[order].astype(np.int64), pos[order]
        cut = np.ones(len(token), bool)
        cut[1:] = (token[1:] != token[:-1]) | (num * n[1:] > den * n[:-1])
        begin = np.flatnonzero(cut)
        length = np.diff(begin, append=len(token))
        keep = np.zeros(len(token), bool)
        pair = begin[length == 2]
        need = -(-num * (n[pair] + n[pair + 1]) // (num + den))
        good = pair[np.minimum(n[pair] - pos[pair], n[pair + 1] - pos[pair + 1]) >= need]
        keep[good] = keep[good + 1] = True
        for a, k in zip(begin[length > 2], length[length > 2]):
            few = slice(a, a + k)
            keep[few] = k > PART or may_link(n[few], n[few] - pos[few], num, den)
        part = np.cumsum(cut) - 1
        token, own, pos, part = token[keep], own[keep], pos[keep], part[keep]
        order = np.lexsort((own, pos, part))
        own, part = own[order], part[order]
        start = np.ones(len(part), bool)
        start[1:] = part[1:] != part[:-1]
        number = np.cumsum(start) - 1
        pivot = own[start][number]
        many = np.bincount(number, weights=own != pivot)[number] > 0 if len(own) else np.zeros(0, bool)
        pairs = np.unique(np.stack([pivot[many], own[many]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["pivot", "set"])

    return entries.select("token", "set", "n", "pos").repartition(
        partitions(entries.sparkSession), "token"
    ).mapInArrow(run, "pivot long, set long")


def long_lists(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, set) from lists of any length: a pivot for each two neighbouring bands of set size.

    Sizes of one band, or of two that follow each other, hold all that can link.
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    each = entries.select("token", "set", "pos", F.explode(F.array(band, band - 1)).alias("band"))
    best = each.groupBy("token", "band").agg(
        F.min(F.shiftleft(F.least("pos", F.lit(32767)).cast("long"), 48) + F.col("set")).alias("best"),
        F.min("set").alias("low"), F.max("set").alias("high"),
    ).where("low != high")
    return each.join(best, ["token", "band"]).select(F.expr("best & 281474976710655").alias("pivot"), "set")


def pivot_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, set): all sets that may link share a pivot."""
    maybe = entries.where("long").select("token", "set", "n", "pos")
    short = entries.where("not long").select("token", "set", "n", "pos")
    if maybe.isEmpty():
        return short_lists(short, num, den).distinct()
    counted = written(maybe.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= LONG), "long-lists")
    short = short.union(maybe.join(counted, "token", "left_anti"))
    return short_lists(short, num, den).union(
        long_lists(maybe.join(counted, "token", "left_semi"), num, den)
    ).distinct()


def star(pairs: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """(block, set, pivot): slices of the sets that may link with a pivot, and the pivot in each of them."""
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n", "sig", "pivot_n", "pivot_sig")]
            keep = pa.array([may_reach(*x, num, den) for x in zip(*columns)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("pivot").filter(keep), batch.column("set").filter(keep)], ["pivot", "set"]
            )

    own = signatures.select(F.col("set").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sig").alias("pivot_sig"))
    both = pairs.where("pivot != set").join(signatures, "set").join(own, "pivot")
    near = written(both.mapInArrow(run, "pivot long, set long").distinct(), "near")
    sizes = near.groupBy("pivot").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    sliced = near.join(sizes, "pivot").select(
        F.xxhash64("pivot", F.pmod(F.xxhash64("set"), F.col("slices"))).alias("block"), "pivot", "set"
    )
    heads = sliced.select("block", F.col("pivot").alias("set"), F.lit(True).alias("pivot")).distinct()
    return sliced.select("block", "set", F.lit(False).alias("pivot")).union(heads)


def star_links(blocks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): fingerprints of sets that link with their pivot."""
    rows = blocks.join(sets, "set").select("block", "pivot", "fp", "items")
    rows = rows.repartition(partitions(blocks.sparkSession), "block").sortWithinPartitions("block", F.desc("pivot"), "fp")

    def run(batches):
        key, heads, out = None, {}, []
        for batch in batches:
            for block, pivot, fp, items in zip(*(batch.column(c).to_pylist() for c in ("block", "pivot", "fp", "items"))):
                if block != key:
                    key, heads = block, {}
                own = np.frombuffer(items, _U)
                if pivot:
                    heads[fp] = own
                    continue
                for other, head in heads.items():
                    if other == fp or num * max(len(own), len(head)) > den * min(len(own), len(head)):
                        continue
                    both = len(np.intersect1d(own, head, assume_unique=True))
                    if both >= least_overlap(len(own), len(head), num, den):
                        out.append((other, fp))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b"])
                out = []

    return rows.mapInArrow(run, "a string, b string")


def open_blocks(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(block, set, root, side, whole): sets outside the largest class of a pivot, to be joined with all its others."""
    key = F.conv(F.substring("node", 1, 12), 16, 10).cast("long")
    named = roots.select(key.alias("set"), "root")
    members = written(pairs.join(named, "set", "left").select(
        "pivot", "set", F.coalesce("root", F.col("set").cast("string")).alias("root")
    ), "members")
    classes = members.groupBy("pivot", "root").agg(F.count("*").alias("k"))
    # a pivot and one more set have met already
    sizes = written(classes.groupBy("pivot").agg(
        F.max_by("root", F.struct("k", "root")).alias("major"), F.max("k").alias("in_major"), F.sum("k").alias("n"),
    ).where("n > in_major and n > 2"), "open")
    rows = members.join(sizes, "pivot").select(
        "pivot", "set", "root", (F.col("root") == F.col("major")).alias("major"),
        F.ceil((F.col("n") - F.col("in_major")) / CHUNK).cast("long").alias("minor_chunks"),
        F.ceil(F.col("in_major") / CHUNK).cast("long").alias("major_chunks"),
    )
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("other")
    minor = rows.where("not major").withColumn("side", F.pmod(F.xxhash64("set"), F.col("minor_chunks")))
    major = rows.where("major").withColumn("side", F.pmod(F.xxhash64("set"), F.col("major_chunks")))
    inside = minor.select("pivot", "set", "root", "side", upto("minor_chunks")).select(
        F.xxhash64("pivot", F.lit(0), F.least("side", "other"), F.greatest("side", "other")).alias("block"),
        "set", "root", "side", (F.col("side") == F.col("other")).alias("whole"),
    )
    across = [
        rows_.select("pivot", "set", "root", "side", upto(chunks)).select(
            F.xxhash64("pivot", F.lit(1), *pair).alias("block"), "set", "root", F.lit(side).cast("long").alias("side"),
            F.lit(False).alias("whole"),
        )
        for rows_, chunks, pair, side in (
            (minor, "major_chunks", ("side", "other"), 0), (major, "minor_chunks", ("other", "side"), 1),
        )
    ]
    return inside.union(across[0]).union(across[1])


def near_rows(sets: list[tuple], num: int, den: int) -> list[int]:
    """Rows (root, side, whole, n, sig) of a block that by their signatures may link with another one."""
    whole = any(s[2] for s in sets)
    by: dict[int, list[int]] = {}
    shapes: dict[tuple[int, int], np.ndarray] = {}
    for i, s in enumerate(sets):
        sig = np.frombuffer(s[4], np.uint8)
        by.setdefault(len(sig), []).append(i)
        shapes[i, len(sig)] = sig
    levels, keep = sorted(by), set()
    for k, low in enumerate(levels):
        for high in levels[k:]:
            if high * num > 4 * low * den:
                break
            for i in by[high]:
                sig = shapes[i, high]
                while len(sig) > low:
                    sig = folded(sig)
                shapes[i, low] = sig
            few = np.array(by[low])
            lower = np.stack([shapes[i, low] for i in few])
            n = np.array([sets[i][3] for i in few], np.int64)
            roots, sides = np.array([sets[i][0] for i in few]), np.array([sets[i][1] for i in few])
            for i in by[high]:
                m = sets[i][3]
                fits = (num * np.maximum(n, m) <= den * np.minimum(n, m)) & (roots != sets[i][0])
                if not whole:
                    fits &= sides != sets[i][1]
                fits &= few != i
                at = np.flatnonzero(fits)
                if len(at):
                    apart = np.bitwise_count(lower[at] ^ shapes[i, low]).sum(1, dtype=np.int64)
                    at = at[apart <= n[at] + m - 2 * -(-num * (n[at] + m) // (num + den))]
                if len(at):
                    keep.add(i)
                    keep.update(few[at].tolist())
    return sorted(keep)


def near_blocks(blocks: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``open_blocks`` that by their signatures may link with another one of their block."""
    names = ["block", "set", "root", "side", "whole", "n", "sig"]
    rows = blocks.join(signatures, "set").select(*names)
    rows = rows.repartition(partitions(blocks.sparkSession), "block").sortWithinPartitions("block")

    def close(key, held):
        kept = [held[i] for i in near_rows([(h[1], h[2], h[3], h[4], h[5]) for h in held], num, den)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array([key] * len(kept), pa.int64()), *(pa.array([h[c] for h in kept], t) for c, t in enumerate(kinds))],
            names[:5],
        )

    def run(batches):
        key, held = None, []
        for batch in batches:
            for block, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if block != key and held:
                    yield close(key, held)
                    held = []
                key = block
                held.append(row)
        if held:
            yield close(key, held)

    return rows.mapInArrow(run, "block long, set long, root string, side long, whole boolean")


def wanted_sets(docs: DataFrame, size: int, bits) -> DataFrame:
    """(set, fp, items): the sets of candidates, once per task; the bit map may let others through."""
    def run(batches):
        seen, kept = set(), []

        def flush():
            out = pa.RecordBatch.from_arrays([
                pa.array([set_key(f) for f, _ in kept], pa.int64()), pa.array([f for f, _ in kept], pa.string()),
                pa.array([s.tobytes() for _, s in kept], pa.binary()),
            ], ["set", "fp", "items"])
            kept.clear()
            return out

        for _, _, own in text_sets(batches, size):
            fp = fingerprint(own)
            if fp is None or fp in seen or not has_bit(bits.value, np.array([set_key(fp)]))[0]:
                continue
            seen.add(fp)
            kept.append((fp, own))
            if len(kept) == 500:
                yield flush()
        if kept:
            yield flush()

    return docs.select("text").mapInArrow(run, "set long, fp string, items binary")


# --- joining a block ----------------------------------------------------------------------------

def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """The smallest intersection of linked sets of sizes a and b."""
    return -(-num * (a + b) // (num + den))


def join_block(sets: list[np.ndarray], sides: list[int], whole: bool, num: int, den: int, classes=None) -> list[tuple[int, int]]:
    """Pairs of links that connect whatever the links of the block connect.

    ``whole``: all pairs count, otherwise those of different sides.  Sets of one class are connected already.
    """
    if len(sets) == 2:
        a, b = sets
        small, large = sorted((len(a), len(b)))
        if num * large > den * small or (not whole and sides[0] == sides[1]):
            return []
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if both >= least_overlap(len(a), len(b), num, den) else []
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sizes = [len(sets[i]) for i in order]
    vocabulary, where, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    bounds = np.cumsum([0, *sizes])
    parent = list(range(len(order)))
    if classes is not None:
        first: dict = {}
        parent = [first.setdefault(classes[i], k) for k, i in enumerate(order)]

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    lists: dict[int, tuple[list, list]] = {}
    mark = np.zeros(len(vocabulary), bool)
    ids = [where[bounds[k] : bounds[k + 1]] for k in range(len(order))]
    answers: dict[int, int] = {}
    anchor = -1
    for x, n in enumerate(sizes):
        own = ids[x]
        ranked = own[np.lexsort((own, counts[own]))]
        front = ranked[: prefix_length(n, num, den)].tolist()
        fewest = -(-num * n // den)
        skip = bisect_left(sizes, fewest, 0, x)
        found = {}
        for i, token in enumerate(front):
            if counts[token] == 1:
                continue
            entry = lists.get(token)
            if entry is None:
                lists[token] = ([x], [i])
                continue
            who, place = entry
            for at in range(bisect_left(who, skip), len(who)):
                y = who[at]
                if y not in found:
                    room = 1 + min(n - i, sizes[y] - place[at]) - 1
                    found[y] = room >= least_overlap(n, sizes[y], num, den)
            who.append(x)
            place.append(i)
        pending = [y for y, fits in found.items() if fits and (whole or sides[order[x]] != sides[order[y]])]
        if not pending:
            continue
        mark[own] = True
        near = -1
        if anchor >= 0:
            near = int(np.count_nonzero(mark[ids[anchor]]))
            if 5 * near < 4 * max(n, sizes[anchor]):
                near = -1
        known: dict[int, int] = {anchor: near} if near >= 0 else {}
        for y in sorted(pending, reverse=True):
            if root(x) == root(y):
                continue
            need = least_overlap(n, sizes[y], num, den)
            if near >= 0 and y in answers:
                if answers[y] + n - near < need:
                    continue
                if answers[y] - (sizes[anchor] - near) >= need:
                    parent[root(x)] = root(y)
                    links.append((order[x], order[y]))
                    continue
            both = known.get(y)
            if both is None:
                both = known[y] = int(np.count_nonzero(mark[ids[y]]))
            if both >= need:
                parent[root(x)] = root(y)
                links.append((order[x], order[y]))
        mark[own] = False
        if len(known) > len(answers) // 2:
            anchor, answers = x, known
    return links


def linked(blocks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): fingerprints of linked sets, enough of them to connect every component."""
    rows = blocks.join(sets, "set").select("block", "side", "whole", "root", "fp", "items")
    n = partitions(blocks.sparkSession)
    rows = rows.repartition(n, "block").sortWithinPartitions("block", "fp")

    def run(batches):
        key, names, sets_, sides, roots, whole = None, [], [], [], [], False

        def close():
            got = join_block(sets_, sides, whole, num, den, roots) if len(names) > 1 else []
            return [(names[i], names[j]) for i, j in got]

        out = []
        for batch in batches:
            for block, side, all_pairs, root, fp, items in zip(
                *(batch.column(c).to_pylist() for c in ("block", "side", "whole", "root", "fp", "items"))
            ):
                if block != key:
                    out += close()
                    key, names, sets_, sides, roots, whole = block, [], [], [], [], False
                whole = whole or all_pairs
                if not names or names[-1] != fp:
                    names.append(fp)
                    sets_.append(np.frombuffer(items, _U))
                    sides.append(side)
                    roots.append(root)
        out += close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b"])

    return rows.mapInArrow(run, "a string, b string")


def classes_of(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_shingles, fp) of every row, and (fp, root, lowest): the component of each set, its smallest id."""
    spark = small_batches(docs).sparkSession
    rows, counts = profile(docs, size)
    sketch = spark.sparkContext.broadcast(counts)
    entries = written(prefixes(docs, size, num, den, sketch), "prefixes")
    pairs = written(pivot_pairs(entries, num, den), "pairs")
    wanted = pairs.select("set").distinct()
    signatures = entries.where("sig is not null").select("set", "n", "sig").join(wanted, "set", "left_semi")
    signatures = written(signatures.distinct(), "signatures")

    def fetched(blocks):
        bits = spark.sparkContext.broadcast(key_bits(blocks.select("set").distinct(), "set"))
        return wanted_sets(docs, size, bits)

    blocks = written(star(pairs, signatures, num, den), "stars")
    links = written(star_links(blocks, fetched(blocks), num, den), "star-links")
    roots = components(links)
    rest = written(near_blocks(open_blocks(pairs, roots), signatures, num, den), "blocks")
    if not rest.isEmpty():
        links = links.union(written(linked(rest, fetched(rest), num, den), "links"))
        roots = components(links)
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("first").alias("lowest"))
    return rows, named.join(lowest, "root").select("fp", "root", "lowest")


def similar_sets(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; a component is what links of at least num/den reach."""
    rows, named = classes_of(docs, size, num, den)
    return rows.join(named, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, all columns: that with the smallest id, then the smallest hash; null ids last.

    Rows of one id are told apart by their text, equal rows (id and text) are one.  Texts without words
    are components of their own.
    """
    rows, named = classes_of(docs, size, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    keep = rows.where("fp is not null").join(named.select("fp", "root"), "fp").groupBy("root").agg(first).select("first.row")
    keep = written(keep.union(rows.where("fp is null").select("row")).distinct(), "representatives")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), row_id().alias("row"))
    return held.join(keep, "row", "left_semi").dropDuplicates(["row"]).select("held.*")


def sql(size: int = 3, num: int = 90, den: int = 100) -> str:
    blank = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{blank}') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: hash(array_to_string(w[i : i + {size - 1}], ' ')))) END AS s FROM words
), items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM sets
"""
