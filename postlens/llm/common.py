"""Shared helpers of the corpus operators: work folder, written tables, text kernels, components.

Text kernels work on the UTF-8 bytes of many texts at once.  Word and window hashes are 64-bit
polynomial hashes taken from one running sum, so their cost does not depend on their length.
"""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# --- work folder ------------------------------------------------------------------------------

@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='postlens-')}"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.  Only a session of one machine may have none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root or _own_folder()


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Whole texts are long: Arrow batches of fewer rows keep a task's memory small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal text falls into the held-out part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


# --- hashing ----------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def salted(seed: int, size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=_U) * _BASE + _U(seed))


_BYTE = salted(7, 256) | _U(1)
_STEP = salted(11, 64) | _U(1)
_ODD = 0xD6E8FEB86659FD93
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    if "up" not in _powers or len(_powers["up"]) < size:
        size = max(size, SLICE_BYTES + 4096)
        for name, step in (("up", _ODD), ("down", _ODD_INVERSE)):
            out = np.full(size, step, _U)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def running_hash(b: np.ndarray) -> np.ndarray:
    up, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * up[: len(b)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end); equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(running))
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(_U) * _BASE)


def slices(texts: list[bytes], most: int = SLICE_BYTES):
    """Consecutive index ranges of texts that hold about ``most`` bytes; a longer text is alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    return [b"" if v is None else v for v in column.cast("binary").to_pylist()]


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last; ASCII white space splits."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (ASCII white space splits, A-Z folded) and the number of words per text."""
    data = b"\n".join(texts).lower()
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    start, end = word_bounds(b)
    hashes = span_hash(running_hash(b), start, end)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, bounds)
    return hashes, np.diff(upto, prepend=0)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; a shorter text is one run, none has none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size * int(_BASE) & (1 << 64) - 1, _U)
    for k in range(size):
        total += words[k : k + n] * _STEP[k % 64]
        if k % 64 == 63:
            total = mix(total)
    return mix(total)


# --- bit maps: bounded filters of keys ----------------------------------------------------------

BITMAP_BITS = 1 << 24


def key_bits(df: DataFrame, key: str) -> np.ndarray:
    """A fixed-size bit map of 64-bit keys (2 MB), built where the rows are.

    It only saves shuffling rows that can't match; a full map lets every row through.
    """
    spot = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    rows = (
        df.select((spot + 1).alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows:
        at = (r.bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = (keys.astype(np.int64) % BITMAP_BITS).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


# --- connected components -----------------------------------------------------------------------

def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node it reaches.

    Alternates the two star steps: each node hands its larger (then its smaller) neighbours to the
    smallest one.  A step is an aggregate and an equi join, so a hub is split by AQE; each round is a
    written table.  The number of rounds grows with the logarithm of the longest path.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = written(pairs.distinct(), name)
    for _ in itertools.count():
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = written(small.union(low.select("a", F.col("low").alias("b"))).distinct(), name)
        changed = after.exceptAll(pairs).isEmpty() and pairs.exceptAll(after).isEmpty()
        pairs = after
        if changed:
            break
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
