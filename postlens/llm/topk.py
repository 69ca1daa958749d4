"""Exact top-k by inner product: exhaustive term-at-a-time accumulation in blocks.

Components become integers, floor(256 x).  A component is a term; a block of candidates holds a posting
list (candidate, weight) per term.  Each sparse query row scatters its weighted postings into a dense
score array of the block, the k best are picked by partition selection, and the blocks' winners merge.

Queries meet candidates on a grid of bounded blocks, so no task grows with the input; the number of
(query, candidate) products is that of the exhaustive search.

Rows with a null id, a null vector, or a null or non-finite component take no part.  Rows that repeat
as a whole count once; a vector without components scores 0; missing components count as 0.  Ties go
to the smaller id.  An empty table, or no query, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

CANDIDATES = 2048     # rows in a block, about
QUERIES = 1024
SCALE = 256


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, terms): valid rows with integer components, each row once."""
    x = F.col(vector)
    good = F.col(key).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    )
    return rows.where(good).select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("weights"),
    ).distinct()


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of integers, shorter rows filled with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    ends = ends - ends[0]
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1], lengths)] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), one term after the other over its postings."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        asks, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if len(posting) == len(candidates) and len(asks) == len(queries):
            scores += queries[:, term, None] * candidates[None, :, term]
        elif len(asks) and len(posting):
            scores[np.ix_(asks, posting)] += queries[asks, term, None] * candidates[None, posting, term]
    return scores


def best_of_block(query_ids, queries, ids, candidates, k: int):
    """(query_id, id, score) of the k best of a block; ties at the border are kept."""
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], candidates[order]
    out = [], [], []
    for a in range(0, len(query_ids), 128):
        scores = accumulate(queries[a : a + 128], candidates)
        for row, q in zip(scores, query_ids[a : a + 128]):
            other = np.flatnonzero(ids != q)
            if not len(other):
                continue
            got = row[other]
            if len(got) > k:
                least = np.partition(got, len(got) - k)[len(got) - k]
                sure, tied = other[got > least], other[got == least]
                other = np.concatenate([sure, tied[: k - len(sure)]])
            out[0].append(np.full(len(other), q))
            out[1].append(ids[other])
            out[2].append(row[other])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def top_k(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose id ``every`` divides."""
    vectors = whole_vectors(rows, key, vector)
    n = rows.count()
    blocks, asks = -(-max(n, 1) // CANDIDATES), -(-max(n, 1) // (every * QUERIES))
    candidates = vectors.select(
        "id", "weights", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask"),
    )
    queries = vectors.where(F.col("id") % every == 0).select(
        "id", "weights", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(asks)).cast("int").alias("ask"),
    )

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        got = best_of_block(
            asked["id"].to_numpy(), _matrix(asked["weights"].combine_chunks()),
            held["id"].to_numpy(), _matrix(held["weights"].combine_chunks()), k,
        ) if asked.num_rows and held.num_rows else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got))))

    found = queries.groupBy("block", "ask").cogroup(candidates.groupBy("block", "ask")).applyInArrow(
        run, "query_id long, vec_id long, score long"
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
