"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, through block-max lists.

Terms are the first four letters of each word, shorter words whole; where a script sets no blanks between
words, each letter with the next.  Document frequencies are counted over all documents.  The examples are
a bounded sample of labelled rows (``EXAMPLES`` per class) and every term of theirs is indexed.  A weight
is (1 + log count) * log((1 + documents) / (1 + df)).  Terms of a text that no example has would shorten
all its similarities alike, so they are left out.

For terms that stand in ``DENSE`` of the examples the inverted index keeps, for every term and block of
examples, the postings and the largest weight.  The few postings of all other terms are added up for a
text at once, which gives their part of its similarity to each example.  Both bound every example of a
block, so a block is only scored while its bound can still beat the k-th best similarity found: the
neighbours are those of a full scan.

The vote is the share of toxic neighbours weighted by squared similarity; a logistic curve fitted on
other labelled rows makes it a probability.  ``evidence`` lists the nearest example ids.

Null and empty texts, and texts without a known term, have no neighbour: they get the share of toxic
rows.  Every row is scored by itself, repeated rows repeat, equal similarities go to the smaller
example id, an empty table gives an empty result, extra columns are ignored.  If either class has no
labelled row, the score is the share of toxic labels (0.0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import held_out, mix, small_batches, utf8
from postlens.llm.features import Slice, labelled_sample, sample_vectors, text_slices

EXAMPLES = 3000       # examples per class in the index
CALIBRATION = 1000    # further labelled rows per class for the logistic curve
BLOCK = 64
NEIGHBOURS = 25
DENSE = 0.02          # terms in at least this share of the examples have block maxima, others plain postings
HELD_OUT = (5, 0)
THRESHOLD = 0.5


@dataclass
class Index:
    """Block-max inverted index; examples are numbered in their order in blocks."""

    terms: np.ndarray        # sorted
    idf: np.ndarray
    ids: np.ndarray          # example ids
    toxic: np.ndarray
    column: np.ndarray       # of each term: its row in ``most``, -1 if it is rare
    most: np.ndarray         # frequent terms x blocks: largest weight of a term in a block
    post_term: list          # per block: frequent term of each posting, sorted
    post_example: list
    post_weight: list
    share: float
    rare_start: np.ndarray = None       # terms + 1: where the postings of each rare term begin
    rare_example: np.ndarray = None
    rare_weight: np.ndarray = None
    slope: float = 1.0
    shift: float = 0.0

    def weights(self, doc, term, count, n):
        """(row, term, weight) of unit TF-IDF rows over the known terms."""
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        keep = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        doc, at, count = doc[keep], at[keep], count[keep]
        weight = (1 + np.log(count)) * self.idf[at]
        norm = np.sqrt(np.bincount(doc, weight * weight, n))
        return doc, at, weight / np.maximum(norm, 1e-12)[doc]

    def queries(self, doc, term, count, n):
        """Per text its weights of the frequent terms, then its similarity to each example over the rare ones."""
        doc, at, weight = self.weights(doc, term, count, n)
        width = len(self.most)
        out = np.zeros((n, width + len(self.ids)), np.float32)
        column = self.column[at]
        often = column >= 0
        out[doc[often], column[often]] = weight[often]
        doc, at, weight = doc[~often], at[~often], weight[~often]
        lengths = self.rare_start[at + 1] - self.rare_start[at]
        if lengths.sum():
            one = np.repeat(np.arange(len(at)), lengths)
            post = np.arange(len(one)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + self.rare_start[at][one]
            spot = doc[one] * len(self.ids) + self.rare_example[post]
            total = np.bincount(spot, weight[one] * self.rare_weight[post], n * len(self.ids))
            out[:, width:] = total.reshape(n, -1)
        return out

    def block(self, k, q):
        """Similarities of some queries to the examples of block k, over its postings and the rare terms."""
        terms, where = np.unique(self.post_term[k], return_inverse=True)
        lists = np.zeros((len(terms), min(BLOCK, len(self.ids) - k * BLOCK)), np.float32)
        lists[where, self.post_example[k]] = self.post_weight[k]
        first = len(self.most) + k * BLOCK
        return q[:, terms] @ lists + q[:, first : first + lists.shape[1]]

    def neighbours(self, q):
        """(similarity, example), the NEIGHBOURS best of each query; -1 beyond the last."""
        n, blocks = len(q), self.most.shape[1]
        width = len(self.most)
        bound = q[:, :width] @ self.most + np.maximum.reduceat(q[:, width:], np.arange(0, len(self.ids), BLOCK), axis=1)
        best = np.full((n, NEIGHBOURS), -1, np.float32)
        whose = np.full((n, NEIGHBOURS), len(self.ids), np.int64)
        turn = np.argsort(-bound, axis=1, kind="stable")
        done = np.zeros((n, blocks), bool)
        for step in range(3):
            for k in range(blocks):
                if step < 2:
                    rows = np.flatnonzero(turn[:, min(step, blocks - 1)] == k)
                else:
                    rows = np.flatnonzero(~done[:, k] & (bound[:, k] > 0) & (bound[:, k] >= best[:, -1] - 1e-5))
                rows = rows[~done[rows, k]]
                if not len(rows):
                    continue
                done[rows, k] = True
                got = self.block(k, q[rows])
                some = np.concatenate([best[rows], got], 1)
                who = np.concatenate(
                    [whose[rows], np.broadcast_to(np.arange(got.shape[1]) + k * BLOCK, got.shape)], 1
                )
                order = np.lexsort((who, -np.round(some, 5)), axis=1)[:, :NEIGHBOURS]
                best[rows] = np.take_along_axis(some, order, 1)
                whose[rows] = np.take_along_axis(who, order, 1)
        whose[best <= 0] = -1
        return best, whose

    def vote(self, best, whose):
        weight = np.where(whose >= 0, np.maximum(best, 0) ** 2, 0)
        toxic = np.where(whose >= 0, self.toxic[np.maximum(whose, 0)], 0)
        total = weight.sum(1)
        return np.where(total > 0, (weight * toxic).sum(1) / np.maximum(total, 1e-12), np.nan)

    def scores(self, vote):
        out = 1 / (1 + np.exp(-np.clip(self.slope * spread(vote) + self.shift, -40, 40)))
        return np.where(np.isnan(vote), self.share, out)


def spread(vote):
    vote = np.clip(np.nan_to_num(vote, nan=0.5), 0.01, 0.99)
    return np.log(vote / (1 - vote))


def build(ids, toxic, doc, term, count, frequency: dict[int, int], n_docs: int, share: float) -> Index:
    """The index of the sampled examples; like examples stand near each other."""
    terms, found = np.unique(term, return_counts=True)
    df = np.array([frequency.get(int(t), 1) for t in terms])
    idf = np.log((1 + n_docs) / (1 + df))
    often = found >= DENSE * len(ids)
    column = np.where(often, np.cumsum(often) - 1, -1)
    index = Index(terms, idf, ids, toxic, column, np.zeros((int(often.sum()), 1), np.float32), [], [], [], share)
    doc, at, weight = index.weights(doc, term, count, len(ids))
    q = np.zeros((len(ids), int(often.sum())), np.float32)
    common = column[at] >= 0
    q[doc[common], column[at[common]]] = weight[common]
    heavy = np.where(q.max(1) > 0, q.argmax(1), -1) if q.shape[1] else np.zeros(len(ids), int)
    order = np.lexsort((ids, mix(heavy.astype(np.uint64)), toxic))
    q, index.ids, index.toxic = q[order], ids[order], toxic[order]
    blocks = range(0, len(ids), BLOCK)
    index.most = np.stack([q[k : k + BLOCK].max(0) for k in blocks], 1)
    for k in blocks:
        example, term = np.nonzero(q[k : k + BLOCK])
        by = np.argsort(term, kind="stable")
        index.post_term.append(term[by])
        index.post_example.append(example[by])
        index.post_weight.append(q[k : k + BLOCK][example[by], term[by]])
    place = np.argsort(order)
    doc, at, weight = place[doc[~common]], at[~common], weight[~common]
    by = np.lexsort((doc, at))
    index.rare_start = np.searchsorted(at[by], np.arange(len(terms) + 1))
    index.rare_example, index.rare_weight = doc[by], weight[by].astype(np.float32)
    return index


def calibrate(index: Index, vote, label, odds: float) -> None:
    """Logistic curve over the vote by Newton steps; ``odds`` turns the balanced sample to the natural one."""
    x = np.stack([spread(vote), np.ones(len(vote))], 1)
    theta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        w = p * (1 - p) + 1e-6
        step = np.linalg.solve(x.T @ (x * w[:, None]) + np.eye(2) * 1e-2, x.T @ (label - p) - 1e-2 * theta)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.shift = max(float(theta[0]), 1e-3), float(theta[1]) + odds


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df) over all documents; each task counts its own rows first."""
    def run(batches):
        counts: dict[int, int] = {}
        rows = 0
        for batch in batches:
            texts = utf8(batch.column("text"))
            rows += len(texts)
            for _, _, part in text_slices(texts):
                _, term, _ = part.beginnings()
                for t, c in zip(*(x.tolist() for x in np.unique(term, return_counts=True))):
                    counts[t] = counts.get(t, 0) + c
            if len(counts) > 500_000:
                yield _counts(counts)
                counts = {}
        counts[-1] = rows
        yield _counts(counts)

    rows = docs.select("text").mapInArrow(run, "term long, df long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def _counts(counts):
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "df"]
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Index | float:
    counts = {
        r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1))
        .where(~held_out(F.col("doc_id"), *HELD_OUT))
        .groupBy(F.col(label).cast("int")).count().collect()
    }
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return float(share)
    sample = labelled_sample(small_batches(labels), label, *HELD_OUT, EXAMPLES + CALIBRATION)
    got = sample_vectors(docs, sample, Slice.beginnings).join(F.broadcast(sample), "doc_id").toArrow().sort_by("doc_id")
    ids, y = got["doc_id"].to_numpy(), got["label"].to_numpy().astype(np.int64)
    if len(set(y)) < 2:
        return float(share)
    terms, counted = got["terms"].combine_chunks(), got["counts"].combine_chunks().flatten().to_numpy()
    doc, term = np.repeat(np.arange(len(y)), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy()
    # of each class the first part becomes examples, the rest calibrates; few rows do both
    rank = np.zeros(len(y), np.int64)
    by = np.lexsort((ids, mix(ids.astype(np.uint64))))
    for k in (0, 1):
        own = by[y[by] == k]
        rank[own] = np.arange(len(own))
    # as many examples of either class, so that a vote starts even
    example = rank < min(EXAMPLES, max(1, int(min((y == 1).sum(), (y == 0).sum())) * 4 // 5))
    terms = np.unique(term[example[doc]])
    spark = docs.sparkSession
    wanted = spark.createDataFrame(pa.table({"term": np.append(terms, -1)}))
    frequency = {r.term: r.df for r in document_frequency(docs).join(F.broadcast(wanted), "term").collect()}
    number = np.cumsum(example) - 1
    use = example[doc]
    index = build(
        ids[example], y[example], number[doc[use]], term[use], counted[use],
        frequency, frequency.get(-1, 0), float(share),
    )
    rest = ~example if (~example).any() else example
    number = np.cumsum(rest) - 1
    use = rest[doc]
    votes = index.vote(*index.neighbours(index.queries(number[doc[use]], term[use], counted[use], int(rest.sum()))))
    label_rest = y[rest]
    ones, zeros = max(1, label_rest.sum()), max(1, (1 - label_rest).sum())
    calibrate(index, votes, label_rest, float(np.log(counts[1] / counts[0]) - np.log(ones / zeros)))
    return index


def scorer(model: Index | float):
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            scores, evidence = np.zeros(len(texts)), [[] for _ in texts]
            for a, b, part in text_slices(texts):
                if isinstance(model, float):
                    scores[a:b] = model
                    continue
                best, whose = model.neighbours(model.queries(*part.beginnings(), b - a))
                scores[a:b] = model.scores(model.vote(best, whose))
                top = np.where(whose[:, :3] >= 0, model.ids[np.maximum(whose[:, :3], 0)], -1)
                evidence[a:b] = [[x for x in r if x >= 0] for r in top.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))],
                ["doc_id", "score", "evidence"],
            )
    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the nearest example ids of every document."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", "text").mapInArrow(
        scorer(model), "doc_id long, score double, evidence array<long>"
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence",
    )
