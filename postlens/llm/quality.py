"""Quality classifier: a factorisation machine over hashed words, structure and length.

A text is a sparse vector: hashed words (sublinear counts, scaled to length one) and a few
structure statistics.  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost one pass over the non-zero features.  The model is fitted on a
bounded sample of labelled rows (``SAMPLE`` per class) and has a fixed size, so it is broadcast.

Nulls and empty texts have a zero vector and get the score of the structure of nothing.  Rows are
scored one by one: repeated rows repeat, ties don't matter, an empty table gives an empty result,
extra columns are ignored.  Without labelled rows of both classes every score is the known share of
label 1, or 1.0 without any label (nothing is rejected on no evidence).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import held_out, small_batches, utf8
from postlens.llm.features import (
    STATISTICS, Slice, bucket, labelled_sample, sample_vectors, text_slices,
)

SAMPLE = 3000        # labelled rows per class used for fitting
BITS = 14            # hashed words: 16384 buckets
FACTORS = 8
EPOCHS = 12
HELD_OUT = (4, 2)    # crc32 of the id modulo 4 is 2
THRESHOLD = 0.7


@dataclass
class Machine:
    bias: float
    weight: np.ndarray       # features
    factor: np.ndarray       # features x FACTORS
    centre: np.ndarray
    scale: np.ndarray

    def logits(self, row, feature, value, n):
        linear = np.bincount(row, self.weight[feature] * value, n) + self.bias
        for f in range(self.factor.shape[1]):
            term = self.factor[feature, f] * value
            linear += 0.5 * (np.bincount(row, term, n) ** 2 - np.bincount(row, term * term, n))
        return linear


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sparse(doc, word, count, statistics, centre, scale):
    """(row, feature, value): words first, then the standardised statistics of each row."""
    n = len(statistics)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, value * value, n))
    value = value / np.maximum(norm, 1e-9)[doc]
    rows = np.concatenate([doc, np.repeat(np.arange(n), STATISTICS)])
    features = np.concatenate([bucket(word, BITS), np.tile(np.arange(STATISTICS), n) + (1 << BITS)])
    values = np.concatenate([value, ((statistics - centre) / scale).ravel()])
    return rows, features, values


def train(doc, word, count, statistics, label, seed: int = 1) -> Machine:
    """Logistic loss, Adagrad over shuffled batches; the bias is set for the natural class share later."""
    n = len(label)
    centre, scale = statistics.mean(0), statistics.std(0) + 0.05
    row, feature, value = sparse(doc, word, count, statistics, centre, scale)
    order = np.argsort(row, kind="stable")
    row, feature, value = row[order], feature[order], value[order]
    bounds = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + STATISTICS
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.03, (size, FACTORS)), centre, scale)
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(n), max(1, n // 64)):
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in batch])
            r = np.repeat(np.arange(len(batch)), bounds[batch + 1] - bounds[batch])
            f, x = feature[at], value[at]
            miss = (sigmoid(m.logits(r, f, x, len(batch))) - label[batch]) / len(batch)
            used, where = np.unique(f, return_inverse=True)
            g = np.bincount(where, miss[r] * x, len(used)) + 1e-5 * m.weight[used]
            seen_w[used] += g * g
            total = np.stack([np.bincount(r, m.factor[f, k] * x, len(batch)) for k in range(FACTORS)], 1)
            part = (miss[r] * x)[:, None] * (total[r] - m.factor[f] * x[:, None])
            gv = np.stack([np.bincount(where, part[:, k], len(used)) for k in range(FACTORS)], 1)
            gv += 1e-4 * m.factor[used]
            seen_v[used] += gv * gv
            m.weight[used] -= 0.1 * g / np.sqrt(seen_w[used])
            m.factor[used] -= 0.02 * gv / np.sqrt(seen_v[used])
            gb = miss.sum()
            seen_b += gb * gb
            m.bias -= 0.1 * gb / np.sqrt(seen_b)
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Machine | float:
    """A machine, or the known share of label 1 when a class is missing."""
    sample = labelled_sample(small_batches(labels), label, *HELD_OUT, SAMPLE)
    counts = {
        r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1))
        .where(~held_out(F.col("doc_id"), *HELD_OUT))
        .groupBy(F.col(label).cast("int")).count().collect()
    }
    if len(counts) < 2:
        return 0.0 if 0 in counts else 1.0
    got = sample_vectors(docs, sample, Slice.whole_words).join(F.broadcast(sample), "doc_id").toArrow().sort_by("doc_id")
    y = got["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return float(counts[1] / sum(counts.values()))
    words = got["terms"].combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(words.offsets.to_numpy()))
    statistics = got["statistics"].combine_chunks().flatten().to_numpy().reshape(len(y), STATISTICS)
    count = got["counts"].combine_chunks().flatten().to_numpy()
    m = train(doc, words.flatten().to_numpy(), count, statistics, y)
    m.bias += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return m


def scorer(model: Machine | float):
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            scores = np.zeros(len(texts))
            for a, b, part in text_slices(texts):
                if isinstance(model, float):
                    scores[a:b] = model
                    continue
                doc, word, count = part.whole_words()
                row, feature, value = sparse(doc, word, count, part.statistics(), model.centre, model.scale)
                scores[a:b] = sigmoid(model.logits(row, feature, value, b - a))
            yield pa.RecordBatch.from_arrays(
                [*(c for n, c in zip(batch.schema.names, batch.columns) if n != "text"), pa.array(scores)],
                [*(n for n in batch.schema.names if n != "text"), "score"],
            )
    return run


def score(docs: DataFrame, model: Machine | float, keep: list[str]) -> DataFrame:
    """``keep`` and the score of every row."""
    wanted = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in wanted.dtypes if c != "text") + ", score double"
    return wanted.mapInArrow(scorer(model), schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the classifier does not reject."""
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            scores = pa.concat_arrays([b.column("score") for b in scorer(model)([batch.select(["text"])])])
            yield batch.filter(pc.greater_equal(scores, THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``THRESHOLD`` on) of every document."""
    return score(docs, fit(docs, labels), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
