"""Sparse term counts and structure statistics of whole texts, computed on many texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import held_out, mix, running_hash, slices, span_hash, utf8

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = np.full(256, 9, np.uint8)
_CLASS[65:91] = 0                                          # upper case
_CLASS[48:58] = 1                                          # digits
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2  # punctuation
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[128:] = 5
STATISTICS = 14
LETTERS = 4
# first bytes of the scripts from U+0800 on but for U+2000 to U+2FFF (quotes, dashes, symbols)
_DENSE = np.zeros(256, bool)
_DENSE[[0xE0, 0xE1, *range(0xE3, 0xF5)]] = True


class Slice:
    """Some texts as one byte array with the words in it."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        data = b"\n".join(texts)
        self.bytes = np.frombuffer(data, np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths + 1)
        self.folded = np.frombuffer(data.lower(), np.uint8)
        inside = np.zeros(len(self.bytes) + 2, np.int8)
        inside[1:-1] = _WORD[self.bytes]
        edges = np.diff(inside)
        self.start, self.stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def beginnings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count): the first four letters of each word; a shorter word is whole."""
        return self._terms(LETTERS)

    def whole_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count): each word."""
        return self._terms(len(self.bytes))

    def _terms(self, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count): the first letters (code points) of each word, A-Z folded.

        In scripts that set no blanks between words every letter begins a term of itself and the next
        one instead.
        """
        lead = np.flatnonzero((self.folded & 0xC0) != 0x80)
        border = np.append(lead, len(self.folded))
        dense = _DENSE[self.folded]
        first = np.flatnonzero(~dense[self.start]) if len(self.start) else np.zeros(0, np.int64)
        letter = np.flatnonzero(dense)
        word = np.searchsorted(self.start, letter, side="right") - 1
        whose = np.concatenate([first, word])
        start = np.concatenate([self.start[first], letter])
        many = np.repeat([letters, 2], [len(first), len(letter)])
        after = np.minimum(np.searchsorted(lead, start) + many, len(lead))
        term = span_hash(running_hash(self.folded), start, np.minimum(border[after], self.stop[whose]))
        return counted(self.doc[whose], (term >> _U(1)).astype(np.int64))

    def words(self) -> np.ndarray:
        return span_hash(running_hash(self.folded), self.start, self.stop)

    def statistics(self) -> np.ndarray:
        """One row of bounded structure statistics per text; an empty text has zeros."""
        size = np.maximum(self.lengths, 1).astype(np.float32)
        begin = self.ends - self.lengths - 1
        total = np.zeros((self.n, 6), np.float32)
        kind = _CLASS[self.bytes]
        for k in range(6):
            if len(kind):
                upto = np.searchsorted(np.flatnonzero(kind == k), np.stack([begin, self.ends - 1]))
                total[:, k] = upto[1] - upto[0]
        words = np.bincount(self.doc, minlength=self.n).astype(np.float32)
        many = np.maximum(words, 1)
        hashes = self.words()
        doc, _, _ = counted(self.doc, (hashes >> _U(24)).astype(np.int64))
        distinct = np.bincount(doc, minlength=self.n)
        again = np.zeros(self.n)
        if len(hashes) > 1:
            same = (hashes[1:] == hashes[:-1]) & (self.doc[1:] == self.doc[:-1])
            again = np.bincount(self.doc[1:][same], minlength=self.n)
        long_words = np.bincount(self.doc, weights=self.stop - self.start, minlength=self.n)
        out = np.zeros((self.n, STATISTICS), np.float32)
        out[:, 0] = total[:, 0] / size * 4
        out[:, 1] = total[:, 1] / size * 10
        out[:, 2] = total[:, 2] / many
        out[:, 3] = total[:, 3] / many
        out[:, 4] = total[:, 4] / many * 5
        out[:, 5] = total[:, 5] / size * 4
        out[:, 6] = distinct / many
        out[:, 7] = distinct / np.sqrt(many) / 10
        out[:, 8] = again / many
        out[:, 9] = long_words / many / 10
        out[:, 10] = np.log1p(words) / 10
        out[:, 11] = np.log1p(self.lengths) / 12
        out[:, 12] = (total[:, 2] / many > 0.6) & (words > 0)
        out[:, 13] = (total[:, 0] / size > 0.3) & (words > 0)
        return np.minimum(out, 4)


def counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, term) in order with their counts."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(first)
    return doc[at], term[at], np.diff(at, append=len(doc))


VECTORS = "doc_id long, terms array<long>, counts array<int>, statistics array<float>"


def vectors(terms: Callable[[Slice], tuple]):
    """Arrow batches of (doc_id, text) to the schema ``VECTORS``; ``terms`` is a method of ``Slice``."""
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b, part in text_slices(texts):
                doc, term, count = terms(part)
                offsets = pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32())
                flat = pa.array(part.statistics().ravel(), pa.float32())
                steps = pa.array(np.arange(b - a + 1) * STATISTICS, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a),
                    pa.ListArray.from_arrays(offsets, pa.array(term)),
                    pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32))),
                    pa.ListArray.from_arrays(steps, flat),
                ], ["doc_id", "terms", "counts", "statistics"])
    return run


def labelled_sample(labels: DataFrame, label: str, parts: int, part: int, per_class: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` labelled ids of each class, not from the held-out part.

    The bound is a documented parameter of the classifiers; ids are taken in the order of their hash.
    """
    rows = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id"), parts, part))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    picked = [
        rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for k in (0, 1)
    ]
    return picked[0].union(picked[1])


def sample_vectors(docs: DataFrame, sample: DataFrame, terms: Callable[[Slice], tuple]) -> DataFrame:
    """Vectors of the sampled rows; the sample is broadcast, its size is bounded by its limits.

    Of rows of one id the one with the smallest text counts, so a fitted model doesn't change between runs.
    """
    found = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(vectors(terms), VECTORS)


def text_slices(texts: list[bytes]):
    for a, b in slices(texts):
        yield a, b, Slice(texts[a:b])


def bucket(term: np.ndarray, bits: int) -> np.ndarray:
    return (mix(term.astype(_U)) >> _U(64 - bits)).astype(np.int64)
