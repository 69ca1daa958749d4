"""Ranked lexical search of many items at once: common subexpressions are evaluated once.

A document's score for an item is a sum over the item's terms, and a term's share does not depend on the
item.  So items that share terms share partial sums:

* *Mining.*  Terms that stand in the same items are one atom.  Then, round by round, the pairs of nodes
  that most items share become a node of their own, until no pair is shared by two items.  The nodes form
  a DAG: atoms at the bottom, sums of two nodes above, items on top as sums of what is left of them.
* *Postings.*  One pass over all texts writes each document's length and its counts of the items' terms.
* *Evaluation.*  For some documents at a time every atom has one accumulator row, filled from the
  postings; every node adds its two children once, whatever the number of items above it; items add up
  their nodes.  A task keeps the ``k`` best documents of each item, and the tasks' winners merge.

Terms are maximal runs of ASCII letters, digits and characters outside ASCII; only A-Z are folded.  N
counts documents with a term, L all terms, n the terms of a document, df the documents with a term:

    weight = floor(1000 * ln((2N + 2) / (2df + 1))),  m = 50 + (50 * n * N) div L
    score  = sum of weight * ((10^9 * tf) div (1000 * tf + 20 * m)) over the item's terms, once each

Items are taken in blocks of bounded size (``BLOCK_TERMS``), in the order of their ids, so neither the
driver nor a task holds more than a block of them, a block's accumulators and ``k`` winners per item.

Null is an empty text, which has no terms: such a document counts in nothing and is never found, such an
item finds nothing.  Rows of one item id (also null) are one item with the terms of all.  Documents are
rows: repeated rows count and are ranked each, among equal scores by ascending id, null ids last.  Empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm.common import small_batches, utf8, written

BLOCK_TERMS = 100_000     # (item, term) pairs of a block of items; a longer item is a block of its own
CELLS = 4 << 20           # accumulator cells of a task
NEXT = 16                 # a node is paired with so many nodes after it; decides speed only
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_MOST = 1 << 62


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())


# --- mining -------------------------------------------------------------------------------------

class Plan:
    """The sharing DAG of a block of items.

    ``ids`` the items' ids, ``terms`` the terms in order of their numbers, ``atom`` the atom of each term,
    ``levels`` rounds of (node, left, right), ``parts`` and ``begin`` the nodes that add up to each item.
    """

    def __init__(self, items: list[tuple[object, set[bytes]]]):
        items = [(i, own) for i, own in items if own]
        self.ids = [i for i, _ in items]
        holders: dict[bytes, list[int]] = {}
        for at, (_, own) in enumerate(items):
            for term in sorted(own):
                holders.setdefault(term, []).append(at)
        self.terms = sorted(holders)
        atoms: dict[tuple[int, ...], int] = {}
        self.atom = np.array([atoms.setdefault(tuple(holders[t]), len(atoms)) for t in self.terms], np.int64)
        rows: list[list[int]] = [[] for _ in items]
        for where, atom in sorted(atoms.items(), key=lambda a: (-len(a[0]), a[1])):
            for at in where:
                rows[at].append(atom)
        self.atoms = self.nodes = len(atoms)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while made := self._round(rows):
            self.levels.append(tuple(np.array(x, np.int64) for x in zip(*made)))
        self.parts = np.array([n for row in rows for n in row], np.int64)
        self.begin = np.cumsum([0] + [len(row) for row in rows])[:-1]

    def _round(self, rows: list[list[int]]) -> list[tuple[int, int, int]]:
        """Pairs shared by two items become nodes, the most shared first; each node of an item is used once."""
        shared: Counter = Counter()
        for row in rows:
            for at, left in enumerate(row):
                for right in row[at + 1 : at + 1 + NEXT]:
                    shared[left, right] += 1
        holders: dict[int, set[int]] = {}
        for at, row in enumerate(rows):
            for node in row:
                holders.setdefault(node, set()).add(at)
        made, taken = [], {}
        for (left, right), times in sorted(shared.items(), key=lambda p: (-p[1], p[0])):
            if times < 2:
                break
            both = holders[left] & holders[right]
            if len(both) < 2:
                continue
            node = self.nodes
            self.nodes += 1
            made.append((node, left, right))
            holders[left] -= both
            holders[right] -= both
            for at in both:
                taken.setdefault(at, {}).update({left: node, right: None})
        for at, change in taken.items():
            row = [change.get(node, node) for node in rows[at]]
            rows[at][:] = [node for node in row if node is not None]
        return made

    def additions(self) -> int:
        """Accumulator rows added per document block (a plain evaluation adds one per item and term)."""
        return sum(len(level[0]) for level in self.levels) + len(self.parts)

    def scores(self, term: np.ndarray, share: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """(items x rows): ``share`` of each ``term`` in each ``row``, summed along the DAG."""
        held = np.zeros((self.nodes, rows), np.int64)
        np.add.at(held, (self.atom[term], row), share)
        for node, left, right in self.levels:
            held[node] = held[left] + held[right]
        return np.add.reduceat(held[self.parts], self.begin, axis=0)


def blocks(items: DataFrame):
    """Plans of consecutive items; the driver holds the items of one block at a time."""
    rows = items.select("item_id", "text").orderBy("item_id").toLocalIterator()
    block, size = [], 0
    for item, group in groupby(rows, key=lambda r: r["item_id"]):
        own = {t for r in group for t in terms((r["text"] or "").encode())}
        if block and size + len(own) > BLOCK_TERMS:
            yield Plan(block)
            block, size = [], 0
        block.append((item, own))
        size += len(own)
    if block:
        yield Plan(block)


# --- evaluation ---------------------------------------------------------------------------------

def postings(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """(doc_id, n, term, tf): length and counts of the ``known`` terms of every document with a term."""
    def run(batches):
        number = {t: k for k, t in enumerate(known)}
        for batch in batches:
            ids, length, term, tf, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                found = Counter(terms(text))
                if not found:
                    continue
                own = [(number[t], c) for t, c in found.items() if t in number]
                ids.append(doc_id)
                length.append(found.total())
                term.extend(k for k, _ in own)
                tf.extend(c for _, c in own)
                ends.append(len(term))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(length, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
            ], ["doc_id", "n", "term", "tf"])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(
        run, "doc_id long, n long, term array<int>, tf array<int>"
    )


def best(item: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each item: highest score, smallest id, null ids last."""
    order = np.lexsort((doc, null, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def winners(posted: DataFrame, plan: Plan, weight: np.ndarray, documents: int, length: int, k: int, kind: str) -> DataFrame:
    """(item_id, doc_id, score): each task's ``k`` best documents of each item of the plan."""
    step = max(16, CELLS // max(plan.nodes, 1))

    def run(batches):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        least = np.ones(len(plan.ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, n, term, tf = (part.column(c) for c in ("doc_id", "n", "term", "tf"))
                sizes = np.diff(np.asarray(term.offsets))
                term, tf = term.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), sizes)
                n = n.to_numpy()
                if int(n.max()) * 50 * documents < _MOST:
                    m = 50 + 50 * n * documents // length
                else:
                    m = np.array([50 + 50 * int(x) * documents // length for x in n], np.int64)
                share = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                got = plan.scores(term, share, row, part.num_rows)
                if part.num_rows > k:
                    border = np.partition(got, part.num_rows - k, axis=1)[:, part.num_rows - k]
                    least = np.maximum(least, border)
                item, found = np.nonzero(got >= least[:, None])
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                new = item, ids[found], null[found], got[item, found]
                kept = [np.concatenate(x) for x in zip(kept, new)]
                stay = best(*kept, k)
                kept = [x[stay] for x in kept]
                item, begin, size = np.unique(kept[0], return_index=True, return_counts=True)
                full = size == k
                least[item[full]] = np.maximum(least[item[full]], kept[3][begin[full] + k - 1])
        yield pa.RecordBatch.from_arrays([
            pa.array([plan.ids[i] for i in kept[0]], posted_type), pa.array(kept[1], mask=kept[2]), pa.array(kept[3])
        ], ["item_id", "doc_id", "score"])

    posted_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return posted.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 for every item."""
    kind = items.schema["item_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        kind, items = "string", items.withColumn("item_id", F.col("item_id").cast("string"))
    found = docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for plan in blocks(items):
        if not plan.ids:
            continue
        posted = written(postings(docs, plan.terms), "postings")
        total = posted.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not total.documents:
            break
        df = np.zeros(len(plan.terms), np.int64)
        counts = posted.select(F.explode("term").alias("term")).groupBy("term").count()
        for r in counts.toLocalIterator():
            df[r["term"]] = r["count"]
        weight = np.array([
            math.floor(1000 * math.log((2 * total.documents + 2) / (2 * int(x) + 1))) for x in df
        ], np.int64)
        found = found.union(winners(posted, plan, weight, total.documents, total.length, k, kind))
    place = F.row_number().over(
        Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    )
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL
), i AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0
), p AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, docs
), c AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))::BIGINT AS share FROM p JOIN w USING (term), s
), a AS (
  SELECT item_id, r, doc_id, sum(share)::BIGINT AS score FROM c JOIN i USING (term) GROUP BY ALL HAVING sum(share) > 0
), o AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM a
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
