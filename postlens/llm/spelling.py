"""Spelling variants: words one code point apart, found in a bit-sliced position index.

A block of words holds, for each position and letter, the set of its words with that letter there, one bit
per word.  All words of the block are asked at once.  Going through their letters, two sets are tracked
word-parallel (64 words an operation): the words met without error, and those met with one.  A word joins
the second set by a letter that differs, or by a letter it has more, after which it is read one position
further on; a letter less is the same pair asked from the other side.

Blocks are small because near words share letters.  Of two words of ``m`` and at most ``m + 1`` letters,
the letters before and after their one difference agree, so either the first or the last (m - 1) / 2
letters, rounded up, are equal.  All words are one group at first.  A group above ``GROUP`` words is
divided by each of these halves of what is still open (each word goes to one group of either kind); the
open part shrinks by half, down to one letter (two in a longer word), where a group can only hold as many
words as there are letters for it.  So no block grows with the data, however common a beginning or an ending is, and no pair is
lost; small groups share a block.  Every step is a count and a join by the group's key.

Words are the maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z folded.  Let h be crc32 of
``<doc_id>:<run>``; if 31 divides h, the run's code point h % length is left out (planted misspellings).
Those of at least 7 code points and 2 occurrences count.  A word's form is its most frequent near word,
the first in code-point order of equals, if it is at least ten times as frequent.

A null text has no words; a null id is written as an empty text.  Repeated rows count as often as they
stand.  Without words the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import written

LEAST_LETTERS = 7
LEAST_TIMES = 2
TIMES = 10               # a form is so many times as frequent
GROUP = 2048             # words of a group that is searched as a whole
PACKED = 16              # so many times as many words in a task
_U = np.uint64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, slip: int = 31) -> DataFrame:
    """(word, n): words of at least ``LEAST_LETTERS`` code points with their occurrences, if ``LEAST_TIMES``."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        # shorter runs can't become longer words
        F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"),
    ).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat_ws(":", "doc_id", "run"), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    return (
        runs.withColumn("h", h)
        .select(F.when(F.col("h") % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))))
                .otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= LEAST_LETTERS)
        .groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_TIMES)
    )


# --- the index of a block ---------------------------------------------------------------------------

class Index:
    """Bit sets over the words of a block: ``letters[i]`` the letters at position i, ``sets[i]`` their words."""

    def __init__(self, block: list[str]):
        self.size = np.array([len(w) for w in block], np.int64)
        order = np.argsort(-self.size, kind="stable")
        self.words = [block[i] for i in order]
        self.size = self.size[order]
        flat = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        self.begin = np.cumsum(self.size) - self.size
        self.width = -(-len(block) // 64)
        self.flat = flat
        self.letters, self.sets = [], []
        for at in range(int(self.size[0]) if block else 0):
            letter, which = np.unique(self.at(at), return_inverse=True)
            self.letters.append(letter)
            self.sets.append(self._bits(which, len(letter)))

    def at(self, position: int) -> np.ndarray:
        """Letters at a position, of the words that reach it: the first of the block, as longer ones come first."""
        reach = int(np.searchsorted(-self.size, -position, side="left"))
        return self.flat[self.begin[:reach] + position]

    def _bits(self, which: np.ndarray, kinds: int) -> np.ndarray:
        out = np.zeros((kinds + 1, self.width), _U)       # the last row is the empty set
        word = np.arange(len(which))
        np.bitwise_or.at(out, (which, word >> 6), _U(1) << (word & 63).astype(_U))
        return out

    def _held(self, position: int, asked: np.ndarray) -> np.ndarray:
        """For each asked letter the words that have it at a position."""
        if position >= len(self.letters):
            return np.zeros((len(asked), self.width), _U)
        letter = self.letters[position]
        place = np.searchsorted(letter, asked)
        known = letter[np.minimum(place, len(letter) - 1)] == asked
        return self.sets[position][np.where(known, place, len(letter))]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words (a, b) one code point apart, b as long as a or one longer."""
        count = len(self.words)
        every = np.full((count, self.width), ~_U(0))
        none, replaced, added = every, np.zeros_like(every), np.zeros_like(every)
        asked, met = [], []
        length = {int(s): self._bits(np.where(self.size == s, 0, 1), 1)[0] for s in np.unique(self.size)}
        for at in range(int(self.size[0]) + 1 if count else 0):
            # words of `at` letters are read to their end; they are the last that are left
            left = int(np.searchsorted(-self.size, -at, side="left"))
            if left < len(none):
                same, longer = length[at], length.get(at + 1)
                found = replaced[left:] & same
                if longer is not None:
                    found |= (added[left:] | none[left:]) & longer
                a, b = self._numbers(found)
                asked.append(a + left)
                met.append(b)
                none, replaced, added = none[:left], replaced[:left], added[:left]
            if not left:
                break
            letter = self.at(at)
            here, after = self._held(at, letter), self._held(at + 1, letter)
            replaced = (replaced & here) | (none & ~here)
            added = (added | none) & after
            none = none & here
        if not asked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(asked), np.concatenate(met)

    @staticmethod
    def _numbers(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, column = np.nonzero(found)
        bits = np.unpackbits(found[row, column].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        return row[hit], column[hit] * 64 + bit


# --- groups -----------------------------------------------------------------------------------------

def _half(open_part: Column) -> Column:
    """Letters that agree at one end at least: (m - 1) / 2, rounded up."""
    return F.floor(open_part / 2).cast("int")


def groups(vocabulary: DataFrame) -> DataFrame:
    """(word, n, group): every two near words meet in a group.

    A group is named by ``m``, the length of its shorter words, and the letters known to agree at the start and
    the end.  ``m - head - tail`` letters are open; with one open letter a group isn't divided further.
    """
    rows = vocabulary.select("word", "n", F.length("word").alias("size"))
    rows = rows.select("*", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("m"))
    rows = rows.select("word", "n", "size", "m", F.lit(0).alias("head"), F.lit(0).alias("tail"))
    key = ["m", "head", "tail", "start", "stop"]
    ready = None
    while True:
        keyed = rows.select(
            "word", "n", "size", "m", "head", "tail",
            F.substring("word", F.lit(1), F.col("head")).alias("start"),
            F.when(F.col("tail") > 0, F.substring("word", -F.col("tail"), F.col("tail"))).otherwise("").alias("stop"),
        )
        # a group without a word of m letters asks for nothing, one of a single word finds nothing
        counts = written(keyed.groupBy(key).agg(F.count("*").alias("held"), F.min("size").alias("least")), "word-groups")
        counts = counts.where((F.col("held") > 1) & (F.col("least") == F.col("m")))
        small = (F.col("held") <= GROUP) | (F.col("m") - F.col("head") - F.col("tail") <= 1)
        joined = written(keyed.join(counts.drop("least"), key).withColumn("small", small), "word-groups")
        found = joined.where("small").select("word", "n", F.xxhash64(*key).alias("group"))
        ready = found if ready is None else ready.union(found)
        large = joined.where("NOT small")
        if large.isEmpty():
            return ready
        half = _half(F.col("m") - F.col("head") - F.col("tail"))
        rows = large.select("word", "n", "size", "m", "head", "tail", half.alias("half"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        rows = rows.select(
            "word", "n", "size", "m",
            (F.col("head") + F.when(F.col("side") == 0, F.col("half")).otherwise(0)).alias("head"),
            (F.col("tail") + F.when(F.col("side") == 1, F.col("half")).otherwise(0)).alias("tail"),
        )


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, n): every pair of ``vocabulary`` (word, n) one code point apart, both ways, n of ``near``."""
    placed = groups(vocabulary)
    blocks = max(1, -(-placed.count() // (PACKED * GROUP)))

    def run(table: pa.Table) -> pa.Table:
        # whole groups are packed into runs of about GROUP words, each searched as one
        out = [], [], []
        order = np.argsort(table["group"].to_numpy(), kind="stable")
        names = table["group"].to_numpy()[order]
        word = table["word"].take(pa.array(order)).to_pylist()
        n = table["n"].to_numpy()[order].tolist()
        ends = np.append(np.flatnonzero(np.diff(names)) + 1, len(names)).tolist()
        begin = 0
        for k, end in enumerate(ends):
            if k + 1 < len(ends) and ends[k + 1] - begin <= GROUP:
                continue
            times = dict(zip(word[begin:end], n[begin:end]))
            index = Index(list(times))
            for a, b in zip(*(x.tolist() for x in index.near())):
                a, b = index.words[a], index.words[b]
                for one, other in ((a, b),) if len(a) == len(b) else ((a, b), (b, a)):
                    out[0].append(one)
                    out[1].append(other)
                    out[2].append(times[other])
            begin = end
        return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "n": pa.array(out[2], pa.int64())})

    pairs = placed.withColumn("block", F.pmod("group", F.lit(blocks))).groupBy("block").applyInArrow(
        run, "word string, near string, n long"
    )
    return pairs.groupBy("word", "near").agg(F.max("n").alias("n"))     # halves of a pair may agree at both ends


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): every word's last form, by pointer doubling.

    A form is more frequent than its word, so chains end; their length grows with the logarithm of the counts.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(reached.join(further, "root", "left").select("word", "root", "next"), "word-roots")
        if after.where("next IS NOT NULL").isEmpty():
            return reached
        reached = after.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    vocabulary = written(words(docs), "vocabulary")
    near = near_words(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best")
    )
    often = -F.col("best.less") >= TIMES * F.col("n")
    judged = written(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
    ), "word-forms")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


SQL = f"""
WITH RECURSIVE c AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
), o AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
    '{_UPPER}', '{_LOWER}') AS run FROM documents
), u AS (
  SELECT run, hex(encode(d || ':' || run)) AS x, count(*) AS n FROM o WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM u, c
), w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_TIMES}
), l AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)
), p AS MATERIALIZED (
  SELECT DISTINCT word, near, n FROM (
    SELECT a.word, b.word AS near, b.n FROM l a JOIN l b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM l a JOIN w b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM l a JOIN w b ON a.rest = b.word)
), q AS (
  SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM p
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(q.n_near, 0)::BIGINT AS n_near, CASE WHEN q.n >= {TIMES} * w.n THEN q.near END AS form,
    CASE WHEN q.n >= {TIMES} * w.n THEN q.n END AS form_n FROM w LEFT JOIN q ON q.word = w.word AND q.place = 1
), r AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""
