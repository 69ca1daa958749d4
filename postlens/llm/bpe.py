"""BPE encoding and decoding by a prefix-sharing trie over distinct words.

A text falls into pieces that can be encoded on their own.  The new distinct words of a batch enter a
trie; its depth-first walk gives every node its *last token*: the final token of the encoding of the
bytes on the path.  The last token of a prefix is the one token that ends there and may follow the last
token of what stands before it, so an encoding is read backwards from a node and prefixes shared by
many words are computed once.  Finished words are kept per Python worker in a table of bounded bytes.

Special tokens written out in a text are encoded as such (the tokenizer file's default) and decoding
keeps them.  Null is an empty text: no token, and the digests of nothing.  Rows are encoded one by one,
so repeated rows repeat, ties don't occur, an empty table gives an empty result; texts are never cut.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from postlens.llm.common import slices, small_batches

MOST_PIECES = 600_000        # entries of the worker's table before it starts anew
MOST_BYTES = 1 << 27         # of pieces and their encodings in that table
LONGEST = 64                 # letters of a piece that is kept; longer ones are encoded where they stand
MOST_PAIRS = 2_000_000       # known pairs of tokens before their table starts anew

# fixed values: the pre-tokenizer's pattern and its white space
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|["
    + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
)


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for the 256 byte values."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """One vocabulary with its pair rules and the table of known pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        raw = {bytes(letters[c] for c in word): i for word, i in data["model"]["vocab"].items()
               if all(c in letters for c in word)}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = {k: v for k, v in special.items() if k}
        self.bytes = {i: b for b, i in raw.items()}
        self.bytes.update({i: s.encode() for s, i in self.special.items()})
        # rank order: single bytes first, then one number per merge
        singles = [b for b in raw if len(b) == 1]
        self.rank = {b: k for k, b in enumerate(sorted(singles))}
        self.join: dict[tuple[int, int], int] = {}
        self.split = {k: (k, k) for k in range(len(singles))}
        for a, b in data["model"]["merges"]:
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            pair = (self.rank[left], self.rank[right])
            whole = self.rank.setdefault(left + right, len(self.rank))
            self.join.setdefault(pair, whole)
            self.split.setdefault(whole, pair)
        self.id = {k: raw[b] for b, k in self.rank.items()}
        self.size = {k: len(b) for b, k in self.rank.items()}
        # every ending of a token: its rank, or -1 where it is no token itself
        self.tail = {b[k:]: -1 for b in self.rank for k in range(len(b))} | self.rank
        self.word = regex.compile(PATTERN)
        self.double = regex.compile(f"[{WHITE}]{{2}}")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len)[::-1])) + ")") \
            if self.special else None
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.held = 0                       # bytes in the two tables below
        self.ids: dict[str, str] = {}       # piece -> its ids, each with a comma behind
        self.text: dict[str, bytes] = {}    # piece -> the bytes its ids decode to

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay apart when their bytes are encoded together.

        Undo the later of both tokens step by step; a merge across the border that comes before the
        merge just undone would have happened first.
        """
        limit = 1 << 60
        while True:
            merged = self.join.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def encode_words(self, words) -> dict[bytes, list[int]]:
        """Ids of distinct words by one walk over their trie.

        Sorted words are the trie's depth-first order: going from one to the next keeps the last tokens
        of the shared prefix and works out those of the bytes that differ.
        """
        out: dict[bytes, list[int]] = {}
        tail, size, ids, fits, follows = self.tail, self.size, self.id, self.fits, self.may_follow
        last: list[int] = []
        before = b""
        if len(fits) > MOST_PAIRS:
            fits.clear()
        for w in sorted(words):
            shared, most = 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del last[shared:]
            for n in range(shared + 1, len(w) + 1):
                found = -1
                for begin in range(n - 1, -1, -1):
                    t = tail.get(w[begin:n])
                    if t is None:
                        break
                    if t >= 0:
                        if begin:
                            key = last[begin - 1] << 20 | t
                            good = fits.get(key)
                            if good is None:
                                good = fits[key] = follows(last[begin - 1], t)
                            if good:
                                found = t
                        else:
                            found = t
                last.append(found)
            at, got = len(w), []
            while at:
                t = last[at - 1]
                got.append(ids[t])
                at -= size[t]
            got.reverse()
            out[w] = got
            before = w
        return out

    def learn(self, pieces) -> None:
        """Encode new pieces; a piece that starts with a line end stands as it is, others follow a blank."""
        split = {p: [w.encode() for w in self.word.findall(p if p[:1] == "\n" else f" {p}")] for p in pieces}
        known = self.encode_words({w for ws in split.values() for w in ws})
        for p, ws in split.items():
            ids = [i for w in ws for i in known[w]]
            self.ids[p] = "".join(f"{i}," for i in ids)
            self.text[p] = b"".join(self.bytes[i] for i in ids)
            self.held += len(p) + len(self.ids[p]) + len(self.text[p])

    def forget(self, pieces) -> None:
        """Long pieces seldom come again: they leave the table with their batch."""
        for p in pieces:
            if len(p) > LONGEST:
                self.held -= len(p) + len(self.ids[p]) + len(self.text[p])
                del self.ids[p], self.text[p]

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """(head, pieces): a border lies before a blank or line end that follows no white space."""
        head, *rest = text.replace("\n", " \n").split(" ")
        return head, rest

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Per text: its ids, each with a comma behind, and the bytes they decode to."""
        plain, other = {}, {}
        new: set[str] = set()
        for k, t in enumerate(texts):
            if not t:
                other[k] = ("", b"")
            elif self.double.search(t) or (self.cut and self.cut.search(t)):
                other[k] = self.encode_whole(t)
            else:
                plain[k] = self.pieces(t)
                new.update(plain[k][1])
        if len(self.ids) > MOST_PIECES or self.held > MOST_BYTES:
            self.clear()
        new.difference_update(self.ids)
        if new:
            self.learn(new)
        heads = self.encode_words({w for h, _ in plain.values() for w in map(str.encode, self.word.findall(h))})
        out = []
        for k in range(len(texts)):
            if k in other:
                out.append(other[k])
                continue
            head, rest = plain[k]
            ids = [i for w in self.word.findall(head) for i in heads[w.encode()]]
            out.append((
                "".join(f"{i}," for i in ids) + "".join(map(self.ids.__getitem__, rest)),
                b"".join(self.bytes[i] for i in ids) + b"".join(map(self.text.__getitem__, rest)),
            ))
        self.forget(new)
        return out

    def encode_whole(self, text: str) -> tuple[str, bytes]:
        """A text with runs of white space or special tokens: no borders are assumed."""
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                words = [w.encode() for w in self.word.findall(part)]
                known = self.encode_words(set(words))
                ids += [i for w in words for i in known[w]]
        return "".join(f"{i}," for i in ids), b"".join(self.bytes[i] for i in ids)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; unknown ids are skipped, broken UTF-8 becomes replacement characters."""
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _array(ids: list[str]) -> pa.Array:
    lengths = [i.count(",") for i in ids]
    flat = np.fromstring("".join(ids), np.int32, sep=",") if any(lengths) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat, pa.int32()))


def encoded(docs: DataFrame, path: str, keep: list[str], ids: bool = True, decoded: bool = False) -> DataFrame:
    """``keep``, n_tokens, the SHA-256 of the comma-joined ids and of the decoded text, and on demand
    token_ids and the decoded text itself, of every row."""
    extra = ["token_ids array<int>"] * ids + ["decoded string"] * decoded
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(e.split(" ")[0] for e in extra)]

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            held = {n: batch.column(n) for n in keep}
            for a, b in slices(texts):
                got = coder.encode(texts[a:b])
                back = [t.decode("utf-8", "replace") for _, t in got]
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(a, b - a) for c in held.values()),
                    pa.array([i.count(",") for i, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(i[:-1].encode()).hexdigest() for i, _ in got], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    *([_array([i for i, _ in got])] if ids else []), *([pa.array(back, pa.string())] if decoded else []),
                ], names)

    kinds = dict(small_batches(docs).dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *extra]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(schema))
