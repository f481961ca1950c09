"""Problem 6: encoding the whole corpus with a public byte-level BPE.

Method: a text is cut into words by the vocabulary's pattern; each word's bytes
are the leaves of a segment tree that keeps, per node, the leftmost minimum
rank of the pairs that start there. A merge takes the root's pair, links the
live neighbours around it and updates the two pairs that changed, each in a
logarithmic number of nodes; so a word of n bytes costs O(n log n) however long
it is, which is what keeps texts without any blank affordable.

Most words repeat, so each task keeps the ids of words it has seen, in a cache
of bounded size. Encoding is one narrow projection of the documents: nothing is
shuffled, and the vocabulary (its size is fixed by the tokenizer) is sent along
once.

Defined results: null and empty texts give an empty list; special tokens are
never produced, their spelling is ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which this vocabulary cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
NONE = 1 << 60

# Blanks as the pattern's \s has them. A stretch of blanks and the characters up
# to the next one are encoded alike wherever they stand: words never reach
# from a visible character across the blank that follows it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


class SegmentTree:
    """Minimum over keys with single updates; the minimum's low bits hold its place, so ties go left."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(len(keys) - 1, 0).bit_length()
        self.node = [NONE] * self.size + keys + [NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            a, b = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = a if a < b else b

    def set(self, i: int, key: int) -> None:
        node = self.node
        i += self.size
        node[i] = key
        while i > 1:
            other = node[i ^ 1]
            i >>= 1
            least = key if key < other else other
            if node[i] == least:
                return
            node[i] = key = least


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: merges in order of rank, the leftmost first."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the live piece that starts here
    before = list(range(-1, n - 1))  # start of the live piece before
    get = ranks.get
    keys = [(r << 32 | i) if (r := get(word[i : i + 2])) is not None else NONE for i in range(n - 1)]
    tree = SegmentTree(keys or [NONE])
    while (least := tree.node[1]) != NONE:
        i = least & 0xFFFFFFFF
        j = end[i]
        end[i] = k = end[j]
        tree.set(j, NONE) if j < n - 1 else None
        if k < n:
            before[k] = i
            r = get(word[i : end[k]])
            tree.set(i, NONE if r is None else r << 32 | i)
        else:
            tree.set(i, NONE)
        if (p := before[i]) >= 0:
            r = get(word[p:k])
            tree.set(p, NONE if r is None else r << 32 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, cache: int = CACHE):
        self.ranks, self.words, self.limit = ranks, regex.compile(pattern), cache
        self.seen: dict[str, tuple[int, ...]] = {}
        self.word_seen: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        ids = self.word_seen.get(w)
        if ids is None:
            ids = encode_word(w.encode("utf-8", "replace"), self.ranks)
            if len(w) < 64:
                if len(self.word_seen) >= self.limit:
                    self.word_seen.clear()
                self.word_seen[w] = ids
        return ids

    def stretch(self, s: str) -> tuple[int, ...]:
        ids = tuple(i for w in self.words.findall(s) for i in self.word(w))
        if len(s) < 64:
            if len(self.seen) >= self.limit:
                self.seen.clear()
            self.seen[s] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        get, miss, add = self.seen.get, self.stretch, out.extend
        for s in STRETCH.findall(text or ""):
            add(get(s) or miss(s))
        return out


def read_ranks(packed: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in packed.splitlines() if line)}


@lru_cache(maxsize=2)
def _encoder(packed: bytes, pattern: str, cache: int) -> Encoder:
    return Encoder(read_ranks(packed), pattern, cache)


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, cache: int = CACHE) -> DataFrame:
    """(doc_id, ids) of each document; the vocabulary file is read by the driver, executors need no copy."""
    with open(path, "rb") as f:
        packed = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(packed.value, pattern, cache)
        for s in batches:
            yield pd.Series([np.array(encoder.encode(x), dtype=np.int32) for x in s], dtype=object)

    return docs.select("doc_id", ids("text").alias("ids"))


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Documents, tokens and characters per language."""
    return (
        encode(docs, path).join(docs.select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("chars")), "doc_id")
        .groupBy("lang")
        .agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).cast("long").alias("n_tokens"), F.sum("chars").cast("long").alias("n_chars"))
    )
