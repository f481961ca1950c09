"""Problem 7: evaluation texts that leak into training text.

Method: the items, in the one form of problem 8 and as words, give one
Aho-Corasick automaton. Its patterns are runs of half of `words` words, taken
at such places of each item that every run of `words` words holds one; so an
item makes no more nodes than it has characters. Each document is scanned once;
a hit is extended word by word both ways, and runs of `words` or more are
mapped back to offsets in the original text, through normalisation, character
by character.

The items are a withheld set of fixed size. They are read in blocks of at most
`block_chars` characters; a larger set makes more automata, each of bounded
size, and one more scan of the documents each, so no side grows beyond memory.
No document is sent to the driver, and none is shuffled.

Defined results: a null or empty text or item gives nothing; an item of fewer
words than `words` cannot leak; a document that holds several runs of an item
is one row of `leaks` and one row per run of `spans`; equal items each count.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.textform import form, form_offsets

WORD = re.compile(r"[^\W_]+")
WORDS = 12
BLOCK_CHARS = 4_000_000


def line_of(text: str) -> str:
    """The words of a text, each with a blank on both sides."""
    # Words are found before they are put in lower case, which may split a letter.
    return f" {' '.join(WORD.findall(form(text)))} ".lower()


def words_of(text: str) -> list[str]:
    return line_of(text).split()


def patterns(items: list[tuple[int, str]], n: int) -> tuple[dict[int, list[str]], dict[str, list[tuple[int, int]]]]:
    """The words of each item, and per pattern the items and places that have it."""
    size = max(1, n // 2)
    words = {k: words_of(text) for k, (_, text) in enumerate(items)}
    out: dict[str, list[tuple[int, int]]] = {}
    for k, w in words.items():
        if len(w) >= n:
            for i in range(0, len(w) - size + 1, n - size + 1):
                out.setdefault(f" {' '.join(w[i : i + size])} ", []).append((k, i))
    return words, out


@lru_cache(maxsize=4)
def _automaton(packed: bytes) -> tuple[dict[int, int], dict[int, list[str]], ahocorasick.Automaton]:
    ids, words, found = pickle.loads(packed)
    a = ahocorasick.Automaton()
    for pattern, places in found.items():
        a.add_word(pattern, (len(pattern), places))
    a.make_automaton()
    return ids, words, a


def blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, partition by partition."""
    block, size = [], 0
    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def _scan(docs: DataFrame, packed, schema: str, spans: bool, n: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, words, automaton = _automaton(packed.value)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                line = line_of(text)
                hits = [(end - size + 1, places) for end, (size, places) in automaton.iter(line)] if len(automaton) else []
                runs = _runs(line.split(), hits, words, n) if hits else []
                if runs and spans:
                    out += [(doc, *x) for x in _placed(text, [(ids[k], a, b) for k, a, b in runs])]
                else:
                    out += [(doc, i) for i in {ids[k] for k, _, _ in runs}]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.filter("text IS NOT NULL").select("doc_id", "text").mapInPandas(scan, schema)


def _runs(have: list[str], hits, words: dict[int, list[str]], n: int) -> list[tuple[int, int, int]]:
    """(item, first word, end) of the longest runs of n or more words that go through the hits."""
    number, at = {}, 0
    for k, w in enumerate(have):
        number[at] = k
        at += len(w) + 1
    out: set[tuple[int, int, int]] = set()
    seen: dict[tuple[int, int], int] = {}
    for pos, places in hits:
        p = number[pos]
        for item, i in places:
            # A hit within a run that was followed on the same diagonal is part of it.
            if p < seen.get((item, p - i), 0):
                continue
            own = words[item]
            a, b = 0, 0
            while p - a > 0 and i - a > 0 and have[p - a - 1] == own[i - a - 1]:
                a += 1
            while p + b < len(have) and i + b < len(own) and have[p + b] == own[i + b]:
                b += 1
            seen[item, p - i] = p + b
            if a + b >= n:
                out.add((item, p - a, p + b))
    # Where an item has a passage twice, the longest run at a place counts.
    return sorted(r for r in out if not any(r != q and q[0] == r[0] and q[1] <= r[1] and r[2] <= q[2] for q in out))


def _placed(text: str, runs: list[tuple[int, int, int]]):
    """Item, number of words, start and end in the text of each run."""
    f, starts, ends = form_offsets(text)
    places = [m.span() for m in WORD.finditer(f)]
    for item, a, b in runs:
        yield item, b - a, starts[places[a][0]], ends[places[b - 1][1] - 1]


def _all(docs: DataFrame, items: DataFrame, schema: str, spans: bool, words: int, block_chars: int) -> DataFrame:
    spark = docs.sparkSession
    out, several = None, False
    for block in blocks(items, block_chars):
        packed = spark.sparkContext.broadcast(pickle.dumps(({k: i for k, (i, _) in enumerate(block)}, *patterns(block, words))))
        part = _scan(docs, packed, schema, spans, words)
        out, several = (part, False) if out is None else (out.unionByName(part), True)
    if out is None:
        return spark.createDataFrame([], schema)
    # One id may have texts in two blocks.
    return out.distinct() if several else out


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) where the document has `words` consecutive words of the item, each pair once."""
    return _all(docs, items, "doc_id bigint, item_id bigint", False, words, block_chars)


def spans(docs: DataFrame, items: DataFrame, words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each leaked run: its words and its place in the original text (code points, end exclusive)."""
    return _all(docs, items, "doc_id bigint, item_id bigint, n_words int, start int, end int", True, words, block_chars)


def item_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item, how many documents give it away."""
    found = leaks(docs, items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return (
        items.select("item_id", "tier").distinct().join(found, "item_id", "left")
        .select("item_id", "tier", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    )
