"""Problem 2: splitting oversized texts at natural boundaries.

Method: the offsets of blanks in a text give the token offsets, and from their
cumulated run lengths the longest stretch without a blank. The places where a
piece may end are kept in sorted arrays, one per kind of boundary. From the
start of a piece, a binary search finds the last boundary of the best kind
within the limit; the next piece starts `overlap` characters before that place.

Kinds, best first: paragraph, line, sentence and word ends. A better kind wins
if it leaves a piece of at least half the limit, else the last boundary of any
kind is taken. Where no boundary lies behind the overlap and within the limit
the piece is cut hard at the limit, as the overlap is kept in every case: a
piece starts exactly `overlap` characters before the end of the one before.

Only texts over the limit leave the JVM; each is worked on alone, so there is
no shuffle.

Defined results: null, empty and short texts give no pieces here (`pieces`
returns a short text as one piece); pieces are at most `limit` characters,
their offsets count code points, and together they cover the text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 8000, 200
BLANK, BLANKS = re.compile(r"\s"), re.compile(r"\s+")
PARAGRAPHS = re.compile(r"\n[^\S\n]*\n\s*")
LINES = re.compile(r"\n\s*")
SENTENCES = re.compile(r"[.!?;:…][\"')\]”’»]*\s+")


def longest_run(text: str) -> int:
    """The most characters in a row without whitespace."""
    spans = np.array([m.span() for m in BLANKS.finditer(text)], dtype=np.int64).reshape(-1, 2)
    starts = np.concatenate([[0], spans[:, 1]])
    ends = np.concatenate([spans[:, 0], [len(text)]])
    return int((ends - starts).max())


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of each piece."""
    n = len(text)
    kinds = [
        (name, np.array([m.end() for m in p.finditer(text)], dtype=np.int64))
        for name, p in (("paragraph", PARAGRAPHS), ("line", LINES), ("sentence", SENTENCES))
    ]
    # A word ends where a blank begins; within a run of blanks a piece may end anywhere.
    blank = np.array([m.start() for m in BLANK.finditer(text)], dtype=np.int64)
    kinds.append(("word", np.union1d(blank, blank + 1)))

    def last(start: int, floor: int) -> tuple[int, str] | None:
        for name, at in kinds:
            k = int(np.searchsorted(at, start + limit, "right")) - 1
            if k >= 0 and at[k] > floor:
                return int(at[k]), name
        return None

    out, start = [], 0
    while n - start > limit:
        end, name = last(start, start + max(overlap, limit // 2)) or last(start, start + overlap) or (start + limit, "hard")
        out.append((start, end, name))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def pieces(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece, start, end, ends_at, text) for every text; short ones are one piece."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    schema = "array<struct<start:int,end:int,ends_at:string>>"

    @F.pandas_udf(schema)
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("start", "end", "ends_at"), c)) for c in cuts(t, limit, overlap)])

    texts = docs.filter(F.length("text") > 0).select("doc_id", "text")
    long = F.length("text") > limit
    cut_up = texts.filter(long).select("doc_id", "text", F.posexplode(split("text")).alias("piece", "c"))
    return (
        cut_up.select("doc_id", "piece", "c.*", F.expr("substring(text, c.start + 1, c.end - c.start)").alias("text"))
        .unionByName(texts.filter(~long).select(
            "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("end").alias("ends_at"), "text"
        ))
    )


def found(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, cut) of each text over the limit: `forced` if a stretch without a blank is over the limit too."""

    @F.pandas_udf("string")
    def how(s: pd.Series) -> pd.Series:
        # A stretch that no piece can hold makes a hard cut; so may a shorter one, as the overlap takes room.
        return s.map(lambda t: "forced" if any(c[2] == "hard" for c in cuts(t, limit, overlap)) and longest_run(t) > limit else "natural")

    return docs.filter(F.length("text") > limit).select("doc_id", how("text").alias("cut"))


def filings(manifests: DataFrame, docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces per filing, with the form as the latest manifest lists it and what its `chars` claims."""
    listed = (
        manifests.select("fetched_at", F.explode("documents").alias("d"))
        .groupBy("d.file")
        .agg(F.max_by(F.struct("d.form", "d.chars"), F.struct("fetched_at", "d.form", "d.chars")).alias("m"))
    )
    counted = (
        pieces(docs, limit, overlap).groupBy("doc_id")
        .agg(
            F.count("*").alias("n_pieces"), F.max(F.col("end") - F.col("start")).alias("longest"),
            F.count_if(F.col("ends_at") == "hard").alias("hard_cuts"), F.max("end").alias("chars"),
        )
    )
    return (
        docs.select("doc_id", "file").join(counted, "doc_id").join(listed, "file", "left")
        .select("doc_id", "file", "m.form", F.col("m.chars").alias("claimed_chars"), "chars", "n_pieces", "longest", "hard_cuts")
    )
