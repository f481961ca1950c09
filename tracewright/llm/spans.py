"""Problem 1: long exact spans shared between records.

Method: seed and extend. Each different text is hashed by runs of `anchor`
characters and winnowed: of every `at_least - anchor + 1` neighbouring hashes
the least are kept, so two texts that share `at_least` characters share an
anchor. Texts are joined on their anchors, each match is extended both ways to
a maximal repeat, and repeats of at least `at_least` characters are kept.

Scale: equal texts are one class, known by a 128-bit digest and joined once,
whatever the number of copies; texts are carried once per class. The rows of a
class are added only to classes that do match, and grouped by file first, so
copies within one file are never paired. Two classes that one and the same file
holds alone are never compared. An anchor that more than `hot` classes share is
not joined as it is: its places are extended to the runs of `at_least`
characters around it, each with the character in front. Of these runs, texts
meet only in the one where their common stretch begins, that is, where the
characters in front differ, so each maximal repeat of two texts is met once and
the work is bounded by the anchors and the result. `shares` needs no pairs: a
run counts if more than one file has it, which is an aggregate.

Defined results: a record without id, file or text, or with a text under
`at_least` characters, shares nothing (`shares` lists it with 0); copies of a
row with one id are one record, the least (file, quote) of them if they differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import stored

AT_LEAST, ANCHOR, HOT = 120, 64, 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def run_hashes(text: str, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n characters, by doubling: the hash of 2k is made of two of k."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(h) < n:
        return h[:0]
    h = (h + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    # The binary digits of n say which blocks of 1, 2, 4, ... characters follow each other.
    out, done, size = None, 0, 1
    while True:
        if n & size:
            out = h if out is None else _join(out, h, done)
            done += size
        if size * 2 > n:
            return out
        h = _join(h, h, size)
        size *= 2


def _join(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Hash of a block followed, `gap` places later, by another."""
    m = min(len(a), len(b) - gap)
    h = (a[:m] * _BASE) ^ (b[gap : gap + m] + (a[:m] << np.uint64(23)))
    h *= _MIX
    return h ^ (h >> np.uint64(31))


def _slide(h: np.ndarray, window: int, f) -> np.ndarray:
    """f over every window of neighbouring values, by doubling."""
    size = 1
    while size * 2 <= window:
        h = f(h[:-size], h[size:])
        size *= 2
    return f(h[: len(h) - (window - size)], h[window - size :]) if window > size else h


def winnow(h: np.ndarray, window: int, owner: np.ndarray) -> np.ndarray:
    """Whether each hash is the least of some window of neighbouring hashes of one owner; all of equal least ones are."""
    if len(h) < window:
        return np.zeros(len(h), dtype=bool)
    edge = np.zeros(window - 1, dtype=h.dtype)
    within = owner[: len(h) - window + 1] == owner[window - 1 :]
    least = np.concatenate([edge, np.where(within, _slide(h, window, np.minimum), np.uint64(0)), edge])
    # The windows that hold a hash have least values up to it; it is chosen if one of them equals it.
    return _slide(least, window, np.maximum) == h


def records(rows: DataFrame, key: str, group: str, text: str, at_least: int) -> DataFrame:
    """One row per usable record: id, file, text."""
    return (
        rows.filter(F.col(key).isNotNull() & F.col(group).isNotNull() & (F.length(text) >= at_least))
        .groupBy(F.col(key).alias("id"))
        .agg(F.min(F.struct(F.col(group).alias("file"), F.col(text).alias("text"))).alias("r"))
        .select("id", "r.*")
    )


def classes(recs: DataFrame) -> DataFrame:
    """One row per different text: class (its digest), text, and `own`, the one file that holds it if it is one."""
    return recs.groupBy("class").agg(
        F.first("text").alias("text"), F.when(F.min("file") == F.max("file"), F.xxhash64(F.min("file"))).alias("own")
    )


def classed(rows: DataFrame, key: str, group: str, text: str, at_least: int) -> DataFrame:
    """The usable records with the class of each."""
    return records(rows, key, group, text, at_least).withColumn("class", F.unhex(F.md5("text")))


def _anchors(cls: DataFrame, anchor: int, at_least: int) -> DataFrame:
    """(class, own, pos, anchor) of the winnowed hashes; a batch of texts is hashed as one array."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            h = run_hashes("".join(texts), anchor)
            if len(h) == 0:
                continue
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            owner = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
            pos = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[owner]
            inside = pos <= sizes[owner] - anchor
            # Only runs within one text are winnowed; every text here has a window's worth of them.
            at = np.flatnonzero(inside)
            keep = at[winnow(h[at], at_least - anchor + 1, owner[at])]
            row = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(pos[keep].astype(np.int32)), pa.array(h[keep].view(np.int64))],
                ["class", "own", "pos", "anchor"],
            )

    return cls.select("class", "own", "text").mapInArrow(of, "class binary, own bigint, pos int, anchor bigint")


def _extended(places: DataFrame, cls: DataFrame, anchor: int, at_least: int) -> DataFrame:
    """(class, own, pos, run, check, front) of all runs of `at_least` characters that hold an anchor place.

    `run` and `check` are hashes of a run, of all of it and all but its last character; `front` is the
    character before it, null at the start of a text.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, runs, checks, fronts = [], [], [], [], []
            for k, (t, at) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                h = run_hashes(t, at_least)
                take = np.zeros(len(h), dtype=bool)
                for p in at:
                    take[max(0, p - at_least + anchor) : p + 1] = True
                take = np.flatnonzero(take)
                rows.append(np.full(len(take), k))
                pos.append(take)
                runs.append(h[take])
                checks.append(run_hashes(t, at_least - 1)[take])
                fronts += [ord(t[i - 1]) if i else None for i in take.tolist()]
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(pos).astype(np.int32)),
                        pa.array(np.concatenate(runs).view(np.int64)), pa.array(np.concatenate(checks).view(np.int64)), pa.array(fronts, pa.int32()),
                    ],
                    ["class", "own", "pos", "run", "check", "front"],
                )

    at = places.groupBy("class").agg(F.collect_set("pos").alias("at"))
    return at.join(cls, "class").select("class", "own", "text", "at").mapInArrow(of, "class binary, own bigint, pos int, run bigint, check bigint, front int")


def _apart(x: str, y: str) -> Column:
    """Whether some file of the one class is another than some file of the other."""
    return F.col(x).isNull() | F.col(y).isNull() | (F.col(x) != F.col(y))


def _meet(places: DataFrame) -> DataFrame:
    """Class pairs that share an anchor, one seed for each diagonal."""
    x = places.select("anchor", F.col("class").alias("a"), F.col("own").alias("f"), F.col("pos").alias("p"))
    y = places.select("anchor", F.col("class").alias("b"), F.col("own").alias("g"), F.col("pos").alias("q"))
    met = x.join(y, "anchor").filter(F.col("a") < F.col("b")).filter(_apart("f", "g"))
    return met.groupBy("a", "b", (F.col("q") - F.col("p")).alias("diagonal")).agg(F.min("p").alias("p"))


def _begin(runs: DataFrame) -> DataFrame:
    """Seeds of the class pairs whose common stretch begins at a run: the characters in front differ or one has none.

    Groups of a run by (front, own) meet first. As each two that may meet hold a pair of the result, the
    joins are no larger than that; most runs have one character in front and fall away before.
    """
    at_start = F.count_if(F.col("front").isNull())
    several = runs.groupBy("run").agg(
        ((F.min("front") != F.max("front")) | (at_start > 0)).alias("begins"),
        (F.count_if(F.col("own").isNull()) > 0).alias("spread"), (F.min("own") != F.max("own")).alias("files"),
    ).filter("begins AND (spread OR files)").select("run")
    kept = stored(runs.join(several, "run", "left_semi"))
    part = kept.groupBy("run", "front", "own").agg(F.lit(1).alias("one")).drop("one")
    met = (
        part.select("run", F.col("front").alias("c"), F.col("own").alias("f"))
        .join(part.select("run", F.col("front").alias("e"), F.col("own").alias("g")), "run").filter(_apart("f", "g"))
        .filter("coalesce(c, -1) < coalesce(e, -1) OR (c IS NULL AND e IS NULL AND (f IS NULL OR f <= g))")
    )
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    x = kept.select(F.col("run").alias("r"), F.col("front").alias("cx"), F.col("own").alias("fx"), F.col("class").alias("a"), F.col("pos").alias("p"))
    y = kept.select(F.col("run").alias("s"), F.col("front").alias("ey"), F.col("own").alias("gy"), F.col("class").alias("b"), F.col("pos").alias("q"))
    pairs = (
        met.join(x, (F.col("run") == F.col("r")) & same("c", "cx") & same("f", "fx"))
        .join(y, (F.col("run") == F.col("s")) & same("e", "ey") & same("g", "gy")).filter("a <> b")
    )
    first, other = F.struct(F.col("a").alias("c"), F.col("p").alias("at")), F.struct(F.col("b").alias("c"), F.col("q").alias("at"))
    pairs = pairs.select(F.least(first, other).alias("x"), F.greatest(first, other).alias("y"))
    return (
        pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), (F.col("y.at") - F.col("x.at")).alias("diagonal"), F.col("x.at").alias("p"))
        .groupBy("a", "b", "diagonal").agg(F.min("p").alias("p"))
    )


def extend(t: str, u: str, p: int, d: int, at_least: int) -> list[tuple[int, int, int]]:
    """Maximal repeats of at least `at_least` characters on the diagonal q = p + d."""
    lo, hi = max(0, -d), min(len(t), len(u) - d)
    if hi - lo < at_least:
        return []
    x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[lo:hi]
    y = np.frombuffer(u.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[lo + d : hi + d]
    ends = np.flatnonzero(np.concatenate([[True], x != y, [True]]))
    sizes = np.diff(ends) - 1
    return [(int(s) + lo, int(s) + lo + d, int(n)) for s, n in zip(ends[:-1], sizes) if n >= at_least]


def repeats(cls: DataFrame, at_least: int = AT_LEAST, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Maximal repeats between different texts (class, text, own): a < b (classes), start_a, start_b, n.

    Texts that only one and the same file holds are not compared, as their repeats are of no use to the callers.
    """
    places = stored(_anchors(cls, anchor, at_least))
    counts = places.groupBy("anchor").agg(F.count("*").alias("n"))
    few = places.join(counts.filter(f"n BETWEEN 2 AND {hot}"), "anchor", "left_semi")
    many = places.join(counts.filter(f"n > {hot}"), "anchor", "left_semi")
    seeds = _meet(few).unionByName(_begin(stored(_extended(many, cls, anchor, at_least))))
    seeds = seeds.groupBy("a", "b", "diagonal").agg(F.min("p").alias("p"))

    @F.pandas_udf("array<struct<start_a:int,start_b:int,n:int>>")
    def grown(t: pd.Series, u: pd.Series, p: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(
            [[dict(zip(("start_a", "start_b", "n"), r)) for r in extend(*x, at_least)] for x in zip(t, u, p, d)], dtype=object
        )

    return (
        seeds.join(cls.select(F.col("class").alias("a"), F.col("text").alias("t")), "a")
        .join(cls.select(F.col("class").alias("b"), F.col("text").alias("u")), "b")
        .select("a", "b", F.inline(grown("t", "u", "p", "diagonal")))
    )


def found(rows: DataFrame, key: str = "cite_id", group: str = "file", text: str = "quote", at_least: int = AT_LEAST) -> DataFrame:
    """(cite_id_a, cite_id_b): records of different files that share a run of `at_least` characters."""
    recs = stored(classed(rows, key, group, text, at_least))
    cls = stored(classes(recs))
    members = recs.select("id", "file", "class")
    files = members.select("class", "file").distinct()
    pairs = repeats(cls, at_least).select("a", "b").distinct()
    own = cls.filter("own IS NULL").select(F.col("class").alias("a"), F.col("class").alias("b"))
    by_file = (
        pairs.unionByName(own)
        .join(files.select(F.col("class").alias("a"), F.col("file").alias("f")), "a")
        .join(files.select(F.col("class").alias("b"), F.col("file").alias("g")), "b")
        .filter("f < g OR (f > g AND a <> b)")
    )
    return (
        by_file.join(members.select(F.col("id").alias("x"), F.col("class").alias("a"), F.col("file").alias("f")), ["a", "f"])
        .join(members.select(F.col("id").alias("y"), F.col("class").alias("b"), F.col("file").alias("g")), ["b", "g"])
        .select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
    )


def shares(
    rows: DataFrame, key: str = "cite_id", group: str = "file", text: str = "quote", at_least: int = AT_LEAST, anchor: int = ANCHOR
) -> DataFrame:
    """Per record: its length and how many of its characters lie in runs that a record of another file has too.

    The anchors that several files have are extended to runs; of these, those that several files have cover
    the text. A text that several files hold is covered whole.
    """
    recs = stored(classed(rows, key, group, text, at_least))
    cls = stored(classes(recs))
    several = (F.count_if(F.col("own").isNull()) > 0) | (F.min("own") != F.max("own"))
    places = stored(_anchors(cls, anchor, at_least))
    shared = places.groupBy("anchor").agg(several.alias("s")).filter("s").select("anchor")
    runs = stored(_extended(places.join(shared, "anchor", "left_semi"), cls, anchor, at_least))
    hit = runs.groupBy("run", "check").agg(several.alias("s")).filter("s").select("run", "check")
    spans = runs.filter("own IS NOT NULL").join(hit, ["run", "check"], "left_semi").select("class", F.col("pos").alias("lo")).distinct()
    w = Window.partitionBy("class").orderBy("lo")
    covered = (
        spans.withColumn("before", F.lag(F.col("lo") + at_least).over(w))
        .groupBy("class").agg(F.sum(at_least - F.greatest(F.coalesce("before", F.lit(0)) - F.col("lo"), F.lit(0))).cast("long").alias("shared"))
        .unionByName(cls.filter("own IS NULL").select("class", F.length("text").cast("long").alias("shared")))
    )
    got = recs.select("id", "class").join(covered, "class").select(F.col("id").alias(key), "shared")
    every = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.length(text)).alias("chars"))
    return every.join(got, key, "left").select(key, "chars", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))
