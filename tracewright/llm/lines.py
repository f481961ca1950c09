"""Problem 4: lines repeated across one site's documents.

Method: numbers, dates and names of each line are masked; the different masked
forms of a source are clustered by locality-sensitive hashing (minhash over
runs of five words); clusters that stand in many of the source's documents are
removed from each text.

Scale: one pass over the texts gives a narrow row per line (keys, no text); a
masked form's text comes along once per task. Forms are hashed once for all
sources. Different forms that share a bucket and a source are compared exactly
(Jaccard of the five-word runs, 0.8 or more). A bucket with more than `hot`
forms is taken apart by source first; one that has more within a source is
taken apart by the rarest runs of each form, of which alike forms share one;
what is large even then is compared with its least form, and only forms that
are not alike to that one are paired with the rest, as far as their
similarities to it allow. This loses no pair that shares a bucket, and no link
is made without the exact check. Lines that are equal in compared form are
linked whatever their masks. Clusters are the connected components of these
links. Only lines of clusters that stand in enough documents go on; within
these clusters documents are counted per compared form where that is asked for.

Defined results: a null text or source has no lines; lines shorter than
`min_chars` in compared form stay; a line that repeats within one document
counts for it once; a text all of whose lines go becomes empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.components import components
from tracewright.session import stored

MIN_CHARS, MIN_DOCS = 30, 6
WORDS, SIMILAR, BANDS, ROWS, HOT = 5, 0.8, 12, 6, 50
# Month names of the corpus languages, for masking dates.
MONTHS = (
    "January February March April May June July August September October November December "
    "Januar Februar März Mai Juni Juli Oktober Dezember janvier février mars avril mai juin juillet août septembre "
    "octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря"
).split()
_MONTHS = set(MONTHS)
_BARE = re.compile(r"^[^\w$€£]+|[^\w%]+$")
_ISO = re.compile(r"\W*\d{4}-\d\d-\d\d\b")


class _Words(dict):
    """word -> what stands for it, remembered up to a bound."""

    def __init__(self, make, limit: int = 200_000):
        self.make, self.limit = make, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = self.make(word)
        return out


class _Masks(_Words):
    """Numbers, which hardly repeat, are told by their first characters and not remembered."""

    def __missing__(self, word: str) -> str:
        if (word[0] in "$€£0123456789" or word[1:2].isdigit()) and not _ISO.match(word):
            return "<0>"
        return super().__missing__(word)


def _mask_word(word: str) -> str:
    bare = _BARE.sub("", word)
    if any(c.isdigit() for c in bare):
        return "<d>" if _ISO.match(bare) else "<0>"
    if bare in _MONTHS:
        return "<d>"
    return "<n>" if bare[:1].isupper() else word.lower()


_masks = _Masks(_mask_word)


def collapse(m: str) -> str:
    """Neighbouring masks of one name or date made one."""
    if "<d>" in m:
        while "<d> <0>" in m:
            m = m.replace("<d> <0>", "<d>")
        m = m.replace("<0> <d>", "<d>")
    while "<n> <n>" in m:
        m = m.replace("<n> <n>", "<n>")
    return m


def mask(words: list[str]) -> str:
    """A line's words with dates, numbers and capitalised names masked, in lower case."""
    return collapse(" ".join(map(_masks.__getitem__, words)))


OCCURRENCES = "doc_id bigint, source_key bigint, line_no int, first boolean, first_form boolean, line bigint, form bigint, masked string"


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, source_key, line_no, first, first_form, line, form, masked) of each long line.

    `line` and `form` are keys of the compared and the masked form; `first` and
    `first_form` say that the document has not had them before; `masked` is the
    masked form itself where a task meets it for the first time.
    """

    names = [c.split()[0] for c in OCCURRENCES.split(", ")]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        digest, masked_word = xxhash.xxh3_64_intdigest, _masks.__getitem__
        for batch in batches:
            numbers, firsts, first_forms, keys, forms, masked, counts = [], [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                before, had, had_forms = len(numbers), set(), set()
                for i, raw in enumerate(text.split("\n"), 1):
                    if len(raw) < min_chars:
                        continue
                    words = raw.split()
                    low = " ".join(words).lower()
                    if len(low) < min_chars:
                        continue
                    m = collapse(" ".join(map(masked_word, words)))
                    form = digest(m.encode("utf-8", "surrogatepass"))
                    numbers.append(i)
                    line = digest(low.encode("utf-8", "surrogatepass"))
                    keys.append(line)
                    firsts.append(line not in had)
                    had.add(line)
                    first_forms.append(form not in had_forms)
                    had_forms.add(form)
                    forms.append(form)
                    masked.append(None if form in known else m)
                    known.add(form)
                counts.append(len(numbers) - before)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            key = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row), batch.column(1).take(row), pa.array(numbers, pa.int32()), pa.array(firsts, pa.bool_()),
                    pa.array(first_forms, pa.bool_()), key(keys), key(forms), pa.array(masked, pa.string()),
                ],
                names,
            )

    kept = docs.filter("text IS NOT NULL AND source IS NOT NULL")
    return kept.select("doc_id", F.xxhash64("source").alias("source_key"), "text").mapInArrow(lines, OCCURRENCES)


_hashes = _Words(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words of each text, one after the other, and where each text's begin.

    A text of fewer words is one run.
    """
    split = [t.split() or [""] for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    h = np.fromiter((_hashes[w] for ws in split for w in ws), dtype=np.uint64, count=int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    padded = np.concatenate([h, np.zeros(WORDS, dtype=np.uint64)])
    # Short texts are hashed over their own words only.
    left = np.repeat(starts + sizes, sizes) - np.arange(len(h))
    runs = np.zeros(len(h), dtype=np.uint64)
    for k in range(WORDS):
        runs = (runs ^ np.where(left > k, padded[k : k + len(h)], np.uint64(0))) * _ODD
        runs ^= runs >> np.uint64(29)
    keep = left >= WORDS
    keep[starts] = True
    counts = np.add.reduceat(keep.astype(np.int64), starts)
    return runs[keep], np.concatenate([[0], np.cumsum(counts)])


_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64)


def band_keys(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One key per text and band of its minhash signature."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(at) - 1, 1))
    for b in range(BANDS):
        for r in range(ROWS):
            h = runs * _MUL[b * ROWS + r] + _ADD[b * ROWS + r]
            h ^= h >> np.uint64(32)
            keys[:, b] = (keys[:, b] ^ np.minimum.reduceat(h * np.uint64(0xD6E8FEB86659FD93), at[:-1])) * _ODD
            keys[:, b] ^= keys[:, b] >> np.uint64(31)
    return keys


FORMS = "form bigint, runs array<int>, buckets array<bigint>"


def hashed(texts: DataFrame) -> DataFrame:
    """(form, runs, buckets): the distinct run hashes, sorted, and the band keys of each masked form."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            runs, at = shingles(batch.column(1).to_pylist())
            keys = band_keys(runs, at)
            low = (runs >> np.uint64(32)).astype(np.uint32).view(np.int32)
            sets = [np.unique(low[a:b]) for a, b in zip(at[:-1], at[1:])]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
                ],
                ["form", "runs", "buckets"],
            )

    return texts.select("form", "masked").mapInArrow(of, FORMS)


def node(form: str) -> Column:
    """A masked form within a source."""
    return F.xxhash64("source_key", form)


def likeness() -> Column:
    """The Jaccard similarity of the sets x and y."""
    share = F.size(F.array_intersect("x", "y")) / (F.size("x") + F.size("y"))
    return share / (1 - share)


def alike() -> Column:
    """Whether it reaches SIMILAR: with b runs in common, b / (x + y - b) does if b / (x + y) reaches this."""
    return F.size(F.array_intersect("x", "y")) >= (F.size("x") + F.size("y")) * (SIMILAR / (1 + SIMILAR)) - 1e-9


def refined(many: DataFrame, forms: DataFrame) -> DataFrame:
    """(source_key, bucket, run, form, size, n, least): each form under the rarest runs it has in its bucket.

    Of `size` runs, all but a fifth are in every set that is alike; so if the runs of a bucket are put in one
    order, alike sets share one of their first `size` / 5 + 1. The order is by rarity, which gives small parts.
    """
    key = ["source_key", "bucket"]
    rows = many.select(*key, "form", "size").join(forms.select("form", "runs"), "form").select(*key, "form", "size", F.explode("runs").alias("run"))
    rarity = rows.groupBy(*key, "run").agg(F.count("*").alias("held"))
    first = F.slice(F.sort_array(F.collect_list(F.struct("held", "run"))), 1, F.first("size") - F.ceil(F.first("size") * SIMILAR - 1e-9).cast("int") + 1)
    parts = stored(
        rows.join(rarity, [*key, "run"]).groupBy(*key, "form").agg(F.first("size").alias("size"), first.alias("rare"))
        .select(*key, "form", "size", F.explode("rare.run").alias("run"))
    )
    counts = parts.groupBy(*key, "run").agg(F.count("*").alias("n"), F.min("form").alias("least")).filter("n > 1")
    return parts.join(counts, [*key, "run"]).select(*key, "run", "form", "size", "n", "least")


def around_least(parts: DataFrame, forms: DataFrame) -> DataFrame:
    """(source_key, form, other): candidates of large parts, enough for their connected components.

    Forms alike to the part's least one are joined by it. All others meet every form whose distance to the
    least one differs by no more than alike forms' can, as the Jaccard distance keeps the triangle inequality.
    """
    key = ["source_key", "bucket", "run"]
    near = (
        parts.select("form", "least").distinct()
        .join(forms.select("form", F.col("runs").alias("x")), "form")
        .join(forms.select(F.col("form").alias("least"), F.col("runs").alias("y")), "least")
        .select("form", "least", likeness().alias("near"))
    )
    parts = stored(parts.join(near, ["form", "least"]))
    joined = F.col("near") >= SIMILAR - 1e-9
    other = parts.select(*key, F.col("form").alias("other"), F.col("size").alias("other_size"), F.col("near").alias("other_near"))
    apart = (
        parts.filter(~joined).join(other, key)
        # Two that are both not joined meet twice, once is enough.
        .filter((F.col("form") < F.col("other")) | ((F.col("form") > F.col("other")) & (F.col("other_near") >= SIMILAR - 1e-9)))
        .filter(F.least("size", "other_size") >= F.greatest("size", "other_size") * SIMILAR)
        .filter(F.abs(F.col("near") - F.col("other_near")) <= 1 - SIMILAR + 1e-9)
        .select("source_key", "form", "other")
    )
    stars = parts.filter(joined & (F.col("form") > F.col("least"))).select("source_key", "form", F.col("least").alias("other"))
    return apart.unionByName(stars).select("source_key", F.least("form", "other").alias("form"), F.greatest("form", "other").alias("other"))


def nodes(occ: DataFrame) -> DataFrame:
    """One row per masked form of a source, with the documents that have it."""
    return occ.groupBy("source_key", "form").agg(F.count_if("first_form").alias("docs"))


def links(occ: DataFrame, held: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs of nodes (a, b) that are alike; `held` has the nodes."""
    texts = occ.filter("masked IS NOT NULL").groupBy("form").agg(F.first("masked").alias("masked"))
    forms = stored(hashed(texts))
    held = held.select("source_key", "form")
    # `own` is the source of a form that only one has.
    spread = held.groupBy("form").agg(F.count("*").alias("sources"), F.when(F.count("*") == 1, F.min("source_key")).alias("own"))
    keyed = forms.select("form", F.size("runs").alias("size"), F.explode("buckets").alias("bucket"))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = stored(keyed.join(counts, "bucket").join(spread, "form"))
    # Sets of very unlike size cannot be alike enough.
    close = F.least("size", "other_size") >= F.greatest("size", "other_size") * SIMILAR
    other = {"form": "other", "size": "other_size", "sources": "other_sources", "own": "other_own"}

    # Small buckets are paired once for all sources; then the sources of the rarer form that hold the other one count.
    small = keyed.filter(F.col("n") <= hot).select("bucket", "form", "size", "sources", "own")
    rare = (F.col("sources") < F.col("other_sources")) | ((F.col("sources") == F.col("other_sources")) & (F.col("form") < F.col("other")))
    together = F.col("own").isNull() | F.col("other_own").isNull() | (F.col("own") == F.col("other_own"))
    met = stored(
        small.join(small.withColumnsRenamed(other), "bucket").filter(F.col("form") != F.col("other")).filter(rare & close & together)
        .select("form", "other", "own", "other_own").distinct()
    )
    of_one = met.filter("own IS NOT NULL").withColumnRenamed("own", "source_key")
    of_many = met.filter("own IS NULL").join(held, "form").select("form", "other", "source_key", "other_own")
    met = (
        of_one.filter("other_own IS NOT NULL").select("source_key", "form", "other")
        .unionByName(
            of_one.filter("other_own IS NULL").unionByName(of_many)
            .join(held.withColumnRenamed("form", "other"), ["source_key", "other"]).select("source_key", "form", "other")
        )
    )

    # Large buckets are taken apart by source, what is large in a source as well by rare runs.
    inside = keyed.filter(F.col("n") > hot).select("bucket", "form", "size").join(held, "form")
    sizes = inside.groupBy("source_key", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    inside = stored(inside.join(sizes, ["source_key", "bucket"]))
    fine = stored(refined(inside.filter(F.col("n") > hot), forms))
    few = inside.withColumn("run", F.lit(0)).unionByName(fine.drop("least")).filter(F.col("n") <= hot).drop("n")
    own = (
        few.join(few.withColumnsRenamed({"form": "other", "size": "other_size"}), ["source_key", "bucket", "run"])
        .filter("form < other").filter(close).select("source_key", "form", "other")
    )
    pairs = met.unionByName(own).unionByName(around_least(fine.filter(F.col("n") > hot).drop("n"), forms))
    pairs = pairs.select("source_key", F.least("form", "other").alias("form"), F.greatest("form", "other").alias("other")).distinct()
    verified = (
        pairs.join(forms.select("form", F.col("runs").alias("x")), "form")
        .join(forms.select(F.col("form").alias("other"), F.col("runs").alias("y")), "other")
        .filter(alike())
        .select(node("form").alias("a"), node("other").alias("b"))
    )
    # Lines of one compared form can differ in case and so in masks.
    line = ["source_key", "line"]
    equal = occ.groupBy(*line).agg(F.min("form").alias("least"), F.max("form").alias("most")).filter("least < most")
    equals = (
        occ.select(*line, "form").join(equal, line).filter("form > least")
        .select(node("form").alias("a"), node("least").alias("b")).distinct()
    )
    return verified.unionByName(equals)


def clustered(docs: DataFrame, min_chars: int = MIN_CHARS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Line occurrences, and the masked forms of each source (source_key, form, docs) with their cluster."""
    occ = stored(occurrences(docs, min_chars))
    held = stored(nodes(occ))
    roots = components(links(occ, held, hot))
    own = held.withColumn("node", node("form")).join(roots, "node", "left")
    return occ, stored(own.select("source_key", "form", "docs", F.coalesce("root", "node").alias("cluster")))


def frequent(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(doc_id, source_key, line_no, first, line, cluster) of the lines whose cluster can stand in `min_docs` documents.

    That is so if its masked forms together have as many, each counted by itself.
    """
    occ, held = clustered(docs, min_chars, hot)
    large = held.groupBy("cluster").agg(F.sum("docs").alias("most_docs")).filter(F.col("most_docs") >= min_docs).select("cluster")
    kept = held.join(large, "cluster", "left_semi").select("source_key", "form", "cluster")
    return stored(occ.select("doc_id", "source_key", "line_no", "first", "line", "form").join(kept, ["source_key", "form"]).drop("form"))


def repeated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(doc_id, source_key, line_no, line, cluster, n_docs) of the lines whose cluster stands in `min_docs` documents."""
    rows = frequent(docs, min_docs, min_chars, hot).drop("first")
    sizes = rows.select("cluster", "doc_id").distinct().groupBy("cluster").agg(F.count("*").alias("n_docs"))
    return rows.join(sizes.filter(F.col("n_docs") >= min_docs), "cluster")


def same(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(doc_id, source_key, line_no, line) of the lines whose very compared form stands in `min_docs` documents.

    Documents are counted per cluster and compared form, within the clusters that are frequent enough.
    """
    rows = frequent(docs, min_docs, min_chars, hot)
    key = ["source_key", "cluster", "line"]
    kept = rows.groupBy(*key).agg(F.count_if("first").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return rows.join(kept, key, "left_semi").select("doc_id", "source_key", "line_no", "line")


def found(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    return same(docs, min_docs, min_chars).select("doc_id", "line_no")


def clean(docs: DataFrame, near: bool = False, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, removed): each text without its repeated lines, with `near` those of whole clusters."""
    lines = (repeated if near else same)(docs, min_docs, min_chars)
    gone = lines.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i + 1)), "\n")
    return (
        docs.select("doc_id", "text").join(gone, "doc_id", "left")
        .select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
    )


def report(docs: DataFrame, manifests: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Repeated clusters per source and form of filing: documents and lines."""
    listed = (
        manifests.select("fetched_at", F.explode("documents").alias("d")).groupBy("d.file")
        .agg(F.max_by("d.form", F.struct("fetched_at", "d.form")).alias("form"))
    )
    return (
        repeated(docs, min_docs).join(docs.select("doc_id", "source", "file"), "doc_id").join(listed, "file", "left")
        .groupBy("source", "cluster", "form")
        .agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_form_docs"), F.first("n_docs").alias("n_docs"))
    )
