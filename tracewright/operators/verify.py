"""Checking quotes against the documents they cite.

What is found literally is decided in the JVM. The residue is compared by
window: a window of the quote's length begins every `stride` characters of the
text, and a quote is FUZZY if its similarity to some window (twice the
characters in matching blocks by the characters of both) reaches the
threshold. Matching blocks that hold so many characters must hold many runs of
three as well, so windows with too few of the quote's runs are passed over
without a comparison; no verdict changes by that.

Defined results: an unknown or null file is BAD_FILE, an empty or null quote
NOT_FOUND; repeated rows of one `cite_id` are one citation; `ratio` is the best
similarity of the windows that can reach the threshold, NULL where none can.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import compared

THRESHOLD = 0.85
RUN = 3


def _codes(text: str) -> np.ndarray:
    """A number for each run of RUN characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    n = max(len(c) - RUN + 1, 0)
    return sum((c[k : k + n] << (21 * k) for k in range(RUN)), np.zeros(n, dtype=np.int64))


def window_starts(quote: str, text: str, stride: int, threshold: float) -> np.ndarray:
    """Starts of the windows whose similarity to the quote can reach the threshold, by the runs they share."""
    n = len(quote)
    starts = np.arange(0, max(1, len(text) - n), stride)
    sizes = np.minimum(n, len(text) - starts)
    # At least so many characters must match; what is left of both bounds the number of blocks, and each block loses RUN - 1 runs.
    matching = threshold * (n + sizes) / 2
    blocks = n + sizes - 2 * matching + 1
    needed = matching - (RUN - 1) * blocks
    own, counts = np.unique(_codes(quote), return_counts=True)
    runs = _codes(text)
    if len(own) == 0 or len(runs) == 0:
        return starts[needed <= 0]
    # Places of the quote's runs in order; per run, a window counts no more of them than the quote has.
    which = np.minimum(np.searchsorted(own, runs), len(own) - 1)
    places = np.flatnonzero(own[which] == runs)
    which = which[places]
    lo = np.searchsorted(places, starts)
    hi = np.searchsorted(places, starts + np.maximum(sizes - RUN + 1, 0))
    possible = np.flatnonzero(hi - lo >= needed)
    return np.array([
        starts[w] for w in possible if np.minimum(np.bincount(which[lo[w] : hi[w]], minlength=len(own)), counts).sum() >= needed[w]
    ], dtype=np.int64)


def similarity(quote: str, text: str, stride: int, threshold: float = THRESHOLD) -> float | None:
    """The best similarity of the quote to a window of the text among those that can reach the threshold."""
    compare = SequenceMatcher(None, quote, "")
    best = None
    for at in window_starts(quote, text, stride, threshold):
        compare.set_seq2(text[at : at + len(quote)])
        if best is None or compare.quick_ratio() > best:
            best = max(compare.ratio(), best or 0.0)
    return best


def located(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """Each citation with its normalised quote and its document's normalised text, both NULL-safe.

    Only the texts that are cited are normalised.
    """
    cites = citations.withColumn("base", F.element_at(F.split(F.coalesce("file", F.lit("")), "/"), -1)).withColumn(
        "q", F.coalesce(compared(F.col("quote")), F.lit(""))
    )
    cited = docs.select(F.col("file").alias("base"), "text").join(cites.select("base").distinct(), "base", "left_semi")
    texts = cited.select("base", F.coalesce(compared(F.col("text")), F.lit("")).alias("t"), F.lit(True).alias("known"))
    return cites.join(texts, "base", "left")


def verdict() -> Column:
    """Verdict of a located citation before any fuzzy comparison; NULL is the residue left for that."""
    return (
        F.when(F.col("known").isNull(), "BAD_FILE")
        .when(F.col("q") == "", "NOT_FOUND")
        .when(F.contains("t", "q"), "EXACT")
    )


def exact(citations: DataFrame, docs: DataFrame) -> DataFrame:
    return located(citations, docs).select("cite_id", "evidence_id", F.coalesce(verdict(), F.lit("RESIDUE")).alias("found"))


def checked(citations: DataFrame, docs: DataFrame, stride: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(cite_id, evidence_id, found, ratio); windows are `stride` characters apart, by default half a quote.

    Texts go to Python only for what the JVM left open.
    """

    @F.pandas_udf("double")
    def best(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else similarity(a, b, stride or max(1, len(a) // 2), threshold) for a, b in zip(q, t)], dtype=float)

    rows = located(citations.dropDuplicates(["cite_id"]), docs).withColumn("found", verdict())
    open_ = F.col("found").isNull()
    ratio = best(F.when(open_, F.col("q")), F.when(open_, F.col("t")))
    rows = rows.select("cite_id", "evidence_id", "found", ratio.alias("ratio"))
    return rows.withColumn("found", F.coalesce("found", F.when(F.col("ratio") >= threshold, "FUZZY").otherwise("NOT_FOUND")))


def accuracy(found: DataFrame, *by: str) -> DataFrame:
    """Counts per verdict and the share that holds, NULL where nothing was checked; `score` is 0 there."""
    good = F.count_if(F.col("found").isin("EXACT", "FUZZY"))
    share = F.try_divide(good.cast("double"), F.count("*").cast("double"))
    return found.groupBy(*by).agg(
        F.count("*").alias("checked"), *[F.count_if(F.col("found") == v).alias(v.lower()) for v in ("EXACT", "FUZZY", "BAD_FILE", "NOT_FOUND")],
        share.alias("accuracy"), F.coalesce(share, F.lit(0.0)).alias("score"),
    )


def screened(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """Evidence with its kept and quarantined citations; DIRECT without a kept one becomes INFERRED."""
    per = found.filter("evidence_id IS NOT NULL").groupBy("evidence_id").agg(
        F.count_if(F.col("found").isin("EXACT", "FUZZY")).alias("kept"), F.count_if(~F.col("found").isin("EXACT", "FUZZY")).alias("quarantined")
    )
    lost = (F.col("kept") == 0) & (F.col("quarantined") > 0) & (F.col("tier") == "DIRECT")
    return (
        evidence.join(per, evidence["id"] == per["evidence_id"], "left")
        .select(
            "id", F.when(lost, "INFERRED").otherwise(F.col("tier")).alias("tier"), F.coalesce("kept", F.lit(0)).alias("kept"),
            F.coalesce("quarantined", F.lit(0)).alias("quarantined"), F.when(lost, "unverifiable_citation").alias("integrity_flag"),
        )
    )
