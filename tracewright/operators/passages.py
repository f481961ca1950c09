"""Passage retrieval: relevance, places of terms, windows around them, and excerpts within a budget.

Everything stays in column expressions and windows per document; a document has
at most six places per term, so the groups are as small as the term list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import occurrences
from tracewright.operators.events import top_k
from tracewright.operators.ranks import ranked

HEAD, WINDOW, BUDGET, HITS, SHORTEST = 1500, 2600, 40000, 6, 4
# What a figure and a term look like.
FIGURE = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"
TERM = r"[A-Za-z][A-Za-z0-9]{3,}"
# Words that select nothing.
STOP = """the and for with from that this have been were was are which their they
company companies inc llc corp report reports reported filing filings financial
statement statements period periods year years quarter quarters what when where
identify determine whether across between during before after any all more most""".split()


def query_terms(text: Column) -> Column:
    """Figures first, then words of four letters or more in lower case, distinct and without stop words."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    return F.concat(
        F.array_distinct(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0))),
        F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP))),
    )


def score(text: Column, terms: list[str]) -> Column:
    """How often the terms stand in the whole text."""
    total = F.lit(0).cast("long")
    for t in terms:
        if len(t) >= SHORTEST:
            total = total + F.coalesce(occurrences(text, t.lower()), F.lit(0))
    return total


def spans(docs: DataFrame, terms: list[str], hits: int = HITS) -> DataFrame:
    """(doc_id, term, n, lo, hi): the first places of each term, 0-based, without overlap."""
    wanted = [t.lower() for t in terms if len(t) >= SHORTEST]
    low = docs.filter("text IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    # One row per text holds the places of all terms; the text is not copied for each.
    split = low.select("doc_id", *[F.when(F.contains("low", F.lit(t)), F.split("low", re.escape(t), hits + 1)).alias(f"p{k}") for k, t in enumerate(wanted)])

    def places(k: int, term: str) -> Column:
        start = lambda i: F.length(F.array_join(F.slice(f"p{k}", F.lit(1), i), term))
        found = F.transform(F.sequence(F.lit(1), F.size(f"p{k}") - 1), lambda i: F.struct(F.lit(term).alias("term"), (i - 1).alias("n"), start(i).alias("lo")))
        return F.when(F.col(f"p{k}").isNotNull(), found).otherwise(F.array().cast("array<struct<term:string,n:int,lo:int>>"))

    rows = split.select("doc_id", F.explode(F.concat(*[places(k, t) for k, t in enumerate(wanted)])).alias("p")).select("doc_id", "p.*")
    return rows.withColumn("hi", F.col("lo") + F.length("term"))


def merged(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Intervals (key, lo, hi) that touch or overlap made one."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    ahead = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("new", F.when(ahead.isNull() | (F.col("lo") > ahead), 1).otherwise(0))
        .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")
    )


def windows(docs: DataFrame, terms: list[str], window: int = WINDOW) -> DataFrame:
    """(doc_id, lo, hi, matches): merged windows around the places, with the number of places that start in each."""
    s = spans(docs, terms)
    sized = s.join(docs.select("doc_id", F.length("text").alias("n_chars")), "doc_id")
    wins = merged(sized.select("doc_id", F.greatest(F.col("lo") - window, F.lit(0)).alias("lo"), F.least(F.col("hi") + window, "n_chars").alias("hi")))
    inside = wins.join(s.select("doc_id", F.col("lo").alias("at")), "doc_id").filter("at >= lo AND at < hi")
    return inside.groupBy("doc_id", "lo", "hi").agg(F.count("*").alias("matches"))


def filled(docs: DataFrame, terms: list[str], budget: int = BUDGET, window: int = WINDOW, head: int = HEAD) -> DataFrame:
    """(doc_id, lo, hi): the head and the densest windows of each text over the budget, cut where the budget ends."""
    long = docs.filter(F.length("text") > budget).select("doc_id", "text")
    wins = windows(long, terms, window)
    w = Window.partitionBy("doc_id").orderBy(F.desc("matches"), "lo").rowsBetween(Window.unboundedPreceding, -1)
    used = F.lit(head) + F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(w), F.lit(0))
    taken = wins.withColumn("take", F.least(F.col("hi") - F.col("lo"), F.lit(budget) - used)).filter("take > 0")
    heads = wins.select("doc_id").distinct().select("doc_id", F.lit(0).alias("lo"), F.lit(head).alias("hi"))
    return heads.unionByName(taken.select("doc_id", "lo", (F.col("lo") + F.col("take")).alias("hi")))


def excerpts(docs: DataFrame, terms: list[str], budget: int = BUDGET, window: int = WINDOW, head: int = HEAD) -> DataFrame:
    """(doc_id, mode, excerpt): short texts whole, texts without a match by their head, others by windows with gaps marked."""
    keep = merged(filled(docs, terms, budget, window, head))
    per = keep.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("w"))
    gap = lambda n: F.when(n > 0, F.concat(F.lit("\n[... "), F.format_number(n, 0), F.lit(" characters omitted ...]\n"))).otherwise("")
    before = F.expr("transform(w, (x, i) -> x.lo - if(i = 0, 0, w[i - 1].hi))")
    parts = F.zip_with("w", before, lambda x, g: F.concat(gap(g), F.substring(F.col("text"), x["lo"] + 1, x["hi"] - x["lo"])))
    rest = F.length("text") - F.element_at("w", -1)["hi"]
    return docs.filter("text IS NOT NULL").select("doc_id", "text").join(per, "doc_id", "left").select(
        "doc_id",
        F.when(F.length("text") <= budget, "full").when(F.col("w").isNull(), "head").otherwise("windows").alias("mode"),
        F.when(F.length("text") <= budget, F.col("text")).when(F.col("w").isNull(), F.left("text", F.lit(budget)))
        .otherwise(F.concat(F.array_join(parts, ""), gap(rest))).alias("excerpt"),
    )


def best(docs: DataFrame, terms: list[str], by: str, k: int) -> DataFrame:
    """(doc_id, by, score, rn): the k first documents of each group, ties by id; Spark drops lower ranks before the shuffle."""
    return top_k(docs.select("doc_id", by, score(F.col("text"), terms).alias("score")), by, k, F.desc("score"), F.col("doc_id"))


def scored(docs: DataFrame, terms: list[str], by: str) -> DataFrame:
    """(doc_id, by, score, rn): rank of each document within its group, ties by id."""
    return ranked(docs.select("doc_id", by, score(F.col("text"), terms).alias("score")), by, F.desc("score"), F.col("doc_id"))
