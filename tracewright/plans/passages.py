"""Queries on passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import passages
from tracewright.plans.registry import Registry
from tracewright.session import table, texts

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

TERMS = ["settled", "warrants", "credit note", "portal", "$6,400", "refund", "llc"]
LONG = [t for t in TERMS if len(t) >= passages.SHORTEST]
BUDGET, WINDOW, HEAD = 4000, 300, 200
_T = "[" + ", ".join(f"'{t}'" for t in LONG) + "]"

SCORE = "coalesce(" + ", 0) + coalesce(".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in LONG) + ", 0)"
SCORES = f"s AS (SELECT doc_id, source, {SCORE} AS score FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM s)"


@query(f"WITH {SCORES} SELECT doc_id, source, score::BIGINT AS score, rn::INT AS rn FROM r WHERE rn <= 8 AND score > 0")
def doc_relevance_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight most relevant documents of each source."""
    return passages.best(texts(spark, d), TERMS, "source", 8).filter("score > 0")


@query(f"WITH {SCORES} SELECT doc_id, source, rn <= 8 AS top FROM r WHERE rn <= 8 OR (rn - 9) % 7 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """The top documents and every seventh of the rest."""
    r = passages.scored(texts(spark, d), TERMS, "source")
    return r.filter("rn <= 8 OR (rn - 9) % 7 = 0").select("doc_id", "source", (F.col("rn") <= 8).alias("top"))


@query(r"""WITH h AS (SELECT id, coalesce(claim, '') AS claim FROM hypotheses GROUP BY ALL),
    t AS (SELECT id, list_distinct(regexp_extract_all(claim, '\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b')) AS f,
    list_filter(list_distinct(list_transform(regexp_extract_all(claim, '[A-Za-z][A-Za-z0-9]{3,}'), lambda x: lower(x))), lambda x: NOT list_contains(""" + str(passages.STOP) + r""", x)) AS w FROM h)
    SELECT id, len(f)::INT AS n_figures, len(w)::INT AS n_words, array_to_string(list_sort(f), ' ') AS figures, array_to_string(list_sort(w), ' ') AS words FROM t""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms each claim selects by."""
    h = table(spark, d, "hypotheses").select("id", F.coalesce("claim", F.lit("")).alias("claim")).distinct()
    t = h.select("id", passages.query_terms(F.col("claim")).alias("t"))
    figure = lambda x: F.rlike(x, F.lit(r"^\d"))
    f, w = F.filter("t", figure), F.filter("t", lambda x: ~figure(x))
    return t.select(
        "id", F.size(f).alias("n_figures"), F.size(w).alias("n_words"), F.array_join(F.sort_array(f), " ").alias("figures"), F.array_join(F.sort_array(w), " ").alias("words")
    )


SPANS = f"""t AS (SELECT doc_id, length(text) AS n_chars, lower(text) AS low, unnest({_T}) AS term FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, n_chars, term, string_split(low, term) AS p FROM t WHERE contains(low, term)),
    s AS (SELECT doc_id, n_chars, term, unnest(list_transform(range(1, least(len(p), 7)), lambda i: i - 1))::INT AS n,
        unnest(list_transform(range(1, least(len(p), 7)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(term)))::INT AS lo FROM p)"""


@query(f"WITH {SPANS} SELECT doc_id, term, n, lo, lo + length(term)::INT AS hi FROM s")
def term_spans(spark: SparkSession, d: str) -> DataFrame:
    """The first six places of each term."""
    return passages.spans(texts(spark, d), TERMS)


WINDOWS = f"""{SPANS}, w AS (SELECT doc_id, greatest(lo - {WINDOW}, 0) AS lo, least(lo + length(term) + {WINDOW}, n_chars) AS hi FROM s),
    g AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM w),
    i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM g),
    m AS (SELECT doc_id, min(lo)::INT AS lo, max(hi)::INT AS hi FROM i GROUP BY doc_id, island),
    win AS (SELECT m.doc_id, m.lo, m.hi, count(*) AS matches FROM m JOIN s ON s.doc_id = m.doc_id AND s.lo >= m.lo AND s.lo < m.hi GROUP BY ALL)"""


@query(f"WITH {WINDOWS} SELECT * FROM win")
def passage_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows around the places of terms, merged where they meet."""
    return passages.windows(texts(spark, d), TERMS, WINDOW)


@query(f"""WITH {WINDOWS}, l AS (SELECT win.* FROM win JOIN documents USING (doc_id) WHERE length(text) > {BUDGET}),
    u AS (SELECT *, {HEAD} + coalesce(sum(hi - lo) OVER (PARTITION BY doc_id ORDER BY matches DESC, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l)
    SELECT doc_id, lo::INT AS lo, (lo + least(hi - lo, {BUDGET} - used))::INT AS hi FROM u WHERE least(hi - lo, {BUDGET} - used) > 0
    UNION ALL SELECT DISTINCT doc_id, 0, {HEAD} FROM l""")
def passage_fill(spark: SparkSession, d: str) -> DataFrame:
    """Head and densest windows of long texts within the budget."""
    return passages.filled(texts(spark, d), TERMS, BUDGET, WINDOW, HEAD)


@query(f"""WITH f AS ({SQL['passage_fill']}),
    g AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f),
    i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM g),
    m AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY doc_id, island),
    x AS (SELECT *, lo - coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS gap FROM m),
    p AS (SELECT doc_id, string_agg(CASE WHEN gap > 0 THEN chr(10) || '[... ' || format('{{:,}}', gap) || ' characters omitted ...]' || chr(10) ELSE '' END || substring(text, lo + 1, hi - lo), '' ORDER BY lo) AS body,
        any_value(length(text)) - max(hi) AS rest FROM x JOIN documents USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length(text) <= {BUDGET} THEN 'full' WHEN body IS NULL THEN 'head' ELSE 'windows' END AS mode,
    CASE WHEN length(text) <= {BUDGET} THEN text WHEN body IS NULL THEN left(text, {BUDGET})
    ELSE body || CASE WHEN rest > 0 THEN chr(10) || '[... ' || format('{{:,}}', rest) || ' characters omitted ...]' || chr(10) ELSE '' END END AS excerpt
    FROM documents LEFT JOIN p USING (doc_id) WHERE text IS NOT NULL""")
def passage_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The excerpt of every text."""
    return passages.excerpts(texts(spark, d), TERMS, BUDGET, WINDOW, HEAD)
