"""Queries that check quotes and named parties against the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import extract, verify
from tracewright.plans.registry import Registry, compared_sql, squeeze_sql
from tracewright.session import table, texts

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

EXACT = f"""c AS (SELECT DISTINCT cite_id, evidence_id, regexp_extract(coalesce(file, ''), '[^/]*$') AS base, coalesce({compared_sql('quote')}, '') AS q FROM citations),
    t AS (SELECT file AS base, coalesce({compared_sql('text')}, '') AS t, true AS known FROM documents),
    x AS (SELECT cite_id, evidence_id, CASE WHEN known IS NULL THEN 'BAD_FILE' WHEN q = '' THEN 'NOT_FOUND' WHEN contains(t, q) THEN 'EXACT' ELSE 'RESIDUE' END AS found
    FROM c LEFT JOIN t USING (base))"""


def _cites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations").distinct()


@query(f"WITH {EXACT} SELECT * FROM x")
def citation_exact(spark: SparkSession, d: str) -> DataFrame:
    """Each citation: its file is unknown, its quote is empty, stands in the text, or is left for fuzzy comparison."""
    return verify.exact(_cites(spark, d), texts(spark, d))


@query(f"""WITH {EXACT} SELECT count(*) AS checked, count(*) FILTER (WHERE found = 'EXACT') AS exact, count(*) FILTER (WHERE found = 'RESIDUE') AS residue,
    count(*) FILTER (WHERE found = 'BAD_FILE') AS bad_file, count(*) FILTER (WHERE found = 'NOT_FOUND') AS not_found FROM x""")
def citation_exact_tally(spark: SparkSession, d: str) -> DataFrame:
    """What the literal stage decides and leaves open."""
    found = verify.exact(_cites(spark, d), texts(spark, d))
    return found.agg(F.count("*").alias("checked"), *[F.count_if(F.col("found") == v).alias(v.lower()) for v in ("EXACT", "RESIDUE", "BAD_FILE", "NOT_FOUND")])


@query()
def citation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts, fuzzy ones included, and the share that holds."""
    return verify.accuracy(verify.checked(table(spark, d, "citations"), texts(spark, d)))


@query()
def citation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts with fuzzy comparison of what is not found exactly."""
    return verify.checked(table(spark, d, "citations"), texts(spark, d))


@query()
def citation_verdicts_scorer(spark: SparkSession, d: str) -> DataFrame:
    """The scorer's variant: windows every 500 characters."""
    return verify.checked(table(spark, d, "citations"), texts(spark, d), stride=500)


@query(f"""WITH {EXACT}, p AS (SELECT evidence_id, count(*) FILTER (WHERE found = 'EXACT') AS kept, count(*) FILTER (WHERE found <> 'EXACT') AS quarantined
    FROM x WHERE evidence_id IS NOT NULL GROUP BY 1)
    SELECT id, CASE WHEN kept = 0 AND quarantined > 0 AND tier = 'DIRECT' THEN 'INFERRED' ELSE tier END AS tier, coalesce(kept, 0) AS kept,
    coalesce(quarantined, 0) AS quarantined, CASE WHEN kept = 0 AND quarantined > 0 AND tier = 'DIRECT' THEN 'unverifiable_citation' END AS integrity_flag
    FROM evidence LEFT JOIN p ON id = evidence_id""")
def evidence_screen_exact(spark: SparkSession, d: str) -> DataFrame:
    """Evidence screened by literal quotes alone."""
    return verify.screened(table(spark, d, "evidence"), verify.exact(_cites(spark, d), texts(spark, d)))


@query()
def evidence_screen(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with its citations kept (exact or fuzzy) and quarantined; DIRECT evidence without a kept one becomes INFERRED."""
    return verify.screened(table(spark, d, "evidence"), verify.checked(table(spark, d, "citations"), texts(spark, d)))


@query(f"""WITH {EXACT} SELECT coalesce(verdict, 'none') AS recorded, found, count(*) AS n
    FROM x JOIN (SELECT DISTINCT cite_id, verdict FROM citations) USING (cite_id) GROUP BY ALL""")
def verdict_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Recorded verdicts against those found."""
    cites = _cites(spark, d)
    return (
        verify.exact(cites, texts(spark, d)).join(cites.select("cite_id", "verdict").distinct(), "cite_id")
        .groupBy(F.coalesce("verdict", F.lit("none")).alias("recorded"), "found").agg(F.count("*").alias("n"))
    )


@query(f"""WITH c AS (SELECT DISTINCT id, claim FROM hypotheses), r AS (
    SELECT id, claim, unnest(list_distinct(regexp_extract_all({squeeze_sql('claim')}, '{extract.portable(extract.NAME)}'))) AS referent FROM c),
    m AS (SELECT DISTINCT file, unnest(list_distinct(regexp_extract_all({squeeze_sql('text')}, '{extract.portable(extract.NAME)}'))) AS referent FROM documents),
    h AS (SELECT referent, count(*) AS n_files, list_sort(list(file))[:4] AS found_in FROM m GROUP BY referent)
    SELECT id, referent, CASE WHEN instr({squeeze_sql('claim')}, referent) < CASE WHEN regexp_matches({squeeze_sql('claim')}, '(?i)\\b{extract.QUALIFIER}\\b')
    THEN length(regexp_extract({squeeze_sql('claim')}, '(?i)^(.*?)\\b{extract.QUALIFIER}\\b', 1)) + 1 ELSE length({squeeze_sql('claim')}) + 1 END THEN 'HARD' ELSE 'SOFT' END AS severity,
    coalesce(n_files, 0) AS n_files, array_to_string(coalesce(found_in, []), ' ') AS found_in FROM r LEFT JOIN h USING (referent)""")
def claim_referents(spark: SparkSession, d: str) -> DataFrame:
    """Parties a claim names, whether in its head or behind a qualifier, and the files that name them."""
    return extract.referents(table(spark, d, "hypotheses"), texts(spark, d))
