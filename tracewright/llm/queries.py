"""Queries of the numbered problems on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import leaks, lines, pieces, spans, textform, tokens
from tracewright.functions.text import WS_CLASS
from tracewright.plans.registry import compared_sql
from tracewright.session import table, texts


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.found(table(spark, d, "citations"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(table(spark, d, "citations"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.found(texts(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(texts(spark, d))


def p2_filings(spark: SparkSession, d: str) -> DataFrame:
    return pieces.filings(table(spark, d, "manifests"), texts(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.found(texts(spark, d))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.clean(texts(spark, d))


def p4_clean_near(spark: SparkSession, d: str) -> DataFrame:
    return lines.clean(texts(spark, d), near=True)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return lines.report(texts(spark, d), table(spark, d, "manifests"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(texts(spark, d))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(texts(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(texts(spark, d), table(spark, d, "eval_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.spans(texts(spark, d), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.item_report(texts(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.look_alikes(texts(spark, d))


def p8_scripts(spark: SparkSession, d: str) -> DataFrame:
    return textform.confusables(texts(spark, d))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return textform.forms(texts(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_shares, p2_found, p2_pieces, p2_filings, p4_found, p4_clean, p4_clean_near, p4_report, p6_ids, p6_counts,
        p7_found, p7_spans, p7_items, p8_found, p8_scripts, p8_forms,
    )
}

_RUNS = f"""q AS (SELECT cite_id, min({{'f': file, 'q': quote}}) AS r FROM citations WHERE cite_id IS NOT NULL AND file IS NOT NULL AND length(quote) >= {spans.AT_LEAST} GROUP BY 1),
    runs AS (SELECT cite_id, r.f AS file, i, substring(r.q, i, {spans.AT_LEAST}) AS run FROM (SELECT *, unnest(range(1, length(r.q) - {spans.AT_LEAST - 2})) AS i FROM q))"""
_LINES = f"""l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
    c AS (SELECT doc_id, source, line_no::INT AS line_no, {compared_sql('line')} AS form FROM l),
    often AS (SELECT source, form FROM c WHERE length(form) >= {lines.MIN_CHARS} GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
    found AS (SELECT doc_id, line_no FROM c SEMI JOIN often USING (source, form))"""
SQL = {
    "p1_found": f"""WITH {_RUNS}, c AS (SELECT DISTINCT cite_id, file, run FROM runs)
        SELECT DISTINCT a.cite_id AS cite_id_a, b.cite_id AS cite_id_b FROM c a JOIN c b ON a.run = b.run AND a.file <> b.file AND a.cite_id < b.cite_id""",
    "p1_shares": f"""WITH {_RUNS}, s AS (SELECT run FROM runs GROUP BY run HAVING count(DISTINCT file) > 1),
        p AS (SELECT cite_id, unnest(range(i, i + {spans.AT_LEAST})) AS place FROM runs SEMI JOIN s USING (run)), n AS (SELECT cite_id, count(DISTINCT place) AS shared FROM p GROUP BY 1)
        SELECT cite_id, max(length(quote))::INT AS chars, coalesce(any_value(shared), 0) AS shared FROM citations LEFT JOIN n USING (cite_id) WHERE cite_id IS NOT NULL GROUP BY 1""",
    "p2_found": f"""SELECT doc_id, CASE WHEN list_max(list_transform(string_split_regex(text, '{WS_CLASS}'), lambda x: length(x))) > {pieces.LIMIT} THEN 'forced' ELSE 'natural' END AS cut
        FROM documents WHERE length(text) > {pieces.LIMIT}""",
    "p4_found": f"WITH {_LINES} SELECT doc_id, line_no FROM found",
    "p4_clean": f"""WITH {_LINES}, g AS (SELECT doc_id, list(line_no) AS gone FROM found GROUP BY 1)
        SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text,
        coalesce(len(gone), 0)::INT AS removed FROM documents LEFT JOIN g USING (doc_id)""",
}
