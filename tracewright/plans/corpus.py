"""Queries on the corpus and its manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import squeeze
from tracewright.plans.registry import Registry, squeeze_sql
from tracewright.session import shared_folder, table, texts
from tracewright.sources import corpus

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

ENTRIES = "(SELECT company, cik, fetched_at, unnest(documents) AS d FROM manifests)"
CLEAN = r"regexp_replace(regexp_replace(upper(trim({})), '^(NT )?(8|10)([A-Z])', '\1\2-\3'), '^S(\d)', 'S-\1')"


@query("""SELECT lang, count(*) AS n_docs, sum(coalesce(length(text), 0))::BIGINT AS n_chars,
    sum(coalesce(length(text), 0) // 4)::BIGINT AS n_tokens, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_empty
    FROM documents GROUP BY lang""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents, characters and a token estimate (four characters each) per language."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    return texts(spark, d).groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(chars).cast("long").alias("n_chars"),
        F.sum(F.floor(chars / 4)).cast("long").alias("n_tokens"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_empty"),
    )


@query(f"""SELECT {CLEAN.format('d.form')} AS form, count(*) AS n_entries, count(DISTINCT d.file) AS n_files,
    count(*) FILTER (WHERE d.filed IS NULL) AS n_undated FROM {ENTRIES} GROUP BY 1""")
def form_tally(spark: SparkSession, d: str) -> DataFrame:
    """Listed filings per form, its spellings brought to one."""
    return (
        corpus.entries(table(spark, d, "manifests")).groupBy(corpus.clean_form(F.col("form")).alias("form"))
        .agg(F.count("*").alias("n_entries"), F.count_distinct("file").alias("n_files"), F.count_if(F.col("filed").isNull()).alias("n_undated"))
    )


@query(f"""SELECT d.file AS file, arg_min(d.form, (fetched_at, cik)) FILTER (WHERE d.form IS NOT NULL) AS form,
    min(fetched_at) IS NOT NULL AS listed, count(DISTINCT cik) AS n_issuers,
    max(d.chars) FILTER (WHERE d.chars > 0) AS chars FROM {ENTRIES} WHERE d.file IS NOT NULL GROUP BY d.file""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """First listing wins per file; gaps in it are filled from later listings."""
    order = F.when(F.col("form").isNotNull(), F.struct("fetched_at", "cik"))
    return (
        corpus.entries(table(spark, d, "manifests")).filter("file IS NOT NULL").groupBy("file")
        .agg(
            F.min_by("form", order).alias("form"), F.min("fetched_at").isNotNull().alias("listed"),
            F.count_distinct("cik").alias("n_issuers"), F.max(F.when(F.col("chars") > 0, F.col("chars"))).alias("chars"),
        )
    )


@query(f"""WITH l AS (SELECT DISTINCT d.file AS file FROM {ENTRIES} WHERE d.file IS NOT NULL)
    SELECT 'not in corpus' AS what, file FROM l ANTI JOIN documents USING (file)
    UNION ALL SELECT 'not listed' AS what, file FROM documents ANTI JOIN l USING (file)""")
def unmatched_files(spark: SparkSession, d: str) -> DataFrame:
    """Listed files without a document and documents no manifest lists."""
    listed = corpus.entries(table(spark, d, "manifests")).filter("file IS NOT NULL").select("file").distinct()
    docs = texts(spark, d).select("file")
    return (
        listed.join(docs, "file", "left_anti").select(F.lit("not in corpus").alias("what"), "file")
        .unionByName(docs.join(listed, "file", "left_anti").select(F.lit("not listed").alias("what"), "file"))
    )


def _header(name: str) -> str:
    return f"nullif(trim(regexp_extract(text, '^(?:[A-Z]+: [^\\r\\n]*\\r?\\n)*?{name}: ([^\\r\\n]*)', 1)), '') AS {name.lower()}"


@query(f"""SELECT doc_id, file, regexp_extract(file, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS file_date,
    {', '.join(map(_header, ('SOURCE', 'FORM', 'FILED', 'COMPANY')))} FROM documents""")
def filing_headers(spark: SparkSession, d: str) -> DataFrame:
    return corpus.headers(texts(spark, d))


@query(f"""WITH e AS (SELECT DISTINCT d.file AS file, d.filed AS filed, {CLEAN.format('d.form')} AS form, d.url AS url FROM {ENTRIES})
    SELECT file, filed || '_' || regexp_replace(form, '[/ ]', '', 'g') || '_' || right(regexp_extract(url, '/(\\d+)/[^/]*$', 1), 6) || '.txt' AS built
    FROM e WHERE filed IS NOT NULL AND form IS NOT NULL AND url IS NOT NULL""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """The file name a sink gives each filing, beside the listed one."""
    e = corpus.entries(table(spark, d, "manifests")).select("file", "filed", corpus.clean_form(F.col("form")).alias("form"), "url").distinct()
    accession = F.regexp_extract("url", r"/(\d+)/[^/]*$", 1)
    return e.filter("filed IS NOT NULL AND form IS NOT NULL AND url IS NOT NULL").select(
        "file", corpus.file_name(F.col("filed"), F.col("form"), accession).alias("built")
    )


BLANK_LINE = r"\n[ \t\x{a0}\r]*\n"


PARAGRAPH = squeeze_sql(f"unnest(regexp_split_to_array(text, '{BLANK_LINE}'))")


@query(f"""WITH p AS (SELECT doc_id, {PARAGRAPH} AS p FROM documents)
    SELECT doc_id, count(*) AS n_paragraphs, max(length(p))::INT AS longest FROM p WHERE p <> '' AND length(p) <= 2500 GROUP BY doc_id""")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs between blank lines, empty and very long ones left out."""
    p = texts(spark, d).select("doc_id", F.explode(F.split("text", BLANK_LINE, -1)).alias("p"))
    return (
        p.select("doc_id", squeeze(F.col("p")).alias("p")).filter("p <> '' AND length(p) <= 2500")
        .groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max(F.length("p")).alias("longest"))
    )


@query(f"""WITH e AS (SELECT DISTINCT d.file AS file, {CLEAN.format('d.form')} AS form FROM {ENTRIES} WHERE d.form IS NOT NULL),
    f AS (SELECT file, min(form) AS form FROM e GROUP BY file)
    SELECT source, coalesce(form, 'unlisted') AS form, count(*) AS n_docs FROM documents LEFT JOIN f USING (file) GROUP BY ALL""")
def agent_forms(spark: SparkSession, d: str) -> DataFrame:
    """Documents per filing agent and form."""
    f = (
        corpus.entries(table(spark, d, "manifests")).filter("form IS NOT NULL")
        .groupBy("file").agg(F.min(corpus.clean_form(F.col("form"))).alias("form"))
    )
    return (
        texts(spark, d).select("source", "file").join(f, "file", "left")
        .groupBy("source", F.coalesce("form", F.lit("unlisted")).alias("form")).agg(F.count("*").alias("n_docs"))
    )


@query("""SELECT doc_id, file FROM documents WHERE regexp_matches(lower(file), 'nt10-k|key|truth')""")
def forbidden_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose file name holds a forbidden word, as of an answer key."""
    return texts(spark, d).filter(F.rlike(F.lower("file"), F.lit("nt10-k|key|truth"))).select("doc_id", "file")


FORMS = ("8-K", "10-K", "10-Q", "S-1")


@query(f"""WITH e AS (SELECT DISTINCT d.file AS file, {CLEAN.format('d.form')} AS form, try_cast(d.filed AS DATE) AS filed FROM {ENTRIES})
    SELECT doc_id, file, form, filed::VARCHAR AS filed FROM e JOIN documents USING (file)
    WHERE form IN ('8-K', '10-K', '10-Q', 'S-1') AND filed BETWEEN DATE '2018-01-01' AND DATE '2022-12-31' AND length({squeeze_sql('text')}) > 0""")
def usable_filings(spark: SparkSession, d: str) -> DataFrame:
    """Listed filings of some forms and years that have a text."""
    e = corpus.entries(table(spark, d, "manifests")).select("file", corpus.clean_form(F.col("form")).alias("form"), F.col("filed").try_cast("date").alias("filed")).distinct()
    return usable(e, texts(spark, d), FORMS, "2018-01-01", "2022-12-31").select("doc_id", "file", "form", F.col("filed").cast("string"))


def usable(listed: DataFrame, docs: DataFrame, forms: tuple[str, ...], first: str, last: str) -> DataFrame:
    """Listed filings of the given forms between two days whose document is not empty."""
    some = listed.filter(F.col("form").isin(*forms) & F.col("filed").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return docs.filter(F.length(squeeze(F.col("text"))) > 0).select("doc_id", "file").join(some, "file")


@query(f"""SELECT doc_id, len(string_split(flat, ' | '))::INT AS n_blocks, length(flat)::INT AS n_chars
    FROM (SELECT doc_id, {squeeze_sql(f"regexp_replace(text, '{BLANK_LINE}', ' | ', 'g')")} AS flat FROM documents WHERE text IS NOT NULL)""")
def flat_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Texts made flat with a bar where a blank line stood, so that nothing is read across it."""
    flat = squeeze(F.regexp_replace("text", BLANK_LINE, " | "))
    return texts(spark, d).filter("text IS NOT NULL").select("doc_id", F.size(F.split(flat, r" \| ", -1)).alias("n_blocks"), F.length(flat).alias("n_chars"))


@query(f"SELECT company, cik, d.file AS file, d.form AS form, d.filed AS filed, d.url AS url, d.chars AS chars FROM {ENTRIES}")
def manifest_copy(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries written as JSON, one object a company, and read back."""
    path = f"{shared_folder(spark)}/manifests/{uuid.uuid4().hex}"
    corpus.write_manifest(corpus.entries(table(spark, d, "manifests")), path)
    return corpus.read_manifest(spark, path, lines=True)
