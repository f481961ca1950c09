"""Sources and sinks of a document corpus: folders of texts, manifests, HTML pages, JSON records."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import leading_date

MANIFEST = "company string, cik string, documents array<struct<file:string,form:string,filed:string,url:string,chars:bigint>>"


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of every .txt file of a folder; bytes that are no UTF-8 become U+FFFD."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    )


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per listed filing of JSON manifests: one object a file, or with `lines` one a line."""
    return entries(spark.read.schema(MANIFEST).option("multiLine", not lines).json(path))


def entries(manifests: DataFrame) -> DataFrame:
    """Manifest rows exploded to (company, cik, ..., file, form, filed, url, chars)."""
    keep = [c for c in manifests.columns if c != "documents"]
    return manifests.select(*keep, F.explode("documents").alias("d")).select(*keep, "d.*")


def write_manifest(listed: DataFrame, path: str) -> None:
    """Filings (company, cik, file, form, filed, url, chars) as one JSON row per company."""
    doc = F.struct("file", "form", "filed", "url", "chars")
    listed.groupBy("company", "cik").agg(F.sort_array(F.collect_list(doc)).alias("documents")).write.mode("overwrite").json(path)


def catalogue(rows: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays of a filing catalogue as rows."""
    keep = [c for c in rows.columns if c not in arrays]
    return rows.select(*keep, F.inline(F.arrays_zip(*arrays)))


def file_name(filed: Column, form: Column, accession: Column) -> Column:
    """`date_form_last6.txt`, the form without slashes and blanks."""
    return F.concat(filed, F.lit("_"), F.regexp_replace(form, "[/ ]", ""), F.lit("_"), F.right(accession, F.lit(6)), F.lit(".txt"))


def clean_form(form: Column) -> Column:
    """Spellings of a form brought to one: upper case, trimmed, hyphen after the leading digits or S."""
    f = F.upper(F.trim(form))
    f = F.regexp_replace(f, r"^(NT )?(8|10)([A-Z])", "$1$2-$3")
    return F.regexp_replace(f, r"^S(\d)", "S-$1")


def headers(docs: DataFrame) -> DataFrame:
    """SOURCE, FORM, FILED and COMPANY lines that open a text, and the date in the file name."""
    line = lambda name: F.nullif(F.trim(F.regexp_extract("text", rf"^(?:[A-Z]+: [^\r\n]*\r?\n)*?{name}: ([^\r\n]*)", 1)), F.lit(""))
    return docs.select(
        "doc_id", "file", leading_date(F.col("file")).alias("file_date"),
        *[line(n).alias(n.lower()) for n in ("SOURCE", "FORM", "FILED", "COMPANY")],
    )


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.skip, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def page_text(page: str | None) -> str | None:
    """Visible text of an HTML page: one text node a line, blank runs and blank lines collapsed."""
    if page is None:
        return None
    p = _Text()
    p.feed(page)
    p.close()
    text = "\n".join(p.parts)
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(page_text, na_action="ignore")
