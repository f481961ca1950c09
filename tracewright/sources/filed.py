"""Filed figures and run records as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = "struct<start:string,end:string,val:double,form:string,fp:string>"
FACTS = f"cik string, entityName string, facts map<string,map<string,struct<units:map<string,array<{FACT}>>>>>"
CONCEPT = f"cik string, tag string, units map<string,array<{FACT}>>"


def _rows(df: DataFrame, unit: str) -> DataFrame:
    """Facts of one unit with real dates; `seq` keeps the order of the file, later filings last."""
    return df.select("entity", "tag", F.posexplode(F.col("units")[unit]).alias("seq", "f")).select(
        "entity", "tag", F.to_date("f.start").alias("start"), F.to_date("f.end").alias("end"), "f.val", "f.form", "f.fp", "seq"
    )


def read_company_facts(spark: SparkSession, path: str, taxonomy: str = "us-gaap", unit: str = "USD", lines: bool = False) -> DataFrame:
    """(entity, tag, start, end, val, form, fp, seq) of company-facts files, one object a file or with `lines` one a line."""
    raw = spark.read.schema(FACTS).option("multiLine", not lines).json(path)
    tags = raw.select(F.coalesce("entityName", "cik").alias("entity"), F.explode(F.col("facts")[taxonomy]).alias("tag", "t"))
    return _rows(tags.select("entity", "tag", F.col("t.units").alias("units")), unit)


def write_company_facts(facts: DataFrame, path: str, taxonomy: str = "us-gaap", unit: str = "USD") -> None:
    """Facts (entity, tag, start, end, val, form, fp, seq) as one company-facts object a line."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    fact = F.struct("seq", day("start"), day("end"), F.col("val").cast("double").alias("val"), "form", "fp")
    tags = facts.groupBy("entity", "tag").agg(F.transform(F.sort_array(F.collect_list(fact)), lambda f: f.dropFields("seq")).alias("rows"))
    units = F.struct(F.create_map(F.lit(unit), F.col("rows")).alias("units"))
    companies = tags.groupBy(F.col("entity").cast("string").alias("cik")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("tag"), units))).alias("tags"))
    companies.select("cik", F.col("cik").alias("entityName"), F.create_map(F.lit(taxonomy), F.col("tags")).alias("facts")).write.mode("overwrite").json(path)


def read_concept(spark: SparkSession, path: str, unit: str = "USD") -> DataFrame:
    """The same for files of a single concept."""
    return _rows(spark.read.schema(CONCEPT).option("multiLine", True).json(path).withColumnRenamed("cik", "entity"), unit)


def read_runs(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Run or score records, one JSON document a file or with `lines` one a line; the schema is inferred unless given."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Run records, replaced as a whole."""
    runs.write.mode("overwrite").json(path)


# Month counts in words.
_MONTHS = {"three": 3, "six": 6, "nine": 9, "twelve": 12}


def period_window(phrase: Column) -> Column:
    """`six-month period ended October 31, 2023` as (end DATE, months INT); NULL where either is missing."""
    low = F.lower(phrase)
    months = F.lit(None).cast("int")
    for word, n in [("year", 12), *reversed(_MONTHS.items())]:
        months = F.when(F.contains(low, F.lit(word)), n).otherwise(months)
    end = F.try_to_date(F.regexp_extract(phrase, r"ended ([A-Z][a-z]+ \d{1,2}, \d{4})", 1), "MMMM d, yyyy")
    return F.when(end.isNotNull() & months.isNotNull(), F.struct(end.alias("end"), months.alias("months")))
