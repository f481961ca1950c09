"""Queries on run records, read from the raw benchmark exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.records import extract_json, widest_object
from tracewright.plans.registry import Registry
from tracewright.session import shared_folder, table
from tracewright.sources import filed

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

RUNS = """r AS (SELECT series, bench_file, exported_at, line_no, raw::JSON AS o FROM bench_raw WHERE raw IS NOT NULL AND json_valid(raw) AND json_type(raw) = 'OBJECT'),
    v AS (SELECT series, (o->>'run')::BIGINT AS run, arg_max({'f': o->>'n_findings', 'a': o->>'citation_accuracy', 's': o->>'stop_reason', 'e': o->>'counts', 'x': o->>'overrides'}, (exported_at, bench_file, line_no)) AS m FROM r GROUP BY 1, 2),
    runs AS (SELECT series, run, try_cast(m.f AS DOUBLE) AS n_findings, try_cast(m.a AS DOUBLE) AS accuracy, m.s AS stop_reason, m.x AS overrides FROM v)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per run, as the last export has it; rows that are no JSON object are left out."""
    raw = table(spark, d, "bench_raw").withColumn("o", F.try_parse_json("raw")).filter(F.startswith(F.schema_of_variant("o"), F.lit("OBJECT")))
    get = lambda k, t: F.try_variant_get("o", f"$.{k}", t)
    rows = raw.select(
        "series", "bench_file", "exported_at", "line_no", get("run", "bigint").alias("run"), get("n_findings", "string").try_cast("double").alias("n_findings"),
        get("citation_accuracy", "string").try_cast("double").alias("accuracy"), get("stop_reason", "string").alias("stop_reason"),
        get("overrides", "array<string>").alias("overrides"),
    )
    last = F.max_by(F.struct("n_findings", "accuracy", "stop_reason", "overrides"), F.struct("exported_at", "bench_file", "line_no"))
    return rows.groupBy("series", "run").agg(last.alias("r")).select("series", "run", "r.*")


@query(f"WITH {RUNS} SELECT series, run, n_findings, accuracy, stop_reason FROM runs")
def run_records(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).drop("overrides")


@query(f"WITH {RUNS} SELECT series, run, n_findings, accuracy, stop_reason FROM runs")
def runs_copy(spark: SparkSession, d: str) -> DataFrame:
    """Run records written as JSON and read back."""
    path = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
    filed.write_runs(run_records(spark, d), path)
    return filed.read_runs(spark, path, "series string, run bigint, n_findings double, accuracy double, stop_reason string", lines=True)


@query(f"""WITH {RUNS} SELECT series, count(*) AS n_runs, round(avg(n_findings), 6) AS mean, min(n_findings) AS low, max(n_findings) AS high, round(stddev_samp(n_findings), 6) AS stdev,
    round(avg(accuracy), 6) AS accuracy FROM runs GROUP BY series""")
def run_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Findings and accuracy over the runs of a series; no deviation for a single run."""
    return runs(spark, d).groupBy("series").agg(
        F.count("*").alias("n_runs"), F.round(F.avg("n_findings"), 6).alias("mean"), F.min("n_findings").alias("low"), F.max("n_findings").alias("high"),
        F.round(F.stddev_samp("n_findings"), 6).alias("stdev"), F.round(F.avg("accuracy"), 6).alias("accuracy"),
    )


@query(f"WITH {RUNS} SELECT coalesce(stop_reason, 'none') AS stop_reason, count(*) AS n, count(accuracy) AS n_scored FROM runs GROUP BY 1")
def stop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy(F.coalesce("stop_reason", F.lit("none")).alias("stop_reason")).agg(F.count("*").alias("n"), F.count("accuracy").alias("n_scored"))


@query(f"WITH {RUNS} SELECT series, arg_max(run, (n_findings, -run)) AS run, max(n_findings) AS n_findings FROM runs WHERE n_findings IS NOT NULL GROUP BY series")
def best_run(spark: SparkSession, d: str) -> DataFrame:
    """The first run of each series with the most findings."""
    r = runs(spark, d).filter("n_findings IS NOT NULL")
    return r.groupBy("series").agg(F.max_by("run", F.struct("n_findings", -F.col("run"))).alias("run"), F.max("n_findings").alias("n_findings"))


@query(f"""WITH {RUNS}, x AS (SELECT series, run, unnest(from_json(overrides, '["VARCHAR"]')) AS stage FROM runs WHERE overrides IS NOT NULL AND json_type(overrides) = 'ARRAY')
    SELECT stage, count(*) AS n, count(DISTINCT (series, run)) AS n_runs FROM x GROUP BY stage""")
def override_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each stage was put first, and in how many runs."""
    x = runs(spark, d).select("series", "run", F.explode("overrides").alias("stage"))
    return x.groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("series", "run").alias("n_runs"))


@query()
def repaired_records(spark: SparkSession, d: str) -> DataFrame:
    """Per export, how many rows hold a JSON object as they are and after repair."""
    r = table(spark, d, "bench_raw").select("bench_file", "raw", extract_json(F.col("raw")).alias("fixed"))
    return r.groupBy("bench_file").agg(
        F.count("*").alias("n"), F.count(F.try_parse_json("raw")).alias("n_valid"), F.count("fixed").alias("n_repaired")
    )


@query("""SELECT bench_file, count(*) AS n, count(*) FILTER (WHERE json_valid(regexp_extract(raw, '(?s)\\{.*\\}'))) AS n_widest FROM bench_raw GROUP BY 1""")
def widest_records(spark: SparkSession, d: str) -> DataFrame:
    """Per export, how many rows hold JSON between their first and their last brace."""
    return table(spark, d, "bench_raw").groupBy("bench_file").agg(F.count("*").alias("n"), F.count(widest_object(F.col("raw"))).alias("n_widest"))


@query("""SELECT case_id, count(*) FILTER (WHERE survives) AS hits, count(*) FILTER (WHERE survives IS NULL) AS partial, count(*) AS n,
    (count(*) FILTER (WHERE survives) + 0.5::DOUBLE * count(*) FILTER (WHERE survives IS NULL)) / count(*) AS recovery,
    count(*) FILTER (WHERE coalesce(unsupported_leap, false)) AS unsupported FROM (SELECT DISTINCT * FROM verdicts) GROUP BY case_id""")
def recovery_score(spark: SparkSession, d: str) -> DataFrame:
    """Hits and half of the open ones over all verdicts of a case, and the unsupported among them."""
    v = table(spark, d, "verdicts").distinct()
    hit, half = F.count_if(F.coalesce("survives", F.lit(False))), F.count_if(F.col("survives").isNull())
    return v.groupBy("case_id").agg(
        hit.alias("hits"), half.alias("partial"), F.count("*").alias("n"), ((hit + half * 0.5) / F.count("*")).alias("recovery"),
        F.count_if(F.coalesce("unsupported_leap", F.lit(False))).alias("unsupported"),
    )


FLAGS = ["timing difference", "shared address", "auditor note", "goes further", "different periods"]
DENIALS = ["nothing shows", "no record", "cannot be"]
_F = "[" + ", ".join(f"'{x}'" for x in FLAGS) + "]"
_D = "[" + ", ".join(f"'{x}'" for x in DENIALS) + "]"


@query(f"""WITH v AS (SELECT DISTINCT verdict_id, case_id, lower(attack) AS a FROM verdicts WHERE attack IS NOT NULL),
    p AS (SELECT *, len(list_filter({_F}, lambda f: contains(a, f))) AS hits, len(list_filter({_D}, lambda f: contains(a, f))) AS denials FROM v)
    SELECT case_id, sum(hits)::BIGINT AS flag_hits, count(*) FILTER (WHERE denials > 0) AS denials, count(*) FILTER (WHERE hits > 0 AND denials = 0) AS affirming FROM p GROUP BY case_id""")
def probe_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flag phrases and denials in the attacks on a case."""
    v = table(spark, d, "verdicts").filter("attack IS NOT NULL").select("verdict_id", "case_id", F.lower("attack").alias("a")).distinct()
    n = lambda xs: F.size(F.filter(F.array(*map(F.lit, xs)), lambda f: F.contains("a", f)))
    p = v.select("case_id", n(FLAGS).alias("hits"), n(DENIALS).alias("denials"))
    return p.groupBy("case_id").agg(
        F.sum("hits").alias("flag_hits"), F.count_if(F.col("denials") > 0).alias("denials"), F.count_if((F.col("hits") > 0) & (F.col("denials") == 0)).alias("affirming")
    )
