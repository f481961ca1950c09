"""Queries on the event log and on evidence as it was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import events, verify
from tracewright.operators.ranks import ranked
from tracewright.plans.registry import Registry
from tracewright.session import stored, table, texts
from tracewright.streaming import log

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


COUNTS = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
STATE = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id"


@query(COUNTS)
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return log.counts(_events(spark, d))


@query(COUNTS)
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same counts, kept by a stream."""
    schema = table(spark, d, "events").schema
    return log.drain(log.counts(log.tail(spark, f"{d}/events.parquet", schema)), "complete")


@query(STATE)
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user."""
    return events.latest(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_id", "event_type").withColumnRenamed("n_versions", "n")


@query(STATE)
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The same state, folded by a stream."""
    schema = table(spark, d, "events").schema
    return log.drain(log.state(log.tail(spark, f"{d}/events.parquet", schema)), "complete")


@query("""SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts that the watermark has made final.

    What is there is one batch, so nothing of it is late, in whatever files and order it lies.
    """
    schema = table(spark, d, "events").schema
    counts = log.drain(log.windowed(log.tail(spark, f"{d}/events.parquet", schema)), "append")
    return counts.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("""SELECT event_id, event_type, user_id FROM events
    WHERE ts > TIMESTAMP '2024-01-20 00:00:00' OR (ts = TIMESTAMP '2024-01-20 00:00:00' AND event_id > 0)""")
def events_since(spark: SparkSession, d: str) -> DataFrame:
    """Events behind a cursor."""
    return events.since(_events(spark, d), "2024-01-20 00:00:00", 0).select("event_id", "event_type", "user_id")


@query("SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_value FROM events")
def prior_value(spark: SparkSession, d: str) -> DataFrame:
    return events.previous(_events(spark, d), "user_id", "value")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rn FROM events QUALIFY rn <= 6")
def recent_k(spark: SparkSession, d: str) -> DataFrame:
    """The last six events of each user."""
    return events.top_k(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", 6, F.desc("ts"), F.desc("event_id")).drop("ts")


@query("SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS rn FROM events QUALIFY rn <= 3")
def topk_leads_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three of highest priority per type, first come first on ties."""
    return events.top_k(_events(spark, d).select("event_type", "event_id", "value"), "event_type", 3, F.desc("value"), F.col("event_id"))


@query("SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS rn FROM events QUALIFY rn > 3")
def dropped_leads(spark: SparkSession, d: str) -> DataFrame:
    """What the three of highest priority per type leave out."""
    e = _events(spark, d).select("event_type", "event_id", "value")
    return ranked(e, "event_type", F.desc("value"), F.col("event_id")).filter("rn > 3")


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def priority_pop(spark: SparkSession, d: str) -> DataFrame:
    """The next 25 of the queue, by priority, then first come first."""
    return _events(spark, d).select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("""WITH w AS (SELECT event_id, user_id, event_type, count(*) OVER r AS seen, count(*) FILTER (WHERE event_type = 'error') OVER r AS of_kind FROM events
    WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, user_id, seen, of_kind FROM w WHERE of_kind * 100 > seen * 45""")
def running_share(spark: SparkSession, d: str) -> DataFrame:
    """Events at which errors are more than 45 % of what the user did so far."""
    return events.running_share(_events(spark, d), "user_id", F.col("event_type") == "error").filter("of_kind * 100 > seen * 45")


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total, count(DISTINCT props->>'k') AS n_values FROM events GROUP BY event_type")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    """A field of the JSON payload, per type."""
    k = F.get_json_object("props", "$.k")
    return _events(spark, d).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(k.cast("long")).alias("total"), F.count_distinct(k).alias("n_values")
    )


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOURS) AS "end", count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user (an extension: the log knows none)."""
    return events.sessions(_events(spark, d), "user_id").withColumn("value", F.col("value").cast("double"))


@query("""SELECT id, arg_max(tier, (recorded_at, tier)) FILTER (WHERE recorded_at = m) AS tier, epoch_us(m) AS recorded, count(*) AS n_versions
    FROM (SELECT *, max(recorded_at) OVER (PARTITION BY id) AS m FROM evidence) GROUP BY id, m""")
def evidence_latest(spark: SparkSession, d: str) -> DataFrame:
    """Evidence as its last delivery has it."""
    e = table(spark, d, "evidence")
    rows = e.groupBy("id").agg(
        F.max(F.struct("recorded_at", F.coalesce("tier", F.lit("")).alias("t"))).alias("m"), F.count("*").alias("n_versions")
    )
    return rows.select("id", F.nullif(F.col("m.t"), F.lit("")).alias("tier"), F.unix_micros("m.recorded_at").alias("recorded"), "n_versions")


@query("""SELECT upper(coalesce(trim(tier), 'none')) AS tier, coalesce(source, 'none') AS source, count(DISTINCT id) AS n, count(DISTINCT id) FILTER (WHERE len(figures) > 0) AS with_figures
    FROM evidence GROUP BY ALL""")
def tier_tally(spark: SparkSession, d: str) -> DataFrame:
    """Evidence per tier and source."""
    e = table(spark, d, "evidence")
    return e.groupBy(F.upper(F.coalesce(F.trim("tier"), F.lit("none"))).alias("tier"), F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count_distinct("id").alias("n"), F.count_distinct(F.when(F.size("figures") > 0, F.col("id"))).alias("with_figures")
    )


@query("""SELECT case_id, count(DISTINCT x) AS n_entities, count(*) AS n_mentions FROM (SELECT case_id, unnest(entities) AS x FROM evidence) GROUP BY case_id""")
def case_entities(spark: SparkSession, d: str) -> DataFrame:
    """Distinct entities per case. Two partial aggregates, so a case with a tenth of the rows is counted by all tasks."""
    x = table(spark, d, "evidence").select("case_id", F.explode("entities").alias("x"))
    per = x.groupBy("case_id", "x").agg(F.count("*").alias("n"))
    return per.groupBy("case_id").agg(F.count("x").alias("n_entities"), F.sum("n").alias("n_mentions"))


@query("""WITH e AS (SELECT 'evidence' AS kind, case_id, recorded_at, deleted_at FROM evidence UNION ALL SELECT 'hypotheses', case_id, recorded_at, deleted_at FROM hypotheses
    UNION ALL SELECT 'verdicts', case_id, recorded_at, NULL FROM verdicts)
    SELECT kind, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n, count(DISTINCT case_id) AS n_cases, count(deleted_at) AS n_deleted FROM e GROUP BY ALL""")
def recorded_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the case tables per month."""
    rows = None
    for kind in ("evidence", "hypotheses", "verdicts"):
        t = table(spark, d, kind)
        died = F.col("deleted_at") if "deleted_at" in t.columns else F.lit(None).cast("timestamp")
        t = t.select(F.lit(kind).alias("kind"), "case_id", "recorded_at", died.alias("deleted_at"))
        rows = t if rows is None else rows.unionByName(t)
    return rows.groupBy("kind", F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.count_distinct("case_id").alias("n_cases"), F.count("deleted_at").alias("n_deleted")
    )


@query()
def stream_screen(spark: SparkSession, d: str) -> DataFrame:
    """Evidence screened as it arrives: each micro-batch loses the citations that do not hold."""
    found = stored(verify.checked(table(spark, d, "citations"), texts(spark, d)))
    stream = log.tail(spark, f"{d}/evidence.parquet", table(spark, d, "evidence").schema)
    return log.each_batch(stream, lambda batch: verify.screened(batch, found))
