"""The event log: replay, snapshots and rankings in batch, and the same as streams.

Every order has a total tie-break by `event_id`; cursors compare
(time, id), so events that share a time are neither skipped nor repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


def since(events: DataFrame, ts: str, event_id: int) -> DataFrame:
    """Events behind a cursor, the cursor's own time included for later ids."""
    at = F.lit(ts).cast("timestamp")
    return events.filter((F.col("ts") > at) | ((F.col("ts") == at) & (F.col("event_id") > event_id)))


def latest(rows: DataFrame, keys: list[str], order: list[str], *fields: str) -> DataFrame:
    """The last row per key: the snapshot that upserts leave. One aggregate, no window over a hot key."""
    at = F.struct(*order)
    last = F.max_by(F.struct(*fields), at)
    return rows.groupBy(*keys).agg(last.alias("r"), F.count("*").alias("n_versions")).select(*keys, "r.*", "n_versions")


def previous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each event with the value before it of the same key."""
    w = Window.partitionBy(key).orderBy(*ORDER)
    return rows.select("event_id", key, value, F.lag(value).over(w).alias(f"prior_{value}"))


def top_k(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The k first rows per group; ranks beyond k are pruned before the shuffle by Spark's window group limit."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rn") <= k)


def running_share(rows: DataFrame, key: str, kind: Column) -> DataFrame:
    """Per event of a key: how many events there were up to it and how many of the kind."""
    w = Window.partitionBy(key).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", key, F.count("*").over(w).alias("seen"), F.count_if(kind).over(w).alias("of_kind"))


def sessions(rows: DataFrame, key: str, gap: str = "2 hours") -> DataFrame:
    """Runs of events of a key with no pause longer than the gap."""
    s = F.session_window(F.col("ts"), gap)
    return rows.groupBy(key, s).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value")).select(
        key, F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n", "value"
    )
