"""The event log as a stream: tail, running counts, folded state, windowed counts.

Queries run with `availableNow`: they take what is there, in micro-batches, and
stop; run again with the same checkpoint they take what is new. Each sink is a
table in the shared folder, replaced or appended per batch by batch id, so a
replayed batch does not count twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.session import shared_folder


def append(rows: DataFrame, path: str) -> None:
    """Add events (actor, kind, payload, ...) to a log, each with an id of its own and the time."""
    rows.select(F.uuid().alias("event_id"), F.current_timestamp().alias("ts"), "*").write.mode("append").parquet(path)


def tail(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The log from its beginning, then what is added; times become TIMESTAMP, which watermarks need.

    All files that are there are one batch unless `files_per_batch` is given: with a watermark, files that are
    not cut by time must come so, else the first moves it past the rows of the others.
    """
    # As a pattern the path may be one file as well as a folder of files.
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drain(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its sink as a table.

    `complete` replaces the table with each batch, once per run as a run takes all that is there; `append`
    adds each batch under its id.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table" if mode == "complete" else f"{folder}/table/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table").select(*stream.columns)


def counts(events: DataFrame) -> DataFrame:
    """Running counts per type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def state(events: DataFrame) -> DataFrame:
    """Events folded into the last state per user."""
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("r"), F.count("*").alias("n")).select("user_id", "r.*", "n")


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per window and type, final once the watermark has passed; what comes later than `late` is dropped.

    An extension: the log itself knows no event-time windows.
    """
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """Apply a batch operator to each micro-batch of what is there and return what all of them gave.

    Each batch's rows are kept under its id, so a batch that is run again replaces its own.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").drop("batch")
