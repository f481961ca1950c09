"""Session helpers: building a local session, loading tables, cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tracewright", cores: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS") or "8"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The documents, which are much work each: if the scan has fewer tasks than there are cores, they are spread over all of them.

    A scan of fewer tasks reads at most that many times `spark.sql.files.maxPartitionBytes` (or files that
    cannot be split), so what is shuffled here is bounded; larger tables are read as they lie.
    """
    df = table(spark, folder, "documents")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, which a cluster sets to a place all executors share.

    Where it is unset a session on one machine (tests, the bench) takes a temporary folder; on a cluster
    that is an error, as no folder of the driver's machine can be read by the executors.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-"))
        folder = sc.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder and go on from there; Spark cleans the files up with the data frame."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Unlike a checkpoint it is compressed and read by column, for what is large
    or read several times. The files go when the Python process ends, or by
    `clear_stored`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear_stored() -> None:
    """Delete the tables `stored` has written; data frames made from them can no longer be read."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before
            return


atexit.register(clear_stored)
