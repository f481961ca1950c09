"""Pairs of values that lie within a relative tolerance of each other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import stored

#: Keys in a list; pairs looked at under one join key, and in one task; all on average. Spark holds the pairs of two lists at once.
LIST, BLOCK, TASK = 64, 1 << 23, 1 << 24


def band_pairs(rows: DataFrame, value: str, key: str, tolerance: float = 0.005) -> DataFrame:
    """(a, b, va, vb) with va < vb <= va * (1 + tolerance), as an equi-join.

    A value falls in the bucket of its logarithm, a little wider than the
    tolerance, and is looked for in its own bucket and the next one, so the
    join is a merge instead of a nested loop. Values are joined with short
    lists of their keys, which are unfolded after that, so what is shuffled is
    far less than the result. A bucket is split by the pairs that can come of
    it, and there are as many tasks as all pairs call for, whatever the bytes.

    Defined results: null, zero, negative and infinite values pair with nothing.
    """
    step = math.log1p(tolerance * 1.02)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    v, n = F.col("v"), F.col("n")
    keys = rows.select(F.col(value).alias("v"), F.col(key).alias("k")).filter((v > 0) & (v < math.inf))
    part = F.pmod(F.xxhash64("k"), F.ceil(n / LIST))
    # A struct is kept where its key is null; partitions of a given number are not merged by AQE.
    lists = stored(
        keys.join(keys.groupBy("v").agg(F.count("*").alias("n")), "v").withColumn("part", part).repartition(cores, "v", "part")
        .groupBy("v", "n", "part").agg(F.collect_list(F.struct("k")).getField("k").alias("keys"))
        .select("v", "n", "keys", F.size("keys").alias("held"), F.xxhash64("v", "part").alias("hash"), F.floor(F.log("v") / F.lit(step)).alias("bucket"))
    )

    held = F.col("held").cast("double")
    sizes = lists.groupBy("bucket").agg(F.sum(held).alias("all"), F.sum(held * n).alias("equal"), F.count("*").cast("double").alias("lists"))
    before = sizes.select((F.col("bucket") + 1).alias("bucket"), F.col("all").alias("before"))
    # Lists of one value are compared too, but none of their keys.
    pairs = (F.col("all") * F.col("all") - F.col("equal")) / 2 + F.col("all") * F.coalesce("before", F.lit(0.0)) + F.col("lists") * F.col("lists")
    work = stored(sizes.join(before, "bucket", "left").select("bucket", pairs.alias("pairs"), F.greatest(F.lit(1), F.ceil(F.sqrt(pairs / BLOCK))).alias("splits")))
    tasks = max(cores, math.ceil((work.agg(F.sum("pairs")).first()[0] or 0) / TASK))

    own, each = F.pmod("hash", "splits"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))
    both = lists.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    left = both.join(work, "bucket").select("bucket", own.alias("i"), each.alias("j"), v.alias("va"), F.col("keys").alias("of_a"))
    right = lists.join(work, "bucket").select("bucket", each.alias("i"), own.alias("j"), v.alias("vb"), F.col("keys").alias("of_b"))
    at = ["bucket", "i", "j"]
    near = left.repartition(tasks, *at).hint("merge").join(right.repartition(tasks, *at), at).filter((F.col("va") < F.col("vb")) & (F.col("vb") - F.col("va") <= F.col("va") * tolerance))
    return near.select("va", "vb", "of_b", F.explode("of_a").alias("a")).select("a", F.explode("of_b").alias("b"), "va", "vb")
