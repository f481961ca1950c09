"""Ranks and medians within groups of any size.

No group is sorted in one task, so one that holds a third of all rows is as
good as any other.

Defined results: a median leaves nulls out, and a group of nulls only has none;
rows that are equal in the whole order get different ranks in no given order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import stored


def ranked(rows: DataFrame, by: str, *order: Column, name: str = "rn") -> DataFrame:
    """`rows` with each row's number (from 1) in the order within its group.

    Rows are spread by ranges of (group, order); a row's number is its number within the range, which is
    sorted by itself, and the rows of the group in the ranges before.
    """
    spread = stored(rows.repartitionByRange(by, *order).withColumn("part__", F.spark_partition_id()))
    sizes = spread.groupBy(F.col(by).alias("group__"), F.col("part__").alias("range__")).agg(F.count("*").alias("held__"))
    # As many rows as the group has ranges.
    before = F.sum("held__").over(Window.partitionBy("group__").orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("group__", "range__", F.coalesce(before, F.lit(0)).alias("before__"))
    numbered = spread.withColumn("own__", F.row_number().over(Window.partitionBy(by, "part__").orderBy(*order)))
    return (
        numbered.join(sizes, F.col(by).eqNullSafe(F.col("group__")) & (F.col("part__") == F.col("range__")))
        .select(*rows.columns, (F.col("own__") + F.col("before__")).cast("int").alias(name))
    )


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): exact medians, from the counts of different values.

    Values fall in bands of like size; the band that holds a group's middle is found from the bands' counts,
    and only its values are put in order.
    """
    v = F.col(value)
    # Bands are in the order of the values, some hundred for each power of e.
    band = F.signum(v) * F.floor((F.log1p(F.abs(v)) + 1) * 128)
    counts = rows.filter(v.isNotNull()).groupBy(F.col(by).alias("g"), v.alias("v")).agg(F.count("*").alias("n"), F.min(band).alias("band"))
    bands = counts.groupBy("g", "band").agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("g").orderBy("band"))
    total = F.sum("n").over(Window.partitionBy("g"))
    placed = bands.select("g", "band", (up_to - F.col("n")).alias("before"), up_to.alias("upto"), total.alias("total"))
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    middle = placed.filter(((F.col("before") < lower) & (F.col("upto") >= lower)) | ((F.col("before") < upper) & (F.col("upto") >= upper)))
    inside = counts.join(middle.withColumnsRenamed({"g": "g_", "band": "band_"}), F.col("g").eqNullSafe(F.col("g_")) & (F.col("band") == F.col("band_")))
    last = F.col("before") + F.sum("n").over(Window.partitionBy("g", "band").orderBy("v"))
    at = inside.select("g", "v", "total", last.alias("last"), (last - F.col("n")).alias("first"))
    hit = lambda k: F.max(F.when((F.col("first") < k) & (F.col("last") >= k), F.col("v")))
    return at.groupBy(F.col("g").alias(by)).agg(((hit(lower) + hit(upper)) / 2).alias("median"))
