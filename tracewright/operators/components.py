"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregate and one join by node; a hub with many edges is
reduced on the map side for its minimum, and AQE may split its join. The edges
of a step are written to the shared folder, so the plan does not
grow with the number of steps and a lost executor costs no more than one step.

Defined results: self-loops and repeated edges are ignored; null ends are
dropped; nodes without an edge do not come out; the root is the least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import stored


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Large star links larger neighbours to a node's least one; small star the smaller ones and the node."""
    nbr = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        nbr = nbr.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = nbr.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = nbr.join(least, "u")
    if large:
        return out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    both = F.explode(F.array_distinct(F.array("v", "u"))).alias("a")
    return out.select(both, F.col("m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge."""
    e = stored(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    print_of = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    last = None
    while (now := print_of(e)) != last:
        last = now
        e = stored(_star(_star(e, large=True), large=False))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
