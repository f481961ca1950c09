"""Problem 3: references to records that do not exist.

References and parent keys are shuffled by the same key and sorted, and one
merge over both streams (Spark's sort-merge join) decides each reference by
the parent's validity interval: the parent is `missing` if there is none,
`late` if it begins after the reference was written, `deleted` if it had ended
by then.

Parents are aggregated to one row per key before the shuffle. The join key is
(scope, kind, key), not the scope, so a case that holds a third of the rows
spreads over all tasks; a single key that many rows refer to is split by AQE's
skew join, which can split the left side of a left join.

Defined results: null and blank ids are no reference; a null scope never
matches, so its references are `missing`; a reference without a time is neither
late nor deleted; repeated rows count once; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import clean_id


def clean_ids(c: Column) -> Column:
    """The distinct usable ids of an array."""
    return F.array_distinct(F.filter(F.transform(c, clean_id), lambda x: x.isNotNull()))


def references(
    rows: DataFrame, table: str, src_id: str, scope: str, at: str, fields: dict[str, str]
) -> DataFrame:
    """One row per distinct reference of each row. `fields`: column -> kind of the target."""
    kinds = dict(rows.dtypes)
    refs = [
        F.struct(
            F.lit(name).alias("ref_field"),
            F.lit(kind).alias("kind"),
            clean_ids(F.col(name) if kinds[name].startswith("array") else F.array(name)).alias("ids"),
        )
        for name, kind in fields.items()
    ]
    return (
        rows.select(
            F.lit(table).alias("src_table"),
            F.col(src_id).alias("src_id"),
            F.col(scope).alias("scope"),
            F.col(at).alias("at"),
            F.explode(F.array(*refs)).alias("r"),
        )
        .select("src_table", "src_id", "scope", "at", "r.ref_field", "r.kind", F.explode("r.ids").alias("ref_id"))
    )


def parents(rows: DataFrame, kind: str, key: Column, scope: str, born: str, died: str) -> DataFrame:
    """Validity interval of each parent key; `key` is an array of the ids a row answers to."""
    return (
        rows.select(
            F.col(scope).alias("scope"), F.col(born).alias("born"), F.col(died).alias("died"), F.explode(clean_ids(key)).alias("ref_id")
        )
        .groupBy("scope", "ref_id")
        .agg(F.min("born").alias("born"), F.min("died").alias("died"))
        .withColumn("kind", F.lit(kind))
    )


def orphans(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References that do not resolve, each with its reason; `at` is kept for reports."""
    known = known.withColumn("found", F.lit(True))
    reason = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("born") > F.col("at"), "late")
        .when(F.col("died") <= F.col("at"), "deleted")
    )
    return (
        refs.join(known.hint("merge"), ["scope", "kind", "ref_id"], "left")
        .select("src_table", "src_id", "ref_field", "ref_id", "at", reason.alias("reason"))
        .filter("reason IS NOT NULL")
    )


def case_orphans(hypotheses: DataFrame, verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Orphans of the case tables; an absorbed hypothesis id stands for the row that absorbed it."""
    refs = references(
        hypotheses, "hypotheses", "id", "case_id", "recorded_at", {"supporting": "evidence", "contradicting": "evidence"}
    ).unionByName(references(verdicts, "verdicts", "verdict_id", "case_id", "recorded_at", {"hypothesis_id": "hypothesis"}))
    ids = F.concat(F.array("id"), F.coalesce("merged_from", F.array().cast("array<string>")))
    known = parents(evidence, "evidence", F.array("id"), "case_id", "recorded_at", "deleted_at").unionByName(
        parents(hypotheses, "hypothesis", ids, "case_id", "recorded_at", "deleted_at")
    )
    return orphans(refs, known)


def found(hypotheses: DataFrame, verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    return case_orphans(hypotheses, verdicts, evidence).drop("at").distinct()


def report(hypotheses: DataFrame, verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct orphans per table, month of the referring row, and reason."""
    return (
        case_orphans(hypotheses, verdicts, evidence)
        .withColumn("month", F.date_format("at", "yyyy-MM"))
        .drop("at")
        .distinct()
        .groupBy("src_table", "month", "ref_field", "reason")
        .agg(F.count("*").alias("n_refs"))
    )
