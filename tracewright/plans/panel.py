"""Queries on figures by period; orders and their lines stand in for filed figures, nations for entities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import panel
from tracewright.plans.registry import Registry
from tracewright.session import shared_folder, table
from tracewright.sources import filed

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

# Every span a quarterly filer reports: three quarters, nine months and the year; the fourth quarter of odd years too.
SPANS = [("Q1", 1, 3), ("Q2", 4, 6), ("Q3", 7, 9), ("Q4", 10, 12), ("9M", 1, 9), ("FY", 1, 12)]


def order_facts(spark: SparkSession, d: str) -> DataFrame:
    """Order totals per customer nation and span, as filed facts. The aggregate runs by quarter; spans are sums of quarters."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    by_quarter = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("val"))
    )
    spans = F.array(*[F.struct(F.lit(n).alias("fp"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in SPANS])
    rows = by_quarter.select("*", F.inline(spans)).filter("q * 3 BETWEEN a AND b AND (fp <> 'Q4' OR y % 2 = 1)")
    return (
        rows.groupBy("entity", "y", "fp", "a", "b").agg(F.sum("val").cast("double").alias("val"), F.count("*").alias("n"))
        .filter("n * 3 = b - a + 1")
        .select(
            "entity", F.lit("Revenues").alias("tag"), F.make_date("y", "a", F.lit(1)).alias("start"), F.last_day(F.make_date("y", "b", F.lit(1))).alias("end"),
            "val", F.when(F.col("fp") == "FY", "10-K").otherwise("10-Q").alias("form"), "fp", F.lit(0).alias("seq"),
        )
    )


FACTS = """bq AS (SELECT c_nationkey AS entity, year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(o_totalprice::DECIMAL(18,2)) AS val
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    full_q AS (SELECT entity, make_date(y, 3 * q - 2, 1) AS start, last_day(make_date(y, 3 * q, 1)) AS "end", val::DOUBLE AS revenue, false AS derived FROM bq WHERE q < 4 OR y % 2 = 1),
    nine AS (SELECT entity, y, sum(val)::DOUBLE AS v FROM bq WHERE q < 4 GROUP BY ALL HAVING count(*) = 3),
    fy AS (SELECT entity, y, sum(val)::DOUBLE AS v FROM bq GROUP BY ALL HAVING count(*) = 4),
    q4 AS (SELECT entity, make_date(y, 10, 1) AS start, make_date(y, 12, 31) AS "end", fy.v - nine.v AS revenue, true AS derived
        FROM fy JOIN nine USING (entity, y) WHERE y % 2 = 0),
    quarters AS (SELECT * FROM full_q UNION ALL SELECT * FROM q4)"""


_SPANS = ", ".join(f"('{n}', {a}, {b})" for n, a, b in SPANS)


@query(f"""WITH {FACTS}, s AS (SELECT * FROM (VALUES {_SPANS}) t(fp, a, b)),
    f AS (SELECT entity, y, fp, a, b, sum(val) AS val FROM bq JOIN s ON q * 3 BETWEEN a AND b AND (fp <> 'Q4' OR y % 2 = 1) GROUP BY ALL HAVING count(*) * 3 = b - a + 1)
    SELECT entity::VARCHAR AS entity, 'Revenues' AS tag, make_date(y, a, 1)::VARCHAR AS start, last_day(make_date(y, b, 1))::VARCHAR AS "end", val::DOUBLE AS val,
    CASE WHEN fp = 'FY' THEN '10-K' ELSE '10-Q' END AS form, fp FROM f""")
def facts_copy(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as company-facts JSON, one object a company, and read back."""
    path = f"{shared_folder(spark)}/facts/{uuid.uuid4().hex}"
    filed.write_company_facts(order_facts(spark, d), path)
    return _days(filed.read_company_facts(spark, path, lines=True)).drop("seq")


def _days(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end", "prior_end") if c in df.columns})


@query(f"""WITH {FACTS} SELECT entity, start::VARCHAR AS start, "end"::VARCHAR AS "end", round(revenue, 2) AS revenue, derived FROM quarters""")
def quarter_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Quarters as filed, with fourth quarters derived where they are not."""
    return _days(panel.quarters(order_facts(spark, d))).withColumn("revenue", F.round("revenue", 2))


@query(f"""WITH {FACTS} SELECT entity, round(sum(revenue), 2) AS total, count(*) AS n_quarters, count(*) FILTER (WHERE derived) AS n_derived
    FROM quarters WHERE start BETWEEN '1996-02-01' AND '1999-10-31' GROUP BY entity""")
def revenue_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Total over a window that keeps quarters by their start."""
    q = panel.quarters(order_facts(spark, d), "1996-02-01", "1999-10-31")
    return q.groupBy("entity").agg(F.round(F.sum("revenue"), 2).alias("total"), F.count("*").alias("n_quarters"), F.count_if("derived").alias("n_derived"))


TRAILING = f"""{FACTS}, t AS (SELECT entity, "end", unnest([3, 6, 9, 12]) AS months,
        unnest([revenue, CASE WHEN n >= 2 THEN s2 END, CASE WHEN n >= 3 THEN s3 END, CASE WHEN n >= 4 THEN s4 END]) AS revenue FROM (
        SELECT *, row_number() OVER w AS n, sum(revenue) OVER (w ROWS 1 PRECEDING) AS s2, sum(revenue) OVER (w ROWS 2 PRECEDING) AS s3,
        sum(revenue) OVER (w ROWS 3 PRECEDING) AS s4 FROM quarters WINDOW w AS (PARTITION BY entity ORDER BY "end")))"""


@query(f"""WITH {TRAILING} SELECT entity, "end"::VARCHAR AS "end", months, round(revenue, 2) AS revenue FROM t""")
def trailing_revenue(spark: SparkSession, d: str) -> DataFrame:
    return _days(panel.trailing(panel.quarters(order_facts(spark, d)))).withColumn("revenue", F.round("revenue", 2))


@query(f"""WITH {TRAILING}, s AS (SELECT c_nationkey AS entity, c_mktsegment AS party, last_day(make_date(y, 3 * q, 1)) AS "end", months,
        round(100 * n / sum(n) OVER (PARTITION BY c_nationkey, y, q)) AS pct FROM (SELECT c_nationkey, c_mktsegment, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
        count(*) AS n, CASE quarter(o_orderdate) WHEN 2 THEN 6 WHEN 3 THEN 9 WHEN 4 THEN 12 ELSE 3 END AS months
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)),
    v AS (SELECT *, row_number() OVER (PARTITION BY entity, party ORDER BY months DESC, pct DESC, "end" DESC) AS rn FROM s JOIN t USING (entity, "end", months) WHERE revenue <> 0)
    SELECT entity, party, "end"::VARCHAR AS "end", months, pct, round(revenue, 2) AS revenue, round(revenue * pct / 100, 2) AS value FROM v WHERE rn = 1""")
def window_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Whole-percent shares of orders per market segment, valued against the window's revenue; the longest window counts."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("party"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
        .agg(F.count("*").alias("n"))
    )
    whole = n.groupBy("entity", "y", "q").agg(F.sum("n").alias("all"))
    shares = n.join(whole, ["entity", "y", "q"]).select(
        "entity", "party", F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1))).alias("end"), (F.col("q") * 3).alias("months"),
        F.round(F.lit(100) * F.col("n") / F.col("all")).alias("pct"),
    )
    out = panel.valued(shares, panel.trailing(panel.quarters(order_facts(spark, d))))
    return _days(out).withColumns({"revenue": F.round("revenue", 2), "value": F.round("value", 2)})


# Measures of the stand-in panel, as sums over order lines; the last has no figures in even years.
EXT, DISC, TAX = "cast(l_extendedprice AS DECIMAL(12,2))", "cast(l_discount AS DECIMAL(4,2))", "cast(l_tax AS DECIMAL(4,2))"
MEASURES = {
    "revenue": f"sum({EXT} * (1 - {DISC}))",
    "cogs": f"sum({EXT} * {DISC})",
    "receivables": f"sum(CASE WHEN l_linestatus = 'O' THEN {EXT} END)",
    "assets": f"sum({EXT})",
    "current_assets": f"sum(CASE WHEN l_returnflag = 'N' THEN {EXT} END)",
    "ppe": f"sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN {EXT} END)",
    "cfo": f"sum(CASE WHEN l_linestatus = 'F' THEN {EXT} * (1 - {DISC}) ELSE -{EXT} END)",
    "net_income": f"sum({EXT} * ({TAX} - {DISC}))",
    "current_liabilities": f"sum(CASE WHEN l_quantity < 10 THEN {EXT} END)",
    "liabilities": f"sum(CASE WHEN l_quantity < 20 THEN {EXT} END)",
    "ltd": f"sum(CASE WHEN l_quantity > 45 THEN {EXT} END)",
    "sga": f"sum({EXT} * {TAX})",
    "depreciation": f"sum(CASE WHEN l_returnflag = 'A' THEN {EXT} * {DISC} END)",
    "securities": f"sum(CASE WHEN l_returnflag = 'A' AND year(l_shipdate) % 2 = 1 THEN {EXT} END)",
}


def line_facts(spark: SparkSession, d: str) -> DataFrame:
    """One annual fact per supplier nation, year and measure; cost of revenue is filed under its second tag."""
    li = table(spark, d, "lineitem")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    wide = (
        li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("entity"), F.year("l_shipdate").alias("y"))
        .agg(*[F.expr(x).cast("double").alias(m) for m, x in MEASURES.items()])
    )
    tag = {m: panel.TAGS[m][1 if m == "cogs" else 0] for m in MEASURES}
    facts = F.array(*[F.struct(F.lit(tag[m]).alias("tag"), F.col(m).alias("val")) for m in MEASURES])
    return wide.select("entity", "y", F.inline(facts)).filter("val IS NOT NULL").select(
        "entity", "tag", F.make_date("y", F.lit(1), F.lit(1)).alias("start"), F.make_date("y", F.lit(12), F.lit(31)).alias("end"), "val",
        F.lit("10-K").alias("form"), F.lit("FY").alias("fp"), F.lit(0).alias("seq"),
    )


PANEL = "p AS (SELECT s_nationkey AS entity, year(l_shipdate) AS y, " + ", ".join(f"({x})::DOUBLE AS {m}" for m, x in MEASURES.items()) + """
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


@query(f"""WITH {PANEL} SELECT entity, make_date(y, 12, 31)::VARCHAR AS "end", {', '.join(MEASURES)} FROM p""")
def financial_panel(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity and year, one column per measure."""
    return _days(panel.panel(panel.annual_series(line_facts(spark, d))))


@query(f"""WITH {PANEL} SELECT entity, make_date(y, 12, 31)::VARCHAR AS "end", net_income, cfo, net_income - cfo AS gap,
    (net_income - cfo) / revenue AS gap_over_revenue, net_income > 0 AND cfo < 0 AS profit_without_cash
    FROM p WHERE net_income IS NOT NULL AND cfo IS NOT NULL AND revenue <> 0""")
def accrual_screen(spark: SparkSession, d: str) -> DataFrame:
    return _days(panel.accruals(panel.panel(panel.annual_series(line_facts(spark, d)))))


_S = "(1 - (coalesce({0}.current_assets, 0) + coalesce({0}.ppe, 0) + coalesce({0}.securities, 0)) / {0}.assets)"
_D = "({0}.depreciation / (coalesce({0}.depreciation, 0) + coalesce({0}.ppe, 0)))"
_L = "((coalesce({0}.current_liabilities, 0) + coalesce({0}.ltd, 0)) / {0}.assets)"
_G = "((coalesce({0}.revenue, 0) - coalesce({0}.cogs, 0)) / {0}.revenue)"


@query(f"""WITH {PANEL}, l AS (SELECT entity, y, lag(y) OVER (PARTITION BY entity ORDER BY y) AS py FROM p),
    i AS (SELECT c.entity, c.y, q.y AS py, (c.receivables / c.revenue) / (q.receivables / q.revenue) AS DSRI, {_G.format('q')} / {_G.format('c')} AS GMI,
        {_S.format('c')} / {_S.format('q')} AS AQI, c.revenue / q.revenue AS SGI, {_D.format('q')} / {_D.format('c')} AS DEPI,
        (c.sga / c.revenue) / (q.sga / q.revenue) AS SGAI, (coalesce(c.net_income, 0) - coalesce(c.cfo, 0)) / c.assets AS TATA, {_L.format('c')} / {_L.format('q')} AS LVGI
        FROM l JOIN p c USING (entity, y) JOIN p q ON q.entity = l.entity AND q.y = l.py WHERE least(c.revenue, q.revenue) >= 1000000),
    n AS (SELECT entity, y, py, coalesce(DSRI, 1) AS DSRI, coalesce(GMI, 1) AS GMI, coalesce(AQI, 1) AS AQI, coalesce(SGI, 1) AS SGI, coalesce(DEPI, 1) AS DEPI,
        coalesce(SGAI, 1) AS SGAI, coalesce(TATA, 0) AS TATA, coalesce(LVGI, 1) AS LVGI,
        trim(concat_ws(' ', {', '.join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in panel.WEIGHTS)})) AS unavailable FROM i),
    m AS (SELECT *, {panel.CONSTANT}::DOUBLE {' '.join(f'+ ({w}::DOUBLE) * {k}' for k, w in panel.WEIGHTS.items())} AS m_score FROM n)
    SELECT entity, make_date(y, 12, 31)::VARCHAR AS "end", make_date(py, 12, 31)::VARCHAR AS prior_end, {', '.join(f'round({k}, 6) AS {k}' for k in panel.WEIGHTS)},
    round(m_score, 6) AS m_score, m_score > {panel.THRESHOLD} AS flagged, unavailable,
    list_sort([{', '.join(f"{{'s': -abs(({w}::DOUBLE) * {k}), 'i': {i}, 'n': '{k}'}}" for i, (k, w) in enumerate(panel.WEIGHTS.items()))}])[1].n AS dominant_driver FROM m""")
def beneish_score(spark: SparkSession, d: str) -> DataFrame:
    """Eight indices and their score for consecutive available years above the revenue floor."""
    y = panel.years(panel.panel(panel.annual_series(line_facts(spark, d)))).filter("NOT skipped")
    out = _days(panel.m_score(y))
    return out.withColumns({k: F.round(k, 6) for k in [*panel.WEIGHTS, "m_score"]})


@query(f"""WITH {PANEL}, l AS (SELECT entity, y, revenue, lag(revenue) OVER (PARTITION BY entity ORDER BY y) AS before FROM p)
    SELECT entity, make_date(y, 12, 31)::VARCHAR AS "end", revenue FROM l WHERE least(revenue, before) < 8000000 AND before IS NOT NULL""")
def skipped_years(spark: SparkSession, d: str) -> DataFrame:
    """Years whose revenue, or that of the year before, is under the floor where ratios mean something."""
    y = panel.years(panel.panel(panel.annual_series(line_facts(spark, d))), 8_000_000)
    return _days(y.filter("skipped").select("entity", "end", "revenue"))
