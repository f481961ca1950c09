"""Filed figures as panels and timelines, and the screens that read them.

Facts are rows (entity, tag, start, end, val, form, fp, seq); dates are DATE,
`start` is null for figures of one day, `seq` orders repeated filings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags per measure, in order of preference.
TAGS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"],
    "cogs": ["CostOfRevenue", "CostOfGoodsAndServicesSold"],
    "receivables": ["AccountsReceivableNetCurrent"],
    "assets": ["Assets"],
    "current_assets": ["AssetsCurrent"],
    "ppe": ["PropertyPlantAndEquipmentNet"],
    "cfo": ["NetCashProvidedByUsedInOperatingActivities"],
    "net_income": ["NetIncomeLoss"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "liabilities": ["Liabilities"],
    "ltd": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "sga": ["SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"],
    "depreciation": ["DepreciationDepletionAndAmortization", "Depreciation", "DepreciationAmortizationAndAccretionNet"],
    "securities": ["MarketableSecuritiesNoncurrent", "LongTermInvestments"],
}
# Weights of the eight indices, in order, and the constant.
WEIGHTS = {"DSRI": 0.920, "GMI": 0.528, "AQI": 0.404, "SGI": 0.892, "DEPI": 0.115, "SGAI": -0.172, "TATA": 4.679, "LVGI": -0.327}
CONSTANT, THRESHOLD, MIN_REVENUE = -4.84, -1.78, 1_000_000


def annual_series(facts: DataFrame, tags: dict[str, list[str]] = TAGS) -> DataFrame:
    """(entity, measure, end, val): full-year figures, the largest per year, of the first tag that has any."""
    order = F.create_map(*[F.lit(x) for m, ts in tags.items() for i, t in enumerate(ts) for x in (t, f"{i}:{m}")])
    months = (F.year("end") - F.year("start")) * 12 + F.month("end") - F.month("start")
    rows = (
        facts.withColumn("m", order[F.col("tag")])
        .filter(F.col("m").isNotNull() & (F.col("form") == "10-K") & (F.col("fp") == "FY") & (F.col("start").isNull() | months.between(10, 14)))
        .withColumns({"rank": F.split("m", ":")[0].cast("int"), "measure": F.split("m", ":")[1]})
    )
    first = F.min("rank").over(Window.partitionBy("entity", "measure"))
    return (
        rows.groupBy("entity", "measure", "rank", "end").agg(F.max_by("val", F.struct(F.abs("val"), -F.col("seq"))).alias("val"))
        .withColumn("first", first).filter("rank = first").select("entity", "measure", "end", "val")
    )


def panel(series: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """One row per entity and year, one column per measure; the list of measures keeps the pivot from scanning twice."""
    return series.groupBy("entity", "end").pivot("measure", measures or list(TAGS)).agg(F.first("val"))


def quarters(facts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(entity, start, end, revenue, derived): filed quarters and fourth quarters derived from year less nine months."""
    days = F.coalesce(F.datediff("end", "start"), F.lit(0))
    span = F.when(days.between(80, 100), "q").when(days.between(260, 285), "n").when(days.between(355, 375), "y")
    last = facts.withColumn("span", span).filter(F.col("span").isNotNull() & F.startswith("form", F.lit("10-"))).groupBy(
        "entity", "span", "start", "end"
    ).agg(F.max_by("val", "seq").alias("val"))
    of = lambda s: last.filter(F.col("span") == s).drop("span")
    nine = of("n").select("entity", "start", F.date_add("end", 1).alias("q4"), F.col("val").alias("nine"))
    derived = of("y").join(nine, ["entity", "start"]).select("entity", F.col("q4").alias("start"), "end", (F.col("val") - F.col("nine")).alias("revenue"))
    filed = of("q").withColumnRenamed("val", "revenue")
    derived = derived.join(filed, ["entity", "start", "end"], "left_anti")
    rows = filed.withColumn("derived", F.lit(False)).unionByName(derived.withColumn("derived", F.lit(True)))
    if start:
        rows = rows.filter(F.col("start").between(start, end))
    first = F.row_number().over(Window.partitionBy("entity", "end").orderBy("start", "derived"))
    return rows.withColumn("rn", first).filter("rn = 1").drop("rn")


def trailing(q: DataFrame, spans: tuple[int, ...] = (3, 6, 9, 12)) -> DataFrame:
    """(entity, end, months, revenue): sums over the last reported quarters, NULL where there are too few."""
    w = Window.partitionBy("entity").orderBy("end")
    n = F.row_number().over(w)
    sums = [
        F.struct(F.lit(m).alias("months"), F.when(n >= m // 3, F.sum("revenue").over(w.rowsBetween(1 - m // 3, 0))).alias("revenue")) for m in spans
    ]
    return q.select("entity", "end", F.array(*sums).alias("s")).select("entity", "end", F.inline("s"))


def valued(shares: DataFrame, windows: DataFrame) -> DataFrame:
    """Stated shares (entity, party, end, months, pct) as amounts; per party the longest window supersedes the rest."""
    rows = shares.join(windows.filter("revenue IS NOT NULL AND revenue <> 0"), ["entity", "end", "months"])
    rn = F.row_number().over(Window.partitionBy("entity", "party").orderBy(F.desc("months"), F.desc("pct"), F.desc("end")))
    return rows.withColumn("rn", rn).filter("rn = 1").select(
        "entity", "party", "end", "months", "pct", "revenue", (F.col("revenue") * F.col("pct") / 100).alias("value")
    )


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def years(p: DataFrame, min_revenue: float = MIN_REVENUE) -> DataFrame:
    """Each year with the entity's previous available year as `prior`; `skipped` where revenue is under the floor."""
    w = Window.partitionBy("entity").orderBy("end")
    cols = [c for c in p.columns if c not in ("entity", "end")]
    rows = p.withColumn("prior", F.lag(F.struct("end", *cols)).over(w))
    ok = (F.col("revenue") != 0) & (F.col("prior.revenue") != 0)
    return rows.filter(ok).withColumn("skipped", F.least("revenue", "prior.revenue") < min_revenue)


def indices(c: str = "", p: str = "prior.", strict: bool = False) -> dict[str, Column]:
    """The eight indices of a year against its prior; NULL is unavailable.

    Missing parts of a sum count as 0, unless `strict`, which leaves the index unavailable.
    """
    cur, pri = (lambda n: F.col(f"{c}{n}")), (lambda n: F.col(f"{p}{n}"))
    z = (lambda x: x) if strict else (lambda x: F.coalesce(x, F.lit(0.0)))

    def margin(y):
        return _div(z(y("revenue")) - z(y("cogs")), y("revenue"))

    def soft(y):
        return 1 - _div(z(y("current_assets")) + z(y("ppe")) + z(y("securities")), y("assets"))

    def rate(y):
        return _div(y("depreciation"), z(y("depreciation")) + z(y("ppe")))

    def debt(y):
        total = z(y("current_liabilities")) + z(y("ltd"))
        return _div(F.when((total == 0) & (z(y("liabilities")) != 0), y("liabilities")).otherwise(total), y("assets"))

    return {
        "DSRI": _div(_div(cur("receivables"), cur("revenue")), _div(pri("receivables"), pri("revenue"))),
        "GMI": F.when((margin(cur) != 0) & (margin(pri) != 0), _div(margin(pri), margin(cur))),
        "AQI": _div(soft(cur), soft(pri)),
        "SGI": _div(cur("revenue"), pri("revenue")),
        "DEPI": _div(rate(pri), rate(cur)),
        "SGAI": _div(_div(cur("sga"), cur("revenue")), _div(pri("sga"), pri("revenue"))),
        "TATA": _div(z(cur("net_income")) - z(cur("cfo")), cur("assets")),
        "LVGI": _div(debt(cur), debt(pri)),
    }


def m_score(y: DataFrame, strict: bool = False) -> DataFrame:
    """Years with their score, flag, missing indices (held neutral) and the index that contributes most."""
    ix = indices(strict=strict)
    rows = y.select("*", *[v.alias(f"raw_{k}") for k, v in ix.items()])
    rows = rows.select("*", *[F.coalesce(f"raw_{k}", F.lit(0.0 if k == "TATA" else 1.0)).alias(k) for k in ix])
    score = F.lit(CONSTANT)
    for k, w in WEIGHTS.items():
        score = score + F.lit(w) * F.col(k)
    parts = F.array(*[F.struct(F.abs(F.lit(w) * F.col(k)).alias("size"), F.lit(-i).alias("at"), F.lit(k).alias("name")) for i, (k, w) in enumerate(WEIGHTS.items())])
    return rows.select(
        "entity", "end", F.col("prior.end").alias("prior_end"), *ix, score.alias("m_score"), (score > THRESHOLD).alias("flagged"),
        F.array_join(F.array_compact(F.array(*[F.when(F.col(f"raw_{k}").isNull(), k) for k in ix])), " ").alias("unavailable"),
        F.array_max(parts)["name"].alias("dominant_driver"),
    )


def accruals(p: DataFrame) -> DataFrame:
    """Income without cash: the gap, its share of revenue, and whether income is positive and cash negative."""
    return p.filter("net_income IS NOT NULL AND cfo IS NOT NULL AND revenue <> 0").select(
        "entity", "end", "net_income", "cfo", (F.col("net_income") - F.col("cfo")).alias("gap"),
        ((F.col("net_income") - F.col("cfo")) / F.col("revenue")).alias("gap_over_revenue"),
        ((F.col("net_income") > 0) & (F.col("cfo") < 0)).alias("profit_without_cash"),
    )
