"""Queries that build a ledger from stated facts and look for odd figures in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import number, significant_digits, squashed
from tracewright.operators import extract
from tracewright.operators.bands import band_pairs
from tracewright.operators.extract import FILINGS, NAME
from tracewright.operators.ranks import medians, ranked
from tracewright.plans.registry import Registry, squeeze_sql
from tracewright.session import stored, table, texts

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

EQ, CASH, CONC, RATE, DATE = (extract.portable(FILINGS[k]) for k in ("equity", "cash", "concentration", "rate", "date"))

SQL_NAME = extract.portable(NAME)


def _num_sql(c: str) -> str:
    return f"replace({c}, ',', '')::DOUBLE"


def _matches_sql(pattern: str, name: str = "x") -> str:
    """CTE: file, text (flat), k, m."""
    return f"""{name}_t AS (SELECT file, {squeeze_sql('text')} AS text FROM documents),
    {name}_a AS (SELECT file, text, regexp_extract_all(text, '{pattern}') AS a FROM {name}_t WHERE regexp_matches(text, '{pattern}')),
    {name} AS (SELECT file, text, unnest(range(len(a))) AS k, unnest(a) AS m FROM {name}_a)"""


def _key_sql(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


DEALS = f"""{_matches_sql(EQ)}, deals AS (SELECT file, k, 'equity' AS settled_in, regexp_extract(m, '{EQ}', 1) AS party,
    {_num_sql(f"regexp_extract(m, '{EQ}', 2)")} AS units, {_num_sql(f"regexp_extract(m, '{EQ}', 4)")} AS consideration,
    regexp_extract(m, '{EQ}', 6)::DOUBLE AS unit_price FROM x)"""
FEES = f"""{_matches_sql(CASH, 'y')}, fees AS (SELECT file, k, 'cash' AS settled_in, regexp_extract(m, '{CASH}', 2) AS party,
    {_num_sql(f"regexp_extract(m, '{CASH}', 3)")} AS consideration, regexp_extract(m, '{CASH}', 4)::DOUBLE AS unpaid_pct FROM y)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "file", "text")


def deals(spark: SparkSession, d: str) -> DataFrame:
    return extract.facts(_docs(spark, d), "equity").select("file", "k", F.col("kind").alias("settled_in"), "party", "units", F.col("amount").alias("consideration"), "unit_price")


def fees(spark: SparkSession, d: str) -> DataFrame:
    return extract.facts(_docs(spark, d), "cash").select("file", "k", F.col("kind").alias("settled_in"), "party", F.col("amount").alias("consideration"), "unpaid_pct")


@query(f"WITH {DEALS} SELECT file, k::INT AS k, party, units, consideration, unit_price FROM deals")
def equity_deals(spark: SparkSession, d: str) -> DataFrame:
    """Every stated deal settled in units."""
    return deals(spark, d).drop("settled_in")


@query(f"WITH {FEES} SELECT file, k::INT AS k, party, consideration, unpaid_pct FROM fees")
def cash_deals(spark: SparkSession, d: str) -> DataFrame:
    return fees(spark, d).drop("settled_in")


FIRST = f"""{DEALS}, firsts AS (SELECT settled_in, {_key_sql('party')} AS key, arg_min(party, (file, k)) AS party, arg_min(units, (file, k)) AS units,
    min(file) AS file, arg_min(consideration, (file, k)) AS consideration, arg_min(unit_price, (file, k)) AS unit_price,
    count(DISTINCT file) AS filing_count FROM deals GROUP BY 1, 2)"""


@query(f"WITH {FIRST} SELECT * FROM firsts")
def first_disclosure(spark: SparkSession, d: str) -> DataFrame:
    """One row per party: the first disclosure, gaps filled from later ones, and the number of files."""
    return extract.register(deals(spark, d))


@query(f"""WITH {FEES} SELECT settled_in, {_key_sql('party')} AS key, arg_min(party, (file, k)) AS party, min(file) AS file,
    arg_min(consideration, (file, k)) AS consideration, count(DISTINCT file) AS filing_count FROM fees GROUP BY 1, 2""")
def first_fee(spark: SparkSession, d: str) -> DataFrame:
    return extract.register(fees(spark, d), fill=("consideration",))


def _sentences_sql(c: str) -> str:
    return f"""string_split(regexp_replace({c}, '([.;])[ ]+([A-Z("''“])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"""


# The place of a match: how much text stands before it, equal matches told apart by their number.
PLACED = "p AS (SELECT *, (list_sum(list_transform(string_split(text, m)[:n], lambda x: length(x))) + (n - 1) * length(m))::BIGINT AS start FROM (SELECT *, row_number() OVER (PARTITION BY file, m ORDER BY k) AS n FROM x))"


@query(f"""WITH {_matches_sql(EQ)}, {PLACED},
    q AS (SELECT file, k, regexp_extract(m, '{EQ}', 1) AS party, m, {_sentences_sql("substring(text, greatest(start - 400, 0)::BIGINT + 1, start - greatest(start - 400, 0)::BIGINT + 1)")}[-1] AS head,
        {_sentences_sql("substring(text, start + length(m), 401)")}[1] AS behind FROM p)
    SELECT file, k::INT AS k, party, trim(right(left(head, length(head) - 1) || m || substring(behind, 2), 400)) AS quote FROM q""")
def deal_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Each deal with the sentence it stands in, as a citation that can be verified."""
    m = extract.matches(_docs(spark, d), FILINGS["equity"], {"party": 1}, extract.WORDS["equity"])
    return m.select("file", "k", "party", extract.quote(F.col("text"), F.col("start"), F.col("start") + F.length("m")).alias("quote"))


CONCS = f"""{_matches_sql(CONC)}, c AS (SELECT file, k, unnest([regexp_extract(m, '{CONC}', 1), regexp_extract(m, '{CONC}', 2)]) AS party,
    regexp_extract(m, '{CONC}', 3)::DECIMAL(9,2) AS pct FROM x)"""


@query(f"""WITH {CONCS}, l AS (SELECT left(file, 7) AS period, party, arg_max(pct, (file, k)) AS pct FROM c GROUP BY 1, 2)
    SELECT period, count(*) AS n_customers, sum(pct)::DOUBLE AS named_share_pct, (array_agg(party ORDER BY pct DESC, party))[1] AS largest FROM l GROUP BY period""")
def concentration_share(spark: SparkSession, d: str) -> DataFrame:
    """Named customers and their stated share per month of filing; a later statement replaces an earlier one."""
    return concentrated(extract.facts(_docs(spark, d), "concentration"))


def concentrated(f: DataFrame) -> DataFrame:
    """Customers and their stated share per month, from concentration facts."""
    rows = f.filter("kind = 'concentration'").select("file", "k", F.explode(F.array("party", "other")).alias("party"), F.col("share_pct").cast("decimal(9,2)").alias("pct"))
    last = rows.groupBy(F.left("file", F.lit(7)).alias("period"), "party").agg(F.max_by("pct", F.struct("file", "k")).alias("pct"))
    return last.groupBy("period").agg(
        F.count("*").alias("n_customers"), F.sum("pct").cast("double").alias("named_share_pct"),
        F.min_by("party", F.struct(-F.col("pct"), "party")).alias("largest"),
    )


@query(f"""WITH {_matches_sql(CONC)}, {PLACED}
    SELECT file, k::INT AS k, coalesce(regexp_extract_all(substring(text, greatest(start - 299, 1)::BIGINT, least(start, 300)::BIGINT), '{DATE}')[-1], '') AS period FROM p""")
def preceding_period(spark: SparkSession, d: str) -> DataFrame:
    """The last date in the 300 characters in front of each stated share."""
    m = extract.matches(_docs(spark, d), FILINGS["concentration"], {}, extract.WORDS["concentration"])
    dates = F.regexp_extract_all(extract.before(300), F.lit(FILINGS["date"]), F.lit(0))
    return m.select("file", "k", F.coalesce(F.try_element_at(dates, F.lit(-1)), F.lit("")).alias("period"))


@query(f"""WITH {_matches_sql(EQ)}, {PLACED}
    SELECT file, k::INT AS k, nullif(regexp_extract(substring(text, start + 1 + length(m), 1200), '{RATE}', 1), '') AS low FROM p""")
def trailing_rate(spark: SparkSession, d: str) -> DataFrame:
    """The first rate in the 1,200 characters behind each deal."""
    m = extract.matches(_docs(spark, d), FILINGS["equity"], {}, extract.WORDS["equity"])
    return m.select("file", "k", F.nullif(F.regexp_extract(extract.tail(1200), FILINGS["rate"], 1), F.lit("")).alias("low"))


RATES = f"""{_matches_sql(RATE, 'z')}, rates AS (SELECT {_num_sql(f"regexp_extract(m, '{RATE}', 1)")} AS low, {_num_sql(f"regexp_extract(m, '{RATE}', 2)")} AS high,
    file, k FROM z)"""


def rates(spark: SparkSession, d: str) -> DataFrame:
    return extract.facts(_docs(spark, d), "rate").select("file", "k", "low", "high")


@query(f"WITH {RATES} SELECT low, high, min(file) AS file, count(DISTINCT file) AS n_files FROM rates GROUP BY low, high")
def rate_cards(spark: SparkSession, d: str) -> DataFrame:
    """Distinct published rates with the first file that states them."""
    return rates(spark, d).groupBy("low", "high").agg(F.min("file").alias("file"), F.count_distinct("file").alias("n_files"))


def _ordered_sql(order: str) -> str:
    return f"row_number() OVER (ORDER BY {order})::INT AS rn"


@query(f"""WITH {RATES}, c AS (SELECT low, high, min(file) AS file, count(DISTINCT file) AS n_files FROM rates GROUP BY low, high) SELECT *, {_ordered_sql('low, high')} FROM c""")
def rate_card_order(spark: SparkSession, d: str) -> DataFrame:
    """Published rates, the lowest first."""
    return in_order(rate_cards(spark, d), F.col("low"), F.col("high"))


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with their number `rn` in an order over all of them."""
    return ranked(rows.withColumn("all_", F.lit(0)), "all_", *order).drop("all_")


@query(f"""WITH {DEALS}, {FEES}, u AS (SELECT settled_in, file, k, party, consideration, unit_price FROM deals UNION ALL SELECT settled_in, file, k, party, consideration, NULL FROM fees),
    g AS (SELECT settled_in, {_key_sql('party')} AS key, arg_min(party, (file, k)) AS party, min(file) AS file, arg_min(consideration, (file, k)) AS consideration,
        arg_min(unit_price, (file, k)) AS unit_price, count(DISTINCT file) AS filing_count FROM u GROUP BY 1, 2)
    SELECT *, {_ordered_sql('coalesce(consideration, 0) DESC, settled_in, key')} FROM g""")
def engagement_register(spark: SparkSession, d: str) -> DataFrame:
    """Each party's first disclosure per way of settlement, gaps filled from later ones, the largest first."""
    rows = engaged(extract.facts(_docs(spark, d), "equity", "cash"))
    return in_order(rows, F.desc(F.coalesce("consideration", F.lit(0.0))), F.col("settled_in"), F.col("key"))


def engaged(f: DataFrame) -> DataFrame:
    """The register of equity and cash facts, in no order."""
    rows = f.filter("kind IN ('equity', 'cash')").select(
        "file", "k", F.col("kind").alias("settled_in"), "party", F.col("amount").alias("consideration"), F.when(F.col("kind") == "equity", F.col("unit_price")).alias("unit_price")
    )
    return extract.register(rows)


@query(f"""WITH {_matches_sql(CONC)}, {PLACED},
    q AS (SELECT file, k, m, {_sentences_sql("substring(text, greatest(start - 400, 0)::BIGINT + 1, start - greatest(start - 400, 0)::BIGINT + 1)")}[-1] AS head,
        {_sentences_sql("substring(text, start + length(m), 401)")}[1] AS behind FROM p),
    c AS (SELECT left(file, 7) AS period, file, k, trim(right(left(head, length(head) - 1) || m || substring(behind, 2), 400)) AS quote,
        unnest([regexp_extract(m, '{CONC}', 1), regexp_extract(m, '{CONC}', 2)]) AS party, regexp_extract(m, '{CONC}', 3)::DOUBLE AS pct FROM q),
    l AS (SELECT period, party, arg_max(pct, (file, k)) AS pct, max(file) AS file, arg_max(quote, (file, k)) AS quote FROM c GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY period ORDER BY pct DESC, party)::INT AS rn FROM l""")
def concentration_customers(spark: SparkSession, d: str) -> DataFrame:
    """The customers of each month with their last stated share and the sentence that states it, the largest first."""
    m = extract.matches(_docs(spark, d), FILINGS["concentration"], {"p": 1, "q": 2, "s": 3}, extract.WORDS["concentration"])
    said = extract.quote(F.col("text"), F.col("start"), F.col("start") + F.length("m"))
    rows = m.select("file", "k", said.alias("quote"), F.explode(F.array("p", "q")).alias("party"), F.col("s").cast("double").alias("pct"))
    last = rows.groupBy(F.left("file", F.lit(7)).alias("period"), "party").agg(F.max_by(F.struct("pct", "file", "quote"), F.struct("file", "k")).alias("r"))
    return ranked(last.select("period", "party", "r.*"), "period", F.desc("pct"), F.col("party"))


@query(f"""WITH {DEALS}, {FEES}, {RATES} SELECT e.*, c.*, r.*, e.equity_median / r.published_high AS multiple_vs_published, e.equity_median / c.cash_median AS multiple_vs_cash
    FROM (SELECT min(consideration) AS equity_low, max(consideration) AS equity_high, median(consideration) AS equity_median FROM deals WHERE consideration <> 0) e,
    (SELECT min(consideration) AS cash_low, max(consideration) AS cash_high, median(consideration) AS cash_median FROM fees WHERE consideration <> 0) c,
    (SELECT min(low) AS published_low, max(high) AS published_high FROM rates) r""")
def pricing_spread(spark: SparkSession, d: str) -> DataFrame:
    """Lowest, highest and median consideration per way of settlement, against published rates."""
    return spread(stored(extract.facts(_docs(spark, d), "equity", "cash", "rate").select("kind", "amount", "low", "high")))


def spread(f: DataFrame) -> DataFrame:
    """One row of prices from equity, cash and rate facts."""
    paid = f.filter("kind IN ('equity', 'cash') AND amount <> 0")
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    some = {k: of(k, "amount") for k in ("equity", "cash")}
    ends = paid.agg(*[x(some[k]).alias(f"{k}_{n}") for k in some for n, x in (("low", F.min), ("high", F.max))])
    middle = medians(paid, "kind", "amount").agg(*[F.max(of(k, "median")).alias(f"{k}_median") for k in some])
    cards = f.filter("kind = 'rate'").agg(F.min("low").alias("published_low"), F.max("high").alias("published_high"))
    # Three single rows, joined on a constant.
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(ends).join(one(middle), "one").join(one(cards), "one").select(
        "equity_low", "equity_high", "equity_median", "cash_low", "cash_high", "cash_median", "published_low", "published_high",
        F.try_divide("equity_median", "published_high").alias("multiple_vs_published"), F.try_divide("equity_median", "cash_median").alias("multiple_vs_cash"),
    )


@query(f"""WITH {DEALS}, {FEES}, e AS (SELECT left(file, 4) AS year, count(*) AS n, sum(consideration::DECIMAL(18,2)) AS total FROM deals GROUP BY 1),
    c AS (SELECT left(file, 4) AS year, count(*) AS n, sum(consideration::DECIMAL(18,2)) AS total FROM fees GROUP BY 1)
    SELECT year, coalesce(e.n, 0) AS equity_deals, coalesce(e.total, 0)::DOUBLE AS equity_total, coalesce(c.n, 0) AS cash_deals, coalesce(c.total, 0)::DOUBLE AS cash_total,
    (coalesce(e.total, 0)::DOUBLE) / nullif(coalesce(e.total, 0)::DOUBLE + coalesce(c.total, 0)::DOUBLE, 0) AS equity_share,
    CASE WHEN c.total > 0 THEN coalesce(e.total, 0)::DOUBLE / c.total::DOUBLE END AS overstatement FROM e FULL JOIN c USING (year)""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Totals per year and way of settlement, the share that never arrived as cash, and what it adds to the rest."""
    return settled(extract.facts(_docs(spark, d), "equity", "cash"))


def settled(f: DataFrame) -> DataFrame:
    """Totals per year of filing from equity and cash facts."""
    money = F.col("amount").cast("decimal(18,2)")
    of = lambda k, x: F.when(F.col("kind") == k, x)
    out = f.filter("kind IN ('equity', 'cash')").groupBy(F.left("file", F.lit(4)).alias("year")).agg(
        F.count(of("equity", F.lit(1))).alias("equity_deals"), F.coalesce(F.sum(of("equity", money)).cast("double"), F.lit(0.0)).alias("equity_total"),
        F.count(of("cash", F.lit(1))).alias("cash_deals"), F.coalesce(F.sum(of("cash", money)).cast("double"), F.lit(0.0)).alias("cash_total"),
    )
    return out.withColumns({
        "equity_share": F.try_divide("equity_total", F.col("equity_total") + F.col("cash_total")),
        "overstatement": F.try_divide("equity_total", "cash_total"),
    })


RESTATED = extract.portable(FILINGS["restated"])
REPORTED = f"""{_matches_sql(RESTATED, 'w')}, rs AS (SELECT DISTINCT regexp_extract(m, '{RESTATED}', 1) AS year, {_key_sql(f"regexp_extract(m, '{RESTATED}', 4)")} AS key,
    {_num_sql(f"regexp_extract(m, '{RESTATED}', 2)")}::DECIMAL(18,2) AS fell, {_num_sql(f"regexp_extract(m, '{RESTATED}', 3)")}::DECIMAL(18,2) AS left_over FROM w),
    ry AS (SELECT year, max(fell + left_over) AS reported, sum(fell) AS excluded, count(DISTINCT key) AS n_excluded FROM rs GROUP BY 1)"""


@query(f"""WITH {DEALS}, {FEES}, {REPORTED}, s AS (SELECT left(file, 4) AS year, sum(consideration::DECIMAL(18,2)) FILTER (WHERE o = 0) AS equity, sum(consideration::DECIMAL(18,2)) FILTER (WHERE o = 1) AS cash
        FROM (SELECT file, consideration, 0 AS o FROM deals UNION ALL SELECT file, consideration, 1 FROM fees) GROUP BY 1),
    t AS (SELECT year, reported, coalesce(equity, 0) AS equity, coalesce(cash, 0) AS cash, excluded, n_excluded, reported - coalesce(equity, 0) - coalesce(cash, 0) AS residual FROM ry LEFT JOIN s USING (year))
    SELECT year, reported::DOUBLE AS reported, equity::DOUBLE AS equity_total, cash::DOUBLE AS cash_total, excluded::DOUBLE AS excluded_total, n_excluded, residual::DOUBLE AS residual,
    CASE WHEN reported > 0 THEN equity::DOUBLE / reported::DOUBLE END AS equity_share, CASE WHEN reported > 0 THEN excluded::DOUBLE / reported::DOUBLE END AS excluded_share,
    CASE WHEN residual > 0 THEN equity::DOUBLE / residual::DOUBLE END AS overstatement FROM t""")
def reconcile_reported(spark: SparkSession, d: str) -> DataFrame:
    """Stated deals of a year against the income reported for it, with what was taken out and what no deal explains."""
    return against_reported(stored(extract.facts(_docs(spark, d), "equity", "cash", "restated")))


def against_reported(f: DataFrame) -> DataFrame:
    """Per fiscal year with a reported income: its residual and shares, from equity, cash and restated facts."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    once = f.filter("kind = 'restated'").select("year", squashed(F.col("party")).alias("key"), money("amount").alias("fell"), money("low").alias("left_over")).distinct()
    reported = once.groupBy("year").agg(F.max(F.col("fell") + F.col("left_over")).alias("reported"), F.sum("fell").alias("excluded"), F.count_distinct("key").alias("n_excluded"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, money("amount"))), F.lit(0).cast("decimal(28,2)"))
    stated = f.filter("kind IN ('equity', 'cash')").groupBy(F.left("file", F.lit(4)).alias("year")).agg(of("equity").alias("equity"), of("cash").alias("cash"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(28,2)"))
    t = reported.join(stated, "year", "left").withColumns({"equity": zero("equity"), "cash": zero("cash")}).withColumn("residual", F.col("reported") - F.col("equity") - F.col("cash"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double"))
    return t.select(
        "year", F.col("reported").cast("double"), F.col("equity").cast("double").alias("equity_total"), F.col("cash").cast("double").alias("cash_total"),
        F.col("excluded").cast("double").alias("excluded_total"), "n_excluded", F.col("residual").cast("double"),
        share("equity", "reported").alias("equity_share"), share("excluded", "reported").alias("excluded_share"), share("equity", "residual").alias("overstatement"),
    )


@query(f"""WITH {DEALS}, {FEES}, u AS (SELECT party, 0 AS o, file, k FROM deals UNION ALL SELECT party, 1, file, k FROM fees)
    SELECT {_key_sql('party')} AS key, arg_min(party, (o, file, k, party)) AS party, count(DISTINCT o) AS n_kinds FROM u GROUP BY 1""")
def counterparty_union(spark: SparkSession, d: str) -> DataFrame:
    """All parties of both kinds of deals; the first spelling stands."""
    u = extract.facts(_docs(spark, d), "equity", "cash").select("party", F.when(F.col("kind") == "equity", 0).otherwise(1).alias("o"), "file", "k")
    return u.groupBy(squashed(F.col("party")).alias("key")).agg(
        F.min_by("party", F.struct("o", "file", "k", "party")).alias("party"), F.count_distinct("o").alias("n_kinds")
    )


@query(f"""WITH m AS (SELECT file, unnest(list_distinct(regexp_extract_all({squeeze_sql('text')}, '{SQL_NAME}'))) AS party FROM documents)
    SELECT party, count(DISTINCT file) AS n_files, min(file) AS first_file FROM m GROUP BY party HAVING count(DISTINCT file) >= 2""")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Parties that at least two files name."""
    return (
        extract.mentions(_docs(spark, d)).groupBy("party")
        .agg(F.count_distinct("file").alias("n_files"), F.min("file").alias("first_file")).filter("n_files >= 2")
    )


ALIAS = r" \([“\"]([^”\"]{1,25})[”\"]\)"
ALIASES = f"""al AS (SELECT file, unnest(range(len(a))) AS k, unnest(a) AS m FROM (SELECT file, regexp_extract_all({squeeze_sql('text')}, '{SQL_NAME}{ALIAS}') AS a FROM documents)),
    an AS (SELECT file, k, trim(regexp_extract(m, '^({SQL_NAME})', 1)) AS party, lower(trim(regexp_extract(m, '{SQL_NAME}{ALIAS}', 1))) AS alias FROM al)"""


_STOP = ", ".join(f"'{x}'" for x in extract.ALIAS_STOP)


ALIAS_MAP = f"""{ALIASES}, am AS (SELECT alias, arg_min(party, (file, k)) AS party FROM an WHERE length(alias) >= 2 AND alias NOT IN ({_STOP}) GROUP BY alias)"""


@query(f"WITH {ALIAS_MAP} SELECT * FROM am")
def alias_map(spark: SparkSession, d: str) -> DataFrame:
    """Short names of parties, for what each first stands for, whether or not it is part of the name."""
    return extract.aliases(_docs(spark, d), NAME, ALIAS, part_of_name=False)


@query(f"""WITH {ALIAS_MAP}, t AS (SELECT file, lower({squeeze_sql('text')}) AS t FROM documents)
    SELECT DISTINCT file, party FROM t JOIN am ON regexp_matches(t, '\\b' || alias || '\\b')""")
def alias_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Files that name a party by its short name."""
    docs = _docs(spark, d)
    return extract.alias_mentions(docs, extract.aliases(docs, NAME, ALIAS, part_of_name=False))


AMOUNT = FILINGS["amount"]
SENTENCES = f"""s AS (SELECT file, squeezed, unnest(string_split(squeezed, '. ')) AS s FROM (SELECT file, {squeeze_sql('text')} AS squeezed FROM documents)),
    o AS (SELECT file, list_distinct(regexp_extract_all(s, '{SQL_NAME}')) AS n, list_distinct(regexp_extract_all(s, '{AMOUNT}')) AS a FROM s),
    f AS (SELECT file, n[1] AS party, unnest(a) AS amount FROM o WHERE len(n) = 1)"""


def single_party_figures(spark: SparkSession, d: str) -> DataFrame:
    """(file, party, amount): amounts of sentences that name exactly one party."""
    s = _docs(spark, d).select("file", F.explode(F.split(extract.squeeze(F.col("text")), r"\. ", -1)).alias("s"))
    all_of = lambda p: F.array_distinct(F.regexp_extract_all("s", F.lit(p), F.lit(0)))
    return (
        s.select("file", all_of(NAME).alias("n"), all_of(AMOUNT).alias("a")).filter("size(n) = 1")
        .select("file", F.col("n")[0].alias("party"), F.explode("a").alias("amount"))
    )


def _digits_sql(c: str) -> str:
    return f"greatest(length(trim(regexp_replace({c}, '[$,.]', '', 'g'), '0')), 1)"


REPEATED = f"""{SENTENCES}, r AS (SELECT amount, count(DISTINCT party) AS party_count, count(DISTINCT file) AS n_files, list_sort(list_distinct(list(party))) AS parties
    FROM f GROUP BY amount HAVING count(DISTINCT party) >= 2)"""


def repeated(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("amount", r"\$", "")
    return (
        single_party_figures(spark, d).groupBy("amount")
        .agg(F.count_distinct("party").alias("party_count"), F.count_distinct("file").alias("n_files"), F.sort_array(F.collect_set("party")).alias("parties"))
        .filter("party_count >= 2")
        .withColumn("digits", significant_digits(bare)).withColumn("value", number(F.col("amount")))
        .withColumn("significance", F.when(F.col("digits") >= 3, "STRONG").otherwise("WEAK"))
    )


@query(f"""WITH {REPEATED} SELECT amount, party_count, n_files, array_to_string(parties, '; ') AS parties, {_digits_sql('amount')}::INT AS digits,
    regexp_replace(amount, '[$,]', '', 'g')::DOUBLE AS value, CASE WHEN {_digits_sql('amount')} >= 3 THEN 'STRONG' ELSE 'WEAK' END AS significance FROM r""")
def repeated_figures(spark: SparkSession, d: str) -> DataFrame:
    """Amounts that several parties share, each in a sentence of its own."""
    return repeated(spark, d).withColumn("parties", F.array_join("parties", "; "))


MIN_PARTIES = 3


@query(f"""WITH s AS (SELECT file, unnest({_sentences_sql(squeeze_sql('text'))}) AS s FROM documents),
    o AS (SELECT file, s, list_distinct(regexp_extract_all(s, '{SQL_NAME}')) AS n, list_distinct(regexp_extract_all(s, '{AMOUNT}')) AS a FROM s),
    f AS (SELECT file, right(s, 400) AS quote, n[1] AS party, unnest(a) AS amount FROM o WHERE len(n) = 1),
    c AS (SELECT amount, count(DISTINCT party) AS party_count, count(DISTINCT file) AS n_files, {_digits_sql('amount')}::INT AS digits, regexp_replace(amount, '[$,]', '', 'g')::DOUBLE AS value
        FROM f GROUP BY amount HAVING count(DISTINCT party) >= {MIN_PARTIES}),
    r AS (SELECT *, {_ordered_sql('digits DESC, party_count DESC, value DESC')} FROM c),
    e AS (SELECT amount, party, min({{'file': file, 'quote': quote}}) AS x FROM f GROUP BY 1, 2)
    SELECT r.*, party, x.file AS file, x.quote AS quote FROM r JOIN e USING (amount)""")
def figure_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Amounts that at least three parties share, the most telling first, with one sentence per party."""
    return exemplars(_docs(spark, d))


def exemplars(docs: DataFrame, parties: int = MIN_PARTIES) -> DataFrame:
    s = docs.select("file", F.explode_outer(extract.sentences(extract.squeeze(F.col("text")))).alias("s"))
    all_of = lambda p: F.array_distinct(F.regexp_extract_all("s", F.lit(p), F.lit(0)))
    f = stored(
        s.select("file", F.right("s", F.lit(400)).alias("quote"), all_of(NAME).alias("n"), all_of(AMOUNT).alias("a")).filter("size(n) = 1")
        .select("file", "quote", F.col("n")[0].alias("party"), F.explode("a").alias("amount"))
    )
    counts = (
        f.groupBy("amount").agg(F.count_distinct("party").alias("party_count"), F.count_distinct("file").alias("n_files")).filter(F.col("party_count") >= parties)
        .withColumns({"digits": significant_digits(F.regexp_replace("amount", r"\$", "")), "value": number(F.col("amount"))})
    )
    one = f.groupBy("amount", "party").agg(F.min(F.struct("file", "quote")).alias("x")).select("amount", "party", "x.*")
    return in_order(counts, F.desc("digits"), F.desc("party_count"), F.desc("value")).join(one, "amount")


@query(f"""WITH {REPEATED}, v AS (SELECT *, regexp_replace(amount, '[$,]', '', 'g')::DOUBLE AS value FROM r WHERE {_digits_sql('amount')} >= 3)
    SELECT a.amount AS a, b.amount AS b, b.value - a.value AS delta, len(list_intersect(a.parties, b.parties)) AS n_shared
    FROM v a JOIN v b ON a.value < b.value AND b.value - a.value <= a.value * 0.005""")
def near_miss(spark: SparkSession, d: str) -> DataFrame:
    """Repeated figures a hair apart, with the number of parties they share."""
    r = stored(repeated(spark, d).filter("significance = 'STRONG'"))
    p = r.select("amount", "parties")
    return (
        band_pairs(r, "value", "amount").join(p.select(F.col("amount").alias("a"), F.col("parties").alias("pa")), "a")
        .join(p.select(F.col("amount").alias("b"), F.col("parties").alias("pb")), "b")
        .select("a", "b", (F.col("vb") - F.col("va")).alias("delta"), F.size(F.array_intersect("pa", "pb")).cast("long").alias("n_shared"))
    )


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_retailprice AS va, b.p_retailprice AS vb
    FROM part a JOIN part b ON a.p_retailprice < b.p_retailprice AND b.p_retailprice - a.p_retailprice <= a.p_retailprice * 0.001""")
def price_band_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose prices differ by at most a thousandth."""
    return band_pairs(table(spark, d, "part"), "p_retailprice", "p_partkey", 0.001)


@query(f"""SELECT a, b, delta, n_shared FROM ({SQL['near_miss']}) WHERE n_shared > 0""")
def near_miss_shared(spark: SparkSession, d: str) -> DataFrame:
    """Of the repeated figures a hair apart those that a party shares."""
    return near_miss(spark, d).filter("n_shared > 0")


@query(f"""WITH er AS ({SQL['engagement_register']}), rc AS ({SQL['rate_cards']}), cs AS ({SQL['concentration_share']}), rr AS ({SQL['reconcile']}), rp AS ({SQL['reconcile_reported']}), ps AS ({SQL['pricing_spread']})
    SELECT 'engagements' AS section, settled_in AS item, count(*) AS n, sum(consideration::DECIMAL(18,2))::DOUBLE AS value FROM er GROUP BY settled_in
    UNION ALL SELECT 'rate cards', 'all', count(*), max(high) FROM rc
    UNION ALL SELECT 'concentration', period, n_customers, named_share_pct FROM cs
    UNION ALL SELECT 'settled', year, equity_deals + cash_deals, equity_share FROM rr
    UNION ALL SELECT 'reported', year, n_excluded, residual FROM rp
    UNION ALL SELECT 'prices', 'equity against published', NULL, multiple_vs_published FROM ps
    UNION ALL SELECT 'prices', 'equity against cash', NULL, multiple_vs_cash FROM ps""")
def ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """The whole ledger as one report, its facts extracted in one scan of the texts."""
    f = stored(extract.facts(_docs(spark, d)))
    part = lambda name, df, item, n, value: df.select(F.lit(name).alias("section"), item.alias("item"), n.cast("long").alias("n"), value.cast("double").alias("value"))
    c = F.col
    register = engaged(f).groupBy("settled_in").agg(F.count("*").alias("n"), F.sum(c("consideration").cast("decimal(18,2)")).alias("v"))
    cards = f.filter("kind = 'rate'").select("low", "high").distinct().agg(F.count("*").alias("n"), F.max("high").alias("v"))
    against = lambda name, v: F.struct(F.lit(f"equity against {name}").alias("item"), c(v).alias("value"))
    prices = spread(f).select(F.inline(F.array(against("published", "multiple_vs_published"), against("cash", "multiple_vs_cash"))))
    return (
        part("engagements", register, c("settled_in"), c("n"), c("v"))
        .unionByName(part("rate cards", cards, F.lit("all"), c("n"), c("v")))
        .unionByName(part("concentration", concentrated(f), c("period"), c("n_customers"), c("named_share_pct")))
        .unionByName(part("settled", settled(f), c("year"), c("equity_deals") + c("cash_deals"), c("equity_share")))
        .unionByName(part("reported", against_reported(f), c("year"), c("n_excluded"), c("residual")))
        .unionByName(part("prices", prices, c("item"), F.lit(None), c("value")))
    )
