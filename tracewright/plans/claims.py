"""Queries on hypotheses, verdicts and the evidence behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.text import clean_id
from tracewright.operators import claims
from tracewright.operators.ranks import ranked
from tracewright.plans.registry import Registry, clean_id_sql
from tracewright.session import stored, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _count(marks: list[str]) -> str:
    return f"len(list_filter({_list(marks)}, lambda k: contains(lower(claim), k)))"


FIGURE, WORD = claims.FIGURE, claims.WORD.replace("'", "''")
STANCE = f"""CASE WHEN w > 0 AND i = 0 THEN 'ASSERTS_WRONGDOING' WHEN i > 0 AND w = 0 THEN 'ASSERTS_INNOCENT' WHEN w = 0 AND i = 0 THEN 'NEUTRAL'
    WHEN w - i >= {claims.MARGIN} THEN 'ASSERTS_WRONGDOING' WHEN i - w >= {claims.MARGIN} THEN 'ASSERTS_INNOCENT' ELSE 'AMBIGUOUS' END"""
FEATURES = f"""h AS (SELECT case_id AS scope, coalesce(claim, '') AS claim, min(id) AS id, max(coalesce(confidence, 0)) AS confidence, count(DISTINCT id) AS members FROM hypotheses GROUP BY 1, 2),
    n AS (SELECT *, {_count(claims.WRONGDOING)} AS w, {_count(claims.INNOCENT)} AS i,
        list_filter(list_distinct(regexp_extract_all(lower(claim), '{WORD}')), lambda x: NOT list_contains({_list(claims.STOP)}, x)) AS words,
        list_transform(regexp_extract_all(claim, '{FIGURE}'), lambda x: trim(regexp_replace(x, '[$,]', '', 'g'))) AS bare FROM h),
    f AS (SELECT scope, claim, id, confidence, members, {STANCE} AS stance, words,
        list_distinct(list_filter(list_transform(bare, lambda x: CASE WHEN x LIKE '%\\%' ESCAPE '\\' THEN x WHEN try_cast(rtrim(x, '.') AS DOUBLE) >= 1000
        THEN round_even(try_cast(rtrim(x, '.') AS DOUBLE), 0)::DECIMAL(30,0)::VARCHAR END), lambda x: x IS NOT NULL)) AS figures FROM n)"""


@query(f"WITH {FEATURES} SELECT scope AS case_id, stance, sum(members)::BIGINT AS n_claims FROM f GROUP BY ALL")
def stance_class(spark: SparkSession, d: str) -> DataFrame:
    """Claims per case and stance."""
    f = claims.features(table(spark, d, "hypotheses"), "case_id")
    return f.groupBy(F.col("scope").alias("case_id"), "stance").agg(F.sum("members").alias("n_claims"))


@query(f"""WITH {FEATURES} SELECT id, stance, array_to_string(list_sort(figures), ' ') AS figures, array_to_string(list_sort(words), ' ') AS words FROM f""")
def claim_features(spark: SparkSession, d: str) -> DataFrame:
    f = claims.features(table(spark, d, "hypotheses"), "case_id")
    return f.select("id", "stance", F.array_join(F.sort_array("figures"), " ").alias("figures"), F.array_join(F.sort_array("words"), " ").alias("words"))


@query(f"""WITH {FEATURES}, p AS (SELECT a.scope, a.id AS a, b.id AS b, len(list_intersect(a.figures, b.figures)) AS n_shared,
        len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words)))::DOUBLE AS similarity
        FROM f a JOIN f b ON a.scope = b.scope AND a.stance = b.stance AND a.id < b.id WHERE a.stance <> 'AMBIGUOUS' AND len(a.words) > 0 AND len(b.words) > 0)
    SELECT * FROM p WHERE n_shared > 0 AND similarity >= {claims.SIMILAR}""")
def claim_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a case that say the same: one stance, a common figure, similar words."""
    return claims.pairs(claims.features(table(spark, d, "hypotheses"), "case_id"))


@query()
def claim_leaders(spark: SparkSession, d: str) -> DataFrame:
    """The claim each claim is merged into."""
    f = claims.cut(claims.features(table(spark, d, "hypotheses"), "case_id"))
    return claims.leaders(f, claims.pairs(f))


@query()
def arrival_leaders(spark: SparkSession, d: str) -> DataFrame:
    """The claim each claim is merged into if the first that arrived absorbs what comes later."""
    h = table(spark, d, "hypotheses")
    born = h.groupBy(F.col("case_id").alias("scope"), F.coalesce("claim", F.lit("")).alias("claim")).agg(F.min("recorded_at").alias("arrived"))
    f = stored(claims.features(h, "case_id").join(born, ["scope", "claim"]))
    return claims.leaders(f, claims.pairs(f), F.col("arrived"))


@query()
def claims_merged(spark: SparkSession, d: str) -> DataFrame:
    return claims.merged(table(spark, d, "hypotheses"))


@query()
def claims_merged_all(spark: SparkSession, d: str) -> DataFrame:
    """Claims merged over all cases, not within each."""
    return claims.merged(table(spark, d, "hypotheses").withColumn("all_cases", F.lit("all")).drop("case_id"), "all_cases")


ALIAS = f"""a AS (SELECT case_id, {clean_id_sql('m')} AS absorbed, min(id) AS survivor FROM (SELECT case_id, id, unnest(merged_from) AS m FROM hypotheses) WHERE {clean_id_sql('m')} IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {ALIAS}, v AS (SELECT DISTINCT verdict_id, case_id, {clean_id_sql('hypothesis_id')} AS hyp, survives FROM verdicts WHERE {clean_id_sql('hypothesis_id')} IS NOT NULL)
    SELECT verdict_id, hyp, coalesce(survivor, hyp) AS resolved, h.id IS NOT NULL AS known FROM v LEFT JOIN a ON a.case_id = v.case_id AND absorbed = hyp
    LEFT JOIN (SELECT DISTINCT case_id, id FROM hypotheses) h ON h.case_id = v.case_id AND h.id = coalesce(survivor, hyp)""")
def verdict_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each verdict with the hypothesis it resolves to through merges."""
    h = table(spark, d, "hypotheses")
    alias = (
        h.select("case_id", "id", F.explode("merged_from").alias("m")).select("case_id", "id", clean_id(F.col("m")).alias("hyp")).filter("hyp IS NOT NULL")
        .groupBy("case_id", "hyp").agg(F.min("id").alias("survivor"))
    )
    v = table(spark, d, "verdicts").select("verdict_id", "case_id", clean_id(F.col("hypothesis_id")).alias("hyp"), "survives").distinct().filter("hyp IS NOT NULL")
    known = h.select("case_id", F.col("id").alias("resolved")).distinct().withColumn("k", F.lit(True))
    return (
        v.join(alias, ["case_id", "hyp"], "left").withColumn("resolved", F.coalesce("survivor", "hyp"))
        .join(known, ["case_id", "resolved"], "left").select("verdict_id", "hyp", "resolved", F.col("k").isNotNull().alias("known"))
    )


@query(f"""WITH {ALIAS}, v AS (SELECT DISTINCT verdict_id, case_id, {clean_id_sql('hypothesis_id')} AS hyp, survives, unsupported_leap, confidence_after, epoch_us(recorded_at) AS t FROM verdicts),
    r AS (SELECT v.*, coalesce(survivor, hyp) AS id FROM v LEFT JOIN a ON a.case_id = v.case_id AND absorbed = hyp),
    l AS (SELECT case_id, id, arg_max(survives, (t, verdict_id)) AS survives, bool_or(coalesce(unsupported_leap, false)) AS leap FROM r GROUP BY 1, 2),
    h AS (SELECT DISTINCT case_id, id, confidence, coalesce(refuted, false) AS refuted, len(list_filter(list_distinct(list_transform(coalesce(contradicting, []), lambda x: {clean_id_sql('x')})), lambda x: x IS NOT NULL)) AS n_against FROM hypotheses)
    SELECT h.case_id, h.id, CASE WHEN coalesce(leap, false) THEN 'blocked' WHEN h.refuted OR NOT coalesce(survives, true) THEN 'refuted'
    WHEN h.confidence >= 0.7 THEN 'active' ELSE 'contested' END AS state, n_against::INT AS n_against FROM h LEFT JOIN l USING (case_id, id)""")
def hypothesis_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each hypothesis after its last verdict: blocked, refuted, active or contested."""
    h = table(spark, d, "hypotheses")
    alias = (
        h.select("case_id", "id", F.explode("merged_from").alias("m")).select("case_id", "id", clean_id(F.col("m")).alias("hyp")).filter("hyp IS NOT NULL")
        .groupBy("case_id", "hyp").agg(F.min("id").alias("survivor"))
    )
    v = table(spark, d, "verdicts").withColumn("hyp", clean_id(F.col("hypothesis_id"))).join(alias, ["case_id", "hyp"], "left")
    last = v.groupBy("case_id", F.coalesce("survivor", "hyp").alias("id")).agg(
        F.max_by("survives", F.struct("recorded_at", "verdict_id")).alias("survives"), F.bool_or(F.coalesce("unsupported_leap", F.lit(False))).alias("leap")
    )
    against = F.array_distinct(F.filter(F.transform(F.coalesce("contradicting", F.array().cast("array<string>")), clean_id), lambda x: x.isNotNull()))
    rows = h.select("case_id", "id", "confidence", F.coalesce("refuted", F.lit(False)).alias("refuted"), F.size(against).alias("n_against")).distinct()
    return rows.join(last, ["case_id", "id"], "left").select(
        "case_id", "id",
        F.when(F.coalesce("leap", F.lit(False)), "blocked").when(F.col("refuted") | ~F.coalesce("survives", F.lit(True)), "refuted")
        .when(F.col("confidence") >= 0.7, "active").otherwise("contested").alias("state"), "n_against",
    )


@query(f"""WITH u AS (SELECT case_id, id, unnest(supporting) AS x FROM hypotheses), s AS (SELECT DISTINCT case_id, id, {clean_id_sql('x')} AS ev FROM u),
    e AS (SELECT DISTINCT case_id, id AS ev FROM evidence), c AS (SELECT DISTINCT cite_id, evidence_id AS ev, file, pos FROM citations)
    SELECT s.id AS finding, s.ev AS evidence, c.cite_id, c.file FROM s JOIN e USING (case_id, ev) JOIN c USING (ev) WHERE s.ev IS NOT NULL""")
def finding_citations(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the citations of the evidence they rest on; ids without a row fall away."""
    s = table(spark, d, "hypotheses").select("case_id", F.col("id").alias("finding"), F.explode("supporting").alias("x"))
    s = s.select("case_id", "finding", clean_id(F.col("x")).alias("evidence")).filter("evidence IS NOT NULL").distinct()
    e = table(spark, d, "evidence").select("case_id", F.col("id").alias("evidence")).distinct()
    c = table(spark, d, "citations").select("cite_id", F.col("evidence_id").alias("evidence"), "file", "pos").distinct()
    return s.join(e, ["case_id", "evidence"], "left_semi").join(c, "evidence").select("finding", "evidence", "cite_id", "file")


STATES = SQL["hypothesis_states"]


@query(f"SELECT state, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM ({STATES}) GROUP BY state")
def state_tally(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses per state."""
    return hypothesis_states(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("n_cases"))


@query(f"""WITH s AS ({STATES}), t AS (SELECT case_id, id, min(left(claim, 120)) AS title, max(confidence) AS confidence, max(len(supporting)) AS n_supporting FROM hypotheses GROUP BY 1, 2),
    j AS (SELECT case_id, id, title, confidence, n_supporting::INT AS n_supporting FROM s JOIN t USING (case_id, id) WHERE state IN ('active', 'contested') AND confidence IS NOT NULL)
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, id)::INT AS rn FROM j""")
def surviving_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings that are neither refuted nor blocked, per case by confidence."""
    t = table(spark, d, "hypotheses").groupBy("case_id", "id").agg(
        F.min(F.left("claim", F.lit(120))).alias("title"), F.max("confidence").alias("confidence"), F.max(F.size("supporting")).alias("n_supporting")
    )
    rows = hypothesis_states(spark, d).filter("state IN ('active', 'contested')").select("case_id", "id").join(t, ["case_id", "id"])
    return ranked(rows.filter("confidence IS NOT NULL"), "case_id", F.desc("confidence"), F.col("id"))


@query(f"""WITH s AS ({STATES}), t AS (SELECT case_id, id, max(confidence) AS confidence FROM hypotheses GROUP BY 1, 2)
    SELECT case_id, id, state, confidence, row_number() OVER (PARTITION BY case_id ORDER BY list_position(['active', 'contested', 'blocked', 'refuted'], state), coalesce(confidence, -1) DESC, id, n_against)::INT AS rn
    FROM s JOIN t USING (case_id, id)""")
def hypothesis_board(spark: SparkSession, d: str) -> DataFrame:
    """All hypotheses of a case in the order a board shows them: by state, then by confidence."""
    t = table(spark, d, "hypotheses").groupBy("case_id", "id").agg(F.max("confidence").alias("confidence"))
    rows = hypothesis_states(spark, d).join(t, ["case_id", "id"]).select("case_id", "id", "state", "confidence", "n_against")
    place = F.array_position(F.array(*map(F.lit, ("active", "contested", "blocked", "refuted"))), F.col("state"))
    return ranked(rows, "case_id", place, F.desc(F.coalesce("confidence", F.lit(-1.0))), F.col("id"), F.col("n_against")).drop("n_against")


@query()
def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of merged claims, each id once, in order."""
    return claims.united(table(spark, d, "hypotheses"))


@query("""WITH h AS (SELECT DISTINCT case_id, id, confidence FROM hypotheses WHERE confidence IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY abs(confidence - 0.5), id, confidence) AS rn FROM h) SELECT case_id, id, confidence, rn::INT AS rn FROM r WHERE rn <= 20""")
def uncertainty_order(spark: SparkSession, d: str) -> DataFrame:
    """The twenty claims of each case whose confidence is nearest to one half."""
    h = table(spark, d, "hypotheses").filter("confidence IS NOT NULL").select("case_id", "id", "confidence").distinct()
    w = Window.partitionBy("case_id").orderBy(F.abs(F.col("confidence") - 0.5), "id", "confidence")
    return h.withColumn("rn", F.row_number().over(w)).filter("rn <= 20")


WORDS = f"list_distinct(list_filter(string_split_regex(lower(coalesce(claim, '')), '[ ]+'), lambda x: length(x) > 3 AND NOT list_contains({_list(claims.STOP)}, x)))"


@query(f"""WITH h AS (SELECT case_id, id, min(claim) AS claim, max(confidence) AS confidence FROM hypotheses GROUP BY 1, 2),
    k AS (SELECT case_id, id, confidence, unnest({WORDS}) AS word FROM h), c AS (SELECT word, count(DISTINCT case_id) AS n_cases, avg(confidence::DECIMAL(9,4)::DOUBLE) AS m, count(*) AS n FROM k GROUP BY word)
    SELECT word, n_cases, n FROM c WHERE n_cases >= 2""")
def word_stability(spark: SparkSession, d: str) -> DataFrame:
    """Words of claims, stop words left out, that come up in several cases."""
    h = table(spark, d, "hypotheses").groupBy("case_id", "id").agg(F.min("claim").alias("claim"))
    word = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("claim", F.lit(""))), "[ ]+"), lambda x: (F.length(x) > 3) & ~x.isin(claims.STOP)))
    return (
        h.select("case_id", "id", F.explode(word).alias("word")).groupBy("word")
        .agg(F.count_distinct("case_id").alias("n_cases"), F.count("*").alias("n")).filter("n_cases >= 2")
    )
