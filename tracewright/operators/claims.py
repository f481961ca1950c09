"""Claims: their stance, figures and words, which of them say the same, and merging those without losing disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut

# Marks of an accusation, of an exoneration, and words without content.
WRONGDOING = [
    "artificial", "artificially", "inflated", "inflate", "sham", "fabricated",
    "fictitious", "bogus", "improper", "improperly", "misrepresent",
    "misrepresented", "misstated", "overstated", "not genuine", "non-arm",
    "non-arms", "undisclosed", "concealed", "disguised", "scheme", "fraud",
    "fraudulent", "manipulat", "circular", "self-dealing", "round-trip",
]
INNOCENT = [
    "legitimate", "standard", "standardized", "ordinary", "customary",
    "genuine", "bona fide", "routine", "normal", "clerical", "innocent",
    "consistent with industry", "common practice", "typical", "benign",
    "good faith", "inadvertent", "error", "errors", "mistake",
]
STOP = """a an the and or of to in on for with by from as at is are was were be been
being that this these those it its their his her they them we our us you your which who
whom whose what when where how why not no nor but if then than so such can could may
might must shall should will would do does did have has had over under between during
company companies inc llc corp reported report reporting financial financials""".split()
# What a figure and a word look like.
FIGURE = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\$\s?\d[\d,.]*|\b\d+(?:\.\d+)?%"
WORD = r"[a-z][a-z\-']{2,}"
SIMILAR, MARGIN = 0.34, 2


def _marks(text: Column, marks: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, marks)), lambda k: F.contains(text, k)))


def stance(claim: Column) -> Column:
    """ASSERTS_WRONGDOING, ASSERTS_INNOCENT, NEUTRAL, or AMBIGUOUS where both kinds of marks come without a clear margin."""
    low = F.lower(F.coalesce(claim, F.lit("")))
    w, i = _marks(low, WRONGDOING), _marks(low, INNOCENT)
    return (
        F.when((w > 0) & (i == 0), "ASSERTS_WRONGDOING").when((i > 0) & (w == 0), "ASSERTS_INNOCENT").when((w == 0) & (i == 0), "NEUTRAL")
        .when(w - i >= MARGIN, "ASSERTS_WRONGDOING").when(i - w >= MARGIN, "ASSERTS_INNOCENT").otherwise("AMBIGUOUS")
    )


def words(claim: Column) -> Column:
    """Distinct content words."""
    low = F.lower(F.coalesce(claim, F.lit("")))
    return F.array_except(F.array_distinct(F.regexp_extract_all(low, F.lit(WORD), F.lit(0))), F.array(*map(F.lit, STOP)))


def figures(claim: Column) -> Column:
    """Distinct figures: amounts of 1,000 or more as whole numbers, percentages as written."""
    bare = F.transform(
        F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(FIGURE), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, "[$,]", ""))
    )
    value = lambda x: F.rtrim(x, F.lit(".")).try_cast("double")
    named = F.transform(bare, lambda x: F.when(F.endswith(x, F.lit("%")), x).when(value(x) >= 1000, F.bround(value(x)).cast("decimal(30,0)").cast("string")))
    return F.array_distinct(F.array_compact(named))


def features(claims: DataFrame, scope: str) -> DataFrame:
    """One row per different claim text of a scope: least id, highest confidence, members, stance, figures, words."""
    text = F.coalesce("claim", F.lit(""))
    return (
        claims.groupBy(F.col(scope).alias("scope"), text.alias("claim"))
        .agg(F.min("id").alias("id"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.count_distinct("id").alias("members"))
        .select("*", stance(F.col("claim")).alias("stance"), figures(F.col("claim")).alias("figures"), words(F.col("claim")).alias("words"))
    )


def rarest(rows: DataFrame, keys: list[str], kept: Column) -> DataFrame:
    """(keys, w): the words of each row that are rarest over all rows, `kept` of them.

    Words are in one order, so two rows with enough words in common share one of these; frequent words are
    no join keys unless a row has no others.
    """
    each = rows.select(*keys, F.size("words").alias("n_words"), F.explode("words").alias("w"))
    held = each.groupBy("w").agg(F.count("*").alias("held"))
    order = F.sort_array(F.collect_list(F.struct("held", "w")))
    return (
        each.join(held, "w").groupBy(*keys, "n_words").agg(order.alias("order"))
        .select(*keys, F.explode(F.slice("order", F.lit(1), F.greatest(kept, F.lit(0)))).alias("o")).select(*keys, F.col("o.w").alias("w"))
    )


def pairs(f: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(scope, a, b, n_shared, similarity): different claims of one stance that share a figure and enough words.

    The join is by (scope, stance, figure, word) over each claim's rarest words, of which similar claims share
    one, so a figure that many claims of a scope have is split by words.
    """
    rows = f.filter("stance <> 'AMBIGUOUS'").select("scope", "stance", "id", "words", "figures")
    # Of n words similar ones share at least `similar` * n.
    first = rarest(rows, ["scope", "id"], (F.col("n_words") - F.ceil(F.col("n_words") * similar - 1e-9) + 1).cast("int"))
    keyed = rows.join(first, ["scope", "id"]).select("scope", "stance", F.explode("figures").alias("figure"), "w", "id")
    met = (
        keyed.withColumnRenamed("id", "a").join(keyed.withColumnRenamed("id", "b"), ["scope", "stance", "figure", "w"])
        .filter("a < b").select("scope", "a", "b").distinct()
    )
    x = rows.select("scope", F.col("id").alias("a"), F.col("words").alias("wa"), F.col("figures").alias("fa"))
    y = rows.select("scope", F.col("id").alias("b"), F.col("words").alias("wb"), F.col("figures").alias("fb"))
    near = F.size(F.array_intersect("wa", "wb")).cast("double") / F.size(F.array_union("wa", "wb")).cast("double")
    return (
        met.join(x, ["scope", "a"]).join(y, ["scope", "b"])
        .select("scope", "a", "b", F.size(F.array_intersect("fa", "fb")).cast("long").alias("n_shared"), near.alias("similarity"))
        .filter(F.col("similarity") >= similar)
    )


def leaders(f: DataFrame, links: DataFrame, rank: Column | None = None) -> DataFrame:
    """(scope, id, leader): the greedy merge in order of confidence, or of `rank`, found in rounds over all claims at once.

    A claim leads once every better claim it pairs with has been absorbed; it is
    absorbed by the best leader it pairs with. That is what going through the
    claims one by one gives, but each round is two joins over the open claims,
    and only chains of open claims, not their number, make further rounds.
    """
    rank = F.struct(-F.col("confidence") if rank is None else rank, F.col("id"))
    both = links.select("scope", "a", "b").unionByName(links.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
    of = f.select("scope", F.col("id").alias("a"), rank.alias("ra"))
    to = f.select("scope", F.col("id").alias("b"), rank.alias("rb"))
    # From each claim to the better ones it pairs with.
    up = cut(both.join(of, ["scope", "a"]).join(to, ["scope", "b"]).filter("rb < ra").select("scope", "a", "b", "rb"))
    state = cut(
        f.select("scope", "id").join(up.select("scope", F.col("a").alias("id")).distinct().withColumn("open", F.lit(True)), ["scope", "id"], "left")
        .select("scope", "id", F.when(F.col("open").isNull(), F.col("id")).alias("leader"))
    )
    while state.filter("leader IS NULL").take(1):
        known = state.select("scope", F.col("id").alias("b"), F.col("leader").alias("lead"))
        seen = up.join(known, ["scope", "b"]).groupBy("scope", F.col("a").alias("id")).agg(
            F.min(F.when(F.col("lead") == F.col("b"), F.struct("rb", "b"))).alias("best"),
            F.min(F.when(F.col("lead").isNull(), F.col("rb"))).alias("wait"),
        )
        # A leader is final for a claim only if no better claim it pairs with is still open.
        settled = (
            F.when(F.col("best").isNotNull() & (F.col("wait").isNull() | (F.col("best.rb") < F.col("wait"))), F.col("best.b"))
            .when(F.col("best").isNull() & F.col("wait").isNull(), F.col("id"))
        )
        state = cut(state.join(seen, ["scope", "id"], "left").select("scope", "id", F.coalesce("leader", settled).alias("leader")))
    return state


def stable(findings: DataFrame, overlap: int = 4) -> DataFrame:
    """Findings of several runs (run, n, title, confidence) in clusters of like titles: (leader, runs, mean).

    A finding joins the first cluster whose first member shares `overlap` words with it. Titles meet by their
    rarest words, of which those with enough words in common share one. Meant for the findings of runs, of
    which there are few: titles of one template all pair up with each other.
    """
    word = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(STOP)))
    rows = findings.select(F.lit("").alias("scope"), F.format_string("%012d-%06d", "run", "n").alias("id"), "run", "confidence", word.alias("words"))
    first = rarest(rows, ["id"], F.col("n_words") - overlap + 1)
    met = first.withColumnRenamed("id", "a").join(first.withColumnRenamed("id", "b"), "w").filter("a < b").select("a", "b").distinct()
    words_of = lambda key, name: rows.select(F.col("id").alias(key), F.col("words").alias(name))
    both = met.join(words_of("a", "wa"), "a").join(words_of("b", "wb"), "b").filter(F.size(F.array_intersect("wa", "wb")) >= overlap)
    links = both.select(F.lit("").alias("scope"), "a", "b")
    lead = leaders(rows.select("scope", "id", F.lit(0.0).alias("confidence")), links)
    return rows.join(lead, ["scope", "id"]).groupBy("leader").agg(F.count_distinct("run").alias("runs"), F.avg("confidence").alias("mean"))


def united(claims: DataFrame, scope: str = "case_id") -> DataFrame:
    """(scope, leader, field, n, ref): the evidence of merged claims, each id once, the leader's own first.

    Ids compare without regard to case and blanks; `n` numbers them within the field.
    """
    rows = _members(claims, scope)
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ids")) for f in ("supporting", "contradicting")])
    refs = rows.select("scope", "leader", F.struct(F.col("rep") != F.col("leader"), -F.coalesce("confidence", F.lit(0.0)), F.col("id")).alias("at"), F.explode(lists).alias("r"))
    refs = refs.select("scope", "leader", "at", "r.field", F.posexplode("r.ids").alias("pos", "ref")).filter("ref IS NOT NULL AND trim(ref) <> ''")
    once = refs.groupBy("scope", "leader", "field", F.lower(F.trim("ref")).alias("key")).agg(F.min(F.struct("at", "pos", "ref")).alias("r"))
    n = F.row_number().over(Window.partitionBy("scope", "leader", "field").orderBy("r"))
    return once.select(F.col("scope").alias(scope), "leader", "field", n.alias("n"), F.col("r.ref").alias("ref"))


def _members(claims: DataFrame, scope: str) -> DataFrame:
    """Claims with their class's least id `rep` and the `leader` it is merged into."""
    f = cut(features(claims, scope))
    lead = leaders(f, pairs(f)).withColumnRenamed("id", "rep")
    return (
        claims.withColumn("claim", F.coalesce("claim", F.lit(""))).withColumnRenamed(scope, "scope")
        .join(f.select("scope", "claim", F.col("id").alias("rep")), ["scope", "claim"]).join(lead, ["scope", "rep"])
    )


def merged(claims: DataFrame, scope: str = "case_id") -> DataFrame:
    """Consolidated claims: evidence united without regard to case and blanks, the highest confidence kept, absorbed ids listed."""
    rows = _members(claims, scope)
    key = lambda x: F.lower(F.trim(x))
    refs = rows.select("scope", "leader", F.explode(F.array(
        F.struct(F.lit("supporting").alias("field"), F.col("supporting").alias("ids")),
        F.struct(F.lit("contradicting").alias("field"), F.col("contradicting").alias("ids")),
    )).alias("r")).select("scope", "leader", "r.field", F.explode("r.ids").alias("ref")).filter("ref IS NOT NULL AND trim(ref) <> ''")
    united = (
        refs.select("scope", "leader", "field", key(F.col("ref")).alias("ref")).distinct()
        .groupBy("scope", "leader").agg(
            F.count_if(F.col("field") == "supporting").alias("n_supporting"), F.count_if(F.col("field") == "contradicting").alias("n_contradicting")
        )
    )
    return (
        rows.groupBy("scope", "leader").agg(F.max("confidence").alias("confidence"), (F.count_distinct("id") - 1).alias("n_absorbed"))
        .join(united, ["scope", "leader"], "left")
        .select(F.col("scope").alias(scope), F.col("leader").alias("id"), "confidence", "n_absorbed", F.coalesce("n_supporting", F.lit(0)).alias("n_supporting"), F.coalesce("n_contradicting", F.lit(0)).alias("n_contradicting"))
    )
