"""Operators of the core against brute force and on hand-made fixtures."""

import json
import math
import random
import re
from collections import Counter
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tracewright.functions import records
from tracewright.functions import text as T
from tracewright.operators import bands, claims, extract, panel, passages, verify
from tracewright.operators.bands import band_pairs
from tracewright.plans import ledger
from tracewright.plans import verify as checks
from tracewright.sources import corpus, filed

# Functions


def values(spark, expr, xs, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in xs], schema).select(expr(F.col("x"))).collect()]


def test_text_functions(spark):
    assert values(spark, T.compared, ["A  b\r\n c ", None, "​"]) == ["a b c", None, "​"]
    assert values(spark, T.clean_id, [" e-1\t", " ", None]) == ["E-1", None, None]
    assert values(spark, T.number, ["$1,234.50", "x", None]) == [1234.5, None, None]
    assert values(spark, T.significant_digits, ["50,000", "2,718,281", "1,260,000", "0"]) == [1, 7, 3, 1]
    assert values(spark, T.squashed, ["Cust Corp."]) == ["custcorp"]
    assert values(spark, T.leading_date, ["2020-01-02_8-K.txt", "x"]) == ["2020-01-02", ""]


REPLIES = [
    ('{"a": 1}', '{"a":1}'), ("```json\n{\"a\": 1}\n```", '{"a":1}'), ('Sure: {"a": {"b": "}"}} done', '{"a":{"b":"}"}}'),
    ('{"a": [1, 2,],}', '{"a":[1,2]}'), ("no object", None), ("", None), (None, None), ("{broken", None),
    ('{"q": "say \\"hi\\" {"}', '{"q":"say \\"hi\\" {"}'), ('text } before {"a": null}', '{"a":null}'), ('{"s": "a,]", "t": [",}",],}', '{"s":"a,]","t":[",}"]}'),
    ('first {"a": 1} then {"b": 2}', '{"a":1}'), ("x ```\nnothing\n``` {\"c\": 3}", '{"c":3}'), ("```\n{\"d\": 4}\n``` {\"c\": 3}", '{"d":4}'),
]


def test_extract_json(spark):
    assert values(spark, records.extract_json, [r for r, _ in REPLIES]) == [e for _, e in REPLIES]


# Sources


def test_texts_manifest_and_pages(spark, tmp_path):
    (tmp_path / "2020-01-02_8-K_1.txt").write_bytes("SOURCE: u\nFORM: 8-K\n\nBody é".encode() + b"\xff")
    (tmp_path / "skip.md").write_text("x")
    rows = corpus.read_texts(spark, str(tmp_path)).collect()
    assert [(r.file, r.text[:9], r.text[-1]) for r in rows] == [("2020-01-02_8-K_1.txt", "SOURCE: u", "�")]
    listed = spark.createDataFrame([("C", "1", "f", "8-K", "2020", "u", 3), ("C", "1", "e", None, None, "u", None)], "company string, cik string, file string, form string, filed string, url string, chars long")
    corpus.write_manifest(listed, str(tmp_path / "m"))
    got = corpus.read_manifest(spark, str(tmp_path / "m" / "*.json"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in listed.collect()}
    two = listed.unionByName(spark.createDataFrame([("D", "2", "g", "8-K", "2020", "u", 3)], listed.schema))
    corpus.write_manifest(two.coalesce(1), str(tmp_path / "two"))
    assert {tuple(r) for r in corpus.read_manifest(spark, str(tmp_path / "two"), lines=True).collect()} == {tuple(r) for r in two.collect()}
    page = "<html><head><style>x{}</style></head><body><p>One</p><script>no()</script>\n\n\n\n<p>Two &amp;  three</p></body></html>"
    assert corpus.page_text(page) == "One\n\nTwo & three" and corpus.page_text(None) is None and corpus.page_text("") == ""
    cat = spark.createDataFrame([("c", ["8-K", "10-K"], ["d1", "d2"])], "cik string, form array<string>, filed array<string>")
    assert [tuple(r) for r in corpus.catalogue(cat, "form", "filed").collect()] == [("c", "8-K", "d1"), ("c", "10-K", "d2")]


@pytest.mark.parametrize(("a", "b"), [("8K", "8-K"), ("10-q ", "10-Q"), ("S1/A", "S-1/A"), ("NT 10K", "NT 10-K"), ("def 14a ", "DEF 14A"), (None, None)])
def test_clean_form(spark, a, b):
    assert values(spark, corpus.clean_form, [a]) == [b]


# Verification


def test_verdicts(spark):
    docs = spark.createDataFrame([("f.txt", "The Company\n received  units of Acme LLC as payment."), ("g.txt", None)], "file string, text string")
    cites = spark.createDataFrame(
        [
            (1, "E1", "dir/f.txt", "received units OF Acme LLC"), (2, "E1", "x.txt", "a"), (3, "E2", "f.txt", " "), (4, "E2", None, "a"),
            (5, "E3", "f.txt", "the company received unjts of acme llc as payment"), (6, "E3", "f.txt", "zzzz qqqq"), (6, "E3", "f.txt", "zzzz qqqq"), (7, "E4", "g.txt", "a"),
        ],
        "cite_id long, evidence_id string, file string, quote string",
    )
    checked = verify.checked(cites, docs)
    got = {r.cite_id: r.found for r in checked.collect()}
    assert got == {1: "EXACT", 2: "BAD_FILE", 3: "NOT_FOUND", 4: "BAD_FILE", 5: "FUZZY", 6: "NOT_FOUND", 7: "NOT_FOUND"}
    acc = verify.accuracy(checked).first()
    assert (acc.checked, acc.exact, acc.fuzzy, acc.bad_file, acc.not_found) == (7, 1, 1, 2, 3) and acc.accuracy == pytest.approx(2 / 7)
    ev = spark.createDataFrame([("E1", "DIRECT"), ("E2", "DIRECT"), ("E3", "INFERRED"), ("E9", None)], "id string, tier string")
    s = {r.id: tuple(r)[1:] for r in verify.screened(ev, checked).collect()}
    assert s == {"E1": ("DIRECT", 1, 1, None), "E2": ("INFERRED", 0, 2, "unverifiable_citation"), "E3": ("INFERRED", 1, 1, None), "E9": (None, 0, 0, None)}
    assert verify.checked(cites.limit(0), docs).count() == 0


def test_similarity_is_that_of_the_best_window():
    r = random.Random(1)
    words = ["income", "units", "of", "the", "portal", "fee", "was", "paid", "in", "full", "a"]
    reached = 0
    for k in range(300):
        t = " ".join(r.choices(words, k=r.randint(0, 60))) if k % 2 else "".join(r.choice("abc ") for _ in range(r.randint(0, 80)))
        at = r.randint(0, max(0, len(t) - 30))
        q = list(t[at : at + r.randint(3, 60)] or "x")
        for _ in range(r.randint(0, max(1, len(q) // 6))):
            q[r.randrange(len(q))] = r.choice(["", "z", "ab"])
        q = "".join(q) or "x"
        step = r.choice([1, 3, max(1, len(q) // 2)])
        best = max(SequenceMatcher(None, q, t[i : i + len(q)]).ratio() for i in range(0, max(1, len(t) - len(q)), step))
        got = verify.similarity(q, t, step)
        assert (best >= 0.85) == (got is not None and got >= 0.85), (q, t)
        if best >= 0.85:
            reached += 1
            assert got == best
    assert reached > 30


def test_screen_keeps_fuzzy_citations(spark, medium):
    checked = verify.checked(spark.read.parquet(f"{medium}/citations.parquet"), spark.read.parquet(f"{medium}/documents.parquet")).cache()
    fuzzy = checked.filter("found = 'FUZZY' AND evidence_id IS NOT NULL").count()
    kept = {f.__name__: f(spark, medium).agg(F.sum("kept")).first()[0] for f in (checks.evidence_screen, checks.evidence_screen_exact)}
    per_evidence = spark.read.parquet(f"{medium}/evidence.parquet").join(checked.filter("found = 'FUZZY'"), F.col("id") == F.col("evidence_id")).count()
    assert fuzzy > 30 and kept["evidence_screen"] == kept["evidence_screen_exact"] + per_evidence
    acc = checks.citation_accuracy(spark, medium).first()
    assert acc.fuzzy == checked.filter("found = 'FUZZY'").count() and acc.accuracy == acc.score == (acc.exact + acc.fuzzy) / acc.checked


# Extraction


def test_engagements(spark):
    deal = "In May 2021 the Company received 2,718,281 units of {} as a payment\nfor services. This satisfied an accounts receivable balance of $1,260,000. The units are valued at $0.41 per unit."
    later = "We received 2,718,281 units of North Barn LLC (the deal) as noted."
    cash = "The company signed a consulting agreement with Bluemere, Inc. for a $40,000 fee over a 5-month period. More."
    docs = spark.createDataFrame(
        [("2020-01-01_a.txt", later), ("2021-01-01_b.txt", "First. " + deal.format("NorthBarn LLC")), ("2022-01-01_c.txt", cash), ("d", None), ("e", "")], "file string, text string"
    )
    rows = extract.engagements(docs)
    got = {(r.file, r.settled_in): r for r in rows.collect()}
    assert len(got) == 3
    b = got["2021-01-01_b.txt", "equity"]
    assert (b.party, b.units, b.consideration, b.unit_price) == ("NorthBarn LLC", 2718281.0, 1260000.0, 0.41)
    assert b.quote.startswith("In May 2021") and b.quote.endswith("$1,260,000.")
    assert got["2022-01-01_c.txt", "cash"].party == "Bluemere, Inc" and got["2022-01-01_c.txt", "cash"].consideration == 40000.0
    reg = {r.key: r for r in extract.register(rows).collect()}
    barn = reg["northbarnllc"]
    assert (barn.party, barn.file, barn.consideration, barn.unit_price, barn.filing_count) == ("North Barn LLC", "2020-01-01_a.txt", 1260000.0, 0.41, 2)
    assert extract.engagements(docs, own="northbarn|north barn").count() == 1
    assert extract.engagements(docs.limit(0)).count() == 0


def test_matches_tell_equal_matches_apart(spark):
    docs = spark.createDataFrame([("f", "ab xx ab yy ab")], "file string, text string")
    rows = extract.matches(docs, "ab", {}).select("k", "start", extract.tail(3).alias("t"), extract.before(2).alias("b")).collect()
    assert [tuple(r) for r in sorted(rows)] == [(0, 0, " xx", ""), (1, 6, " yy", "x "), (2, 12, "", "y ")]


def test_repeated_statements_each_have_their_place(spark, tmp_path):
    share = "Ulmo Harbor LLC and Fenn Works Inc. together made up 31.5% of quarterly income, against 28.0%"
    deal = "Ulmo Harbor LLC handed over 1,200 preferred units against an open fee of $45,000, which the board priced at $1.25 each"
    rate = "Rates run from ${} to $90,000 per raise; Fenn Works Inc. was charged $50,000"
    texts = {
        "a": f"On March 1, 2020 {share}. {'x ' * 200}On June 2, 2021 {share}. {share}. " + "y " * 200 + share,
        "b": f"{deal}. {rate.format('10,000')}. {'x ' * 700}{deal}. {deal}. {rate.format('20,000')}. {'y ' * 700}{deal}",
        "c": f"May 3, 2019 {share} {deal}",
    }
    spark.createDataFrame(list(texts.items()), "file string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(pattern, of):
        flat = {f: " ".join(t.split()) for f, t in texts.items()}
        return sorted((f, k, of(t, m)) for f, t in flat.items() for k, m in enumerate(re.finditer(pattern, t)))

    rates = re.compile(extract.FILINGS["rate"].replace(extract.NAME, "[A-Z].*?"))
    periods = brute(re.escape(share), lambda t, m: (re.findall(extract.FILINGS["date"], t[max(0, m.start() - 300) : m.start()]) or [""])[-1])
    lows = brute(re.escape(deal), lambda t, m: (rates.findall(t[m.end() : m.end() + 1200]) or [(None,)])[0][0])
    assert [p for _, _, p in periods] == ["March 1, 2020", "June 2, 2021", "June 2, 2021", "", "May 3, 2019"]
    assert [x for _, _, x in lows] == ["10,000", "20,000", "20,000", None, None]
    assert sorted(tuple(r) for r in ledger.preceding_period(spark, str(tmp_path)).collect()) == periods
    assert sorted(tuple(r) for r in ledger.trailing_rate(spark, str(tmp_path)).collect()) == lows


def test_facts_come_from_one_scan(spark):
    deal = "Ulmo Harbor LLC handed over 1,200 preferred units against an open fee of $45,000, which the board priced at $1.25 each"
    share = "Ulmo Harbor LLC and Fenn Works Inc. together made up 31.5% of quarterly income, against 28.0%"
    cut = "Restated income for fiscal 2021 fell by $5,000 to $7,000, after Fenn Works Inc. was taken out of the count"
    docs = spark.createDataFrame([("a", f"{deal}. {share}.\n{deal}; {cut}.", 1, "x"), ("b", None, 1, "x"), ("c", "", 1, "x"), ("d", f"together {cut}", 1, "x")], "file string, text string, k int, kind string")
    got = sorted((r.file, r.kind, r.k, r.party, r.other, r.amount, r.low, r.year) for r in extract.facts(docs).collect())
    assert got == sorted([
        ("a", "equity", 0, "Ulmo Harbor LLC", None, 45000.0, None, None), ("a", "equity", 1, "Ulmo Harbor LLC", None, 45000.0, None, None),
        ("a", "concentration", 0, "Ulmo Harbor LLC", "Fenn Works Inc.", None, None, None),
        *[(f, "restated", 0, "Fenn Works Inc.", None, 5000.0, 7000.0, "2021") for f in "ad"],
    ], key=lambda r: r[:3])
    flat = docs.select("file", "text")
    one = extract.scan(flat, {"equity": extract.FILINGS["equity"]}, extract.WORDS).select("file", "k", "start", "m")
    assert one.exceptAll(extract.matches(flat, extract.FILINGS["equity"], {}).select("file", "k", "start", "m")).count() == 0 and one.count() == 2
    assert extract.facts(docs.limit(0)).count() == 0
    r = ledger.against_reported(extract.facts(docs)).first()
    assert (r.year, r.reported, r.excluded_total, r.n_excluded, r.residual, r.equity_share) == ("2021", 12000.0, 5000.0, 1, 12000.0, 0.0)


def test_quote(spark):
    t = "First one. Second with 5,000 units; and more. Third."
    at = lambda t, x: (t, t.index(x), t.index(x) + len(x))
    rows = [at(t, "5,000"), at(t, "First"), at(t, "Third"), at(t, "Second"), at(t, "one. Second"), at("x" * 1000, "x" * 10), at(f"{'y ' * 500}end", "end"), at("One; Two. Three", "Two.")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, a int, b int").select(extract.quote(F.col("t"), F.col("a"), F.col("b"))).collect()]
    second = "Second with 5,000 units; and more."
    assert got[:5] == [second, "First one.", "Third.", second, f"First one. {second}"]
    assert len(got[5]) == 400 and got[6] == ("y " * 500 + "end")[-400:].strip() and got[7] == "Two."


def test_absence_referents(spark):
    docs = spark.createDataFrame(
        [("2020_10-K_1.txt", "Filed by TallyWell LLC."), ("2021_NT10-K_2.txt", "Nothing."), ("2022_8-K_3.txt", None)], "file string, text string"
    )
    c = spark.createDataFrame(
        [
            ("1", "The Form 10-K filings are absent from the corpus."), ("2", "The details of TallyWell LLC are absent."),
            ("3", "TallyWell LLC may not be included."), ("4", "Absentia Inc. is absent."), ("5", None), ("6", "Form 10-Q filings cannot be found."),
        ],
        "id string, claim string",
    )
    got = {r.id: (r.kind, r.referent, r.severity, r.n_files) for r in extract.absence_referents(c, docs).collect()}
    assert got == {"1": ("form", "Form 10-K", "HARD", 2), "2": ("entity", "TallyWell LLC", "SOFT", 1)}


@pytest.mark.parametrize("tolerance", [0.005, 0.02])
def test_band_pairs(spark, tolerance):
    r = random.Random(3)
    vals = [round(r.uniform(900, 1100), 2) for _ in range(200)] + [1000.0, 1000.0, 1005.0, 0.0, -5.0, None]
    rows = list(enumerate(vals))
    got = {(x.a, x.b) for x in band_pairs(spark.createDataFrame(rows, "k int, v double"), "v", "k", tolerance).collect()}
    ok = [(k, v) for k, v in rows if v and v > 0]
    assert got == {(a, b) for a, v in ok for b, w in ok if v < w and w - v <= v * tolerance}

def test_band_pairs_of_repeated_values(spark, monkeypatch):
    """All pairs of keys come out, of repeated, absent and endless values too, with buckets in one piece and split."""
    r = random.Random(4)
    vals = [900 + r.randrange(60) / 10 for _ in range(400)] + [903.0] * 300 + [math.inf, math.nan, -1.0, 0.0, None]
    rows = [(f"k{i}", v) for i, v in enumerate(vals)] + [(None, 903.0), ("k0", vals[0])]
    ok = [(k, v) for k, v in rows if v and 0 < v < math.inf]
    want = Counter((a, b, v, w) for a, v in ok for b, w in ok if v < w and w - v <= v * 0.001)
    df = spark.createDataFrame(rows, "k string, v double")
    for limits in ((64, 1 << 23, 1 << 24), (3, 500, 2000)):
        for name, x in zip(("LIST", "BLOCK", "TASK"), limits):
            monkeypatch.setattr(bands, name, x)
        assert Counter(tuple(x) for x in band_pairs(df, "v", "k", 0.001).collect()) == want


def test_band_pairs_are_spread(spark):
    """Pairs of few keys, which are many all the same, are made by all tasks."""
    rows = spark.range(2000).select(F.col("id").alias("k"), (900 + F.col("id") % 1000 / 10).alias("v"))
    by = [x["count"] for x in band_pairs(rows, "v", "k", 0.001).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by) == 35820 and max(by) < 0.4 * sum(by)


# Panel

CLEAN = dict(revenue=10.0, cogs=4.0, receivables=1.0, assets=20.0, current_assets=8.0, ppe=6.0, securities=1.0, cfo=2.0, net_income=1.5, current_liabilities=3.0, liabilities=6.0, ltd=2.0, sga=2.0, depreciation=1.0)


def test_scores(spark):
    rows = [("a", date(2020, 12, 31), CLEAN), ("a", date(2021, 12, 31), CLEAN), ("b", date(2020, 12, 31), CLEAN), ("b", date(2022, 12, 31), CLEAN | {"receivables": None, "net_income": 9.0, "cfo": -5.0})]
    facts = spark.createDataFrame(
        [(e, panel.TAGS[m][0], None, d, v, "10-K", "FY", 0) for e, d, y in rows for m, v in y.items() if v is not None],
        "entity string, tag string, start date, end date, val double, form string, fp string, seq int",
    )
    p = panel.panel(panel.annual_series(facts))
    assert p.count() == 4
    got = {r.entity: r for r in panel.m_score(panel.years(p, 0)).collect()}
    # Equal years: every index is 1 but accruals, which are (1.5 - 2) / 20.
    expected = -4.84 + 0.920 + 0.528 + 0.404 + 0.892 + 0.115 - 0.172 + 4.679 * (-0.5 / 20) - 0.327
    assert got["a"].m_score == pytest.approx(expected) and not got["a"].flagged and got["a"].unavailable == ""
    assert got["b"].unavailable == "DSRI" and got["b"].dominant_driver == "TATA" and got["b"].flagged and got["b"].prior_end == date(2020, 12, 31)
    assert {r.entity for r in panel.years(p).filter("skipped").collect()} == {"a", "b"}
    acc = {(r.entity, r.end.year): r for r in panel.accruals(p).collect()}
    assert acc["b", 2022].profit_without_cash and acc["b", 2022].gap == 14.0 and acc["b", 2022].gap_over_revenue == 1.4


def test_annual_series_rules(spark):
    d = date
    facts = spark.createDataFrame(
        [
            ("a", "RevenueFromContractWithCustomerExcludingAssessedTax", d(2020, 1, 1), d(2020, 12, 31), 7.0, "10-K", "FY", 0),
            ("a", "Revenues", d(2021, 1, 1), d(2021, 12, 31), 5.0, "10-K", "FY", 1), ("a", "Revenues", d(2021, 1, 1), d(2021, 12, 31), -6.0, "10-K", "FY", 2),
            ("a", "Revenues", d(2021, 10, 1), d(2021, 12, 31), 99.0, "10-K", "FY", 3), ("a", "Revenues", d(2021, 1, 1), d(2021, 12, 31), 99.0, "10-Q", "FY", 4),
        ],
        "entity string, tag string, start date, end date, val double, form string, fp string, seq int",
    )
    assert [tuple(r) for r in panel.annual_series(facts).collect()] == [("a", "revenue", d(2021, 12, 31), -6.0)]


def test_quarters(spark):
    d = date
    q = lambda s, e, v, form="10-Q", seq=0: ("a", "Revenues", s, e, v, form, "", seq)
    facts = spark.createDataFrame(
        [
            q(d(2021, 1, 1), d(2021, 3, 31), 1.0), q(d(2021, 1, 1), d(2021, 3, 31), 2.0, seq=1), q(d(2021, 4, 1), d(2021, 6, 30), 3.0), q(d(2021, 1, 1), d(2021, 9, 30), 9.0),
            q(d(2021, 1, 1), d(2021, 12, 31), 20.0, "10-K"), q(d(2022, 1, 1), d(2022, 3, 31), 5.0, "8-K"),
        ],
        "entity string, tag string, start date, end date, val double, form string, fp string, seq int",
    )
    got = sorted((r.end, r.revenue, r.derived) for r in panel.quarters(facts).collect())
    assert got == [(d(2021, 3, 31), 2.0, False), (d(2021, 6, 30), 3.0, False), (d(2021, 12, 31), 11.0, True)]
    t = {(r.end, r.months): r.revenue for r in panel.trailing(panel.quarters(facts)).collect()}
    assert t[d(2021, 12, 31), 9] == 16.0 and t[d(2021, 6, 30), 6] == 5.0 and t[d(2021, 6, 30), 9] is None
    shares = spark.createDataFrame([("a", "X", d(2021, 6, 30), 3, 50.0), ("a", "X", d(2021, 6, 30), 6, 40.0), ("a", "Y", d(2020, 1, 1), 3, 9.0)], "entity string, party string, end date, months int, pct double")
    v = panel.valued(shares, panel.trailing(panel.quarters(facts))).collect()
    assert [(r.party, r.months, r.value) for r in v] == [("X", 6, 2.0)]


# Passages


def brute_select(text, terms, budget, window, head):
    """The excerpt by going through the windows one by one."""
    if len(text) <= budget:
        return "full", text
    low, spans = text.lower(), []
    for t in terms:
        at = -1
        for _ in range(6 if len(t) >= 4 else 0):
            at = low.find(t, at + 1 if at < 0 else at + len(t))
            if at < 0:
                break
            spans.append((at, at + len(t)))
    if not spans:
        return "head", text[:budget]

    def union(ws):
        out = []
        for lo, hi in sorted(ws):
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return out

    wins = union([(max(0, a - window), min(len(text), b + window)) for a, b in spans])
    keep, used = [(0, head)], head
    for lo, hi in sorted(wins, key=lambda w: (-sum(w[0] <= a < w[1] for a, _ in spans), w[0])):
        take = min(hi - lo, budget - used)
        if take <= 0:
            break
        keep.append((lo, lo + take))
        used += take
    out, before = "", 0
    for lo, hi in union(keep):
        out += (f"\n[... {lo - before:,} characters omitted ...]\n" if lo > before else "") + text[lo:hi]
        before = hi
    return "windows", out + (f"\n[... {len(text) - before:,} characters omitted ...]\n" if before < len(text) else "")


def test_excerpts_equal_brute_force(spark):
    r = random.Random(5)
    terms = ["needle", "Alpha", "x.y+", "abc"]
    texts = ["".join(r.choice(["lorem ipsum ", "needle ", "ALPHA. ", "x.y+ ", "ééé "] if i % 3 else ["lorem ipsum "]) for _ in range(r.randint(1, 400))) for i in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (98, None), (99, "")], "doc_id long, text string")
    got = {x.doc_id: (x.mode, x.excerpt) for x in passages.excerpts(df, terms, 600, 40, 50).collect()}
    assert got == {i: brute_select(t, [x.lower() for x in terms], 600, 40, 50) for i, t in [*enumerate(texts), (99, "")]}


def test_needle_deep_in_a_long_text(spark):
    text = "x" * 302_971 + " 2,718,281 units " + "y" * 17_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = passages.excerpts(df, ["2,718,281"]).first()
    assert "2,718,281 units" in r.excerpt and r.mode == "windows"


def test_query_terms(spark):
    got = values(spark, passages.query_terms, ["Identify what 2,718,281 Units and units of NorthBarn in 2021", ""])
    assert got == [["2,718,281", "units", "northbarn"], []]


# Claims


def brute_leaders(rows, pairs):
    """Greedy merging in order of confidence."""
    kept, lead = [], {}
    for i, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        lead[i] = next((k for k in kept if frozenset((i, k)) in pairs), i)
        if lead[i] == i:
            kept.append(i)
    return lead


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_greedy_merging(spark, seed):
    r = random.Random(seed)
    rows = [(f"h{i:02}", r.choice([0.1, 0.5, 0.9])) for i in range(40)]
    pairs = {tuple(sorted(r.sample([x for x, _ in rows], 2))) for _ in range(60)}
    f = spark.createDataFrame([("s", *x) for x in rows], "scope string, id string, confidence double")
    p = spark.createDataFrame([("s", *x) for x in pairs], "scope string, a string, b string")
    got = {x.id: x.leader for x in claims.leaders(f, p).collect()}
    assert got == brute_leaders(rows, {frozenset(x) for x in pairs})


STANCES = [
    ("Income was artificial and inflated", "ASSERTS_WRONGDOING"), ("This is ordinary practice", "ASSERTS_INNOCENT"), ("Revenue rose", "NEUTRAL"), (None, "NEUTRAL"),
    ("The standard practice was a scheme", "AMBIGUOUS"), ("A sham, bogus, fictitious but routine deal", "ASSERTS_WRONGDOING"),
]


def test_claim_features(spark):
    assert values(spark, claims.stance, [c for c, _ in STANCES]) == [s for _, s in STANCES]
    got = values(spark, claims.figures, ["$1,260,000 or 1,260,000, 37% of 12 in $999.", None, "$2,500.5 and 45.5%"])
    assert got == [["1260000", "37%"], [], ["2500", "45.5%"]]
    assert values(spark, claims.words, ["The self-dealing of Acme Inc was large"]) == [["self-dealing", "acme", "large"]]


def test_merging_keeps_disagreement(spark):
    base = "Income of $1,260,000 from units was {} across several filings"
    rows = [
        ("h1", "c", base.format("artificial"), 0.9, ["E1", "e2 "], None), ("h2", "c", base.format("an artificial amount"), 0.4, ["E2"], ["E3"]),
        ("h3", "c", base.format("ordinary"), 0.8, None, None), ("h4", "d", base.format("artificial"), 0.2, [], []), ("h5", "c", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, case_id string, claim string, confidence double, supporting array<string>, contradicting array<string>")
    got = {(r.case_id, r.id): tuple(r)[2:] for r in claims.merged(df).collect()}
    assert got == {("c", "h1"): (0.9, 1, 2, 1), ("c", "h3"): (0.8, 0, 0, 0), ("d", "h4"): (0.2, 0, 0, 0), ("c", "h5"): (None, 0, 0, 0)}
    assert claims.merged(df.limit(0)).count() == 0


def test_united_evidence_keeps_order(spark):
    base = "Income of $1,260,000 from units was {} across several filings"
    rows = [("h1", "c", base.format("artificial"), 0.4, ["E9", " e2"], None), ("h2", "c", base.format("an artificial sum"), 0.9, ["E2", "", "E1", None], None)]
    df = spark.createDataFrame(rows, "id string, case_id string, claim string, confidence double, supporting array<string>, contradicting array<string>")
    got = sorted((r.n, r.ref, r.leader) for r in claims.united(df).collect())
    assert got == [(1, "E2", "h2"), (2, "E1", "h2"), (3, "E9", "h2")]


def test_stable_findings(spark):
    rows = [(1, 0, "Artificial portal income from equity deals", 0.8), (1, 1, "Routine fees", 0.5), (2, 0, "Equity deals made artificial portal income", 0.6), (3, 0, None, 0.1)]
    got = sorted((r.runs, round(r.mean, 6)) for r in claims.stable(spark.createDataFrame(rows, "run int, n int, title string, confidence double")).collect())
    assert got == [(1, 0.1), (1, 0.5), (2, 0.7)]


def test_filed_facts(spark, tmp_path):
    fact = {"start": "2021-01-01", "end": "2021-12-31", "val": 5, "form": "10-K", "fp": "FY"}
    (tmp_path / "f.json").write_text(json.dumps({"cik": "1", "entityName": "A", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact]}}, "Other": {"units": {"EUR": [fact]}}}}}))
    (tmp_path / "c.json").write_text(json.dumps({"cik": "1", "tag": "Revenues", "units": {"USD": [fact, fact | {"start": None}]}}))
    facts = filed.read_company_facts(spark, str(tmp_path / "f.json"))
    assert [tuple(r) for r in facts.collect()] == [("A", "Revenues", date(2021, 1, 1), date(2021, 12, 31), 5.0, "10-K", "FY", 0)]
    assert filed.read_concept(spark, str(tmp_path / "c.json")).count() == 2
    assert panel.annual_series(facts).count() == 1
    filed.write_runs(facts.select("tag", "val"), str(tmp_path / "runs"))
    assert filed.read_runs(spark, str(tmp_path / "runs")).collect() == [("Revenues", 5.0)]


PERIODS = [
    ("six-month period ended October 31, 2023", (date(2023, 10, 31), 6)), ("fiscal year ended April 30, 2022", (date(2022, 4, 30), 12)),
    ("three months ended July 31, 2021", (date(2021, 7, 31), 3)), ("period ended July 31, 2021", None), ("year ended Foo 31, 2021", None), ("", None), (None, None),
]


def test_period_window(spark):
    got = values(spark, filed.period_window, [p for p, _ in PERIODS])
    assert [tuple(g) if g else None for g in got] == [e for _, e in PERIODS]


def test_widest_object(spark):
    got = values(spark, lambda c: F.to_json(records.widest_object(c)), ['x {"a": {"b": 1}} y', "none", "{bad", None])
    assert got == ['{"a":{"b":1}}', None, None, None]


def test_aliases(spark):
    name, alias = r"[A-Z][A-Za-z]+ (?:LLC|Inc)", extract.DISCLOSURE["alias"]
    docs = spark.createDataFrame(
        [("a", 'NorthBarn LLC ("North") and SeeMore LLC ("SM") and Acme Inc ("the Company") and Zed LLC ("Unrelated")'), ("b", 'Other LLC ("SM")'), ("c", "The SM stake; smx, Northline"), ("d", None)],
        "file string, text string",
    )
    known = extract.aliases(docs, name, alias)
    assert {tuple(r) for r in known.collect()} == {("north", "NorthBarn LLC"), ("sm", "SeeMore LLC")}
    got = {tuple(r) for r in extract.alias_mentions(docs, known).collect()}
    assert got == {("a", "NorthBarn LLC"), ("a", "SeeMore LLC"), ("b", "SeeMore LLC"), ("c", "SeeMore LLC")}
