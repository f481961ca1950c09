"""Problems 2, 6, 7 and 8 against brute force, libraries and on their edge cases."""

import random
import re
import sys
import unicodedata
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from tracewright.llm import leaks, pieces, queries, textform, tokens

DOCS = "doc_id long, text string, lang string, source string, file string, form string, ids int, item_id long"


def documents(folder):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}


def make(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", f"f{i}", "x", 1, 2) for i, t in enumerate(texts)], DOCS)


# Problem 2


def test_cut_kinds_equal_definition(spark, medium):
    got = {r.doc_id: r.cut for r in queries.p2_found(spark, medium).collect()}
    assert got == {
        d: "forced" if max(map(len, re.split(r"\s+", t))) > 8000 else "natural" for d, t in documents(medium).items() if t and len(t) > 8000
    }


def test_pieces_cover_the_text(spark, medium):
    by = defaultdict(list)
    for r in queries.p2_pieces(spark, medium).collect():
        by[r.doc_id].append(r)
    texts = {d: t for d, t in documents(medium).items() if t}
    assert by.keys() == texts.keys()
    for d, t in texts.items():
        at = 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert r.piece == k and r.text == t[r.start : r.end] and len(r.text) <= 8000
            assert r.start == (max(0, at - 200) if k else 0)
            at = r.end
        assert at == len(t)


@pytest.mark.parametrize("seed", range(5))
def test_cuts_of_odd_texts(seed):
    r = random.Random(seed)
    for _ in range(1500):
        t = "".join(r.choice(["a" * r.randint(1, 60), " ", "\n", "\n\n", ". ", "\u200b", "\u00a0" * 40]) for _ in range(r.randint(1, 99)))
        limit, overlap = r.choice([(40, 9), (50, 10), (30, 0)])
        got, at = pieces.cuts(t, limit, overlap), 0
        for k, (s, e, kind) in enumerate(got):
            # The overlap is the same everywhere, whatever the words are like.
            assert 0 < e - s <= limit and s == (at - overlap if k else 0) and at < e
            if kind == "hard":
                assert e - s == limit and not any(t[i - 1].isspace() or t[i : i + 1].isspace() for i in range(s + overlap + 1, e + 1))
            at = e
        assert at == len(t)
        assert any(c[2] == "hard" for c in got) or len(t) <= limit or pieces.longest_run(t) <= limit


def test_pieces_edge_cases(spark):
    df = make(spark, [None, "", "a", "b" * 8000, "b" * 8001, ("c" * 7900 + " ") * 2, "\u200b" * 8100, "\u00a0" * 8100])
    got = {r.doc_id: r.cut for r in pieces.found(df).collect()}
    assert got == {4: "forced", 5: "natural", 6: "forced", 7: "natural"}
    by = defaultdict(list)
    for r in pieces.pieces(df).orderBy("piece").collect():
        by[r.doc_id].append((r.start, r.end))
    assert by.keys() == set(range(2, 8))
    assert all(b[0] == a[1] - 200 for x in by.values() for a, b in zip(x, x[1:])) and len(by[5]) == 3
    empty = make(spark, ["x"]).limit(0)
    assert pieces.found(empty).count() == pieces.pieces(empty).count() == 0
    with pytest.raises(ValueError):
        pieces.pieces(df, 10, 9)


# Problem 6


def test_ids_equal_the_library(spark, medium):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = documents(medium)
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, medium).collect()}
    assert got == {d: t.encode(x or "", add_special_tokens=False).ids for d, x in texts.items()}


def test_ids_of_odd_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    r = random.Random(6)
    odd = " \n\r\t\x85\xa0\u3000\x1c ab1²'sétll中\U0001f680\u0301\u200b.,-"
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(500)]
    texts += [None, "", " ", "<|endoftext|>", "x" * 20000, "абв" * 3000, texts[3], texts[3]]
    got = {x.doc_id: x.ids for x in tokens.encode(make(spark, texts), cache=50).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert tokens.encode(make(spark, ["x"]).limit(0)).count() == 0


def test_segment_tree_takes_the_leftmost_least():
    tree = tokens.SegmentTree([5 << 32, 3 << 32 | 1, 3 << 32 | 2])
    assert tree.node[1] == 3 << 32 | 1
    tree.set(1, tokens.NONE)
    assert tree.node[1] == 3 << 32 | 2
    tree.set(0, 1 << 32)
    assert tree.node[1] == 1 << 32


# Problem 7


def brute_leaks(docs, items, n):
    w = lambda t: re.findall(r"[^\W_]+", textform.form(t or "").lower())
    grams = defaultdict(set)
    for i, t in items:
        x = w(t)
        for k in range(len(x) - n + 1):
            grams[tuple(x[k : k + n])].add(i)
    out = set()
    for d, t in docs.items():
        x = w(t)
        for k in range(len(x) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(x[k : k + n]), ())}
    return out


@pytest.mark.parametrize("block", [leaks.BLOCK_CHARS, 2000])
def test_leaks_equal_brute_force(spark, medium, block):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{medium}/eval_items.parquet").to_pylist()]
    docs = documents(medium)
    read = lambda t: spark.read.parquet(f"{medium}/{t}.parquet")
    got = [tuple(r) for r in leaks.leaks(read("documents"), read("eval_items"), block_chars=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_leaks(docs, items, 12)
    by = dict(items)
    for r in leaks.spans(read("documents"), read("eval_items"), block_chars=block).collect():
        run = leaks.words_of(docs[r.doc_id][r.start : r.end])
        assert len(run) == r.n_words >= 12
        assert f" {' '.join(run)} " in f" {' '.join(leaks.words_of(by[r.item_id]))} "


ODD = ["cafe\u0301", "İstanbul", "ﬁrst", "naı\u0308ve", "pro\u200bfit", "соm", "ｗｉｄｅ", "o\u0308\u0323st", "각하", "각", "Straße", "e\u0301te\u0301", "ΣΑΣ", "x\u00ady", "12\u0301"]


def test_spans_fit_the_original(spark):
    r = random.Random(7)
    made = {}
    for k in range(40):
        item = [r.choice(ODD + ["plain", "words"]) + str(i % 3) * (i % 2) for i in range(14)]
        before, behind = (" ".join(r.choices(ODD, k=5)) for _ in range(2))
        made[k] = (f"{before}, {' '.join(item)}. {behind}", len(before) + 2, " ".join(item))
    docs = make(spark, [t for t, _, _ in made.values()])
    items = spark.createDataFrame([(k, "A", i) for k, (_, _, i) in made.items()], "item_id long, tier string, text string")
    rows = [x for x in leaks.spans(docs, items).collect() if x.doc_id == x.item_id]
    assert {x.doc_id for x in rows} == made.keys()
    for x in rows:
        text, at, item = made[x.doc_id]
        assert x.start <= at and x.end >= at + len(item) and len(leaks.words_of(text[x.start : x.end])) == x.n_words
        assert x.n_words > len(leaks.words_of(item)) or (x.start, x.end) == (at, at + len(item))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_runs_equal_brute_force(n):
    r = random.Random(n)
    for _ in range(400):
        items = [(k, " ".join(r.choices("ab", k=r.randint(0, 16)) + r.choices("cd", k=r.randint(0, 3)))) for k in range(3)]
        text = " ".join(r.choices("abcd", weights=(5, 5, 1, 1), k=r.randint(0, 30)))
        words, found = leaks.patterns(items, n)
        line = leaks.line_of(text)
        hits = [(i, places) for p, places in found.items() for i in range(len(line)) if line.startswith(p, i)]
        runs = leaks._runs(line.split(), sorted(hits), words, n)
        assert {(0, k) for k, _, _ in runs} == brute_leaks({0: text}, items, n)
        for k, a, b in runs:
            assert b - a >= n and f" {' '.join(line.split()[a:b])} " in f" {' '.join(words[k])} "


def test_leaks_edge_cases(spark):
    twelve = " ".join(f"w{i}" for i in range(12))
    docs = make(spark, [None, "", f"X {twelve.upper()}, y", twelve.replace(" ", "_-\u00a0"), twelve[:-1] + "2", f"{twelve} {twelve}"])
    items = spark.createDataFrame(
        [(1, "A", twelve), (2, "A", twelve), (3, "A", "short"), (4, None, None), (None, "B", twelve)], "item_id long, tier string, text string"
    )
    got = {tuple(r) for r in leaks.leaks(docs, items).collect()}
    assert got == {(d, i) for d in (2, 3, 5) for i in (1, 2)}
    assert leaks.spans(docs, items).filter("doc_id = 5 AND item_id = 1").count() == 2
    assert leaks.leaks(docs, items.limit(0)).count() == 0
    assert leaks.leaks(docs.limit(0), items).count() == 0
    assert {r.item_id: r.n_docs for r in leaks.item_report(docs, items).filter("item_id < 4").collect()} == {1: 3, 2: 3, 3: 0}


# Problem 8

SAME = [
    ("Sale of units", "Sаle оf units"),
    ("Sale of units", "Sale\u00a0of\u2009units"),
    ("Sale of units", "Ｓａｌｅ of units"),
    ("Sale of units", "Sa\u200ble\ufeff of un\u00adits"),
    ("profit office", "proﬁt oﬃce"),
    ("co-op", "co\u2010op"),
    ("co-op", "co\u2011op"),
    ("été", "e\u0301te\u0301"),
    ("été", "е\u0301té"),
    ("СОР", "COP"),
    ("Кода", "Kода"),
    ("ΡΒC", "PBC"),
    ("1,500", "１，５００"),
    ("Å", "Å"),
    ("a\r\nb", "a\nb"),
    ("Ivy line", "Ӏѵу line"),
    ("virus", "νіrυѕ"),
    ("gun", "ցսո"),
    ("grant", "ɡrɑnt"),
    ("DWARF", "ᎠᏔᎪᎡF"),
    ("pay", "ρаγ"),
]
OTHER = [("Sale", "sale"), ("été", "ete"), ("15", "16"), ("a b", "a  b"), ("a\nb", "a b"), ("x²", "x2"), ("й", "и"), ("a-b", "a—b"), ("O", "0"), ("①", "1"), ("½", "1/2")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_form(a, b):
    assert textform.form(a) == textform.form(b)
    assert textform.form(textform.form(a)) == textform.form(a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_form(a, b):
    assert textform.form(a) != textform.form(b)


def test_form_is_stable_and_its_offsets_fit(medium):
    for t in documents(medium).values():
        f = textform.form(t or "")
        again, starts, ends = textform.form_offsets(t or "")
        assert again == f and len(starts) == len(ends) == len(f)
        assert starts == sorted(starts) and ends == sorted(ends) and all(a < b for a, b in zip(starts, ends))
        assert textform.form(f) == f


@pytest.mark.parametrize("t", ["Отчёт компании", "Έκθεση εταιρείας", "Հայերեն", "東京タワー", "한국어 보고서", "ʼn’est-ce", "Übergröße"])
def test_a_language_keeps_its_script(t):
    assert textform.form(t) == unicodedata.normalize("NFC", t)


def test_every_shape_joins_all_its_scripts():
    for row in textform.SHAPES.split("\n"):
        letters = [c for c in row.split() if c != "."]
        assert len({textform.form(c) for c in letters}) <= 1
        assert all(textform.scripts(c) for c in letters)
    for c, script in zip("aбαա東カ가", ["Latin", "Cyrillic", "Greek", "Armenian", "Han", "Katakana", "Hangul"]):
        assert script in textform.scripts(c)
    assert textform.scripts("東") & textform.scripts("カ") and not textform.scripts("a") & textform.scripts("б")


@pytest.mark.parametrize(("token", "kind"), [("fоr", "mixed"), ("сор", "whole"), ("for", None), ("слово", None), ("東カ", None), ("бa", "mixed"), ("café", None)])
def test_confusable_tokens(spark, token, kind):
    assert textform.token_kind(token) == kind
    got = textform.confusables(make(spark, [f"a {token}, {token} b"])).first()
    assert (got.n_mixed, got.n_whole) == (2 * (kind == "mixed"), 2 * (kind == "whole"))


def test_look_alikes_equal_definition(spark, medium):
    groups = defaultdict(list)
    for d, t in documents(medium).items():
        if t and textform.form(t).strip():
            groups[textform.form(t)].append(d)
    texts = documents(medium)
    expected = {(min(a, b), max(a, b)) for g in groups.values() for a in g for b in g if texts[a] != texts[b]}
    got = [tuple(r) for r in queries.p8_found(spark, medium).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


def test_look_alikes_edge_cases(spark):
    df = make(spark, [None, "", " ", "\u00a0", "\u200b", "ab", "a\u200bb", "ab", "a\u200cb", "cd", "cd"])
    got = {tuple(r) for r in textform.look_alikes(df).collect()}
    assert got == {(5, 6), (6, 7), (5, 8), (7, 8), (6, 8)}
    assert textform.look_alikes(df.limit(0)).count() == 0
    forms = {r.doc_id: r.form for r in textform.forms(df).collect()}
    assert forms[0] is None and forms[1] == "" and forms[6] == "ab"


def test_every_character_has_a_stable_form():
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c) not in ("Cs", "Cn", "Co") and (i < 0x3100 or 0xA000 <= i < 0xAC00 or 0xF900 <= i < 0x20000):
            f = textform.form(c)
            assert textform.form(f) == f, hex(i)
