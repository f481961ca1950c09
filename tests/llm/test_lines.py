"""Problem 4 against brute force and on its edge cases."""

import itertools
import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
import xxhash

from tracewright.llm import lines, queries

DOCS = "doc_id long, text string, source string, file string, line int, form long, cluster string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, f"f{i}", 1, 1, "x") for i, (s, t) in enumerate(rows)], DOCS)


def brute(docs, min_docs, min_chars):
    seen, at = defaultdict(set), []
    for d, (s, t) in docs.items():
        if s is None or t is None:
            continue
        for i, raw in enumerate(t.split("\n"), 1):
            form = " ".join(raw.split()).lower()
            if len(form) >= min_chars:
                seen[s, form].add(d)
                at.append((d, i, s, form))
    return {(d, i) for d, i, s, f in at if len(seen[s, f]) >= min_docs}


def test_found_equals_brute_force(spark, medium):
    docs = {r["doc_id"]: (r["source"], r["text"]) for r in pq.read_table(f"{medium}/documents.parquet").to_pylist()}
    got = [tuple(r) for r in queries.p4_found(spark, medium).collect()]
    expected = brute(docs, 6, 30)
    assert len(got) == len(set(got)) and set(got) == expected
    gone = defaultdict(set)
    for d, i in expected:
        gone[d].add(i)
    for r in queries.p4_clean(spark, medium).collect():
        t = docs[r.doc_id][1]
        assert r.removed == len(gone[r.doc_id])
        assert r.text == (t if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in gone[r.doc_id]))


def key(s):
    h = xxhash.xxh3_64_intdigest(s.encode())
    return h - (1 << 64) if h >> 63 else h


def runs(masked):
    h, _ = lines.shingles([masked])
    return set(h.tolist())


@pytest.mark.parametrize("hot", [1, 50])
def test_clusters_hold_all_alike_lines(spark, small, hot):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    forms = defaultdict(dict)
    for r in pq.read_table(f"{small}/documents.parquet").to_pylist():
        for raw in (r["text"] or "").split("\n"):
            flat = " ".join(raw.split())
            if len(flat.lower()) >= 30:
                forms[r["source"]][lines.mask(raw.split())] = (r["doc_id"], key(flat.lower()))
    occ, held = lines.clustered(docs, hot=hot)
    rows = occ.join(held, ["source_key", "form"]).collect()
    cluster = {(r.doc_id, r.line): r.cluster for r in rows}
    alike = together = 0
    for by in forms.values():
        sets = {m: runs(m) for m in by}
        for a, b in itertools.combinations(by, 2):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                alike += 1
                together += cluster[by[a]] == cluster[by[b]]
    assert alike and together >= 0.98 * alike
    by = defaultdict(set)
    for r in rows:
        by[r.cluster].add(r.doc_id)
    near = {(r.doc_id, r.line_no): r.n_docs for r in lines.repeated(docs, hot=hot).collect()}
    assert near == {(r.doc_id, r.line_no): len(by[r.cluster]) for r in rows if len(by[r.cluster]) >= 6}


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_buckets_link_what_is_alike_and_nothing_else(spark, hot):
    r = random.Random(1)
    clause = " ".join(f"{a}{b}" for a in "abcde" for b in "vwxyz")
    texts = sorted({f"{clause} {' '.join(r.choices(['one', 'two', 'three'], k=r.randint(0, 14)))}".strip() for _ in range(150)})
    occ = lines.occurrences(make(spark, [("s", t) for t in texts])).cache()
    keys = {r.line: r.n for r in occ.select("line", lines.node("form").alias("n")).collect()}
    masked = {keys[key(t)]: runs(lines.mask(t.split())) for t in texts}
    alike = lambda a, b: len(masked[a] & masked[b]) >= 0.8 * len(masked[a] | masked[b])

    def roots(hot):
        links = lines.links(occ, lines.nodes(occ), hot)
        assert all(alike(r.a, r.b) for r in links.collect())
        return {tuple(r) for r in lines.components(links).collect()}

    # With no bucket hot, each is paired in full.
    full = roots(1_000_000)
    assert full and roots(hot) == full


def test_found_rests_on_the_clusters(spark, monkeypatch):
    line = "Fees fall due on the first day of each new quarter"
    df = make(spark, [("s", line if i < 3 else line.title()) for i in range(6)])
    assert lines.found(df).count() == 6 and lines.clean(df).filter("removed = 1").count() == 6
    # Either spelling alone stands in too few documents.
    monkeypatch.setattr(lines, "links", lambda *a: spark.createDataFrame([], "a long, b long"))
    assert lines.found(df).count() == 0 and lines.clean(df).filter("removed = 1").count() == 0


def test_near_lines_go_as_one_cluster(spark):
    text = "The undersigned agent certifies that this notice number {} was sent to every holder of record in the usual form and manner and that it remains open for comment"
    df = make(spark, [("s", text.format(i)) for i in range(4)] + [("s", text.format(9) + " now")] * 2 + [("t", text.format(1))] * 2)
    assert lines.found(df).count() == 0
    assert {r.doc_id: r.removed for r in lines.clean(df, near=True).collect()} == {**dict.fromkeys(range(6), 1), 6: 0, 7: 0}


def test_shingles_depend_on_the_text_alone():
    texts = ["a b c d e f g", "", "a b", "b c d e f", "a b c d e f g"]
    h, at = lines.shingles(texts)
    assert at.tolist() == [0, 3, 4, 5, 6, 9]
    assert h[0:3].tolist() == h[6:9].tolist() and h[1] == h[5] and len(set(h.tolist())) == 5
    keys = lines.band_keys(h, at)
    assert keys[0].tolist() == keys[4].tolist() and keys[0].tolist() != keys[3].tolist()


def test_edge_cases(spark):
    line = "The same Legal notice stands in  Every filing of this agent"
    rows = [("s", f"{line}\nown line number {i} of this document here") for i in range(4)]
    rows += [("s", line.upper() + "\r"), ("s", f" {line.replace('  ', ' ')}　\n{line}\n")]
    rows += [("t", line)] * 5 + [(None, line), ("s", None), ("s", ""), ("s", "\n \n"), ("u", "short\n" * 9), ("s", "x" * 100_000)]
    df = make(spark, rows)
    docs = dict(enumerate(rows))
    assert {tuple(r) for r in lines.found(df).collect()} == brute(docs, 6, 30) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 2)}
    clean = {r.doc_id: (r.text, r.removed) for r in lines.clean(df).collect()}
    assert clean[4] == ("", 1) and clean[5] == ("", 2) and clean[12] == (None, 0) and clean[13] == ("", 0)
    assert clean[0] == ("own line number 0 of this document here", 1)
    assert lines.found(df.limit(0)).count() == 0 and lines.clean(df.limit(0)).count() == 0


def test_mask():
    line = "Fees of $1,200 billed to Örtori Ltd. on May 3, 2020 rose 4%"
    assert lines.mask(line.split()) == "<n> of <0> billed to <n> on <d> rose <0>"
    assert lines.mask(["on", "2020-01-02", "(LLC)"]) == "on <d> <n>"
