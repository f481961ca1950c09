"""Problem 5: schemas that drift between the files of a series.

Method: similarity flooding. The schemas of a file and its predecessor are
graphs of fields with their types, parents and the words of their names. Pairs
of like nodes form the connectivity graph; scores start from name similarity,
are passed along it until they stop changing, and all pairs of a gone and a new
field of one type are then proposed in order of their scores, one to one. A
proposal is accepted as `renamed` if the exact check holds as well: equal
values on every run both files hold. A rejected one leaves both fields free for
the next best proposal.

Scale: records are parsed in the JVM. Schemas are aggregated to one row per
file, and all decisions are made on one row per file pair, as wide as a schema
and independent of the number of records. Values are read only of files with
both gone and new fields, and of those fields only; a field's values on the
common runs become a digest by a hash aggregate over (file pair, side, field),
filled from rows that are spread by (file pair, run).

Defined results: `raw` that is null, empty, no JSON object, followed by
anything else, or with a key twice in one object is ignored; a field with nulls
only has no type and is never retyped; repeated records count once, and of
several records of one run the one with the last line number counts; values
are equal as numbers, not as spellings (in arrays and objects, numbers with an
exponent equal only such numbers); a pair of files without a common run has no
renames; a file without usable records has no fields; empty input gives no
rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut, stored

def records(raw: DataFrame, nested: str = "counts") -> DataFrame:
    """One row per usable record: bench_file, line_no, run, entries (key, value, kind), parsed once and stored.

    The entries are the top-level keys and, as `nested.key`, those inside one of them.
    """
    # The parser stops at the end of a value; if anything else follows, the mark is not the list's second item.
    framed = raw.select("bench_file", "line_no", F.try_parse_json(F.concat(F.lit("["), "raw", F.lit(f',"{END}"]'))).alias("list"))
    single = F.startswith(F.schema_of_variant("list"), F.lit("ARRAY<")) & (F.try_variant_get("list", "$[1]", "string") == END)
    first = framed.select("bench_file", "line_no", F.when(single, F.try_variant_get("list", "$[0]", "variant")).alias("o"))
    objects = stored(first).filter("o IS NOT NULL").filter(F.startswith(F.schema_of_variant("o"), F.lit("OBJECT<")))
    inner = F.map_entries(F.try_variant_get("o", f"$.{nested}", "map<string,variant>"))
    named = F.transform(inner, lambda e: F.struct(F.concat(F.lit(f"{nested}."), e["key"]).alias("key"), e["value"].alias("value")))
    every = F.concat(F.map_entries(F.col("o").try_cast("map<string,variant>")), F.coalesce(named, F.array().cast("array<struct<key:string,value:variant>>")))
    run = F.array(F.struct(F.lit("run").alias("key"), F.try_variant_get("o", "$.run", "variant").alias("value")))
    return objects.select("bench_file", "line_no", plain(run)[0]["value"].alias("run"), every.alias("entries"))


END = "end of record 5b0c9c1e"
KINDS = {"BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object"}


def shape(value: Column) -> Column:
    """The name of a value's type, without what it consists of."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)


def kind(name: Column) -> Column:
    """number, string, boolean, array or object; NULL of a null."""
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.try_element_at(known, name)


def plain(entries: Column) -> Column:
    """(field, type, value) of each entry; values are spelled alike if they are equal: 1, 1.0 and 1e0 are one number."""
    named = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), shape(e["value"]).alias("name"), e["value"].try_cast("string").alias("text")))
    exact = F.transform(named, lambda e: F.struct(
        e["key"].alias("key"), e["name"].alias("name"),
        F.when(e["name"] == "DOUBLE", F.coalesce(e["text"].try_cast("decimal(38,18)").cast("string"), e["text"])).otherwise(e["text"]).alias("text"),
    ))
    # Texts of arrays and objects have their keys in order and decimals without zeros at the end.
    fraction = lambda e: e["name"].isin("DECIMAL", "DOUBLE", "FLOAT") & F.contains(e["text"], F.lit("."))
    return F.transform(exact, lambda e: F.struct(
        e["key"].alias("field"), kind(e["name"]).alias("type"),
        F.when(fraction(e), F.rtrim(F.rtrim(e["text"], F.lit("0")), F.lit("."))).otherwise(e["text"]).alias("value"),
    ))


def schemas(recs: DataFrame) -> DataFrame:
    """One row per file: its fields, each with the types it has."""
    each = recs.select("bench_file", F.inline("entries")).select("bench_file", F.col("key").alias("field"), kind(shape(F.col("value"))).alias("type"))
    types = each.groupBy("bench_file", "field").agg(F.sort_array(F.collect_set("type")).alias("types"))
    return types.groupBy("bench_file").agg(F.map_from_entries(F.collect_list(F.struct("field", "types"))).alias("fields"))


def file_order(raw: DataFrame) -> DataFrame:
    """Each file with its predecessor in the series, by export time.

    Neighbours are found within a (series, day) and across a series' days, so
    that one series with a third of all files is no single sorted group.
    """
    files = (
        raw.groupBy("series", "bench_file")
        .agg(F.min("exported_at").alias("exported_at"))
        .withColumn("day", F.to_date("exported_at"))
    )
    order = ["exported_at", "bench_file"]
    w = Window.partitionBy("series", "day").orderBy(*order)
    days = files.groupBy("series", "day").agg(F.max_by("bench_file", F.struct(*order)).alias("last"))
    days = days.withColumn("before", F.lag("last").over(Window.partitionBy("series").orderBy("day"))).drop("last")
    days = days.withColumnsRenamed({"series": "day_series", "day": "of_day"})
    return (
        files.withColumn("prev", F.lag("bench_file").over(w))
        .join(days, F.col("series").eqNullSafe(F.col("day_series")) & F.col("day").eqNullSafe(F.col("of_day")))
        .select("series", "bench_file", "exported_at", F.coalesce("prev", "before").alias("prev_file"))
    )


# Fields of one side: their single type, and how their values on the common runs read.
FIELDS = "array<struct<field:string,type:string,digest:string>>"


def file_pairs(raw: DataFrame, recs: DataFrame) -> DataFrame:
    """One row per file with a predecessor: gone, new and stay (arrays of fields), was and now (types by field)."""
    s = schemas(recs)
    none = F.create_map().cast("map<string,array<string>>")
    both = (
        file_order(raw).filter("prev_file IS NOT NULL").select("bench_file", "prev_file")
        .join(s.withColumnRenamed("fields", "now"), "bench_file", "left")
        .join(s.select(F.col("bench_file").alias("prev_file"), F.col("fields").alias("was")), "prev_file", "left")
        .select("bench_file", "prev_file", F.coalesce("was", none).alias("was"), F.coalesce("now", none).alias("now"))
    )
    names = {"gone": F.array_except(F.map_keys("was"), F.map_keys("now")), "new": F.array_except(F.map_keys("now"), F.map_keys("was")), "stay": F.array_intersect(F.map_keys("was"), F.map_keys("now"))}
    return both.withColumns({k: F.sort_array(v) for k, v in names.items()})


def digests(pairs: DataFrame, recs: DataFrame) -> DataFrame:
    """(bench_file, digest): by `gone` or `new` and field, what the field's values on the common runs are.

    Fields without a value on any common run are not in the map; a pair of files without a common run has no row.
    """
    some = pairs.filter("size(gone) > 0 AND size(new) > 0")
    side = lambda name, by: recs.join(
        some.select(F.col("bench_file").alias("pair"), F.col(by).alias("bench_file"), F.col(name).alias("wanted")), "bench_file"
    ).filter("run IS NOT NULL").select("pair", "run", F.lit(name).alias("side"), "line_no", plain(
        F.filter("entries", lambda e: F.array_contains("wanted", e["key"]))
    ).alias("values"))
    last = lambda name: F.max_by("values", F.when(F.col("side") == name, F.struct("line_no", "values")))
    runs = (
        side("gone", "prev_file").unionByName(side("new", "bench_file")).groupBy("pair", "run")
        .agg(last("gone").alias("gone"), last("new").alias("new")).filter("gone IS NOT NULL AND new IS NOT NULL")
    )
    # One marker per run keeps pairs whose gone and new fields have no values there.
    marked = lambda name: F.transform(name, lambda v: F.struct(F.lit(name).alias("side"), v["field"].alias("field"), v["value"].alias("value")))
    marker = F.array(F.struct(F.lit("run").alias("side"), F.lit("").alias("field"), F.lit("").alias("value")))
    values = runs.select("pair", "run", F.inline(F.concat(marked("gone"), marked("new"), marker))).filter("value IS NOT NULL")
    # A run is there once per field, so the exclusive or of hashes tells sets of (run, value) apart.
    code = lambda seed: F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "run", "value")))
    one = values.groupBy("pair", "side", "field").agg(F.concat_ws(":", F.count("*"), code(1), code(2)).alias("digest"))
    return one.groupBy(F.col("pair").alias("bench_file")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "side", "field"), "digest"))).alias("digests")
    )


def grams(name: str) -> set[str]:
    s = f"  {name.lower()} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def alike(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


WORD = re.compile(r"[A-Z]?[^A-Z_\W]+|[A-Z]+")


def flood(pairs: list[tuple[str, str, str]], eps: float = 1e-4) -> np.ndarray:
    """Converged scores of pairs (old field, new field, type).

    The graph's nodes are these pairs and the pairs of types, parents and words that they meet in. In each
    round a node passes its score to its neighbours in equal parts, is added to its start value and rescaled
    by the largest score; as no more than a node's own score is passed on, the rounds converge.
    """
    start: list[float] = []
    index: dict[tuple, int] = {}
    edges: list[tuple[int, int]] = []

    def node(key: tuple, value: float) -> int:
        if key not in index:
            index[key] = len(start)
            start.append(value)
        return index[key]

    for a, b, t in pairs:
        (pa, _, na), (pb, _, nb) = a.rpartition("."), b.rpartition(".")
        i = node(("field", a, b), alike(na, nb))
        edges += [(i, node(("type", t), 1.0)), (i, node(("parent", pa, pb), float(pa == pb)))]
        edges += [(i, node(("word", x, y), alike(x, y))) for x in WORD.findall(na) for y in WORD.findall(nb)]
    zero = np.array(start)
    a, b = np.array(edges).T
    degree = np.bincount(np.concatenate([a, b]), minlength=len(zero))
    s = zero.copy()
    while True:
        new = zero + s + np.bincount(b, s[a] / degree[a], len(zero)) + np.bincount(a, s[b] / degree[b], len(zero))
        new /= new.max()
        if np.abs(new - s).max() < eps:
            return new[[index["field", x, y] for x, y, _ in pairs]]
        s = new


def correspond(gone, new, stay) -> list[dict]:
    """Renames of one file pair: the best proposal by flooding is checked, accepted or rejected, then the next."""
    proposals = [(g["field"], n["field"], g["type"]) for g in gone for n in new if g["type"] == n["type"]]
    if not proposals:
        return []
    # Fields that stay correspond to themselves and anchor their types, parents and words.
    scores = flood([*proposals, *((s["field"], s["field"], s["type"]) for s in stay)])
    was, now = ({f["field"]: f["digest"] for f in side} for side in (gone, new))
    out: dict[str, tuple[str, float]] = {}
    taken: set[str] = set()
    for k in sorted(range(len(proposals)), key=lambda k: (-round(float(scores[k]), 6), proposals[k])):
        x, y, _ = proposals[k]
        if x not in out and y not in taken and was[x] == now[y]:
            out[x] = (y, float(scores[k]))
            taken.add(y)
    return [{"field": x, "new_field": y, "score": s} for x, (y, s) in out.items()]


RENAMES = "array<struct<field:string,new_field:string,score:double>>"


def changes(raw: DataFrame, nested: str = "counts", recs: DataFrame | None = None) -> DataFrame:
    """Every change of a file against the preceding one of its series, with a rename's score."""
    recs = records(raw, nested) if recs is None else recs
    pairs = cut(file_pairs(raw, recs))
    d = digests(pairs, recs)
    single = lambda types, f: F.try_element_at(types, f)
    fields = lambda name, types: F.filter(F.transform(name, lambda f: F.struct(
        f.alias("field"), F.when(F.size(single(F.col(types), f)) == 1, single(F.col(types), f)[0]).alias("type"),
        F.coalesce(F.try_element_at("digests", F.concat(F.lit(f"{name} "), f)), F.lit("none")).alias("digest"),
    )), lambda x: x["type"].isNotNull()).cast(FIELDS)
    same = F.filter(fields("stay", "now"), lambda x: single(F.col("was"), x["field"]) == single(F.col("now"), x["field"]))

    @F.pandas_udf(RENAMES)
    def renames(gone: pd.Series, new: pd.Series, stay: pd.Series) -> pd.Series:
        return pd.Series([correspond(*x) for x in zip(gone, new, stay)], dtype=object)

    # Some rows are much work each; they are spread over all cores, as few bytes would else be one task.
    matched = (
        pairs.join(d, "bench_file").repartition(pairs.sparkSession.sparkContext.defaultParallelism)
        .select("bench_file", renames(fields("gone", "was"), fields("new", "now"), same).alias("renamed"))
    )
    rows = pairs.join(matched, "bench_file", "left").withColumn("renamed", F.coalesce("renamed", F.array().cast(RENAMES)))
    change = lambda name, c, to=F.lit(""), score=F.lit(None).cast("double"): F.struct(
        F.lit(name).alias("change"), c.alias("field"), to.alias("new_field"), score.alias("score")
    )
    typed = lambda f: F.size(single(F.col("was"), f)) * F.size(single(F.col("now"), f)) > 0
    every = F.concat(
        F.transform("renamed", lambda r: change("renamed", r["field"], r["new_field"], r["score"])),
        F.transform(F.array_except("gone", F.col("renamed.field")), lambda f: change("removed", f)),
        F.transform(F.array_except("new", F.col("renamed.new_field")), lambda f: change("added", f)),
        F.transform(F.filter("stay", lambda f: typed(f) & (single(F.col("was"), f) != single(F.col("now"), f))), lambda f: change("retyped", f)),
    )
    return rows.select("bench_file", F.inline(every))


def found(raw: DataFrame) -> DataFrame:
    return changes(raw).select("bench_file", "change", "field", "new_field")


def last_names(raw: DataFrame, recs: DataFrame) -> DataFrame:
    """(series, field, at, name): the name that each field renamed at some time ends up with in its series.

    Renames chain over files; each round every rename takes over the target of
    the next rename of its new name, so a chain of n needs log2(n) rounds.
    """
    order = file_order(raw).select("series", "bench_file", "exported_at")
    steps = cut(
        changes(raw, recs=recs).filter("change = 'renamed'").join(order, "bench_file")
        .select("series", "field", F.struct("exported_at", "bench_file").alias("at"), F.col("new_field").alias("name"))
        .withColumn("upto", F.col("at"))
    )
    while True:
        nxt = steps.select("series", F.col("field").alias("name"), F.col("at").alias("nat"), F.col("upto").alias("nupto"), F.col("name").alias("nname"))
        joined = steps.join(nxt, ["series", "name"], "left")
        best = joined.groupBy("series", "field", "at").agg(
            F.min("name").alias("name"), F.min("upto").alias("upto"),
            F.min(F.when(F.col("nat") > F.col("upto"), F.struct("nat", "nname", "nupto"))).alias("n"),
        )
        steps = cut(best.select(
            "series", "field", "at", F.coalesce("n.nname", "name").alias("name"), F.coalesce("n.nupto", "upto").alias("upto"),
            F.col("n").isNotNull().alias("moved"),
        ))
        if not steps.filter("moved").take(1):
            return steps.select("series", "field", F.col("at"), "name")
        steps = steps.drop("moved")


def file_fields(raw: DataFrame, recs: DataFrame) -> DataFrame:
    """(bench_file, field, series, at, name): each field of each file with its last name, found on schemas, not on records."""
    order = file_order(raw).select("series", "bench_file", F.struct("exported_at", "bench_file").alias("file_at"))
    s = schemas(recs).select("bench_file", F.explode(F.map_keys("fields")).alias("field")).join(order, "bench_file")
    later = F.when(F.col("at") > F.col("file_at"), F.struct("at", "name"))
    return (
        s.join(last_names(raw, recs), ["series", "field"], "left").groupBy("bench_file", "field")
        .agg(F.min("series").alias("series"), F.min("file_at").alias("at"), F.min(later).alias("n"))
        .select("bench_file", "field", "series", "at", F.coalesce("n.name", "field").alias("name"))
    )


def values(raw: DataFrame, nested: str = "counts") -> DataFrame:
    """(series, run, name, type, value): each run's fields under their last names, as the last file that has them says."""
    recs = records(raw, nested)
    names = file_fields(raw, recs)
    facts = recs.select("bench_file", "line_no", "run", F.inline(plain(F.filter("entries", lambda e: e["key"] != "run"))))
    return (
        facts.join(names, ["bench_file", "field"]).groupBy("series", "run", "name")
        .agg(F.max_by(F.struct("type", "value"), F.struct("at", "line_no", "type", "value")).alias("v"))
        .select("series", "run", "name", "v.*")
    )


SQL_TYPES = {"number": "double", "boolean": "boolean"}


def columns(fields: list[str], taken: tuple[str, ...] = ("series", "run", "not_cast")) -> dict[str, str]:
    """Field -> column name: dots become underscores; names equal but for case, or taken, get a number."""
    used, out = set(taken), {}
    for f in sorted(fields):
        base, k = f.replace(".", "_"), 2
        name = base
        while name.lower() in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name.lower())
        out[f] = name
    return out


def table(raw: DataFrame, nested: str = "counts") -> DataFrame:
    """All runs in one table: a row per (series, run), a typed column per field under its last name.

    A field's type is the one most of its values have: number (double), boolean, string, and array or object
    as JSON text. A value of another type is cast where that is possible (`{"value": x}` gives x); else the
    column is null and `not_cast` has the value under the column's name. `run`, the key, is one spelling of
    the number. Names and types are read by the
    driver, as in reading any schema; they grow with the schema, not with the records.
    """
    long = cut(values(raw, nested))
    usual = (
        long.groupBy("name", "type").agg(F.count("*").alias("c"))
        .groupBy("name").agg(F.max_by("type", F.when(F.col("type").isNotNull(), F.struct("c", "type"))).alias("type")).collect()
    )
    names = columns([r.name for r in usual])
    there = F.when(F.col("value").isNotNull(), F.struct("name", F.struct("type", "value")))
    every = long.groupBy("series", "run").agg(F.map_from_entries(F.collect_list(there)).alias("m"))
    out, failed = {}, []
    for r in sorted(usual, key=lambda r: r.name):
        v = F.try_element_at("m", F.lit(r.name))
        inner = F.when((v["type"] == "object") & (F.lit(r.type) != "object"), F.coalesce(F.get_json_object(v["value"], "$.value"), v["value"])).otherwise(v["value"])
        cast = F.when(v["type"] == r.type, v["value"]) if r.type in ("array", "object") else inner
        cast = cast.try_cast(SQL_TYPES.get(r.type, "string"))
        out[names[r.name]] = cast
        failed.append(F.when(v["value"].isNotNull() & cast.isNull(), F.struct(F.lit(names[r.name]).alias("key"), v["value"].alias("value"))))
    not_cast = F.map_from_entries(F.array_compact(F.array(*failed))) if failed else F.create_map().cast("map<string,string>")
    return every.select("series", "run", *[c.alias(n) for n, c in out.items()], not_cast.alias("not_cast"))
