"""Queries of the general numbered problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators import drift, orphans
from tracewright.plans.registry import clean_id_sql
from tracewright.session import table


def _case(spark: SparkSession, d: str):
    return table(spark, d, "hypotheses"), table(spark, d, "verdicts"), table(spark, d, "evidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(*_case(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(*_case(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.found(table(spark, d, "bench_raw"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.table(table(spark, d, "bench_raw"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found, p5_table)}

ORPHANS = f"""refs AS (SELECT DISTINCT 'hypotheses' AS src_table, id AS src_id, case_id, recorded_at AS written, ref_field, {clean_id_sql('x')} AS ref_id, 'e' AS kind
        FROM (SELECT *, 'supporting' AS ref_field, unnest(supporting) AS x FROM hypotheses UNION ALL SELECT *, 'contradicting', unnest(contradicting) FROM hypotheses)
        UNION SELECT 'verdicts', verdict_id, case_id, recorded_at, 'hypothesis_id', {clean_id_sql('hypothesis_id')}, 'h' FROM verdicts),
    rows AS (SELECT case_id, {clean_id_sql('id')} AS ref_id, 'e' AS kind, recorded_at, deleted_at FROM evidence
        UNION ALL SELECT case_id, {clean_id_sql('id')}, 'h', recorded_at, deleted_at FROM hypotheses
        UNION ALL SELECT case_id, {clean_id_sql('m')}, 'h', recorded_at, deleted_at FROM (SELECT *, unnest(merged_from) AS m FROM hypotheses)),
    known AS (SELECT case_id, ref_id, kind, min(recorded_at) AS born, min(deleted_at) AS died FROM rows WHERE ref_id IS NOT NULL GROUP BY ALL),
    orphans AS (SELECT refs.*, CASE WHEN known.kind IS NULL THEN 'missing' WHEN born > written THEN 'late' WHEN died <= written THEN 'deleted' END AS reason
        FROM refs LEFT JOIN known USING (case_id, ref_id, kind) WHERE ref_id IS NOT NULL)"""
# By the definition alone; where one field could be renamed to several, which these tables do not have, it would list them all.
CHANGES = """rec AS (SELECT bench_file, line_no, raw::JSON AS o FROM bench_raw WHERE raw IS NOT NULL AND json_valid(raw) AND json_type(raw) = 'OBJECT'),
    kv AS (SELECT bench_file, line_no, o->>'run' AS run, field, o->field AS v FROM (SELECT *, unnest(json_keys(o)) AS field FROM rec)
        UNION ALL SELECT bench_file, line_no, o->>'run', 'counts.' || k, o->'counts'->k FROM (SELECT *, unnest(json_keys(o, 'counts')) AS k FROM rec WHERE json_type(o, 'counts') = 'OBJECT')),
    f AS (SELECT bench_file, line_no, run, field, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
        CASE WHEN json_type(v) = 'NULL' THEN NULL WHEN json_type(v) IN ('VARCHAR', 'BOOLEAN', 'ARRAY', 'OBJECT') THEN v->>'$' ELSE ((v->>'$')::DOUBLE)::VARCHAR END AS val FROM kv),
    files AS (SELECT bench_file, lag(bench_file) OVER (PARTITION BY series ORDER BY t, bench_file) AS prev FROM (SELECT series, bench_file, min(exported_at) AS t FROM bench_raw GROUP BY 1, 2)),
    prof AS (SELECT bench_file, field, list_sort(list_distinct(list(kind) FILTER (WHERE kind IS NOT NULL))) AS kinds FROM f GROUP BY 1, 2),
    now AS (SELECT files.bench_file, field, coalesce(kinds, []) AS kinds FROM files JOIN prof ON prof.bench_file = files.bench_file WHERE prev IS NOT NULL),
    was AS (SELECT files.bench_file, field, coalesce(kinds, []) AS kinds FROM files JOIN prof ON prof.bench_file = prev),
    gone AS (SELECT * FROM was ANTI JOIN now USING (bench_file, field)), new AS (SELECT * FROM now ANTI JOIN was USING (bench_file, field)),
    last AS (SELECT bench_file, run, field, arg_max({'v': val}, line_no).v AS val FROM f WHERE run IS NOT NULL GROUP BY 1, 2, 3),
    runs AS (SELECT DISTINCT files.bench_file, prev, a.run FROM files JOIN last a ON a.bench_file = files.bench_file JOIN last b ON b.bench_file = prev AND b.run = a.run),
    pairs AS (SELECT g.bench_file, g.field, n.field AS new_field FROM gone g JOIN new n ON n.bench_file = g.bench_file AND n.kinds = g.kinds AND len(g.kinds) = 1),
    renamed AS (SELECT p.bench_file, p.field, p.new_field FROM pairs p JOIN runs r ON r.bench_file = p.bench_file LEFT JOIN last x ON x.bench_file = r.prev AND x.run = r.run AND x.field = p.field
        LEFT JOIN last y ON y.bench_file = r.bench_file AND y.run = r.run AND y.field = p.new_field GROUP BY ALL HAVING bool_and(x.val IS NOT DISTINCT FROM y.val))
    SELECT bench_file, 'renamed' AS change, field, new_field FROM renamed
    UNION ALL SELECT bench_file, 'removed', field, '' FROM gone ANTI JOIN renamed USING (bench_file, field)
    UNION ALL SELECT bench_file, 'added', field, '' FROM new ANTI JOIN (SELECT bench_file, new_field AS field FROM renamed) r USING (bench_file, field)
    UNION ALL SELECT bench_file, 'retyped', field, '' FROM now JOIN was USING (bench_file, field) WHERE len(now.kinds) > 0 AND len(was.kinds) > 0 AND now.kinds <> was.kinds"""
SQL = {
    "p5_found": f"WITH {CHANGES}",
    "p3_found": f"WITH {ORPHANS} SELECT DISTINCT src_table, src_id, ref_field, ref_id, reason FROM orphans WHERE reason IS NOT NULL",
    "p3_report": f"""WITH {ORPHANS}, m AS (SELECT DISTINCT src_table, src_id, ref_field, ref_id, reason, strftime(written, '%Y-%m') AS month FROM orphans WHERE reason IS NOT NULL)
        SELECT src_table, month, ref_field, reason, count(*) AS n_refs FROM m GROUP BY ALL""",
}
