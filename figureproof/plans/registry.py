"""Every registered query and its oracle SQL, by key."""

from __future__ import annotations

from . import catalog_queries as CQ
from . import log_queries as LQ
from . import report_text as RT
from . import manifest_queries as MQ
from . import naming_queries as NQ
from . import publish_queries as PQ
from . import text_queries as TQ
from . import workbook_queries as WQ
from . import fingerprint_queries as FQ
from . import fingerprint_sql as FS
from . import graph_queries as GQ
from ..session import listed_once

# Any scale factor has the same schemas; the oracle reads only the footers.
SCHEMA_DIR = "/root/testdata/sf0.001"


def queries():
    return {name: listed_once(query) for name, query in _queries().items()}


def _queries():
    return {
        "report_figures": FQ.report_figures,
        "measure_cube": FQ.measure_cube,
        "value_space_hits": FQ.value_space_hits,
        "filtered_candidates": FQ.filtered_candidates,
        "two_term_candidates": FQ.two_term_candidates,
        "constraint_bands": FQ.constraint_bands,
        "resolve_metrics": FQ.resolve_metrics,
        "drift_register": FQ.drift_register,
        "join_paths": GQ.join_paths,
        "graph_cube": GQ.graph_cube,
        "graph_hits": GQ.graph_hits,
        "column_profile": CQ.column_profile,
        "approx_profile": CQ.approx_profile,
        "key_heuristic": CQ.key_heuristic,
        "column_roles": CQ.column_roles,
        "join_edges": CQ.join_edges,
        "snapshot_as_of": CQ.snapshot_as_of,
        "schema_rename_union": CQ.schema_rename_union,
        "snapshot_rows": CQ.snapshot_rows,
        "column_samples": CQ.column_samples,
        "query_shapes": LQ.query_shapes,
        "log_aggregates": LQ.log_aggregates,
        "log_dimensions": LQ.log_dimensions,
        "log_joins": LQ.log_joins,
        "evidence_bundle": LQ.evidence_bundle,
        "trust_score": LQ.trust_score,
        "signal_dedup_stream": LQ.signal_dedup_stream,
        "usage_window_stream": LQ.usage_window_stream,
        "figure_extract": RT.figure_extract,
        "figure_text_check": RT.figure_text_check,
        "figure_consistency": RT.figure_consistency,
        "extraction_recall": RT.extraction_recall,
        "cell_evidence": RT.cell_evidence,
        "formula_mining": TQ.formula_mining,
        "statement_mining": TQ.statement_mining,
        "glossary_mining": TQ.glossary_mining,
        "approval_flags": TQ.approval_flags,
        "contradictions": TQ.contradictions,
        "ground_definitions": TQ.ground_definitions,
        "name_shortlist": NQ.name_shortlist,
        "token_similarity": NQ.token_similarity,
        "prose_candidates": NQ.prose_candidates,
        "glossary_terms": PQ.glossary_terms,
        "lineage_edges": PQ.lineage_edges,
        "column_tags": PQ.column_tags,
        "semantic_model_rows": PQ.semantic_model_rows,
        "conflict_tables": PQ.conflict_tables,
        "scorecard": PQ.scorecard,
        "published_files": PQ.published_files,
        "published_drift": PQ.published_drift,
        "published_contradictions": PQ.published_contradictions,
        "glossary_payloads": PQ.glossary_payloads,
        "eval_metrics": PQ.eval_metrics,
        "eval_accuracy": PQ.eval_accuracy,
        "evidence_gate": PQ.evidence_gate,
        "candidate_grammar": PQ.candidate_grammar,
        "guardrail": PQ.guardrail,
        "question_metrics": PQ.question_metrics,
        "manifest_models": MQ.manifest_models,
        "manifest_metrics": MQ.manifest_metrics,
        "certified_metric_stream": MQ.certified_metric_stream,
        "certified_trust": MQ.certified_trust,
        "bi_formula": WQ.bi_formula,
    }


def _guardrail_sql(sqls: dict, schema: dict) -> str:
    cat = ", ".join(f"('{t}', '{c}')" for t, cs in schema.items() for c, _ in cs)
    return f"""
WITH sm AS ({sqls['semantic_model_rows']}),
gl AS ({sqls['glossary_mining']}),
lg AS ({sqls['log_aggregates']}),
cat AS (SELECT lower(t) AS "table", lower(c) AS "column" FROM (VALUES {cat}) v(t, c)),
refs AS (SELECT DISTINCT * FROM (
  SELECT 'semantic_model' AS source, "table", expr AS "column" FROM sm WHERE kind = 'measure' AND expr <> '1'
  UNION ALL SELECT 'glossary', lower("table"), lower("column") FROM gl
  UNION ALL SELECT 'query_log', "table", "column" FROM lg WHERE "column" <> '*')),
j AS (SELECT r.*, c."table" IS NOT NULL AS known FROM refs r
      LEFT JOIN cat c ON c."table" = r."table" AND c."column" = r."column")
SELECT j.source, j."table", j."column", j.known, f.review_required
FROM j JOIN (SELECT "table", count_if(NOT known) > 0 AS review_required FROM j GROUP BY "table") f USING ("table")"""


def oracle_sql():
    out = _oracle_sql()
    out.update(NQ.oracle("WITH " + FS.MARTS_SQL + ",\n" + FS.figures_sql(), CQ.parquet_schema(SCHEMA_DIR),
                         {"orders": FS.ORDERS_MEASURES, "lineitem": FS.LINE_MEASURES}, out["glossary_mining"], out["formula_mining"]))
    out.update(LQ.oracle_evidence(CQ.parquet_schema(SCHEMA_DIR), out["cell_evidence"], WQ.oracle()["bi_formula"]))
    out["guardrail"] = _guardrail_sql(out, CQ.parquet_schema(SCHEMA_DIR))
    out.update(MQ.oracle(out["log_aggregates"], SCHEMA_DIR))
    out["certified_metric_stream"] = out["manifest_metrics"]
    out["certified_trust"] = MQ.oracle_certified(out["trust_score"], out["manifest_metrics"])
    out.update(WQ.oracle())
    out["question_metrics"] = f"""
WITH f AS ({out['report_figures']}), g AS ({out['glossary_terms']}),
q AS (SELECT DISTINCT 'What was ' || metric || CASE WHEN label IS NOT NULL THEN ' for ' || label ELSE '' END
                      || ' as of ' || strftime(as_of, '%Y-%m-%d') || '?' AS question FROM f),
qt AS (SELECT question, list_distinct(list_transform(regexp_extract_all(question, '[a-zA-Z0-9]+', 0), lambda t: lower(t))) AS qt FROM q),
gb AS (SELECT metric AS name, list_distinct(list_concat(
          list_transform(regexp_extract_all(metric, '[a-zA-Z0-9]+', 0), lambda t: lower(t)),
          list_transform(regexp_extract_all(definition, '[a-zA-Z0-9]+', 0), lambda t: lower(t)))) AS bag FROM g),
sc AS (SELECT question, name, len(list_intersect(qt, bag)) / len(list_distinct(list_concat(qt, bag))) AS jaccard
       FROM qt, gb WHERE len(list_intersect(qt, bag)) > 0)
SELECT question, name AS metric, round(jaccard, 6) AS jaccard FROM sc
QUALIFY row_number() OVER (PARTITION BY question ORDER BY jaccard DESC, name) = 1"""
    out["contradictions"] = TQ.oracle_contradictions(out["statement_mining"], out["approval_flags"], out["bi_formula"], out["glossary_terms"])
    out["snapshot_rows"] = CQ.SNAPSHOT_ROWS_SQL
    out["column_samples"] = CQ.oracle_samples(SCHEMA_DIR)
    out["eval_accuracy"] = f"""SELECT CAST(count(*) AS BIGINT) AS n_metrics, CAST(count_if("equal") AS BIGINT) AS n_equal,
       round(count_if("equal") / nullif(count(*), 0), 6) AS accuracy FROM ({FS.eval_metrics_sql(PQ.GOLD, whole=True)})"""
    out["evidence_gate"] = f"""SELECT "table", "column", agg, total, row_number() OVER (ORDER BY total DESC, "table", "column", agg) AS rank
FROM ({out['trust_score']}) WHERE total > 0.5"""
    # the keys are the grammar's own but for what the log aggregates otherwise
    out["candidate_grammar"] = FS._verdict_ctes() + f""",
ky AS (SELECT 'search' AS source, key FROM allranked
       UNION SELECT 'bi', key FROM ({out['bi_formula']}) WHERE key IS NOT NULL
       UNION SELECT 'log', upper(agg || '(' || "table" || '.' || "column" || ')') FROM ({out['log_aggregates']}))
SELECT source, key, CASE WHEN key NOT LIKE 'SUM(%' AND key NOT LIKE 'COUNT(%' AND key NOT LIKE 'AVG(%' THEN 'no aggregate of the grammar'
       WHEN key LIKE '%SUM(%.*)%' OR key LIKE '%AVG(%.*)%' THEN 'star outside of COUNT' END AS fault FROM ky"""
    kept = [n for n in PQ.SINKS if n not in ("drift", "contradictions")]
    for key, names in (("published_files", kept), ("published_drift", ["drift"]), ("published_contradictions", ["contradictions"])):
        out[key] = PQ.published_sql(out, PQ.SINK_COLUMNS, names)
    return out


def _oracle_sql():
    return {
        **CQ.oracle(CQ.parquet_schema(SCHEMA_DIR)),
        **CQ.oracle_rename(),
        **LQ.oracle(CQ.parquet_schema(SCHEMA_DIR)),
        **RT.oracle("WITH " + FS.MARTS_SQL + ",\n" + FS.figures_sql()),
        **RT.oracle_cells("WITH " + FS.MARTS_SQL + ",\n" + FS.figures_sql(), CQ.parquet_schema(SCHEMA_DIR)),
        **TQ.oracle("WITH " + FS.MARTS_SQL + ",\n" + FS.figures_sql()),
        **TQ.oracle_grounding("WITH " + FS.MARTS_SQL + ",\n" + FS.figures_sql(), CQ.parquet_schema(SCHEMA_DIR)),
        **GQ.oracle("WITH " + FS.MARTS_SQL + ",\n" + FS.figures_sql(), CQ.parquet_schema(SCHEMA_DIR),
                    {t: [c for c, k in cs if k == "number"] for t, cs in CQ.parquet_schema(SCHEMA_DIR).items()}),
        "report_figures": FS.report_figures_sql(),
        "measure_cube": FS.measure_cube_sql(),
        "value_space_hits": FS.value_space_hits_sql(),
        "filtered_candidates": FS.filtered_candidates_sql(),
        "two_term_candidates": FS.two_term_candidates_sql(),
        "resolve_metrics": FS.resolve_metrics_sql(),
        "constraint_bands": FS.constraint_bands_sql(),
        "drift_register": FS.drift_register_sql(),
        **FS.publish_sql(),
        "scorecard": FS.scorecard_sql(PQ.GOLD, PQ.TRAP_KEYS, PQ.GOLD_DRIFT),
        "eval_metrics": FS.eval_metrics_sql(PQ.GOLD),
    }
