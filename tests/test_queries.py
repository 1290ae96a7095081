"""Every query with SQL must agree with DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "tag_open_counts", "tag_balance", "links", "token_round_trip", "missing_close_b", "extract_both", "extract_ruby_bytes", "lint_offenses", "lint_cases", "lint_gate", "lint_suppressed", "lint_unknown_names", "render_edges",
    "partials_unresolved", "templates_reachable", "partials_unused", "strict_local_mismatches", "unused_strict_locals", "inferred_signatures", "ancestor_verdicts", "partial_verdicts", "partial_signatures", "entry_trails", "layout_sites", "state_flow", "diff_summary", "class_sort",
    "helpers_to_html", "html_to_helpers", "lint_autofix", "inlined_partials", "nesting_validator", "project_status", "sql_functions", "indentation", "format_templates", "auto_close", "unified_diff", "stream_changes", "escape_html",
    "token_shapes", "error_shapes", "node_shapes", "attribute_shapes", "extract_shapes", "change_shapes", "compile_shapes", "layout_shapes", "fix_shapes", "format_check_shapes", "escapes", "escapes_css", "lint_by_rule",
    "inlined_documents", "iteration_shapes", "balance_shapes", "dependency_shapes", "scope_shapes", "reference_shapes", "ruby_entries", "static_pages", "graph_report",
    "lint_simple_report", "lint_json_report", "lint_once_per_run", "lint_ranked", "lint_new_only", "lint_levels",
]


def canon(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).map(str).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, FOLDER).toPandas()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
