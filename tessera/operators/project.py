"""Project-wide reports: validators, status of files, tree prints, SQL table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.html_tables import INTERACTIVE, P_CLOSERS
from tessera.lint.catalogue import sql_list
from tessera.operators import graph
from tessera.operators.tables import Tables


def nesting_errors(t: Tables) -> DataFrame:
    """Block children of ``p``, nested links and interactive children of ``button``."""
    hits = F.array(
        F.when(F.expr(f"try_element_at(ancestors, -1) = 'p' and tag in {sql_list(P_CLOSERS)}"), F.lit("block_in_p")),
        F.when(F.expr("tag = 'a' and array_contains(ancestors, 'a')"), F.lit("link_in_link")),
        F.when(F.expr(f"tag in {sql_list(INTERACTIVE | {'a'})} and array_contains(ancestors, 'button')"), F.lit("interactive_in_button")),
    )
    return t.elements.select("doc_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("problem"), "tag", "line", "column")


def security_errors(t: Tables) -> DataFrame:
    """Output in attribute position or in an attribute name."""
    where = t.erb.where("opening in ('<%=', '<%==') and place = 'tag'").select("doc_id", F.lit("attribute_position").alias("problem"), "line", "column")
    names = t.attributes.where("exists(name_parts, p -> p.kind = 'erb_output')").select("doc_id", F.lit("attribute_name").alias("problem"), "line", "column")
    return where.unionByName(names)


def render_validation(t: Tables) -> DataFrame:
    return graph.unresolved(t)


#: Which errors only strict parsing, or only analysis, reports.
STRICT_ONLY = ("OmittedClosingTagError", "StrayERBClosingTagError")
ANALYSIS = ("ERBControlFlowScopeError", "MissingERBEndTagError")


def file_status(t: Tables) -> DataFrame:
    """(doc_id, status): ok, strict, analysis or template, by the worst of a file's errors."""
    kind = F.when(F.col("name").isin(*STRICT_ONLY), 1).when(F.col("name").isin(*ANALYSIS), 2).otherwise(3)
    worst = t.errors.groupBy("doc_id").agg(F.max(kind).alias("worst"))
    status = F.element_at(F.array(F.lit("ok"), F.lit("strict"), F.lit("analysis"), F.lit("template")), F.coalesce("worst", F.lit(0)) + 1)
    return t.docs.select("doc_id").join(worst, "doc_id", "left").select("doc_id", status.alias("status"))


def status_counts(t: Tables) -> DataFrame:
    return file_status(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tree_lines(t: Tables) -> DataFrame:
    """A line for each node, indented by depth, in document order by ``node_id``."""
    label = F.concat_ws(" ", "type", F.when(F.col("tag") != "", F.col("tag")), F.when(F.trim("content") != "", F.to_json(F.struct(F.substring("content", 1, 40).alias("text")))))
    return t.nodes.select("doc_id", "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), label, F.format_string(" (%d:%d)", "line", "column")).alias("text"))


def folding_ranges(t: Tables) -> DataFrame:
    last = t.nodes.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.max("line").alias("end_line"))
    return t.elements.select("doc_id", "node_id", "tag", F.col("line").alias("start_line")).join(last, ["doc_id", "node_id"]).where("end_line > start_line")


def register(spark: SparkSession) -> None:
    """SQL table functions ``lex(source)``, ``parse_errors(source)`` (every error of a source) and ``tree_diff(old, new)``."""

    @udtf(returnType="idx int, type string, value string, range_from int, range_to int")
    class Lex:
        def eval(self, source: str):
            from tessera.operators.lexer import lex

            for i, t in enumerate(lex(source)):
                yield i, t[0], t[1], t[2], t[3]

    @udtf(returnType="name string, message string, line int, col int")
    class ParseErrors:
        def eval(self, source: str):
            from tessera.operators.parser import Options, parse

            for r in parse(source, Options(max_errors=1 << 30)):
                if r["kind"] == "error":
                    yield r["name"], r["message"], r["line"], r["column"]

    @udtf(returnType="op_index int, type string, path string")
    class TreeDiff:
        def eval(self, old: str, new: str):
            from tessera.operators.diff import diff

            for i, (kind, path, *_) in enumerate(diff(old, new)):
                yield i, kind, ".".join(map(str, path))

    spark.udtf.register("lex", Lex)
    spark.udtf.register("parse_errors", ParseErrors)
    spark.udtf.register("tree_diff", TreeDiff)
