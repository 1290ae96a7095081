"""Rules over branches, siblings, client state and other files: joins and windows of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.directives import named
from tessera.lint.catalogue import Rule, sql_list
from tessera.operators import erb, graph
from tessera.operators.tables import Tables

#: Common helpers of the view layer.
HELPERS = (
    "tag content_tag link_to button_to mail_to image_tag form_with form_for form_tag label select text_field text_area check_box submit_tag url_for render capture content_for "
    "javascript_tag stylesheet_link_tag turbo_frame_tag truncate pluralize number_to_currency time_ago_in_words simple_format cycle concat raw"
).split()


def _offense(df: DataFrame, message: str) -> DataFrame:
    return df.select("doc_id", "line", "column", F.expr(message).alias("message"))


def helper_shadowing(t: Tables) -> DataFrame:
    assigned = t.erb.where("opening <> '<%#'").withColumn("name", F.regexp_extract("content", r"^\s*([a-z_]\w*)\s*=(?![=~>])", 1))
    return _offense(assigned.where(F.col("name").isin(HELPERS)), "concat('Local variable `', name, '` shadows a helper')")


def _literal_type(c: Column) -> Column:
    return (
        F.when(c.rlike("^(\"[^\"]*\"|'[^']*')$"), "string").when(c.rlike("^-?[0-9]+$"), "integer").when(c.rlike("^-?[0-9]+[.][0-9]+$"), "float").when(c.isin("true", "false"), "boolean")
        .when(c.rlike(r"^\["), "array").when(c.rlike(r"^\{"), "hash").when(c.rlike("^:"), "symbol")
    )


def mistyped_locals(t: Tables) -> DataFrame:
    index = graph.partial_index(t.docs).select(F.col("name").alias("partial_name"), F.col("doc_id").alias("callee"))
    passed = graph.calls(t).withColumnRenamed("name", "partial_name").join(index, "partial_name").select("doc_id", "line", "column", "callee", F.explode("locals").alias("name", "value"))
    declared = erb.strict_locals(t).where("default_source is not null").select(F.col("doc_id").alias("callee"), "name", _literal_type(F.col("default_source")).alias("want"))
    both = passed.withColumn("got", _literal_type(F.trim("value"))).join(declared, ["callee", "name"])
    return _offense(both.where("got <> want"), "concat('`', name, '` is ', got, ' and declared as ', want)")


def redundant_local_assigns(t: Tables) -> DataFrame:
    declared = erb.strict_locals(t).select("doc_id").distinct()
    return _offense(t.erb.where("opening <> '<%#' and content rlike '\\\\blocal_assigns\\\\b'").join(declared, "doc_id", "left_semi"), "'`local_assigns` beside strict locals'")


def strict_locals_error(t: Tables) -> DataFrame:
    return graph.strict_local_mismatches(t).select("doc_id", "line", F.lit(0).alias("column"), F.format_string("`%s` is %s for `%s`", "local", "problem", "name").alias("message"))


def prefer_collection_render(t: Tables) -> DataFrame:
    inside = t.nodes.where("not (type = 'text' and trim(content) = '')").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.expr("type = 'erb' and opening = '<%=' and content rlike '^\\\\s*render\\\\b'")).alias("render")
    )
    loops = t.blocks.where("control = 'block' and content rlike '[.]each\\\\s+do\\\\b'")
    return _offense(loops.join(inside.where("n = 1 and render"), ["doc_id", "node_id"], "left_semi"), "'Render the collection'")


def prefer_pluralize(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    tags = t.erb.where("opening = '<%=' and place = 'content'").withColumn("next", F.lead("content").over(w))
    return _offense(tags.where("content rlike '[.](count|size|length)\\\\s*$' and next rlike '[.]pluralize\\\\b'"), "'Use `pluralize`'")


def conditional_html_element(t: Tables) -> DataFrame:
    """A tag opened in one conditional and closed in a later one of the same condition."""
    blocks = t.blocks.where("control in ('if', 'unless')").select("doc_id", "node_id", F.trim("content").alias("condition"), "line", "column")
    opened = t.elements.where("close = 'missing'").select("doc_id", F.col("parent_id").alias("node_id"), "tag").join(blocks, ["doc_id", "node_id"])
    closed = t.nodes.where("type = 'stray_close'").select("doc_id", F.col("parent_id").alias("node_id"), "tag").join(blocks, ["doc_id", "node_id"]).groupBy("doc_id", "condition", "tag").agg(F.max("node_id").alias("last"))
    return _offense(opened.join(closed, ["doc_id", "condition", "tag"]).where("last > node_id"), "concat('`<', tag, '>` is opened and closed in separate conditionals')")


def _branch_heads(t: Tables) -> DataFrame:
    """For each branch of a block: its first node that is not blank, and how many there are."""
    inside = t.rows.where("kind = 'node' and size(branch) > 0 and not (type = 'text' and trim(content) = '')").withColumn("of", F.expr("branch[size(branch) - 1]"))
    direct = inside.where(F.col("parent_id") == F.split("of", ":")[0].cast("int"))
    key = F.to_json(F.struct("type", "raw", "close", F.map_entries("attr").alias("attr")))
    return direct.groupBy("doc_id", F.col("parent_id").alias("node_id"), "of").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("type", "tag", "close", key.alias("key")), F.col("pos")).alias("head"))


def conditional_open_tag(t: Tables) -> DataFrame:
    heads = _branch_heads(t).groupBy("doc_id", "node_id").agg(
        F.count(F.lit(1)).alias("branches"), F.bool_and(F.expr("n = 1 and head.type = 'element' and head.close = 'missing'")).alias("all_open"), F.countDistinct("head.tag").alias("tags")
    )
    return _offense(t.blocks.where("control in ('if', 'unless')").join(heads.where("branches > 1 and all_open and tags = 1"), ["doc_id", "node_id"], "left_semi"), "'Only the open tag differs'")


def duplicate_branch_elements(t: Tables) -> DataFrame:
    heads = _branch_heads(t).groupBy("doc_id", "node_id").agg(
        F.count(F.lit(1)).alias("filled"), F.bool_and(F.expr("head.type = 'element' and head.close = 'tag'")).alias("elements"), F.countDistinct("head.key").alias("kinds")
    )
    blocks = t.blocks.where("control in ('if', 'unless', 'case') and size(branches) > 1").withColumn("wanted", F.expr("case when control = 'case' then size(branches) - 1 else size(branches) end"))
    ends = t.erb.where("control = 'else'").select("doc_id", "node_id").distinct()
    found = blocks.join(ends, ["doc_id", "node_id"], "left_semi").join(heads, ["doc_id", "node_id"]).where("filled = wanted and elements and kinds = 1")
    return _offense(found, "'Every branch begins with the same element'")


# -- client state
def _kind(source: Column) -> Column:
    return F.coalesce(_literal_type(source), F.when(source == "", "missing").when(source == "nil", "nil").otherwise("bare"))


def state_declarations(t: Tables) -> DataFrame:
    rows = erb.states(t).withColumn("kind", _kind(F.col("default_source")))
    bad = rows.where("kind in ('missing', 'float', 'array', 'hash') or not name rlike '^[a-z_]'")
    broken = t.erb.where(named("opening = '<%#' and content rlike '^\\\\s*{word}:state' and content not rlike '^\\\\s*{word}:state\\\\s*\\\\(.*\\\\)\\\\s*$'"))
    return _offense(bad, "concat('State `', name, '` has a ', kind, ' default')").unionByName(_offense(broken, "'State declaration does not parse'"))


def state_unused(t: Tables) -> DataFrame:
    return _offense(erb.unused_states(t), "concat('State `', name, '` is never used')")


def state_client_mode(t: Tables) -> DataFrame:
    client = t.erb.where(named("opening = '<%#' and content rlike '^\\\\s*{word}:slots\\\\s+client\\\\s*$'")).select("doc_id").distinct()
    first = erb.states(t).groupBy("doc_id").agg(F.min(F.struct("line", "column")).alias("x")).select("doc_id", "x.*")
    return _offense(first.join(client, "doc_id", "left_anti"), "'States need client-mode slots'")


def _actions(t: Tables) -> DataFrame:
    """A row for each state that an action attribute names: operation, state and assigned value."""
    acts = t.attributes.where(named("name rlike '^data-{word}-(set|toggle|increment|decrement|reset)$' and size(parts) = 1"))
    clause = F.explode(F.filter(F.transform(F.split("value", ";"), lambda x: F.trim(F.regexp_replace(x, "^\\s*[a-z:]+->", ""))), lambda x: x != ""))
    one = acts.select("doc_id", "line", "column", F.substring_index("name", "-", -1).alias("operation"), clause.alias("clause"))
    item = F.explode(F.filter(F.transform(F.split("clause", r"[,\s]+"), lambda x: F.trim(x)), lambda x: x != ""))
    return one.select("doc_id", "line", "column", "operation", item.alias("item")).withColumns({"state": F.regexp_extract("item", r"^(\w+)", 1), "assigned": F.when(F.col("item").contains("="), F.regexp_replace("item", r"^[^=]*=\s*[\"']?|[\"']$", ""))})


def state_actions(t: Tables) -> DataFrame:
    declared = erb.states(t).select("doc_id", F.col("name").alias("state"), _kind(F.col("default_source")).alias("kind"))
    rows = _actions(t).join(declared, ["doc_id", "state"], "left")
    wrong = rows.withColumn(
        "why",
        F.expr(
            "case when kind is null then 'is not declared' when operation = 'set' and assigned is null then 'is given no value' when operation = 'toggle' and kind not in ('boolean', 'bare') then 'is no boolean' "
            "when operation in ('increment', 'decrement') and kind not in ('integer', 'bare') then 'is no integer' when operation = 'set' and assigned <> '$value' and kind = 'boolean' and assigned not in ('true', 'false') then 'is a boolean' "
            "when operation = 'set' and assigned <> '$value' and kind = 'integer' and assigned not rlike '^-?[0-9]+$' then 'is an integer' end"
        ),
    )
    return _offense(wrong.where("why is not null"), "concat('State `', state, '` ', why)")


def state_bindings(t: Tables) -> DataFrame:
    """``checked`` and ``selected`` bind booleans; ``value`` binds a string or an integer."""
    parts = t.attributes.where("name in ('checked', 'selected', 'value') and size(parts) = 1 and parts[0].kind = 'erb_output'").withColumn("state", F.regexp_extract(F.expr("parts[0].text"), r"^\s*([a-z_]\w*)\??\s*$", 1))
    declared = erb.states(t).select("doc_id", F.col("name").alias("state"), _kind(F.col("default_source")).alias("kind"))
    bad = parts.join(declared, ["doc_id", "state"]).where("(name in ('checked', 'selected') and kind not in ('boolean', 'bare')) or (name = 'value' and kind = 'boolean')")
    return _offense(bad, "concat('`', name, '` cannot bind the ', kind, ' state `', state, '`')")


def state_reads(t: Tables) -> DataFrame:
    """A predicate read of a state that is no boolean."""
    reads = t.erb.where("opening <> '<%#'").withColumn("state", F.regexp_extract("content", r"^\s*(?:if|unless|elsif)?\s*([a-z_]\w*)\?\s*$", 1)).where("state <> ''")
    declared = erb.states(t).select("doc_id", F.col("name").alias("state"), _kind(F.col("default_source")).alias("kind"))
    return _offense(reads.join(declared, ["doc_id", "state"]).where("kind not in ('boolean', 'bare')"), "concat('State `', state, '` is no boolean')")


def into_requires_collection(t: Tables) -> DataFrame:
    slots = t.attributes.where(named("name = 'data-{word}-name' and size(parts) = 1")).select("doc_id", F.col("node_id"), F.trim("value").alias("target"))
    loops = t.erb.where(named("opening = '<%#' and content rlike '^\\\\s*{word}:key\\\\b'")).select("doc_id").distinct()
    keyed = slots.join(loops, "doc_id", "left_semi").select("doc_id", "target").distinct()
    targets = t.attributes.where(named("name = 'data-{word}-into'")).withColumn("target", F.when(F.expr("exists(parts, p -> p.kind = 'erb_output')"), "").otherwise(F.trim(F.coalesce("value", F.lit("")))))
    return _offense(targets.join(keyed, ["doc_id", "target"], "left_anti"), named("'`data-{word}-into` names no keyed collection'"))


def slot_names(t: Tables) -> DataFrame:
    rows = t.attributes.where(named("name = 'data-{word}-name'"))
    blank = rows.where("exists(parts, p -> p.kind = 'erb_output') or trim(coalesce(value, '')) = ''")
    counted = rows.where("size(parts) = 1 and trim(value) <> ''").withColumn("slot", F.trim("value"))
    first = counted.groupBy("doc_id", "slot").agg(F.min("node_id").alias("first"))
    again = counted.join(first, ["doc_id", "slot"]).where("node_id > first")
    return _offense(blank, "'A slot name must be static and not empty'").unionByName(_offense(again, "concat('Slot `', slot, '` is named twice')"))


def _rule(name: str, severity: str, framework: str = "ruby") -> Rule:
    return Rule(name, "XFILE", severity, True, "", "", framework=framework)


CROSSFILE: list[tuple[Rule, Callable[[Tables], DataFrame]]] = [
    (_rule("actionview-no-helper-shadowing", "warning", "actionview"), helper_shadowing),
    (_rule("actionview-no-mistyped-locals", "warning", "actionview"), mistyped_locals),
    (_rule("actionview-no-redundant-local-assigns", "error", "actionview"), redundant_local_assigns),
    (_rule("actionview-no-strict-locals-error", "error", "actionview"), strict_locals_error),
    (_rule("actionview-prefer-collection-render", "error", "actionview"), prefer_collection_render),
    (_rule("actionview-prefer-pluralize-helper", "warning", "actionview"), prefer_pluralize),
    (_rule("erb-no-conditional-html-element", "error"), conditional_html_element),
    (_rule("erb-no-conditional-open-tag", "error"), conditional_open_tag),
    (_rule("erb-no-duplicate-branch-elements", "warning"), duplicate_branch_elements),
    (_rule(named("{word}-state-valid-declaration"), "error"), state_declarations),
    (_rule(named("{word}-state-no-unused-states"), "warning"), state_unused),
    (_rule(named("{word}-state-requires-client-mode"), "error"), state_client_mode),
    (_rule(named("{word}-state-valid-actions"), "error"), state_actions),
    (_rule(named("{word}-state-valid-bindings"), "error"), state_bindings),
    (_rule(named("{word}-state-valid-reads"), "error"), state_reads),
    (_rule(named("{word}-into-requires-collection"), "error"), into_requires_collection),
    (_rule(named("{word}-valid-slot-names"), "error"), slot_names),
]


def helper_condition() -> str:
    return f"regexp_extract(content, '^\\\\s*([a-z_]+)', 1) in {sql_list(HELPERS)}"
