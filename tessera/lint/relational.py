"""Rules that need a window, a join or an explode, as functions from the tables to offenses (doc_id, line, column, message)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.directives import named
from tessera.lint.catalogue import Rule
from tessera.operators.tables import Tables


def exclusive(a: str, b: str) -> F.Column:
    """Whether two branch paths lie in different branches of one block, so both can never appear together."""
    return F.expr(f"exists({a}, x -> exists({b}, y -> split(x, ':')[0] = split(y, ':')[0] and x <> y))")


def _offense(df: DataFrame, message: str) -> DataFrame:
    return df.select("doc_id", "line", "column", F.expr(message).alias("message"))


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with an earlier row of the same keys that is not in an exclusive branch.

    The earlier branch paths of a key travel in a window; a key with one row only
    ends in the first filter, so nothing is paired within a group.
    """
    w = Window.partitionBy(*keys).orderBy("line", "column", "seq")
    seen = df.withColumn("earlier", F.collect_set("branch").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.where(F.expr("size(earlier) > 0 and exists(earlier, e -> not exists(e, x -> exists(branch, y -> split(x, ':')[0] = split(y, ':')[0] and x <> y)))"))


def duplicate_attributes(t: Tables) -> DataFrame:
    return _offense(_repeated(t.attributes.where("name <> ''").withColumn("seq", F.col("pos")), ["doc_id", "node_id", "name"]), "concat('Duplicate attribute `', name, '`')")


def duplicate_ids(t: Tables) -> DataFrame:
    ids = "name = 'id' and value <> '' and size(parts) = 1 and not array_contains(ancestors, 'template')"
    rows = t.picked(lambda x: x.attributes.where(ids).select("doc_id", "value", "line", "column", "branch", F.col("node_id").alias("seq")))
    return _offense(_repeated(rows, ["doc_id", "value"]), "concat('Duplicate id `', value, '`')")


def duplicate_meta_names(t: Tables) -> DataFrame:
    key = F.explode(F.expr("filter(array(concat('name:', lower(attr['name'])), concat('http-equiv:', lower(attr['http-equiv']))), x -> x is not null)")).alias("key")
    rows = t.picked(lambda x: x.elements.where("tag = 'meta' and array_contains(ancestors, 'head')").select("doc_id", "line", "column", "branch", F.col("node_id").alias("seq"), key))
    return _offense(_repeated(rows, ["doc_id", "key"]), "concat('Duplicate meta ', key)")


def duplicate_disabled_rules(t: Tables) -> DataFrame:
    rows = directives(t).where("kind = 'disable'").select("doc_id", "line", "column", F.explode("names").alias("name"))
    return _offense(rows.groupBy("doc_id", "line", "column", "name").count().where("count > 1"), "concat('Rule `', name, '` is listed more than once')")


def directives(t: Tables) -> DataFrame:
    """``<word>:`` comments: kind (disable, linter ignore, formatter ignore, state, slots), text and listed names."""
    body = F.regexp_extract("content", named(r"^\s*{word}:(\w+)\s*([\s\S]*?)\s*$"), 2)
    return t.picked(
        lambda x: x.erb.where(named("opening = '<%#' and content rlike '^\\\\s*{word}:'"))
        .withColumn("kind", F.regexp_extract("content", named(r"^\s*{word}:(\w+)"), 1))
        .withColumn("body", body)
        .withColumn("names", F.filter(F.transform(F.split("body", ","), lambda x: F.trim(x)), lambda x: x != ""))
        .select("doc_id", "line", "column", "kind", "body", "names", "content")
    )


def disable_missing(t: Tables) -> DataFrame:
    return _offense(directives(t).where("kind = 'disable' and body = ''"), named("'`{word}:disable` names no rule'"))


def disable_malformed(t: Tables) -> DataFrame:
    return _offense(directives(t).where("kind = 'disable' and body rlike '^,|,\\\\s*,|,$'"), named("'Malformed `{word}:disable`'"))


def disable_redundant_all(t: Tables) -> DataFrame:
    return _offense(directives(t).where("kind = 'disable' and array_contains(names, 'all') and size(names) > 1"), "'`all` makes other names redundant'")


def disable_valid_name(t: Tables) -> DataFrame:
    from tessera.lint.engine import catalogue

    known = catalogue(t.docs.sparkSession).select(F.col("rule").alias("known"))
    rows = directives(t).where("kind = 'disable'").select("doc_id", "line", "column", F.explode("names").alias("name")).where("name <> 'all'")
    # the catalogue has a fixed number of rows
    unknown = rows.join(F.broadcast(known), F.col("name") == F.col("known"), "left_anti")
    near = unknown.select("name").distinct().join(F.broadcast(known), F.levenshtein("name", "known") <= 5, "left").groupBy("name").agg(F.min_by("known", F.struct(F.levenshtein("name", "known"), "known")).alias("near"))
    return _offense(unknown.join(near, "name"), "concat('Unknown rule `', name, '`', coalesce(concat('. Did you mean `', near, '`?'), ''))")


def unused_strict_locals(t: Tables) -> DataFrame:
    from tessera.operators.erb import strict_locals, words

    declared = strict_locals(t).where("kind = 'keyword'")
    return _offense(declared.join(words(t), ["doc_id", "name"], "left_anti"), "concat('Strict local `', name, '` is never used')")


def strict_locals_required(t: Tables) -> DataFrame:
    from tessera.operators.erb import strict_locals

    partial = t.docs.where("path rlike '(^|/)_[^/]+$'").select("doc_id", F.lit(1).alias("line"), F.lit(0).alias("column"))
    # a declaration may be empty
    declared = strict_locals(t).select("doc_id").unionByName(t.erb.where("opening = '<%#' and content rlike '^\\\\s*locals:\\\\s*\\\\('").select("doc_id"))
    return _offense(partial.join(declared.distinct(), "doc_id", "left_anti"), "'Partial without strict locals'")


def unused_local_variable(t: Tables) -> DataFrame:
    from tessera.operators.erb import words

    made = t.erb.where("opening <> '<%#' and control = ''").withColumn("name", F.regexp_extract("content", r"^\s*([a-z_]\w*)\s*=(?![=~>])", 1)).where("name <> '' and name not like '\\_%'")
    uses = words(t).withColumnRenamed("uses", "n")
    assigned = made.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("assigned"), F.min("line").alias("line"), F.min("column").alias("column"))
    return _offense(assigned.join(uses, ["doc_id", "name"]).where("n <= assigned"), "concat('Local variable `', name, '` is never used')")


def unused_block_argument(t: Tables) -> DataFrame:
    from tessera.operators.erb import words

    name = F.explode(F.expr("filter(transform(split(regexp_extract(content, '\\\\|([^|]*)\\\\|', 1), ','), x -> trim(x)), x -> x rlike '^[a-z][a-z0-9_]*$')")).alias("name")

    def args(x: Tables) -> DataFrame:
        return x.blocks.where("control = 'block'").select("doc_id", "line", "column", name)

    declared = t.picked(args).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("declared"), F.min("line").alias("line"), F.min("column").alias("column"))
    return _offense(declared.join(words(t, args), ["doc_id", "name"]).where("uses <= declared"), "concat('Block argument `', name, '` is never used')")


def render_ambiguous(t: Tables) -> DataFrame:
    from tessera.operators.erb import render_calls

    return _offense(render_calls(t).where("is_dynamic"), "'Dynamic partial path'")


def render_implicit(t: Tables) -> DataFrame:
    from tessera.operators.erb import render_calls

    return _offense(render_calls(t).where("partial is null and renderable is not null"), "'Implicit partial'")


def render_option_shadowing(t: Tables) -> DataFrame:
    from tessera.operators.erb import render_calls

    return _offense(render_calls(t).where("shorthand and exists(map_keys(locals), k -> k in ('collection', 'object', 'as', 'layout', 'formats', 'variants', 'handlers', 'spacer_template'))"), "'Local named like an option of render'")


def render_qualified(t: Tables) -> DataFrame:
    from tessera.operators.erb import render_calls

    return _offense(render_calls(t).where("partial is not null and not is_dynamic and not contains(partial, '/')"), "concat('Partial `', partial, '` names no directory')")


def shadowed_block_argument(t: Tables) -> DataFrame:
    """A block argument that an enclosing block binds: blocks meet by range containment within a document."""
    args = t.rows.where("kind = 'node' and type = 'block'").withColumn(
        "name", F.explode(F.expr("filter(transform(split(regexp_extract(content, '(?:\\\\||for )([^|]*?)(?:\\\\||in )', 1), ','), x -> trim(x)), x -> x rlike '^[a-z][a-z0-9_]*$')"))
    )
    w = Window.partitionBy("doc_id", "name").orderBy("range_from").rowsBetween(Window.unboundedPreceding, -1)
    return _offense(args.withColumn("open_until", F.max("range_to").over(w)).where("open_until > range_from"), "concat('Block argument `', name, '` shadows an outer one')")


RELATIONAL: list[tuple[Rule, Callable[[Tables], DataFrame]]] = [
    (Rule("html-no-duplicate-attributes", "WINDOW", "error", True, "", ""), duplicate_attributes),
    (Rule("html-no-duplicate-ids", "WINDOW", "error", True, "", ""), duplicate_ids),
    (Rule("html-no-duplicate-meta-names", "WINDOW", "error", True, "", ""), duplicate_meta_names),
    (Rule(named("{word}-disable-comment-no-duplicate-rules"), "DIR", "warning", True, "", ""), duplicate_disabled_rules),
    (Rule(named("{word}-disable-comment-missing-rules"), "DIR", "error", True, "", ""), disable_missing),
    (Rule(named("{word}-disable-comment-malformed"), "DIR", "error", True, "", ""), disable_malformed),
    (Rule(named("{word}-disable-comment-no-redundant-all"), "DIR", "warning", True, "", ""), disable_redundant_all),
    (Rule(named("{word}-disable-comment-valid-rule-name"), "DIR", "warning", True, "", ""), disable_valid_name),
    (Rule("actionview-no-unused-strict-locals", "ERB", "error", True, "", "", framework="actionview"), unused_strict_locals),
    (Rule("erb-strict-locals-required", "ERB", "error", False, "", ""), strict_locals_required),
    (Rule("erb-no-unused-local-variable", "ERB", "error", True, "", ""), unused_local_variable),
    (Rule("erb-no-unused-block-argument", "ERB", "error", True, "", ""), unused_block_argument),
    (Rule("erb-no-shadowed-block-argument", "ERB", "error", True, "", ""), shadowed_block_argument),
    (Rule("actionview-no-dynamic-partial-path", "XFILE", "info", True, "", "", framework="actionview"), render_ambiguous),
    (Rule("actionview-no-implicit-partial", "XFILE", "info", True, "", "", framework="actionview"), render_implicit),
    (Rule("actionview-no-render-option-shadowing", "XFILE", "info", True, "", "", framework="actionview"), render_option_shadowing),
    (Rule("actionview-prefer-qualified-partial-path", "XFILE", "info", True, "", "", framework="actionview"), render_qualified),
]

#: Rules of one element, tag or block and what lies within: found alike on a piece of a document that stands alone.
LOCAL = frozenset((duplicate_attributes, duplicate_disabled_rules, disable_missing, disable_malformed, disable_redundant_all, disable_valid_name, shadowed_block_argument))
