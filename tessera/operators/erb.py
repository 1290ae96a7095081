"""Tables from embedded tags: render calls, strict locals, words, states and helper calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.directives import named
from tessera.operators.tables import Tables

RENDER_KEYS = ("partial", "template", "layout", "file", "inline", "body", "plain", "html", "renderable", "collection", "object", "as", "spacer_template", "formats", "variants", "handlers", "content_type")
_STRING = "\"([^\"]*)\"|'([^']*)'"


def _arg(text: Column, key: str) -> Column:
    """A keyword argument's source text; null without one."""
    got = F.regexp_extract(text, rf"(?:^|[\s,(])(?::{key}\s*=>|{key}:)\s*(\"[^\"]*\"|'[^']*'|:\w+|[@\w.\[\]()]+)", 1)
    return F.when(got != "", got)


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"':]|[\"']$", "")


def render_calls(t: Tables) -> DataFrame:
    """A row for each ``render`` call: partial or object, options, locals, whether the path is dynamic."""
    code = F.trim("content")
    calls = t.erb.where("opening <> '<%#' and content rlike '(^|[^\\\\w.])render(\\\\s|\\\\()'").withColumn("args", F.trim(F.regexp_extract("content", r"(?s)(?:^|[^\w.])render(?:\s+|\s*\()(.*?)\)?\s*(?:\bdo\b[^\n]*)?$", 1)))
    args = F.col("args")
    first = F.regexp_extract(args, r"^(\"[^\"]*\"|'[^']*')", 1)
    shorthand = first != ""
    keyword = _arg(args, "partial")
    source = F.when(shorthand, first).otherwise(keyword)
    renderable = F.regexp_extract(args, r"^(@?[a-z_][\w.]*)\s*(?:,|$)", 1)
    inner = F.when(shorthand, F.regexp_replace(args, r"^(\"[^\"]*\"|'[^']*')\s*,?", "")).otherwise(F.regexp_extract(args, r"locals:\s*\{([^}]*)\}", 1))
    pairs = F.filter(F.split(inner, r",(?=(?:[^\"']*[\"'][^\"']*[\"'])*[^\"']*$)"), lambda x: x.rlike(r"^\s*:?\w+\s*(?::|=>)"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^\s*:?(\w+)", 1).alias("key"), F.trim(F.regexp_replace(x, r"^\s*:?\w+\s*(?::|=>)", "")).alias("value")))
    # of repeated names the first counts
    distinct = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda z: z["key"]), e["key"]) == i + 1)
    out = calls.select(
        "doc_id", "node_id", "pos", "opening", "line", "column", "ancestors", "control", code.alias("code"), args.alias("args"),
        _plain(source).alias("partial"), shorthand.alias("shorthand"), F.when(~shorthand & keyword.isNull() & (renderable != ""), renderable).alias("renderable"),
        *[_plain(_arg(args, k)).alias(f"{k}_option") for k in RENDER_KEYS if k != "partial"],
        F.map_from_entries(distinct).alias("locals"),
        (F.col("control") == "block").alias("has_block"),
    )
    dynamic = (F.col("partial").isNotNull() & ~F.col("partial").rlike("^[a-z0-9_/]+$")) | (F.col("args").rlike(r"^(\"[^\"]*\"|'[^']*')\s*\+"))
    return out.withColumn("is_dynamic", F.coalesce(dynamic, F.lit(False)))


def render_errors(t: Tables) -> DataFrame:
    """(doc_id, name, line, column): misuse of ``render``."""
    c = render_calls(t)
    cases = {
        "RenderAmbiguousLocalsError": "shorthand and map_contains_key(locals, 'locals')",
        "RenderMissingLocalsError": "not shorthand and partial is not null and args not rlike 'locals:' and args rlike ',\\\\s*(?!collection|object|as|layout|formats|variants|handlers|spacer_template|locals)[a-z_]+:'",
        "RenderNoArgumentsError": "args = ''",
        "RenderConflictingPartialError": "shorthand and args rlike '[,\\\\s]partial:'",
        "RenderInvalidAsOptionError": "as_option is not null and as_option not rlike '^[a-z_][a-z0-9_]*$'",
        "RenderObjectAndCollectionError": "object_option is not null and collection_option is not null",
        "RenderLayoutWithoutBlockError": "layout_option is not null and not has_block and partial is null and template_option is null",
    }
    hits = F.array(*[F.when(F.expr(where), F.lit(name)) for name, where in cases.items()])
    return c.select("doc_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("name"), "line", "column")


def strict_locals(t: Tables) -> DataFrame:
    """Declared locals (doc_id, name, kind, required, default_source, line, column) of the first declaration of a template."""
    body = F.regexp_extract("content", r"^\s*locals:\s*\((.*)\)\s*$", 1)
    found = t.erb.where("opening = '<%#' and content rlike '^\\\\s*locals:\\\\s*\\\\('").withColumn("body", body)
    first = found.groupBy("doc_id").agg(F.min_by(F.struct("body", "line", "column"), F.col("pos")).alias("x")).select("doc_id", "x.*")
    parts = first.withColumn("part", F.explode(F.filter(F.transform(F.split("body", r",(?![^\[({]*[\])}])"), lambda x: F.trim(x)), lambda x: x != "")))
    part = F.col("part")
    kind = F.when(part.startswith("**"), "keyword_rest").when(part.startswith("*"), "rest").when(part.startswith("&"), "block").when(part.rlike(r"^\w+:"), "keyword").otherwise("positional")
    default = F.trim(F.regexp_replace(part, r"^\w+:\s*", ""))
    return parts.select(
        "doc_id", F.regexp_extract(part, r"(\w+)", 1).alias("name"), kind.alias("kind"), ((kind == "keyword") & (default == "")).alias("required"),
        F.when((kind == "keyword") & (default != ""), default).alias("default_source"), "line", "column",
    )


def strict_local_errors(t: Tables) -> DataFrame:
    name = F.create_map(F.lit("positional"), F.lit("StrictLocalsPositionalArgumentError"), F.lit("block"), F.lit("StrictLocalsBlockArgumentError"), F.lit("rest"), F.lit("StrictLocalsSplatArgumentError"))
    bad = strict_locals(t).where("kind in ('positional', 'block', 'rest')").select("doc_id", name[F.col("kind")].alias("name"), "line", "column")
    comments = t.erb.where("opening = '<%#'")
    bare = comments.where("content rlike '^\\\\s*locals:\\\\s*[^\\\\s(]'").select("doc_id", F.lit("StrictLocalsMissingParenthesisError").alias("name"), "line", "column")
    all_ = comments.where("content rlike '^\\\\s*locals:\\\\s*\\\\('")
    first = all_.groupBy("doc_id").agg(F.min("pos").alias("first"))
    again = all_.join(first, "doc_id").where("pos > first").select("doc_id", F.lit("StrictLocalsDuplicateDeclarationError").alias("name"), "line", "column")
    return bad.unionByName(bare).unionByName(again)


def words(t: Tables, among: Callable[[Tables], DataFrame] | None = None) -> DataFrame:
    """(doc_id, name, uses): identifiers of a template's code, strings kept only where they interpolate; of all, or of the names that ``among`` finds."""
    code = F.regexp_replace("content", r"'[^']*'|\"[^\"#]*\"", " ")
    names = F.regexp_extract_all(code, F.lit(r"(?<![\w@$:.])([a-z_]\w*)(?![\w?!]*:(?!:))"), F.lit(1))

    def used(x: Tables) -> DataFrame:
        found = x.erb.where("opening <> '<%#'").select("doc_id", F.explode(names).alias("name"))
        if among:
            found = found.join(among(x).select("name").distinct(), "name", "left_semi")
        return found.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("uses"))

    return used(t) if t.local is None else t.picked(used).groupBy("doc_id", "name").agg(F.sum("uses").alias("uses"))


def instance_variables(t: Tables) -> DataFrame:
    return t.erb.where("opening <> '<%#'").select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(r"(@[a-z_]\w*)"), F.lit(1))).alias("name")).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("uses"))


def constants(t: Tables) -> DataFrame:
    code = F.regexp_replace("content", r"'[^']*'|\"[^\"#]*\"", " ")
    return t.erb.where("opening <> '<%#'").select("doc_id", F.explode(F.regexp_extract_all(code, F.lit(r"(?<![\w:])([A-Z]\w*(?:::[A-Z]\w*)*)"), F.lit(1))).alias("name")).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("uses"))


def states(t: Tables) -> DataFrame:
    """Declared client state: (doc_id, name, default_source)."""
    body = F.regexp_extract("content", named(r"^\s*{word}:state\s*\((.*)\)\s*$"), 1)
    part = F.explode(F.filter(F.transform(F.split(body, r",(?![^\[({]*[\])}])"), lambda x: F.trim(x)), lambda x: x != ""))
    return t.erb.where(named("opening = '<%#' and content rlike '^\\\\s*{word}:state'")).select("doc_id", "line", "column", part.alias("part")).select(
        "doc_id", F.regexp_extract("part", r"^(\w+)", 1).alias("name"), F.trim(F.regexp_replace("part", r"^\w+:?\s*", "")).alias("default_source"), "line", "column"
    )


def unused_states(t: Tables) -> DataFrame:
    acts = t.attributes.where(named("name rlike '^data-{word}-(set|toggle|increment|decrement|reset)$'")).select("doc_id", F.explode(F.regexp_extract_all("value", F.lit(r"(\w+)"), F.lit(1))).alias("name"))
    used = words(t).select("doc_id", "name").unionByName(acts).distinct()
    return states(t).join(used, ["doc_id", "name"], "left_anti")
