"""The lint run: rule selection, offenses, suppression, severities and reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.directives import named
from tessera.lint.catalogue import RULES, Rule
from tessera.lint.crossfile import CROSSFILE
from tessera.lint.relational import LOCAL
from tessera.lint.relational import RELATIONAL as _WINDOWED
from tessera.lint.relational import directives
from tessera.operators.tables import Tables
from tessera.session import checkpoint

RELATIONAL = [*_WINDOWED, *CROSSFILE]
LEVELS = ("error", "warning", "info", "hint")


@dataclass
class Config:
    """What a project sets: rules switched on or off, severities, framework, version gate and path patterns."""

    only: tuple[str, ...] = ()
    all_rules: bool = False
    rules: dict[str, bool] = field(default_factory=dict)
    severities: dict[str, str] = field(default_factory=dict)
    framework: str = "ruby"
    version: str = ""
    gate: bool = True
    fail_level: str = "error"
    exclude: dict[str, str] = field(default_factory=dict)
    custom: list[tuple[Rule, Callable[[Tables], DataFrame]]] = field(default_factory=list)


def semver(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split("-")[0].split("."))


def selected(rule: Rule, config: Config) -> bool:
    """Named alone, then all, then the user's entry, then the version gate, then the default; the framework gate last."""
    if config.only:
        return rule.name in config.only
    if rule.framework == "unset":
        return not config.framework
    if rule.framework == "actionview" and config.framework != "actionview" and not config.all_rules:
        return False
    if config.all_rules:
        return True
    if rule.name in config.rules:
        return config.rules[rule.name]
    if config.version and semver(rule.introduced) > semver(config.version):
        return False
    return rule.enabled


def catalogue(spark: SparkSession) -> DataFrame:
    """(rule, source, severity, enabled, fixable, framework) of every rule."""
    rows = [(r.name, r.source, r.severity, r.enabled, r.fixable, r.framework) for r in [*RULES, *(r for r, _ in RELATIONAL)]]
    return spark.createDataFrame(rows, "rule string, source string, severity string, enabled boolean, fixable string, framework string")


#: What a condition may ask that a piece of a document cannot tell.
_WIDE = re.compile(r"\b(doc_id|node_id|parent_id|pos|line|range_from|range_to|branch|is_partial|path)\b")


def _local(rule: Rule) -> bool:
    """Whether a condition holds of the same rows when a document's pieces are read alone."""
    return rule.source in ("ELEM", "ATTR", "BLOCK", "TEXT", "ERB") and not _WIDE.search(re.sub("'[^']*'", "", rule.where) + re.sub("'[^']*'", "", rule.message))


def _table(t: Tables, source: str, rules: Iterable[Rule]) -> DataFrame:
    if source == "DOC":
        return t.docs.withColumns({"line": F.lit(1), "column": F.lit(0)})
    if source == "TEXT":
        return t.nodes.where("type = 'text'")
    if source == "ERB" and any("is_partial" in r.where for r in rules):
        partial = t.docs.select("doc_id", F.coalesce(F.expr("path rlike '(^|/)_[^/]+$'"), F.lit(False)).alias("is_partial"))
        return t.erb.join(partial, "doc_id")
    return {"ELEM": lambda: t.elements, "ATTR": lambda: t.attributes, "ERB": lambda: t.erb, "BLOCK": lambda: t.blocks, "ERROR": lambda: t.errors}[source]()


def by_conditions(t: Tables, rules: Iterable[Rule]) -> list[DataFrame]:
    """Offenses of condition rules: each table is read once for all of its rules, which explode into rows."""
    out = []
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.source, []).append(r)
    for source, rules_ in groups.items():
        hits = F.array(*[F.when(F.expr(r.where), F.struct(F.lit(r.name).alias("rule"), F.expr(r.message).alias("message"))) for r in rules_])
        found = _table(t, source, rules_).withColumn("hit", F.explode(F.filter(hits, lambda x: x.isNotNull())))
        out.append(found.select("doc_id", F.col("hit.rule").alias("rule"), "line", "column", F.col("hit.message").alias("message")))
    return out


def offenses(t: Tables, config: Config | None = None, suppress: bool = True) -> DataFrame:
    """(doc_id, rule, severity, line, column, message) under ``config``.

    With ``gate`` a document that failed to parse yields parser errors alone;
    without it rules run on the recovered tree.
    """
    config = config or Config()
    spark = t.docs.sparkSession
    chosen = [r for r in RULES if selected(r, config)]
    parts, rest = [], t
    if config.gate:
        failed = t.errors.select("doc_id").distinct()
        rest = t.without(failed)
        parts += by_conditions(t, [r for r in chosen if r.source == "ERROR"])
        chosen = [r for r in chosen if r.source != "ERROR"]
    apart, within = rest.local, []
    if apart:
        within += by_conditions(apart, [r for r in chosen if _local(r)])
        chosen = [r for r in chosen if not _local(r)]
    parts += by_conditions(rest, chosen)
    for r, f in [*RELATIONAL, *config.custom]:
        if selected(r, config):
            to, of = (within, apart) if apart and f in LOCAL else (parts, rest)
            to.append(f(of).select("doc_id", F.lit(r.name).alias("rule"), "line", "column", "message"))
    if within:
        parts.append(rest.placed(reduce(DataFrame.unionByName, within)))
    if not parts:
        return spark.createDataFrame([], "doc_id long, rule string, severity string, line int, column int, message string")
    found = reduce(DataFrame.unionByName, parts)
    if suppress:
        # the rules run once; suppression reads their offenses several times
        found = checkpoint(found)
    for name, pattern in config.exclude.items():
        skip = t.docs.where(F.col("path").rlike(pattern)).select("doc_id", F.lit(name).alias("rule"))
        found = found.join(skip, ["doc_id", "rule"], "left_anti")
    if suppress:
        found = suppressed(t, found, unnecessary=named("{word}-disable-comment-unnecessary") in config.only or not config.only)
    level = F.create_map(*[F.lit(x) for r in [*RULES, *(r for r, _ in RELATIONAL), *(r for r, _ in config.custom)] for x in (r.name, config.severities.get(r.name, r.severity))])
    severity = F.coalesce(level[F.col("rule")], F.lit("warning"))
    return found.select("doc_id", "rule", severity.alias("severity"), "line", "column", "message")


def suppressed(t: Tables, found: DataFrame, unnecessary: bool = True) -> DataFrame:
    """Offenses left by ``<word>:disable`` comments of their line and by whole-file ignores; then comments that hid nothing."""
    d = directives(t)
    ignored = d.where("kind = 'linter' and body = 'ignore'").select("doc_id").distinct()
    found = found.join(ignored, "doc_id", "left_anti")
    hides = d.where("kind = 'disable'").select("doc_id", "line", F.explode("names").alias("hidden")).distinct()
    single = hides.where("hidden <> 'all'").select("doc_id", "line", F.col("hidden").alias("rule"))
    every = hides.where("hidden = 'all'").select("doc_id", "line")
    left = found.join(single, ["doc_id", "line", "rule"], "left_anti").join(every, ["doc_id", "line"], "left_anti")
    if not unnecessary:
        return left.select(*found.columns)
    used = found.select("doc_id", "line", F.explode(F.array("rule", F.lit("all"))).alias("hidden")).distinct()
    idle = hides.join(used, ["doc_id", "line", "hidden"], "left_anti")
    idle = idle.select("doc_id", F.lit(named("{word}-disable-comment-unnecessary")).alias("rule"), "line", F.lit(0).alias("column"), F.concat(F.lit("Nothing to disable for `"), "hidden", F.lit("`")).alias("message"))
    return left.select(*found.columns).unionByName(idle.select(*found.columns))


def at_least(severity: Column, level: str) -> Column:
    """Whether a severity is as bad as ``level``."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), severity) <= LEVELS.index(level) + 1


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def most_violated(found: DataFrame, k: int = 5) -> DataFrame:
    """The top-k report."""
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).orderBy(F.desc("n"), "rule").limit(k)


def once_per_run(found: DataFrame, rules: Iterable[str]) -> DataFrame:
    """Of project-wide rules the first offense only; found by aggregation, so no rule's rows meet in one task."""
    wide = F.col("rule").isin(list(rules))
    first = found.where(wide).groupBy("rule").agg(F.min(F.struct("doc_id", "line", "column", "severity", "message")).alias("x")).select("rule", "x.*")
    return found.where(~wide).unionByName(first.select(*found.columns))


def github_annotations(found: DataFrame, docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    return found.join(docs.select("doc_id", "path"), "doc_id").select(
        F.format_string("::%s file=%s,line=%d,col=%d::%s (%s)", kind, F.coalesce("path", F.lit("")), "line", F.col("column") + 1, "message", "rule").alias("annotation")
    )


def json_report(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct("doc_id", "rule", "severity", "line", "column", "message")).alias("json"))


def simple_report(found: DataFrame) -> DataFrame:
    return found.select(F.format_string("%d:%d:%d %s %s [%s]", "doc_id", "line", "column", "severity", "message", "rule").alias("report"))


def diagnostics(t: Tables) -> DataFrame:
    """Parse errors by name: count and documents."""
    return t.errors.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def new_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """Offenses of ``after`` without one of the same document, rule and line in ``before``."""
    return after.join(before.select("doc_id", "rule", "line").distinct(), ["doc_id", "rule", "line"], "left_anti")


def ranked(found: DataFrame) -> DataFrame:
    """Offenses numbered within their document."""
    return found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "column", "rule", "message")))
