"""Queries of the engine on the driver's tables, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.directives import named
from tessera.lint import engine as lint
from tessera.lint.relational import directives
from tessera.operators import code, diff, erb, extract, graph, rewrite, textops
from tessera.operators import project as reports
from tessera.operators.lexer import tokens
from tessera.operators.parser import Options
from tessera.operators.tables import Tables
from tessera.plans import cases, fragments, shapes
from tessera.plans.project import project
from tessera.session import prepare, remove, shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Page source without the bodies of script and style, and its tags.
_TAGS = r"""with s as (select page_id, regexp_replace(html, '(?s)(<(script|style)[^>]*>).*?(</(script|style)>)', '\1\3', 'g') h from pages),
t as (select page_id, unnest(regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9:_-]*)', 1)) tag from s) """


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"), F.col("html").alias("source")))


def _page_tables(spark, sf_dir, keep: bool = False, **options) -> Tables:
    return Tables(_pages(spark, sf_dir), options=Options(**options) if options else None, keep=keep)


def _markup(spark, sf_dir, keep: bool = True, apart: bool = False) -> Tables:
    return Tables(fragments.corpus(spread(_read(spark, sf_dir, "part").select("p_partkey"))), keep=keep, apart=apart)


def _project(spark, sf_dir) -> Tables:
    prepare(spark)
    return Tables(project(spark, sf_dir))


# -- lexing and parsing
@query(_TAGS + "select tag, count(*) n from t where tag not like '/%' group by tag")
def tag_open_counts(spark, sf_dir):
    """Open tags by name, from tokens: an identifier that follows a tag start, outside script and style bodies."""
    e = _page_tables(spark, sf_dir).elements
    return e.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(_TAGS + "select page_id, count(*) filter (tag not like '/%') opens, count(*) filter (tag like '/%') closes from t group by page_id")
def tag_balance(spark, sf_dir):
    t = _page_tables(spark, sf_dir, strict=False)
    e = t.rows.where("kind = 'node' and type in ('element', 'stray_close')")
    opens = F.sum((F.col("type") == "element").cast("long"))
    closes = F.sum(((F.col("close") == "tag") | (F.col("type") == "stray_close")).cast("long"))
    return e.groupBy(F.col("doc_id").alias("page_id")).agg(opens.alias("opens"), closes.alias("closes"))


@query("select page_id, len(regexp_extract_all(html, '<')) + 0 as n from pages where false union all select page_id, 1 from pages")
def comments_per_page(spark, sf_dir):
    t = _page_tables(spark, sf_dir)
    return t.nodes.where("type = 'comment'").groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("select page_id from pages where html ilike '%<!doctype%'")
def doctype_present(spark, sf_dir):
    return _page_tables(spark, sf_dir).nodes.where("type = 'doctype'").select(F.col("doc_id").alias("page_id")).distinct()


@query(_TAGS + "select page_id, count(*) n from t where tag in ('br', 'meta', 'img', 'hr', 'input', 'link') group by page_id")
def void_elements(spark, sf_dir):
    return _page_tables(spark, sf_dir).elements.where("close = 'void'").groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


@query(_TAGS + "select page_id, unnest(regexp_extract_all(h, '<a href=\"([^\"]*)\"', 1)) href from s")
def links(spark, sf_dir):
    return _page_tables(spark, sf_dir).attributes.where("tag = 'a' and name = 'href'").select(F.col("doc_id").alias("page_id"), F.col("value").alias("href"))


@query("select page_id, octet_length(encode(html)) as bytes, md5(html) as digest from pages")
def token_round_trip(spark, sf_dir):
    """Tokens put together again are the source: one row of tokens for each page."""
    t = tokens(_pages(spark, sf_dir))
    whole = t.groupBy("doc_id").agg(F.max("range_to").cast("long").alias("bytes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]), "").alias("text"))
    return whole.select(F.col("doc_id").alias("page_id"), "bytes", F.md5("text").alias("digest"))


@query()
def token_pairs(spark, sf_dir):
    """Neighbouring token types."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    return tokens(_pages(spark, sf_dir)).withColumn("next", F.lead("type").over(w)).where("next is not null").groupBy("type", "next").agg(F.count(F.lit(1)).alias("n"))


@query(_TAGS + "select 'MissingClosingTagError' as name, count(*) as n from t where tag = 'b'")
def missing_close_b(spark, sf_dir):
    t = _page_tables(spark, sf_dir, max_errors=1 << 30)
    return t.errors.where("name = 'MissingClosingTagError' and message like '%`<b>`%'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query()
def diagnostics(spark, sf_dir):
    return lint.diagnostics(_page_tables(spark, sf_dir))


@query()
def symbol_outline(spark, sf_dir):
    e = _page_tables(spark, sf_dir).elements
    return e.select("doc_id", "node_id", "depth", F.concat_ws(" > ", F.concat("ancestors", F.array("tag"))).alias("outline"), "line")


@query()
def page_nodes(spark, sf_dir):
    return _page_tables(spark, sf_dir).nodes.groupBy("type", "depth").agg(F.count(F.lit(1)).alias("n"))


# -- extraction
@query("select page_id, md5(html) as digest from pages")
def extract_html_identity(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.md5(extract.extract_html("source")).alias("digest"))


@query("select page_id, octet_length(encode(html)) as bytes from pages")
def extract_ruby_bytes(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.octet_length(extract.extract_ruby("source")).cast("long").alias("bytes"))


@query("select p_partkey as doc_id, '<p>' || repeat(' ', length('<%= name_' || p_partkey || ' %>')) || '</p>' as html, repeat(' ', 3 + 3) || ' name_' || p_partkey || '  ;' || repeat(' ', 4) as ruby from part")
def extract_both(spark, sf_dir):
    d = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<p><%= name_"), F.col("p_partkey").cast("string"), F.lit(" %></p>")).alias("source"))
    return d.select("doc_id", extract.extract_html("source").alias("html"), extract.extract_ruby("source").alias("ruby"))


# -- linting
@query(f"select doc_id, rule, count(*) n from ({fragments.expected_sql()}) group by doc_id, rule")
def lint_offenses(spark, sf_dir):
    """Offenses of documents that break rules at known keys, on the recovered tree."""
    found = lint.offenses(_markup(spark, sf_dir, apart=True), lint.Config(only=fragments.RULES, gate=False))
    return found.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(cases.expected_sql())
def lint_cases(spark, sf_dir):
    """Documents about one rule each: whether they break it, in two shapes or more, or keep it."""
    docs = cases.corpus(_read(spark, sf_dir, "part"))
    found = lint.offenses(Tables(docs), lint.Config(only=cases.RULES, gate=False), suppress=False).select("doc_id", "rule").distinct()
    return found.join(docs.select("doc_id", F.col("own").alias("rule")), ["doc_id", "rule"]).select("doc_id", "rule")


@query(f"select rule, count(*) n, count(distinct doc_id) docs from ({fragments.expected_sql()}) group by rule order by n desc, rule limit 5")
def most_violated_rules(spark, sf_dir):
    return lint.most_violated(lint.offenses(_markup(spark, sf_dir, apart=True), lint.Config(only=fragments.RULES, gate=False)))


def _severity_sql() -> str:
    known = {r.name: r.severity for r in [*lint.RULES, *(r for r, _ in lint.RELATIONAL)]}
    rows = " union all ".join(f"select '{n}' as rule, '{known[n]}' as severity" for n in fragments.RULES)
    return f"select severity, count(*) n, count(distinct doc_id) docs from ({fragments.expected_sql()}) join ({rows}) using (rule) group by severity"


@query(_severity_sql())
def offense_summary(spark, sf_dir):
    return lint.counts(lint.offenses(_markup(spark, sf_dir, apart=True), lint.Config(only=fragments.RULES, gate=False)))


@query("select page_id as doc_id, unnest(['html-no-inline-script-elements', 'html-no-style-elements', 'html-navigation-has-label', 'html-require-script-nonce']) as rule from pages")
def lint_pages(spark, sf_dir):
    only = ("html-no-inline-script-elements", "html-no-style-elements", "html-navigation-has-label", "html-require-script-nonce", "html-img-require-alt", "html-anchor-require-href")
    return lint.offenses(_page_tables(spark, sf_dir, keep=True), lint.Config(only=only, gate=False)).select("doc_id", "rule")


@query("select 'parser-no-errors' as rule, count(*) as docs from pages where html like '%<b>%' or html not like '%</body>%'")
def lint_gate(spark, sf_dir):
    """Documents that failed to parse yield parser errors alone."""
    t = Tables(_pages(spark, sf_dir))
    return lint.offenses(t).where("rule not like 'erb-%' and rule not like 'source-%'").groupBy("rule").agg(F.countDistinct("doc_id").alias("docs"))


@query(named("select p_partkey as doc_id, 'html-img-require-alt' as rule from part where p_partkey % 3 = 0 union all select p_partkey, '{word}-disable-comment-unnecessary' from part where p_partkey % 3 = 1 and p_partkey % 2 = 0"))
def lint_suppressed(spark, sf_dir):
    """Directives of a line hide its offenses; a directive that hides nothing is an offense."""
    k = F.col("p_partkey")
    body = F.when(k % 3 == 0, '<img src="x">').when(k % 3 == 1, F.when(k % 2 == 0, named('<img src="x" alt="y"> <%# {word}:disable html-img-require-alt %>')).otherwise('<img src="x" alt="y">')).otherwise(named('<img src="x"> <%# {word}:disable all %>'))
    t = Tables(_read(spark, sf_dir, "part").select(k.alias("doc_id"), F.concat(body, F.lit("\n")).alias("source")))
    return lint.offenses(t, lint.Config(only=("html-img-require-alt", named("{word}-disable-comment-unnecessary")), gate=False)).select("doc_id", "rule")


@query("select count(*) as n from part where p_partkey % 3 = 2")
def lint_directives(spark, sf_dir):
    k = F.col("p_partkey")
    d = _read(spark, sf_dir, "part").select(k.alias("doc_id"), F.when(k % 3 == 2, named("<%# {word}:disable a, b %>")).otherwise("<%# note %>").alias("source"))
    return directives(Tables(d)).where("size(names) = 2").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey as doc_id, 'Unknown rule `html-img-require-al`. Did you mean `html-img-require-alt`?' as message from part where p_partkey % 4 = 1")
def lint_unknown_names(spark, sf_dir):
    k = F.col("p_partkey")
    d = _read(spark, sf_dir, "part").select(k.alias("doc_id"), F.when(k % 4 == 1, named("<%# {word}:disable html-img-require-al %>")).otherwise(named("<%# {word}:disable html-img-require-alt %>")).alias("source"))
    return lint.offenses(Tables(d), lint.Config(only=(named("{word}-disable-comment-valid-rule-name"),), gate=False)).select("doc_id", "message")


@query("select p_partkey as doc_id, '::warning file=p/' || p_partkey || ',line=1,col=1::`<img>` needs `alt` (html-img-require-alt)' as annotation from part where p_partkey % 5 = 0")
def lint_annotations(spark, sf_dir):
    k = F.col("p_partkey")
    d = _read(spark, sf_dir, "part").select(k.alias("doc_id"), F.concat(F.lit("p/"), k.cast("string")).alias("path"), F.when(k % 5 == 0, '<img src="x">').otherwise("x").alias("source"))
    t = Tables(d)
    found = lint.offenses(t, lint.Config(only=("html-img-require-alt",), gate=False), suppress=False)
    text = lint.github_annotations(found, t.docs)
    return text.select(F.regexp_extract("annotation", "p/([0-9]+)", 1).cast("long").alias("doc_id"), "annotation")


@query()
def rule_catalogue(spark, sf_dir):
    prepare(spark)
    return lint.catalogue(spark)


# -- embedded code and cross-file analysis
_SLUG = "lower(regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g'))"
_EDGES = f"""edges as (
  select 2000 + n_nationkey as caller, 1000 + r_regionkey as callee from nation join region on n_regionkey = r_regionkey
  union select 1000 + r_regionkey, 1 from region
  union select 3000 + b, 3020 + b from brands where b <= 5 and b + 20 in (select b from brands)
  union select 10000 + s_suppkey, 3000 + s_suppkey % 19 from sup where s_suppkey % 19 in (select b from brands))"""
_BASE = "brands as (select distinct cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) b from part), sup as (select * from supplier)"


@query(f"with {_BASE}, {_EDGES} select cast(caller as bigint) caller, cast(callee as bigint) callee from edges")
def render_edges(spark, sf_dir):
    return graph.edges(_project(spark, sf_dir))


@query(f"with {_BASE} select 10000 + s_suppkey as doc_id, 'parts/brand_' || (s_suppkey % 19) as name from sup where s_suppkey % 19 not in (select b from brands)")
def partials_unresolved(spark, sf_dir):
    return graph.unresolved(_project(spark, sf_dir)).select("doc_id", "name")


_REACH = f"""with recursive {_BASE}, {_EDGES}, r(doc_id) as (
  select 2000 + n_nationkey from nation union select 10000 + s_suppkey from sup union select 1 union select callee from r join edges on r.doc_id = edges.caller)"""


@query(f"{_REACH} select cast(doc_id as bigint) doc_id from r")
def templates_reachable(spark, sf_dir):
    """With prefixes expanded: the dynamic ``shared/…`` call keeps the footer."""
    return graph.reachable(_project(spark, sf_dir))


@query(f"{_REACH} select 'parts/brand_' || b as name, 3000 + b as doc_id from brands where 3000 + b not in (select doc_id from r) union all select 'regions/' || {_SLUG.format('r_name')}, 1000 + r_regionkey from region where 1000 + r_regionkey not in (select doc_id from r)")
def partials_unused(spark, sf_dir):
    return graph.unused_partials(_project(spark, sf_dir)).select("name", "doc_id")


@query(f"with {_BASE} select 'shared/footer' as name, 1 as doc_id union all select 'regions/' || {_SLUG.format('r_name')}, 1000 + r_regionkey from region union all select 'parts/brand_' || b, 3000 + b from brands")
def partials_ranked(spark, sf_dir):
    """Of files with one partial name the best extension wins."""
    return graph.partial_index(_project(spark, sf_dir).docs).select("name", "doc_id")


@query("select 1000 + r_regionkey as doc_id, unnest(['title', 'size']) as name, unnest([true, false]) as required from region")
def strict_locals(spark, sf_dir):
    return erb.strict_locals(_project(spark, sf_dir)).select("doc_id", "name", "required")


@query(f"select 2000 + n_nationkey as doc_id, 'regions/' || {_SLUG.format('r_name')} as name, 'colour' as local, 'unknown' as problem from nation join region on n_regionkey = r_regionkey where n_nationkey % 4 = 0")
def strict_local_mismatches(spark, sf_dir):
    return graph.strict_local_mismatches(_project(spark, sf_dir)).select("doc_id", "name", "local", "problem")


@query("select 1000 + r_regionkey as doc_id, 'Strict local `size` is never used' as message from region where r_regionkey % 2 = 1")
def unused_strict_locals(spark, sf_dir):
    return lint.offenses(_project(spark, sf_dir), lint.Config(only=("actionview-no-unused-strict-locals",))).select("doc_id", "message")


@query(f"""with {_BASE}, u as (
  select 'regions/' || {_SLUG.format('r_name')} as name, 'title' || max(case when n_nationkey % 4 = 0 then ',c' else '' end) as x, max(n_nationkey % 4 = 0) as c from nation join region on n_regionkey = r_regionkey group by 1)
  select name, case when c then 'colour,title' else 'title' end as locals from u
  union all select 'shared/footer', '' union all select 'parts/brand_' || (b + 20), 'name' from brands where b <= 5
  union all select distinct 'parts/brand_' || (s_suppkey % 19), 'name' from sup""")
def inferred_signatures(spark, sf_dir):
    return graph.inferred_signature(_project(spark, sf_dir))


_CALLED = "select s_suppkey % 19 from sup"


@query(f"""with {_BASE} select cast(3000 + b as bigint) as doc_id,
  case when b in ({_CALLED}) or (b - 20 between 0 and 5 and b - 20 in (select b from brands) and b - 20 in ({_CALLED})) then 'always' else 'unknown' end as verdict from brands
union all select cast(1000 + r_regionkey as bigint), case when r_regionkey in (select n_regionkey from nation) then 'never' else 'unknown' end from region union all select unnest([1, 2]), unnest(['never', 'unknown'])""")
def partial_verdicts(spark, sf_dir):
    """Of every partial, those that nothing renders included."""
    return graph.partial_verdict(_project(spark, sf_dir), "ul")


@query(f"""with {_BASE}, u as (
  select 'regions/' || {_SLUG.format('r_name')} as name, case when max(n_nationkey % 4 = 0) then 'colour,title' else 'title' end as locals, count(*) n from nation join region on n_regionkey = r_regionkey group by 1
  union all select 'shared/footer', '', count(*) from region
  union all select 'parts/brand_' || b, 'name', sum(n) from (select s_suppkey % 19 as b, count(*) n from sup group by 1 union all select b + 20, 1 from brands where b <= 5) group by b)
select p.name, coalesce(locals, '') as locals, cast(coalesce(n, 0) as bigint) as call_sites, true as keyword_rest
from (select 'shared/footer' as name union all select 'regions/' || {_SLUG.format('r_name')} from region union all select 'parts/brand_' || b from brands) p left join u using (name)""")
def partial_signatures(spark, sf_dir):
    """Open signatures: the project has dynamic renders."""
    return graph.signatures(_project(spark, sf_dir))


@query(f"""with {_BASE}, r as (select 'regions/' || {_SLUG.format('r_name')} as name, 'nations/' || n_nationkey as view from nation join region on n_regionkey = r_regionkey),
b as (select 'parts/brand_' || (s_suppkey % 19) as name, 'suppliers/' || s_suppkey as view, s_suppkey % 19 as b from sup where s_suppkey % 19 in (select b from brands))
select name, name || ' > ' || view as trail from r union all select 'shared/footer', 'shared/footer > ' || name || ' > ' || view from r
union all select name, name || ' > ' || view from b union all select 'parts/brand_' || (b + 20), 'parts/brand_' || (b + 20) || ' > ' || name || ' > ' || view from b where b <= 5 and b + 20 in (select b from brands)""")
def entry_trails(spark, sf_dir):
    return graph.entry_trails(_project(spark, sf_dir))


@query(f"{_REACH} select distinct cast(10000 + s_suppkey as bigint) as doc_id from sup union select cast(3000 + s_suppkey % 19 as bigint) from sup where s_suppkey % 19 in (select b from brands) union select cast(3020 + b as bigint) from brands where b <= 5 and b + 20 in (select b from brands) and b in (select s_suppkey % 19 from sup)")
def affected_templates(spark, sf_dir):
    return graph.affected_templates(_project(spark, sf_dir), "@supplier")


@query("select cast(k as bigint) as caller, 1 as callee, 'layouts/nations' as layout from (select n_nationkey as k from nation) union all select 1000 + s_suppkey, 2, 'layouts/application' from supplier")
def layout_sites(spark, sf_dir):
    """Nations have a layout of their own, suppliers take the application's."""
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("app/views/nations/"), F.col("n_nationkey").cast("string"), F.lit(".html.erb")).alias("path"))
    s = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("doc_id"), F.concat(F.lit("app/views/suppliers/"), F.col("s_suppkey").cast("string"), F.lit(".html.erb")).alias("path"))
    n = n.withColumn("doc_id", F.col("doc_id"))
    fixed = spark.createDataFrame([(1, "app/views/layouts/nations.html.erb"), (2, "app/views/layouts/application.html.erb")], "doc_id long, path string")
    docs = n.unionByName(s).select(F.when(F.col("path").like("%nations%"), F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).alias("doc_id"), "path").unionByName(fixed).withColumn("source", F.lit("x"))
    got = graph.layout_sites(Tables(docs, keep=False))
    return got.select(F.when(F.col("caller") >= 1_000_000, F.col("caller") - 1_000_000).otherwise(F.col("caller")).alias("caller"), F.col("callee").cast("int").alias("callee"), "layout")


@query("select 2000 + n_nationkey as doc_id, 'dynamic' as kind from nation where n_nationkey % 5 = 0 union all select 2000 + n_nationkey, 'implicit' from nation where n_nationkey % 6 = 0")
def render_kinds(spark, sf_dir):
    c = erb.render_calls(_project(spark, sf_dir))
    return c.where("is_dynamic or renderable is not null").select("doc_id", F.when(F.col("is_dynamic"), "dynamic").otherwise("implicit").alias("kind"))


@query(f"with {_BASE} select distinct cast(3000 + s_suppkey % 19 as bigint) as doc_id, 'always' as verdict from sup where s_suppkey % 19 in (select b from brands) union select distinct cast(3020 + b as bigint), 'always' from brands where b <= 5 and b + 20 in (select b from brands) and b in (select s_suppkey % 19 from sup) union select cast(1000 + r_regionkey as bigint), 'never' from region where r_regionkey in (select n_regionkey from nation) union select 1, 'never'")
def ancestor_verdicts(spark, sf_dir):
    return graph.ancestor_verdict(_project(spark, sf_dir), "ul")


@query(f"with {_BASE} select cast(10000 + s_suppkey as bigint) as doc_id, '@supplier' as name from sup union select cast(3000 + s_suppkey % 19 as bigint), 'name' from sup where s_suppkey % 19 in (select b from brands) union select cast(3020 + b as bigint), 'name' from brands where b <= 5 and b + 20 in (select b from brands) and b in (select s_suppkey % 19 from sup)")
def state_flow(spark, sf_dir):
    return graph.state_flow(_project(spark, sf_dir), "@supplier")


@query("select 2000 + n_nationkey as doc_id, unnest([0, 1]) as pos, unnest(['layouts/nations', 'layouts/application']) as layout from nation union all select 10000 + s_suppkey, unnest([0, 1]), unnest(['layouts/suppliers', 'layouts/application']) from supplier")
def layout_candidates(spark, sf_dir):
    return graph.layout_candidates(_project(spark, sf_dir).docs)


@query()
def render_traces(spark, sf_dir):
    return graph.traces(_project(spark, sf_dir))


@query()
def render_errors(spark, sf_dir):
    return erb.render_errors(_project(spark, sf_dir))


@query()
def erb_control(spark, sf_dir):
    return _markup(spark, sf_dir, keep=False).erb.groupBy("opening", "control").agg(F.count(F.lit(1)).alias("n"))


# -- differences
@query("select page_id as pair_id, cast(case page_id % 4 when 0 then 1 when 1 then 1 when 2 then 1 else 0 end as bigint) as operations, page_id % 4 = 3 as identical, page_id % 4 in (0, 1, 3) as patchable from pages")
def diff_summary(spark, sf_dir):
    """Pages against a changed copy: an attribute, a text, a new element, nothing."""
    p = _read(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    html = F.col("html")
    new = (
        F.when(k == 0, F.replace(html, F.lit("<nav>"), F.lit('<nav class="x">')))
        .when(k == 1, F.regexp_replace(html, "<title>", "<title>Zz "))
        .when(k == 2, F.replace(html, F.lit("<nav><ul>"), F.lit("<nav><hr><ul>")))
        .otherwise(html)
    )
    pairs = spread(p.select(F.col("page_id").alias("pair_id"), html.alias("old"), new.alias("new")))
    return diff.summary(pairs, diff.diff_pairs(pairs))


@query()
def diff_operations(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    pairs = spread(p.select(F.col("page_id").alias("pair_id"), F.col("html").alias("old"), F.regexp_replace("html", "<li>", '<li class="m">').alias("new")))
    return diff.diff_pairs(pairs).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# -- text operators
@query("select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) as digest from documents")
def escape_html(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(textops.escape_html(F.col("text"))).alias("digest"))


@query("select p_partkey as doc_id, '<p>x' || p_partkey || '</p>' as source from part")
def string_to_direct_output(spark, sf_dir):
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(k.alias("doc_id"), textops.string_to_direct_output(F.concat(F.lit('<p><%= "x'), k.cast("string"), F.lit('" %></p>'))).alias("source"))


@query("select p_partkey as doc_id, '\"a#{b' || p_partkey || '}\"' as code from part")
def erb_to_ruby_string(spark, sf_dir):
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(k.alias("doc_id"), textops.erb_to_ruby_string(F.concat(F.lit("a<%= b"), k.cast("string"), F.lit(" %>"))).alias("code"))


@query("select p_partkey as doc_id, 'own-' || p_partkey || ' flex p-2 md:p-2' as classes from part")
def class_sort(spark, sf_dir):
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(k.alias("doc_id"), textops.sort_classes(F.concat(F.lit("md:p-2 p-2  own-"), k.cast("string"), F.lit(" flex")), ["flex", "p-2"]).alias("classes"))


@query("select p_partkey as doc_id, '    a' || chr(10) || '  b' as spaces, chr(9) || chr(9) || 'a' || chr(10) || chr(9) || 'b' as tabs from part")
def indentation(spark, sf_dir):
    k = F.col("p_partkey").alias("doc_id")
    return _read(spark, sf_dir, "part").select(k, textops.tabs_to_spaces(F.lit("\t\ta\n\tb")).alias("spaces"), textops.spaces_to_tabs(F.lit("    a\n  b")).alias("tabs"))


@query("select p_partkey as doc_id, '<ul>' || chr(10) || '  <li>' || p_partkey || '</li>' || chr(10) || '</ul>' || chr(10) as source from part")
def format_templates(spark, sf_dir):
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(k.alias("doc_id"), textops.formatted(F.concat(F.lit("<ul><li>"), k.cast("string"), F.lit("</li></ul>"))).alias("source"))


@query("select p_partkey as doc_id, '<ul><li>' || p_partkey || '</li><li>b</li></ul>' as source from part")
def auto_close(spark, sf_dir):
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(k.alias("doc_id"), textops.auto_close(F.concat(F.lit("<ul><li>"), k.cast("string"), F.lit("<li>b</ul>"))).alias("source"))


@query("select page_id from pages where false")
def format_check(spark, sf_dir):
    """Pages fail to parse, so none would change."""
    t = _read(spark, sf_dir, "pages")
    return textops.would_change(t.select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))).select(F.col("doc_id").alias("page_id"))


@query("select p_partkey as diff_id, unnest(['context', 'removed', 'added']) as kind, unnest(['a', 'b', 'c' || p_partkey]) as text from part")
def unified_diff(spark, sf_dir):
    k = F.col("p_partkey")
    d = _read(spark, sf_dir, "part").select(k.alias("diff_id"), textops.line_diff(F.lit("a\nb"), F.concat(F.lit("a\nc"), k.cast("string"))).alias("text"))
    return textops.unified_hunks(d).select("diff_id", "kind", "text")


def _part_text(spark, sf_dir, before: str, after: str, change) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(k.alias("doc_id"), change(F.concat(F.lit(before), k.cast("string"), F.lit(after))).alias("source"))


@query("select p_partkey as doc_id, '<a href=\"/p/' || p_partkey || '\" class=\"c\" data-x-y=\"1\">Go</a>' as source from part")
def helpers_to_html(spark, sf_dir):
    return _part_text(spark, sf_dir, '<%= link_to "Go", "/p/', '", class: "c", data: { x_y: 1 } %>', lambda c: rewrite.rewritten(c, rewrite.helpers_to_html))


@query("select p_partkey as doc_id, '<%= link_to \"Go\", \"/p/' || p_partkey || '\", class: \"c\" %>' as source from part")
def html_to_helpers(spark, sf_dir):
    return _part_text(spark, sf_dir, '<a href="/p/', '" class="c">Go</a>', lambda c: rewrite.rewritten(c, rewrite.html_to_helpers))


@query("select p_partkey as doc_id, '<% if ok %><%= p' || p_partkey || ' %><% end %>' as source from part")
def conditionals_to_blocks(spark, sf_dir):
    return _part_text(spark, sf_dir, "<%= p", " if ok %>", lambda c: rewrite.pipeline(c, rewrite.postfix_to_block, rewrite.ternary_to_block))


@query("select p_partkey as doc_id, '<p lang=\"e' || p_partkey || '\"><%= x -%></p>' || chr(10) as source from part")
def lint_autofix(spark, sf_dir):
    return _part_text(spark, sf_dir, "<P lang='e", "'><%=x  =%></P>  \n\n", lambda c: rewrite.rewritten(c, rewrite.fixed))


@query(f"select 1000 + r_regionkey as doc_id, '<%# locals: (title:, size: 1) %>' || chr(10) || '<section><h2><%= title %></h2>' || case when r_regionkey % 2 = 0 then '<p><%= size %></p>' else '' end || '<footer>x</footer>' || chr(10) || '</section>' || chr(10) as source from region")
def inlined_partials(spark, sf_dir):
    return rewrite.inline_partials(_project(spark, sf_dir)).where("path like '%regions/%'").select("doc_id", "source")


@query(f"""with {_BASE}
select 1 as doc_id, '<footer>x</footer>' || chr(10) as source union all select 2, '<footer>y</footer>' || chr(10)
union all select 1000 + r_regionkey, '<%# locals: (title:, size: 1) %>' || chr(10) || '<section><h2><%= title %></h2>' || case when r_regionkey % 2 = 0 then '<p><%= size %></p>' else '' end || '<footer>x</footer>' || chr(10) || '</section>' || chr(10) from region
union all select 2000 + n_nationkey, '<div class="n"><%= render "regions/' || {_SLUG.format('r_name')} || '", title: @nation' || case when n_nationkey % 4 = 0 then ', colour: 1' else '' end || ' %></div>' || chr(10)
  || case when n_nationkey % 5 = 0 then '<%= render "shared/#{{kind}}" %>' || chr(10) else '' end || case when n_nationkey % 6 = 0 then '<%= render @items %>' || chr(10) else '' end from nation join region on n_regionkey = r_regionkey
union all select 3000 + b, '<li><%= name %></li>' || chr(10) || case when b <= 5 then '<%= render "brand_' || (b + 20) || '", name: name %>' || chr(10) else '' end from brands
union all select 10000 + s_suppkey, '<ul><%= render partial: \'\'parts/brand_' || (s_suppkey % 19) || '\'\', locals: {{ name: @supplier.name }} %></ul>' || chr(10) from sup""")
def inlined_documents(spark, sf_dir):
    """Every document of the project, also those that inlining must leave as they are."""
    return rewrite.inline_partials(_project(spark, sf_dir)).select("doc_id", "source")


@query("select p_partkey as doc_id, case p_partkey % 3 when 0 then 'block_in_p' when 1 then 'interactive_in_button' end as problem from part where p_partkey % 3 < 2")
def nesting_validator(spark, sf_dir):
    k = F.col("p_partkey")
    d = _read(spark, sf_dir, "part").select(k.alias("doc_id"), F.when(k % 3 == 0, "<p><div>x</div></p>").when(k % 3 == 1, "<button><a href='/'>x</a></button>").otherwise("<p>x</p>").alias("source"))
    return reports.nesting_errors(Tables(d)).select("doc_id", "problem")


@query("select p_partkey as doc_id, case p_partkey % 3 when 0 then 'attribute_position' when 1 then 'attribute_name' end as problem from part where p_partkey % 3 < 2")
def security_validator(spark, sf_dir):
    k = F.col("p_partkey")
    d = _read(spark, sf_dir, "part").select(k.alias("doc_id"), F.when(k % 3 == 0, "<p <%= x %>>x</p>").when(k % 3 == 1, '<p data-<%= x %>="1">x</p>').otherwise('<p a="<%= x %>">x</p>').alias("source"))
    return reports.security_errors(Tables(d)).select("doc_id", "problem")


@query("select case p_partkey % 4 when 0 then 'template' when 1 then 'strict' when 2 then 'analysis' else 'ok' end as status, count(*) as n from part group by 1")
def project_status(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.when(k % 4 == 0, "<b>x").when(k % 4 == 1, "<ul><li>x</ul>").when(k % 4 == 2, "<% end %>").otherwise("<p>x</p>")
    return reports.status_counts(Tables(_read(spark, sf_dir, "part").select(k.alias("doc_id"), body.alias("source"))))


@query()
def tree_lines(spark, sf_dir):
    return reports.tree_lines(_page_tables(spark, sf_dir))


@query()
def folding_ranges(spark, sf_dir):
    return reports.folding_ranges(Tables(_pages(spark, sf_dir)))


@query(_TAGS + "select page_id, count(*) as n from t where tag = 'b' or (tag = 'html' and page_id in (select page_id from pages where html not like '%</html>%')) or (tag = 'body' and page_id in (select page_id from pages where html not like '%</body>%')) group by page_id")
def sql_functions(spark, sf_dir):
    """The table functions from SQL: missing closing tags of each page."""
    reports.register(prepare(spark))
    _read(spark, sf_dir, "pages").createOrReplaceTempView("sql_functions_pages")
    found = spark.sql("select page_id, e.name, e.message from sql_functions_pages, lateral parse_errors(html) e")
    return found.where("name = 'MissingClosingTagError'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


# -- streaming
@query("select seq, type from (select page_id * 2 as seq, 'node_inserted' as type from pages where false) union all select page_id * 2 + 1, 'attribute_added' from pages")
def stream_changes(spark, sf_dir):
    """Two versions of each page replayed as a stream: the second adds one attribute."""
    import uuid

    from tessera.streaming.changes import diff_stream

    p = _read(spark, sf_dir, "pages")
    first = p.select((F.col("page_id") * 2).alias("seq"), F.col("page_id").cast("string").alias("path"), F.lit("created").alias("kind"), F.col("html").alias("source"))
    second = first.select((F.col("seq") + 1).alias("seq"), "path", F.lit("modified").alias("kind"), F.replace("source", F.lit("<nav>"), F.lit('<nav class="x">')).alias("source"))
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    first.unionByName(second).write.parquet(f"{folder}/in")
    feed = spark.readStream.schema(first.schema).parquet(f"{folder}/in")
    name = f"changes_{uuid.uuid4().hex}"
    run = diff_stream(feed).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    for part in ("in", "state"):
        remove(spark, f"{folder}/{part}")
    return spark.read.parquet(f"{folder}/out").where("kind = 'modified'").select("seq", "type")


# -- short sources and what reading them must give
def _shapes(spark, sf_dir, rows, *names) -> DataFrame:
    return shapes.corpus(_read(spark, sf_dir, "part"), rows, *(names or ("source",)))


def _in_order(rows: DataFrame, order: str | list[str], text, sep: str = " ") -> DataFrame:
    """(doc_id, found): one text of a document's rows in order; documents here have few."""
    by = [order] if isinstance(order, str) else order
    listed = F.array_sort(F.collect_list(F.struct(*by, text.alias("_text"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["_text"]), sep).alias("found"))


@query(shapes.expected_sql(shapes.TOKENS, "found"))
def token_shapes(spark, sf_dir):
    return _in_order(tokens(_shapes(spark, sf_dir, shapes.TOKENS)).where("type <> 'EOF'"), "idx", F.col("type"))


@query(shapes.expected_sql(shapes.ERRORS, "found"))
def error_shapes(spark, sf_dir):
    e = Tables(_shapes(spark, sf_dir, shapes.ERRORS), keep=False).errors
    return _in_order(e, "pos", F.format_string("%s@%d:%d", "name", "line", "column"))


@query(shapes.expected_sql(shapes.NODES, "found"))
def node_shapes(spark, sf_dir):
    n = Tables(_shapes(spark, sf_dir, shapes.NODES), keep=False).nodes
    return _in_order(n, "node_id", F.format_string("%d:%s:%s", "depth", "type", F.when(F.col("tag") != "", F.col("tag")).otherwise(F.col("control"))))


@query(shapes.expected_sql(shapes.ATTRIBUTES, "found"))
def attribute_shapes(spark, sf_dir):
    a = Tables(_shapes(spark, sf_dir, shapes.ATTRIBUTES), keep=False).attributes
    return _in_order(a, ["node_id", "pos"], F.concat_ws("|", "name", F.coalesce("value", F.lit("-")), "quote", "equals"))


@query(shapes.expected_sql(shapes.EXTRACTS, "ruby", "commented", "html"))
def extract_shapes(spark, sf_dir):
    d = _shapes(spark, sf_dir, shapes.EXTRACTS)
    return d.select("doc_id", extract.extract_ruby("source").alias("ruby"), extract.extract_ruby("source", comments=True).alias("commented"), extract.extract_html("source").alias("html"))


@query(shapes.expected_sql(shapes.CHANGES, "found"))
def change_shapes(spark, sf_dir):
    pairs = _shapes(spark, sf_dir, shapes.CHANGES, "old", "new").withColumnRenamed("doc_id", "pair_id")
    return _in_order(diff.diff_pairs(pairs).withColumnRenamed("pair_id", "doc_id"), "op_index", F.col("type"))


@query(shapes.expected_sql(shapes.COMPILED, "found"))
def compile_shapes(spark, sf_dir):
    return _shapes(spark, sf_dir, shapes.COMPILED).select("doc_id", textops.compiled(F.col("source")).alias("found"))


@query(shapes.expected_sql(shapes.LAYOUTS, "found"))
def layout_shapes(spark, sf_dir):
    return _shapes(spark, sf_dir, shapes.LAYOUTS).select("doc_id", textops.formatted(F.col("source")).alias("found"))


@query(shapes.expected_sql(shapes.FIXES, "found"))
def fix_shapes(spark, sf_dir):
    return _shapes(spark, sf_dir, shapes.FIXES).select("doc_id", rewrite.rewritten(F.col("source"), rewrite.fixed).alias("found"))


@query("select p_partkey as doc_id from part join (values " + ", ".join(f"({i})" for i, (a, b) in enumerate(shapes.LAYOUTS) if a != b) + f") v(i) on p_partkey % {len(shapes.LAYOUTS)} = i")
def format_check_shapes(spark, sf_dir):
    """Documents that formatting would change."""
    return textops.would_change(_shapes(spark, sf_dir, shapes.LAYOUTS))


@query("""select doc_id,
  replace(replace(replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;') as attribute,
  replace(replace(replace(replace(replace(replace(t, '\\', '\\\\'), '''', '\\'''), '"', '\\"'), '</', '<\\/'), chr(10), '\\n'), chr(13), '\\r') as script
from (select p_partkey as doc_id, 'a' || p_partkey || chr(10) || chr(9) || '"b'' </x> & \\ c' || chr(13) as t from part)""")
def escapes(spark, sf_dir):
    t = F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit("\n\t\"b' </x> & \\ c\r"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), textops.escape_attribute(t).alias("attribute"), textops.escape_javascript(t).alias("script"))


@query("select p_partkey as doc_id, 'w' || p_partkey || '\\:x\\;y-z_\\{\\}' as style from part")
def escapes_css(spark, sf_dir):
    t = F.concat(F.lit("w"), F.col("p_partkey").cast("string"), F.lit(":x;y-z_{}"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), textops.escape_css(t).alias("style"))


# -- reports of a lint run
def _images(spark, sf_dir) -> Tables:
    """Documents with p_partkey % 3 images without alternative text, one on each line; every fifth is ignored as a whole."""
    k = F.col("p_partkey")
    body = F.concat(F.when(k % 5 == 0, named("<%# {word}:linter ignore %>\n")).otherwise("x\n"), F.repeat(F.lit('<img src="a">\n'), (k % 3).cast("int")))
    return Tables(_read(spark, sf_dir, "part").select(k.alias("doc_id"), F.concat(F.lit("p/"), k.cast("string")).alias("path"), body.alias("source")))


_IMAGES = lint.Config(only=("html-img-require-alt",), gate=False)
_FOUND = "select p_partkey as doc_id, 'html-img-require-alt' as rule, 'warning' as severity, 1 + unnest(range(1, 1 + p_partkey % 3)) as line, 0 as col, '`<img>` needs `alt`' as message from part where p_partkey % 5 <> 0"


@query(f"select rule, severity, count(*) as n, count(distinct doc_id) as docs from ({_FOUND}) group by rule, severity")
def lint_by_rule(spark, sf_dir):
    """Whole-file ignores leave nothing of a document."""
    return lint.by_rule(lint.offenses(_images(spark, sf_dir), _IMAGES))


@query(f"select doc_id || ':' || line || ':' || col || ' ' || severity || ' ' || message || ' [' || rule || ']' as report from ({_FOUND})")
def lint_simple_report(spark, sf_dir):
    return lint.simple_report(lint.offenses(_images(spark, sf_dir), _IMAGES))


@query(f"""select '{{"doc_id":' || doc_id || ',"rule":"' || rule || '","severity":"' || severity || '","line":' || line || ',"column":' || col || ',"message":"' || message || '"}}' as json from ({_FOUND})""")
def lint_json_report(spark, sf_dir):
    return lint.json_report(lint.offenses(_images(spark, sf_dir), _IMAGES))


@query(f"select min(doc_id) as doc_id, rule from ({_FOUND}) group by rule")
def lint_once_per_run(spark, sf_dir):
    return lint.once_per_run(lint.offenses(_images(spark, sf_dir), _IMAGES), ("html-img-require-alt",)).select("doc_id", "rule")


@query(f"select doc_id, cast(line as int) as line, cast(row_number() over (partition by doc_id order by line) as int) as n from ({_FOUND})")
def lint_ranked(spark, sf_dir):
    return lint.ranked(lint.offenses(_images(spark, sf_dir), _IMAGES)).select("doc_id", "line", "n")


@query(f"select doc_id, cast(line as int) as line from ({_FOUND}) where line > 2")
def lint_new_only(spark, sf_dir):
    """Offenses that an earlier run, which saw the first line of each document alone, does not have."""
    found = lint.offenses(_images(spark, sf_dir), _IMAGES)
    return lint.new_only(found.where("line <= 2"), found).select("doc_id", "line")


@query(f"select doc_id, cast(line as int) as line from ({_FOUND}) where doc_id % 2 = 0")
def lint_levels(spark, sf_dir):
    """Severities set by the project, the level that fails a run, and a path pattern that excludes a rule."""
    config = lint.Config(only=("html-img-require-alt",), gate=False, exclude={"html-img-require-alt": "p/[0-9]*[13579]$"}, severities={"html-img-require-alt": "info"})
    found = lint.offenses(_images(spark, sf_dir), config)
    return found.where(lint.at_least(F.col("severity"), "info") & ~lint.at_least(F.col("severity"), "warning")).select("doc_id", "line")


@query(f"with {_BASE} select 10000 + s_suppkey as doc_id, 'parts/brand_' || (s_suppkey % 19) as name from sup where s_suppkey % 19 not in (select b from brands)")
def render_validator(spark, sf_dir):
    return reports.render_validation(_project(spark, sf_dir)).select("doc_id", "name")


# -- what embedded code says
def _coded(spark, sf_dir, rows) -> Tables:
    return Tables(_shapes(spark, sf_dir, rows), keep=False)


@query(shapes.expected_sql(shapes.ITERATIONS, "found"))
def iteration_shapes(spark, sf_dir):
    i = code.iterations(_coded(spark, sf_dir, shapes.ITERATIONS))
    return _in_order(i, ["line", "column"], F.concat_ws("|", "receiver", "operator", "message", F.array_join("arguments", ";"), F.array_join("parameters", ";")))


@query(shapes.expected_sql(shapes.BALANCE, "found"))
def balance_shapes(spark, sf_dir):
    return _in_order(code.balance_errors(_coded(spark, sf_dir, shapes.BALANCE)), ["line", "column"], F.col("message"))


@query(shapes.expected_sql(shapes.DEPENDENCIES, "found"))
def dependency_shapes(spark, sf_dir):
    d = code.dependency_index(_coded(spark, sf_dir, shapes.DEPENDENCIES))
    return _in_order(d, "state", F.concat("state", F.lit("="), F.array_join(F.transform("uses", lambda x: F.concat(x["line"], F.lit(":"), x["column"])), ",")))


@query(shapes.expected_sql(shapes.SCOPES, "found"))
def scope_shapes(spark, sf_dir):
    t = Tables(_shapes(spark, sf_dir, shapes.SCOPES))
    at = code.locals_at(t, t.erb.where("opening = '<%='").select("doc_id", F.col("range_from").alias("at")))
    return _in_order(at, "at", F.when(F.size("locals") == 0, "-").otherwise(F.array_join("locals", ",")))


@query(shapes.expected_sql(shapes.REFERENCES, "found"))
def reference_shapes(spark, sf_dir):
    return _in_order(code.ruby_references(_shapes(spark, sf_dir, shapes.REFERENCES)), "name", F.concat("name", F.when(F.col("dynamic"), "*").otherwise("")))


@query(f"with {_BASE} select cast(1000 + r_regionkey as bigint) as doc_id from region union all select 3000 + b from brands where b % 2 = 1")
def ruby_entries(spark, sf_dir):
    """A Ruby file for each brand: odd ones render theirs, even ones only name it; all render from the folder of regions."""
    t = _project(spark, sf_dir)
    b = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    known = _read(spark, sf_dir, "part").select(b.alias("doc_id")).distinct()
    verb = F.when(F.col("doc_id") % 2 == 1, "render partial: ").otherwise("puts ")
    files = known.select("doc_id", F.concat(F.lit("def show = "), verb, F.lit("'parts/brand_"), F.col("doc_id").cast("string"), F.lit("'\n  render \"regions/#{kind}\"\n")).alias("source"))
    return code.referenced_partials(t, files)


@query("select page_id as doc_id from pages")
def static_pages(spark, sf_dir):
    """Pages hold no code, so each is one constant."""
    return code.static_templates(_page_tables(spark, sf_dir))


@query(f"""{_REACH} select 'templates' as metric, 2 + (select count(*) from region) + (select count(*) from nation) + (select count(*) from brands) + (select count(*) from sup) as n
union all select 'partials', 1 + (select count(*) from region) + (select count(*) from brands) union all select 'edges', (select count(*) from edges)
union all select 'unresolved', (select count(*) from sup where s_suppkey % 19 not in (select b from brands))
union all select 'unused', (select count(*) from brands where 3000 + b not in (select doc_id from r)) + (select count(*) from region where 1000 + r_regionkey not in (select doc_id from r))""")
def graph_report(spark, sf_dir):
    return code.graph_report(_project(spark, sf_dir))
