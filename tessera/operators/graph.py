"""Cross-file analysis: names of templates, resolution of render calls, reachability, contexts and state flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.directives import named
from tessera.operators import erb
from tessera.operators.tables import Tables
from tessera.session import checkpoint

#: Template extensions in order of precedence.
EXTENSIONS = (".html.erb", named(".html.{word}"), ".turbo_stream.erb", ".erb", named(".{word}"), ".rhtml", ".html")
MAX_CHAINS = 32


def _below_root(path: Column, root: str) -> Column:
    return F.regexp_replace(path, f"^.*?{root}/", "")


def _no_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^/]*$", "")


def is_partial(path: Column) -> Column:
    return F.coalesce(path.rlike("(^|/)_[^/]+$"), F.lit(False))


def partial_name(path: Column, root: str = "app/views") -> Column:
    """``posts/_card.html.erb`` → ``posts/card``; null for other templates."""
    return F.when(is_partial(path), F.regexp_replace(_no_extension(_below_root(path, root)), "(^|/)_([^/]+)$", "$1$2"))


def template_name(path: Column, root: str = "app/views") -> Column:
    return F.when(~is_partial(path), _no_extension(_below_root(path, root)))


def template_rank(path: Column) -> Column:
    rank = F.lit(len(EXTENSIONS))
    for i, x in reversed(list(enumerate(EXTENSIONS))):
        rank = F.when(path.endswith(x), i).otherwise(rank)
    return rank


def partial_index(docs: DataFrame, root: str = "app/views") -> DataFrame:
    """(name, doc_id, path): for each partial name the file with the best extension, then the first path."""
    named = docs.withColumn("name", partial_name(F.col("path"), root)).where("name is not null")
    return named.groupBy("name").agg(F.min_by(F.struct("doc_id", "path"), F.struct(template_rank(F.col("path")), "path")).alias("x")).select("name", "x.doc_id", "x.path")


def layout_candidates(docs: DataFrame, root: str = "app/views") -> DataFrame:
    """(doc_id, pos, layout): layouts by directory upwards, then the application's."""
    parts = F.split(_below_root(F.col("path"), root), "/")
    dirs = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.concat(F.lit("layouts/"), F.array_join(F.slice(parts, 1, n), "/")))
    steps = F.when(F.size(parts) > 1, F.concat(dirs, F.array(F.lit("layouts/application")))).otherwise(F.array(F.lit("layouts/application")))
    return docs.where(~is_partial(F.col("path"))).select("doc_id", F.posexplode(steps).alias("pos", "layout"))


def calls(t: Tables, root: str = "app/views") -> DataFrame:
    """Static render calls with the name they resolve to: a bare name looks in the caller's folder."""
    c = erb.render_calls(t).join(t.docs.select("doc_id", "path"), "doc_id")
    folder = F.regexp_extract(_below_root(F.col("path"), root), "^(.*)/[^/]*$", 1)
    name = F.when(F.col("partial").contains("/"), F.col("partial")).otherwise(F.concat_ws("/", F.when(folder != "", folder), "partial"))
    return c.where("partial is not null and not is_dynamic").withColumn("name", name)


def dynamic_prefixes(t: Tables) -> DataFrame:
    return erb.render_calls(t).where("is_dynamic and partial is not null").select(F.regexp_replace(F.substring_index("partial", "#{", 1), "/+$", "").alias("prefix")).where("prefix <> ''").distinct()


def edges(t: Tables, root: str = "app/views") -> DataFrame:
    """(caller, callee): which template renders which partial, each once."""
    index = partial_index(t.docs, root).select("name", F.col("doc_id").alias("callee"))
    return calls(t, root).select(F.col("doc_id").alias("caller"), "name").distinct().join(index, "name").select("caller", "callee").distinct()


def unresolved(t: Tables, root: str = "app/views") -> DataFrame:
    """Calls whose partial is no file."""
    return calls(t, root).join(partial_index(t.docs, root).select("name"), "name", "left_anti").select("doc_id", "name", "line", "column")


def reachable(t: Tables, root: str = "app/views", expand_prefixes: bool = True, entries: DataFrame | None = None) -> DataFrame:
    """Documents that rendering can reach from templates that are no partials, and from ``entries(doc_id)``.

    Partials under a dynamic prefix count as reachable; with ``expand_prefixes``
    so do the partials they render.  A breadth-first fixpoint: each round joins
    the frontier alone and is cut at the shared checkpoint folder.
    """
    e = checkpoint(edges(t, root))
    start = t.docs.where(~is_partial(F.col("path"))).select("doc_id")
    if entries is not None:
        start = start.unionByName(entries.select("doc_id"))
    index = partial_index(t.docs, root)
    # prefixes of one project: joined by the first folders of each name, not by comparing all with all
    folders = index.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "/"))), lambda n: F.array_join(F.slice(F.split("name", "/"), 1, n), "/"))).alias("prefix"))
    by_prefix = folders.join(dynamic_prefixes(t), "prefix", "left_semi").select("doc_id").distinct()
    seen = checkpoint((start.unionByName(by_prefix) if expand_prefixes else start).distinct())
    frontier = seen
    while True:
        frontier = checkpoint(frontier.join(e, F.col("doc_id") == F.col("caller")).select(F.col("callee").alias("doc_id")).distinct().join(seen, "doc_id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen if expand_prefixes else seen.unionByName(by_prefix).distinct()


def unused_partials(t: Tables, root: str = "app/views", **options) -> DataFrame:
    return partial_index(t.docs, root).join(reachable(t, root, **options), "doc_id", "left_anti")


def _sites(t: Tables, root: str) -> DataFrame:
    """(caller, callee, around): which partial is rendered where, and the tags around the call, each once."""
    index = partial_index(t.docs, root).select("name", F.col("doc_id").alias("callee"))
    around = F.coalesce("ancestors", F.expr("array()").cast("array<string>"))
    return calls(t, root).join(index, "name").select(F.col("doc_id").alias("caller"), "callee", around.alias("around")).distinct()


def contexts(t: Tables, root: str = "app/views") -> DataFrame:
    """(doc_id, chain, resolved): the tag stacks around a partial over its callers, at most 32 different ones for each (a feature of the report).

    ``resolved`` is false where some were cut, at the partial or above it.  The
    shortest way stands for all that give one stack; none enters a partial twice.
    """
    site = checkpoint(_sites(t, root))
    frontier = checkpoint(t.docs.where(~is_partial(F.col("path"))).select("doc_id", F.expr("array()").cast("array<string>").alias("chain"), F.array("doc_id").alias("through")))
    out = frontier.where("false")
    cut = frontier.where("false").select("doc_id")
    while True:
        step = frontier.join(site, F.col("doc_id") == F.col("caller")).where(~F.array_contains("through", F.col("callee")))
        step = step.select(F.col("callee").alias("doc_id"), F.concat("chain", "around").alias("chain"), F.concat("through", F.array("callee")).alias("through"))
        step = step.groupBy("doc_id", "chain").agg(F.min(F.struct(F.size("through"), "through")).alias("way")).select("doc_id", "chain", "way.through")
        have = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("have"))
        step = step.join(out.select("doc_id", "chain"), ["doc_id", "chain"], "left_anti").join(have, "doc_id", "left")
        step = checkpoint(step.withColumn("n", F.coalesce("have", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id").orderBy("chain"))))
        frontier = step.where(F.col("n") <= MAX_CHAINS).select("doc_id", "chain", "through")
        cut = checkpoint(cut.unionByName(step.where(F.col("n") > MAX_CHAINS).select("doc_id")).distinct())
        if frontier.isEmpty():
            break
        out = checkpoint(out.unionByName(frontier))
    below = frontier = cut
    while not frontier.isEmpty():
        step = frontier.join(site, F.col("doc_id") == F.col("caller")).select(F.col("callee").alias("doc_id")).distinct()
        frontier = checkpoint(step.join(below, "doc_id", "left_anti"))
        below = checkpoint(below.unionByName(frontier))
    return out.select("doc_id", "chain").join(below.withColumn("lost", F.lit(True)), "doc_id", "left").select("doc_id", "chain", F.col("lost").isNull().alias("resolved"))


def ancestor_verdict(t: Tables, tag: str, root: str = "app/views") -> DataFrame:
    """(doc_id, verdict): whether callers render a partial inside ``tag``: always, never, mixed.

    All callers count: a fixpoint over (partial, inside or not), two rows for each at most.
    """
    site = checkpoint(_sites(t, root).select("caller", "callee", F.array_contains("around", tag).alias("within")).distinct())
    frontier = checkpoint(t.docs.where(~is_partial(F.col("path"))).select("doc_id", F.lit(False).alias("inside")))
    seen = frontier.where("false")
    while True:
        step = frontier.join(site, F.col("doc_id") == F.col("caller")).select(F.col("callee").alias("doc_id"), (F.col("inside") | F.col("within")).alias("inside")).distinct()
        frontier = checkpoint(step.join(seen, ["doc_id", "inside"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen.groupBy("doc_id").agg(F.when(F.bool_and("inside"), "always").when(F.bool_or("inside"), "mixed").otherwise("never").alias("verdict"))


def cycles(edge: DataFrame) -> DataFrame:
    """The edges (doc_id, callee) whose callee leads back to the caller."""
    core, count = edge, edge.count()
    while True:
        # what lies on a cycle is a caller and a callee
        core = checkpoint(core.join(core.select(F.col("callee").alias("doc_id")).distinct(), "doc_id", "left_semi").join(core.select(F.col("doc_id").alias("callee")).distinct(), "callee", "left_semi").select("doc_id", "callee"))
        if (now := core.count()) == count or not now:
            break
        count = now
    reach = frontier = core
    step = core.select(F.col("doc_id").alias("callee"), F.col("callee").alias("next"))
    while not frontier.isEmpty():
        further = frontier.join(step, "callee").select("doc_id", F.col("next").alias("callee")).distinct()
        frontier = checkpoint(further.join(reach, ["doc_id", "callee"], "left_anti"))
        reach = checkpoint(reach.unionByName(frontier))
    return core.join(reach.select(F.col("callee").alias("doc_id"), F.col("doc_id").alias("callee")), ["doc_id", "callee"], "left_semi")


def partial_verdict(t: Tables, tag: str, root: str = "app/views") -> DataFrame:
    """(doc_id, verdict) of every partial: whether its callers render it inside ``tag``: always, never, mixed or unknown.

    A partial that nothing renders has no known surroundings.  Below one, or on
    a cycle of renders or below that, what stands around is known only in part:
    there the tag may be found, but its absence is unknown.
    """
    site = checkpoint(_sites(t, root))
    within = site.select("caller", "callee", F.array_contains("around", tag).alias("within")).distinct()
    partials = t.docs.where(is_partial(F.col("path"))).select("doc_id")
    uncalled = checkpoint(partials.join(site.select(F.col("callee").alias("doc_id")).distinct(), "doc_id", "left_anti"))
    roots = t.docs.where(~is_partial(F.col("path"))).select("doc_id").unionByName(uncalled)
    frontier = checkpoint(roots.select("doc_id", F.lit(False).alias("inside")))
    seen = frontier.where("false")
    while True:
        step = frontier.join(within, F.col("doc_id") == F.col("caller")).select(F.col("callee").alias("doc_id"), (F.col("inside") | F.col("within")).alias("inside")).distinct()
        frontier = checkpoint(step.join(seen, ["doc_id", "inside"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    e = site.select(F.col("caller").alias("doc_id"), "callee").distinct()
    open_ = frontier = checkpoint(uncalled.unionByName(cycles(e).select("doc_id")).distinct())
    while not frontier.isEmpty():
        frontier = checkpoint(frontier.join(e, "doc_id").select(F.col("callee").alias("doc_id")).distinct().join(open_, "doc_id", "left_anti"))
        open_ = checkpoint(open_.unionByName(frontier))
    found = seen.groupBy("doc_id").agg(F.bool_and("inside").alias("all_in"), F.bool_or("inside").alias("some_in"))
    rows = partials.join(found, "doc_id", "left").join(open_.withColumn("open", F.lit(True)), "doc_id", "left")
    verdict = F.when(F.col("all_in").isNull(), "unknown").when(F.col("all_in"), "always").when(F.col("some_in"), "mixed").when(F.col("open"), "unknown").otherwise("never")
    return rows.select("doc_id", verdict.alias("verdict"))


def signatures(t: Tables, root: str = "app/views") -> DataFrame:
    """(name, locals, call_sites, keyword_rest) of every partial: locals over all callers; open where a render is dynamic or finds no file, because then not all callers are known."""
    c = calls(t, root)
    # whether the graph is complete is one row
    lost = unresolved(t, root).select("doc_id").unionByName(erb.render_calls(t).where("is_dynamic or (partial is null and renderable is not null)").select("doc_id"))
    open_ = not lost.isEmpty()
    per = c.groupBy("name").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("locals"))))), ",").alias("locals"), F.count(F.lit(1)).alias("call_sites"))
    return partial_index(t.docs, root).select("name").join(per, "name", "left").select("name", F.coalesce("locals", F.lit("")).alias("locals"), F.coalesce("call_sites", F.lit(0)).cast("long").alias("call_sites"), F.lit(open_).alias("keyword_rest"))


def entry_trails(t: Tables, root: str = "app/views") -> DataFrame:
    """(name, trail): for each partial the ways up to the templates that render it, names joined by `` > ``.

    A breadth-first walk over callers that enters a partial once for each
    start, by the first of its shortest ways; every template it meets ends a trail.
    """
    index = partial_index(t.docs, root)
    names = t.docs.select("doc_id", F.coalesce(template_name(F.col("path"), root), partial_name(F.col("path"), root)).alias("label"), is_partial(F.col("path")).alias("partial"))
    e = edges(t, root).join(names.withColumnRenamed("doc_id", "caller"), "caller")
    e = checkpoint(e.select("callee", "caller", "label", "partial"))
    frontier = checkpoint(index.select(F.col("doc_id").alias("start"), F.col("doc_id").alias("at"), F.array("name").alias("way")))
    seen, trails = frontier.select("start", "at"), None
    while True:
        step = checkpoint(frontier.join(e, F.col("at") == F.col("callee")).select("start", F.col("caller").alias("at"), F.concat("way", F.array("label")).alias("way"), "partial"))
        ends = step.where("not partial").select(F.expr("way[0]").alias("name"), F.array_join("way", " > ").alias("trail"))
        trails = ends if trails is None else trails.unionByName(ends)
        frontier = checkpoint(step.where("partial").groupBy("start", "at").agg(F.min("way").alias("way")).join(seen, ["start", "at"], "left_anti"))
        if frontier.isEmpty():
            return trails.distinct()
        seen = checkpoint(seen.unionByName(frontier.select("start", "at")))


def affected_templates(t: Tables, variable: str, root: str = "app/views") -> DataFrame:
    """Templates that show ``variable``, under whatever name it reaches them."""
    return state_flow(t, variable, root).select("doc_id").distinct()


def layout_sites(t: Tables, root: str = "app/views") -> DataFrame:
    """(caller, callee, layout): each template and the first of its layout candidates that is a file."""
    files = t.docs.select(F.col("doc_id").alias("callee"), template_name(F.col("path"), root).alias("layout"), template_rank(F.col("path")).alias("rank"), "path").where("layout like 'layouts/%'")
    best = files.groupBy("layout").agg(F.min_by("callee", F.struct("rank", "path")).alias("callee"))
    found = layout_candidates(t.docs, root).join(best, "layout").where("doc_id <> callee")
    views = t.docs.where(~template_name(F.col("path"), root).startswith("layouts/")).select("doc_id")
    return found.join(views, "doc_id").groupBy(F.col("doc_id").alias("caller")).agg(F.min(F.struct("pos", "layout", "callee")).alias("x")).select("caller", "x.callee", "x.layout")


def inferred_signature(t: Tables, root: str = "app/views") -> DataFrame:
    """(name, locals): names of locals over all callers, sorted, comma-joined."""
    c = calls(t, root).select("name", F.explode_outer(F.map_keys("locals")).alias("local"))
    return c.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("local")), ",").alias("locals"))


def strict_local_mismatches(t: Tables, root: str = "app/views") -> DataFrame:
    """(doc_id, name, local, problem): required locals a call leaves out, and locals the partial does not declare."""
    index = partial_index(t.docs, root).select("name", F.col("doc_id").alias("callee"))
    site = calls(t, root).join(index, "name").select("doc_id", "name", "callee", "line", "pos", F.map_keys("locals").alias("passed"))
    declared = erb.strict_locals(t).groupBy(F.col("doc_id").alias("callee")).agg(
        F.collect_set(F.when(F.col("required"), F.col("name"))).alias("needed"), F.collect_set("name").alias("allowed"), F.bool_or(F.col("kind") == "keyword_rest").alias("open")
    )
    both = site.join(declared, "callee")
    missing = both.select("doc_id", "name", "line", F.explode(F.array_except("needed", "passed")).alias("local"), F.lit("missing").alias("problem"))
    unknown = both.where("not open").select("doc_id", "name", "line", F.explode(F.array_except("passed", "allowed")).alias("local"), F.lit("unknown").alias("problem"))
    return missing.unionByName(unknown)


def state_flow(t: Tables, variable: str, root: str = "app/views") -> DataFrame:
    """(doc_id, name): templates that receive an instance variable, and under which local name."""
    index = partial_index(t.docs, root).select("name", F.col("doc_id").alias("callee"))
    passed = calls(t, root).join(index, "name").select(F.col("doc_id").alias("caller"), "callee", F.explode("locals").alias("local", "value"))
    passed = checkpoint(passed.withColumn("root", F.regexp_extract("value", r"^(@?\w+)", 1)).distinct())
    seen = checkpoint(erb.instance_variables(t).where(F.col("name") == variable).select("doc_id", "name").distinct())
    frontier = seen
    while True:
        step = frontier.join(passed, (F.col("doc_id") == F.col("caller")) & (F.col("name") == F.col("root"))).select(F.col("callee").alias("doc_id"), F.col("local").alias("name")).distinct()
        frontier = checkpoint(step.join(seen, ["doc_id", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen


def traces(t: Tables, root: str = "app/views") -> DataFrame:
    """(doc_id, trail): chains of callers from an entry template to each partial, as ids joined by ``>``."""
    e = checkpoint(edges(t, root))
    frontier = checkpoint(t.docs.where(~is_partial(F.col("path"))).select("doc_id", F.array("doc_id").alias("through")))
    out = frontier
    while True:
        step = frontier.join(e, F.col("doc_id") == F.col("caller")).where(~F.array_contains("through", F.col("callee"))).select(F.col("callee").alias("doc_id"), F.concat("through", F.array("callee")).alias("through"))
        frontier = checkpoint(step)
        if frontier.isEmpty():
            break
        out = checkpoint(out.unionByName(frontier))
    return out.select("doc_id", F.array_join(F.transform("through", lambda x: x.cast("string")), ">").alias("trail"))
