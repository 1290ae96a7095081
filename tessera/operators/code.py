"""What embedded code says: iterations, unbalanced brackets, locals in scope, states and the tags they reach, renders in Ruby files.

All of it reads code with the small reader of ``ruby.py`` or with patterns, not with a Ruby grammar.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.operators import erb, graph
from tessera.operators.ruby import code_of
from tessera.operators.tables import Tables

#: Methods whose block runs once for each element.
ITERATION = (
    "each", "each_with_index", "each_with_object", "each_slice", "each_cons", "each_pair", "each_entry", "times", "upto", "downto", "step",
    "map", "flat_map", "select", "filter", "reject", "filter_map", "cycle",
)

_LOOP = r"^\s*(?:[a-z_]\w*\s*=\s*)?(\S.*?)\s*(&?\.)(" + "|".join(ITERATION) + r")\s*(?:\(((?:[^()]|\([^()]*\))*)\))?\s*(?:do\b|\{)\s*(?:\|([^|]*)\|)?\s*$"
#: Commas outside of brackets.
_COMMA = r"\s*,\s*(?![^\[({]*[\])}])"
_CODE = "opening not in ('<%#', '<%%', '<%%=')"


def _listed(text):
    return F.filter(F.split(F.trim(text), _COMMA), lambda x: x != "")


def iterations(t: Tables) -> DataFrame:
    """(doc_id, receiver, operator, message, arguments, parameters, line, column) of blocks that run once for each element."""
    part = lambda k: F.regexp_extract("content", _LOOP, k)
    return t.erb.where("control = 'block'").where(F.col("content").rlike(_LOOP)).select(
        "doc_id", part(1).alias("receiver"), part(2).alias("operator"), part(3).alias("message"), _listed(part(4)).alias("arguments"), _listed(part(5)).alias("parameters"), "line", "column"
    )


_PAIRS = {")": "(", "]": "[", "}": "{"}


def unbalanced(content: str, control: str) -> str | None:
    """The first bracket or quote of a tag's code without its counterpart; blocks may open or close one brace."""
    code = re.sub(r"\"\"|''", "", code_of(content))
    if control == "end":
        code = re.sub(r"^\s*\}", "", code)
    if re.search(r"[\"']", code):
        return "unterminated string"
    opened = []
    for c in re.findall(r"[(\[{}\])]", code):
        if c not in _PAIRS:
            opened.append(c)
        elif opened and opened[-1] == _PAIRS[c]:
            opened.pop()
        else:
            return f"unexpected {c}"
    if control == "block" and opened and opened[0] == "{":
        opened = opened[1:]
    return f"unclosed {opened[-1]}" if opened else None


def balance_errors(t: Tables) -> DataFrame:
    """(doc_id, message, line, column): tags whose brackets or quotes do not pair up."""

    @pandas_udf("string")
    def judge(content: pd.Series, control: pd.Series) -> pd.Series:
        return pd.Series([unbalanced(a, b) for a, b in zip(content.fillna(""), control.fillna(""), strict=True)], dtype=object)

    # code without brackets and quotes needs no reading
    tags = t.erb.where(_CODE).where(F.col("content").rlike(r"[()\[\]{}\"']"))
    return tags.select("doc_id", judge("content", "control").alias("message"), "line", "column").where("message is not null")


def dependency_index(t: Tables) -> DataFrame:
    """(doc_id, state, uses): the tags, by position, that read an instance variable, a constant or a declared local."""
    code = F.regexp_replace("content", r"'[^']*'|\"[^\"#]*\"", " ")
    word = F.regexp_extract_all(code, F.lit(r"(?<![\w@$:.])(@?[a-z_]\w*(?![\w?!]*:(?!:))|[A-Z]\w*(?:::[A-Z]\w*)*)"), F.lit(1))
    use = t.erb.where(_CODE).select("doc_id", "line", "column", F.explode(F.array_distinct(word)).alias("state"))
    declared = erb.strict_locals(t).select("doc_id", F.col("name").alias("state")).distinct()
    known = use.where("state rlike '^[@A-Z]'").unionByName(use.join(declared, ["doc_id", "state"], "left_semi").where("not state rlike '^[@A-Z]'"))
    return known.groupBy("doc_id", "state").agg(F.array_sort(F.collect_set(F.struct("line", "column"))).alias("uses"))


def local_scopes(t: Tables) -> DataFrame:
    """(doc_id, name, range_from, range_to): where a block parameter or an assigned local can be read.

    A parameter lives in its block; an assignment from its tag to the end of the innermost block around it, else of the document.
    """
    blocks = t.nodes.where("type = 'block' and control = 'block'").select("doc_id", "node_id", "content", "range_from", "range_to")
    names = F.regexp_extract_all(F.regexp_extract("content", r"\|([^|]*)\|\s*$", 1), F.lit(r"([a-z_]\w*)(?=\s*(?:[,=:)]|$))"), F.lit(1))
    given = blocks.select("doc_id", F.explode(names).alias("name"), "range_from", "range_to")
    to = F.regexp_extract_all("content", F.lit(r"(?:^|[;\n(])\s*([a-z_]\w*)\s*(?:\|\||&&|[-+*/])?=(?![=~>])"), F.lit(1))
    put = t.erb.where(_CODE).select("doc_id", F.explode(F.array_distinct(to)).alias("name"), F.col("range_to").alias("at"))
    around = blocks.select("doc_id", F.col("range_from").alias("a"), F.col("range_to").alias("b"))
    inner = put.join(around, ["doc_id"], "left").groupBy("doc_id", "name", "at").agg(F.min(F.when((F.col("a") < F.col("at")) & (F.col("at") < F.col("b")), F.col("b"))).alias("end"))
    return given.unionByName(inner.select("doc_id", "name", F.col("at").alias("range_from"), F.coalesce("end", F.lit((1 << 31) - 1)).alias("range_to")))


def locals_at(t: Tables, places: DataFrame) -> DataFrame:
    """``places(doc_id, at)`` with ``locals``, the sorted names readable at byte ``at``: a range join within each document."""
    found = places.select("doc_id", "at").distinct().join(local_scopes(t), ["doc_id"], "left")
    inside = (F.col("range_from") <= F.col("at")) & (F.col("at") < F.col("range_to"))
    return found.groupBy("doc_id", "at").agg(F.array_sort(F.collect_set(F.when(inside, F.col("name")))).alias("locals"))


#: Fixed value: how Ruby files name partials, up to the closing quote or the first interpolated folder.
_RENDER = r"(?:render\s+(?:partial:\s*)?|partial\s*[:=]\s*)[\"']([a-z0-9_/]+(?:[\"']|/#\{))"


def ruby_references(files: DataFrame) -> DataFrame:
    """(doc_id, name, dynamic) of Ruby ``files(doc_id, source)``: partials they render; with ``dynamic``, ``name`` is the folder that the interpolation follows."""
    hit = F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(_RENDER), F.lit(1)))).alias("hit")
    return files.select("doc_id", hit).select("doc_id", F.regexp_extract("hit", r"^([a-z0-9_/]+?)(?:[\"']|/#\{)$", 1).alias("name"), F.col("hit").endswith("/#{").alias("dynamic"))


def referenced_partials(t: Tables, files: DataFrame, root: str = "app/views") -> DataFrame:
    """``entries(doc_id)`` for ``graph.reachable``: partials that Ruby files render by name or whose folder they name."""
    index = graph.partial_index(t.docs, root).select("doc_id", "name")
    ref = ruby_references(files).select("name", "dynamic").distinct()
    folders = index.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "/"))), lambda n: F.array_join(F.slice(F.split("name", "/"), 1, n), "/"))).alias("name"))
    return index.join(ref.where("not dynamic"), "name", "left_semi").select("doc_id").unionByName(folders.join(ref.where("dynamic"), "name", "left_semi").select("doc_id")).distinct()


def static_templates(t: Tables) -> DataFrame:
    """(doc_id): documents without code, which are one constant once compiled."""
    return t.docs.select("doc_id").join(t.erb.where(_CODE).select("doc_id").distinct(), "doc_id", "left_anti")


def graph_report(t: Tables, root: str = "app/views") -> DataFrame:
    """(metric, n): templates, partials, render edges, unresolved renders, unused partials."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    out = count(t.docs, "templates")
    for df, name in ((graph.partial_index(t.docs, root), "partials"), (graph.edges(t, root), "edges"), (graph.unresolved(t, root), "unresolved"), (graph.unused_partials(t, root), "unused")):
        out = out.unionByName(count(df, name))
    return out
