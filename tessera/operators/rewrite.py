"""Rewriters: helpers to HTML and back, conditionals, automatic fixes, inlined partials."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.html_tables import VOID
from tessera.operators import graph
from tessera.operators.lexer import lex
from tessera.operators.tables import Tables

_TOKEN = re.compile(r"\s*(\"(?:[^\"\\#]|\\.)*\"|'(?:[^'\\]|\\.)*'|:\w+|-?\d+(?:\.\d+)?|true|false|nil|[@\w.\[\]]+(?:\([^()]*\))?|\{[^{}]*\})\s*")
_KEY = re.compile(r"\s*(?:(\w+):|\"([\w-]+)\":|:(\w+)\s*=>)\s*")


def arguments(text: str) -> tuple[list[str], list[tuple[str, str]]] | None:
    """Positional and keyword arguments of a call in order; None where the text is more than literals and simple calls."""
    at, places, keys = 0, [], []
    text = text.strip()
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1]
    while at < len(text):
        k = _KEY.match(text, at)
        name = None
        if k:
            name, at = k[1] or k[2] or k[3], k.end()
        v = _TOKEN.match(text, at)
        if not v or not v[1]:
            return None
        at = v.end()
        if name is None:
            if keys:
                return None
            places.append(v[1])
        else:
            keys.append((name, v[1]))
        if at < len(text):
            if text[at] != ",":
                return None
            at += 1
    return places, keys


def _value(source: str) -> str:
    """Markup of a Ruby value: literals as text, the rest as output."""
    if source[0] in "\"'":
        return escape(source[1:-1], quote=True)
    if source[0] == ":":
        return source[1:]
    if re.fullmatch(r"-?\d+(\.\d+)?|true|false", source):
        return source
    return f"<%= {source} %>"


def attributes_of(keys: list[tuple[str, str]]) -> str:
    out = []
    for name, source in keys:
        if name in ("data", "aria") and source.startswith("{"):
            inner = arguments(source[1:-1])
            if inner:
                out += [f'{name}-{k.replace("_", "-")}="{_value(v)}"' for k, v in inner[1]]
        elif source == "true":
            out.append(name)
        elif source not in ("false", "nil"):
            out.append(f'{name.replace("_", "-") if name.startswith(("data_", "aria_")) else name}="{_value(source)}"')
    return "".join(" " + x for x in out)


def helper_markup(code: str) -> str | None:
    """HTML of one helper call, None for other code."""
    m = re.match(r"\s*(link_to|content_tag|image_tag|javascript_include_tag|stylesheet_link_tag|turbo_frame_tag|javascript_tag|tag\.[a-z]\w*)\b(.*)\Z", code, re.S)
    if not m or re.search(r"\bdo\b|\{\s*\|", m[2]):
        return None
    got = arguments(m[2])
    if got is None:
        return None
    places, keys = got
    name = m[1]
    if name == "link_to" and len(places) == 2:
        return f'<a href="{_value(places[1])}"{attributes_of(keys)}>{_value(places[0])}</a>'
    if name == "image_tag" and len(places) == 1:
        return f'<img src="{_value(places[0])}"{attributes_of(keys)}>'
    if name == "javascript_include_tag" and len(places) == 1:
        return f'<script src="{_value(places[0])}"{attributes_of(keys)}></script>'
    if name == "stylesheet_link_tag" and len(places) == 1:
        return f'<link rel="stylesheet" href="{_value(places[0])}"{attributes_of(keys)}>'
    if name == "turbo_frame_tag" and len(places) == 1:
        return f'<turbo-frame id="{_value(places[0])}"{attributes_of(keys)}></turbo-frame>'
    if name == "javascript_tag" and len(places) == 1:
        return f"<script{attributes_of(keys)}>{places[0][1:-1]}</script>"
    if name == "content_tag" and places and len(places) <= 2:
        tag, body = _value(places[0]), places[1:]
    elif name.startswith("tag.") and len(places) <= 1:
        tag, body = name[4:].replace("_", "-"), places
    else:
        return None
    if tag in VOID:
        return None if body else f"<{tag}{attributes_of(keys)}>"
    return f"<{tag}{attributes_of(keys)}>{_value(body[0]) if body else ''}</{tag}>"


def _each_tag(source: str, change: Callable[[str, str, str], str | None]) -> str:
    """Source with every embedded tag that ``change(opening, content, closing)`` rewrites."""
    out, toks, i = [], lex(source), 0
    while i < len(toks):
        kind, value = toks[i][:2]
        if kind == "ERB_START":
            content = toks[i + 1][1]
            end = toks[i + 2][1] if i + 2 < len(toks) and toks[i + 2][0] == "ERB_END" else ""
            new = change(value, content, end) if end else None
            out.append(value + content + end if new is None else new)
            i += 3 if end else 2
            continue
        out.append(value)
        i += 1
    return "".join(out)


def helpers_to_html(source: str) -> str:
    return _each_tag(source, lambda o, c, e: helper_markup(c) if o == "<%=" else None)


def postfix_to_block(source: str) -> str:
    """``<%= x if y %>`` → an if block around the output."""

    def change(opening: str, content: str, closing: str) -> str | None:
        m = re.match(r"\s*([^\"'\n]+?|\"[^\"]*\"|'[^']*')\s+(if|unless)\s+(\S[^\n]*?)\s*\Z", content)
        return f"<% {m[2]} {m[3]} %><%= {m[1]} %><% end %>" if opening == "<%=" and m and not re.match(r"\s*(if|unless|else)\b", content) else None

    return _each_tag(source, change)


def ternary_to_block(source: str) -> str:
    def change(opening: str, content: str, closing: str) -> str | None:
        m = re.match(r"\s*([\w.@?!]+)\s+\?\s+(\"[^\"]*\"|'[^']*'|[\w.@]+)\s*:\s*(\"[^\"]*\"|'[^']*'|[\w.@]+)\s*\Z", content)
        return f"<% if {m[1]} %><%= {m[2]} %><% else %><%= {m[3]} %><% end %>" if opening == "<%=" and m else None

    return _each_tag(source, change)


def html_to_helpers(source: str) -> str:
    """Links and images with static attributes as helper calls."""

    def keys(text: str, skip: tuple[str, ...]) -> str | None:
        pairs = re.findall(r'\s+([a-z][\w-]*)(?:="([^"<]*)")?', text)
        if "".join(f' {n}="{v}"' for n, v in pairs) != text:
            return None
        return "".join(f', {n if "-" not in n else chr(34) + n + chr(34)}: "{v}"' for n, v in pairs if n not in skip)

    def link(m: re.Match) -> str:
        href, rest = re.search(r' href="([^"<]*)"', m[1]), keys(m[1], ("href",))
        return f'<%= link_to "{m[2]}", "{href[1]}"{rest} %>' if href and rest is not None else m[0]

    def image(m: re.Match) -> str:
        src, rest = re.search(r' src="([^"<]*)"', m[1]), keys(m[1], ("src",))
        return f'<%= image_tag "{src[1]}"{rest} %>' if src and rest is not None else m[0]

    source = re.sub(r'<a((?: [a-z][\w-]*="[^"<]*")+)>([^<"#]*)</a>', link, source)
    return re.sub(r'<img((?: [a-z][\w-]*="[^"<]*")+)>', image, source)


#: What fixes of markup leave alone: bodies that are no markup, comments, embedded tags.
_KEPT = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<%.*?(?:%>|\Z)|<(?=(?i:pre|textarea|script|style)\b)")
_BODY = re.compile(r"(?is)(<(pre|textarea|script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)(.*?)(?=</\2\s*>|\Z)")


def _markup_only(source: str, change: Callable[[str], str]) -> str:
    """``source`` with ``change`` applied to its markup and text, in pieces between what it must leave alone."""
    kept: list[tuple[int, int]] = []
    at = 0
    while m := _KEPT.search(source, at):
        if m[0] == "<":
            body = _BODY.match(source, m.start())
            if body is None:
                at = m.end()
                continue
            kept.append(body.span(3))
            at = max(body.end(), m.end())
        else:
            kept.append(m.span())
            at = max(m.end(), m.start() + 1)
    out, at = [], 0
    for a, b in kept:
        out += [change(source[at:a]), source[a:b]]
        at = b
    return "".join([*out, change(source[at:])])


def fixed(source: str) -> str:
    """Safe automatic fixes of tags, spacing and line ends; preformatted text, scripts, styles and comments keep theirs."""

    def tag(opening: str, content: str, closing: str) -> str | None:
        if opening == "<%" and re.match(r" +#", content) and not re.match(r"\s*#\s*locals:", content):
            opening, content = "<%#", content.split("#", 1)[1]
        if closing == "=%>":
            closing = "-%>"
        # a commented-out output tag is a comment as it stands
        if opening in ("<%", "<%=", "<%==", "<%-", "<%#") and content.strip() and "\n" not in content and not (opening == "<%#" and content.startswith("=")):
            content = f" {content.strip()} "
        return opening + content + closing

    def markup(piece: str) -> str:
        piece = re.sub(r"<(/?)([A-Za-z][\w-]*)", lambda m: f"<{m[1]}{m[2].lower()}" if m[2].isupper() or m[2].istitle() else m[0], piece)
        piece = re.sub(r"(<[a-z][^<>%\"']*\s[\w-]+)='([^'\"<>]*)'", r'\1="\2"', piece)
        piece = re.sub(r"[ \t\f]+(?=\n)", "", piece.replace("\r\n", "\n"))
        return re.sub(r"\n{4,}", "\n\n\n", piece)

    source = _markup_only(_each_tag(source.lstrip("\ufeff"), tag), markup)
    return source.rstrip("\n") + "\n" if source.strip() else source


def rewritten(c: Column, change: Callable[[str], str]) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else change(x))

    return run(c)


def pipeline(c: Column, *changes: Callable[[str], str]) -> Column:
    """Rewriters in order in one pass over the text."""

    def every(x: str) -> str:
        for f in changes:
            x = f(x)
        return x

    return rewritten(c, every)


def inline_partials(t: Tables, root: str = "app/views") -> DataFrame:
    """``(doc_id, path, source)`` of all documents, with static renders that pass no locals replaced by the partial's source, its own renders replaced before.

    A render stays where the partial leads back to the one that renders it.
    """
    docs = t.docs.select("doc_id", "path", "source")
    index = graph.partial_index(t.docs, root).select("name", F.col("doc_id").alias("callee"))
    site = graph.calls(t, root).where("size(locals) = 0 and opening = '<%=' and collection_option is null and object_option is null").join(index, "name")
    site = graph.checkpoint(site.select("doc_id", "partial", "callee").distinct())
    pending = graph.checkpoint(site.join(graph.cycles(site.select("doc_id", "callee").distinct()), ["doc_id", "callee"], "left_anti"))
    out = docs.join(pending.select("doc_id").distinct(), "doc_id", "left_anti")

    @pandas_udf("string")
    def put(source: pd.Series, entries: pd.Series) -> pd.Series:
        pattern = re.compile(r"\s*render\s*\(?\s*(?:partial:\s*)?[\"']([a-z0-9_/]+)[\"']\s*\)?\s*\Z")

        def one(s, have):
            have = dict(have or {})
            return _each_tag(s, lambda o, c, e: have.get(m[1], None) if o == "<%=" and (m := pattern.match(c)) else None)

        return pd.Series([one(s, h) for s, h in zip(source, entries, strict=True)])

    # a document's turn comes once all that it renders has had its own
    while not pending.isEmpty():
        waits = pending.join(pending.select(F.col("doc_id").alias("callee")).distinct(), "callee", "left_semi").select("doc_id").distinct()
        ready = pending.join(waits, "doc_id", "left_anti")
        per = ready.join(out.select(F.col("doc_id").alias("callee"), F.col("source").alias("body")), "callee").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("partial", "body"))).alias("bodies"))
        out = graph.checkpoint(out.unionByName(docs.join(per, "doc_id").select("doc_id", "path", put("source", "bodies").alias("source"))))
        pending = graph.checkpoint(pending.join(waits, "doc_id", "left_semi"))
    return out
