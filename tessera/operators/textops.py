"""Scalar text operators: escapes, indentation, printing, rewriting and unified diffs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.directives import named
from tessera.functions.html_tables import BLOCK, OPTIONAL_END, P_CLOSERS, VOID
from tessera.operators.lexer import lex
from tessera.operators.parser import Item, Options, Parser


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_html(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def escape_attribute(c: Column) -> Column:
    return _replaced(escape_html(c), [("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")])


def escape_javascript(c: Column) -> Column:
    return _replaced(c, [("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("</", "<\\/"), ("\n", "\\n"), ("\r", "\\r")])


def escape_css(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\w\s-])", r"\\$1")


def tabs_to_spaces(c: Column, width: int = 2) -> Column:
    """Leading tabs only; four nested tabs and more take one pass each, up to a depth of 64."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.repeat(F.lit(" " * width), F.length(F.regexp_extract(x, "^(\t*)", 1))), F.regexp_replace(x, "^\t+", ""))), "\n")


def spaces_to_tabs(c: Column, width: int = 2) -> Column:
    lead = F.regexp_extract
    return F.array_join(
        F.transform(F.split(c, "\n"), lambda x: F.concat(F.repeat(F.lit("\t"), F.floor(F.length(lead(x, "^( *)", 1)) / width).cast("int")), F.regexp_replace(x, f"^( {{{width}}})+", ""))), "\n"
    )


def string_to_direct_output(c: Column) -> Column:
    """``<%= "x" %>`` → ``x`` for strings without interpolation or escapes."""
    return F.regexp_replace(c, r"<%=\s*(?:\"([^\"#\\<>&]*)\"|'([^'\\<>&]*)')\s*%>", "$1$2")


def erb_to_ruby_string(c: Column) -> Column:
    """``a<%= b %>`` → ``"a#{b}"``."""
    return F.concat(F.lit('"'), F.regexp_replace(F.replace(c, F.lit('"'), F.lit('\\"')), r"<%=\s*(.*?)\s*%>", r"#{$1}"), F.lit('"'))


def sort_classes(c: Column, order: list[str]) -> Column:
    """Class tokens: unknown ones first as they stand, then known ones by ``order``, variants after their base."""
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)]) if order else None
    tokens = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")

    def place(x: Column, i: Column) -> Column:
        base = F.regexp_replace(x, "^.*:", "")
        known = rank[base] if rank is not None else F.lit(None).cast("int")
        return F.struct(F.coalesce(known, F.lit(-1)).alias("r"), F.when(known.isNotNull(), F.size(F.split(x, ":"))).otherwise(0).alias("v"), i.alias("i"), x.alias("x"))

    return F.array_join(F.transform(F.array_sort(F.transform(tokens, place)), lambda s: s["x"]), " ")


def identity(source: str | None) -> str:
    """Source printed from its tokens."""
    return "".join(t[1] for t in lex(source))


def print_identity(c: Column) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else identity(x))

    return run(c)


def is_scaffold(c: Column) -> Column:
    """Generator templates (``<%%``) and templates with an ignore comment are not formatted."""
    return c.rlike(r"<%%=?") | c.rlike(named(r"<%#\s*{word}:formatter ignore\s*%>"))


def _tag(x: Item) -> str:
    parts = [x.raw]
    for a in x.attrs:
        name = "".join(p.text if p.kind == "literal" else f"{p.opening}{p.text}%>" for p in a.name_parts)
        value = "".join(p.text if p.kind == "literal" else f"{p.opening}{p.text}%>" for p in a.parts)
        parts.append(name if not a.equals else f"{name}='{value}'" if '"' in value else f'{name}="{value}"')
    parts += [f"{e.opening} {e.text.strip()} {e.closing or '%>'}" for e in x.erb]
    return "<" + " ".join(parts) + (" />" if x.closing == "/>" and x.tag not in VOID else ">")


#: Elements around and inside which white space may be added; all others stand in text, where it may not.
_BLOCKS = BLOCK | P_CLOSERS | OPTIONAL_END | frozenset("html head body title meta link base caption col summary legend".split())
#: What shows nothing itself: on lines of its own, unless text touches it.
_UNSEEN = frozenset("script style template noscript".split())


def _flows(x: Item) -> bool:
    return x.kind in ("text", "erb") or (x.kind == "element" and x.tag not in _BLOCKS and x.tag not in _UNSEEN)


def _runs(items: list[Item], raw: bytes) -> list[list[Item] | Item]:
    """Siblings as runs of text with what stands in it, and blocks between them."""
    out: list[list[Item] | Item] = []
    for k, x in enumerate(items):
        stands = _flows(x)
        if not stands and not (x.kind == "element" and x.tag in _BLOCKS):
            before = k and _flows(items[k - 1]) and not raw[x.start - 1 : x.start].isspace()
            after = k + 1 < len(items) and _flows(items[k + 1]) and not raw[x.end : x.end + 1].isspace()
            stands = bool(before or after)
        if not stands:
            out.append(x)
        elif out and isinstance(out[-1], list):
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _atoms(run: list[Item], raw: bytes) -> list[str]:
    """A run cut where it has white space between words: nowhere else may a line end."""
    out: list[str] = []
    glued = False
    for x in run:
        if x.kind != "text":
            text = raw[x.start : x.end].decode("utf-8", "surrogatepass")
            out[-1:] = [out[-1] + text] if glued else [*out[-1:], text]
            glued = True
            continue
        words = x.text.split()
        if not words:
            glued = glued and not x.text
            continue
        if glued and not x.text[0].isspace():
            out[-1] += words.pop(0)
        out += words
        glued = not x.text[-1].isspace()
    return out


def _filled(atoms: list[str], pad: str, width: int) -> list[str]:
    lines, line = [], ""
    for a in atoms:
        if line and len(pad) + len(line) + 1 + len(a) > width:
            lines.append(pad + line)
            line = a
        else:
            line = f"{line} {a}" if line else a
    return [*lines, pad + line] if line else lines


def _rewritable(x: Item) -> bool:
    """Whether the open tag can be written anew: nothing embedded between its attributes, and no value with both quotes."""
    values = ["".join(p.text if p.kind == "literal" else f"{p.opening}{p.text}%>" for p in a.parts) for a in x.attrs]
    return not x.erb and not any("'" in v and '"' in v for v in values)


def format_source(source: str | None, width: int = 80, indent: int = 2) -> str | None:
    """A layout of one block a line, deeper ones indented; text and what stands in it fill lines.

    White space is changed only where the source has some, and at the edges of
    blocks, where it does not show.  Sources with parse errors, scaffolds and
    ignored templates stay as they are; preformatted elements keep their body.
    """
    if source is None or "<%%" in source or named("{word}:formatter ignore") in source:
        return source
    p = Parser(source, Options(strict=False))
    tree = p.tree()
    if p.errors:
        return source
    raw = source.encode("utf-8", "surrogatepass")
    out: list[str] = []

    def verbatim(x: Item) -> str:
        return raw[x.start : x.end].decode("utf-8", "surrogatepass")

    # (run or item, depth) or (line, None)
    work: list[tuple] = [(x, 0) for x in reversed(_runs(tree, raw))]
    while work:
        x, depth = work.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        pad = " " * (indent * depth)
        if isinstance(x, list):
            out += _filled(_atoms(x, raw), pad, width)
        elif x.kind == "element" and x.close in ("tag", "omitted", "missing") and x.tag not in ("pre", "textarea", "script", "style") and _rewritable(x):
            close = f"</{x.close_raw or x.raw}>" if x.close == "tag" else ""
            runs = _runs(x.children, raw)
            if not runs or (len(runs) == 1 and isinstance(runs[0], list)):
                line = pad + _tag(x) + " ".join(_atoms(runs[0], raw) if runs else ()) + close
                if len(line) <= width:
                    out.append(line)
                    continue
            out.append(pad + _tag(x))
            if close:
                work.append((pad + close, None))
            work += [(c, depth + 1) for c in reversed(runs)]
        elif x.kind == "element" and x.close in ("void", "self") and _rewritable(x):
            out.append(pad + _tag(x))
        elif x.kind == "block":
            lines: list[tuple] = []
            for n, head in enumerate(x.heads):
                lines.append((f"{pad}{head.opening} {head.text.strip()} {head.closing or '%>'}", None))
                if n < len(x.branches):
                    lines += [(c, depth + 1) for c in _runs(x.branches[n], raw)]
            work += reversed(lines)
        else:
            out.append(pad + verbatim(x))
    return "\n".join(out) + ("\n" if out else "")


def formatted(c: Column, width: int = 80, indent: int = 2) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: format_source(x, width, indent))

    return run(c)


def would_change(docs: DataFrame, text: str = "source") -> DataFrame:
    """Documents that formatting would change."""
    return docs.withColumn("formatted", formatted(F.col(text))).where(F.col("formatted") != F.col(text)).select("doc_id")


def auto_closed(source: str | None) -> str | None:
    """Omitted closing tags written out."""
    if source is None:
        return None
    raw = source.encode("utf-8", "surrogatepass")
    ends: dict[int, str] = {}
    todo = list(Parser(source, Options(strict=False)).tree())
    while todo:
        x = todo.pop()
        if x.kind == "element" and x.close == "omitted":
            ends[x.end] = f"</{x.raw}>" + ends.get(x.end, "")
        todo += x.children + [c for part in x.branches for c in part]
    at, out = 0, []
    for k in sorted(ends):
        out += [raw[at:k], ends[k].encode()]
        at = k
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def auto_close(c: Column) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(auto_closed)

    return run(c)


def line_diff(old: Column, new: Column, context: int = 3) -> Column:
    """Unified hunks of two texts."""

    @pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), lineterm="", n=context)) for x, y in zip(a, b, strict=True)])

    return run(old, new)


def unified_hunks(diffs: DataFrame) -> DataFrame:
    """Lines of ``diffs(diff_id, text)``: hunk number, kind (context, added, removed) and text; hunks are counted by a running sum."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("diff_id").orderBy("n")
    hunk = F.sum(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(w)
    kind = F.when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "removed").otherwise("context")
    return lines.withColumn("hunk", hunk).where("hunk > 0 and not startswith(line, '@@')").select("diff_id", "hunk", "n", kind.alias("kind"), F.expr("substring(line, 2)").alias("text"))


def compile_tokens(source: str | None) -> list[tuple[str, str]]:
    """The static part of compiling: text, code, expr, expr_escaped; adjacent text is one, ``-`` trims its line."""
    out: list[list[str]] = []
    toks = lex(source)
    i = 0
    trim = False
    while i < len(toks):
        kind, value = toks[i][:2]
        if kind == "ERB_START":
            content = toks[i + 1][1]
            end = toks[i + 2][1] if i + 2 < len(toks) and toks[i + 2][0] == "ERB_END" else ""
            if value == "<%-" and out and out[-1][0] == "text":
                out[-1][1] = out[-1][1].rstrip(" \t")
            if value in ("<%%", "<%%="):
                out.append(["text", "<%" + value[3:] + content + "%>"])
            elif value != "<%#":
                out.append([{"<%=": "expr_escaped", "<%==": "expr"}.get(value, "code"), content.strip()])
            trim = end == "-%>"
            i += 3 if end else 2
            continue
        if kind != "EOF":
            if trim and kind == "NEWLINE":
                value = ""
            trim = False
            if out and out[-1][0] == "text":
                out[-1][1] += value
            elif value:
                out.append(["text", value])
        i += 1
    return [(k, v) for k, v in out]


def compiled(c: Column) -> Column:
    """The compile steps of a source as one text, kind(text) after kind(text)."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "".join(f"{kind}({text})" for kind, text in compile_tokens(x)))

    return run(c)
