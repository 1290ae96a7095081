"""Ruby and HTML of a template, with byte positions kept."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.operators.lexer import lex

SKIPPED = ("<%#", "<%%", "<%%=", "<%graphql")


def _blank(value: str) -> str:
    """Spaces for bytes, line breaks kept."""
    return "".join(c if c in "\r\n" else " " * len(c.encode()) for c in value)


def ruby_of(source: str | None, semicolons: bool = True, comments: bool = False, preserve_positions: bool = True) -> str:
    out: list[str] = []
    plain: list[str] = []
    toks = lex(source)
    i = 0
    while i < len(toks):
        kind, value = toks[i][:2]
        if kind != "ERB_START":
            out.append(_blank(value))
            i += 1
            continue
        content = toks[i + 1][1] if toks[i + 1][0] == "ERB_CONTENT" else ""
        has_end = i + 2 < len(toks) and toks[i + 2][0] == "ERB_END"
        close = toks[i + 2][1] if has_end else ""
        comment = value == "<%#"
        lone = content.strip().startswith("#") and "\n" not in content
        if comment and comments:
            out.append(("#" + " " * (len(value) - 1)) if "\n" in content else " " * (len(value) - 1) + "#")
            out.append(content)
            out.append(_blank(close))
            plain.append("#" + content.rstrip())
        elif value in SKIPPED or lone:
            out.append(_blank(value) + _blank(content) + _blank(close))
        else:
            out.append(_blank(value))
            out.append(content)
            out.append((" ;" + " " * (len(close) - 2)) if semicolons and len(close) >= 2 else _blank(close))
            plain.append(content.strip())
        i += 2 + has_end
    return "".join(out) if preserve_positions else "\n".join(plain)


def html_of(source: str | None) -> str:
    return "".join(_blank(v) if k.startswith("ERB_") else v for k, v, *_ in lex(source))


def extract_ruby(column: Column | str, semicolons: bool = True, comments: bool = False, preserve_positions: bool = True) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else ruby_of(x, semicolons, comments, preserve_positions))

    return run(column)


def extract_html(column: Column | str) -> Column:
    """Native: embedded tags become as many spaces as they have bytes, line breaks stay; the rest is verbatim."""
    c = F.col(column) if isinstance(column, str) else column

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html_of(x))

    # templates without an embedded tag never reach Python
    return F.when(c.contains("<%"), run(F.when(c.contains("<%"), c))).otherwise(c)


def extract(docs: DataFrame, language: str, text: str = "source") -> DataFrame:
    made = extract_ruby(text) if language == "ruby" else extract_html(text)
    return docs.select("doc_id", made.alias("text"))
