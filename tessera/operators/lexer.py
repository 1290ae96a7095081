"""Tokens of HTML with embedded Ruby, with byte ranges and line/column positions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.session import spread

#: Openers, longest first.
_OPEN = r"<%==|<%%=|<%graphql|<%=|<%\#|<%-|<%%(?!>)|<%"
_DATA = re.compile(
    rf"""(?P<IDENTIFIER>[A-Za-z0-9](?:(?!--!?>)[A-Za-z0-9:_-])*)
    |(?P<WHITESPACE>[ \t\f\v]+)
    |(?P<NEWLINE>\r\n|\r|\n)
    |(?P<NBSP>\u00a0)
    |(?P<ERB_START>{_OPEN})
    |(?P<HTML_DOCTYPE>(?i:<!doctype))
    |(?P<XML_DECLARATION><\?xml(?![A-Za-z0-9:_-]))
    |(?P<XML_PI_START><\?(?=[A-Za-z]))
    |(?P<XML_DECLARATION_END>\?>)
    |(?P<CDATA_START><!\[CDATA\[)
    |(?P<CDATA_END>\]\]>)
    |(?P<HTML_COMMENT_START><!--)
    |(?P<HTML_COMMENT_END>-->)
    |(?P<HTML_COMMENT_INVALID_END>--!>)
    |(?P<HTML_TAG_START_CLOSE></(?=\s*[A-Za-z_]))
    |(?P<HTML_TAG_START><(?=[A-Za-z]))
    |(?P<LT><)
    |(?P<HTML_TAG_SELF_CLOSE>/>)
    |(?P<HTML_TAG_END>>)
    |(?P<UNDERSCORE>_)|(?P<COLON>:)|(?P<AT>@)|(?P<SEMICOLON>;)|(?P<AMPERSAND>&)|(?P<EXCLAMATION>!)
    |(?P<EQUALS>=)|(?P<PERCENT>%)|(?P<SLASH>/)|(?P<DASH>-)|(?P<QUOTE>["'])|(?P<BACKTICK>`)|(?P<BACKSLASH>\\)
    |(?P<CHARACTER>.)""",
    re.X | re.S,
)
_CONTENT = re.compile(r"(?:(?![%=-]?%>|<%).)*", re.S)
_CLOSE = re.compile(r"%%>|=%>|-%>|%>")
_BREAK = re.compile(r"\r\n|\r|\n")

#: Text behind a tag's end in which no token means more than its characters.
_TEXT = re.compile(r"[^<>\"'\-\]?%/\r\n]+")

Token = tuple[str, str, int, int, int, int, int, int]


def lex(source: str | None, coarse: bool = False) -> list[Token]:
    """``(type, value, from, to, start_line, start_column, end_line, end_column)``; lines from 1, columns from 0.

    Ranges count UTF-8 bytes, columns code points.  The last token is ``EOF``.
    A null source lexes like an empty one.  With ``coarse``, as the parser reads,
    plain text behind a tag's end is one ``TEXT`` token.
    """
    source = source or ""
    out: list[Token] = []
    put = out.append
    at, byte, line, column = 0, 0, 1, 0
    plain = source.isascii()
    match, end = _DATA.match, len(source)
    run, in_text = _TEXT.match, False
    while at < end:
        if in_text and (m := run(source, at)):
            value = m.group()
            at = m.end()
            size = len(value)
            after = byte + (size if plain else len(value.encode("utf-8", "surrogatepass")))
            put(("TEXT", value, byte, after, line, column, line, column + size))
            column += size
            byte = after
            continue
        m = match(source, at)
        kind, value = m.lastgroup, m.group()
        at = m.end()
        size = len(value)
        after = byte + (size if plain else len(value.encode("utf-8", "surrogatepass")))
        if kind == "NEWLINE":
            put((kind, value, byte, after, line, column, line + 1, 0))
            line, column = line + 1, 0
        else:
            put((kind, value, byte, after, line, column, line, column + size))
            column += size
        byte = after
        if coarse and kind in _TURNS:
            in_text = value[-1] == ">"
        if kind == "ERB_START":
            value = _CONTENT.match(source, at).group()
            at += len(value)
            after = byte + len(value.encode("utf-8", "surrogatepass"))
            breaks = _BREAK.findall(value)
            then = (line + len(breaks), len(value) - max(value.rfind("\n"), value.rfind("\r")) - 1) if breaks else (line, column + len(value))
            put(("ERB_CONTENT", value, byte, after, line, column, *then))
            byte, (line, column) = after, then
            e = _CLOSE.match(source, at)
            if e:
                size = len(e.group())
                put(("ERB_END", e.group(), byte, byte + size, line, column, line, column + size))
                at, byte, column = at + size, byte + size, column + size
    put(("EOF", "", byte, byte, line, column, line, column))
    return out


def lines(source: str) -> int:
    """The number of line ends."""
    return len(_BREAK.findall(source))


#: Tokens after which text begins, and tokens that end it.
_TURNS = frozenset(("HTML_TAG_END", "HTML_TAG_SELF_CLOSE", "QUOTE", "HTML_TAG_START", "HTML_TAG_START_CLOSE", "HTML_DOCTYPE", "XML_DECLARATION", "XML_PI_START", "CDATA_START", "HTML_COMMENT_START"))

SCHEMA = "doc_id long, idx int, type string, value string, range_from int, range_to int, start_line int, start_column int, end_line int, end_column int"


def tokens(docs: DataFrame, text: str = "source") -> DataFrame:
    """A row for each token of ``docs(doc_id, <text>)``: one scan, no shuffle."""

    def run(batches):
        for b in batches:
            for doc, source in zip(b.column("doc_id").to_pylist(), b.column("source").to_pylist(), strict=True):
                got = lex(source)
                cols = list(zip(*got, strict=True))
                kinds = [pa.string(), pa.string(), *[pa.int32()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                    names=["doc_id", "idx", "type", "value", "range_from", "range_to", "start_line", "start_column", "end_line", "end_column"],
                )

    return spread(docs.selectExpr("doc_id", f"`{text}` as source")).mapInArrow(run, SCHEMA)
