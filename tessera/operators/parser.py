"""Error-tolerant parsing of HTML with embedded Ruby into rows.

A document becomes one list of row dicts: nodes in document order, attributes,
embedded tags and errors.  The walk over tokens yields a flat list; embedded
control tags then group siblings into branches; last, open and close tags are
matched within each list of siblings.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from tessera.functions.html_tables import CLOSED_BY, OPTIONAL_END, VOID
from tessera.operators.lexer import Token, lex
from tessera.operators.ruby import control_of

MAX_ERRORS = 25
#: Of an element's ancestors a row keeps so many, the nearest ones.
MAX_ANCESTORS = 256


@dataclass
class Options:
    """Parser options with their defaults."""

    strict: bool = True
    analyze: bool = True
    html: bool = True
    track_whitespace: bool = False
    max_errors: int = MAX_ERRORS


@dataclass
class Part:
    """A piece of an attribute name or value."""

    kind: str
    text: str
    opening: str = ""


@dataclass
class Attribute:
    name: str
    raw: str
    value: str | None
    quote: str
    equals: str
    parts: list[Part]
    name_parts: list[Part]
    line: int
    column: int
    branch: list[str] = field(default_factory=list)


@dataclass
class Item:
    """A flat item, later a tree node."""

    kind: str
    line: int
    column: int
    start: int
    end: int = 0
    tag: str = ""
    raw: str = ""
    text: str = ""
    opening: str = ""
    closing: str = ""
    control: str = ""
    close: str = ""
    close_raw: str = ""
    attrs: list[Attribute] = field(default_factory=list)
    children: list[Item] = field(default_factory=list)
    branches: list[list[Item]] = field(default_factory=list)
    heads: list[Item] = field(default_factory=list)
    erb: list[Item] = field(default_factory=list)
    tag_space: str = ""
    has_end: bool = False


class Parser:
    def __init__(self, source: str, options: Options):
        self.source = source
        self.options = options
        self.t: list[Token] = lex(source, coarse=True)
        self.i = 0
        self.errors: list[tuple[str, str, int, int]] = []
        self.cut_off = False
        self.raw_bytes = source.encode("utf-8", "surrogatepass")
        self.quotes = {q: [k for k, t in enumerate(self.t) if t[0] == "QUOTE" and t[1] == q] for q in "\"'"}

    # -- errors
    def error(self, name: str, message: str, line: int, column: int) -> None:
        self.errors.append((name, message, line, column))

    def reported(self) -> list[tuple[str, str, int, int]]:
        """The first errors of the document, by position."""
        return sorted(self.errors, key=lambda e: e[2:])[: self.options.max_errors]

    # -- walk
    def kind(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.t[k][0] if k < len(self.t) else "EOF"

    def flat(self) -> list[Item]:
        out: list[Item] = []
        text: list[Token] = []

        def flush() -> None:
            if text:
                a = text[0]
                body = "".join(x[1] for x in text)
                out.append(Item("text", a[4], a[5], a[2], text[-1][3], text=body))
                if self.options.strict and "%>" in body:
                    self._stray(text)
                text.clear()

        toks, plain = self.t, PLAIN
        while True:
            i = self.i
            k = toks[i][0]
            while k in plain:
                text.append(toks[i])
                i += 1
                k = toks[i][0]
            self.i = i
            if k == "EOF":
                break
            if k == "ERB_START":
                flush()
                out.append(self.erb())
            elif not self.options.html:
                text.append(self.t[self.i])
                self.i += 1
            elif k == "HTML_DOCTYPE":
                flush()
                out.append(self.until("doctype", "HTML_TAG_END"))
            elif k == "XML_DECLARATION":
                flush()
                out.append(self.until("xml_declaration", "XML_DECLARATION_END"))
            elif k == "XML_PI_START":
                flush()
                out.append(self.until("processing_instruction", "XML_DECLARATION_END"))
            elif k == "CDATA_START":
                flush()
                out.append(self.until("cdata", "CDATA_END"))
            elif k == "HTML_COMMENT_START":
                flush()
                out.append(self.comment())
            elif k == "HTML_TAG_START":
                flush()
                tag = self.open_tag()
                out.append(tag)
                if tag.tag in ("script", "style") and tag.closing != "/>":
                    self.foreign(tag, out)
            elif k == "HTML_TAG_START_CLOSE":
                flush()
                out.append(self.close_tag())
            else:
                text.append(self.t[self.i])
                self.i += 1
        flush()
        return out

    def _stray(self, text: list[Token]) -> None:
        for a, b in zip(text, text[1:], strict=False):
            if a[0] == "PERCENT" and b[0] == "HTML_TAG_END":
                self.error("StrayERBClosingTagError", f"Stray `%>` found at ({a[4]}:{a[5]}).", a[4], a[5])

    def erb(self) -> Item:
        o = self.t[self.i]
        item = Item("erb", o[4], o[5], o[2], o[3], opening=o[1])
        self.i += 1
        if self.kind() == "ERB_CONTENT":
            item.text, item.end = self.t[self.i][1], self.t[self.i][3]
            self.i += 1
        if self.kind() == "ERB_END":
            item.closing, item.end = self.t[self.i][1], self.t[self.i][3]
            self.i += 1
        elif self.kind() == "ERB_START":
            self.error("NestedERBTagError", f"ERB tag `{o[1]}` at ({o[4]}:{o[5]}) was terminated by nested `<%` tag.", o[4], o[5])
        else:
            self.error("UnclosedERBTagError", f"ERB tag `{o[1]}` at ({o[4]}:{o[5]}) is missing closing `%>`.", o[4], o[5])
        item.control = control_of(item.opening, item.text)
        return item

    def until(self, kind: str, end: str) -> Item:
        o = self.t[self.i]
        item = Item(kind, o[4], o[5], o[2])
        parts = []
        while self.kind() not in (end, "EOF"):
            if self.kind() == "ERB_START":
                item.erb.append(self.erb())
                continue
            parts.append(self.t[self.i][1])
            self.i += 1
        if self.kind() == end:
            self.i += 1
        else:
            self.cut_off = True
        item.text, item.end = "".join(parts), self.t[self.i - 1][3]
        return item

    def comment(self) -> Item:
        o = self.t[self.i]
        self.i += 1
        item = Item("comment", o[4], o[5], o[2])
        parts = []
        while self.kind() not in ("HTML_COMMENT_END", "HTML_COMMENT_INVALID_END", "EOF"):
            if self.kind() == "ERB_START":
                item.erb.append(self.erb())
                continue
            parts.append(self.t[self.i][1])
            self.i += 1
        e = self.t[self.i]
        if e[0] == "HTML_COMMENT_INVALID_END":
            self.error("InvalidCommentClosingTagError", f"Invalid comment closing tag `{e[1]}` at ({e[4]}:{e[5]}). Use `-->` instead of `--!>`.", e[4], e[5])
        if e[0] != "EOF":
            self.i += 1
        else:
            self.error("UnexpectedTokenError", f"Found EOF when expecting comment end at ({e[4]}:{e[5]}).", e[4], e[5])
        item.text, item.end = "".join(parts), self.t[self.i - 1][3]
        return item

    def foreign(self, tag: Item, out: list[Item]) -> None:
        """Body of script and style: text and embedded tags up to the matching close tag."""
        body: list[Token] = []

        def flush() -> None:
            if body:
                out.append(Item("literal", body[0][4], body[0][5], body[0][2], body[-1][3], text="".join(x[1] for x in body)))
                body.clear()

        while self.kind() != "EOF":
            if self.kind() == "ERB_START":
                flush()
                out.append(self.erb())
                continue
            if self.kind() == "HTML_TAG_START_CLOSE":
                k = 1
                while self.kind(k) in ("WHITESPACE", "NEWLINE"):
                    k += 1
                if self.kind(k) == "IDENTIFIER" and self.t[self.i + k][1].lower() == tag.tag:
                    flush()
                    out.append(self.close_tag())
                    return
            body.append(self.t[self.i])
            self.i += 1
        flush()

    def close_tag(self) -> Item:
        o = self.t[self.i]
        self.i += 1
        space = ""
        while self.kind() in ("WHITESPACE", "NEWLINE"):
            space += self.t[self.i][1]
            self.i += 1
        name = ""
        while self.kind() in ("IDENTIFIER", "UNDERSCORE", "DASH", "COLON"):
            name += self.t[self.i][1]
            self.i += 1
        item = Item("close", o[4], o[5], o[2], tag=name.lower(), raw=name)
        while self.kind() in ("WHITESPACE", "NEWLINE"):
            space += self.t[self.i][1]
            self.i += 1
        item.tag_space = space
        if self.kind() == "HTML_TAG_END":
            self.i += 1
            item.closing = ">"
        else:
            self.error("UnclosedCloseTagError", f"Closing tag `</{name}>` at ({o[4]}:{o[5]}) is missing closing `>`.", o[4], o[5])
        item.end = self.t[self.i - 1][3]
        return item

    def open_tag(self) -> Item:
        o = self.t[self.i]
        self.i += 1
        name = ""
        while self.kind() in ("IDENTIFIER", "DASH", "COLON") or (name and self.kind() == "CHARACTER" and self.t[self.i][1] == "."):
            name += self.t[self.i][1]
            self.i += 1
        item = Item("open", o[4], o[5], o[2], tag=name.lower(), raw=name)
        space = ""
        branch: list[str] = []
        while True:
            k = self.kind()
            if k in ("WHITESPACE", "NEWLINE"):
                space = self.t[self.i][1]
                if len(space) > 1 and k == "WHITESPACE":
                    item.tag_space = space
                self.i += 1
            elif k in ("HTML_TAG_END", "HTML_TAG_SELF_CLOSE"):
                item.closing = self.t[self.i][1]
                if space and item.closing == ">" and self.kind(-1) == "WHITESPACE":
                    item.tag_space = item.tag_space or space
                self.i += 1
                break
            elif k in ("EOF", "HTML_TAG_START", "HTML_TAG_START_CLOSE", "LT"):
                self.error("UnclosedOpenTagError", f"Opening tag `<{name}>` at ({o[4]}:{o[5]}) is missing closing `>`.", o[4], o[5])
                break
            elif k == "ERB_START" and not self._starts_attribute():
                e = self.erb()
                e.kind = "tag_erb"
                item.erb.append(e)
                if e.control in ("if", "unless", "case"):
                    branch = [*branch, f"{e.start}:0"]
                elif e.control in ("elsif", "else", "when", "in") and branch:
                    b, n = branch[-1].split(":")
                    branch = [*branch[:-1], f"{b}:{int(n) + 1}"]
                elif e.control == "end" and branch:
                    branch = branch[:-1]
            else:
                a = self.attribute()
                if a is not None:
                    a.branch = list(branch)
                    item.attrs.append(a)
        item.end = self.t[self.i - 1][3]
        return item

    def _starts_attribute(self) -> bool:
        if not self.t[self.i][1].startswith("<%="):
            return False
        k = 0
        while self.kind(k) not in ("EOF", "HTML_TAG_END", "HTML_TAG_SELF_CLOSE", "QUOTE", "EQUALS"):
            if self.kind(k) in ("WHITESPACE", "NEWLINE"):
                return False
            k += 1
        return self.kind(k) == "EQUALS"

    def attribute(self) -> Attribute | None:
        a = self.t[self.i]
        parts: list[Part] = []
        while True:
            k = self.kind()
            if k == "ERB_START":
                e = self.erb()
                parts.append(Part("erb_output" if e.opening.startswith("<%=") else "erb_silent", e.text, e.opening))
            elif k in ("IDENTIFIER", "DASH", "COLON", "AT", "UNDERSCORE", "CHARACTER", "SEMICOLON", "AMPERSAND", "PERCENT", "EXCLAMATION", "BACKSLASH"):
                parts.append(Part("literal", self.t[self.i][1]))
                self.i += 1
            else:
                break
        if not parts:
            x = self.t[self.i]
            self.error("UnexpectedError", f"Unexpected token. Expected: attribute, found: {x[1]}.", x[4], x[5])
            self.i += 1
            return None
        raw = "".join(p.text if p.kind == "literal" else p.opening for p in parts)
        dynamic = any(p.kind != "literal" for p in parts)
        out = Attribute("" if dynamic else raw.lower(), raw, None, "", "", [], parts, a[4], a[5])
        k = 0
        while self.kind(k) in ("WHITESPACE", "NEWLINE"):
            k += 1
        if self.kind(k) != "EQUALS":
            return out
        out.equals = "".join(x[1] for x in self.t[self.i : self.i + k + 1])
        self.i += k + 1
        k = 0
        while self.kind(k) in ("WHITESPACE", "NEWLINE"):
            k += 1
        out.equals += "".join(x[1] for x in self.t[self.i : self.i + k])
        if self.kind(k) in ("HTML_TAG_END", "HTML_TAG_SELF_CLOSE", "EOF"):
            self.error("MissingAttributeValueError", f"Attribute `{raw}` at ({a[4]}:{a[5]}) is missing a value after the equals sign.", a[4], a[5])
            return out
        self.i += k
        if self.kind() == "QUOTE":
            self.quoted(out)
        else:
            self.unquoted(out)
        out.value = "".join(p.text if p.kind == "literal" else "" for p in out.parts)
        return out

    def quoted(self, out: Attribute) -> None:
        q = self.t[self.i]
        out.quote = "double" if q[1] == '"' else "single"
        self.i += 1
        lit: list[str] = []

        def flush() -> None:
            if lit:
                out.parts.append(Part("literal", "".join(lit)))
                lit.clear()

        while True:
            k = self.kind()
            if k == "ERB_START":
                flush()
                e = self.erb()
                out.parts.append(Part("erb_output" if e.opening.startswith("<%=") else "erb_silent", e.text, e.opening))
            elif k == "QUOTE" and self.t[self.i][1] == q[1]:
                self.i += 1
                break
            elif k == "EOF" or (k in ("HTML_TAG_END", "HTML_TAG_SELF_CLOSE") and bisect.bisect(self.quotes[q[1]], self.i) == len(self.quotes[q[1]])):
                self.error("UnclosedQuoteError", f"Attribute value opened with {q[1]} at ({q[4]}:{q[5]}) was never closed.", q[4], q[5])
                break
            else:
                lit.append(self.t[self.i][1])
                self.i += 1
        flush()

    def unquoted(self, out: Attribute) -> None:
        if self.kind() == "ERB_START":
            e = self.erb()
            out.parts.append(Part("erb_output" if e.opening.startswith("<%=") else "erb_silent", e.text, e.opening))
        elif self.kind() == "IDENTIFIER":
            out.parts.append(Part("literal", self.t[self.i][1]))
            self.i += 1
        else:
            x = self.t[self.i]
            self.error("UnexpectedError", f"Unexpected token. Expected: identifier or quote, found: {x[1]}.", x[4], x[5])
            self.i += 1

    # -- embedded control flow
    def grouped(self, flat: list[Item]) -> list[Item]:
        """Fold control tags and what lies between them into blocks with branches."""
        root: list[Item] = []
        stack: list[Item] = []

        def here() -> list[Item]:
            return stack[-1].branches[-1] if stack else root

        for item in flat:
            c = item.control if item.kind == "erb" else ""
            if c in OPENERS:
                item.kind = "block"
                item.branches = [[]]
                item.heads = [item]
                here().append(item)
                stack.append(item)
            elif c in CONTINUES:
                if stack and stack[-1].control in CONTINUES[c]:
                    stack[-1].branches.append([])
                    stack[-1].heads.append(item)
                else:
                    self.error("ERBControlFlowScopeError", f"`<% {c} %>` appears outside its control flow block.", item.line, item.column)
                    here().append(item)
            elif c == "end":
                if stack:
                    b = stack.pop()
                    b.has_end = True
                    b.heads.append(item)
                    b.end = item.end
                else:
                    self.error("ERBControlFlowScopeError", "`<% end %>` appears outside its control flow block.", item.line, item.column)
                    here().append(item)
            else:
                here().append(item)
        for b in stack:
            self.error("MissingERBEndTagError", f"`<% {b.control} %>` started here but never closed with an end tag.", b.line, b.column)
        return root

    # -- tag matching
    def matched(self, items: list[Item]) -> list[Item]:
        """Elements from the open and close tags of lists of siblings, without recursion on depth.

        A close tag's partner depends on the tags of its name between the two
        alone, so one pass finds all partners, and a body is a range of its
        list: a partner beyond the range is none.
        """
        out: list[Item] = []
        lists: list[tuple[list[Item], list[Item]]] = [(items, out)]
        work: list[tuple[int, int, list[Item]]] = []
        todo: list[Item] = []
        partner: dict[int, int] = {}
        while work or lists:
            if not work:
                todo, made = lists.pop()
                partner = _partners(todo)
                work = [(0, len(todo), made)]
            k, stop_at, into = work.pop()
            while k < stop_at:
                x = todo[k]
                if x.kind == "block":
                    for n, part in enumerate(x.branches):
                        x.branches[n] = []
                        lists.append((part, x.branches[n]))
                    into.append(x)
                elif x.kind == "close":
                    if x.tag in VOID:
                        self.error("VoidElementClosingTagError", f"`{x.raw}` is a void element and should not be used as a closing tag.", x.line, x.column)
                    else:
                        self.error("MissingOpeningTagError", f"Found closing tag `</{x.raw}>` at ({x.line}:{x.column}) without a matching opening tag in the same scope.", x.line, x.column)
                    x.kind = "stray_close"
                    into.append(x)
                elif x.kind != "open":
                    into.append(x)
                elif _single(x):
                    x.kind = "element"
                    x.close = "void" if x.tag in VOID else "self"
                    into.append(x)
                else:
                    end = partner.get(k, stop_at)
                    if end < stop_at:
                        self._element(x, k + 1, end, "tag", work, into)
                        x.end, x.close_raw = todo[end].end, todo[end].raw
                        x.text = todo[end].tag_space
                        k = end
                    elif x.tag in OPTIONAL_END:
                        stop = k + 1
                        while stop < stop_at and not (todo[stop].kind == "open" and todo[stop].tag in CLOSED_BY[x.tag]) and not (todo[stop].kind == "close" and todo[stop].tag != x.tag):
                            stop += 1
                        if stop > k + 1:
                            if self.options.strict:
                                self.error("OmittedClosingTagError", f"Element `<{x.raw}>` at ({x.line}:{x.column}) has its closing tag omitted.", x.line, x.column)
                            self._element(x, k + 1, stop, "omitted", work, into)
                            x.end = todo[stop - 1].end
                            k = stop - 1
                        else:
                            self._missing(x, into)
                    else:
                        self._missing(x, into)
                k += 1
        return out

    def _element(self, x: Item, first: int, end: int, close: str, work: list, into: list[Item]) -> None:
        x.kind, x.close, x.children = "element", close, []
        if first < end:
            work.append((first, end, x.children))
        into.append(x)

    def _missing(self, x: Item, into: list[Item]) -> None:
        self.error("MissingClosingTagError", f"Opening tag `<{x.raw}>` at ({x.line}:{x.column}) doesn't have a matching closing tag `</{x.raw}>` in the same scope.", x.line, x.column)
        x.kind, x.close = "element", "missing"
        into.append(x)

    def tree(self) -> list[Item]:
        flat = self.flat()
        if self.options.analyze:
            flat = self.grouped(flat)
        return self.matched(flat)


#: Tokens that are always text between tags.
PLAIN = frozenset(
    "IDENTIFIER WHITESPACE NEWLINE NBSP CHARACTER UNDERSCORE COLON AT SEMICOLON AMPERSAND EXCLAMATION EQUALS TEXT PERCENT SLASH DASH QUOTE BACKTICK BACKSLASH LT HTML_TAG_END HTML_TAG_SELF_CLOSE".split()
)
OPENERS = frozenset(("if", "unless", "case", "case_match", "while", "until", "for", "begin", "block"))
CONTINUES = {
    "elsif": ("if",),
    "else": ("if", "unless", "case", "case_match", "begin", "block"),
    "when": ("case",),
    "in": ("case", "case_match"),
    "rescue": ("begin", "block"),
    "ensure": ("begin", "block"),
}


def _single(x: Item) -> bool:
    return x.closing == "/>" or x.tag in VOID


def _partners(items: list[Item]) -> dict[int, int]:
    """For each open tag the first close tag at depth 0, counting tags of the same name only: a stack for each name."""
    out: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for k, x in enumerate(items):
        if x.kind == "open" and not _single(x):
            stacks.setdefault(x.tag, []).append(k)
        elif x.kind == "close" and (stack := stacks.get(x.tag)):
            out[stack.pop()] = k
    return out


#: Behind a line's end, what begins anything but text.
_CUT = re.compile(r"(?<=\n)(?=<(?:[A-Za-z%]|/[A-Za-z_]|!--))")
#: Longer pieces are not tried alone.
MAX_PIECE = 512


def stands_alone(piece: str) -> bool:
    """Whether ``piece``, which ends behind a line's end, parses alike wherever it stands at the top of a document.

    All it opens it closes, and all it closes it has opened; elements with an omitted close tag lie within others.
    """
    p = Parser(piece, Options())
    tree = p.tree()
    return not p.cut_off and all(e[0] == "OmittedClosingTagError" for e in p.errors) and all(x.close != "omitted" for x in tree)


def pieces(source: str, alone: dict[str, bool]) -> list[str]:
    """``source`` in pieces whose parses, one behind the other, are its parse.

    Only the last piece may fail to stand alone.  ``alone`` remembers what was tried.
    """
    parts = _CUT.split(source)
    for k, part in enumerate(parts[:-1]):
        if (ok := alone.get(part)) is None:
            ok = len(part) <= MAX_PIECE and stands_alone(part)
            if len(part) <= MAX_PIECE:
                alone[part] = ok
        if not ok:
            return [*parts[:k], "".join(parts[k:])]
    return parts


def parse(source: str | None, options: Options | None = None) -> list[dict]:
    """Rows of a document: nodes (kind node), attributes (attr), embedded tags (erb) and errors (error)."""
    p = Parser(source or "", options or Options())
    tree = p.tree()
    heard = _heard(tree)
    rows: list[dict] = []
    ids = iter(range(1, 1 << 60))
    # explicit stack of (item, parent, index, depth, ancestors, branch path)
    work = [(x, 0, n, 1, [], []) for n, x in reversed(list(enumerate(tree)))]
    emb = 0

    def embedded(x: Item, node: int, where: str, ancestors: list[str]) -> None:
        nonlocal emb
        emb += 1
        rows.append({"kind": "erb", "node_id": node, "pos": emb, "opening": x.opening, "content": x.text if x.kind != "element" else "", "closing": x.closing, "control": x.control,
                     "type": where, "line": x.line, "column": x.column, "range_from": x.start, "range_to": x.end, "ancestors": ancestors})

    while work:
        x, parent, index, depth, ancestors, branch = work.pop()
        node = next(ids)
        kind = x.kind
        content = x.text if kind in ("text", "literal", "comment", "doctype", "cdata", "xml_declaration", "processing_instruction", "erb", "block") else ""
        row = {"kind": "node", "node_id": node, "parent_id": parent, "pos": index, "depth": depth, "type": kind, "tag": x.tag, "raw": x.raw, "content": content, "opening": x.opening,
               "closing": x.closing, "control": x.control, "close": x.close, "close_raw": x.close_raw, "space": x.tag_space, "close_space": x.text if kind == "element" and x.close == "tag" else "",
               "line": x.line, "column": x.column, "range_from": x.start, "range_to": x.end, "ancestors": ancestors, "branch": branch}
        if kind == "element":
            row |= _summary(x, id(x) in heard)
        elif kind == "block":
            row["name"] = "end" if x.has_end else None
            row["child_tags"] = ["empty" if all(c.kind == "text" and not c.text.strip() for c in part) else "full" for part in x.branches]
        rows.append(row)
        if kind in ("erb", "block"):
            embedded(x, node, "content", ancestors)
            for h in x.heads[1:]:
                embedded(h, node, "content", ancestors)
        inner = [*ancestors[1 - MAX_ANCESTORS :], x.tag] if kind == "element" else ancestors
        for e in x.erb:
            embedded(e, node, "tag" if kind == "element" else kind, inner)
        for n, a in enumerate(x.attrs):
            rows.append({"kind": "attr", "node_id": node, "pos": n, "tag": x.tag, "name": a.name, "raw": a.raw, "value": a.value, "quote": a.quote, "equals": a.equals,
                         "parts": [(q.kind, q.text, q.opening) for q in a.parts], "name_parts": [(q.kind, q.text, q.opening) for q in a.name_parts], "line": a.line, "column": a.column,
                         "ancestors": ancestors, "branch": [*branch, *a.branch]})
            for q in (*a.name_parts, *a.parts):
                if q.kind != "literal":
                    emb += 1
                    rows.append({"kind": "erb", "node_id": node, "pos": emb, "opening": q.opening, "content": q.text, "closing": "%>", "control": control_of(q.opening, q.text),
                                 "type": "attribute", "name": a.name, "line": a.line, "column": a.column, "ancestors": inner})
        kids = [(c, branch) for c in x.children]
        for n, part in enumerate(x.branches):
            kids += [(c, [*branch, f"{node}:{n}"]) for c in part]
        work += [(c, node, n, depth + 1, inner, b) for n, (c, b) in reversed(list(enumerate(kids)))]
    for n, (name, message, line, column) in enumerate(p.reported()):
        rows.append({"kind": "error", "pos": n, "name": name, "message": message, "line": line, "column": column})
    return rows


def _summary(x: Item, accessible: bool) -> dict:
    """What rules ask of an element: its attributes by name (the first of a name counts), direct text and children."""
    attr: dict[str, str | None] = {}
    for a in x.attrs:
        if a.name and a.name not in attr:
            attr[a.name] = a.value
    return {
        "attr": list(attr.items()),
        "dynamic": sorted({a.name for a in x.attrs if any(q.kind != "literal" for q in a.parts)}),
        "direct_text": "".join(c.text for c in x.children if c.kind in ("text", "literal")),
        "child_tags": [c.tag for c in x.children if c.kind == "element"],
        "accessible": accessible,
    }


def _heard(tree: list[Item]) -> set[int]:
    """Ids of the items in which text or output stands, outside of hidden children: children before their parents."""
    order: list[tuple[Item, Item | None]] = []
    todo: list[tuple[Item, Item | None]] = [(x, None) for x in tree]
    while todo:
        x, up = todo.pop()
        order.append((x, up))
        todo += [(c, x) for c in x.children]
        for part in x.branches:
            todo += [(c, x) for c in part]
    out: set[int] = set()
    for x, up in reversed(order):
        if up is None or id(up) in out:
            continue
        said = id(x) in out
        if x.kind in ("text", "literal"):
            said = bool(x.text.strip())
        elif x.kind == "erb":
            said = said or x.opening.startswith("<%=")
        elif x.kind == "element":
            names = {a.name: a.value for a in x.attrs}
            said = names.get("aria-hidden") != "true" and (said or bool(names.get("aria-label")) or (x.tag == "img" and bool(names.get("alt"))))
        if said:
            out.add(id(up))
    return out
