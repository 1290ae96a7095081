"""A small reader of the Ruby inside embedded tags: control keywords, calls, literals.

It knows strings, symbols, comments and brackets, not the whole grammar; rules
that depend on it are approximate where Ruby is unusual.
"""

from __future__ import annotations

import re

_STRIP = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|(?<![\w)\]])/(?:\\.|[^/\\\n])+/|#[^\n]*", re.S)
_WORD = re.compile(r"(?<![\w.:@$?])(?:if|unless|case|while|until|for|begin|def|class|module|do|end)\b(?![:?])")
_LEAD = re.compile(r"\s*(elsif|else|when|in|rescue|ensure|end|if|unless|case|while|until|for|begin)\b(?![:?.(]?=[^=])")
_BLOCK = re.compile(r"(?:\bdo\s*(?:\|[^|]*\|)?|\{\s*(?:\|[^|]*\|)?)\s*$")


def code_of(content: str) -> str:
    """Content with strings, patterns and comments blanked."""
    return _STRIP.sub(lambda m: " " if m.group()[0] == "#" else m.group()[0] * 2, content)


def control_of(opening: str, content: str) -> str:
    """What an embedded tag does to control flow; empty for plain code, output and comments.

    A complete expression (``x if y``, or a block closed in the same tag) is no
    control flow.
    """
    if opening.startswith(("<%#", "<%%", "<%graphql")):
        return ""
    code = code_of(content).strip()
    if not code:
        return ""
    m = _LEAD.match(code)
    lead = m.group(1) if m else ""
    if lead in ("elsif", "else", "when", "in", "rescue", "ensure"):
        return lead
    if lead == "end" or re.match(r"\}\s*\)?\s*$", code):
        return "end"
    opened = 0
    for w in _WORD.finditer(code):
        k = w.group()
        if k == "end":
            opened -= 1
        elif k in ("if", "unless", "while", "until"):
            before = code[: w.start()].rstrip()
            if not before or before[-1] in "=(;\n,[{|&" or before.endswith(("then", "do")):
                opened += 1
        elif k != "do" or not re.search(r"\b(?:while|until|for)\b[^\n;]*$", code[: w.start()]):
            opened += 1
    if opened <= 0 and not (_BLOCK.search(code) and code.count("{") > code.count("}")):
        return "yield" if re.match(r"yield\b", code) else ""
    if lead:
        return "case_match" if lead == "case" and re.search(r"\n\s*in\b", code) else lead
    return "block"


