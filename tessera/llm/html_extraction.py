"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from templates.  A token is an element's opening with
the path of block elements around it (its role), or a whole text block at its
path.  Tokens with the same occurrence vector over the host's pages form an
equivalence class; vectors are compared by a commutative hash of (page, count),
so classes come from one aggregation, whatever a host's size.  Classes that are
frequent and large enough, whose members are nested in one another's paths below
one element, make up the host's template, and so do others that lie in elements
of these on as many pages or more; all text blocks in them are template text.
What remains are slots.  A slot is main text if it lies in the template's
content container and in no menu, header, footer, sidebar, notice, advert, form
or comment section.  A page that has nothing but template text in its content
is taken as a copy of others, and keeps it.

A host's template is a short list of container paths and text hashes.  It is
joined to the pages by host: by broadcast where its measured size allows, else
by a salted shuffle that spreads a large host over many tasks.

A null html is an empty page, and empty pages count in no host; a page without a host, or the only one of its host,
is read by its own structure.  Very long pages are handled whole.  Repeated
rows are pages of their own; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._graph import lookup
from tessera.llm._io import Batches, arrow_schema, batch, columns
from tessera.llm.url_filter import host_and_path
from tessera.session import checkpoint

#: Least pages and share of the host's pages that a class of the template covers, and least tokens in it.
MIN_PAGES, MIN_SHARE, MIN_SIZE = 3, 0.5, 3
#: Templates are broadcast up to this many characters in all.
BROADCAST_CHARS = 8 << 20
SALTS = 32
_FLUSH = 100_000

# Elements and naming words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button datalist noframes".split())
SKIP = frozenset("head nav menu footer aside form fieldset dialog".split())
SKIP_WORDS = frozenset(
    "nav navbar navigation menu masthead footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup form login search share sharing social related recommended breadcrumb breadcrumbs pagination pager "
    "comment comments commentlist discussion replies respond disqus copyright legal disclaimer toolbar skip "
    "site-nav main-nav main-menu site-navigation main-navigation nav-menu site-footer page-footer main-footer cookie-banner cookie-notice cookie-consent skip-link social-share share-buttons "
    "related-posts related-articles comment-list comments-area comment-form search-form login-form".split()
)
HEADER_WORDS = frozenset("header topbar site-header page-header".split())
CONTENT_WORDS = frozenset("article content main post entry story article-content article-body entry-content post-content post-body page-content main-content story-body".split())
#: Elements that no naming word makes boilerplate; elements whose raw text ends only at their closing tag or the page's end.
KEPT = frozenset("html body main article".split())
SWALLOW = frozenset("script style textarea".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTRS = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")
#: Elements that belong to the main text where they lie in a container around it, and not deeper.
DIRECT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())


class Node:
    """An open element: tag, path, rank as a content container, and what calls it boilerplate: its tag, its names, or that it heads a page (1 by name, 2 by tag).

    ``_settle`` adds whether it is boilerplate, and whether it is or lies in a content container.
    """

    __slots__ = ("tag", "path", "up", "rank", "by_tag", "by_name", "head", "cut", "dark", "chars", "holds", "skip", "inside")

    def __init__(self, tag: str, path: str, up: Node | None = None, rank: int = 0, by_tag: bool = False, by_name: bool = False, head: int = 0):
        self.tag, self.path, self.up, self.rank, self.by_tag, self.by_name, self.head = tag, path, up, rank, by_tag, by_name, head
        self.cut = self.dark = self.skip = False
        self.chars = self.holds = self.inside = 0


def _open(tag: str, rest: str, up: Node) -> Node:
    names: set[str] = set()
    label, role = tag, ""
    if "=" in rest:
        for m in _ATTRS.finditer(rest):
            if (key := m[1].lower()) in ("class", "id", "role"):
                value = (m[2] or m[3] or m[4] or "").lower()
                names.update(value.split())
                role = value if key == "role" else role
        if words := {w for n in names for w in _WORDS.findall(n)}:
            label = tag + "." + ".".join(sorted(words))
    rank = 3 if tag == "article" else 2 if tag == "main" or "main" in role.split() else 1 if names & CONTENT_WORDS and tag in ("div", "section", "td") else 0
    named = names if tag not in KEPT else set()
    head = 0 if rank else 2 if tag == "header" else 1 if named & HEADER_WORDS else 0
    return Node(tag, f"{up.path}/{label}", up, rank, tag in SKIP, bool(named & SKIP_WORDS), head)


def _settle(nodes: list[Node], texts: list[tuple[Node, int]]) -> None:
    """Boilerplate and containers of a page, once all of it is known.  ``nodes`` has parents before children, the root first.

    A name alone makes no boilerplate of an element that holds most of the text
    outside boilerplate tags, nor of one that is or holds a better content
    container than any outside named boilerplate.
    """
    for n in nodes[1:]:
        n.cut = n.up.cut or n.by_tag or (n.head == 2 and not n.up.inside)
        n.inside = max(n.up.inside, 0 if n.cut else n.rank)
        n.by_name = n.by_name or (n.head == 1 and not n.up.inside)
        n.dark = n.up.dark or n.cut or n.by_name
    for n, size in texts:
        if not n.cut:
            n.chars += size
    for n in reversed(nodes[1:]):
        if n.chars and not n.cut:
            n.holds = max(n.holds, n.rank)
        n.up.chars += n.chars
        n.up.holds = max(n.up.holds, n.holds)
    total = nodes[0].chars
    free = max((n.rank for n in nodes if n.chars and not n.dark), default=0)
    for n in nodes[1:]:
        n.skip = n.up.skip or n.cut or (n.by_name and 2 * n.chars <= total and n.holds <= free)
        n.inside = max(n.up.inside, 0 if n.skip else n.rank)


def _closings(html: str, tag: str) -> dict[int, int]:
    """Where each opening of ``tag`` that is closed starts, and where its closing tag ends."""
    found, open_ = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>", html, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append(m.start())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def parse(html: str) -> Iterator[tuple[str, str | None, Node]]:
    """Openings ``(path, None, element)`` and text blocks ``(path, text, element)`` in page order."""
    root = Node("", "")
    nodes, found = [root], []
    stack, text, at = [root], [], 0
    closings: dict[str, dict[int, int]] = {}

    def block(here: Node) -> None:
        got = " ".join(unescape("".join(text)).split())
        text.clear()
        if got:
            found.append((here.path, got, here))

    while True:
        m = _TOKEN.search(html, at)
        text.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = max(m.end(), at + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        here = stack[-1]
        if tag in RAW and not m[1]:
            if m[3].endswith("/"):
                continue
            if tag in SWALLOW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            else:
                if tag not in closings:
                    closings[tag] = _closings(html, tag)
                at = max(at, closings[tag].get(m.start(), at))
            continue
        if tag in INLINE:
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag not in INLINE:
                        break
                    if stack[k].tag == tag:
                        if stack[k].by_name or stack[k].head:
                            block(here)
                        del stack[k:]
                        break
            elif "=" in m[3]:
                inner = _open(tag, m[3], here)
                if inner.by_name or inner.head:
                    block(here)
                node = Node(tag, here.path, here, by_name=inner.by_name, head=inner.head)
                nodes.append(node)
                stack.append(node)
            continue
        block(here)
        if tag in VOID:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        while stack[-1].tag in INLINE or stack[-1].tag == "p" or stack[-1].tag == tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            stack.pop()
        node = _open(tag, m[3], stack[-1])
        nodes.append(node)
        stack.append(node)
        found.append((node.path, None, node))
    block(stack[-1])
    _settle(nodes, [(n, len(t)) for _, t, n in found if t is not None])
    yield from found


def _text_key(path: str, text: str) -> str:
    return f"#{xxhash.xxh64_hexdigest(path + chr(0) + text)}"


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _tokens(pages: DataFrame) -> DataFrame:
    """(host, token, path, vector, pages, chars, rank): vectors added up within a task before the shuffle; ``path`` is a text block's."""

    def run(batches: Batches) -> Batches:
        found: dict[tuple[str, str], list] = {}

        def flush() -> pa.RecordBatch:
            cols = list(zip(*[(h, t, p, _signed(v), n, c, r) for (h, t), (v, n, c, r, p) in found.items()], strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "token", "path", "vector", "pages", "chars", "rank"]
            )

        for b in batches:
            for host, page, html in zip(*(b.column(n).to_pylist() for n in ("host", "page", "html")), strict=True):
                once: dict[str, list] = {}
                for path, text, node in parse(html or ""):
                    if text is None:
                        once.setdefault(path, [0, 0, node.inside * 2 + node.skip, None])[0] += 1
                    elif not node.skip:
                        once.setdefault(path, [0, 0, node.inside * 2 + node.skip, None])[1] += len(text)
                        once.setdefault(_text_key(path, text), [0, 0, node.inside * 2 + node.skip, path])[0] += 1
                if not once:
                    continue
                once.setdefault("", [0, 0, 0, None])[0] = 1
                for token, (n, chars, rank, path) in once.items():
                    mine = found.setdefault((host, token), [0, 0, 0, rank, path])
                    mine[0] += xxhash.xxh64_intdigest(str(page), seed=n)
                    mine[1] += 1
                    mine[2] += chars
                if len(found) > _FLUSH:
                    yield flush()
        if found:
            yield flush()

    schema = "host string, token string, path string, vector long, pages long, chars long, rank long"
    made = pages.mapInArrow(run, schema)
    whole = F.expr("pmod(sum(cast(vector as decimal(38,0))), 18446744073709551616BD)")
    return made.groupBy("host", "token").agg(
        whole.alias("vector"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.max("rank").alias("rank"), F.first("path").alias("path")
    )


def _main_rank(sizes: dict[int, int]) -> int:
    """Of the ranks of containers, with the characters in them, the highest that no lower one exceeds by more than twice; 0 without any."""
    for r in sorted((r for r in sizes if r), reverse=True):
        if all(2 * sizes[r] >= n for q, n in sizes.items() if 0 < q < r):
            return r
    return 0


def _containers(rows: list[tuple[str, int, int, int]], n: int) -> list[str]:
    """Content container paths among template roles (path, pages, chars, rank); by their names, else by where the text is."""
    sizes: dict[int, int] = {}
    for r in rows:
        if not r[3] & 1:
            sizes[r[3] // 2] = sizes.get(r[3] // 2, 0) + r[2]
    named = _main_rank(sizes)
    if named:
        best = [r[0] for r in rows if r[3] // 2 == named and not r[3] & 1]
        return sorted(p for p in best if not any(p != q and p.startswith(q + "/") for q in best))
    free = [r for r in rows if not r[3] & 1 and r[0]]
    total = sum(r[2] for r in free)
    inside = {r[0]: sum(q[2] for q in free if q[0] == r[0] or q[0].startswith(r[0] + "/")) for r in free}
    deep = [p for p, c in inside.items() if total and c * 5 >= total * 3 and p.rsplit("/", 1)[-1].split(".")[0] in ("div", "section", "td", "main", "article", "body")]
    return [max(deep, key=lambda p: (p.count("/"), p))] if deep else []


def _under(path: str, top: str) -> bool:
    return not top or path == top or path.startswith(top + "/")


def _template(rows: list[tuple[str, str, object, int]]) -> set[str]:
    """Members of a host's valid classes, from its frequent tokens (token, path, vector, pages)."""
    classes: dict[object, list[tuple[str, str, int]]] = {}
    for token, path, vector, pages in rows:
        classes.setdefault(vector, []).append((token, path, pages))

    def up(path: str) -> str:
        return path.rpartition("/")[0]

    def nested(members: list[tuple[str, str, int]]) -> bool:
        """Whether the members that lie in no other member lie in one element."""
        own = {p for t, p, _ in members if t == p}
        slots = set()
        for token, path, _ in members:
            at = top = up(path) if token == path else path
            while at and at not in own:
                at = up(at)
            if at not in own or token == "":
                slots.add(top)
        return len(slots) <= 1

    valid = {v for v, m in classes.items() if len(m) >= MIN_SIZE and nested(m)}
    # elements of these, and on how many pages each stands: in them, on no more pages, lie the smaller classes
    held = {p: n for v in valid for t, p, n in classes[v] if t == p}

    def inside(path: str, pages: int) -> bool:
        while path and held.get(path, 0) < pages:
            path = up(path)
        return held.get(path, 0) >= pages

    valid |= {v for v, m in classes.items() if all(inside(p if t != p else up(p), n) for t, p, n in m)}
    return {t for v in valid for t, *_ in classes[v]}


def templates(pages: DataFrame) -> DataFrame:
    """(host, containers, constants) of every host with enough pages, from ``pages(host, page, html)``; an empty host is none."""
    tokens = checkpoint(_tokens(pages.where("host != ''")))
    hosts = tokens.where("token = ''").select("host", F.col("pages").alias("all_pages"))
    # a host may hold most tokens: they are spread before they meet its row
    frequent = lookup(tokens, "host", hosts).where(F.col("pages") >= F.greatest(F.lit(MIN_PAGES), F.col("all_pages") * MIN_SHARE))

    # a token on half of a host's pages or more: all of them are at most as many as two of its pages have
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        r = rows.to_pylist()
        members = _template([(x["token"], x["token"] if x["path"] is None else x["path"], x["vector"], x["pages"]) for x in r])
        roles = [(x["token"], x["pages"], x["chars"], x["rank"]) for x in r if x["path"] is None and (x["token"] in members or x["rank"] > 1)]
        return pa.table(
            {
                "host": pa.array([key[0].as_py()], pa.string()),
                "containers": pa.array([_containers(roles, r[0]["all_pages"])], pa.list_(pa.string())),
                "constants": pa.array([sorted(x["token"] for x in r if x["path"] is not None and x["token"] in members)], pa.list_(pa.string())),
            }
        )

    return frequent.select("host", "token", "path", "vector", "pages", "chars", "rank", "all_pages").groupBy("host").applyInArrow(build, "host string, containers array<string>, constants array<string>")


def main_text(html: str, containers: list[str] | None, constants: list[str] | None) -> str:
    """Slots of the content container, joined by one space.

    A page that lacks its host's container, or has more text in its own named
    containers outside, falls back to its own: article elements, then main, then
    containers by name, unless a lower kind holds more than twice the text, then
    the whole body.  Paragraphs and headings directly in a container around the
    chosen text belong to it.
    """
    fixed = frozenset(constants or ())
    blocks = [(p, t, n) for p, t, n in parse(html) if t is not None and not n.skip]
    sizes: dict[int, int] = {}
    for _, t, n in blocks:
        sizes[n.inside] = sizes.get(n.inside, 0) + len(t)
    top = _main_rank(sizes)
    named = [k for k, (_, _, n) in enumerate(blocks) if not top or any(e.rank == top for e in _above(n))]
    content = [k for k, (p, _, _) in enumerate(blocks) if any(_under(p, c) for c in containers or ())]
    taken = set(content)
    if not content or (top and sum(len(blocks[k][1]) for k in named if k not in taken) > sum(len(blocks[k][1]) for k in content)):
        content = named
    around = {id(e) for n in {id(blocks[k][2]): blocks[k][2] for k in content}.values() for e in _above(n) if e.rank}
    chosen = set(content)
    for k, (_, _, n) in enumerate(blocks):
        while n.tag in INLINE:
            n = n.up
        if id(n) in around or (n.tag in DIRECT and id(n.up) in around):
            chosen.add(k)
    found = [blocks[k][:2] for k in sorted(chosen)]
    slots = [t for p, t in found if _text_key(p, t) not in fixed] if fixed else []
    return " ".join(slots or [t for _, t in found])


def _above(n: Node | None) -> Iterator[Node]:
    while n is not None:
        yield n
        n = n.up


_ARROW = arrow_schema(page_id=pa.int64(), url=pa.string(), text=pa.string(), n_chars=pa.int64())


def extract(pages: DataFrame) -> DataFrame:
    """Contract rows: page_id, url, text, n_chars."""
    pages = columns(pages, "page_id", "url", "html")
    host = host_and_path(F.col("url"))[0]
    found = checkpoint(templates(pages.select(host.alias("host"), F.xxhash64("page_id", "url").alias("page"), "html")))
    size = found.agg(F.sum(F.length("host") + F.length(F.array_join("containers", "")) + 17 * F.size("constants"))).first()[0] or 0
    left = pages.withColumn("host", host)
    if size <= BROADCAST_CHARS:
        joined = left.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Batches) -> Batches:
        for b in batches:
            text = [main_text(h or "", c, k) for h, c, k in zip(*(b.column(n).to_pylist() for n in ("html", "containers", "constants")), strict=True)]
            yield batch(_ARROW, page_id=b.column("page_id"), url=b.column("url"), text=text, n_chars=[len(t) for t in text])

    return joined.select("page_id", "url", "html", "containers", "constants").mapInArrow(run, "page_id long, url string, text string, n_chars long")
