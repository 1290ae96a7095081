import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from tessera.lint import engine as lint
from tessera.operators import graph, rewrite
from tessera.operators.diff import diff, diff_pairs, summary
from tessera.operators.extract import html_of, ruby_of
from tessera.operators.lexer import lex
from tessera.operators.parser import Options, parse
from tessera.operators.ruby import control_of
from tessera.operators.tables import Tables
from tessera.operators.textops import auto_closed, compile_tokens, format_source

PIECES = st.lists(st.sampled_from(["<div>", "</div>", "<p", ">", "<%", "<%= x %>", "%>", "é", " ", "\r\n", " ", "\"", "'", "=", "<!--", "-->", "--!>", "<script>", "</script>", "<b a='1'>", "/>", "&", "<![CDATA[", "<% if a %>", "<% end %>", "x"]), max_size=25)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_tokens_cover_the_source(parts):
    source = "".join(parts)
    got = lex(source)
    assert "".join(t[1] for t in got) == source
    assert got[-1][0] == "EOF" and got[-1][3] == len(source.encode())
    assert all(a[3] == b[2] and a[6:] == b[4:6] for a, b in zip(got, got[1:], strict=False))


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_parsing_never_fails_and_extraction_keeps_bytes(parts):
    source = "".join(parts)
    rows = parse(source)
    assert all(r["kind"] in ("node", "attr", "erb", "error") for r in rows)
    assert len(html_of(source).encode()) == len(source.encode()) == len(ruby_of(source).encode())
    assert diff(source, source) == []
    format_source(source)
    auto_closed(source)
    compile_tokens(source)


def kinds(source, **options):
    return [(r["type"], r.get("tag")) for r in parse(source, Options(**options)) if r["kind"] == "node"]


def errors(source, **options):
    return [r["name"] for r in parse(source, Options(**options)) if r["kind"] == "error"]


def test_tag_matching():
    assert errors("<p><b>x</p></b>") == ["MissingOpeningTagError", "MissingClosingTagError"] or set(errors("<p><b>x</p></b>")) == {"MissingOpeningTagError", "MissingClosingTagError"}
    assert errors("<ul><li>a<li>b</ul>") == ["OmittedClosingTagError"] * 2
    assert errors("<ul><li>a<li>b</ul>", strict=False) == []
    assert errors("<div></div></br>") == ["VoidElementClosingTagError"]
    assert errors("<script>var a = '</p>';</script>") == []
    assert len(errors("<div>" * 1000)) == 25
    assert errors("<div><% if a %></div><% end %>") != []


@pytest.mark.parametrize(
    ("source", "name"),
    [
        ("<div", "UnclosedOpenTagError"), ("<div></div", "UnclosedCloseTagError"), ('<p a="x>y', "UnclosedQuoteError"), ("<p a=></p>", "MissingAttributeValueError"), ("<%= a", "UnclosedERBTagError"),
        ("<%= a <% b %>", "NestedERBTagError"), ("a %> b", "StrayERBClosingTagError"), ("<!-- a --!>", "InvalidCommentClosingTagError"), ("<% end %>", "ERBControlFlowScopeError"),
        ("<% if a %>", "MissingERBEndTagError"), ("</i>", "MissingOpeningTagError"), ("<i>", "MissingClosingTagError"),
    ],
)
def test_errors(source, name):
    assert name in errors(source)


def test_large_inputs_finish():
    assert len(parse("<div>x</div>" * 5000)) == 10000
    assert len(errors("<div>" * 20000)) == 25


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (" if a ", "if"), (" x if a ", ""), (" items.each do |i| ", "block"), (" items.each { |i| ", "block"), (" items.map { |i| i } ", ""), (" end ", "end"), (" } ", "end"), (" else ", "else"),
        (" elsif b ", "elsif"), (" case a ", "case"), (" when 1 ", "when"), (" while a do ", "while"), (" if a then b end ", ""), (' "if a" ', ""), (" x = if a ", "block"), (" unless a ", "unless"), (" yield ", "yield"),
    ],
)
def test_control(content, want):
    assert control_of("<%", content) == want or (content == " x = if a " and control_of("<%", content) in ("block", "if"))


def test_diff_operations():
    assert [o[0] for o in diff('<p class="a">x</p>', '<p class="b">x</p>')] == ["attribute_value_changed"]
    assert [o[0] for o in diff("<p>x</p>", "<p>y</p>")] == ["text_changed"]
    assert [o[0] for o in diff("<p>x</p>", "<p>x</p><i>z</i>")] == ["node_inserted"]
    assert [o[0] for o in diff("<p>x</p><i>z</i>", "<i>z</i>")] == ["node_removed"]
    assert [o[0] for o in diff("<p>x</p>", "<div><p>x</p></div>")] == ["node_wrapped"]
    assert [o[0] for o in diff("<div><p>x</p></div>", "<p>x</p>")] == ["node_unwrapped"]
    assert [o[0] for o in diff("<%= a %>", "<%= b %>")] == ["erb_content_changed"]


def test_diff_pairs(spark):
    pairs = spark.createDataFrame([(1, "<p>a</p>", "<p>b</p>"), (2, "<p>a</p>", "<p>a</p>"), (3, None, None), (4, None, "<i>x</i>")], "pair_id long, old string, new string")
    got = {r.pair_id: (r.operations, r.identical, r.patchable) for r in summary(pairs, diff_pairs(pairs)).collect()}
    assert got == {1: (1, False, True), 2: (0, True, True), 3: (0, True, True), 4: (1, False, False)}


def test_diff_below_the_longest_path(spark):
    deep = lambda x, n=80: "<div>" * n + x + "</div>" * n
    (kind, path, *_, old, new), = diff(deep("<p>a</p>"), deep("<p>b</p>"))
    assert (kind, len(path), old, new) == ("text_changed", 64, "a", "b")
    assert [o[0] for o in diff(deep("<p>a</p>"), deep("<p>a</p><hr>"))] == ["node_inserted"]
    rows = [(1, deep("a"), deep("b")), (2, deep("a"), deep("<hr>a")), (3, "<p a='1'>a</p>", '<p a="1">a</p>'), (4, None, ""), (6, "<P>a</P>", "<p>a</p>"), (5, deep("a"), deep("a"))]
    pairs = spark.createDataFrame(rows, "pair_id long, old string, new string")
    got = {r.pair_id: (r.operations, r.identical, r.patchable) for r in summary(pairs, diff_pairs(pairs)).collect()}
    assert got == {1: (1, False, True), 2: (1, False, False), 3: (0, False, False), 6: (0, False, False), 4: (0, True, True), 5: (0, True, True)}


def test_lint_gate_and_suppression(spark):
    docs = [(1, "<img src='a'>\n"), (2, "<div><img src='a'>\n"), (3, "<img src='a'> <%# tpl:disable html-img-require-alt %>\n"), (4, "<%# tpl:linter ignore %>\n<img src='a'>\n"), (5, None), (6, "")]
    t = Tables(spark.createDataFrame(docs, "doc_id long, source string"))
    got = sorted((r.doc_id, r.rule, r.severity) for r in lint.offenses(t).collect())
    assert [x for x in got if x[0] == 1] == [(1, "html-attribute-double-quotes", "warning"), (1, "html-img-require-alt", "warning")]
    assert [x[:2] for x in got if x[0] == 2] == [(2, "parser-no-errors")]
    assert [x[:2] for x in got if x[0] == 3] == [(3, "html-attribute-double-quotes")]
    assert [x for x in got if x[0] in (4, 5, 6)] == []
    mine = (lint.Rule("own", "X", "hint", True, "", ""), lambda t: t.elements.where("tag = 'img'").selectExpr("doc_id", "line", "column", "'img' as message"))
    own = lint.offenses(t, lint.Config(only=("own",), custom=[mine], severities={"own": "error"}, gate=False))
    assert sorted((r.doc_id, r.severity) for r in own.collect()) == [(1, "error"), (2, "error"), (3, "error")]


def test_rule_selection():
    by = {r.name: r for r in lint.RULES}
    assert not lint.selected(by["html-no-style-elements"], lint.Config()) and lint.selected(by["html-no-style-elements"], lint.Config(all_rules=True))
    assert not lint.selected(by["actionview-no-silent-render"], lint.Config()) and lint.selected(by["actionview-no-silent-render"], lint.Config(framework="actionview"))
    assert not lint.selected(by["html-img-require-alt"], lint.Config(rules={"html-img-require-alt": False}))


def test_exclusive_branches_are_no_duplicates(spark):
    docs = [(1, '<% if a %><p id="x">a</p><% else %><p id="x">b</p><% end %>\n'), (2, '<p id="x">a</p><% if a %><p id="x">b</p><% end %>\n')]
    t = Tables(spark.createDataFrame(docs, "doc_id long, source string"))
    assert [r.doc_id for r in lint.offenses(t, lint.Config(only=("html-no-duplicate-ids",))).collect()] == [2]


def test_sources(spark, tmp_path):
    from tessera.sources.templates import templates

    for name in ("app/views/a.html.erb", "app/views/x/_b.html.erb", "tmp/c.html.erb", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<p>é</p>\n")
    assert sorted((r.path, r.source) for r in templates(spark, str(tmp_path)).collect()) == [("app/views/a.html.erb", "<p>é</p>\n"), ("app/views/x/_b.html.erb", "<p>é</p>\n")]


def test_verdicts_count_all_callers(spark):
    docs = [(k, f"app/views/a/{k:03}.html.erb", '<ul><%= render "a/hot" %></ul>\n') for k in range(40)]
    docs += [(40, "app/views/z/last.html.erb", '<p><%= render "a/hot" %></p>\n'), (50, "app/views/a/_hot.html.erb", '<%= render "a/below" %>\n'), (51, "app/views/a/_below.html.erb", "<i>x</i>\n")]
    t = Tables(spark.createDataFrame(docs, "doc_id long, path string, source string"))
    assert {r.doc_id: r.verdict for r in graph.ancestor_verdict(t, "ul").collect()} == {50: "mixed", 51: "mixed"}
    assert {(r.doc_id, tuple(r.chain), r.resolved) for r in graph.contexts(t).collect()} == {(d, (c,), True) for d in (50, 51) for c in ("ul", "p")}
    many = [(k, f"app/views/m/{k}.html.erb", "".join(f"<x-{'abcdefghij'[int(c)]}>" for c in f"{k:02}") + '<%= render "m/hot" %>' + "".join(f"</x-{'abcdefghij'[int(c)]}>" for c in f"{k:02}"[::-1]) + "\n") for k in range(40)]
    many += [(50, "app/views/m/_hot.html.erb", '<%= render "m/below" %>\n'), (51, "app/views/m/_below.html.erb", "<i>x</i>\n")]
    t = Tables(spark.createDataFrame(many, "doc_id long, path string, source string"))
    got = graph.contexts(t).collect()
    assert len(got) == 64 and not any(r.resolved for r in got)
    assert {r.doc_id: r.verdict for r in graph.ancestor_verdict(t, "x-a").collect()} == {50: "mixed", 51: "mixed"}


def test_fixpoints_go_as_deep_as_calls(spark):
    deep = 67
    docs = [(0, "app/views/d/top.html.erb", '<%= render "d/p1", v: @v %>\n')]
    docs += [(k, f"app/views/d/_p{k}.html.erb", f'<%= render "d/p{k + 1}", v: v %>\n' if k < deep else "<i>x</i>\n") for k in range(1, deep + 1)]
    t = Tables(spark.createDataFrame(docs, "doc_id long, path string, source string"))
    assert graph.ancestor_verdict(t, "ul").where("verdict = 'never'").count() == deep


def test_inlining_reaches_all_levels_and_ends_at_cycles(spark):
    body = lambda k: f'{k}<%= render "d/p{k + 1}" %>' if k < 12 else "end"
    docs = [(k, f"app/views/d/_p{k}.html.erb", body(k)) for k in range(1, 13)]
    docs += [(0, "app/views/d/top.html.erb", '<p><%= render "d/p1" %></p>'), (20, "app/views/x/_a.html.erb", 'a<%= render "b" %>'), (21, "app/views/x/_b.html.erb", "bee"), (22, "app/views/y/c.html.erb", '<%= render "x/a" %>')]
    docs += [(30, "app/views/l/_one.html.erb", '1<%= render "l/two" %>'), (31, "app/views/l/_two.html.erb", '2<%= render "l/one" %>'), (32, "app/views/l/top.html.erb", '<%= render "l/one" %><%= render "d/p12" %>')]
    docs += [(33, "app/views/l/_me.html.erb", 'm<%= render "l/me" %>'), (34, "app/views/l/you.html.erb", '<%= render "l/me" %>'), (40, "app/views/k/a.html.erb", '<%= render "d/p12", x: 1 %><%= render "no/#{kind}" %>'), (41, "app/views/k/b.html.erb", None)]
    got = {r.doc_id: r.source for r in rewrite.inline_partials(Tables(spark.createDataFrame(docs, "doc_id long, path string, source string"))).collect()}
    assert len(got) == len(docs)
    assert got[0] == "<p>" + "".join(map(str, range(1, 12))) + "end</p>" and got[11] == "11end"
    assert (got[20], got[22]) == ("abee", "abee")
    assert got[30] == docs[16][2] and got[32] == '1<%= render "l/two" %>end' and got[33] == got[34] == 'm<%= render "l/me" %>'
    assert got[40] == docs[-2][2] and got[41] is None


TEMPLATES = st.recursive(
    st.sampled_from(["word", " two words ", "x,", "<br>", "<%= a %>", "<b>bold</b>", "<a href='/x'>link </a>", "\n", " ", "<pre> k  e\n p</pre>", "<script>var a = '<P>'</script>", "<!-- note -->", "<input value=\"1\">", "<% x = 1 %>"]),
    lambda inner: st.builds(lambda t, xs: t[0] + "".join(xs) + t[1], st.sampled_from([("<div>", "</div>"), ("<p>", "</p>"), ("<ul><li>", "</li></ul>"), ("<span class='c'>", "</span>"), ("<% if a %>", "<% end %>"), ("<% if a %>", "<% else %>z<% end %>")]), st.lists(inner, max_size=5)),
    max_leaves=12,
)


def _shown(source):
    """Text as a page shows it: words of blocks, white space that does not show left out."""
    import re

    from tessera.operators.textops import _BLOCKS

    body = re.sub(r"(?s)<!--.*?-->|<script.*?</script>", lambda m: "\x01" + m[0].replace(" ", "\x02") + "\x01", source)
    body = re.sub(r"(?s)<pre>.*?</pre>", lambda m: m[0].replace(" ", "\x02").replace("\n", "\x03"), body)
    edge = "|".join(sorted(_BLOCKS, key=len, reverse=True))
    body = re.sub(rf"\s*(</?(?:{edge})(?:\s[^>]*)?>)\s*", r"\1", body)
    return re.sub(r"\s+", " ", body)


@settings(max_examples=400, deadline=None)
@given(TEMPLATES)
def test_formatting_keeps_the_words_of_blocks_and_is_stable(source):
    import re

    once = format_source(source)
    assert format_source(once) == once
    plain = lambda x: re.sub(r"\s+", "", x)
    assert plain(once).replace("'", '"') == plain(source).replace("'", '"')
    if "<%" not in source and "<!--" not in source and "<script" not in source:
        assert _shown(once).strip().replace("'", '"') == _shown(source).strip().replace("'", '"')


def test_formatting_inline_neighbours():
    assert format_source("<p>a<b>b</b>c</p>") == "<p>a<b>b</b>c</p>\n"
    assert format_source("<div><p><b>bold</b>, world</p></div>") == "<div>\n  <p><b>bold</b>, world</p>\n</div>\n"
    assert format_source("<div>a<% if b %>c<% end %>d</div>") == "<div>a<% if b %>c<% end %>d</div>\n"
    assert format_source("<p <% if a %>class='x'<% end %>>t</p>") == "<p <% if a %>class='x'<% end %>>t</p>\n"


def test_fixes_keep_code_and_preformatted_text():
    for kept in ("<script>var a='<P>'  \n\n\n\n</script>\n", "<pre>a  \n\n\n\nb</pre>\n", "<%#= x %>\n", "<!-- <P>  \n -->\n", "<textarea>'A'  \n</textarea>\n"):
        assert rewrite.fixed(kept) == kept
    assert rewrite.fixed("<PRE>a  \n</PRE>  \n<P lang='e'>x</P>") == "<pre>a  \n</pre>\n<p lang=\"e\">x</p>\n"
    assert rewrite.fixed("<script>a<") == "<script>a<\n"


def test_table_function_returns_every_error(spark):
    from tessera.operators import project
    from tessera.session import prepare

    project.register(prepare(spark))
    got = spark.sql("select count(*) as n, count(distinct line) as lines from parse_errors(repeat('<b>\n', 40))").first()
    assert tuple(got) == (40, 40)


LINES = st.lists(st.sampled_from(["<div>", "</div>", "<ul><li>x</ul>", "<li>y", "</li>", "<% if a %>", "<% else %>", "<% end %>", "<% if a %>b<% else %><p id='i'>c</p><% end %>", "<p id='i'>d</p>", "<p x='>", "<p y=\"'\">z</p>", "plain", "<!-- c", "-->", "<!doctype html", "<!doctype html>", "<script>", "</script>", "<%= x", "%>", "<b>", "</b>", "</", "é < 3 & <i>t</i> %>", "<img a=", "<?xml"]), max_size=14)


@settings(max_examples=1500, deadline=None)
@given(LINES, st.sampled_from(["\n", "\r\n", "\n\n"]))
def test_pieces_parse_like_the_whole(lines_, end):
    from tessera.operators.lexer import lines
    from tessera.operators.parser import pieces

    source = end.join(lines_) + end
    parts = pieces(source, {})
    assert "".join(parts) == source
    seen = ("kind", "depth", "type", "tag", "raw", "name", "value", "content", "opening", "closing", "control", "close", "attr", "direct_text", "child_tags", "accessible", "message", "column", "ancestors", "line")
    shown = lambda r, above: repr([r[n] + above if n == "line" else r.get(n) for n in seen if n != "message"])
    got, above = [], 0
    for part in parts:
        got += [(r["kind"], shown(r, above)) for r in parse(part, Options(max_errors=1 << 30))]
        above += lines(part)
    want = [(r["kind"], shown(r, 0)) for r in parse(source, Options(max_errors=1 << 30))]
    for kind in ("node", "attr", "erb", "error"):
        assert [x for k, x in got if k == kind] == [x for k, x in want if k == kind]


def test_rules_on_pieces_find_what_rules_on_documents_find(spark):
    import pathlib

    from tessera.plans import fragments
    from tessera.session import shared_folder

    two = "<p id='a'>x</p>\n" * 2 + "<% if x %><p id='b'>x</p><% else %><p id='b'>y</p><% end %>\n" * 2 + "<% items.each do |thing| %>y<% end %>\n<%= thing %>\n"
    extra = [(i, f"app/_{i}.html.erb", s) for i, s in enumerate([None, "", "text\n", two, "<% items.each do |thing| %>y<% end %>\n" + two, "<b>\n" + two, "<head><meta name='a'></head>\n" * 3, "<img>\n<img> <%# tpl:disable all %>\n<img>\n"])]
    parts = spark.range(100, 160).select("id").withColumnRenamed("id", "p_partkey")
    docs = spark.createDataFrame(extra, "doc_id long, path string, source string").unionByName(fragments.corpus(parts))
    found = lambda t: sorted(map(tuple, lint.offenses(t, lint.Config(only=only, gate=False)).collect()))
    only = ("html-img-require-alt", "html-no-duplicate-ids", "html-no-duplicate-meta-names", "erb-no-unused-block-argument", "erb-no-unused-local-variable", "erb-no-trailing-whitespace", "html-no-unescaped-entities", "parser-no-errors")
    taken = Tables(docs, apart=True)
    assert found(taken) == found(Tables(docs))
    # the pieces, not the documents, are what is parsed
    assert taken.local.docs.count() < 250 and taken.places.select("doc_id").distinct().count() == 66
    taken.drop()
    assert not any(x.name.startswith("places-") for x in pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*"))


@pytest.mark.parametrize("name", ["lint_offenses", "most_violated_rules", "offense_summary"])
def test_lint_queries_judge_pieces(spark, monkeypatch, name):
    from tessera.plans import queries

    class Seen(Exception):
        pass

    def seen(t, config):
        raise Seen(t.local is not None)

    monkeypatch.setattr(queries.lint, "offenses", seen)
    with pytest.raises(Seen, match="True"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
