"""Short sources and what reading them must give: the document of key k holds shape ``k % n``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Source, and the types of its tokens in order.
TOKENS = [
    ("a b", "IDENTIFIER NBSP IDENTIFIER"),
    ("<%= x %>", "ERB_START ERB_CONTENT ERB_END"),
    ("<%# n -%>", "ERB_START ERB_CONTENT ERB_END"),
    ("<%== r =%>", "ERB_START ERB_CONTENT ERB_END"),
    ("<%- y -%>", "ERB_START ERB_CONTENT ERB_END"),
    ("<%% e %%>", "ERB_START ERB_CONTENT ERB_END"),
    ("<%graphql q %>", "ERB_START ERB_CONTENT ERB_END"),
    ("<!DOCTYPE html>", "HTML_DOCTYPE WHITESPACE IDENTIFIER HTML_TAG_END"),
    ("<?xml v?>", "XML_DECLARATION WHITESPACE IDENTIFIER XML_DECLARATION_END"),
    ("<?php x ?>", "XML_PI_START IDENTIFIER WHITESPACE IDENTIFIER WHITESPACE XML_DECLARATION_END"),
    ("<![CDATA[x]]>", "CDATA_START IDENTIFIER CDATA_END"),
    ("</p >", "HTML_TAG_START_CLOSE IDENTIFIER WHITESPACE HTML_TAG_END"),
    ("<!-- c -->", "HTML_COMMENT_START WHITESPACE IDENTIFIER WHITESPACE HTML_COMMENT_END"),
    ("<!-- d --!>", "HTML_COMMENT_START WHITESPACE IDENTIFIER WHITESPACE HTML_COMMENT_INVALID_END"),
    ("<br/>", "HTML_TAG_START IDENTIFIER HTML_TAG_SELF_CLOSE"),
    ("d@e;f&g!", "IDENTIFIER AT IDENTIFIER SEMICOLON IDENTIFIER AMPERSAND IDENTIFIER EXCLAMATION"),
    ("x=%/-", "IDENTIFIER EQUALS PERCENT SLASH DASH"),
    ("'q' \"r\" `s` \\t", "QUOTE IDENTIFIER QUOTE WHITESPACE QUOTE IDENTIFIER QUOTE WHITESPACE BACKTICK IDENTIFIER BACKTICK WHITESPACE BACKSLASH IDENTIFIER"),
    ("é+{}", "CHARACTER CHARACTER CHARACTER CHARACTER"),
    ("< 1", "LT WHITESPACE IDENTIFIER"),
    ("a\r\n\tb", "IDENTIFIER NEWLINE WHITESPACE IDENTIFIER"),
    ("_:x", "UNDERSCORE COLON IDENTIFIER"),
]

#: Source, and its errors by position as name@line:column.
ERRORS = [
    ("<div>", "MissingClosingTagError@1:0"),
    ("</div>", "MissingOpeningTagError@1:0"),
    ("</p", "UnclosedCloseTagError@1:0 MissingOpeningTagError@1:0"),
    ("<p", "UnclosedOpenTagError@1:0 MissingClosingTagError@1:0"),
    ("<!-- a --!>", "InvalidCommentClosingTagError@1:7"),
    ("<a href=>x</a>", "MissingAttributeValueError@1:3"),
    ("<a href='x>y", "MissingClosingTagError@1:0 UnclosedQuoteError@1:8"),
    ("<% if a %>", "MissingERBEndTagError@1:0"),
    ("x\n <% end %>", "ERBControlFlowScopeError@2:1"),
    ("<% else %>", "ERBControlFlowScopeError@1:0"),
    ("<%= a", "UnclosedERBTagError@1:0"),
    ("<% a <% b %>", "NestedERBTagError@1:0"),
    ("x %>", "StrayERBClosingTagError@1:2"),
    ("</br>", "VoidElementClosingTagError@1:0"),
    ("<ul><li>a</ul>", "OmittedClosingTagError@1:4"),
    ("<p =a>x</p>", "UnexpectedError@1:3"),
    ("<b><i></b></i>", "MissingClosingTagError@1:3 MissingOpeningTagError@1:10"),
    ("<% case a %><% elsif b %><% end %>", "ERBControlFlowScopeError@1:12"),
    ("<td>a<td>b", "OmittedClosingTagError@1:0 OmittedClosingTagError@1:5"),
    ("<div>" + "<b>x" * 30 + "</div>" + "</i>" * 30, " ".join(f"MissingClosingTagError@1:{5 + 4 * k}" for k in range(25))),
]

#: Source, and its nodes in order as depth:type:tag or control.
NODES = [
    ("t", "1:text:"),
    ("<?xml v?>", "1:xml_declaration:"),
    ("<?php x ?>", "1:processing_instruction:"),
    ("<![CDATA[x]]>", "1:cdata:"),
    ("<!-- <%= c %> -->", "1:comment:"),
    ("<!doctype html>", "1:doctype:"),
    ("<%= x %>", "1:erb:"),
    ("<% if a %>b<% elsif c %>d<% else %><p>e</p><% end %>", "1:block:if 2:text: 2:text: 2:element:p 3:text:"),
    ("<% unless a %>b<% end %>", "1:block:unless 2:text:"),
    ("<% case a %><% when 1 %>x<% when 2 %>y<% end %>", "1:block:case 2:text: 2:text:"),
    ("<% begin %>a<% rescue %>b<% ensure %>c<% end %>", "1:block:begin 2:text: 2:text: 2:text:"),
    ("<% xs.each do |x| %>y<% end %>", "1:block:block 2:text:"),
    ("<% while a %>b<% end %>", "1:block:while 2:text:"),
    ("<% until a %>b<% end %>", "1:block:until 2:text:"),
    ("<% for i in xs %>c<% end %>", "1:block:for 2:text:"),
    ("<p class='a' <%= b %>>x</p>", "1:element:p 2:text:"),
    ("<script>a<%= b %></script>", "1:element:script 2:literal: 2:erb:"),
    ("<style>p{}</style>", "1:element:style 2:literal:"),
    ("<svg><path/></svg>", "1:element:svg 2:element:path"),
    ("<ul><li>a<li>b</ul>", "1:element:ul 2:element:li 3:text: 2:element:li 3:text:"),
    ("<a><b></a></b>", "1:element:a 2:element:b 1:stray_close:b"),
]

#: Source, and its attributes in order as name|value|quote|equals sign with the space around it; no value is ``-``.
ATTRIBUTES = [
    ("<p a>", "a|-||"),
    ("<p a=b>", "a|b||="),
    ("<p A='b'>", "a|b|single|="),
    ('<p a="b <%= c %>">', "a|b |double|="),
    ("<p a-<%= b %>='c'>", "|c|single|="),
    ("<p a = b>", "a|b|| = "),
    ("<p :a='b' @c='d'>", ":a|b|single|= @c|d|single|="),
    ("<p a=''>", "a||single|="),
    ("<p data-x_y='1>2' b>", "data-x_y|1>2|single|= b|-||"),
    ("<p\na='1'\n  b>", "a|1|single|= b|-||"),
]

#: Source, its Ruby, its Ruby with comments, and its HTML.
EXTRACTS = [
    ("<p><%= a %></p>", "       a  ;    ", "       a  ;    ", "<p>        </p>"),
    ("<% b -%>", "   b  ; ", "   b  ; ", "        "),
    ("<%# c %>\n<%= d %>", "        \n    d  ;", "  # c   \n    d  ;", "        \n        "),
    ("<%% e %>", "        ", "        ", "        "),
    ("é<%= h %>", "      h  ;", "      h  ;", "é        "),
]

#: Old and new source, and the types of the changes in order.
CHANGES = [
    ("<p>a</p>", "<p>b</p>", "text_changed"),
    ("<p>a</p>", "<i>a</i>", "node_removed node_inserted"),
    ("<p a='1'>x</p>", "<p a='2'>x</p>", "attribute_value_changed"),
    ("<p a='1'>x</p>", "<p>x</p>", "attribute_removed"),
    ("<p>x</p>", "<p a='1'>x</p>", "attribute_added"),
    ("<p>x</p>", "<div><p>x</p></div>", "node_wrapped"),
    ("<div><p>x</p></div>", "<p>x</p>", "node_unwrapped"),
    ("<p>a</p>", "<p>a</p><p>b</p>", "node_inserted"),
    ("<p>a</p><p>b</p>", "<p>a</p>", "node_removed"),
    ("<%= a %>", "<%= b %>", "erb_content_changed"),
    ("<% if a %>x<% end %>", "<% if b %>x<% end %>", "erb_content_changed"),
    ("<% if a %>x<% end %>", "<% if a %>y<% end %>", "text_changed"),
    ("<p>a</p>", "<p>a</p>", ""),
    ("<div>" * 70 + "a" + "</div>" * 70, "<div>" * 70 + "b" + "</div>" * 70, "text_changed"),
]

#: Source, and its steps for a compiler as kind(text).
COMPILED = [
    ("a<%= b %>c", "text(a)expr_escaped(b)text(c)"),
    ("<%- c -%>\n", "code(c)"),
    ("<%# d %>x", "text(x)"),
    ("<%% e %>", "text(<% e %>)"),
    ("<%== h %>", "expr(h)"),
    ("x<%# n %>y", "text(xy)"),
]

#: Source, and its layout.
LAYOUTS = [
    ("<p>a<b>b</b>c</p>", "<p>a<b>b</b>c</p>\n"),
    ("<div><p><b>bold</b>, world</p></div>", "<div>\n  <p><b>bold</b>, world</p>\n</div>\n"),
    ("<div>a<% if b %>c<% end %>d</div>", "<div>a<% if b %>c<% end %>d</div>\n"),
    ("<ul><li>a</li> <li><a href='/x'>b</a></li></ul>", '<ul>\n  <li>a</li>\n  <li><a href=\'/x\'>b</a></li>\n</ul>\n'),
    ("<% if a %> <p lang='en'>x</p> <% else %> y <% end %>", '<% if a %>\n  <p lang="en">x</p>\n<% else %>\n  y\n<% end %>\n'),
    ("<pre> a\n  b</pre>", "<pre> a\n  b</pre>\n"),
    ("<p>" + "word " * 20 + "</p>", "<p>\n  " + " ".join(["word"] * 15) + "\n  " + " ".join(["word"] * 5) + "\n</p>\n"),
    ("<b>x", "<b>x"),
    ("<%%= x %>  <p>y</p>", "<%%= x %>  <p>y</p>"),
]

#: Source, and what the safe fixes make of it.
FIXES = [
    ("<P>x</P>\n", "<p>x</p>\n"),
    ("<script>var a='<P>'  \n</script>\n", "<script>var a='<P>'  \n</script>\n"),
    ("<pre>a  \n\n\n\n\nb</pre>\n", "<pre>a  \n\n\n\n\nb</pre>\n"),
    ("<%#= x %>\n", "<%#= x %>\n"),
    ("<%=x%>", "<%= x %>\n"),
    ("<% # note %>\n", "<%# note %>\n"),
    ("a\n\n\n\n\nb  \n\n", "a\n\n\nb\n"),
    ("<p lang='en'>x</p>\n", '<p lang="en">x</p>\n'),
    ("<%= x =%>\n", "<%= x -%>\n"),
]

#: Source, and its iterations as receiver|operator|message|arguments|parameters.
ITERATIONS = [
    ("<% items.each do |x| %><%= x %><% end %>", "items|.|each||x"),
    ("<% 3.times { %>y<% } %>", "3|.|times||"),
    ("<% @a.b.each_slice(3) do |p, q| %>z<% end %>", "@a.b|.|each_slice|3|p;q"),
    ("<% a&.step(10, f(2, 3)) do |i| %>z<% end %>", "a|&.|step|10;f(2, 3)|i"),
    ("<%= form_with do |f| %>x<% end %>", ""),
    ("<% list = rows.select(&:ok).map do |r| %>x<% end %>", "rows.select(&:ok)|.|map||r"),
    ("<% if a.each %>x<% end %>", ""),
]

#: Source, and what in its code does not pair up.
BALANCE = [
    ("<%= f(a %>", "unclosed ("),
    ("<%= a] %>", "unexpected ]"),
    ("<%= (a] %>", "unexpected ]"),
    ("<%= 'a %>", "unterminated string"),
    ("<%= \"(\" %>", ""),
    ("<% x.each { |y| %>a<% } %>", ""),
    ("<%# ( %>", ""),
    ("<%= f(a[1], {b: 2}) %>", ""),
    ("<%= [1, {a: (2} %>", "unexpected }"),
]

#: Source, and its states with the tags that read them.
DEPENDENCIES = [
    ("<%= @a %><% if @a %>x<% end %><%= B::C %>", "@a=1:0,1:9 B::C=1:30"),
    ("<%# locals: (t:) %><%= t %>", "t=1:19"),
    ("<%= 'Abc @d' %><%= x.y %>", ""),
    ("<%= @a + @a %>", "@a=1:0"),
]

#: Source, and the locals readable at each of its outputs.
SCOPES = [
    ("<% a = 1 %><% xs.each do |x| %><%= x %><% end %><%= a %>", "a,x a"),
    ("<% xs.each do |x, y| %><% b = x %><%= b %><% end %><%= c %>", "b,x,y -"),
    ("<%= d %><% d = 2 %><% if d == 3 %><%= d %><% end %>", "- d"),
]

#: Ruby source, and the partials it names; a star for a folder.
REFERENCES = [
    ("render partial: 'a/b'", "a/b"),
    ('render "a/#{kind}"', "a*"),
    ('self.partial = "c/d"', "c/d"),
    ("x partial: 'e', render \"f\"", "e f"),
    ("render x", ""),
]


def corpus(parts: DataFrame, shapes: list[tuple], *names: str) -> DataFrame:
    """``(doc_id, path, <names>)`` from ``part``: the first fields of the key's shape."""
    rows = [(i, *x[: len(names)]) for i, x in enumerate(shapes)]
    known = parts.sparkSession.createDataFrame(rows, "shape int, " + ", ".join(f"{n} string" for n in names))
    keyed = parts.select(F.col("p_partkey").alias("doc_id"), F.expr(f"cast(p_partkey % {len(shapes)} as int)").alias("shape"))
    # a row for each shape: a fixed number
    return keyed.join(F.broadcast(known), "shape").select("doc_id", F.lit("app/views/x.html.erb").alias("path"), *names)


def expected_sql(shapes: list[tuple], *names: str) -> str:
    """DuckDB SQL of ``doc_id`` and the last fields of the key's shape as ``names``, without the shapes whose last fields are all empty."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {', '.join(quoted(y) for y in x[-len(names):])})" for i, x in enumerate(shapes) if any(x[-len(names) :]))
    return f"select p_partkey as doc_id, {', '.join(names)} from part join (values {rows}) v(i, {', '.join(names)}) on p_partkey % {len(shapes)} = i"
