"""Each case: a rule, templates that break it (path, source), templates that keep it."""

import pytest

from tessera.lint import engine as lint
from tessera.operators.tables import Tables

CASES = {
    "actionview-no-helper-shadowing": (["<% label = 1 %>"], ["<% caption = 1 %>"]),
    "actionview-no-redundant-local-assigns": (["<%# locals: (a:) %><%= local_assigns[:a] %>"], ["<%= local_assigns[:a] %>"]),
    "actionview-prefer-collection-render": (["<% items.each do |i| %><%= render i %><% end %>"], ["<% items.each do |i| %><p><%= render i %></p><% end %>"]),
    "actionview-prefer-pluralize-helper": (["<%= items.count %> <%= 'item'.pluralize %>"], ["<%= items.count %> <%= 'item' %>"]),
    "erb-no-conditional-html-element": (["<% if a %><div><% end %>x<% if a %></div><% end %>"], ["<% if a %><div></div><% end %>"]),
    "erb-no-conditional-open-tag": (["<% if a %><div id='x'><% else %><div><% end %></div>"], ["<% if a %><div></div><% else %><p></p><% end %>"]),
    "erb-no-duplicate-branch-elements": (["<% if a %><p>x</p><% else %><p>y</p><% end %>"], ["<% if a %><p>x</p><% else %><i>y</i><% end %>", "<% if a %><p>x</p><% end %>"]),
    "erb-no-inline-case-conditions": (["<% case a when 1 %>x<% end %>"], ["<% case a %><% when 1 %>x<% end %>"]),
    "tpl-state-valid-declaration": (["<%# tpl:state (a: 1.5) %>", "<%# tpl:state a %>"], ["<%# tpl:state (a: 1, b: false) %>"]),
    "tpl-state-no-unused-states": (["<%# tpl:state (a: 1) %>"], ["<%# tpl:state (a: 1) %><%= a %>", "<%# tpl:state (a: 1) %><p data-tpl-increment=\"a\">x</p>"]),
    "tpl-state-requires-client-mode": (["<%# tpl:state (a: 1) %>"], ["<%# tpl:slots client %><%# tpl:state (a: 1) %>"]),
    "tpl-state-valid-actions": (["<%# tpl:state (a: 1) %><p data-tpl-toggle=\"a\">x</p>", "<p data-tpl-toggle=\"b\">x</p>"], ["<%# tpl:state (a: false) %><p data-tpl-toggle=\"click->a\">x</p>"]),
    "tpl-state-valid-bindings": (["<%# tpl:state (a: 1) %><input checked=\"<%= a %>\">"], ["<%# tpl:state (a: true) %><input checked=\"<%= a %>\">"]),
    "tpl-state-valid-reads": (["<%# tpl:state (a: 1) %><% if a? %>x<% end %>"], ["<%# tpl:state (a: true) %><% if a? %>x<% end %>"]),
    "tpl-into-requires-collection": (["<form data-tpl-into=\"xs\"></form>"], ["<%# tpl:key id %><ul data-tpl-name=\"xs\"></ul><form data-tpl-into=\"xs\"></form>"]),
    "tpl-valid-slot-names": (["<p data-tpl-name=\"\">x</p>", "<p data-tpl-name=\"a\">x</p><p data-tpl-name=\"a\">x</p>"], ["<p data-tpl-name=\"a\">x</p>"]),
    "erb-no-unused-local-variable": (["<% a = 1 %>"], ["<% a = 1 %><%= a %>"]),
    "erb-no-shadowed-block-argument": (["<% xs.each do |x| %><% x.each do |x| %><%= x %><% end %><% end %>"], ["<% xs.each do |x| %><%= x %><% end %><% xs.each do |x| %><%= x %><% end %>"]),
    "actionview-no-dynamic-partial-path": (["<%= render \"a/#{b}\" %>"], ["<%= render \"a/b\" %>"]),
    "actionview-no-silent-render": (["<% render \"a/b\" %>"], ["<%= render \"a/b\" %>"]),
    "actionview-prefer-qualified-partial-path": (["<%= render \"card\" %>"], ["<%= render \"a/card\" %>"]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows, k = [], 0
    for rule, (bad, good) in CASES.items():
        for broken, sources in ((True, bad), (False, good)):
            for s in sources:
                k += 1
                rows.append((k, rule, broken, s))
    df = spark.createDataFrame([(k, f"app/views/t{k}.html.erb", s) for k, _, _, s in rows], "doc_id long, path string, source string")
    got = lint.offenses(Tables(df), lint.Config(only=tuple(CASES), gate=False)).collect()
    return rows, {(r.doc_id, r.rule) for r in got}


@pytest.mark.parametrize("rule", CASES)
def test_rule(found, rule):
    rows, hits = found
    assert [(s, (k, rule) in hits) for k, r, broken, s in rows if r == rule] == [(s, broken) for _, r, broken, s in rows if r == rule]


def test_cross_file_rules(spark):
    docs = [
        (1, "app/views/a.html.erb", "<%= render \"x/p\", title: 5, colour: 1 %>\n"), (2, "app/views/x/_p.html.erb", "<%# locals: (title: \"t\", size:) %>\n<%= title %><%= size %>\n"),
    ]
    t = Tables(spark.createDataFrame(docs, "doc_id long, path string, source string"))
    got = lint.offenses(t, lint.Config(only=("actionview-no-mistyped-locals", "actionview-no-strict-locals-error")))
    assert sorted((r.doc_id, r.rule, r.message) for r in got.collect()) == [
        (1, "actionview-no-mistyped-locals", "`title` is integer and declared as string"),
        (1, "actionview-no-strict-locals-error", "`colour` is unknown for `x/p`"),
        (1, "actionview-no-strict-locals-error", "`size` is missing for `x/p`"),
    ]
