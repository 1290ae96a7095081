"""The rules: each is a condition over one table, so a rule is a filter that Catalyst can plan.

``source`` names the table: ELEM elements, ATTR attributes, ERB embedded tags,
BLOCK control blocks, TEXT text nodes, TOK tokens-level facts of elements, DOC whole
sources, ERROR parse errors.  Rules that need a join or a window stand in
``relational``.
"""

from __future__ import annotations

from dataclasses import dataclass

from tessera.functions.directives import named
from tessera.functions import html_tables as H


@dataclass(frozen=True)
class Rule:
    name: str
    source: str
    severity: str
    enabled: bool
    where: str
    message: str
    introduced: str = "0.1.0"
    framework: str = "ruby"
    fixable: str = ""


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values)) + ")"


def _has(name: str) -> str:
    return f"map_contains_key(attr, '{name}')"


def _val(name: str) -> str:
    return f"attr['{name}']"


def _static(name: str) -> str:
    """A static, non-empty value; null otherwise."""
    return f"(case when not array_contains(dynamic, '{name}') then nullif(attr['{name}'], '') end)"


def _in(tag: str) -> str:
    return f"array_contains(ancestors, '{tag}')"


_NOT_SVG = "not array_contains(ancestors, 'svg')"
_JS = f"(tag = 'script' and coalesce({_static('type')} not in {sql_list(H.NOT_JAVASCRIPT)}, true))"
_FOCUSABLE = (
    f"((tag = 'a' and {_has('href')}) or (tag in ('button', 'select', 'textarea', 'summary') and not {_has('disabled')}) or (tag = 'input' and coalesce({_val('type')}, '') <> 'hidden' and not {_has('disabled')}) "
    f"or try_cast({_val('tabindex')} as int) >= 0)"
)
_OUTPUT = "opening in ('<%=', '<%==')"
_SILENT = "opening in ('<%', '<%-')"
_CODE = "regexp_replace(content, '\"[^\"]*\"|\\'[^\\']*\\'|#[^\\\\n]*', '\"\"')"


def _call(names: str) -> str:
    return f"{_CODE} rlike '(^|[^\\\\w.:@$])({names})(?![\\\\w?!=:])'"


RULES: list[Rule] = []


def rule(name: str, source: str, severity: str, where: str, message: str, enabled: bool = True, **more) -> None:
    RULES.append(Rule(name, source, severity, enabled, where, message, **more))


# accessibility
rule("a11y-avoid-generic-link-text", "ELEM", "warning", f"tag = 'a' and not {_has('aria-label')} and not {_has('aria-labelledby')} and trim(regexp_replace(lower(direct_text), '\\\\W+', ' ')) in {sql_list(H.GENERIC_LINK)}", "'Avoid generic link text'", False)
rule("a11y-disabled-attribute", "ELEM", "warning", f"{_has('disabled')} and tag not in {sql_list(H.DISABLEABLE | {'task-lists'})}", "concat('`disabled` has no effect on `<', tag, '>`')", False)
rule("a11y-nested-interactive-elements", "ELEM", "error", f"tag in {sql_list(H.INTERACTIVE)} and exists(ancestors, x -> x in {sql_list(H.INTERACTIVE)}) and not (tag = 'input' and coalesce({_val('type')}, '') = 'hidden')", "concat('`<', tag, '>` must not be nested in another interactive element')", False)
rule("a11y-no-accesskey-attribute", "ATTR", "warning", "name = 'accesskey'", "'Avoid the `accesskey` attribute'", False)
rule("a11y-no-aria-label-misuse", "ELEM", "warning", f"({_has('aria-label')} or {_has('aria-labelledby')}) and (tag in {sql_list(H.NAME_RESTRICTED)} or (tag in ('span', 'div') and not {_has('role')}))", "concat('`aria-label` is not permitted on `<', tag, '>`')", False)
rule("a11y-no-aria-unsupported-elements", "ATTR", "warning", f"(name like 'aria-%' or name = 'role') and tag in {sql_list(H.ARIA_UNSUPPORTED)}", "concat('`', name, '` is not supported on `<', tag, '>`')", False)
rule("a11y-no-autofocus-attribute", "ATTR", "warning", "name = 'autofocus' and tag <> 'dialog'", "'Avoid the `autofocus` attribute'", False)
rule("a11y-no-redundant-image-alt", "ELEM", "warning", f"tag = 'img' and arrays_overlap(split(lower({_static('alt')}), '\\\\s+'), array('image', 'picture'))", "'`alt` must not say image or picture'", False)
rule("a11y-no-visually-hidden-interactive-elements", "ELEM", "warning", f"{_FOCUSABLE} and arrays_overlap(split({_val('class')}, '\\\\s+'), array('sr-only', 'visually-hidden')) and not arrays_overlap(split({_val('class')}, '\\\\s+'), array('focus:not-sr-only', 'not-sr-only'))", "'Focusable elements must not be visually hidden'", False)
rule("a11y-svg-has-accessible-text", "ELEM", "warning", f"tag = 'svg' and not ({_has('aria-hidden')} and ({_val('aria-hidden')} is null or {_val('aria-hidden')} = 'true' or array_contains(dynamic, 'aria-hidden'))) and not {_has('aria-label')} and not {_has('aria-labelledby')} and not array_contains(child_tags, 'title')", "'`<svg>` needs accessible text'", False)

# attributes
rule("html-allowed-script-type", "ELEM", "error", f"tag = 'script' and {_has('type')} and not array_contains(dynamic, 'type') and coalesce({_val('type')}, '') not in {sql_list(H.SCRIPT_TYPES)}", "'`type` of `<script>` is not allowed'")
rule("html-anchor-require-href", "ELEM", "error", f"tag = 'a' and (not {_has('href')} or {_static('href')} = '#' or {_static('href')} like 'javascript:void%')", "'`<a>` needs an `href` that goes somewhere'")
rule("html-aria-attribute-must-be-valid", "ATTR", "warning", f"name like 'aria-%' and name not in {sql_list(H.ARIA)}", "concat('`', name, '` is not a valid ARIA attribute')")
rule("html-aria-label-is-well-formatted", "ELEM", "warning", f"{_static('aria-label')} rlike '[\\\\r\\\\n]|&#10;|&#13;|&#x0A;|&#x0D;' or ({_static('aria-label')} rlike '^\\\\S+$' and {_static('aria-label')} rlike '[_-]|[a-z][A-Z]') or {_static('aria-label')} rlike '^[a-z]'", "'`aria-label` must be formatted like text'")
rule("html-aria-level-must-be-valid", "ELEM", "warning", f"{_has('aria-level')} and not array_contains(dynamic, 'aria-level') and coalesce({_val('aria-level')}, '') not rlike '^[1-6]$'", "'`aria-level` must be 1 to 6'")
rule("html-aria-role-heading-requires-level", "ELEM", "warning", f"{_val('role')} = 'heading' and not {_has('aria-level')}", "'`role=heading` needs `aria-level`'")
rule("html-aria-role-must-be-valid", "ELEM", "warning", f"{_static('role')} not in {sql_list(H.ROLES)}", "concat('`', attr['role'], '` is not a valid role')")
rule("html-attribute-double-quotes", "ATTR", "warning", "quote = 'single' and value not like '%\"%'", "concat('Use double quotes for `', raw, '`')", fixable="safe")
rule("html-attribute-equals-spacing", "ATTR", "error", "equals <> '' and equals <> '='", "concat('No space around `=` of `', raw, '`')", fixable="safe")
rule("html-attribute-values-require-quotes", "ATTR", "error", "value is not null and quote = ''", "concat('Quote the value of `', raw, '`')", fixable="safe")
rule("html-avoid-both-disabled-and-aria-disabled", "ELEM", "warning", f"tag in {sql_list(H.DISABLEABLE)} and {_has('disabled')} and {_has('aria-disabled')} and not arrays_overlap(dynamic, array('disabled', 'aria-disabled'))", "'Use either `disabled` or `aria-disabled`'")
rule("html-boolean-attributes-no-value", "ATTR", "error", f"name in {sql_list(H.BOOLEAN)} and equals <> ''", "concat('Boolean attribute `', name, '` takes no value')", fixable="safe")
rule("html-iframe-has-title", "ELEM", "warning", f"tag = 'iframe' and coalesce({_val('aria-hidden')}, '') <> 'true' and trim(coalesce({_val('title')}, '')) = '' and not array_contains(dynamic, 'title')", "'`<iframe>` needs a title'")
rule("html-img-require-alt", "ELEM", "warning", f"tag = 'img' and {_val('alt')} is null", "'`<img>` needs `alt`'")
rule("html-input-require-autocomplete", "ELEM", "warning", f"tag = 'input' and not {_has('disabled')} and {_static('type')} in {sql_list(H.AUTOCOMPLETE_TYPES)} and not array_contains(dynamic, 'autocomplete') and coalesce({_val('autocomplete')}, '') = ''", "'`<input>` needs `autocomplete`'")
rule("html-navigation-has-label", "ELEM", "warning", f"(tag = 'nav' or {_val('role')} = 'navigation') and not {_has('aria-label')} and not {_has('aria-labelledby')}", "'Navigation needs a label'", False)
rule("html-no-abstract-roles", "ELEM", "warning", f"{_static('role')} in {sql_list(H.ABSTRACT_ROLES)}", "'Abstract roles must not be used'")
rule("html-no-aria-hidden-on-body", "ELEM", "warning", f"tag = 'body' and {_has('aria-hidden')}", "'`<body>` must not be hidden'")
rule("html-no-aria-hidden-on-focusable", "ELEM", "warning", f"{_val('aria-hidden')} = 'true' and {_FOCUSABLE}", "'Focusable elements must not be hidden'")
rule("html-no-empty-attributes", "ATTR", "warning", f"(name in {sql_list(H.NON_EMPTY_ATTRIBUTES)} or name like 'data-%' or name like 'aria-%') and trim(value) = '' and not exists(parts, p -> p.kind = 'erb_output')", "concat('`', name, '` must not be empty')")
rule("html-no-event-handler-attributes", "ATTR", "error", f"name in {sql_list(H.EVENT_HANDLERS)}", "concat('Avoid `', name, '`')", False)
rule("html-no-positive-tab-index", "ATTR", "warning", "name = 'tabindex' and cast(nullif(regexp_extract(value, '^\\\\s*([+-]?[0-9]+)', 1), '') as int) > 0", "'Positive `tabindex`'")
rule("html-no-style-attributes", "ATTR", "error", "name = 'style'", "'Avoid inline `style`'", False)
rule("html-no-title-attribute", "ATTR", "warning", "name = 'title' and tag not in ('iframe', 'link')", "'Avoid `title`'", False)
rule("html-no-underscores-in-attribute-names", "ATTR", "warning", "exists(name_parts, p -> p.kind = 'literal' and p.text like '%\\\\_%')", "concat('Underscore in `', raw, '`')")
rule("turbo-permanent-no-misleading-value", "ATTR", "error", "name = 'data-turbo-permanent' and equals <> ''", "case when value = 'true' then '`data-turbo-permanent` needs no value' else 'The value of `data-turbo-permanent` has no effect' end")
rule("turbo-permanent-require-id", "ELEM", "error", f"{_has('data-turbo-permanent')} and not {_has('id')}", "'`data-turbo-permanent` needs an `id`'")
rule("ujs-no-remote-attribute", "ATTR", "warning", "name = 'data-remote'", "'Avoid `data-remote`'")
rule("ujs-prefer-turbo-confirm", "ATTR", "warning", "name = 'data-confirm'", "'Use `data-turbo-confirm`'")
rule("ujs-prefer-turbo-method", "ATTR", "warning", "name = 'data-method'", "'Use `data-turbo-method`'")
rule("ujs-prefer-turbo-submits-with", "ATTR", "warning", "name = 'data-disable-with'", "'Use `data-turbo-submits-with`'")
rule("erb-no-interpolated-class-names", "ATTR", "warning", "name = 'class' and exists(sequence(1, size(parts) - 1), i -> size(parts) > 1 and i > 0 and i < size(parts) and ((get(parts, i).kind = 'erb_output' and get(parts, i - 1).kind = 'literal' and get(parts, i - 1).text rlike '\\\\S$') or (get(parts, i).kind = 'literal' and get(parts, i - 1).kind = 'erb_output' and get(parts, i).text rlike '^\\\\S')))", "'Interpolated class name'")
rule("erb-no-output-in-attribute-name", "ATTR", "error", "exists(name_parts, p -> p.kind = 'erb_output')", "'Output in an attribute name'")
rule("erb-no-silent-tag-in-attribute-name", "ATTR", "error", "exists(name_parts, p -> p.kind = 'erb_silent')", "'Silent tag in an attribute name'")
rule("erb-no-raw-output-in-attribute-value", "ATTR", "error", "exists(parts, p -> p.opening = '<%==')", "'Raw output in an attribute value'")
rule("erb-no-unsafe-js-attribute", "ATTR", "error", "name rlike '^on' and exists(parts, p -> p.kind = 'erb_output' and p.text not rlike '\\\\.to_json|\\\\bj[ (]|escape_javascript')", "concat('Unsafe output in `', name, '`')")
rule("stimulus-attribute-format", "ATTR", "error", "name = 'data-controller' and size(parts) = 1 and value not rlike '^\\\\s*([a-z][a-z0-9]*(-{1,2}[a-z0-9]+)*\\\\s*)*$'", "'Invalid controller name'")
rule("stimulus-action-format", "ATTR", "error", "name = 'data-action' and size(parts) = 1 and exists(filter(split(trim(value), '\\\\s+'), x -> x <> ''), x -> x not rlike '^([a-z0-9:.@+_-]+->)?[a-z0-9-]+#[A-Za-z0-9_]+(:[a-z!]+)*$')", "'Invalid action descriptor'")

# elements
rule("html-body-only-elements", "ELEM", "error", f"tag in {sql_list(H.BODY_ONLY)} and {_in('head')} and not {_in('body')}", "concat('`<', tag, '>` belongs in `<body>`')")
rule("html-head-only-elements", "ELEM", "error", f"tag in {sql_list(H.HEAD_ONLY)} and {_in('body')} and not {_in('head')} and not (tag in ('title', 'style') and {_in('svg')}) and not (tag = 'meta' and {_has('itemprop')})", "concat('`<', tag, '>` belongs in `<head>`')")
rule("html-details-has-summary", "ELEM", "warning", "tag = 'details' and not array_contains(child_tags, 'summary')", "'`<details>` needs a `<summary>`'")
rule("html-no-block-inside-inline", "ELEM", "error", f"(tag in {sql_list(H.BLOCK)} or (tag not in {sql_list(H.INLINE | H.KNOWN_HTML)})) and try_element_at(ancestors, -1) in {sql_list(H.INLINE)} and {_NOT_SVG}", "concat('Block element `<', tag, '>` inside an inline element')", False)
rule("html-no-empty-headings", "ELEM", "warning", f"(tag in {sql_list(H.HEADINGS)} or {_val('role')} = 'heading') and not accessible and close <> 'missing'", "'Empty heading'")
rule("html-no-inline-script-elements", "ELEM", "error", f"{_JS} and not ({_has('src')} and trim(direct_text) = '')", "'Avoid inline scripts'", False)
rule("html-no-nested-forms", "ELEM", "error", f"tag = 'form' and {_in('form')}", "'Nested form'")
rule("html-no-nested-links", "ELEM", "error", f"tag = 'a' and {_in('a')}", "'Nested link'")
rule("html-no-self-closing", "ELEM", "error", f"closing = '/>' and {_NOT_SVG}", "concat('Self-closing `<', raw, ' />`')", fixable="safe")
rule("html-no-space-in-tag", "ELEM", "error", "space <> '' or close_space <> ''", "concat('Extra space in `<', raw, '>`')", fixable="safe")
rule("html-no-style-elements", "ELEM", "error", "tag = 'style'", "'Avoid `<style>`'", False)
rule("html-no-unknown-tag", "ELEM", "warning", f"tag not like '%-%' and tag not like '%.%' and tag not in {sql_list(H.KNOWN_HTML)} and {_NOT_SVG} and not {_in('math')} and raw not rlike '^[A-Z]'", "concat('Unknown tag `<', tag, '>`')")
rule("html-require-closing-tags", "ELEM", "error", "close = 'omitted'", "concat('`<', raw, '>` needs a closing tag')")
rule("html-require-script-nonce", "ELEM", "error", f"{_JS} and not {_has('src')} and coalesce({_val('nonce')}, '') = '' and not array_contains(dynamic, 'nonce')", "'`<script>` needs a nonce'")
rule("html-tag-name-lowercase", "ELEM", "error", f"(raw <> lower(raw) or close_raw <> lower(close_raw)) and {_NOT_SVG}", "concat('Tag name `', raw, '` must be lower case')", fixable="safe")
rule("svg-no-deprecated-tags", "ELEM", "error", f"{_in('svg')} and tag in {sql_list({t.lower() for t in H.SVG_DEPRECATED})}", "concat('`<', raw, '>` is deprecated')")
rule("svg-tag-name-capitalization", "ELEM", "error", f"{_in('svg')} and tag in {sql_list({t.lower() for t in H.SVG_CAMEL})} and raw not in {sql_list(H.SVG_CAMEL)}", "concat('`<', raw, '>` is wrongly capitalised')", fixable="safe")
rule("actionview-prefer-link-to-helper", "ELEM", "info", "tag = 'a' and array_contains(dynamic, 'href') and coalesce(attr['href'], '') = ''", "'Prefer `link_to`'", framework="actionview")
rule("erb-prefer-image-tag-helper", "ELEM", "warning", "tag = 'img' and array_contains(dynamic, 'src')", "'Prefer `image_tag`'")

# embedded tags
rule("erb-comment-syntax", "ERB", "error", "opening in ('<%', '<%=', '<%-') and content rlike '^ +#'", "'Use `<%#` for comments'", fixable="safe")
rule("erb-no-commented-out-output-tags", "ERB", "info", "opening = '<%#' and content rlike '^[ \\\\t]*={1,2}(?!=)'", "'Commented-out output tag'")
rule("erb-no-debug-output", "ERB", "error", f"opening <> '<%#' and {_call('p|pp|puts|print|warn|debug|byebug|binding[.]pry|binding[.]irb')} and control = '' and content rlike '^\\\\s*(p|pp|puts|print|warn|debug|byebug|binding)\\\\b'", "'Debug output'")
rule("erb-no-empty-tags", "ERB", "error", "opening in ('<%', '<%=', '<%-', '<%==') and trim(content) = '' and closing <> ''", "'Empty tag'")
rule("erb-no-extra-whitespace-inside-tags", "ERB", "error", "trim(content) <> '' and content not like '%\n%' and (content rlike '^\\\\s{2,}\\\\S' or content rlike '\\\\S\\\\s{2,}$')", "'Extra white space inside the tag'", fixable="safe")
rule("erb-require-whitespace-inside-tags", "ERB", "error", "opening in ('<%', '<%=', '<%==', '<%-') and trim(content) <> '' and (content not rlike '^\\\\s' or content not rlike '\\\\s$')", "'White space needed inside the tag'", fixable="safe")
rule("erb-no-class-definitions", "ERB", "error", "opening <> '<%#' and content rlike '^\\\\s*class\\\\s'", "'Class definition'")
rule("erb-no-method-definitions", "ERB", "error", "opening <> '<%#' and content rlike '^\\\\s*(def\\\\s|define_method\\\\b)'", "'Method definition'")
rule("erb-no-module-definitions", "ERB", "error", "opening <> '<%#' and content rlike '^\\\\s*module\\\\s|\\\\bModule\\\\.new\\\\b'", "'Module definition'")
rule("erb-no-output-control-flow", "ERB", "error", f"{_OUTPUT} and control in ('if', 'unless', 'case', 'while', 'until', 'for', 'begin', 'elsif', 'else', 'when', 'end')", "'Control flow in an output tag'", fixable="safe")
rule("erb-no-output-in-attribute-position", "ERB", "error", f"{_OUTPUT} and place = 'tag'", "'Output in attribute position'")
rule("erb-no-return", "ERB", "error", f"opening <> '<%#' and {_call('return')}", "'`return` in a template'")
rule("erb-no-sleep", "ERB", "error", f"opening <> '<%#' and ({_call('sleep')} or content like '%Kernel.sleep%')", "'`sleep` in a template'")
rule("erb-no-statement-in-script", "ERB", "warning", f"{_SILENT} and array_contains(ancestors, 'script') and trim(content) <> ''", "'Statement in a script'")
rule("erb-no-then-in-control-flow", "ERB", "warning", f"opening <> '<%#' and control in ('if', 'elsif', 'unless', 'when', 'in') and {_CODE} rlike '\\\\bthen\\\\s*$'", "'`then` in control flow'")
rule("erb-no-unsafe-raw", "ERB", "error", f"{_OUTPUT} and content rlike '(^|[^\\\\w.])raw[ (]|\\\\.html_safe\\\\b'", "'Unsafe raw output'")
rule("erb-no-unsafe-script-interpolation", "ERB", "error", f"{_OUTPUT} and array_contains(ancestors, 'script') and content not rlike '\\\\.to_json\\\\b|escape_javascript|\\\\bj[ (]'", "'Unsafe output in a script'")
rule("erb-prefer-direct-output", "ERB", "error", f"{_OUTPUT} and content rlike '^\\\\s*(\"[^\"]*\"|\\'[^\\']*\\')\\\\s*$'", "'Write the text directly'", fixable="safe")
rule("erb-prefer-do-end-blocks", "ERB", "error", "control = 'block' and content rlike '\\\\{\\\\s*(\\\\|[^|]*\\\\|)?\\\\s*$'", "'Use do and end'", fixable="safe")
rule("erb-prefer-each-over-map", "ERB", "error", f"{_SILENT} and control = 'block' and content rlike '\\\\.(map|collect|flat_map|select|filter|reject|filter_map)\\\\b'", "'Use each'")
rule("erb-prefer-explicit-conditionals", "ERB", "error", f"{_OUTPUT} and control = '' and {_CODE} rlike '\\\\S\\\\s+(if|unless)\\\\s+\\\\S'", "'Use an explicit conditional'", False, fixable="safe")
rule("erb-right-trim", "ERB", "error", "closing = '=%>'", "'Use `-%>`'", fixable="safe")
rule("erb-no-javascript-tag-helper", "ERB", "warning", "content rlike '^\\\\s*javascript_tag\\\\b' and control = 'block'", "'Use a script element'")
rule("erb-no-silent-statement", "ERB", "warning", f"{_SILENT} and control = '' and place = 'content' and trim(content) <> '' and {_CODE} not rlike '(^|[^=!<>])=([^=>~]|$)' and content not rlike '^\\\\s*(yield|render|break|next)\\\\b'", "'Statement without output'", False)
rule("erb-no-unused-literals", "ERB", "error", f"{_SILENT} and content rlike '^\\\\s*(\"[^\"]*\"|\\'[^\\']*\\'|[0-9.]+|:[a-z_]+|nil|true|false|\\\\[[^\\\\]]*\\\\])\\\\s*$'", "'Unused literal'")
rule("erb-no-unused-expressions", "ERB", "error", f"{_SILENT} and content rlike '^\\\\s*@?[a-z_]+([.][a-z_]+)*\\\\s*$' and control = '' and content not rlike '^\\\\s*(yield|break|next|return|redo|retry)\\\\s*$'", "'Unused expression'")
rule("erb-no-instance-variables-in-partials", "ERB", "error", f"opening <> '<%#' and is_partial and {_CODE} rlike '@[a-z_]'", "'Instance variable in a partial'")
rule("erb-strict-locals-comment-syntax", "ERB", "error", "opening = '<%#' and content rlike '^\\\\s*locals\\\\b' and content not rlike '^\\\\s*locals: *\\\\(.*\\\\)\\\\s*$'", "'Malformed strict locals comment'", fixable="safe")
rule("actionview-strict-locals-partial-only", "ERB", "warning", "opening = '<%#' and content rlike '^\\\\s*locals:\\\\s*\\\\(' and not is_partial", "'Strict locals outside a partial'", framework="actionview")
rule("actionview-strict-locals-first-line", "ERB", "error", "opening = '<%#' and content rlike '^\\\\s*locals:\\\\s*\\\\(' and is_partial and line > 1", "'Strict locals must stand in the first line'", False, framework="actionview")
rule("actionview-no-silent-render", "ERB", "error", f"{_SILENT} and content rlike '^\\\\s*render\\\\b'", "'`render` without output'", framework="actionview")
rule("actionview-no-silent-helper", "ERB", "error", f"{_SILENT} and content rlike '^\\\\s*(link_to|form_with|form_for|content_tag|image_tag|button_to|tag[.])'", "'Helper without output'", framework="actionview")
rule("actionview-no-unnecessary-html-safe", "ERB", "error", f"{_OUTPUT} and content rlike '^\\\\s*(\"[^\"#]*\"|\\'[^\\']*\\')[.]html_safe\\\\s*$'", "'Write the markup directly'", framework="actionview", fixable="safe")
rule("actionview-no-content-argument-with-block", "ERB", "error", "control = 'block' and content rlike '^\\\\s*(tag[.][a-z]+|content_tag\\\\s*\\\\(?\\\\s*:[a-z]+\\\\s*,)\\\\s*\\\\(?\\\\s*[\"\\']'", "'Content argument and block'", framework="actionview")
rule("actionview-no-unnecessary-tag-attributes", "ERB", "warning", "place = 'tag' and content rlike '^\\\\s*tag[.]attributes\\\\b'", "'Use a tag helper'", framework="actionview")
rule("actionview-no-void-element-content", "ERB", "error", "content rlike '^\\\\s*(tag[.](br|hr|img|input|link|meta)\\\\s*\\\\(?\\\\s*[\"\\']|content_tag\\\\s*\\\\(?\\\\s*:(br|hr|img|input|link|meta)\\\\s*,\\\\s*[\"\\'])'", "'Void element with content'", framework="actionview")
rule("actionview-no-implicit-polymorphic-url", "ERB", "info", f"{_OUTPUT} and content rlike '^\\\\s*link_to\\\\s*\\\\(?[^,]+,\\\\s*(@[a-z_]+|\\\\[[^\\\\]]*\\\\])\\\\s*\\\\)?\\\\s*$'", "'Use a route helper'", framework="actionview")

rule("erb-no-inline-case-conditions", "ERB", "warning", "opening <> '<%#' and content rlike '^\\\\s*case\\\\b[\\\\s\\\\S]*\\\\b(when|in)\\\\b'", "'`case` and its first condition in one tag'")
rule(named("{word}-config-framework-option"), "ERB", "info", "content rlike '^\\\\s*(link_to|form_with|form_for|content_tag|image_tag|render)\\\\b'", "'Set the framework of the project'", framework="unset")

# blocks
rule("erb-no-empty-control-flow", "BLOCK", "hint", "exists(branches, x -> x = 'empty') and control not in ('case', 'case_match')", "concat('Empty `', control, '` block')")
rule("erb-no-case-node-children", "BLOCK", "error", "control in ('case', 'case_match') and get(branches, 0) = 'full'", "'Content between case and its first condition'")

# text and sources
rule("html-no-unescaped-entities", "TEXT", "warning", "content rlike '[<>]|&(?!(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)'", "'Unescaped character'", fixable="unsafe")
rule("html-no-literal-nbsp", "TEXT", "error", "content like '%\u00a0%'", "'Literal non-breaking space'", fixable="safe")
rule("erb-no-byte-order-mark", "DOC", "error", "startswith(source, '\ufeff')", "'Byte order mark'", fixable="safe")
rule("erb-no-extra-newline", "DOC", "error", "source rlike '\\\\n{4,}'", "'More than two blank lines'", fixable="safe")
rule("erb-require-trailing-newline", "DOC", "error", "path is not null and source <> '' and (not endswith(source, '\\n') or endswith(source, '\\n\\n'))", "'One newline needed at the end'", fixable="safe")
rule("erb-no-trailing-whitespace", "DOC", "error", "source rlike '(?m)[ \\\\t\\\\r\\\\f]+$'", "'Trailing white space'", fixable="safe")
rule("source-indentation", "DOC", "error", "source rlike '(?m)^ *\\\\t'", "'Tab in indentation'", fixable="safe")
rule("parser-no-errors", "ERROR", "error", "true", "message")
