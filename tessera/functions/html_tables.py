"""Fixed values of HTML, SVG and ARIA used by the parser and the rules."""

from __future__ import annotations


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
PRESERVE = _set("pre textarea script style")
BOOLEAN = _set(
    "allowfullscreen async autofocus autoplay checked compact controls declare default defer disabled formnovalidate hidden inert ismap itemscope loop multiple "
    "muted nomodule nohref noresize noshade novalidate nowrap open playsinline readonly required reversed scoped seamless selected sortable truespeed typemustmatch"
)
OPTIONAL_END = _set("li dt dd p rt rp optgroup option thead tbody tfoot tr td th colgroup")
P_CLOSERS = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul")
#: Open tags that end an element whose end tag is optional.
CLOSED_BY = {
    "li": _set("li"),
    "dt": _set("dt dd"),
    "dd": _set("dt dd"),
    "p": P_CLOSERS,
    "rt": _set("rt rp"),
    "rp": _set("rt rp"),
    "optgroup": _set("optgroup hr"),
    "option": _set("option optgroup hr"),
    "thead": _set("tbody tfoot"),
    "tbody": _set("tbody tfoot"),
    "tfoot": frozenset(),
    "tr": _set("tr tbody tfoot thead"),
    "td": _set("td th tr tbody tfoot"),
    "th": _set("td th tr tbody tfoot"),
    "colgroup": _set("thead tbody tfoot tr"),
}
INTERACTIVE = _set("button summary input select textarea")
BLOCK = _set(
    "address article aside blockquote canvas dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav noscript ol p pre section table tfoot ul video"
)
INLINE = _set(
    "a abbr acronym audio b bdi bdo big br button cite code data datalist del dfn em embed i iframe img input ins kbd label map mark meter noscript object output picture progress q ruby s samp "
    "script select slot small span strong sub sup svg template textarea time tt u var video wbr"
)
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
HEAD_ONLY = _set("title meta base link style")
BODY_ONLY = _set("header main nav section footer article aside form h1 h2 h3 h4 h5 h6 p ul ol table")
DISABLEABLE = _set("button fieldset input optgroup option select textarea")
KNOWN_HTML = _set(
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter nav noscript object ol optgroup "
    "option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strong style sub summary sup svg table tbody td template textarea tfoot th "
    "thead time title tr track u ul var video wbr"
)
SVG_DEPRECATED = _set("altGlyph altGlyphDef altGlyphItem color-profile cursor font font-face font-face-format font-face-name font-face-src font-face-uri glyph glyphRef hkern missing-glyph tref vkern")
SVG_CAMEL = _set(
    "animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA "
    "feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject linearGradient "
    "radialGradient textPath"
)
ROLES = _set(
    "alert alertdialog application article banner blockquote button caption cell checkbox code columnheader combobox complementary contentinfo definition deletion dialog directory document "
    "emphasis feed figure form generic grid gridcell group heading img insertion link list listbox listitem log main mark marquee math menu menubar menuitem menuitemcheckbox menuitemradio meter "
    "navigation none note option paragraph presentation progressbar radio radiogroup region row rowgroup rowheader scrollbar search searchbox separator slider spinbutton status strong subscript "
    "suggestion superscript switch tab table tablist tabpanel term textbox time timer toolbar tooltip tree treegrid treeitem"
)
ABSTRACT_ROLES = _set("command composite input landmark range roletype section sectionhead select structure widget window")
ARIA = frozenset(
    "aria-" + x
    for x in (
        "activedescendant atomic autocomplete braillelabel brailleroledescription busy checked colcount colindex colindextext colspan controls current describedby description details disabled "
        "dropeffect errormessage expanded flowto grabbed haspopup hidden invalid keyshortcuts label labelledby level live modal multiline multiselectable orientation owns placeholder posinset "
        "pressed readonly relevant required roledescription rowcount rowindex rowindextext rowspan selected setsize sort valuemax valuemin valuenow valuetext"
    ).split()
)
ARIA_UNSUPPORTED = _set("base col colgroup head html link meta param script slot source style template title track")
GENERIC_LINK = ("read more", "learn more", "click here", "more", "link", "here")
SCRIPT_TYPES = ("text/javascript", "module", "importmap", "speculationrules", "application/ld+json")
NOT_JAVASCRIPT = ("application/json", "application/ld+json", "text/template", "text/html", "text/x-template")
AUTOCOMPLETE_TYPES = ("color", "date", "datetime-local", "email", "month", "number", "password", "range", "search", "tel", "text", "time", "url", "week")
NON_EMPTY_ATTRIBUTES = ("id", "class", "name", "for", "src", "href", "title", "data", "role")
NAME_RESTRICTED = _set("h1 h2 h3 h4 h5 h6 strong em i p b code")
# Event handler attributes of HTML, by the kind of event.
EVENT_HANDLERS = _set(
    "onafterprint onbeforeprint onbeforeunload onerror onhashchange onlanguagechange onload onmessage onmessageerror onoffline ononline onpagehide onpageshow onpopstate onrejectionhandled onresize onstorage onunhandledrejection onunload "
    "onblur onchange onfocus onformdata oninput oninvalid onreset onsearch onselect onsubmit "
    "onkeydown onkeypress onkeyup "
    "onauxclick onclick oncontextmenu ondblclick onmousedown onmouseenter onmouseleave onmousemove onmouseout onmouseover onmouseup onwheel "
    "ondrag ondragend ondragenter ondragleave ondragover ondragstart ondrop "
    "oncopy oncut onpaste "
    "onabort oncanplay oncanplaythrough oncuechange ondurationchange onemptied onended onloadeddata onloadedmetadata onloadstart onpause onplay onplaying onprogress onratechange onseeked onseeking onstalled onsuspend ontimeupdate onvolumechange onwaiting "
    "onscroll onscrollend "
    "onbeforematch onbeforetoggle oncancel onclose oncontextlost oncontextrestored onsecuritypolicyviolation onslotchange ontoggle"
)
