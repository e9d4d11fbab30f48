"""Fixed value lists.

FIXED VALUES: the lists in the first block must equal the inspected tool's
own lists for results to match (attribute keep list, noise prefixes, skip and
void tags, style properties, ignored style values, output defaults and
limits). They are written out in their original order.

The second block holds HTML-parsing sets that come from the public HTML
standard (which start tags close an open ``p``, which tags are phrasing
content, which are raw text), used by our tree builder.
"""

from html.entities import html5

from pyspark.sql import DataFrame


def names_of(table: DataFrame, limit: int = 10_000) -> tuple[str, ...]:
    """The values of a table's first column, sorted, as a job's own list (attribute
    names to keep, beginnings of noise). They go into the plan, so a table of more
    than ``limit`` different values is refused."""
    column = table.columns[0]
    rows = table.select(column).filter(f"`{column}` IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} names: too many for a list in the plan")
    return tuple(sorted(r[0] for r in rows))


# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour)
# ---------------------------------------------------------------------------

# Attributes that are always kept when cleaning markup.
KEEP_ATTRS = [
    "id", "class", "href", "src", "alt", "title", "type", "name",
    "value", "placeholder", "action", "method", "target", "rel",
    "role", "aria-label", "aria-labelledby", "aria-describedby",
    "aria-hidden", "aria-expanded", "aria-controls", "aria-haspopup",
    "aria-selected", "aria-checked", "aria-disabled", "aria-live",
    "aria-atomic", "aria-busy", "aria-current", "aria-invalid",
    "aria-required", "aria-sort", "aria-valuenow", "aria-valuemin",
    "aria-valuemax", "aria-valuetext",
    "for", "tabindex", "disabled", "readonly", "required", "checked",
    "selected", "multiple", "maxlength", "minlength", "pattern",
    "min", "max", "step", "autocomplete", "autofocus",
    "contenteditable", "draggable", "spellcheck",
    "width", "height", "loading", "decoding", "fetchpriority",
    "colspan", "rowspan", "scope", "headers",
    "open", "download", "sandbox", "srcdoc",
    "data-testid", "data-cy", "data-test", "data-qa",
]

# Noise attribute name prefixes (each is an anchored prefix match).
NOISE_PREFIXES = [
    "data-analytics", "data-track", "data-gtm", "data-ga", "data-segment",
    "data-heap", "data-amplitude", "data-hotjar", "data-cb",
    "data-optimizely", "data-abtesting",
    "data-reactid", "data-react-checksum", "data-v-", "_ngcontent",
    "_nghost", "ng-",
    "data-n-head", "data-hid", "data-server-rendered", "jsaction",
    "jscontroller", "jsmodel", "jsname", "jsshadow", "jsslot",
    "bis_skin_checked", "data-bi-", "data-ux-", "data-aut", "data-testid",
]

# Tags skipped entirely in cleaned output (svg prints a placeholder).
SKIP_TAGS = ["script", "noscript", "style", "link", "meta", "svg", "iframe", "br"]

# Self-closing (void) tags.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
]

# Style properties reported per element, in report order.
STYLE_PROPERTIES = [
    "display", "position", "top", "right", "bottom", "left",
    "width", "height", "min-width", "min-height", "max-width", "max-height",
    "margin", "margin-top", "margin-right", "margin-bottom", "margin-left",
    "padding", "padding-top", "padding-right", "padding-bottom", "padding-left",
    "gap", "flex", "flex-direction", "justify-content", "align-items",
    "grid-template-columns", "grid-template-rows",
    "font-family", "font-size", "font-weight", "line-height", "letter-spacing",
    "color", "background", "background-color", "border", "border-radius",
    "box-shadow", "opacity", "overflow", "text-align", "object-fit",
    "z-index", "transform", "white-space", "text-transform", "text-decoration",
]

# Style values that carry no information.
EMPTY_STYLE_VALUES = ["none", "normal", "rgba(0, 0, 0, 0)", "auto", "0px", "0s"]

# Output formats.
FORMATS = ["clean-html", "structure", "html-css", "accessibility", "selectors", "page-snapshot"]

# Default settings (depth None = full subtree).
DEFAULTS = {
    "format": "clean-html",
    "depth": None,
    "includeContext": True,
    "includeCSS": True,
    "stripNoise": True,
    "keepTestIds": True,
    "truncationThreshold": 240,
    "maxTokenWarning": 8000,
    "includeHidden": False,
    "selectorMode": "balanced",
    "promptWrapper": False,
}

# Limits.
PREVIEW_CHARS = 120
CONTEXT_ANCESTORS = 6
SELECTOR_LEVELS = 5
SELECTOR_CLASSES = 2
SUMMARY_CLASSES = 3
TEXT_XPATH_MAX = 80
TEXT_XPATH_EXACT = 40
SNAPSHOT_HEADINGS = 20
SNAPSHOT_LANDMARKS = 25
CHARS_PER_TOKEN = 4

# Snapshot element groups.
HEADING_TAGS = ["h1", "h2", "h3"]
LANDMARK_TAGS = ["header", "nav", "main", "section", "aside", "footer"]
INPUT_TAGS = ["input", "textarea", "select"]

# Tags that can never be a selection root.
UNSELECTABLE_TAGS = ["html", "head", "script", "style"]

# URL prefixes of pages that cannot be captured.
RESTRICTED_URL_PREFIXES = ["chrome://", "chrome-extension://", "devtools://", "edge://", "about:", "file://"]

# Attributes tried for the shortest unique selector, in order.
SHORTEST_ATTRS = ["data-testid", "data-cy", "data-test", "data-qa", "name", "aria-label", "placeholder", "title"]

# Ranked selector scores.
SCORES = {
    "testid": 100, "data-cy": 98, "data-test": 97, "data-qa": 96, "id": 95,
    "name": 88, "aria-label": 80, "role+aria-label": 78, "role+text": 72,
    "href": 70, "class-chain": 60,
}

# ---------------------------------------------------------------------------
# HTML standard sets (tree building)
# ---------------------------------------------------------------------------

# Elements whose content is raw text (one token, never parsed as markup).
RAW_TEXT_TAGS = ["script", "style", "noscript", "iframe", "xmp"]
# Elements whose content is escapable raw text (entities decoded, no markup).
RCDATA_TAGS = ["title", "textarea"]

# Start tags that close an open p element.
P_CLOSERS = [
    "address", "article", "aside", "blockquote", "center", "details", "dialog",
    "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "dd",
    "dt", "listing", "main", "menu", "nav", "ol", "p", "plaintext", "pre",
    "search", "section", "summary", "table", "ul", "xmp",
]

# Phrasing (inline) content: their end tags do not end an open p.
PHRASING_TAGS = [
    "a", "abbr", "b", "bdi", "bdo", "big", "button", "canvas", "cite", "code",
    "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "map",
    "mark", "meter", "nobr", "object", "output", "picture", "progress", "q",
    "ruby", "rp", "rt", "s", "samp", "select", "slot", "small", "span",
    "strike", "strong", "sub", "sup", "svg", "math", "template", "textarea",
    "time", "tt", "u", "var", "video", "audio",
]

# Elements with optional end tags: (tag, start tags that end it, end tags that end it).
OPTIONAL_END = [
    ("li", ["li"], ["ul", "ol", "menu"]),
    ("dt", ["dt", "dd"], ["dl"]),
    ("dd", ["dt", "dd"], ["dl"]),
    ("option", ["option", "optgroup"], ["select", "datalist", "optgroup"]),
    ("tr", ["tr", "tbody", "thead", "tfoot"], ["table", "tbody", "thead", "tfoot"]),
    ("td", ["td", "th", "tr", "tbody", "thead", "tfoot"], ["tr", "table", "tbody", "thead", "tfoot"]),
    ("th", ["td", "th", "tr", "tbody", "thead", "tfoot"], ["tr", "table", "tbody", "thead", "tfoot"]),
]

# Elements hidden by the default style sheet.
UA_HIDDEN_TAGS = [
    "head", "title", "meta", "link", "script", "style", "template", "noscript",
    "base", "datalist", "area", "param", "rp",
]

# Values of the visibility property that set it or hand on the parent's.
VISIBILITY_VALUES = ["hidden", "visible", "collapse", "initial", "inherit", "unset", "revert", "revert-layer"]

# Elements that can hold a declared shadow root, besides those with a hyphen in
# their name.
SHADOW_HOST_TAGS = [
    "article", "aside", "blockquote", "body", "div", "footer", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "main", "nav", "p", "section", "span",
]

# Named character references: the HTML standard's table as Python's library has
# it (names with their semicolon), and the code page that stands in for the
# numeric references 128 to 159.
ENTITY_NAMES = [n for n in html5 if n.endswith(";")]
ENTITY_CHARS = [html5[n] for n in ENTITY_NAMES]
# The names that the standard also accepts without a semicolon.
LEGACY_NAMES = [n for n in html5 if not n.endswith(";")]
LEGACY_CHARS = [html5[n] for n in LEGACY_NAMES]
LEGACY_LENGTHS = sorted({len(n) for n in LEGACY_NAMES}, reverse=True)
CP1252_FROM = "".join(chr(n) for n in range(0x80, 0xA0))
CP1252_TO = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))

# JavaScript whitespace (String.prototype.trim, \s): ASCII plus Unicode spaces.
JS_WS_CHARS = (
    "\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
JS_WS_CLASS = "[" + JS_WS_CHARS + "]"
