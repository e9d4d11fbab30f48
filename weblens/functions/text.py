"""Column-expression builders (all JVM-side, no Python UDFs).

Every helper takes and returns a ``pyspark.sql.Column`` so it can sit inside
a whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblens.functions import lists as L

_WS_LOW = "".join(c for c in L.JS_WS_CHARS if c < "\u0100")
_WS_HIGH = "".join(c for c in L.JS_WS_CHARS if c >= "\u0100")
#: A run of JavaScript whitespace. The pattern engine looks at the members of a class one
#: by one: those beyond U+00FF are looked at only for a character that lies there.
WS_RUN = f"[{_WS_LOW}[\u0100-\uffff&&[{_WS_HIGH}]]]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c, f) -> Column:
    """``f`` of an expression that runs once, however often ``f`` names it: inside a
    higher-order function it would run again for every element."""
    return F.transform(F.array(c), f)[0]


def clean_text(c) -> Column:
    """Collapse every run of (JavaScript) whitespace to one space and trim."""
    return F.trim(F.regexp_replace(col_(c), WS_RUN, " "))


def js_trim(c) -> Column:
    """String.prototype.trim: strip JavaScript whitespace at both ends."""
    return F.btrim(col_(c), F.lit(L.JS_WS_CHARS))


def escape_html(c) -> Column:
    """Escape & < > \" (ampersand first)."""
    c = col_(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: A reference with its semicolon or the character that may stand for it, or text without one.
ENTITY_RX = "(?s)&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*)[;=]?|[^&]+|&"


def _table(names: list[str], chars: list[str]) -> Column:
    """Names and what they stand for as one string: a map would be held, and sent
    with every task, as thousands of values, and is searched one by one too."""
    return F.lit("\u0001" + "".join(f"{n}\u0002{c}\u0001" for n, c in zip(names, chars)))


def _look(table: Column, name: Column) -> Column:
    """What a name of ``_table`` stands for, null for any other."""
    key = F.concat(F.lit("\u0001"), name, F.lit("\u0002"))
    after = F.call_function("substring_index", table, key, F.lit(-1))
    return F.when(F.instr(table, key) > 0, F.substring_index(after, "\u0001", 1))


def _decode(c, attribute: bool) -> Column:
    """Decode character references in one pass from left to right, so nothing is
    decoded twice (strings without '&' are returned as they are). A name without
    its semicolon counts up to its longest accepted beginning; inside an attribute
    only if neither a letter, a digit nor '=' follows."""
    c = col_(c)
    full, legacy = _table(L.ENTITY_NAMES, L.ENTITY_CHARS), _table(L.LEGACY_NAMES, L.LEGACY_CHARS)
    # most references are among the names that count without a semicolon: a short table

    def number(t):
        digits = F.regexp_extract(t, "^&#[xX]?0*([0-9A-Fa-f]*)[;=]?$", 1)
        n = F.when(t.rlike("^&#[xX]"), F.when(F.length(digits) <= 6, F.conv(digits, 16, 10).cast("int"))) \
            .otherwise(F.when(F.length(digits) <= 7, F.try_to_number(digits, F.lit("9999999")).cast("int")))
        return F.concat(code_point(F.coalesce(n, F.lit(0))), F.when(t.endswith("="), F.lit("=")).otherwise(F.lit("")))

    def short(t):
        tries = []
        for n in L.LEGACY_LENGTHS:
            ok = F.length(t) > n
            if attribute:
                ok = ok & (F.rtrim(t, F.lit(";")) == F.substring(t, 1, n + 1))
            tries.append(F.when(ok, F.concat(_look(legacy, F.substring(t, 2, n)), F.substring(t, n + 2, 1 << 30))))
        return F.coalesce(*tries, t)

    def one(t):
        name = F.substring(t, 2, 40)
        named = F.when(t.endswith(";"), F.coalesce(_look(legacy, F.rtrim(name, F.lit(";"))), _look(full, name)))
        return F.when(F.length(t) < 3, t).when(t.rlike("^&#"), number(t)).when(t.startswith("&"), F.coalesce(named, short(t))).otherwise(t)

    return F.when(F.instr(c, "&") > 0, F.array_join(F.transform(F.regexp_extract_all(c, F.lit(ENTITY_RX), 0), one), "")).otherwise(c)


def decode_entities(c) -> Column:
    """Text with its character references decoded."""
    return _decode(c, False)


def decode_attribute(c) -> Column:
    """Attribute value with its character references decoded."""
    return _decode(c, True)


def code_point(n: Column) -> Column:
    """Character for a numeric reference (128 to 159 as the code page has
    them, invalid ones as U+FFFD)."""
    ok = (n > 0) & (n <= 0x10FFFF) & ~((n >= 0xD800) & (n <= 0xDFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(ok, F.translate(char, L.CP1252_FROM, L.CP1252_TO)).otherwise(F.lit("\ufffd"))


CONTROL = r"\x{01}-\x{1F}\x{7F}"


def css_escape(c) -> Column:
    """CSS.escape for identifiers: specials get a backslash; control characters
    and a leading digit (or '-' + digit) become hex escapes."""
    c = col_(c)
    e = F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("\ufffd")), r"([^A-Za-z0-9_\-\x{80}-\x{10FFFF}" + CONTROL + "])", r"\\$1")
    e = F.regexp_replace(e, r"^([0-9])", "\\\\3$1 ")
    e = F.regexp_replace(e, r"^-([0-9])", "-\\\\3$1 ")
    # most names are plain, which one pattern tells
    plain = c.rlike(r"\A-?[A-Za-z_][A-Za-z0-9_\-]*\z")
    control = F.array_join(F.transform(F.regexp_extract_all(e, F.lit("(?s)."), 0), lambda x: F.when(
        x.rlike(f"[{CONTROL}]"), F.concat(F.lit("\\"), F.lower(F.hex(F.ascii(x))), F.lit(" "))).otherwise(x)), "")
    e = F.when(c.rlike(f"[{CONTROL}]"), control).otherwise(e)
    return F.when(plain, c).when(c == "-", F.lit("\\-")).otherwise(e)


def xpath_literal(c) -> Column:
    """XPath string literal; strings with a double quote become concat(...)."""
    c = col_(c)
    return F.when(
        F.instr(c, '"') > 0,
        F.concat(F.lit('concat("'), F.replace(c, F.lit('"'), F.lit('",\'"\',"')), F.lit('")')),
    ).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def json_quote(c) -> Column:
    """JSON.stringify of a string."""
    c = col_(c)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                 ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def estimate_tokens(c) -> Column:
    """ceil(chars / 4); 0 for empty or null."""
    c = col_(c)
    return F.coalesce(F.ceil(F.length(c) / F.lit(L.CHARS_PER_TOKEN)), F.lit(0)).cast("long")


def count_lines(c) -> Column:
    c = col_(c)
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.size(F.split(c, "\n", -1))).cast("long")


def truncate_lines(c, max_lines) -> Column:
    """Keep the first N lines and append '... [truncated k more lines]'."""
    c = col_(c)
    lines = F.split(c, "\n", -1)
    n = F.size(lines)
    m = F.lit(max_lines) if not isinstance(max_lines, Column) else max_lines
    return F.when(n <= m, c).otherwise(
        F.concat(
            F.array_join(F.slice(lines, 1, m), "\n"),
            F.lit("\n... [truncated "), (n - m).cast("string"), F.lit(" more lines]"),
        )
    )


def with_context_header(c, chain, include_context=True) -> Column:
    """Prefix 'CONTEXT: a > b' and a blank line when the chain is non-empty."""
    c = col_(c)
    if not include_context:
        return c
    chain = col_(chain)
    return F.when(
        F.size(chain) > 0,
        F.concat(F.lit("CONTEXT: "), F.array_join(chain, " > "), F.lit("\n\n"), c),
    ).otherwise(c)


def finalize_output(c, chain, include_context=True, max_lines=L.DEFAULTS["truncationThreshold"]) -> Column:
    return truncate_lines(with_context_header(F.coalesce(col_(c), F.lit("")), chain, include_context), max_lines)
