"""Attributes of an open tag, and the flags that hide or skip an element."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblens.functions import lists as L
from weblens.functions.text import decode_attribute

ATTR_RX = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""

STYLE_DISPLAY_NONE = r"(?i)(^|;)\s*display\s*:\s*none\s*(!\s*important\s*)?(;|$)"
STYLE_OPACITY_0 = r"(?i)(^|;)\s*opacity\s*:\s*(0+\.?0*|\.0+)%?\s*(!\s*important\s*)?(;|$)"
#: One declaration of visibility: its value, and whether it is important.
STYLE_VISIBILITY = r"(?i)(?:^|;)\s*visibility\s*:\s*([a-z-]+)\s*(!\s*important)?"


#: White space of a pattern's ``\\s``.
SPACE = " \t\n\x0b\f\r"


def parse_attrs(raw) -> F.Column:
    """Ordered ``array<struct<name,value>>`` of an open tag (names lower-cased,
    values entity-decoded; duplicates not yet removed). One pass of the pattern
    finds the attributes, each is then cut at its equals sign."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    body = F.regexp_replace(raw, r"^<[A-Za-z][^\s/>]*", "")
    found = F.regexp_extract_all(body, F.lit(ATTR_RX), 0)
    cut = F.transform(found, lambda m: F.struct(
        F.lower(F.rtrim(F.substring_index(m, "=", 1), F.lit(SPACE))).alias("name"),
        F.when(F.instr(m, "=") > 0, F.ltrim(F.substring(m, F.instr(m, "=") + 1, F.length(m)), F.lit(SPACE))).otherwise(F.lit("")).alias("value")))
    quoted = lambda v: v.startswith('"') | v.startswith("'")
    bare = F.transform(cut, lambda a: F.struct(
        a["name"].alias("name"), F.when(quoted(a["value"]), F.substring(a["value"], F.lit(2), F.length(a["value"]) - 2)).otherwise(a["value"]).alias("value")))
    attrs = F.transform(bare, lambda a: F.struct(a["name"].alias("name"), decode_attribute(a["value"]).alias("value")))
    return F.when(raw.rlike(r"^<[A-Za-z][^\s/>]*>$"), F.array().cast("array<struct<name:string,value:string>>")).otherwise(attrs)


def first_wins(arr) -> F.Column:
    """Attributes without later ones of the same name. ``arr`` is bound once: inside
    the inner function its expression would run again for every attribute."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    one = F.transform(F.array(arr), lambda a: F.when(F.size(a) < 2, a).otherwise(
        F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: y["name"] == x["name"]))))
    return one[0]


def value_of(attrs, name: str) -> F.Column:
    """Value of an attribute, null without it."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(1))["value"]


def hides(tag, attrs) -> F.Column:
    """What hides an element by itself, whatever it stands in, but for its
    ``hidden`` attribute and its visibility."""
    style = F.coalesce(value_of(attrs, "style"), F.lit(""))
    told = (
        (F.coalesce(value_of(attrs, "aria-hidden"), F.lit("")) == "true")
        | style.rlike(STYLE_DISPLAY_NONE) | style.rlike(STYLE_OPACITY_0)
        | ((tag == "input") & (F.lower(F.coalesce(value_of(attrs, "type"), F.lit(""))) == "hidden"))
    )
    # most elements have no attribute to look at
    return tag.isin(L.UA_HIDDEN_TAGS) | ((F.size(attrs) > 0) & told) | ((tag == "dialog") & value_of(attrs, "open").isNull())


def declared_visibility(attrs) -> F.Column:
    """``hidden`` or ``visible`` as an element's inline style sets it, null where
    it inherits: the last important declaration, else the last one."""
    style = F.coalesce(value_of(attrs, "style"), F.lit(""))
    rx = F.lit(STYLE_VISIBILITY)
    found = F.filter(F.arrays_zip(F.transform(F.regexp_extract_all(style, rx, 1), lambda v: F.lower(v)).alias("v"), F.regexp_extract_all(style, rx, 2).alias("i")),
                     lambda d: d["v"].isin(L.VISIBILITY_VALUES))
    loud = F.filter(found, lambda d: d["i"] != "")
    last = F.try_element_at(F.when(F.size(loud) > 0, loud).otherwise(found), F.lit(-1))["v"]
    return F.when(F.lower(style).contains("visibility"), F.when(last == "hidden", "hidden").when(last.isin("visible", "collapse", "initial"), "visible"))
