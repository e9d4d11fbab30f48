"""Element table from raw HTML, built only from windows over ``page_id``.

Plan (one shuffle: ``pages`` is hash-partitioned by ``page_id`` once; every
window below is partitioned by ``page_id`` plus other keys, which that
partitioning already satisfies):

1. ``tokens``: ``regexp_extract_all`` + ``posexplode``. Raw-text elements
   (script, style, title, ...) are one regex match, split into an open-tag row
   at ``4k`` and a text row at ``4k+1``; every other match sits at ``4k``.
2. End positions (exclusive):
   * leaves (void, raw text, ``/>`` inside svg or math): ``pos + 1`` (raw text ``pos + 2``);
   * ``p``: at the next ``</p>`` (inclusive), the next start tag that closes
     a ``p``, or the next non-phrasing end tag;
   * strong: the matching end tag of the same name and nesting level
     (running open/close count per ``(page, tag)``, then ``lead`` per level);
   * optional-end elements (``li``, ``dt``, ``dd``, ``tr``, ``td``, ...) without
     a matching end tag: at the next sibling start tag or list end tag;
   * weak (unclosed, e.g. ``<b>``): at the end of the innermost element of
     the three kinds above (running depth, then ``last_value`` per depth).
3. Clipping: an element never outlives its container. Pages where some element
   does (``<div><span></div></span>``) are found by the same running depth; their
   ends are cut by a stack over the page's elements in document order, each pushed
   and popped once.
4. One sweep over open/end/text events gives parents (``last_value`` per
   ``(page, level)`` over container/child rows) and, with them, the declared shadow
   roots: the first ``<template shadowrootmode>`` of an element that can hold one.
   An open root becomes a ``shadow`` row whose content belongs to its host (one
   level below it, in a tree scope of its own); content of a closed root or of any
   other ``template`` leaves the table.
5. Running sums over the same events give depth, numbers of enclosing elements
   that hide or skip their subtree, the SVG flag and sizes; per scope level they
   give the byte offsets of the text inside each element, so an element's text
   holds none of the shadow roots below it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from weblens.functions import lists as L
from weblens.functions.text import WS_RUN, decode_entities
from weblens.operators.attrs import declared_visibility, first_wins, hides, parse_attrs, value_of

RAW_TAGS = L.RAW_TEXT_TAGS + L.RCDATA_TAGS

# Tokenizer (valid for Java regex and RE2: no look-around, no back-references).
# A tag's name ends at white space, "/" or ">"; "<" before anything that starts
# no tag is text; "<!", "<?" and "</" before a non-letter are skipped.
_IN_TAG = "[^\"'>]*(?:\"[^\"]*\"[^\"'>]*|'[^']*'[^\"'>]*)*"
_RAW_END = r"(?:[\s/][^>]*)?>"
TOKEN_RX = (
    r"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</[^a-z>][^>]*>|</>|"
    + "|".join(f"<{t}(?:[\\s/]{_IN_TAG})?>.*?</{t}{_RAW_END}" for t in RAW_TAGS)
    + f"|</?[a-z]{_IN_TAG}>"
    + "|(?:[^<]|<[^a-z/!?<])[^<]*(?:<[^a-z/!?<][^<]*)*|<"
)
TAG_RX = r"^</?([A-Za-z][^\s/>]*)"
_RAW_OPEN = r"<[A-Za-z]+(?:[\s/]" + _IN_TAG + ")?>"
RAW_OPEN_RX = "(?s)^" + _RAW_OPEN
RAW_INNER_RX = "(?s)^" + _RAW_OPEN + "(.*)</[A-Za-z]+" + _RAW_END + "$"
RAW_END_RX = "</[A-Za-z]+" + _RAW_END + "$"
UNB = Window.unboundedPreceding
CUR = Window.currentRow


def tokens(pages: DataFrame) -> DataFrame:
    """``tokens(page_id, pos, kind, tag, raw, leaf, raw_el, text)``; kind in open|close|text|skip,
    ``raw`` of start tags only.

    ``pages`` should already be partitioned by ``page_id`` (see ``partition_pages``).
    """
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN_RX), 0)).alias("k", "raw"))
    marked = F.col("raw").startswith("<")  # most tokens are text, which no pattern need read
    tag = F.when(marked, F.lower(F.regexp_extract("raw", TAG_RX, 1))).otherwise(F.lit(""))
    kind = (
        F.when(~marked, "text")
        .when(F.col("raw").rlike("^<[!?]|^</[^A-Za-z]"), "skip")
        .when(F.col("raw").rlike("^</[A-Za-z]"), "close")
        .when(F.col("raw").rlike("^<[A-Za-z]"), "open")
        .otherwise("text")
    )
    t = t.select("page_id", "k", "raw", kind.alias("kind"), tag.alias("tag"))
    # "/>" closes an element in SVG and MathML only
    own = F.col("tag").isin("svg", "math")
    depth = F.when(own & (F.col("kind") == "open") & ~F.col("raw").endswith("/>"), 1).when(own & (F.col("kind") == "close"), -1).otherwise(0)
    t = t.withColumn("foreign", own | (F.sum(depth).over(Window.partitionBy("page_id").orderBy("k").rowsBetween(UNB, CUR)) > 0))
    is_raw = (F.col("kind") == "open") & F.col("tag").isin(RAW_TAGS) & F.col("raw").rlike(RAW_END_RX)
    base = (F.col("k") * 4).cast("long")
    inner = F.regexp_extract("raw", RAW_INNER_RX, 1)
    inner_text = F.when(F.col("tag").isin(L.RAW_TEXT_TAGS), inner).otherwise(decode_entities(inner))
    leaf = (F.col("kind") == "open") & (F.col("tag").isin(L.VOID_TAGS) | (F.col("foreign") & F.col("raw").endswith("/>")))

    def row(pos, kind, tag, raw, leaf, raw_el, text):
        return F.struct(pos.alias("pos"), kind.alias("kind"), tag.alias("tag"), raw.alias("raw"),
                        leaf.alias("leaf"), raw_el.alias("raw_el"), text.alias("text"))

    text_of = F.when(F.col("kind") == "text", decode_entities("raw"))
    rows = F.when(
        is_raw,
        F.array(
            row(base, F.lit("open"), F.col("tag"), F.regexp_extract("raw", RAW_OPEN_RX, 0), F.lit(True),
                F.lit(True), F.lit(None).cast("string")),
            row(base + 1, F.lit("text"), F.lit(""), inner, F.lit(False), F.lit(False), inner_text),
        ),
    ).otherwise(F.array(row(base, F.col("kind"), F.col("tag"), F.col("raw"), leaf, F.lit(False), text_of)))
    out = t.select("page_id", F.inline(rows))
    # a text is known decoded, and nothing reads an end tag again: only start tags keep their markup
    out = out.filter(~((F.col("kind") == "text") & (F.col("raw") == "")))
    return out.withColumn("raw", F.when(F.col("kind") == "open", F.col("raw")))


def _with_ends(tok: DataFrame) -> DataFrame:
    """Adds ``e1_end`` (elements whose end is known locally) and ``page_end``."""
    kind, tag, pos = F.col("kind"), F.col("tag"), F.col("pos")
    is_open, is_close = kind == "open", kind == "close"
    nonleaf = is_open & ~F.col("leaf")

    # strong end: same tag, same nesting level, next token is a close
    t = tok.withColumn("ptag", F.when(nonleaf | is_close, tag))
    w_tag = Window.partitionBy("page_id", "ptag").orderBy("pos").rowsBetween(UNB, CUR)
    s = F.sum(F.when(nonleaf, 1).when(is_close, -1).otherwise(0)).over(w_tag)
    t = t.withColumn("lvl", F.when(is_open, s).otherwise(s + 1))
    w_lvl = Window.partitionBy("page_id", "ptag", "lvl").orderBy("pos")
    strong = F.when(nonleaf & (F.lead("kind").over(w_lvl) == "close"), F.lead("pos").over(w_lvl) + 1)
    t = t.withColumn("strong_end", strong)

    # next boundaries (descending order, frame = strictly later tokens)
    w_next = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(UNB, -1)
    w_all = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(UNB, Window.unboundedFollowing)

    def nxt(cond):
        return F.min(F.when(cond, pos)).over(w_next)

    p_end = F.least(
        nxt(is_close & (tag == "p")) + 1,
        nxt(is_open & tag.isin(L.P_CLOSERS)),
        nxt(is_close & ~tag.isin(L.PHRASING_TAGS) & (tag != "p")),
        F.col("page_end"),
    )
    t = t.withColumn("page_end", F.max("pos").over(w_all) + 4)
    e1 = F.when(tag == "p", p_end).when(F.col("strong_end").isNotNull(), F.col("strong_end"))
    for name, starts, ends in L.OPTIONAL_END:
        e1 = e1.when(tag == name, F.least(nxt((is_open & tag.isin(starts)) | (is_close & tag.isin(ends))),
                                          F.col("page_end")))
    return t.withColumn("e1_end", F.when(nonleaf, e1)).drop("ptag", "lvl", "strong_end")


def _struct(**kw):
    return F.struct(*[v.alias(k) for k, v in kw.items()])


def _null_long():
    return F.lit(None).cast("long")


def _weak_ends(t: DataFrame) -> DataFrame:
    """End of every element. Unclosed elements end with their innermost
    explicitly-ended container (running depth over explicit elements, then
    ``last_value`` of the container end per depth). Text rows pass through."""
    kind = F.col("kind")
    nonleaf = (kind == "open") & ~F.col("leaf")
    is_e1 = nonleaf & F.col("e1_end").isNotNull()
    pos = F.col("pos")
    ev = F.when(is_e1, F.array(
        _struct(ev_pos=pos, ord=F.lit(1), delta=F.lit(1), cend=F.col("e1_end"), role=F.lit("e1")),
        _struct(ev_pos=F.col("e1_end"), ord=F.lit(0), delta=F.lit(-1), cend=_null_long(), role=F.lit("end")),
    )).when(nonleaf, F.array(
        _struct(ev_pos=pos, ord=F.lit(2), delta=F.lit(0), cend=_null_long(), role=F.lit("weak")),
    )).when((kind == "open") | (kind == "text"), F.array(
        _struct(ev_pos=pos, ord=F.lit(3), delta=F.lit(0), cend=_null_long(), role=F.lit("pass")),
    )).otherwise(F.array().cast("array<struct<ev_pos:bigint,ord:int,delta:int,cend:bigint,role:string>>"))
    e = t.select("page_id", "pos", "kind", "tag", "raw", "raw_el", "text", "page_end", F.inline(ev))
    starts = F.col("role") != "end"  # an end event is dropped below and needs no text
    e = e.withColumn("raw", F.when(starts, F.col("raw"))).withColumn("text", F.when(starts, F.col("text")))
    w = Window.partitionBy("page_id").orderBy("ev_pos", "ord", F.desc("pos")).rowsBetween(UNB, CUR)
    role = F.col("role")
    # an end event answers to the level of the element that it closes
    e = e.withColumn("d", F.sum("delta").over(w) + F.when(role == "end", 1).otherwise(0))
    w2 = Window.partitionBy("page_id", "d").orderBy("ev_pos", "ord", F.desc("pos")).rowsBetween(UNB, CUR)
    cont = F.last("cend", ignorenulls=True).over(w2)
    opener = F.last(F.when(role == "e1", pos), ignorenulls=True).over(w2)
    e = e.withColumn("crossing", (role == "end") & ~opener.eqNullSafe(pos)).withColumn("cont", cont)
    e = e.withColumn("misnested", F.max("crossing").over(Window.partitionBy("page_id")))
    cont = F.col("cont")
    end = (
        F.when(role == "e1", F.col("cend"))
        .when(role == "weak", F.when(F.col("d") == 0, F.col("page_end")).otherwise(cont))
        .when(kind == "open", pos + F.when(F.col("raw_el"), 2).otherwise(1))
    )
    return e.filter(role != "end").select("page_id", "pos", "kind", "tag", "raw", "text", "misnested", end.alias("end_pos"))


@F.arrow_udf(ArrayType(LongType()))
def _cut_ends(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Ends of a page's elements (in document order), each cut to the end of the
    innermost one still open: open ends only shrink up the stack, so every
    element is pushed and popped once."""
    out = []
    for pos, end in zip(starts.to_pylist(), ends.to_pylist()):
        stack: list[int] = []
        cut = []
        for p, e in zip(pos, end):
            while stack and stack[-1] <= p:
                stack.pop()
            if stack and stack[-1] < e:
                e = stack[-1]
            stack.append(e)
            cut.append(e)
        out.append(cut)
    return pa.array(out, pa.list_(pa.int64()))


def _clip(nodes: DataFrame) -> DataFrame:
    """Cut every end to the end of its container, on the pages that need it."""
    at = F.struct("pos", "end_pos")
    opens = (
        nodes.filter(F.col("misnested") & (F.col("kind") == "open"))
        .groupBy("page_id").agg(F.array_sort(F.collect_list(at)).alias("els"))
    )
    pos, end = F.transform("els", lambda e: e["pos"]), F.transform("els", lambda e: e["end_pos"])
    cuts = opens.select("page_id", pos.alias("starts"), _cut_ends(pos, end).alias("ends"))
    cuts = cuts.select("page_id", F.inline(F.arrays_zip(F.col("starts").alias("pos"), F.col("ends").alias("clipped"))))
    return nodes.join(cuts, ["page_id", "pos"], "left").withColumn("end_pos", F.coalesce("clipped", "end_pos")).drop("clipped", "misnested")


def _flags(nodes: DataFrame) -> DataFrame:
    """Attributes of open tags, and what they say about hiding and shadow roots."""
    is_open = F.col("kind") == "open"
    n = nodes.withColumn("attrs", F.when(is_open, first_wins(parse_attrs("raw")))).drop("raw")
    a, tag = F.col("attrs"), F.col("tag")
    template = is_open & (tag == "template")
    mode = F.lower(value_of(a, "shadowrootmode"))
    return n.select(
        "*", template.alias("template"), F.when(template & mode.isin("open", "closed"), mode).alias("mode"),
        F.when(is_open, hides(tag, a)).alias("hides"), F.when(is_open, value_of(a, "hidden").isNotNull()).alias("hidden_attr"),
        F.when(is_open & (F.size(a) > 0), declared_visibility(a)).alias("vis"), F.when(is_open, tag.isin(L.SKIP_TAGS)).alias("skip"),
    )


#: Running numbers of enclosing elements (the node itself included) that hide
#: their subtree, hide or skip it, do so but for svg, skip it, skip it but for svg.
SUPPRESSORS = ["n_hid", "n_hs", "n_hsn", "n_s", "n_sn"]


def _sweep(nodes: DataFrame) -> DataFrame:
    """Depth, parent, scope, text byte offsets, suppressor counts and SVG flag
    for elements, texts and shadow roots."""
    kind, pos = F.col("kind"), F.col("pos")
    zero = F.lit(0).cast("long")
    n = _flags(nodes).withColumn("ctext0", F.when(kind != "open", F.regexp_replace("text", WS_RUN, " ")))
    # attributes and texts ride along in one column, on a node's first event only; what
    # else is known of a node in another, so that a window copies few columns. The
    # windows know a text by its length and the spaces at its ends
    itype = n.select(F.struct("attrs", "text", "ctext0").alias("i")).schema["i"].dataType.simpleString()
    item, none = F.struct("attrs", "text", "ctext0").cast(itype), F.lit(None).cast(itype)
    nbytes, c0bytes = (F.coalesce(F.octet_length(c), zero).cast("long") for c in ("text", "ctext0"))
    n = n.select("page_id", "pos", "end_pos", "attrs", "text", "ctext0", F.struct(
        kind, F.col("tag"), (kind == "open").alias("element"), F.coalesce("template", F.lit(False)).alias("template"), F.col("mode"),
        F.col("hides"), F.col("hidden_attr"), F.col("vis"), F.col("skip"), nbytes.alias("nbytes"), c0bytes.alias("c0bytes"),
        F.when(F.col("ctext0") != "", F.col("ctext0").startswith(" ")).alias("starts"),
        F.when(F.col("ctext0") != "", F.col("ctext0").endswith(" ")).alias("ends")).alias("self"))
    me = F.col("self")
    ev = F.when(me["element"], F.array(
        _struct(ev_pos=pos, ord=F.lit(1), delta=F.lit(1), role0=F.lit("open"), item=item),
        _struct(ev_pos=F.col("end_pos"), ord=F.lit(0), delta=F.lit(-1), role0=F.lit("end"), item=none),
    )).otherwise(F.array(_struct(ev_pos=pos, ord=F.lit(1), delta=F.lit(0), role0=F.lit("text"), item=item)))
    order = ["ev_pos", "ord", F.desc("pos")]
    w = Window.partitionBy("page_id").orderBy(*order).rowsBetween(UNB, CUR)
    e = n.select("page_id", "pos", "end_pos", "self", F.inline(ev))
    # no template is an svg, and what a template holds opens and ends inside it
    svg = F.when(me["tag"] == "svg", F.col("delta")).otherwise(0)
    e = e.select("*", F.sum("delta").over(w).alias("cnt"), F.sum(svg).over(w).alias("svgc"))
    # at its end event an svg element has just left the count
    e = e.withColumn("in_svg", F.col("svgc") - F.least(svg, F.lit(0)) > 0).drop("svgc")

    # parents, and which templates are shadow roots
    role0 = F.col("role0")
    roles = (
        F.when(role0 == "open", F.array(_struct(role=F.lit("child"), key=F.col("cnt") - 1), _struct(role=F.lit("cont"), key=F.col("cnt"))))
        .when(role0 == "text", F.array(_struct(role=F.lit("child"), key=F.col("cnt"))))
        .otherwise(F.array(_struct(role=F.lit("end"), key=F.col("cnt"))))
    )
    r = e.select("*", F.inline(roles)).withColumn("item", F.when(F.col("role") == "child", F.col("item")))
    w3 = Window.partitionBy("page_id", "key").orderBy("ev_pos", "ord").rowsBetween(UNB, CUR)
    child, cont = F.col("role") == "child", F.col("role") == "cont"
    # the level's last container is the parent; a declaring template after it is a rival
    r = r.select(
        "*", F.last(F.when(cont, F.struct(F.col("pos"), me["tag"].alias("tag"))), ignorenulls=True).over(w3).alias("parent"),
        F.last(F.when(cont, False).when(child & me["mode"].isNotNull(), True), ignorenulls=True).over(w3.rowsBetween(UNB, -1)).alias("rival"))
    host = F.col("parent.tag").isin(L.SHADOW_HOST_TAGS) | F.col("parent.tag").contains("-")
    root = F.when(F.coalesce(host & ~F.col("rival"), F.lit(False)), me["mode"])
    r = r.withColumn("root", F.when(child, root))
    # the last child of the level before an end event is the element that ends
    r = r.withColumn("root", F.when(F.col("role") == "end", F.last(F.when(child, F.struct("root")), ignorenulls=True).over(w3)["root"]).otherwise(F.col("root")))
    e = r.filter("role <> 'cont'").withColumn("parent_pos", F.when(child, F.col("parent.pos"))).drop("parent", "key", "rival", "role")

    # content of closed roots and plain templates is inert: neither counted nor listed
    open_root = F.coalesce(F.col("root") == "open", F.lit(False))
    own = F.when(me["template"] & ~open_root, F.col("delta")).otherwise(0)
    e = e.withColumn("inert", F.sum(own).over(w) - F.greatest(own, F.lit(0)) > 0)
    e = e.filter(~F.col("inert") & ~F.coalesce(F.col("root") == "closed", F.lit(False))).drop("inert")
    e = e.withColumn("is_root", open_root).drop("root")
    element = me["element"] & ~F.col("is_root")
    delta = F.when(element, F.col("delta")).otherwise(0)
    e = e.withColumn("own_hidden", F.coalesce(element & (me["hides"] | (me["hidden_attr"] & ~F.col("in_svg")) | F.coalesce(me["vis"] == "hidden", F.lit(False))), F.lit(False)))
    h, s = F.col("own_hidden"), F.coalesce(element & me["skip"], F.lit(False))
    plain = s & (me["tag"] != "svg")
    e = e.select(
        "*", F.sum(F.when(F.col("is_root"), F.col("delta")).otherwise(0)).over(w).alias("sl0"),
        F.sum(F.when(me["vis"].isNotNull(), delta).otherwise(0)).over(w).alias("vlevel"),
        F.sum(F.when(element & (role0 == "open"), 1).otherwise(0)).over(w).alias("ec"),
        F.sum(F.when(role0 == "text", 1).otherwise(0)).over(w).alias("tc"),
        *[F.sum(F.when(flag, delta).otherwise(0)).over(w).alias(name) for name, flag in zip(SUPPRESSORS, (h, h | s, h | plain, s, plain))])
    # a shadow root stands in its host's scope and opens the level of its own
    slevel = F.col("sl0") - F.when(F.col("is_root") & (role0 == "open"), 1).otherwise(0)
    level = F.col("cnt") - F.when(role0 == "open", 1).otherwise(0) - F.col("slevel")
    # what the text offsets do not need rides along as well
    e = e.withColumn("slevel", slevel).select(
        "page_id", "pos", "ev_pos", "ord", "role0", "is_root", "self", "item", "parent_pos", (F.col("slevel") + F.when(F.col("is_root"), 1).otherwise(0)).alias("sl"),
        F.struct("end_pos", level.alias("depth"), "slevel", "in_svg", "own_hidden", "vlevel", "ec", "tc", *SUPPRESSORS).alias("at"))

    # text offsets, per scope level; white space collapses across its text nodes: a
    # text node gives up its first space if the text before it ends in one
    at, end = F.col("at"), role0 == "end"
    ws = Window.partitionBy("page_id", "sl").orderBy(*order).rowsBetween(UNB, CUR)
    scope = F.last(F.when(F.col("is_root") & (role0 == "open"), F.struct("pos", "parent_pos")), ignorenulls=True).over(ws)
    before = F.last(me["ends"], ignorenulls=True).over(ws.rowsBetween(UNB, -1))
    size = lambda c: F.when(role0 == "text", me[c]).otherwise(zero)
    e = e.select("*", before.alias("before"), scope.alias("scope0"), F.sum(size("nbytes")).over(ws).alias("tb"))
    given = F.coalesce(F.col("before") & me["starts"], F.lit(False))
    e = e.withColumn("given", given).drop("before")
    cbytes = size("c0bytes") - F.col("given").cast("long")
    ctext = F.when(F.col("given"), F.substring("item.ctext0", 2, 1 << 30)).otherwise(F.col("item.ctext0"))
    e = e.withColumn("cb", F.sum(cbytes).over(ws))
    here = F.when(~F.col("is_root"), F.col("scope0"))
    via = F.coalesce(F.col("parent_pos") == here["pos"], F.lit(False))

    keep = lambda c: F.max(F.when(~end, c))
    at_end = lambda c: F.max(F.when(end & ~F.col("is_root"), c))
    return e.groupBy("page_id", "pos").agg(
        keep(F.when(F.col("is_root"), F.lit("shadow")).otherwise(me["kind"])).alias("kind"),
        keep(F.when(F.col("is_root"), F.lit("#shadow-root")).otherwise(me["tag"])).alias("tag"),
        keep(F.when(~F.col("is_root"), F.col("item.attrs"))).alias("attrs"),
        keep(F.col("item.text")).alias("text"), keep(at["end_pos"]).alias("end_pos"),
        keep(F.when(via, here["parent_pos"]).otherwise(F.col("parent_pos"))).alias("parent_pos"),
        keep(at["depth"]).alias("depth"), keep(at["slevel"]).alias("slevel"), keep(here["pos"]).alias("scope"),
        keep(via).alias("via_shadow"), keep(at["in_svg"]).alias("in_svg"),
        keep(at["own_hidden"]).alias("own_hidden"), keep(me["vis"]).alias("vis"), keep(at["vlevel"]).alias("vlevel"),
        *[keep(at[c]).alias(c) for c in SUPPRESSORS],
        keep(F.col("tb") - size("nbytes")).alias("text_start"), at_end(F.col("tb")).alias("text_end"),
        keep(ctext).alias("ctext"), keep(F.col("cb") - cbytes).alias("ctext_start"), at_end(F.col("cb")).alias("ctext_end"),
        (at_end(at["ec"]) - keep(at["ec"])).alias("n_desc"), (at_end(at["tc"]) - keep(at["tc"])).alias("n_text_desc"),
    )


def partition_pages(pages: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """The only shuffle of the tree build: co-locate every page's rows."""
    if num_partitions:
        return pages.repartition(num_partitions, "page_id")
    return pages.repartition("page_id")


#: HTML bytes of a partition: what a task holds, sorts and writes is a fixed multiple.
PARTITION_BYTES = 4 << 20


def partitions_for(pages: DataFrame, least: int = 1, target: int | None = None) -> int:
    """Partition count of pages by their HTML as it is tokenized, not as it is
    compressed in files (one scan), ``least`` at least."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    return max(least, -(-size // (target or PARTITION_BYTES)))


def build(pages: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``nodes``: elements, text nodes and open shadow roots (``kind`` open|text|shadow)
    with tree columns, in one chain of windows over the page partitioning. ``hold``
    may keep the rows that clipping reads twice."""
    t = _with_ends(tokens(pages))
    return _sweep(_clip(hold(_weak_ends(t))))
