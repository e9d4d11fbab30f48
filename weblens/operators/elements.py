"""Element, text-node and page-text tables on top of the window tree.

``elements``: one row per element with attributes, classes, sibling rank,
hidden flag, the columns that come from its nearest ancestors (class-chain
selector, context chain, parent) and the byte range of its text.

Ancestors are found without a range join: every node emits one *query* row for
each of its nearest ancestor levels and every element one *container* row at its
own level; ``last_value(container)`` over ``(page_id, level) ORDER BY pos`` is the
ancestor at that level. The rows are linear in the nodes however deep they lie.
Whole paths are made only where asked for, by pointer doubling (``with_paths``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import lists as L
from weblens.functions.text import WS_RUN, css_escape, js_trim

UNB = Window.unboundedPreceding
CUR = Window.currentRow

def summary_col(tag, id_, class_tokens, in_svg) -> F.Column:
    """``tag#id.c1.c2.c3`` (classes ignored on SVG elements)."""
    cls = F.array_join(F.transform(F.slice(class_tokens, 1, L.SUMMARY_CLASSES), lambda c: F.concat(F.lit("."), c)), "")
    return F.concat(
        tag,
        F.when(F.coalesce(id_, F.lit("")) != "", F.concat(F.lit("#"), id_)).otherwise(F.lit("")),
        F.when(in_svg, F.lit("")).otherwise(cls),
    )


def _base(nodes: DataFrame) -> DataFrame:
    """Element columns for ``kind = 'open'`` rows (null on the others)."""
    is_el = F.col("kind") == "open"
    n = nodes.withColumn("attr", F.map_from_entries("attrs"))
    a = F.col("attr")
    class_tokens = F.filter(F.split(js_trim(F.coalesce(a["class"], F.lit(""))), WS_RUN), lambda c: c != "")
    # siblings are the children of one parent, or of one shadow root
    w = Window.partitionBy("page_id", "parent_pos", "scope", "tag")
    # visibility is inherited: the last element that declares it, on the node's
    # level among such elements, is the nearest one around it
    wv = Window.partitionBy("page_id", "vlevel").orderBy("pos").rowsBetween(UNB, CUR)
    n = n.withColumn("seen", F.last("vis", ignorenulls=True).over(wv))
    unseen = is_el & (F.coalesce("vis", F.when(F.col("vlevel") > 0, F.col("seen"))) == "hidden")
    return n.select(
        *[c for c in n.columns if c not in ("vis", "vlevel", "seen")],
        F.when(is_el, F.coalesce(a["id"], F.lit(""))).alias("id"),
        F.when(is_el, class_tokens).alias("class_tokens"),
        F.when(is_el, F.array_distinct(class_tokens)).alias("classes"),
        F.when(is_el, F.row_number().over(w.orderBy("pos"))).cast("long").alias("nth_of_type"),
        F.when(is_el, F.count("*").over(w)).alias("n_same_tag"),
        F.when(is_el, F.col("own_hidden") | F.coalesce(unseen, F.lit(False))).alias("hidden"),
    )


def _parts(els: DataFrame) -> DataFrame:
    tag = F.col("tag")
    is_root_html = (F.col("depth") == 0) & (tag == "html")
    indexed = F.col("parent_pos").isNotNull() & (F.col("n_same_tag") > 1)
    sel_cls = F.array_join(F.transform(F.slice("classes", 1, L.SELECTOR_CLASSES), lambda c: css_escape(c)), ".")
    return els.select(
        "*",
        summary_col(tag, F.col("id"), F.col("class_tokens"), F.col("in_svg")).alias("summary"),
        F.when(is_root_html, F.lit("html")).otherwise(F.concat(
            tag, F.when(indexed, F.concat(F.lit(":nth-of-type("), F.col("nth_of_type").cast("string"), F.lit(")")))
            .otherwise(F.lit("")))).alias("css_part"),
        F.when(is_root_html, F.lit("/html")).otherwise(F.concat(
            tag, F.when(indexed, F.concat(F.lit("["), F.col("nth_of_type").cast("string"), F.lit("]")))
            .otherwise(F.lit("")))).alias("xpath_part"),
        F.concat(tag, F.when(F.size("classes") > 0, F.concat(F.lit("."), sel_cls)).otherwise(F.lit(""))).alias("sel_part"),
    )


INFO_FIELDS = ["pos", "depth", "tag", "summary", "sel_part", "id", "classes"]
#: Columns of a core node that the ancestor pass reads, and those that it adds.
WALKED = ["page_id", "kind", "slevel", "parent_pos", "ctext_start", "ctext_end", *INFO_FIELDS]
TOLD = ["preview", "hosts", "class_chain", "context", "place", "parent_tag", "parent_id", "parent_classes", "el_ord", "selector"]
NEAREST = max(L.CONTEXT_ANCESTORS, L.SELECTOR_LEVELS)


def _with_ancestors(n: DataFrame) -> DataFrame:
    """Every node gets ``chain``, its nearest ancestors (and itself, for elements;
    texts and shadow roots only their parent) outermost first, and ``hosts``, the hosts of the shadow roots around it.
    A shadow root of scope level s is the container of level -1 - s. The node's
    own columns ride along in ``self`` and are restored by ``first(ignorenulls)``."""
    cols = [c for c in n.columns]
    self_ = F.struct(*[F.col(c) for c in cols])
    kind, slevel = F.col("kind"), F.col("slevel")
    info = F.struct(F.when(kind == "shadow", F.col("parent_pos")).otherwise(F.col("pos")).alias("pos"), *[F.col(c) for c in INFO_FIELDS[1:]])
    itype = n.select(info.alias("i")).schema["i"].dataType.simpleString()
    stype = n.select(self_.alias("s")).schema["s"].dataType.simpleString()
    rtype = f"array<struct<level:bigint,ord:int,info:{itype},self:{stype}>>"
    empty = F.array().cast(rtype)

    def queries(cond, first, last):
        return F.when(cond, F.transform(F.sequence(first, last), lambda k: F.struct(
            k.alias("level"), F.lit(1).alias("ord"), F.lit(None).alias("info"), F.lit(None).alias("self")))).otherwise(F.array()).cast(rtype)

    own = F.array(F.struct(
        F.when(kind == "open", F.col("depth")).when(kind == "shadow", -2 - slevel).otherwise(-1).alias("level"), F.lit(0).alias("ord"),
        F.when(kind != "text", info).alias("info"), self_.alias("self"))).cast(rtype)
    # only elements show more of their ancestors than the nearest
    near = queries(F.col("depth") > 0, F.greatest(F.col("depth") - F.when(kind == "open", NEAREST).otherwise(1), F.lit(0)), F.col("depth") - 1)
    roots = queries(slevel > 0, F.lit(-2).cast("long"), -1 - slevel)
    r = n.select("page_id", F.col("pos").alias("node"), F.inline(F.flatten(F.array(own, near, F.coalesce(roots, empty)))))
    w = Window.partitionBy("page_id", "level").orderBy("node", "ord").rowsBetween(UNB, CUR)
    r = r.withColumn("anc", F.when(F.col("ord") == 1, F.last("info", ignorenulls=True).over(w))
                     .when(F.col("level") >= 0, F.col("info")))
    g = r.groupBy("page_id", "node").agg(
        F.first("self", ignorenulls=True).alias("self"),
        F.array_sort(F.collect_list(F.when(F.col("anc").isNotNull(), F.struct("level", "anc")))).alias("chain0"))
    # keep the grouping key itself (not self.page_id) so the page partitioning is still known downstream
    return g.select("page_id", *[F.col("self")[c].alias(c) for c in cols if c != "page_id"],
                    F.transform(F.filter("chain0", lambda x: x["level"] >= 0), lambda x: x["anc"]).alias("chain"),
                    F.reverse(F.transform(F.filter("chain0", lambda x: x["level"] < 0), lambda x: x["anc"]["pos"])).alias("hosts"))


def with_paths(els: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds ``css_path`` and ``xpath_absolute`` to element rows.

    Pointer doubling: after k rounds an element knows its steps up to 2^k levels
    up, and takes on those of the element 2^k levels up; so a page of depth D takes
    log2(D) rounds, each linear in the elements. ``hold`` keeps a round's rows."""
    deepest = els.agg(F.max("depth")).first()[0]
    p = els.filter("kind = 'open'").select("page_id", F.col("pos").alias("node"), "depth", F.col("css_part").alias("css"), F.col("xpath_part").alias("xp"))
    step = 1
    while deepest is not None and step <= deepest:
        rows = F.array(
            F.struct(F.col("depth").alias("level"), F.lit(0).alias("ord"), F.struct("css", "xp").alias("known")),
            F.struct((F.col("depth") - step).alias("level"), F.lit(1).alias("ord"), F.lit(None).cast("struct<css:string,xp:string>").alias("known")))
        w = Window.partitionBy("page_id", "level").orderBy("node", "ord").rowsBetween(UNB, CUR)
        r = p.select("page_id", "node", "depth", F.inline(rows)).filter("level >= 0")
        r = r.withColumn("up", F.when(F.col("ord") == 1, F.last("known", ignorenulls=True).over(w)))
        g = r.groupBy("page_id", "node").agg(F.first("depth").alias("depth"), F.first("known", ignorenulls=True).alias("known"), F.first("up", ignorenulls=True).alias("up"))
        p = hold(g.select("page_id", "node", "depth", F.concat_ws(" > ", "up.css", "known.css").alias("css"), F.concat_ws("/", "up.xp", "known.xp").alias("xp")))
        step *= 2
    p = p.select("page_id", F.col("node").alias("pos"), F.col("css").alias("css_path"), F.col("xp").alias("xpath_absolute"))
    return els.join(p, ["page_id", "pos"], "left")


def core_nodes(nodes: DataFrame) -> DataFrame:
    """All nodes (``kind`` open|text|shadow) with the columns that need no ancestors:
    attributes, classes, sibling rank, hidden flag, summary, path steps."""
    return _parts(_base(nodes))


def build_nodes(core: DataFrame) -> DataFrame:
    """``core_nodes`` with the columns that come from a node's ancestors.

    ``place`` sorts the nodes of a page as they are walked: the content of a
    shadow root directly after its host's start tag, wherever its template stands."""
    n = _with_ancestors(core)
    chain, kind = F.col("chain"), F.col("kind")
    proper = F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0)))
    is_el = kind == "open"
    ctx_all = F.transform(F.filter(proper, lambda x: ~((x["depth"] == 0) & (x["tag"] == "html"))),
                          lambda x: x["summary"])
    n = n.select(
        "*",
        F.when(is_el, F.array_join(F.transform(
            F.slice(chain, F.greatest(F.size(chain) - (L.SELECTOR_LEVELS - 1), F.lit(1)), L.SELECTOR_LEVELS),
            lambda x: x["sel_part"]), " > ")).alias("class_chain"),
        F.when(is_el, F.slice(ctx_all, F.greatest(F.size(ctx_all) - (L.CONTEXT_ANCESTORS - 1), F.lit(1)),
                              L.CONTEXT_ANCESTORS)).alias("context"),
        F.concat("hosts", F.when(kind == "shadow", F.array("parent_pos", F.lit(-1).cast("long"))).otherwise(F.array("pos"))).alias("place"),
        F.when(is_el, F.try_element_at(proper, F.lit(-1))["tag"]).otherwise(F.try_element_at(chain, F.lit(-1))["tag"]).alias("parent_tag"),
        F.when(is_el, F.try_element_at(proper, F.lit(-1))["id"]).alias("parent_id"),
        F.when(is_el, F.try_element_at(proper, F.lit(-1))["classes"]).alias("parent_classes"),
    )
    w = Window.partitionBy("page_id").orderBy(F.col("kind") != "open", "pos")
    n = n.withColumn("el_ord", F.when(is_el, F.row_number().over(w) - 1).cast("long"))
    n = n.withColumn("selector", F.when(F.col("id") != "", F.concat(F.lit("#"), css_escape("id")))
                     .otherwise(F.col("class_chain")))
    return n.drop("chain")


def in_document(els: DataFrame) -> DataFrame:
    """The elements that a query on the document meets: none inside a shadow root."""
    return els.filter("slevel = 0")


def _page_bytes(texts: DataFrame, col: str, name: str) -> DataFrame:
    """``(page_id, slevel, name)``: a column of all text nodes of a scope level in
    document order as UTF-8 bytes."""
    return texts.groupBy("page_id", "slevel").agg(F.expr(f"listagg(encode({col}, 'UTF-8')) WITHIN GROUP (ORDER BY pos)").alias(name))


def with_preview(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``preview``, the first characters of an element's collapsed text: a
    short piece of the page's collapsed text from the element's offset on, so
    its cost does not depend on the size of the element."""
    # only the offsets meet the page's text: whole rows are then joined by place
    e = nodes.filter("kind = 'open'").select("page_id", "pos", "slevel", "ctext_start", "ctext_end")
    j = e.join(_page_bytes(texts, "ctext", "page_bin"), ["page_id", "slevel"], "left")
    n = F.least(F.col("ctext_end") - F.col("ctext_start"), F.lit(4 * (L.PREVIEW_CHARS + 2)))
    piece = F.substring(F.col("page_bin"), F.col("ctext_start") + 1, n).cast("string")
    whole = F.when(F.col("ctext_end") - F.col("ctext_start") <= n, F.trim(piece)).otherwise(F.ltrim(piece))
    preview = j.select("page_id", "pos", F.when(n > 0, F.substring(whole, 1, L.PREVIEW_CHARS)).alias("preview"))
    shown = F.when(F.col("kind") == "open", F.coalesce("preview", F.lit("")))
    return nodes.join(preview, ["page_id", "pos"], "left").withColumn("preview", shown)


def with_text(els: DataFrame, texts: DataFrame, name: str = "text") -> DataFrame:
    """Adds ``textContent`` for the given elements (byte-range substring of the
    page text; O(length) per element, no per-element scan of the page).
    Text-node rows in ``els`` keep their own text."""
    j = els.join(_page_bytes(texts, "text", "page_bin"), ["page_id", "slevel"], "left")
    n = F.col("text_end") - F.col("text_start")
    txt = F.when(n > 0, F.decode(F.substring(F.col("page_bin"), F.col("text_start") + 1, n), "UTF-8")) \
        .otherwise(F.lit(""))
    if "kind" in els.columns and "text" in els.columns:
        txt = F.when(F.col("kind") == "text", F.col("text")).otherwise(txt)
    return j.withColumn(name, F.coalesce(txt, F.lit(""))).drop("page_bin")
