"""Tree -> text outputs for capture roots: cleaned HTML, structure outline,
accessibility outline, declared styles; plus the attribute keep rule.

(root, node) pairs come from the roots' nesting levels: every node asks for the
root of each level around it (``last_value`` per ``(page, level)``), so there are as
many rows as pairs and no range join. Every node carries the number of elements
around it that hide or skip their subtree; inside root ``r`` it is dropped iff that
number is above the one at ``r``, or ``r`` itself inherits a hidden state.
Fragments are assembled per root in walking order (``place``) with a ``listagg``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import lists as L
from weblens.functions.text import bound, clean_text, escape_html, finalize_output, json_quote
from weblens.operators.a11y import accessible_name, warnings_col
from weblens.operators.tree import SUPPRESSORS

# Capture roots used by the registered format queries: page regions.
REGION_TAGS = ["body", "header", "nav", "main", "article", "section", "aside", "footer", "form"]

@dataclass(frozen=True)
class Options:
    """Options of an output job. With ``per_root`` each root brings its own, as
    columns ``opt_depth``, ``opt_strip_noise``, ... (see ``replay.options``), so one
    plan serves roots of different settings."""

    depth: int | None = None          # None = full subtree
    strip_noise: bool = True
    keep_test_ids: bool = True
    include_context: bool = True
    truncation: int = L.DEFAULTS["truncationThreshold"]
    include_hidden: bool = False
    include_css: bool = True
    per_root: bool = False
    # the job's own lists (see ``functions.lists.names_of``): attribute names that are
    # kept, beginnings of names that are noise
    keep: tuple[str, ...] = tuple(L.KEEP_ATTRS)
    noise: tuple[str, ...] = tuple(L.NOISE_PREFIXES)

    def col(self, name: str) -> F.Column:
        return F.col(f"opt_{name}") if self.per_root else F.lit(getattr(self, name))

    def columns(self) -> list[str]:
        return [f"opt_{f.name}" for f in fields(self) if f.name not in ("per_root", "keep", "noise")] if self.per_root else []


def _free(name: str, opts: Options, but: int = 0) -> F.Column:
    """Whether nothing between root and node (``but`` suppressors of the node
    itself aside) suppresses it; with include_hidden only skip tags count."""
    skip = {"n_hs": "n_s", "n_hsn": "n_sn", "n_hid": None}[name]
    shown = F.lit(True) if skip is None else F.col(skip) - but == F.col(f"r_{skip}")
    free = (F.col(name) - but == F.col(f"r_{name}")) & ~F.col("r_unseen")
    if not opts.per_root:
        return shown if opts.include_hidden else free
    return F.when(opts.col("include_hidden"), shown).otherwise(free)


def keep_attribute(name, opts: Options = Options()) -> F.Column:
    """The keep rule of an attribute name."""
    name = F.col(name) if isinstance(name, str) else name
    noise = F.lit(False)
    for prefix in opts.noise:
        noise = noise | name.startswith(prefix)
    return name.isin(*opts.keep) | ~opts.col("strip_noise") | (opts.col("keep_test_ids") & (name == "data-testid")) | ~noise


def kept_attrs(opts: Options = Options()):
    return F.filter("attrs", lambda a: keep_attribute(a["name"], opts))


def open_tag(opts: Options = Options()):
    attrs = F.array_join(F.transform(kept_attrs(opts), lambda a: F.concat(
        a["name"], F.lit('="'), escape_html(a["value"]), F.lit('"'))), " ")
    return F.concat(F.lit("<"), F.col("tag"), F.when(attrs != "", F.concat(F.lit(" "), attrs)).otherwise(F.lit("")),
                    F.lit(">"))


def finalized(raw, opts: Options) -> F.Column:
    """Context header and line limit of an output, by the root's options."""
    context = F.col("root_context")
    if opts.per_root:
        context = F.when(opts.col("include_context"), context)
    return finalize_output(raw, F.coalesce(context, F.array().cast("array<string>")), opts.per_root or opts.include_context, opts.col("truncation"))


def region_roots(els: DataFrame) -> DataFrame:
    """Element rows of page regions (body and landmark-like containers); of a page
    without any, its top elements."""
    region = F.col("tag").isin(REGION_TAGS)
    some = F.max(region).over(Window.partitionBy("page_id"))
    return els.withColumn("some", some).filter(region | (~F.col("some") & (F.col("depth") == 0))).drop("some")


def root_columns(roots: DataFrame, opts: Options = Options()) -> DataFrame:
    """What the pairs know of a root: suppressors are counted above it only."""
    h, s = F.col("own_hidden"), F.col("tag").isin(L.SKIP_TAGS)
    plain = s & (F.col("tag") != "svg")
    own = dict(zip(SUPPRESSORS, (h, h | s, h | plain, s, plain)))
    return roots.select(
        "page_id", "pos", F.struct(
            F.col("pos").alias("root_pos"), F.col("depth").alias("root_depth"), F.col("slevel").alias("root_slevel"),
            (F.col("hidden") & ~h).alias("r_unseen"), *opts.columns(), *[(F.col(c) - own[c].cast("int")).alias(f"r_{c}") for c in SUPPRESSORS]).alias("root"))


def pairs(nodes: DataFrame, roots: DataFrame, opts: Options = Options(), asked: F.Column | None = None) -> DataFrame:
    """(root, node-in-subtree) pairs with ``rd`` = depth below the root and ``od``
    = depth in an outline, where a shadow root takes a level of its own. With ``asked``
    only of nodes that it holds for, and of the roots themselves."""
    n = nodes.join(root_columns(roots, opts), ["page_id", "pos"], "left")
    if asked is not None:
        n = n.filter(asked | F.col("root").isNotNull())
    cols = [c for c in nodes.columns if c != "page_id"]
    is_root = F.col("root").isNotNull()
    pos = F.col("pos")

    def event(at, ord_, delta):
        return F.struct(at.alias("at"), F.lit(ord_).alias("ord"), F.lit(delta).alias("delta"))

    here = event(pos, 2, 0)
    n = n.select("*", F.inline(F.when(is_root, F.array(event(pos, 1, 1), here, event(F.col("end_pos"), 0, -1))).otherwise(F.array(here))))
    w = Window.partitionBy("page_id").orderBy("at", "ord", F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = n.withColumn("level", F.sum("delta").over(w)).filter("delta >= 0 AND level > 0")
    levels = F.when(F.col("delta") == 1, F.array(F.col("level"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("level")))
    n = n.select("page_id", *cols, "delta", F.when(F.col("delta") == 1, F.col("root")).alias("opens"), F.explode(levels).alias("level"))
    by_level = Window.partitionBy("page_id", "level").orderBy("pos", F.desc("delta")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = n.withColumn("root", F.last("opens", ignorenulls=True).over(by_level)).filter("delta = 0").drop("opens", "level", "delta")
    rd = F.col("depth") - F.col("root.root_depth")
    return n.select("page_id", *cols, "root.*", rd.alias("rd"), (rd + F.col("slevel") - F.col("root.root_slevel")).alias("od"))


def _within(opts: Options):
    if opts.per_root:
        return F.col("opt_depth").isNull() | (F.col("rd") <= F.col("opt_depth"))
    return F.lit(True) if opts.depth is None else (F.col("rd") <= opts.depth)


def _listed(opts: Options):
    """Depth cut of an outline: a line is there if the one it hangs below is not cut."""
    if opts.depth is None and not opts.per_root:
        return F.lit(True)
    step = F.when(F.col("via_shadow"), 2).otherwise(1)
    return opts.col("depth").isNull() | (F.col("rd") == 0) | (F.col("od") - step < opts.col("depth"))


def _assemble(frags: DataFrame, roots_info: DataFrame, sep: str, opts: Options, fmt: str,
              finalize: bool = True) -> DataFrame:
    out = frags.groupBy("page_id", "root_pos").agg(
        F.expr(f"listagg(frag, '{sep}') WITHIN GROUP (ORDER BY k1, k2, k3)").alias("raw_output"))
    j = roots_info.join(out, ["page_id", "root_pos"], "left")
    if not finalize:
        return j.select("page_id", F.col("root_pos").alias("pos"), F.coalesce("raw_output", F.lit("")).alias("raw"),
                        "root_context", *opts.columns())
    return j.select("page_id", F.col("root_pos").alias("pos"), F.lit(fmt).alias("format"),
                    finalized(F.coalesce("raw_output", F.lit("")), opts).alias("output"))


def _root_info(roots: DataFrame, opts: Options = Options()) -> DataFrame:
    return roots.select("page_id", F.col("pos").alias("root_pos"), F.col("context").alias("root_context"), *opts.columns())


def _with_markup(nodes: DataFrame, opts: Options) -> DataFrame:
    """Nodes with their escaped text and, where all roots share the options, their start
    tag: made once per node, not once for each root around it."""
    n = nodes.withColumn("shown", F.when(F.col("kind") == "text", escape_html(clean_text("text"))))
    return n if opts.per_root else n.withColumn("start_tag", F.when(F.col("kind") == "open", open_tag(opts)))


def _html_frags(opts: Options, frag) -> F.Column:
    """Markup fragments of a pair of ``_with_markup`` nodes: start and end tags, texts,
    shadow root templates."""
    is_el, is_root = F.col("kind") == "open", F.col("kind") == "shadow"
    free = _free("n_hs", opts)
    hidden = F.col("hidden") & ~opts.col("include_hidden")
    svg_ok = (F.col("tag") == "svg") & ~hidden & _free("n_hs", opts, 1)
    cut = F.coalesce(F.col("rd") == opts.col("depth"), F.lit(False))
    ot = open_tag(opts) if opts.per_root else F.col("start_tag")
    close = F.concat(F.lit("</"), F.col("tag"), F.lit(">"))
    text = F.col("shown")
    place, zero = F.col("place"), F.lit(0)
    # an end tag comes behind everything before the element's end in the same scope
    end = F.concat("hosts", F.array("end_pos"))
    root_end = F.concat("hosts", F.array("parent_pos", F.lit(1 << 62)))
    empty = F.array()
    return (
        F.when(~_within(opts), empty)
        .when(is_root, F.when(free, F.array(frag(place, 1, zero, F.lit('<template shadowrootmode="open">')), frag(root_end, 0, zero, F.lit("</template>")))).otherwise(empty))
        .when(~is_el, F.when(free & (text != ""), F.array(frag(place, 1, zero, text))).otherwise(empty))
        .when(~free & svg_ok, F.array(frag(place, 1, zero, F.lit('<svg aria-label="vector graphic"></svg>'))))
        .when(~free, empty)
        .when(F.col("tag").isin(L.VOID_TAGS), F.array(frag(place, 1, zero, ot)))
        .when(cut, F.array(frag(place, 1, zero, F.concat(ot, escape_html(F.col("preview")), close))))
        .otherwise(F.array(frag(place, 1, zero, ot), frag(end, 0, -F.col("depth"), close)))
    )


def _line(text) -> F.Column:
    """An outline line at its depth; a shadow root's line is its name."""
    return F.concat(F.repeat(F.lit("  "), F.col("od").cast("int")), F.when(F.col("kind") == "shadow", F.col("tag")).otherwise(text))


def _summary() -> F.Column:
    return F.concat(F.col("summary"), F.when(F.col("preview") != "", F.concat(F.lit(' "'), F.col("preview"), F.lit('"'))).otherwise(F.lit("")))


def _lines(nodes: DataFrame, roots: DataFrame, name: str, text, sep: str, opts: Options, fmt: str) -> DataFrame:
    """Outline per root of each element's ``text``, made once per node."""
    n = nodes.filter("kind <> 'text'").withColumn("shown", F.when(F.col("kind") == "open", text))
    f = pairs(n, roots, opts).filter(_free(name, opts) & _listed(opts)).select(
        "page_id", "root_pos", F.col("place").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), _line(F.col("shown")).alias("frag"))
    return _assemble(f, _root_info(roots, opts), sep, opts, fmt)


def clean_html(nodes_text: DataFrame, roots: DataFrame, opts: Options = Options(), finalize: bool = True) -> DataFrame:
    """Cleaned markup per root: noise attributes dropped, hidden and skipped
    subtrees removed, text nodes trimmed, svg summarised, open shadow roots as
    templates before the other children."""
    def frag(k1, k2, k3, s):
        return F.struct(k1.alias("k1"), F.lit(k2).alias("k2"), k3.cast("long").alias("k3"), s.alias("frag"))

    f = pairs(_with_markup(nodes_text, opts), roots, opts).select("page_id", "root_pos", F.inline(_html_frags(opts, frag)))
    return _assemble(f, _root_info(roots, opts), "", opts, "clean-html", finalize)


def structure(nodes_text: DataFrame, roots: DataFrame, opts: Options = Options()) -> DataFrame:
    """Indented outline ``tag#id.classes "preview"`` per root."""
    return _lines(nodes_text, roots, "n_hsn", _summary(), "\\n", opts, "structure")


def a11y_line():
    attr = F.col("attr")
    parts = F.array_compact(F.array(
        F.when(F.coalesce(attr["role"], F.lit("")) != "", F.concat(F.lit('role="'), attr["role"], F.lit('"'))),
        F.when(attr["aria-label"].isNotNull(), F.concat(F.lit('aria-label="'), attr["aria-label"], F.lit('"'))),
        F.when(attr["aria-labelledby"].isNotNull(),
               F.concat(F.lit('aria-labelledby="'), attr["aria-labelledby"], F.lit('"'))),
        F.when(attr["alt"].isNotNull(), F.concat(F.lit('alt="'), attr["alt"], F.lit('"'))),
    ))
    name = accessible_name()
    warns = warnings_col()
    return F.concat(
        F.lit("["), F.col("tag"),
        F.when(F.size(parts) > 0, F.concat(F.lit(" "), F.array_join(parts, " "))).otherwise(F.lit("")),
        F.lit("]"),
        F.when(name != "", F.concat(F.lit(" "), json_quote(name))).otherwise(F.lit("")),
        F.when(F.size(warns) > 0, F.concat(F.lit(" WARNING("), F.array_join(warns, ", "), F.lit(")")))
        .otherwise(F.lit("")),
    )


def a11y_outline(nodes_text: DataFrame, roots: DataFrame, opts: Options = Options()) -> DataFrame:
    """Accessibility lines ``[tag role aria-*  alt] "name" WARNING(..)`` per root."""
    return _lines(nodes_text, roots, "n_hid", a11y_line(), "\\n", opts, "accessibility")


# One declaration: quoted strings and bracketed groups go through whole.
DECLARATION_RX = r"""(?:[^;"'()]++|"[^"]*+"|'[^']*+'|\((?:[^()"']++|"[^"]*+"|'[^']*+')*+\)|["'()])++"""
IMPORTANT_RX = r"(?i)\s*!\s*important\s*$"


def style_lines():
    """Reported style lines of an element from its inline ``style``: the
    allow-listed properties in list order; an important declaration beats a
    plain one, then the last wins; values without information are dropped."""
    style = F.coalesce(F.col("attr")["style"], F.lit(""))
    decls = F.transform(
        F.filter(F.regexp_extract_all(style, F.lit(DECLARATION_RX), 0), lambda d: F.instr(d, ":") > 0),
        lambda d: F.struct(
            F.lower(F.trim(F.substring_index(d, ":", 1))).alias("prop"),
            F.trim(F.regexp_replace(F.substring(d, F.instr(d, ":") + 1, 1 << 30), IMPORTANT_RX, "")).alias("value"),
            d.rlike(IMPORTANT_RX).alias("important")))
    def best(ds):
        rev = F.reverse(ds)
        return F.concat(F.filter(rev, lambda d: d["important"]), F.filter(rev, lambda d: ~d["important"]))

    def reported(ds):
        props = F.array(*[F.lit(p) for p in L.STYLE_PROPERTIES])
        values = F.transform(props, lambda p: F.struct(
            p.alias("prop"), F.try_element_at(F.filter(ds, lambda d: d["prop"] == p), F.lit(1))["value"].alias("value")))
        told = F.filter(values, lambda x: (F.coalesce(x["value"], F.lit("")) != "") & ~F.trim(x["value"]).isin(L.EMPTY_STYLE_VALUES))
        return F.transform(told, lambda x: F.concat(x["prop"], F.lit(": "), x["value"], F.lit(";")))

    return bound(bound(decls, best), reported)


def rule_selector():
    s = F.regexp_replace(F.col("summary"), r"\s+", "")
    return F.when(F.instr(s, "#") > 0, s).otherwise(F.col("selector"))


def _style_block() -> F.Column:
    """The rule of an element, null without a line to report."""
    return bound(style_lines(), lambda lines: F.when(F.size(lines) > 0, F.concat(
        rule_selector(), F.lit(" {\n  "), F.array_join(lines, "\n  "), F.lit("\n}"))))


def _css_block(css) -> F.Column:
    return F.concat(F.lit("\n\n<style>\n"), css, F.lit("\n</style>"))


def declared_styles(els_text: DataFrame, roots: DataFrame, opts: Options = Options(), finalize: bool = True
                    ) -> DataFrame:
    """Style blocks ``selector {\n  prop: value;\n}`` per root (declared inline
    styles of visible elements in the subtree, tree order), each made once per node."""
    n = els_text.withColumn("rule", F.when(F.col("attr")["style"].isNotNull(), _style_block()))
    f = pairs(n, roots, opts, F.col("rule").isNotNull()).filter(F.col("rule").isNotNull() & _free("n_hid", opts) & _within(opts)).select(
        "page_id", "root_pos", F.col("place").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.col("rule").alias("frag"))
    return _assemble(f, _root_info(roots, opts), "\\n\\n", opts, "css", finalize)


def html_css(nodes_text: DataFrame, els_text: DataFrame, roots: DataFrame, opts: Options = Options()) -> DataFrame:
    """Cleaned markup followed by a ``<style>`` block of the subtree's rules,
    where the options include it."""
    h = clean_html(nodes_text, roots, opts, finalize=False)
    raw = F.col("raw")
    if opts.per_root or opts.include_css:
        st = declared_styles(els_text, roots, opts, finalize=False).select("page_id", "pos", F.col("raw").alias("css"))
        h = h.join(st, ["page_id", "pos"], "left")
        raw = F.concat(raw, F.when(opts.col("include_css"), _css_block(F.coalesce("css", F.lit("")))).otherwise(F.lit("")))
    return h.select("page_id", "pos", F.lit("html-css").alias("format"), finalized(raw, opts).alias("output"))


def multi_format(nodes_text: DataFrame, roots: DataFrame, opts: Options = Options()) -> DataFrame:
    """clean-html, structure, accessibility and html-css outputs from ONE pass over
    the (root, node) pairs: every pair emits its fragments of all formats in one
    ``inline``, and one grouped ``listagg`` per (root, kind of fragment) assembles
    them. Same results as the single-format functions."""
    is_el, is_text = F.col("kind") == "open", F.col("kind") == "text"
    empty = F.array()

    def frag(fmt):
        return lambda k1, k2, k3, s: F.struct(F.lit(fmt).alias("format"), k1.alias("k1"), F.lit(k2).alias("k2"), k3.cast("long").alias("k3"), s.alias("frag"))

    def line(fmt, shown, text):
        return F.when(shown, F.array(frag(fmt)(F.col("place"), 0, F.lit(0), text))).otherwise(empty)

    listed = ~is_text & _listed(opts)
    styled = F.col("rule").isNotNull() & _within(opts) & _free("n_hid", opts)
    n = _with_markup(nodes_text, opts).withColumn("outline", F.when(is_el, _summary())).withColumn("a11y", F.when(is_el, a11y_line())) \
        .withColumn("rule", F.when(is_el & F.col("attr")["style"].isNotNull(), _style_block()))
    f = pairs(n, roots, opts).select("page_id", "root_pos", F.inline(F.concat(
        _html_frags(opts, frag("clean-html")), line("structure", listed & _free("n_hsn", opts), _line(F.col("outline"))),
        line("accessibility", listed & _free("n_hid", opts), _line(F.col("a11y"))),
        line("css", styled, F.col("rule")))))
    order = "WITHIN GROUP (ORDER BY k1, k2, k3)"
    out = f.groupBy("page_id", "root_pos", "format").agg(
        F.expr(f"listagg(CASE WHEN format = 'clean-html' THEN frag END, '') {order}").alias("h"),
        F.expr(f"listagg(CASE WHEN format IN ('structure', 'accessibility') THEN frag END, '\\n') {order}").alias("l"),
        F.expr(f"listagg(CASE WHEN format = 'css' THEN frag END, '\\n\\n') {order}").alias("c"))
    raw = out.groupBy("page_id", "root_pos").agg(F.map_from_entries(F.collect_list(F.struct("format", F.coalesce("h", "l", "c")))).alias("raw"))
    j = _root_info(roots, opts).join(raw, ["page_id", "root_pos"], "left")

    def text_of(fmt):
        return F.coalesce(F.col("raw")[fmt], F.lit(""))

    html_css = F.concat(text_of("clean-html"), F.when(opts.col("include_css"), _css_block(text_of("css"))).otherwise(F.lit("")))
    formats = [("clean-html", text_of("clean-html")), ("structure", text_of("structure")), ("accessibility", text_of("accessibility")), ("html-css", html_css)]
    return j.select("page_id", F.col("root_pos").alias("pos"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("format"), finalized(text, opts).alias("output")) for name, text in formats])))
