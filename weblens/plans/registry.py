"""Registered queries: name -> Spark builder ``(spark, sf_dir) -> DataFrame``,
and name -> DuckDB oracle SQL for the value-checked ones.

Every query reads the driver's ``pages`` table as it is or the ``events`` table,
over whole tables. ``rich_*`` queries run some of them over pages with more markup
(the fixture view ``rich``), ``malformed_*`` over broken markup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import lists as L
from weblens.operators import elements as E
from weblens.plans import context as C
from weblens.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def W(select: str, derived: bool = True, view: str = "raw") -> str:  # noqa: N802
    return O.with_base(select, view=view, derived=derived)


# ---------------------------------------------------------------------------
# step 1: page snapshot slice
# ---------------------------------------------------------------------------
from weblens.operators import snapshot as S  # noqa: E402


def titles(spark, sf, view=None):
    """Headings and titles with their whole text."""
    e = C.core_elements(spark, sf, view)
    return C.with_text(spark, sf, E.in_document(e).filter(F.col("tag").isin([*L.HEADING_TAGS, "title"])), view)


@query("page_counts", W("""
SELECT pr.page_id,
  count(*) FILTER (WHERE tag = 'button' OR coalesce(a_role, '') = 'button') AS buttons,
  count(*) FILTER (WHERE tag = 'a' AND a_href IS NOT NULL) AS links,
  count(*) FILTER (WHERE tag = 'form') AS forms,
  count(*) FILTER (WHERE tag IN ('input', 'textarea', 'select')) AS inputs,
  count(*) FILTER (WHERE tag = 'img' AND coalesce(a_alt, '') = '') AS images_missing_alt
FROM pr LEFT JOIN elx ON elx.page_id = pr.page_id AND elx.slevel = 0 GROUP BY pr.page_id""", derived=False))
def q_page_counts(spark, sf):
    return S.page_counts(C.pages(spark, sf), C.core_elements(spark, sf))


@query("headings", W(f"""
SELECT page_id, rank, tag, {O.clean_sql('text')} AS text FROM (
  SELECT e.page_id, e.tag, tc.text, row_number() OVER (PARTITION BY e.page_id ORDER BY e.pos) AS rank
  FROM el e JOIN tc USING (page_id, pos) WHERE e.slevel = 0 AND e.tag IN ('h1', 'h2', 'h3'))
WHERE rank <= 20"""))
def q_headings(spark, sf):
    return S.headings(titles(spark, sf))


@query("landmarks", W("""
SELECT page_id, rank, summary FROM (
  SELECT page_id, summary, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank
  FROM elx WHERE slevel = 0 AND tag IN ('header', 'nav', 'main', 'section', 'aside', 'footer'))
WHERE rank <= 25""", derived=False))
def q_landmarks(spark, sf):
    return S.landmarks(C.core_elements(spark, sf))


TITLE_SQL = """
ttl AS (
  SELECT pr.page_id, pr.url,
    trim(regexp_replace(coalesce((SELECT arg_min(tc.text, tc.pos) FROM el e JOIN tc USING (page_id, pos)
                                  WHERE e.page_id = pr.page_id AND e.slevel = 0 AND e.tag = 'title'), ''), '[ \t\n\f\r]+', ' ', 'g'),
         ' ') AS title
  FROM pr)"""


@query("page_title")
def q_page_title(spark, sf):
    return S.page_title(C.pages(spark, sf), titles(spark, sf))


def snapshot_sql() -> str:
    return f"""
SELECT t.page_id, 'PAGE: ' || t.url || chr(10) || 'TITLE: ' || t.title || chr(10)
  || 'INTERACTIVE: ' || c.buttons || ' buttons, ' || c.links || ' links, ' || c.forms || ' forms, '
  || c.inputs || ' inputs' || chr(10)
  || 'A11Y: ' || c.images_missing_alt || ' images missing alt text' || chr(10) || chr(10)
  || 'LANDMARKS:' || coalesce((SELECT string_agg(chr(10) || '  ' || summary, '' ORDER BY pos) FROM (
        SELECT pos, summary FROM elx x WHERE x.page_id = t.page_id AND x.slevel = 0 AND x.tag IN {O.qlist(L.LANDMARK_TAGS)}
        ORDER BY pos LIMIT 25)), '')
  || chr(10) || chr(10) || 'HEADINGS:' || coalesce((SELECT string_agg(chr(10) || '  ' || tag || ' "' || htext || '"', ''
        ORDER BY pos) FROM (
        SELECT x.pos, x.tag, {O.clean_sql('tc.text')} AS htext FROM el x JOIN tc USING (page_id, pos)
        WHERE x.page_id = t.page_id AND x.slevel = 0 AND x.tag IN ('h1', 'h2', 'h3') ORDER BY x.pos LIMIT 20)), '')
  || chr(10) || chr(10) || 'CURRENT_SELECTION: '
  || coalesce((SELECT arg_min(summary, pos) FROM elx x WHERE x.page_id = t.page_id AND x.tag = 'body'),
              (SELECT arg_min(summary, pos) FROM elx x WHERE x.page_id = t.page_id), '') AS snapshot
FROM ttl t JOIN (
  SELECT page_id,
    count(*) FILTER (WHERE tag = 'button' OR coalesce(a_role, '') = 'button') AS buttons,
    count(*) FILTER (WHERE tag = 'a' AND a_href IS NOT NULL) AS links,
    count(*) FILTER (WHERE tag = 'form') AS forms,
    count(*) FILTER (WHERE tag IN ('input', 'textarea', 'select')) AS inputs,
    count(*) FILTER (WHERE tag = 'img' AND coalesce(a_alt, '') = '') AS images_missing_alt
  FROM elx WHERE slevel = 0 GROUP BY page_id) c USING (page_id)"""


@query("page_snapshot")
def q_page_snapshot(spark, sf):
    return S.page_snapshot(C.pages(spark, sf), C.elements(spark, sf), titles(spark, sf))


def _with_title(select: str) -> str:
    return O.with_base("", derived=True).rstrip() + "," + TITLE_SQL + "\n" + select


ORACLE["page_title"] = _with_title("SELECT page_id, url, title FROM ttl")
ORACLE["page_snapshot"] = _with_title(snapshot_sql())


# ---------------------------------------------------------------------------
# step 2: element tree, text nodes, attributes, paths
# ---------------------------------------------------------------------------


@query("element_tree", W("SELECT page_id, pos, end_pos, tag, depth, parent_pos FROM el", derived=False))
def q_element_tree(spark, sf):
    return C.core_elements(spark, sf).select("page_id", "pos", "end_pos", "tag", "depth", "parent_pos")


@query("text_nodes", W("SELECT page_id, pos, parent_pos, text FROM txt", derived=False))
def q_text_nodes(spark, sf):
    return C.texts(spark, sf).select("page_id", "pos", "parent_pos", "text")


@query("attributes", W("""
SELECT page_id, pos, row_number() OVER (PARTITION BY page_id, pos ORDER BY i) AS ordinal, name, value
FROM atr""", derived=False))
def q_attributes(spark, sf):
    return C.core_elements(spark, sf).select("page_id", "pos", F.posexplode("attrs").alias("i", "a")).select(
        "page_id", "pos", (F.col("i") + 1).cast("long").alias("ordinal"), "a.name", "a.value")


# the same tables over markup that is broken in known ways
@query("malformed_tree", W("SELECT page_id, pos, end_pos, tag, depth, parent_pos FROM el", derived=False, view="malformed"))
def q_malformed_tree(spark, sf):
    return C.core_elements(spark, sf, "malformed").select("page_id", "pos", "end_pos", "tag", "depth", "parent_pos")


@query("malformed_texts", W("SELECT page_id, pos, parent_pos, text FROM txt", derived=False, view="malformed"))
def q_malformed_texts(spark, sf):
    return C.texts(spark, sf, "malformed").select("page_id", "pos", "parent_pos", "text")


@query("malformed_attributes", W("""
SELECT page_id, pos, row_number() OVER (PARTITION BY page_id, pos ORDER BY i) AS ordinal, name, value
FROM atr""", derived=False, view="malformed"))
def q_malformed_attributes(spark, sf):
    return C.core_elements(spark, sf, "malformed").select("page_id", "pos", F.posexplode("attrs").alias("i", "a")).select(
        "page_id", "pos", (F.col("i") + 1).cast("long").alias("ordinal"), "a.name", "a.value")


@query("malformed_text_content", W("SELECT page_id, pos, text FROM tc", view="malformed"))
def q_malformed_text_content(spark, sf):
    return C.with_text(spark, sf, C.core_elements(spark, sf, "malformed"), "malformed").select("page_id", "pos", "text")


@query("nth_of_type", W("SELECT page_id, pos, tag, nth_of_type, n_same_tag FROM elx", derived=False))
def q_nth_of_type(spark, sf):
    return C.core_elements(spark, sf).select("page_id", "pos", "tag", "nth_of_type", "n_same_tag")


@query("parent_child", W("""
SELECT c.page_id, c.pos, c.tag, c.parent_pos, p.tag AS parent_tag
FROM el c LEFT JOIN el p ON p.page_id = c.page_id AND p.pos = c.parent_pos""", derived=False))
def q_parent_child(spark, sf):
    return C.elements(spark, sf).select("page_id", "pos", "tag", "parent_pos", "parent_tag")


@query("context_chain", W("SELECT page_id, pos, ctx6 AS context FROM ancg"))
def q_context_chain(spark, sf):
    return C.elements(spark, sf).select("page_id", "pos", F.array_join("context", " > ").alias("context"))


@query("css_path", W("SELECT page_id, pos, css_path FROM ancg"))
def q_css_path(spark, sf):
    return C.paths(spark, sf).select("page_id", "pos", "css_path")


@query("xpath_absolute", W("SELECT page_id, pos, xpath_absolute FROM ancg"))
def q_xpath_absolute(spark, sf):
    return C.paths(spark, sf).select("page_id", "pos", "xpath_absolute")


@query("class_selector", W("SELECT page_id, pos, selector FROM elp"))
def q_class_selector(spark, sf):
    return C.elements(spark, sf).select("page_id", "pos", "selector")


@query("subtree_sizes", W("""
SELECT e.page_id, e.pos,
  (SELECT count(*) FROM el d WHERE d.page_id = e.page_id AND d.pos > e.pos AND d.pos < e.end_pos) AS n_desc,
  (SELECT count(*) FROM txt d WHERE d.page_id = e.page_id AND d.pos > e.pos AND d.pos < e.end_pos) AS n_text_desc
FROM el e""", derived=False))
def q_subtree_sizes(spark, sf):
    return C.elements(spark, sf).select("page_id", "pos", "n_desc", "n_text_desc")


@query("text_content", W("SELECT page_id, pos, text FROM tc"))
def q_text_content(spark, sf):
    return C.with_text(spark, sf, C.core_elements(spark, sf)).select("page_id", "pos", "text")


@query("direct_text", W(f"""
SELECT page_id, parent_pos AS pos, string_agg(t, ' ' ORDER BY pos) AS direct_text FROM (
  SELECT page_id, parent_pos, pos, {O.js_trim_sql('text')} AS t FROM txt WHERE NOT via_shadow)
WHERE t <> '' AND parent_pos IS NOT NULL GROUP BY page_id, parent_pos""", derived=False))
def q_direct_text(spark, sf):
    from weblens.operators.text_ops import direct_text
    return direct_text(C.texts(spark, sf))


@query("hidden_elements", W("SELECT page_id, pos, tag FROM elx WHERE hidden", derived=False))
def q_hidden_elements(spark, sf):
    return C.core_elements(spark, sf).filter("hidden").select("page_id", "pos", "tag")


@query("images_missing_alt", W("SELECT page_id, pos FROM elx WHERE tag = 'img' AND coalesce(a_alt, '') = ''",
                               derived=False))
def q_images_missing_alt(spark, sf):
    return C.elements(spark, sf).filter(S.missing_alt()).select("page_id", "pos")


@query("unnamed_buttons", W("""
SELECT page_id, pos FROM elp
WHERE (tag = 'button' OR coalesce(a_role, '') = 'button') AND coalesce(nullif(a_aria_label, ''), preview) = ''"""))
def q_unnamed_buttons(spark, sf):
    from weblens.operators.a11y import unnamed_buttons
    return unnamed_buttons(C.elements(spark, sf))


@query("capturable_pages", "SELECT page_id, url FROM pages WHERE NOT (" + " OR ".join(
    f"starts_with(coalesce(url, ''), {O.q(p)})" for p in L.RESTRICTED_URL_PREFIXES) + ")")
def q_capturable_pages(spark, sf):
    from weblens.sources.pages import capturable_pages, read_pages
    return capturable_pages(read_pages(spark, sf)).select("page_id", "url")


@query("capturable_roots", W(f"SELECT page_id, pos, tag FROM el WHERE tag NOT IN {O.qlist(L.UNSELECTABLE_TAGS)}",
                             derived=False))
def q_capturable_roots(spark, sf):
    return C.elements(spark, sf).filter(~F.col("tag").isin(L.UNSELECTABLE_TAGS)).select("page_id", "pos", "tag")


# ---------------------------------------------------------------------------
# steps 3-4: cleaning, structure, accessibility
# ---------------------------------------------------------------------------
from weblens.operators import render as R  # noqa: E402
from weblens.operators.a11y import a11y_findings  # noqa: E402


def RW(select: str, depth: int | None = None) -> str:  # noqa: N802
    return O.with_base("", derived=True).rstrip() + O.render_ctes(depth) + "\n" + select


def nodes_text(spark, sf, view=None):
    return C.nodes(spark, sf, view)


def roots(spark, sf):
    return R.region_roots(C.elements(spark, sf))


def clean_frags() -> str:
    void = f"tag IN {O.qlist(L.VOID_TAGS)}"
    cut = f"WHEN rd = o_depth AND NOT {void} THEN otag || {O.escape_html_sql('preview')} || '</' || tag || '>'"
    within, inner = "(o_depth IS NULL OR rd <= o_depth)", "(o_depth IS NULL OR rd < o_depth)"
    return f"""
SELECT page_id, root_pos, place AS k1, 1 AS k2, 0 AS k3,
  CASE WHEN kind = 'text' THEN {O.escape_html_sql(O.clean_sql('ntext'))}
       WHEN NOT (sup_skip IS NULL OR sup_skip < root_pos) THEN '<svg aria-label="vector graphic"></svg>'
       WHEN kind = 'shadow' THEN otag
       {cut}
       ELSE otag END AS frag
FROM rp
WHERE {within} AND (
   (kind = 'text' AND (sup_skip IS NULL OR sup_skip < root_pos) AND {O.clean_sql('ntext')} <> '')
   OR (kind IN ('open', 'shadow') AND (sup_skip IS NULL OR sup_skip < root_pos))
   OR (kind = 'open' AND tag = 'svg' AND NOT hidden AND (anc_skip IS NULL OR anc_skip < root_pos)))
UNION ALL
SELECT page_id, root_pos, hosts || [end_pos], 0, -depth, '</' || tag || '>'
FROM rp WHERE {inner} AND kind = 'open' AND (sup_skip IS NULL OR sup_skip < root_pos) AND NOT {void}
UNION ALL
SELECT page_id, root_pos, place[:-2] || [4611686018427387904], 0, 0, '</template>'
FROM rp WHERE {within} AND kind = 'shadow' AND (sup_skip IS NULL OR sup_skip < root_pos)"""


CLEAN_FRAGS = clean_frags()


def render_select(frags: str, sep: str, fmt: str) -> str:
    out = "coalesce(o.raw_output, '')"
    return f"""
SELECT r.page_id, r.pos, '{fmt}' AS format, {O.finalize_sql(out, 'r')} AS output
FROM roots r LEFT JOIN (
  SELECT page_id, root_pos, string_agg(frag, {sep} ORDER BY k1, k2, k3) AS raw_output FROM ({frags})
  GROUP BY page_id, root_pos) o ON o.page_id = r.page_id AND o.root_pos = r.pos"""


@query("clean_html", RW(render_select(CLEAN_FRAGS, "''", "clean-html")))
def q_clean_html(spark, sf):
    return R.clean_html(nodes_text(spark, sf), roots(spark, sf))


# a line is listed if the element (or shadow root line) it hangs below is not cut
OUTLINE_CUT = " AND (p.o_depth IS NULL OR p.rd = 0 OR p.od - CASE WHEN p.via_shadow THEN 2 ELSE 1 END < p.o_depth)"


def structure_frags() -> str:
    return (f"SELECT page_id, root_pos, place AS k1, 0 AS k2, 0 AS k3, repeat('  ', od::INTEGER) || CASE WHEN kind = 'shadow' THEN tag ELSE summary || "
            f"CASE WHEN preview <> '' THEN ' \"' || preview || '\"' ELSE '' END END AS frag FROM rp p "
            f"WHERE kind <> 'text' AND (sup_skip_nosvg IS NULL OR sup_skip_nosvg < root_pos){OUTLINE_CUT}")


@query("structure", RW(render_select(structure_frags(), "chr(10)", "structure")))
def q_structure(spark, sf):
    return R.structure(nodes_text(spark, sf), roots(spark, sf))


A11Y_LINE = f"""
  '[' || e.tag || CASE WHEN len(list_filter([
      CASE WHEN coalesce(e.a_role, '') <> '' THEN 'role="' || e.a_role || '"' END,
      CASE WHEN e.a_aria_label IS NOT NULL THEN 'aria-label="' || e.a_aria_label || '"' END,
      CASE WHEN e.a_aria_labelledby IS NOT NULL THEN 'aria-labelledby="' || e.a_aria_labelledby || '"' END,
      CASE WHEN e.a_alt IS NOT NULL THEN 'alt="' || e.a_alt || '"' END], lambda x: x IS NOT NULL)) > 0
    THEN ' ' || array_to_string(list_filter([
      CASE WHEN coalesce(e.a_role, '') <> '' THEN 'role="' || e.a_role || '"' END,
      CASE WHEN e.a_aria_label IS NOT NULL THEN 'aria-label="' || e.a_aria_label || '"' END,
      CASE WHEN e.a_aria_labelledby IS NOT NULL THEN 'aria-labelledby="' || e.a_aria_labelledby || '"' END,
      CASE WHEN e.a_alt IS NOT NULL THEN 'alt="' || e.a_alt || '"' END], lambda x: x IS NOT NULL), ' ')
    ELSE '' END || ']'
  || CASE WHEN coalesce(nullif(e.a_aria_label, ''), e.preview) <> ''
          THEN ' ' || {O.json_quote_sql("coalesce(nullif(e.a_aria_label, ''), e.preview)")} ELSE '' END
  || CASE WHEN e.warns <> '' THEN ' WARNING(' || e.warns || ')' ELSE '' END"""

A11Y_WARNS = """
  array_to_string(list_filter([
    CASE WHEN tag = 'img' AND coalesce(a_alt, '') = '' THEN 'missing-alt' END,
    CASE WHEN (tag = 'button' OR coalesce(a_role, '') = 'button')
              AND coalesce(nullif(a_aria_label, ''), preview) = '' THEN 'unnamed-button' END],
    lambda x: x IS NOT NULL), ', ')"""


def a11y_frags() -> str:
    return (f"SELECT p.page_id, p.root_pos, p.place AS k1, 0 AS k2, 0 AS k3, repeat('  ', p.od::INTEGER) || "
            f"CASE WHEN p.kind = 'shadow' THEN p.tag ELSE {A11Y_LINE} END AS frag "
            f"FROM rp p LEFT JOIN (SELECT *, {A11Y_WARNS} AS warns FROM elp) e ON e.page_id = p.page_id AND e.pos = p.pos "
            f"WHERE p.kind <> 'text' AND (p.sup_hidden IS NULL OR p.sup_hidden < p.root_pos){OUTLINE_CUT}")


@query("a11y_outline", RW(render_select(a11y_frags(), "chr(10)", "accessibility")))
def q_a11y_outline(spark, sf):
    return R.a11y_outline(nodes_text(spark, sf), roots(spark, sf))


@query("a11y_findings", W(f"""
SELECT page_id, pos, unnest(list_filter([
    CASE WHEN tag = 'img' AND coalesce(a_alt, '') = '' THEN 'missing-alt' END,
    CASE WHEN (tag = 'button' OR coalesce(a_role, '') = 'button')
              AND coalesce(nullif(a_aria_label, ''), preview) = '' THEN 'unnamed-button' END],
    lambda x: x IS NOT NULL)) AS warning
FROM elp"""))
def q_a11y_findings(spark, sf):
    return a11y_findings(C.elements(spark, sf))


@query("kept_attributes", W(f"""
SELECT page_id, pos, row_number() OVER (PARTITION BY page_id, pos ORDER BY i) AS ordinal, name, value FROM atr
WHERE name IN {O.qlist(L.KEEP_ATTRS)} OR name = 'data-testid' OR NOT regexp_matches(name, {O.q(O.NOISE_RX)})""",
                            derived=False))
def q_kept_attributes(spark, sf):
    e = C.core_elements(spark, sf).select("page_id", "pos", F.posexplode(R.kept_attrs()).alias("i", "a"))
    return e.select("page_id", "pos", (F.col("i") + 1).cast("long").alias("ordinal"), "a.name", "a.value")


# ---------------------------------------------------------------------------
# step 5: selectors, locators, verification, fingerprint
# ---------------------------------------------------------------------------
from weblens.operators import locators as LC  # noqa: E402
from weblens.operators.text_ops import direct_text as _direct, first_text as _first  # noqa: E402
from weblens.plans import oracle_locators as OL  # noqa: E402


def LW(select: str) -> str:  # noqa: N802
    return O.with_base("", derived=True).rstrip() + OL.ctes() + "\n" + select


def _scope(df):
    return df.filter(~F.col("tag").isin(L.UNSELECTABLE_TAGS))


def _in_scope(spark, sf, df, view=None):
    s = _scope(C.core_elements(spark, sf, view)).select("page_id", "pos")
    return df.join(s, ["page_id", "pos"], "left_semi")


def els_src(spark, sf, view=None):
    t = C.texts(spark, sf, view)

    def build():
        e = C.paths(spark, sf, view)
        # a longer collapsed text is over the limit of the text XPath anyway
        short = C.core_elements(spark, sf, view).filter(F.col("ctext_end") - F.col("ctext_start") <= 4 * L.TEXT_XPATH_MAX + 8)
        content = C.with_text(spark, sf, short.select("page_id", "pos", "slevel", "text_start", "text_end"), view).select("page_id", "pos", "text")
        e = e.join(content, ["page_id", "pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))
        return LC.text_source(e, _direct(t), _first(t)).select(*LC.SOURCE)
    return C.memo(spark, sf, f"els_src-{view}", build)


def first_texts(spark, sf, view=None):
    return C.memo(spark, sf, f"first_text-{view}", lambda: _first(C.texts(spark, sf, view)))


@query("ranked_selectors", LW(OL.ranked_sql()))
def q_ranked_selectors(spark, sf):
    return LC.ranked_selectors(_scope(C.elements(spark, sf)))


@query("best_selector", LW(OL.best_sql()))
def q_best_selector(spark, sf):
    return LC.best_selector(_scope(C.elements(spark, sf)))


@query("shortest_unique", LW(OL.shortest_unique_sql()))
def q_shortest_unique(spark, sf):
    return _in_scope(spark, sf, LC.shortest_unique(C.elements(spark, sf)))


@query("xpath_relative", LW(OL.xpath_relative_sql()))
def q_xpath_relative(spark, sf):
    return _in_scope(spark, sf, LC.xpath_relative(C.elements(spark, sf)))


@query("xpath_text", LW(OL.xpath_text_sql()))
def q_xpath_text(spark, sf):
    return _in_scope(spark, sf, LC.xpath_text(els_src(spark, sf), first_texts(spark, sf), hold=C.kept(spark, sf)))


def _locators(spark, sf, view=None):
    return C.memo(spark, sf, f"locators-{view}", lambda: _in_scope(
        spark, sf, LC.locator_matches(els_src(spark, sf, view), first_texts(spark, sf, view), hold=C.kept(spark, sf, view)), view))


@query("locator_matches", LW(OL.locator_matches_sql()))
def q_locator_matches(spark, sf):
    return _locators(spark, sf).select("page_id", "pos", "strategy", "value", "tier", "matches")


@query("locator_tiers", LW(OL.locator_tiers_sql()))
def q_locator_tiers(spark, sf):
    return LC.locator_tiers(_locators(spark, sf))


@query("fingerprint", LW(f"SELECT page_id, pos, fingerprint FROM ({OL.fingerprint_sql()})"))
def q_fingerprint(spark, sf):
    return LC.fingerprint(_locators(spark, sf)).select("page_id", "pos", F.to_json("fingerprint").alias("fingerprint"))


# ---------------------------------------------------------------------------
# step 8: replay, captures, traversal
# ---------------------------------------------------------------------------
from weblens.operators import captures as CP  # noqa: E402
from weblens.operators import replay as RP  # noqa: E402
from weblens.session import scratch_path  # noqa: E402
from weblens.sources.log import read_log  # noqa: E402
from weblens.sources.sinks import read_outputs, write_outputs  # noqa: E402


def GW(select: str) -> str:  # noqa: N802
    return "WITH " + O.log_ctes() + "\n" + select


@query("selection_replay", GW("SELECT tab, element, toggles, sel_order FROM selr"))
def q_selection_replay(spark, sf):
    return RP.selection_replay(read_log(spark, sf)).select("tab", "element", "toggles", "sel_order")


@query("settings_replay", GW("SELECT tab, key, value FROM stg"))
def q_settings_replay(spark, sf):
    return RP.settings_replay(read_log(spark, sf)).select("tab", "key", "value")


@query("inspector_state", GW("""
SELECT tab, count(*) AS toggles, count(*) % 2 = 1 AS enabled FROM lg WHERE type = 'inspector' GROUP BY tab"""))
def q_inspector_state(spark, sf):
    return RP.inspector_state(read_log(spark, sf))


_DEFAULTS_SQL = ", ".join(f"({O.q(k)}, {O.q(v)})" for k, v in RP.DEFAULT_ROWS)


@query("effective_settings", GW(f"""
SELECT t.tab, d.key, coalesce(s.value, d.dv) AS value, CASE WHEN s.value IS NOT NULL THEN 'stored' ELSE 'default' END
  AS source
FROM (SELECT DISTINCT tab FROM lg) t CROSS JOIN (VALUES {_DEFAULTS_SQL}) d(key, dv)
LEFT JOIN stg s ON s.tab = t.tab AND s.key = d.key"""))
def q_effective_settings(spark, sf):
    return RP.effective_settings(read_log(spark, sf))


CAP = "captured"  # every capture query works on the pages that have a selection


def live(spark, sf):
    def build():
        sel = RP.selection_replay(read_log(spark, sf))
        return CP.live_captures(sel, C.elements(spark, sf, CAP))
    return C.memo(spark, sf, "live", build)


def live_sql_ctes() -> str:
    return f""",
elo AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS el_ord FROM elp),
live AS (
  SELECT s.tab, row_number() OVER (PARTITION BY s.tab ORDER BY s.sel_order) AS sel_order, e.*
  FROM selr s JOIN elo e ON e.page_id = s.tab AND e.el_ord = s.element
  WHERE e.tag NOT IN {O.qlist(L.UNSELECTABLE_TAGS)}),
lastsel AS (SELECT * FROM live l WHERE sel_order = (SELECT max(sel_order) FROM live m WHERE m.tab = l.tab))"""


def LVW(select: str, render: bool = False) -> str:  # noqa: N802
    base = O.with_base("", derived=True).rstrip() + "," + O.log_ctes() + live_sql_ctes()
    if render:
        body = O.render_ctes()
        a, b = body.index("roots AS ("), body.index("nd0 AS (")
        base += body[:a] + (f"roots AS (SELECT DISTINCT e.*, g.ctx6 AS root_ctx, {', '.join('o.' + c for c in O.OPTIONS)} FROM elp e JOIN ancg g USING (page_id, pos) "
                            "JOIN live l ON l.page_id = e.page_id AND l.pos = e.pos JOIN opt o ON o.tab = l.tab),\n") + body[b:]
    return base + "\n" + select


@query("live_captures", LVW("SELECT tab, sel_order, page_id, pos, tag FROM live"))
def q_live_captures(spark, sf):
    return live(spark, sf).select("tab", "sel_order", "page_id", "pos", "tag")


@query("traverse_parent", LVW("""
SELECT l.tab, l.page_id, l.pos AS pos_before,
  CASE WHEN l.parent_pos IS NOT NULL AND NOT (p.depth = 0 AND p.tag = 'html') THEN l.parent_pos ELSE l.pos END
    AS pos_after
FROM lastsel l LEFT JOIN el p ON p.page_id = l.page_id AND p.pos = l.parent_pos"""))
def q_traverse_parent(spark, sf):
    return CP.traverse_parent(live(spark, sf))


@query("traverse_child", LVW("""
SELECT l.tab, l.page_id, l.pos AS pos_before,
  coalesce((SELECT min(c.pos) FROM el c WHERE c.page_id = l.page_id AND c.parent_pos = l.pos), l.pos) AS pos_after
FROM lastsel l"""))
def q_traverse_child(spark, sf):
    return CP.traverse_child(live(spark, sf), C.elements(spark, sf, CAP))


# ---------------------------------------------------------------------------
# steps 6-7: styles, html+css, token costs, capture outputs, prompts
# ---------------------------------------------------------------------------
from weblens.operators import payload as PL  # noqa: E402
from weblens.operators import prompt as PR  # noqa: E402

STYLE_FRAGS = """
SELECT p.page_id, p.root_pos, p.place AS k1, 0 AS k2, 0 AS k3,
  CASE WHEN strpos(regexp_replace(e.summary, '\\s+', '', 'g'), '#') > 0 THEN regexp_replace(e.summary, '\\s+', '', 'g')
       ELSE e.selector END || ' {' || chr(10) || '  ' || array_to_string(s.lines, chr(10) || '  ') || chr(10) || '}'
    AS frag
FROM rp p JOIN stl s ON s.page_id = p.page_id AND s.pos = p.pos JOIN elp e ON e.page_id = p.page_id AND e.pos = p.pos
WHERE p.kind = 'open' AND (p.sup_hidden IS NULL OR p.sup_hidden < p.root_pos) AND len(s.lines) > 0 AND (p.o_depth IS NULL OR p.rd <= p.o_depth)"""


def raw_select(frags: str, sep: str) -> str:
    return f"""
SELECT r.page_id, r.pos, r.root_ctx, r.o_ctx, r.o_css, r.o_trunc, coalesce(o.raw_output, '') AS raw
FROM roots r LEFT JOIN (
  SELECT page_id, root_pos, string_agg(frag, {sep} ORDER BY k1, k2, k3) AS raw_output FROM ({frags})
  GROUP BY page_id, root_pos) o ON o.page_id = r.page_id AND o.root_pos = r.pos"""


def html_css_select() -> str:
    block = "h.raw || CASE WHEN h.o_css THEN chr(10) || chr(10) || '<style>' || chr(10) || s.raw || chr(10) || '</style>' ELSE '' END"
    return f"""
SELECT h.page_id, h.pos, 'html-css' AS format, {O.finalize_sql(block, 'h')} AS output
FROM ({raw_select(CLEAN_FRAGS, "''")}) h JOIN ({raw_select(STYLE_FRAGS, "chr(10) || chr(10)")}) s USING (page_id, pos)"""


def SW(select: str, depth: int | None = None) -> str:  # noqa: N802
    return O.with_base("", derived=True).rstrip() + O.render_ctes(depth).rstrip() + O.styles_cte() + "\n" + select


@query("declared_styles", SW(f"SELECT page_id, pos, raw AS styles FROM ({raw_select(STYLE_FRAGS, 'chr(10) || chr(10)')})"))
def q_declared_styles(spark, sf):
    d = R.declared_styles(C.elements(spark, sf), roots(spark, sf), finalize=False)
    return d.select("page_id", "pos", F.col("raw").alias("styles"))


def _depth_limited(depth: int) -> None:
    """The outputs cut at a depth below the root."""
    opts = R.Options(depth=depth)

    @query(f"clean_html_depth{depth}", RW(render_select(clean_frags(), "''", "clean-html"), depth))
    def clean(spark, sf):
        return R.clean_html(nodes_text(spark, sf), roots(spark, sf), opts)

    @query(f"structure_depth{depth}", RW(render_select(structure_frags(), "chr(10)", "structure"), depth))
    def structure(spark, sf):
        return R.structure(nodes_text(spark, sf), roots(spark, sf), opts)

    @query(f"a11y_depth{depth}", RW(render_select(a11y_frags(), "chr(10)", "accessibility"), depth))
    def a11y(spark, sf):
        return R.a11y_outline(nodes_text(spark, sf), roots(spark, sf), opts)

    styles = raw_select(STYLE_FRAGS, "chr(10) || chr(10)")

    @query(f"styles_depth{depth}", SW(f"SELECT page_id, pos, raw AS styles FROM ({styles})", depth))
    def declared(spark, sf):
        d = R.declared_styles(C.elements(spark, sf), roots(spark, sf), opts, finalize=False)
        return d.select("page_id", "pos", F.col("raw").alias("styles"))


for _d in (0, 1):
    _depth_limited(_d)


@query("html_css", SW(html_css_select()))
def q_html_css(spark, sf):
    return R.html_css(nodes_text(spark, sf), C.elements(spark, sf), roots(spark, sf))


def region_outputs(spark, sf):
    """clean-html, structure and accessibility for every region root, from one
    pass over the (root, node) pairs."""
    return R.multi_format(nodes_text(spark, sf), roots(spark, sf))


def _formats_union_sql() -> str:
    return (f"{render_select(CLEAN_FRAGS, chr(39) * 2, 'clean-html')} UNION ALL "
            f"{render_select(structure_frags(), 'chr(10)', 'structure')} UNION ALL "
            f"{render_select(a11y_frags(), 'chr(10)', 'accessibility')}")


def all_outputs(spark, sf, r, view, opts=R.Options()):
    """All six formats of the root elements ``r``: ``(page_id, pos, format, output)``."""
    e, nt = C.elements(spark, sf, view), nodes_text(spark, sf, view)
    pages, tt = C.pages(spark, sf, view), titles(spark, sf, view)
    parts = S.page_parts(pages, e, tt)
    mine = _scope(e).join(r.select("page_id", "pos"), ["page_id", "pos"], "left_semi")
    pay = PL.selector_payload(mine, LC.locator_matches(els_src(spark, sf, view), first_texts(spark, sf, view), mine, C.kept(spark, sf, view)))
    docs = PL.selector_document(pay, S.page_title(pages, tt), r, opts)
    return R.multi_format(nt, r, opts).unionByName(S.snapshot_for_roots(parts, r, opts)).unionByName(docs)


def capture_outputs(spark, sf):
    """Outputs of every live capture in the six formats, each by the options of its
    tab: ``(tab, sel_order, page_id, pos, format, output)``."""
    def build():
        lv = live(spark, sf)
        # a page has one tab, so a root has one set of options
        r = lv.drop("sel_order").dropDuplicates(["page_id", "pos"]).join(RP.options(read_log(spark, sf)), "tab").drop("tab")
        return lv.select("tab", "sel_order", "page_id", "pos").join(all_outputs(spark, sf, r, CAP, R.Options(per_root=True)), ["page_id", "pos"])
    return C.memo(spark, sf, "capture_outputs", build)


def six_formats_sql() -> str:
    snap = f"""
SELECT r.page_id, r.pos, 'page-snapshot' AS format, {O.finalize_sql("sp.body || r.summary", "r")} AS output
FROM roots r JOIN (SELECT t.page_id, replace(s.snapshot, 'CURRENT_SELECTION: ' || s.cur, 'CURRENT_SELECTION: ') AS body
  FROM ttl t JOIN ({snapshot_sql().replace("AS snapshot", "AS snapshot, (SELECT arg_min(summary, pos) FROM elx x WHERE x.page_id = t.page_id AND x.tag = 'body') AS cur")}) s
  USING (page_id)) sp USING (page_id)"""
    doc = f"""
SELECT r.page_id, r.pos, 'selectors' AS format, {O.finalize_sql("d.doc", "r")} AS output
FROM roots r JOIN ({OL.document_sql()}) d USING (page_id, pos)"""
    return f"{_formats_union_sql()} UNION ALL {html_css_select()} UNION ALL {snap} UNION ALL {doc}"


def capture_outputs_sql() -> str:
    return (f"SELECT l.tab, l.sel_order, o.page_id, o.pos, o.format, o.output FROM live l JOIN ("
            f"{six_formats_sql()}) o ON o.page_id = l.page_id AND o.pos = l.pos")


def CW(select: str) -> str:  # noqa: N802
    base = LVW("", render=True).rstrip() + O.styles_cte() + OL.ctes().rstrip() + "," + TITLE_SQL
    return base + "\n" + select


def RSW(select: str) -> str:  # noqa: N802
    """Everything that all six formats of the page regions need."""
    return (O.with_base("", derived=True).rstrip() + O.render_ctes().rstrip() + O.styles_cte() + OL.ctes().rstrip() + "," + TITLE_SQL
            + "\n" + select)


LOW_BUDGET = 400  # tokens; a budget that some of the outputs exceed


def tokens_sql(budget: int) -> str:
    return f"""
SELECT page_id, pos, format, length(output) AS chars, CAST(ceil(length(output) / 4) AS BIGINT) AS tokens,
  ceil(length(output) / 4) > {budget} AS over_budget
FROM ({six_formats_sql()})"""


def region_formats(spark, sf):
    """All six formats of every page region."""
    return C.memo(spark, sf, "region_formats", lambda: all_outputs(spark, sf, roots(spark, sf), None))


@query("token_costs", RSW(tokens_sql(L.DEFAULTS["maxTokenWarning"])))
def q_token_costs(spark, sf):
    return PR.token_costs(region_formats(spark, sf)).select("page_id", "pos", "format", "chars", "tokens", "over_budget")


@query("over_budget", RSW(f"SELECT page_id, pos, format, tokens FROM ({tokens_sql(LOW_BUDGET)}) WHERE over_budget"))
def q_over_budget(spark, sf):
    return PR.token_costs(region_formats(spark, sf), LOW_BUDGET).filter("over_budget").select("page_id", "pos", "format", "tokens")


def format_maps(spark, sf):
    o = capture_outputs(spark, sf).groupBy("tab", "sel_order", "page_id", "pos")
    return o.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "output"))))).alias("formats"))


FORMATS_SQL = f"""
SELECT tab, sel_order, page_id, pos, '{{' || string_agg(to_json(format)::VARCHAR || ':' || to_json(output)::VARCHAR, ',' ORDER BY format) || '}}' AS formats
FROM ({capture_outputs_sql()}) GROUP BY tab, sel_order, page_id, pos"""


@query("all_formats", CW(FORMATS_SQL))
def q_all_formats(spark, sf):
    return format_maps(spark, sf)


@query("capture_rows", CW(f"""
SELECT l.tab, l.sel_order, l.page_id || '-' || l.pos AS selection_id, l.summary, l.selector, l.tag AS tag_name, f.formats
FROM live l JOIN ({FORMATS_SQL}) f USING (tab, sel_order)"""))
def q_capture_rows(spark, sf):
    return CP.capture_rows(live(spark, sf), format_maps(spark, sf).select("tab", "sel_order", "formats"))


COMBINED_SQL = f"""
SELECT tab, format, string_agg(output, chr(10) || chr(10) ORDER BY sel_order) AS output, count(*) AS items
FROM ({capture_outputs_sql()}) WHERE output <> '' GROUP BY tab, format"""


@query("combined_output", CW(COMBINED_SQL))
def q_combined_output(spark, sf):
    return PR.combined_output(capture_outputs(spark, sf))


@query("capture_sink", CW(f"SELECT tab, sel_order, format, output FROM ({capture_outputs_sql()}) WHERE format IN ('structure', 'html-css')"))
def q_capture_sink(spark, sf):
    """All outputs written partitioned by format; two of the formats read back."""
    path = scratch_path(spark, "captures")
    write_outputs(capture_outputs(spark, sf), path)
    return read_outputs(spark, path, ["structure", "html-css"]).select("tab", "sel_order", "format", "output")


@query("current_output", CW(f"""
SELECT o.tab, o.o_format AS format, coalesce(c.output, '') AS output FROM opt o LEFT JOIN ({COMBINED_SQL}) c ON c.tab = o.tab AND c.format = o.o_format"""))
def q_current_output(spark, sf):
    """What each tab shows: its combined output in its current format."""
    o = RP.options(read_log(spark, sf)).select("tab", F.col("opt_format").alias("format"))
    return o.join(PR.combined_output(capture_outputs(spark, sf)).drop("items"), ["tab", "format"], "left").fillna("", ["output"])


@query("tab_options", GW("SELECT tab, o_format AS format, o_depth AS depth, o_strip AS strip_noise, o_ctx AS include_context, o_css AS include_css, o_hidden AS include_hidden, o_trunc AS truncation FROM opt"))
def q_tab_options(spark, sf):
    o = RP.options(read_log(spark, sf))
    return o.select("tab", *[F.col(f"opt_{c}").alias(c) for c in ("format", "depth", "strip_noise", "include_context", "include_css", "include_hidden", "truncation")])


def prompt_sql() -> str:
    def tmpl(lines):
        parts = []
        for line in lines:
            s = O.q(line)
            for f, e in (("{title}", "t.title"), ("{url}", "t.url"), ("{count}", "CAST(n.cnt AS VARCHAR)"),
                         ("{output}", "coalesce(c.output, '')"), ("{format}", "f.format")):
                s = s.replace(f, "' || " + e + " || '")
            parts.append(s)
        return " || chr(10) || ".join(parts)
    cases = " ".join(f"WHEN f.format = {O.q(k)} THEN {tmpl(v)}" for k, v in PR.PROMPT_TEMPLATES.items())
    fmts = ", ".join(f"({O.q(x)})" for x in L.FORMATS)
    return f"""
SELECT n.tab, f.format, CASE {cases} ELSE {tmpl(PR.FALLBACK_TEMPLATE)} END AS prompt
FROM (SELECT tab, count(*) AS cnt FROM live GROUP BY tab) n CROSS JOIN (VALUES {fmts}) f(format)
JOIN ttl t ON t.page_id = n.tab
LEFT JOIN ({COMBINED_SQL}) c ON c.tab = n.tab AND c.format = f.format"""


@query("prompt_text", CW(prompt_sql()))
def q_prompt_text(spark, sf):
    lv = live(spark, sf)
    n = lv.groupBy("tab").agg(F.count("*").alias("cnt"))
    f = n.select("tab", "cnt", F.explode(F.array(*[F.lit(x) for x in L.FORMATS])).alias("format"))
    comb = PR.combined_output(capture_outputs(spark, sf)).select("tab", "format", "output")
    t = S.page_title(C.pages(spark, sf, CAP), titles(spark, sf, CAP))
    j = f.join(comb, ["tab", "format"], "left").join(t, F.col("tab") == F.col("page_id"), "left")
    return j.select("tab", "format", PR.build_prompt(F.col("format"), F.col("title"), F.col("url"), F.col("cnt"),
                                                     F.coalesce("output", F.lit(""))).alias("prompt"))


# ---------------------------------------------------------------------------
# JSON outputs and the stream
# ---------------------------------------------------------------------------
@query("selector_payload", LW(f"SELECT page_id, pos, payload FROM ({OL.payload_sql()})"))
def q_selector_payload(spark, sf):
    e = _scope(C.elements(spark, sf))
    return PL.selector_payload(e, _locators(spark, sf)).select("page_id", "pos", F.to_json("payload").alias("payload"))


@query("selector_document", CW(f"SELECT DISTINCT page_id, pos, format, output FROM ({capture_outputs_sql()}) WHERE format = 'selectors'"))
def q_selector_document(spark, sf):
    return capture_outputs(spark, sf).filter("format = 'selectors'").select("page_id", "pos", "format", "output").distinct()


@query("stream_snapshot")
def q_stream_snapshot(spark, sf):
    from weblens.streaming.page_feed import stream_snapshot
    return stream_snapshot(spark, sf)


ORACLE["stream_snapshot"] = ORACLE["page_snapshot"]


@query("selection_replay_stream")
def q_selection_replay_stream(spark, sf):
    from weblens.streaming.selection_stream import run_selection_stream
    return run_selection_stream(spark, sf).drop("late")


ORACLE["selection_replay_stream"] = ORACLE["selection_replay"]


@query("selection_state_stream")
def q_selection_state_stream(spark, sf):
    from weblens.streaming.selection_state import run_selection_state
    return run_selection_state(spark, sf)


ORACLE["selection_state_stream"] = ORACLE["selection_replay"]


@query("settings_replay_stream")
def q_settings_replay_stream(spark, sf):
    from weblens.streaming.settings_stream import run_settings_stream
    return run_settings_stream(spark, sf)


ORACLE["settings_replay_stream"] = ORACLE["settings_replay"]


# ---------------------------------------------------------------------------
# the fixture view with more markup: ids, ARIA, forms, hidden subtrees, shadow roots
# ---------------------------------------------------------------------------
RICH = [
    "page_counts", "page_snapshot", "element_tree", "text_nodes", "attributes", "kept_attributes", "nth_of_type", "context_chain", "css_path",
    "text_content", "direct_text", "hidden_elements", "images_missing_alt", "clean_html", "structure", "a11y_outline", "a11y_findings",
    "clean_html_depth1", "structure_depth1", "styles_depth1", "html_css", "ranked_selectors", "shortest_unique", "xpath_relative", "xpath_text",
    "locator_matches",
]


def _rich(name: str) -> None:
    def build(spark, sf):
        with C.using("rich"):
            return QUERIES[name](spark, sf)

    QUERIES[f"rich_{name}"] = build
    ORACLE[f"rich_{name}"] = ORACLE[name].replace(O.pages_sql("raw"), O.pages_sql("rich"))


for _n in RICH:
    _rich(_n)
