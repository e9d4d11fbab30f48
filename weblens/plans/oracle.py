"""DuckDB oracle SQL.

Independent re-statement of every value-checked query for DuckDB over the
pre-registered parquet views. The end-position rules are the same as the
Spark tree builder's, but depth, parent, ancestors and text content are
computed differently here (range joins and correlated subqueries instead of
window sweeps), so the check exercises the Spark plan, not a copy of it.
"""

from __future__ import annotations

from weblens.functions import lists as L
from weblens.sources.log import OPTION_VALUES
from weblens.sources.pages import MALFORMED_REPLACEMENTS, RICH_REPLACEMENTS


RAW_TAGS = L.RAW_TEXT_TAGS + L.RCDATA_TAGS

# The oracle's own tokenizer: attributes are spelled out one by one, where the
# Spark side takes quoted stretches as they come.
_ATTRIBUTES = r"""(?:[^"'>]|"[^"]*"|'[^']*')*"""
_NAME_END = r"(?:\s|/)"
TOKEN_RX = "(?is)" + "|".join([
    "<!--.*?-->", r"<!\[CDATA\[.*?\]\]>", "<![^>]*>", r"<\?[^>]*>", "</>", "</[^a-z>][^>]*>",
    *[f"<{t}>.*?</{t}(?:{_NAME_END}[^>]*)?>|<{t}{_NAME_END}{_ATTRIBUTES}>.*?</{t}(?:{_NAME_END}[^>]*)?>" for t in RAW_TAGS],
    f"<[a-z]{_ATTRIBUTES}>", f"</[a-z]{_ATTRIBUTES}>", "(?:[^<]+|<[^a-z<!/?])+", "<",
])
RAW_OPEN_RX = f"(?s)^<[A-Za-z]+(?:>|{_NAME_END}{_ATTRIBUTES}>)"
RAW_END_RX = f"</[A-Za-z]+(?:{_NAME_END}[^>]*)?>$"
ATTR_RX = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


WS = L.JS_WS_CLASS + "+"


def clean_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(WS)}, ' ', 'g'), ' ')"


def js_trim_sql(e: str) -> str:
    return f"regexp_replace({e}, {q('^' + WS + '|' + WS + '$')}, '', 'g')"


ENTITY_RX = "(?s)&[A-Za-z][A-Za-z0-9]*[;=]?|&#[0-9]+[;=]?|&#[xX][0-9A-Fa-f]+[;=]?|&|[^&]+"


def decode_cte(name: str, strings: str, attribute: bool = False) -> str:
    """CTE (s, d) of the strings of a select (column s) that hold a reference:
    the pieces of a string as rows, joined with the tables of names, put together
    again in order."""
    def cp(n):
        return (f"CASE WHEN {n} > 0 AND {n} <= 1114111 AND NOT ({n} BETWEEN 55296 AND 57343) "
                f"THEN translate(chr({n}::INTEGER), {q(L.CP1252_FROM)}, {q(L.CP1252_TO)}) ELSE '\ufffd' END")
    body = "rtrim(t, ';=')"
    dec = f"coalesce(TRY_CAST(substr({body}, 3) AS HUGEINT), 0)"
    hexa = (f"(CASE WHEN length(ltrim(substr({body}, 4), '0')) BETWEEN 1 AND 6 "
            f"THEN TRY_CAST('0x' || substr({body}, 4) AS BIGINT) ELSE 0 END)")
    tail = "CASE WHEN ends_with(t, '=') THEN '=' ELSE '' END"
    # in an attribute a name without semicolon must be all that stands there
    whole = f" AND rtrim(t, ';') = '&' || n.name" if attribute else ""
    return f"""{name}_p AS (
  SELECT s, unnest(p) AS t, generate_subscripts(p, 1) AS i
  FROM (SELECT DISTINCT s, regexp_extract_all(s, {q(ENTITY_RX)}) AS p FROM ({strings}) WHERE strpos(s, '&') > 0)),
{name}_l AS (
  SELECT t, arg_max(n.ch || substr(t, length(n.name) + 2), length(n.name)) AS d
  FROM (SELECT DISTINCT t FROM {name}_p WHERE regexp_matches(t, '^&[A-Za-z]')) JOIN leg n ON starts_with(t, '&' || n.name){whole} GROUP BY t),
{name} AS (
  SELECT s, string_agg(CASE WHEN regexp_matches(t, '^&#[xX][0-9A-Fa-f]') THEN {cp(hexa)} || {tail}
                            WHEN regexp_matches(t, '^&#[0-9]') THEN {cp(dec)} || {tail}
                            ELSE coalesce(ent.ch, {name}_l.d, t) END, '' ORDER BY i) AS d
  FROM {name}_p LEFT JOIN ent ON t = '&' || ent.name LEFT JOIN {name}_l USING (t) GROUP BY s),"""


def decoded(name: str, e: str) -> str:
    return f"coalesce((SELECT d FROM {name} x_ WHERE x_.s = {e}), {e})"


def ent_cte() -> str:
    rows = ", ".join(f"({q(n)}, {q(c)})" for n, c in zip(L.ENTITY_NAMES, L.ENTITY_CHARS))
    short = ", ".join(f"({q(n)}, {q(c)})" for n, c in zip(L.LEGACY_NAMES, L.LEGACY_CHARS))
    return f"ent(name, ch) AS (VALUES {rows}),\nleg(name, ch) AS (VALUES {short}),"


def escape_html_sql(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        e = f"replace({e}, {q(a)}, {q(b)})"
    return e


def css_escape_sql(e: str) -> str:
    bs = chr(92)
    x = f"regexp_replace({e}, {q('([^A-Za-z0-9_' + bs + '-' + bs + 'x{80}-' + bs + 'x{10FFFF}' + bs + 'x01-' + bs + 'x1f' + bs + 'x7f])')}, {q(bs * 2 + bs + '1')}, 'g')"
    x = f"regexp_replace({x}, '^([0-9])', {q(bs * 2 + '3' + bs + '1 ')})"
    x = f"regexp_replace({x}, '^-([0-9])', {q('-' + bs * 2 + '3' + bs + '1 ')})"
    x = (f"CASE WHEN regexp_matches({e}, {q('[' + bs + 'x01-' + bs + 'x1f' + bs + 'x7f]')}) THEN array_to_string(list_transform(string_split({x}, ''), "
         f"lambda h: CASE WHEN ascii(h) BETWEEN 1 AND 31 OR ascii(h) = 127 THEN {q(bs)} || lower(to_hex(ascii(h))) || ' ' ELSE h END), '') ELSE {x} END")
    return f"CASE WHEN {e} = '-' THEN {q(bs + '-')} ELSE {x} END"


def xpath_literal_sql(e: str) -> str:
    return (f"CASE WHEN strpos({e}, '\"') > 0 THEN 'concat(\"' || replace({e}, '\"', '\",''\"'',\"') || '\")' "
            f"ELSE '\"' || {e} || '\"' END")


def json_quote_sql(e: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"),
                 ("\f", "\\f")):
        e = f"replace({e}, {q(a)}, {q(b)})"
    return "'\"' || " + e + " || '\"'"


def pages_sql(view: str) -> str:
    h = "html"
    for a, b in {"raw": [], "rich": RICH_REPLACEMENTS, "malformed": MALFORMED_REPLACEMENTS}[view]:
        h = f"replace({h}, {q(a)}, {q(b)})"
    return f"SELECT page_id, url, {h} AS html FROM pages"


ATTR_NAMES = ["id", "class", "style", "hidden", "aria-hidden", "role", "aria-label", "aria-labelledby", "alt",
              "href", "name", "placeholder", "title", "data-testid", "data-cy", "data-test", "data-qa", "type",
              "shadowrootmode", "open"]


def acol(name: str) -> str:
    return "a_" + name.replace("-", "_")


STYLE_DISPLAY_NONE = r"(?i)(^|;)\s*display\s*:\s*none\s*(!\s*important\s*)?(;|$)"
# values that set the visibility; the rest hand on the parent's
_SETS = "hidden|visible|collapse|initial"
_HANDS_ON = "inherit|unset|revert|revert-layer"
STYLE_OPACITY_0 = r"(?i)(^|;)\s*opacity\s*:\s*(0+\.?0*|\.0+)%?\s*(!\s*important\s*)?(;|$)"


def base_ctes(view: str = "raw") -> str:
    """CTEs: pr (pages), tok, el (elements with end, depth, parent), txt,
    at (attribute rows), elx (elements + attributes + derived columns)."""
    src = pages_sql(view)
    opt_cases = []
    for name, starts, ends in L.OPTIONAL_END:
        opt_cases.append(
            f"WHEN s.tag = {q(name)} THEN least((SELECT min(b.pos) FROM tok b WHERE b.page_id = s.page_id AND "
            f"b.pos > s.pos AND ((b.kind = 'open' AND b.tag IN {qlist(starts)}) OR "
            f"(b.kind = 'close' AND b.tag IN {qlist(ends)}))), s.page_end)")
    opt = "\n          ".join(opt_cases)
    nonleaf = "(kind = 'open' AND NOT leaf)"
    pivot = ",\n      ".join(
        f"max(CASE WHEN name = {q(n)} THEN value END) AS {acol(n)}" for n in ATTR_NAMES)
    class_tokens = (f"list_filter(string_split_regex({js_trim_sql('coalesce(a_class, ' + q('') + ')')}, {q(WS)}), "
                    "lambda c: c <> '')")
    own_hidden = (
        f"((a_hidden IS NOT NULL AND NOT in_svg) OR coalesce(a_aria_hidden, '') = 'true' "
        f"OR regexp_matches(coalesce(a_style, ''), {q(STYLE_DISPLAY_NONE)}) "
        f"OR regexp_matches(coalesce(a_style, ''), {q(STYLE_OPACITY_0)}) "
        f"OR tag IN {qlist(L.UA_HIDDEN_TAGS)} "
        f"OR (tag = 'input' AND lower(coalesce(a_type, '')) = 'hidden') OR (tag = 'dialog' AND a_open IS NULL))"
    )
    decl = f"regexp_extract_all(lower(a_style), '(?:^|;)\\s*visibility\\s*:\\s*(?:{_SETS}|{_HANDS_ON})\\s*(?:!\\s*important|;|$|\\s)')"
    loud = f"list_filter({decl}, lambda d: contains(d, 'important'))"
    last = f"(CASE WHEN len({loud}) > 0 THEN {loud} ELSE {decl} END)[-1]"
    vis = f"CASE WHEN regexp_matches({last}, ':\\s*hidden') THEN 'hidden' WHEN regexp_matches({last}, ':\\s*(?:{_SETS})') THEN 'visible' END"
    hosts = qlist(L.SHADOW_HOST_TAGS)
    return f"""
{ent_cte()}
pr AS ({src}),
m AS (SELECT page_id, regexp_extract_all(html, {q(TOKEN_RX)}) AS a FROM pr),
t0 AS (SELECT page_id, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS k FROM m),
t1 AS (
  SELECT page_id, k, raw,
    CASE WHEN starts_with(raw, '<!') OR starts_with(raw, '<?') OR regexp_matches(raw, '^</[^A-Za-z]') THEN 'skip'
         WHEN regexp_matches(raw, '^</[A-Za-z]') THEN 'close'
         WHEN regexp_matches(raw, '^<[A-Za-z]') THEN 'open' ELSE 'text' END AS kind,
    lower(regexp_extract(raw, {q(r'^</?([A-Za-z][^\s/>]*)')}, 1)) AS tag
  FROM t0),
t2 AS (
  SELECT *, (kind = 'open' AND tag IN {qlist(RAW_TAGS)} AND regexp_matches(raw, {q(RAW_END_RX)})) AS is_raw,
    tag IN ('svg', 'math') OR (
      SELECT count(*) FILTER (WHERE o.kind = 'open' AND NOT ends_with(o.raw, '/>')) - count(*) FILTER (WHERE o.kind = 'close')
      FROM t1 o WHERE o.page_id = t1.page_id AND o.k <= t1.k AND o.tag IN ('svg', 'math')) > 0 AS in_foreign
  FROM t1),
t3 AS (
  SELECT *, regexp_replace(regexp_replace(raw, {q(RAW_OPEN_RX)}, ''), {q(RAW_END_RX)}, '') AS inner_text FROM t2),
{decode_cte("dect", "SELECT raw AS s FROM t3 WHERE kind = 'text' UNION ALL SELECT inner_text FROM t3 WHERE is_raw")}
tok AS (
  SELECT page_id, 4 * k AS pos, kind, tag,
    CASE WHEN is_raw THEN regexp_extract(raw, {q(RAW_OPEN_RX)}, 0) ELSE raw END AS raw,
    (kind = 'open' AND (is_raw OR tag IN {qlist(L.VOID_TAGS)} OR (in_foreign AND ends_with(raw, '/>')))) AS leaf,
    is_raw AS raw_el,
    CASE WHEN kind = 'text' THEN {decoded('dect', 't3.raw')} END AS text
  FROM t3
  UNION ALL
  SELECT page_id, 4 * k + 1, 'text', '', inner_text, false, false,
    CASE WHEN tag IN {qlist(L.RAW_TEXT_TAGS)} THEN inner_text ELSE {decoded('dect', 't3.inner_text')} END
  FROM t3
  WHERE is_raw AND inner_text <> ''),
lv AS (
  SELECT *, CASE WHEN {nonleaf} OR kind = 'close' THEN tag END AS ptag,
    sum(CASE WHEN {nonleaf} THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END)
      OVER (PARTITION BY page_id, CASE WHEN {nonleaf} OR kind = 'close' THEN tag END ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM tok),
lv2 AS (SELECT *, CASE WHEN kind = 'open' THEN s ELSE s + 1 END AS lvl FROM lv),
st AS (
  SELECT *, CASE WHEN {nonleaf} AND lead(kind) OVER w = 'close' THEN lead(pos) OVER w + 1 END AS strong_end,
    max(pos) OVER (PARTITION BY page_id) + 4 AS page_end
  FROM lv2 WINDOW w AS (PARTITION BY page_id, ptag, lvl ORDER BY pos)),
e1 AS (
  SELECT s.*,
    CASE WHEN s.kind = 'open' AND NOT s.leaf THEN
      CASE WHEN s.tag = 'p' THEN least(
          (SELECT min(b.pos) FROM tok b WHERE b.page_id = s.page_id AND b.pos > s.pos AND b.kind = 'close' AND b.tag = 'p') + 1,
          (SELECT min(b.pos) FROM tok b WHERE b.page_id = s.page_id AND b.pos > s.pos AND b.kind = 'open'
             AND b.tag IN {qlist(L.P_CLOSERS)}),
          (SELECT min(b.pos) FROM tok b WHERE b.page_id = s.page_id AND b.pos > s.pos AND b.kind = 'close'
             AND b.tag NOT IN {qlist(L.PHRASING_TAGS)} AND b.tag <> 'p'),
          s.page_end)
          WHEN s.strong_end IS NOT NULL THEN s.strong_end
          {opt}
      END END AS e1_end
  FROM st s),
ends0 AS (
  SELECT e.page_id, e.pos, e.tag, e.raw, e.raw_el,
    CASE WHEN e.e1_end IS NOT NULL THEN e.e1_end
         WHEN NOT e.leaf THEN coalesce((SELECT arg_max(c.e1_end, c.pos) FROM e1 c
                                        WHERE c.page_id = e.page_id AND c.e1_end IS NOT NULL
                                          AND c.pos < e.pos AND c.e1_end > e.pos), e.page_end)
         WHEN e.raw_el THEN e.pos + 2 ELSE e.pos + 1 END AS end_pos
  FROM e1 e WHERE e.kind = 'open'),
endn AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM ends0),
clip(page_id, i, pos, end_pos, stack) AS (
  SELECT page_id, i, pos, end_pos, [end_pos] FROM endn WHERE i = 1
  UNION ALL
  SELECT o.page_id, o.i, o.pos, least(o.end_pos, list_min(list_filter(c.stack, lambda x: x > o.pos))),
    list_append(list_filter(c.stack, lambda x: x > o.pos), least(o.end_pos, list_min(list_filter(c.stack, lambda x: x > o.pos))))
  FROM clip c JOIN endn o ON o.page_id = c.page_id AND o.i = c.i + 1),
enda AS (
  SELECT e.page_id, e.pos, e.tag, e.raw, e.raw_el, c.end_pos, e.tag = 'template' AS template,
    CASE WHEN e.tag = 'template' THEN nullif(regexp_extract(e.raw, '(?i)\\sshadowrootmode\\s*=\\s*["'']?(open|closed)["''\\s/>]', 1), '') END AS mode
  FROM ends0 e JOIN clip c USING (page_id, pos)),
hst AS (
  SELECT t.page_id, t.pos, lower(t.mode) AS mode, max(a.pos) AS host
  FROM enda t JOIN enda a ON a.page_id = t.page_id AND a.pos < t.pos AND a.end_pos > t.pos
  WHERE t.mode IS NOT NULL GROUP BY ALL),
rts AS (
  SELECT h.*, a.end_pos FROM hst h JOIN enda a USING (page_id, pos) JOIN enda o ON o.page_id = h.page_id AND o.pos = h.host
  WHERE (o.tag IN {hosts} OR contains(o.tag, '-'))
    AND NOT EXISTS (SELECT 1 FROM hst b WHERE b.page_id = h.page_id AND b.host = h.host AND b.pos < h.pos)),
inr AS (
  SELECT page_id, pos, end_pos FROM enda t WHERE t.template
    AND NOT EXISTS (SELECT 1 FROM rts r WHERE r.page_id = t.page_id AND r.pos = t.pos AND r.mode = 'open')),
sh AS (
  SELECT r.page_id, r.pos, r.end_pos, r.host FROM rts r WHERE r.mode = 'open'
    AND NOT EXISTS (SELECT 1 FROM inr a WHERE a.page_id = r.page_id AND a.pos < r.pos AND a.end_pos > r.pos)),
ends AS (
  SELECT * EXCLUDE (template, mode) FROM enda e WHERE NOT EXISTS (
    SELECT 1 FROM inr a WHERE a.page_id = e.page_id AND a.pos < e.pos AND a.end_pos > e.pos)
    AND NOT EXISTS (SELECT 1 FROM rts r WHERE r.page_id = e.page_id AND r.pos = e.pos)),
el0 AS (
  SELECT e.*,
    (SELECT count(*) FROM ends a WHERE a.page_id = e.page_id AND a.pos < e.pos AND a.end_pos > e.pos) AS depth,
    (SELECT max(a.pos) FROM ends a WHERE a.page_id = e.page_id AND a.pos < e.pos AND a.end_pos > e.pos) AS parent_pos,
    (SELECT count(*) FROM sh a WHERE a.page_id = e.page_id AND a.pos < e.pos AND a.end_pos > e.pos) AS slevel,
    (SELECT max(a.pos) FROM sh a WHERE a.page_id = e.page_id AND a.pos < e.pos AND a.end_pos > e.pos) AS scope,
    EXISTS (SELECT 1 FROM ends a WHERE a.page_id = e.page_id AND a.tag = 'svg' AND a.pos <= e.pos
            AND a.end_pos > e.pos) AS in_svg
  FROM ends e),
el AS (SELECT *, coalesce(scope > parent_pos, false) AS via_shadow FROM el0),
txt0 AS (
  SELECT t.page_id, t.pos, t.text,
    (SELECT max(a.pos) FROM ends a WHERE a.page_id = t.page_id AND a.pos < t.pos AND a.end_pos > t.pos) AS parent_pos,
    (SELECT count(*) FROM ends a WHERE a.page_id = t.page_id AND a.pos < t.pos AND a.end_pos > t.pos) AS depth,
    (SELECT count(*) FROM sh a WHERE a.page_id = t.page_id AND a.pos < t.pos AND a.end_pos > t.pos) AS slevel,
    (SELECT max(a.pos) FROM sh a WHERE a.page_id = t.page_id AND a.pos < t.pos AND a.end_pos > t.pos) AS scope
  FROM tok t WHERE t.kind = 'text' AND NOT EXISTS (
    SELECT 1 FROM inr a WHERE a.page_id = t.page_id AND a.pos < t.pos AND a.end_pos > t.pos)),
txt AS (SELECT *, coalesce(scope > parent_pos, false) AS via_shadow FROM txt0),
at0 AS (
  SELECT page_id, pos, regexp_replace(regexp_replace(raw, {q(r'^<[A-Za-z][^\s/>]*')}, ''), '>$', '') AS body
  FROM el),
at1 AS (
  SELECT page_id, pos, regexp_extract_all(body, {q(ATTR_RX)}, 1) AS n,
    regexp_extract_all(body, {q(ATTR_RX)}, 2) AS v2, regexp_extract_all(body, {q(ATTR_RX)}, 3) AS v3,
    regexp_extract_all(body, {q(ATTR_RX)}, 4) AS v4
  FROM at0),
at2 AS (
  SELECT page_id, pos, i, lower(n[i]) AS name, coalesce(v2[i], '') || coalesce(v3[i], '') || coalesce(v4[i], '') AS raw_value
  FROM (SELECT *, unnest(generate_series(1, len(n))) AS i FROM at1)),
{decode_cte("deca", "SELECT raw_value AS s FROM at2", True)}
at3 AS (SELECT page_id, pos, i, name, {decoded('deca', 'at2.raw_value')} AS value FROM at2),
atr AS (
  SELECT page_id, pos, i, name, value FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, pos, name ORDER BY i) AS rn FROM at3) WHERE rn = 1),
ea AS (
  SELECT page_id, pos,
      {pivot}
  FROM atr GROUP BY page_id, pos),
elx0 AS (
  SELECT el.*, {", ".join(acol(n) for n in ATTR_NAMES)},
    coalesce(a_id, '') AS id,
    {class_tokens} AS class_tokens,
    row_number() OVER (PARTITION BY el.page_id, parent_pos, scope, tag ORDER BY el.pos) AS nth_of_type,
    count(*) OVER (PARTITION BY el.page_id, parent_pos, scope, tag) AS n_same_tag
  FROM el LEFT JOIN ea USING (page_id, pos)),
elv AS (SELECT page_id, pos, end_pos, {vis} AS vis FROM elx0 WHERE a_style IS NOT NULL),
elx1 AS (
  SELECT *, {own_hidden} OR coalesce((
    SELECT arg_max(v.vis, v.pos) FROM elv v WHERE v.page_id = elx0.page_id AND v.vis IS NOT NULL AND v.pos <= elx0.pos AND v.end_pos > elx0.pos) = 'hidden', false) AS hidden
  FROM elx0),
elx AS (
  SELECT *, list_distinct_ordered AS classes,
    tag IN {qlist(L.SKIP_TAGS)} AS skip,
    tag || CASE WHEN id <> '' THEN '#' || id ELSE '' END
        || CASE WHEN in_svg THEN '' ELSE array_to_string(list_transform(class_tokens[1:3], lambda c: '.' || c), '') END
      AS summary
  FROM (SELECT *, list_filter(class_tokens, lambda c, i: list_position(class_tokens, c) = i) AS list_distinct_ordered
        FROM elx1))
"""


def derived_ctes() -> str:
    """More CTEs on top of ``base_ctes``: tc (textContent), anc (ancestor-or-
    self pairs by range join), elp (elements + paths, context, previews and
    suppression columns), txs (text nodes + suppression columns)."""
    sel_part = (f"tag || CASE WHEN len(classes) > 0 THEN '.' || array_to_string(list_transform(classes[1:2], "
                f"lambda c: {css_escape_sql('c')}), '.') ELSE '' END")
    css_part = ("CASE WHEN depth = 0 AND tag = 'html' THEN 'html' ELSE tag || CASE WHEN parent_pos IS NOT NULL "
                "AND n_same_tag > 1 THEN ':nth-of-type(' || nth_of_type || ')' ELSE '' END END")
    xpath_part = ("CASE WHEN depth = 0 AND tag = 'html' THEN '/html' ELSE tag || CASE WHEN parent_pos IS NOT NULL "
                  "AND n_same_tag > 1 THEN '[' || nth_of_type || ']' ELSE '' END END")
    return f""",
tc AS (
  SELECT e.page_id, e.pos, coalesce(string_agg(t.text, '' ORDER BY t.pos), '') AS text
  FROM el e LEFT JOIN txt t ON t.page_id = e.page_id AND t.pos > e.pos AND t.pos < e.end_pos AND t.slevel = e.slevel
  GROUP BY e.page_id, e.pos),
elq AS (
  SELECT *, {sel_part} AS sel_part, {css_part} AS css_part, {xpath_part} AS xpath_part FROM elx),
anc AS (
  SELECT e.page_id, e.pos, a.pos AS apos, a.depth AS adepth, a.tag AS atag, a.hidden AS ahidden, a.skip AS askip,
    a.summary AS asummary, a.sel_part, a.css_part, a.xpath_part, e.depth AS edepth
  FROM elq e JOIN elq a ON a.page_id = e.page_id AND a.pos <= e.pos AND a.end_pos > e.pos),
ancg AS (
  SELECT page_id, pos,
    max(CASE WHEN ahidden THEN apos END) AS sup_hidden,
    max(CASE WHEN ahidden OR askip THEN apos END) AS sup_skip,
    max(CASE WHEN ahidden OR (askip AND atag <> 'svg') THEN apos END) AS sup_skip_nosvg,
    max(CASE WHEN (ahidden OR askip) AND apos < pos THEN apos END) AS anc_skip,
    max(CASE WHEN askip THEN apos END) AS sup_s, max(CASE WHEN askip AND atag <> 'svg' THEN apos END) AS sup_sn,
    max(CASE WHEN askip AND apos < pos THEN apos END) AS anc_s,
    string_agg(css_part, ' > ' ORDER BY adepth) AS css_path,
    string_agg(xpath_part, '/' ORDER BY adepth) AS xpath_absolute,
    string_agg(CASE WHEN adepth >= edepth - 4 THEN sel_part END, ' > ' ORDER BY adepth) AS class_chain,
    coalesce(string_agg(CASE WHEN apos < pos AND NOT (adepth = 0 AND atag = 'html') AND adepth >= edepth - 6
                          AND (adepth >= edepth - 6) THEN asummary END, ' > ' ORDER BY adepth), '') AS ctx6
  FROM anc GROUP BY page_id, pos),
elp AS (
  SELECT e.*, g.sup_hidden, g.sup_skip, g.sup_skip_nosvg, g.anc_skip, g.sup_s, g.sup_sn, g.anc_s, g.css_path, g.xpath_absolute,
    CASE WHEN e.id <> '' THEN '#' || {css_escape_sql('e.id')} ELSE g.class_chain END AS selector,
    tc.text, substr({clean_sql('tc.text')}, 1, {L.PREVIEW_CHARS}) AS preview
  FROM elq e JOIN ancg g USING (page_id, pos) JOIN tc USING (page_id, pos)),
txs AS (
  SELECT t.*,
    (SELECT max(h.pos) FROM elx h WHERE h.page_id = t.page_id AND h.hidden AND h.pos < t.pos AND h.end_pos > t.pos)
      AS sup_hidden,
    (SELECT max(h.pos) FROM elx h WHERE h.page_id = t.page_id AND (h.hidden OR h.skip) AND h.pos < t.pos
       AND h.end_pos > t.pos) AS sup_skip,
    (SELECT max(h.pos) FROM elx h WHERE h.page_id = t.page_id AND (h.hidden OR (h.skip AND h.tag <> 'svg'))
       AND h.pos < t.pos AND h.end_pos > t.pos) AS sup_skip_nosvg,
    (SELECT max(h.pos) FROM elx h WHERE h.page_id = t.page_id AND h.skip AND h.pos < t.pos AND h.end_pos > t.pos) AS sup_s,
    (SELECT max(h.pos) FROM elx h WHERE h.page_id = t.page_id AND h.skip AND h.tag <> 'svg' AND h.pos < t.pos AND h.end_pos > t.pos) AS sup_sn
  FROM txt t)
"""


def with_base(select: str, view: str = "raw", derived: bool = True) -> str:
    return "WITH RECURSIVE " + base_ctes(view) + (derived_ctes() if derived else "") + "\n" + select


NOISE_RX = "^(?:" + "|".join(p.replace("-", "\\-") for p in L.NOISE_PREFIXES) + ")"
REGION_TAGS = ["body", "header", "nav", "main", "article", "section", "aside", "footer", "form"]


def truncate_sql(x: str, n) -> str:
    parts = f"string_split({x}, chr(10))"
    return (f"CASE WHEN len({parts}) <= {n} THEN {x} ELSE array_to_string({parts}[1:{n}], chr(10)) || chr(10) "
            f"|| '... [truncated ' || (len({parts}) - {n}) || ' more lines]' END")


def finalize_sql(x: str, root: str) -> str:
    """Context header and line limit by the options of the root row ``root``."""
    ctx = f"CASE WHEN {root}.o_ctx THEN coalesce({root}.root_ctx, '') ELSE '' END"
    y = f"CASE WHEN {ctx} <> '' THEN 'CONTEXT: ' || {ctx} || chr(10) || chr(10) || {x} ELSE {x} END"
    return f"(SELECT {truncate_sql('y_.y', f'{root}.o_trunc')} FROM (SELECT {y} AS y) y_)"


OPTIONS = ["o_depth", "o_strip", "o_ids", "o_ctx", "o_css", "o_trunc", "o_hidden"]


def option_literals(depth: int | None) -> str:
    return (f"{'NULL' if depth is None else depth}::INTEGER AS o_depth, true AS o_strip, true AS o_ids, true AS o_ctx, true AS o_css, "
            f"{L.DEFAULTS['truncationThreshold']} AS o_trunc, false AS o_hidden")


def render_ctes(depth: int | None = None) -> str:
    """Roots (page regions), kept-attribute open tags, and (root, node) pairs."""
    noise = f"regexp_matches(name, {q(NOISE_RX)})"

    def kept(name: str, rule: str) -> str:
        return f"""string_agg(CASE WHEN {rule} THEN name || '="' || {escape_html_sql('value')} || '"' END, ' ' ORDER BY i) AS {name}"""

    listed = f"name IN {qlist(L.KEEP_ATTRS)}"
    tag = lambda k: f"'<' || e.tag || CASE WHEN coalesce(k.{k}, '') <> '' THEN ' ' || k.{k} ELSE '' END || '>'"
    return f""",
kept AS (
  SELECT page_id, pos, {kept('kids', f"{listed} OR name = 'data-testid' OR NOT {noise}")}, {kept('knoids', f"{listed} OR NOT {noise}")}, {kept('kall', 'true')}
  FROM atr GROUP BY page_id, pos),
roots AS (SELECT e.*, g.ctx6 AS root_ctx, {option_literals(depth)} FROM elp e JOIN ancg g USING (page_id, pos)
          WHERE e.tag IN {qlist(REGION_TAGS)} OR (e.depth = 0 AND NOT EXISTS (
            SELECT 1 FROM el o WHERE o.page_id = e.page_id AND o.tag IN {qlist(REGION_TAGS)}))),
nd0 AS (
  SELECT e.page_id, e.pos, 'open' AS kind, e.tag, e.depth, e.slevel, e.via_shadow, e.end_pos, e.hidden, e.sup_skip, e.sup_skip_nosvg,
    e.sup_hidden, e.anc_skip, e.preview, NULL::VARCHAR AS ntext, e.summary,
    {tag('kids')} AS otag, {tag('knoids')} AS otag_noids, {tag('kall')} AS otag_all, e.sup_s, e.sup_sn, e.anc_s
  FROM elp e LEFT JOIN kept k USING (page_id, pos)
  UNION ALL
  SELECT page_id, pos, 'text', NULL, depth, slevel, via_shadow, NULL, NULL, sup_skip, sup_skip_nosvg, sup_hidden, NULL, NULL, text,
    NULL, NULL, NULL, NULL, sup_s, sup_sn, NULL
  FROM txs
  UNION ALL
  SELECT s.page_id, s.pos, 'shadow', '#shadow-root', h.depth + 1, h.slevel, false, s.end_pos, NULL, h.sup_skip, h.sup_skip_nosvg, h.sup_hidden, NULL, NULL, NULL,
    NULL, '<template shadowrootmode="open">', '<template shadowrootmode="open">', '<template shadowrootmode="open">', h.sup_s, h.sup_sn, NULL
  FROM sh s JOIN elp h ON h.page_id = s.page_id AND h.pos = s.host),
hch AS (SELECT n.page_id, n.pos, list(s.host ORDER BY s.pos) AS hosts, max(CASE WHEN n.kind = 'shadow' THEN n.pos END) AS own
        FROM nd0 n JOIN sh s ON s.page_id = n.page_id AND s.pos < n.pos AND s.end_pos > n.pos GROUP BY n.page_id, n.pos),
nd AS (
  SELECT n.*, coalesce(h.hosts, []) AS hosts,
    coalesce(h.hosts, []) || CASE WHEN n.kind = 'shadow' THEN [(SELECT s.host FROM sh s WHERE s.page_id = n.page_id AND s.pos = n.pos), -1] ELSE [n.pos] END AS place
  FROM nd0 n LEFT JOIN hch h USING (page_id, pos)),
rp AS (
  SELECT r.page_id, r.pos AS root_pos, {", ".join("r." + o for o in OPTIONS)}, n.* REPLACE (
      CASE WHEN r.o_hidden THEN n.sup_s ELSE n.sup_skip END AS sup_skip, CASE WHEN r.o_hidden THEN n.sup_sn ELSE n.sup_skip_nosvg END AS sup_skip_nosvg,
      CASE WHEN r.o_hidden THEN NULL ELSE n.sup_hidden END AS sup_hidden, CASE WHEN r.o_hidden THEN n.anc_s ELSE n.anc_skip END AS anc_skip,
      n.hidden AND NOT r.o_hidden AS hidden,
      CASE WHEN NOT r.o_strip THEN n.otag_all WHEN NOT r.o_ids THEN n.otag_noids ELSE n.otag END AS otag), n.depth - r.depth AS rd, n.depth - r.depth + n.slevel - r.slevel AS od
  FROM roots r JOIN nd n ON n.page_id = r.page_id AND n.pos >= r.pos AND n.pos < r.end_pos)
"""


def log_ctes() -> str:
    fmts = "[" + ", ".join(q(f) for f in L.FORMATS) + "]"
    n = len(OPTION_VALUES)
    keys = " ".join(f"WHEN ((element % {n}) + {n}) % {n} = {i} THEN {q(name)}" for i, name in enumerate(OPTION_VALUES))
    turn = f"((element - ((element % {n}) + {n}) % {n}) // {n})"
    values = " ".join(f"WHEN ((element % {n}) + {n}) % {n} = {i} THEN [{', '.join(map(q, vs))}][({turn} % {len(vs)} + {len(vs)}) % {len(vs)} + 1]"
                      for i, vs in enumerate(OPTION_VALUES.values()))

    def opt(key: str, default: str) -> str:
        return f"coalesce(max(CASE WHEN s.key = {q(key)} THEN s.value END), {q(default)})"

    flags = ", ".join(f"{opt(k, str(L.DEFAULTS[k]).lower())} = 'true' AS {o}" for k, o in
                      (("stripNoise", "o_strip"), ("keepTestIds", "o_ids"), ("includeContext", "o_ctx"), ("includeCSS", "o_css"), ("includeHidden", "o_hidden")))
    return f"""
lg AS (
  SELECT *, CASE WHEN event_type = 'purchase' THEN 'format' WHEN event_type = 'view' THEN CASE {keys} END END AS key,
    CASE WHEN event_type = 'purchase' THEN {fmts}[(element % 6 + 6) % 6 + 1] WHEN event_type = 'view' THEN CASE {values} END END AS value
  FROM (SELECT user_id AS tab, ts, event_id, event_type,
    CASE event_type WHEN 'click' THEN 'toggle' WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'inspector'
      WHEN 'purchase' THEN 'set' WHEN 'view' THEN 'set' ELSE 'ignore' END AS type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS element
  FROM events)),
sel AS (
  SELECT tab, element, count(*) AS toggles, max((ts, event_id)) AS last FROM lg t
  WHERE type = 'toggle' AND element IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM lg c WHERE c.tab = t.tab AND c.type = 'clear' AND (c.ts, c.event_id) > (t.ts, t.event_id))
  GROUP BY tab, element HAVING count(*) % 2 = 1),
selr AS (SELECT tab, element, toggles, row_number() OVER (PARTITION BY tab ORDER BY last) AS sel_order FROM sel),
stg AS (SELECT tab, key, arg_max(value, (ts, event_id)) AS value FROM lg WHERE type = 'set' GROUP BY tab, key),
opt AS (
  SELECT t.tab, {opt('format', L.DEFAULTS['format'])} AS o_format, TRY_CAST(nullif({opt('depth', 'Infinity')}, 'Infinity') AS INTEGER) AS o_depth, {flags},
    CAST({opt('truncationThreshold', str(L.DEFAULTS['truncationThreshold']))} AS INTEGER) AS o_trunc
  FROM (SELECT DISTINCT tab FROM lg) t LEFT JOIN stg s ON s.tab = t.tab GROUP BY t.tab)"""


DECLARATION_RX = r"""(?:[^;"'()]+|"[^"]*"|'[^']*'|\((?:[^()"']+|"[^"]*"|'[^']*')*\)|["'()])+"""


def styles_cte() -> str:
    imp = "(?i)\\s*!\\s*important\\s*$"
    decls = (f"list_transform(list_filter(regexp_extract_all(a_style, {q(DECLARATION_RX)}), lambda d: strpos(d, ':') > 0), lambda d: "
             "{'prop': lower(trim(split_part(d, ':', 1), ' ')), "
             f"'important': regexp_matches(d, {q(imp)}), "
             f"'value': trim(regexp_replace(substr(d, strpos(d, ':') + 1), {q(imp)}, ''), ' ')}})")
    ranked = "list_concat(list_filter(d0, lambda x: NOT x.important), list_filter(d0, lambda x: x.important))"
    items = []
    for p in L.STYLE_PROPERTIES:
        v = f"list_filter(decls, lambda x: x.prop = {q(p)})[-1].value"
        items.append(f"CASE WHEN coalesce({v}, '') <> '' AND trim({v}, ' ') NOT IN {qlist(L.EMPTY_STYLE_VALUES)} "
                     f"THEN {q(p + ': ')} || {v} || ';' END")
    lst = ",\n      ".join(items)
    return f""",
stl0 AS (SELECT page_id, pos, {ranked} AS decls FROM (SELECT page_id, pos, {decls} AS d0 FROM elp WHERE a_style IS NOT NULL)),
stl AS (SELECT page_id, pos, list_filter([
      {lst}], lambda x: x IS NOT NULL) AS lines FROM stl0)"""
