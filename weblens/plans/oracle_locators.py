"""DuckDB oracle SQL for the locator queries: candidates are rows, match
counts are correlated ``count(*)`` subqueries over the page's elements."""

from __future__ import annotations

from weblens.functions import lists as L
from weblens.plans import oracle as O

esc = O.css_escape_sql
SCOPE = f"tag NOT IN {O.qlist(L.UNSELECTABLE_TAGS)}"


def ctes() -> str:
    """Extra CTEs: ft (first text node), dt (direct text), nft (normalized
    first text), par (parent info), src (text XPath source)."""
    return f""",
ft AS (SELECT page_id, parent_pos AS pos, arg_min(text, pos) AS first_text FROM txt
       WHERE parent_pos IS NOT NULL AND NOT via_shadow GROUP BY page_id, parent_pos),
dt AS (SELECT page_id, parent_pos AS pos, string_agg(t, ' ' ORDER BY pos) AS direct_text FROM (
         SELECT page_id, parent_pos, pos, {O.js_trim_sql('text')} AS t FROM txt WHERE NOT via_shadow)
       WHERE t <> '' AND parent_pos IS NOT NULL GROUP BY page_id, parent_pos),
nft AS (SELECT e.page_id, e.pos, e.tag,
          trim(regexp_replace(coalesce(ft.first_text, ''), '[ \t\r\n]+', ' ', 'g'), ' ') AS nt
        FROM el e LEFT JOIN ft USING (page_id, pos) WHERE NOT e.in_svg AND e.slevel = 0),
par AS (SELECT c.page_id, c.pos, p.id AS pid, p.classes AS pcls, p.tag AS ptag
        FROM elx c JOIN elx p ON p.page_id = c.page_id AND p.pos = c.parent_pos),
src AS (SELECT e.*, CASE WHEN coalesce(dt.direct_text, '') <> '' THEN dt.direct_text
                         ELSE {O.js_trim_sql('e.text')} END AS xt_source
        FROM elp e LEFT JOIN dt USING (page_id, pos))
"""


def _count_attr(name: str, value: str, xpath: bool = False) -> str:
    return (f"(SELECT count(*) FROM elx o JOIN atr x ON x.page_id = o.page_id AND x.pos = o.pos "
            f"WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.tag = e.tag AND x.name = {O.q(name)} AND x.value = {value}" + (" AND NOT o.in_svg)" if xpath else ")"))


def _qual_match(p: str) -> str:
    """Condition that parent ``p`` of a matching element satisfies e's parent qualifier."""
    return (f"CASE WHEN coalesce(q.pid, '') <> '' THEN {p}.id = q.pid "
            f"WHEN len(q.pcls) > 0 THEN {p}.tag = q.ptag AND list_contains({p}.classes, q.pcls[1]) "
            f"ELSE {p}.tag = q.ptag END")


def _qual_text() -> str:
    return (f"CASE WHEN coalesce(q.pid, '') <> '' THEN '#' || {esc('q.pid')} "
            f"WHEN len(q.pcls) > 0 THEN q.ptag || '.' || {esc('q.pcls[1]')} ELSE q.ptag END")


def css_candidates_sql() -> str:
    parts = [
        f"SELECT e.page_id, e.pos, 1 AS ordinal, '#' || {esc('e.id')} AS value, "
        f"(SELECT count(*) FROM elx o WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.id = e.id) AS matches "
        f"FROM elx e WHERE e.id <> ''",
        f"SELECT page_id, pos, 99 + i AS ordinal, tag || '.' || {esc('c')} AS value, "
        f"(SELECT count(*) FROM elx o WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.tag = e.tag AND list_contains(o.classes, c)) "
        f"FROM (SELECT *, unnest(classes) AS c, generate_subscripts(classes, 1) AS i FROM elx) e",
    ]
    for j, a in enumerate(L.SHORTEST_ATTRS):
        col = "e." + O.acol(a)
        parts.append(
            f"SELECT e.page_id, e.pos, {200 + j}, e.tag || '[{a}=\"' || {esc(col)} || '\"]', "
            f"{_count_attr(a, col)} FROM elx e WHERE coalesce({col}, '') <> ''")
    for i in range(3):
        for j in range(i + 1, 3):
            ci, cj = f"e.classes[{i + 1}]", f"e.classes[{j + 1}]"
            parts.append(
                f"SELECT e.page_id, e.pos, {300 + 3 * i + j}, e.tag || '.' || {esc(ci)} || '.' || {esc(cj)}, "
                f"(SELECT count(*) FROM elx o WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.tag = e.tag "
                f"AND list_contains(o.classes, {ci}) AND list_contains(o.classes, {cj})) "
                f"FROM elx e WHERE len(e.classes) >= 2 AND len(e.classes[1:3]) > {j}")
    parts.append(
        f"SELECT e.page_id, e.pos, 400, {_qual_text()} || ' > ' || e.tag, "
        f"(SELECT count(*) FROM elx o JOIN elx p ON p.page_id = o.page_id AND p.pos = o.parent_pos "
        f"WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.tag = e.tag AND {_qual_match('p')}) "
        f"FROM elx e JOIN par q USING (page_id, pos)")
    parts.append(
        f"SELECT e.page_id, e.pos, 499 + e.i, {_qual_text()} || ' > ' || e.tag || '.' || {esc('e.c')}, "
        f"(SELECT count(*) FROM elx o JOIN elx p ON p.page_id = o.page_id AND p.pos = o.parent_pos "
        f"WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.tag = e.tag AND list_contains(o.classes, e.c) AND {_qual_match('p')}) "
        f"FROM (SELECT *, unnest(classes) AS c, generate_subscripts(classes, 1) AS i FROM elx) e "
        f"JOIN par q USING (page_id, pos)")
    return "\nUNION ALL\n".join(parts)


def shortest_unique_sql() -> str:
    return f"""
SELECT c.page_id, c.pos, arg_min(c.value, (length(c.value), c.ordinal)) AS shortest_unique
FROM ({css_candidates_sql()}) c JOIN elx s ON s.page_id = c.page_id AND s.pos = c.pos AND s.{SCOPE}
WHERE c.matches = 1 AND s.slevel = 0 GROUP BY c.page_id, c.pos"""


XATTRS = [("data-testid", 1), ("aria-label", 2), ("id", 3), ("name", 4), ("placeholder", 6)]


def xpath_relative_sql() -> str:
    parts = []
    for a, o in XATTRS:
        col = "e." + O.acol(a)
        parts.append(
            f"SELECT e.page_id, e.pos, {o} AS ordinal, '//' || e.tag || '[@{a}=\"' || {col} || '\"]' AS value, "
            f"CASE WHEN strpos({col}, '\"') > 0 THEN -1 ELSE {_count_attr(a, col, True)} END AS m "
            f"FROM elx e WHERE coalesce({col}, '') <> '' AND e.{SCOPE}")
    parts.append(
        "SELECT e.page_id, e.pos, 5, '//' || e.tag || '[@role=\"' || e.a_role || '\" and @aria-label=\"' "
        "|| e.a_aria_label || '\"]', CASE WHEN strpos(e.a_role, '\"') > 0 OR strpos(e.a_aria_label, '\"') > 0 "
        "THEN -1 ELSE (SELECT count(*) FROM elx o WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.tag = e.tag "
        "AND o.a_role = e.a_role AND o.a_aria_label = e.a_aria_label AND NOT o.in_svg) END "
        f"FROM elx e WHERE coalesce(e.a_role, '') <> '' AND coalesce(e.a_aria_label, '') <> '' AND e.{SCOPE}")
    u = "\nUNION ALL\n".join(parts)
    return f"""
SELECT page_id, pos, arg_min(value, (m <> 1, ordinal)) AS xpath_relative, arg_min(m, (m <> 1, ordinal)) AS matches
FROM ({u}) GROUP BY page_id, pos"""


def xpath_text_sql() -> str:
    s = "xt_source"
    exact = (f"'//' || tag || '[normalize-space(text())=' || {O.xpath_literal_sql(s)} || ']'")
    snip = f"substr({s}, 1, {L.TEXT_XPATH_EXACT})"
    cont = f"'//' || tag || '[contains(normalize-space(text()),' || {O.xpath_literal_sql(snip)} || ')]'"
    return f"""
SELECT e.page_id, e.pos,
  CASE WHEN length({s}) <= {L.TEXT_XPATH_EXACT} THEN {exact} ELSE {cont} END AS text_selector,
  CASE WHEN length({s}) <= {L.TEXT_XPATH_EXACT}
       THEN (SELECT count(*) FROM nft o WHERE o.page_id = e.page_id AND o.tag = e.tag AND o.nt = e.{s})
       ELSE (SELECT count(*) FROM nft o WHERE o.page_id = e.page_id AND o.tag = e.tag AND contains(o.nt, {snip}))
  END AS matches
FROM src e WHERE {s} <> '' AND length({s}) <= {L.TEXT_XPATH_MAX} AND e.{SCOPE}"""


def ranked_sql() -> str:
    def c(typ, value, cond):
        return f"CASE WHEN {cond} THEN {{'type': '{typ}', 'value': {value}, 'score': {L.SCORES[typ]}}} END"

    def t(col):
        return f"coalesce({col}, '') <> ''"

    lst = ", ".join([
        c("testid", "'[data-testid=\"' || a_data_testid || '\"]'", t("a_data_testid")),
        c("data-cy", "'[data-cy=\"' || a_data_cy || '\"]'", t("a_data_cy")),
        c("data-test", "'[data-test=\"' || a_data_test || '\"]'", t("a_data_test")),
        c("data-qa", "'[data-qa=\"' || a_data_qa || '\"]'", t("a_data_qa")),
        c("id", "'#' || " + esc("a_id"), t("a_id")),
        c("name", "tag || '[name=\"' || a_name || '\"]'", t("a_name")),
        c("aria-label", "tag || '[aria-label=\"' || a_aria_label || '\"]'", t("a_aria_label")),
        c("role+aria-label", "tag || '[role=\"' || a_role || '\"][aria-label=\"' || a_aria_label || '\"]'",
          t("a_role") + " AND " + t("a_aria_label")),
        c("role+text", "tag || '[role=\"' || a_role || '\"]'",
          t("a_role") + " AND NOT " + t("a_aria_label") + " AND preview <> ''"),
        c("href", "tag || '[href=\"' || a_href || '\"]'", t("a_href")),
        c("class-chain", "selector", "len(classes) > 0"),
    ])
    return f"""
SELECT page_id, pos, row_number() OVER (PARTITION BY page_id, pos ORDER BY x.score DESC, i) AS rank,
  x.type AS type, x.value AS value, CAST(x.score AS BIGINT) AS score
FROM (SELECT page_id, pos, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
  SELECT page_id, pos, list_filter([{lst}], lambda v: v IS NOT NULL) AS l FROM elp WHERE {SCOPE}))"""


def best_sql() -> str:
    return f"""
SELECT e.page_id, e.pos, coalesce(r.best, e.selector) AS best, e.selector AS css, coalesce(r.fallback, '') AS fallback
FROM elp e LEFT JOIN (
  SELECT page_id, pos, max(CASE WHEN rank = 1 THEN value END) AS best,
    coalesce(string_agg(CASE WHEN rank > 1 THEN value END, chr(10) ORDER BY rank), '') AS fallback
  FROM ({ranked_sql()}) GROUP BY page_id, pos) r USING (page_id, pos)
WHERE e.{SCOPE}"""


def locator_matches_sql() -> str:
    return f"""
SELECT page_id, pos, 'shortest-unique' AS strategy, shortest_unique AS value, 'stable' AS tier, 1 AS matches
FROM ({shortest_unique_sql()})
UNION ALL
SELECT page_id, pos, 'xpath-relative', xpath_relative, 'stable', matches FROM ({xpath_relative_sql()})
UNION ALL
SELECT page_id, pos, 'xpath-text', text_selector, 'stable', matches FROM ({xpath_text_sql()})
UNION ALL
SELECT e.page_id, e.pos, 'css-path', e.css_path, 'positional',
  (SELECT count(*) FROM elp o WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.css_path = e.css_path) FROM elp e WHERE e.{SCOPE}
UNION ALL
SELECT e.page_id, e.pos, 'xpath-absolute', e.xpath_absolute, 'fragile',
  CASE WHEN e.in_svg THEN 0 ELSE (SELECT count(*) FROM elp o WHERE o.page_id = e.page_id AND o.slevel = 0 AND o.xpath_absolute = e.xpath_absolute) END
FROM elp e WHERE e.{SCOPE}"""


def locator_tiers_sql() -> str:
    order = ("CASE strategy WHEN 'shortest-unique' THEN 0 WHEN 'xpath-relative' THEN 1 WHEN 'xpath-text' THEN 2 "
             "WHEN 'css-path' THEN 3 ELSE 4 END")
    return f"""
SELECT page_id, pos,
  coalesce(string_agg(CASE WHEN tier = 'stable' THEN value END, chr(10) ORDER BY {order}), '') AS stable,
  coalesce(string_agg(CASE WHEN tier = 'positional' THEN value END, chr(10) ORDER BY {order}), '') AS positional,
  coalesce(string_agg(CASE WHEN tier = 'fragile' THEN value END, chr(10) ORDER BY {order}), '') AS fragile
FROM ({locator_matches_sql()}) WHERE matches = 1 GROUP BY page_id, pos"""


def _js(e: str) -> str:
    return f"to_json({e})::VARCHAR"


def _fields(*pairs: tuple[str, str]) -> str:
    """JSON object text; a field whose text is null is left out."""
    parts = ", ".join(f"'\"{k}\":' || {v}" for k, v in pairs)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


ORDER = ("CASE strategy WHEN 'shortest-unique' THEN 0 WHEN 'xpath-relative' THEN 1 WHEN 'xpath-text' THEN 2 "
         "WHEN 'css-path' THEN 3 ELSE 4 END")


def fingerprint_sql() -> str:
    def pick(strategy):
        return f"max(CASE WHEN strategy = '{strategy}' THEN {_js('value')} END)"

    def tier(t):
        return f"'[' || coalesce(string_agg(CASE WHEN tier = '{t}' AND matches = 1 THEN {_js('value')} END, ',' ORDER BY o), '') || ']'"

    entry = f"""{_js('value')} || ':{{"unique":' || (matches = 1)::VARCHAR || ',"matches":' || matches || '}}'"""
    return f"""
SELECT page_id, pos, {_fields(('cssPath', pick('css-path')), ('xpathAbsolute', pick('xpath-absolute')),
                              ('xpathRelative', pick('xpath-relative')), ('shortestUnique', pick('shortest-unique')),
                              ('textSelector', pick('xpath-text')),
                              ('stability', _fields(*[(t, tier(t)) for t in ('stable', 'positional', 'fragile')])),
                              ('verification', f"'{{' || string_agg(CASE WHEN rn = 1 THEN {entry} END, ',' ORDER BY o) || '}}'"))} AS fingerprint
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, pos, value ORDER BY o) AS rn
      FROM (SELECT *, {ORDER} AS o FROM ({locator_matches_sql()}))) GROUP BY page_id, pos"""


def payload_sql() -> str:
    rank = _fields(("type", _js("type")), ("value", _js("value")), ("score", "score::VARCHAR"))
    selectors = _fields(("best", _js("coalesce(r.best, e.selector)")), ("css", _js("e.selector")),
                        ("fallback", "'[' || coalesce(r.fallback, '') || ']'"))
    return f"""
SELECT e.page_id, e.pos, {_fields(
        ('description', _js("CASE WHEN e.preview <> '' THEN e.preview ELSE e.summary END")), ('text', _js('e.preview')),
        ('selectors', selectors), ('rankedSelectors', "'[' || coalesce(r.ranked, '') || ']'"), ('tag', _js('e.tag')),
        ('attributes', "'{' || coalesce(a.attributes, '') || '}'"), ('fingerprint', 'f.fingerprint'))} AS payload
FROM elp e LEFT JOIN (
  SELECT page_id, pos, max(CASE WHEN rank = 1 THEN value END) AS best,
    string_agg(CASE WHEN rank > 1 THEN {_js('value')} END, ',' ORDER BY rank) AS fallback,
    string_agg({rank}, ',' ORDER BY rank) AS ranked
  FROM ({ranked_sql()}) GROUP BY page_id, pos) r USING (page_id, pos)
LEFT JOIN (SELECT page_id, pos, string_agg({_js('name')} || ':' || {_js('value')}, ',' ORDER BY i) AS attributes
           FROM atr GROUP BY page_id, pos) a USING (page_id, pos)
LEFT JOIN ({fingerprint_sql()}) f USING (page_id, pos)
WHERE e.{SCOPE}"""


def document_sql() -> str:
    """(page_id, pos, doc): the selector document of every element."""
    doc = _fields(("url", _js("t.url")), ("title", _js("t.title")), ("elements", "'[' || p.payload || ']'"))
    return f"SELECT p.page_id, p.pos, {doc} AS doc FROM ({payload_sql()}) p JOIN ttl t USING (page_id)"
