"""Locators: ranked selectors, fingerprint locators and their verification.

No selector engine: every generated locator has one of a dozen shapes, so
"how many elements of the page match it" is a grouped count over the page's
elements keyed by ``(page_id, shape key)`` and an equi-join from the
candidates to those counts. Match-side keys are generated separately from
candidate keys where they differ (every qualifier the parent satisfies). Pairs
of classes meet the elements on the rarer of the two classes, and the
``contains(normalize-space(text()), s)`` form meets the texts on the rarest of its
pieces that a text of any alignment must hold; both are verified. Only elements
of the document itself match, none inside a shadow root.
All joins are keyed by ``page_id`` first, so they stay within the page
partitioning of the element table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import lists as L
from weblens.functions.text import css_escape, js_trim, xpath_literal
from weblens.operators.elements import in_document

A = lambda n: F.col("attr")[n]
KEYT = "array<string>"
#: What locators know of an element: all that a table of ``text_source`` rows need keep.
SOURCE = ["page_id", "pos", "tag", "slevel", "in_svg", "id", "classes", "attrs", "attr", "parent_pos", "parent_tag", "parent_id", "parent_classes",
          "css_path", "xpath_absolute", "xt_source", "nt"]


def truthy(c):
    return F.coalesce(c, F.lit("")) != ""


def xpath_ws(c):
    """XPath normalize-space: strip and collapse space/tab/CR/LF."""
    return F.trim(F.regexp_replace(c, "[ \t\r\n]+", " "))


def _cand(ordinal, key, value, cond=None):
    s = F.struct(F.lit(ordinal).alias("ordinal"), key.cast(KEYT).alias("key"), value.alias("value"))
    return s if cond is None else F.when(cond, s)


def _arr(*xs):
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])


def _joined(*arrays):
    """The arrays as one: ``concat`` of arrays is slow where it is not compiled."""
    return F.flatten(F.array(*arrays))


def _parent_qual():
    """(qualifier key, qualifier selector text) of the parent, as used by
    the child-combinator candidates."""
    pid, pcls, ptag = F.col("parent_id"), F.col("parent_classes"), F.col("parent_tag")
    key = (F.when(truthy(pid), _arr("pid", pid))
           .when(F.size(pcls) > 0, _arr("pcls", ptag, F.try_element_at(pcls, F.lit(1))))
           .otherwise(_arr("ptag", ptag)))
    txt = (F.when(truthy(pid), F.concat(F.lit("#"), css_escape(pid)))
           .when(F.size(pcls) > 0, F.concat(ptag, F.lit("."), css_escape(F.try_element_at(pcls, F.lit(1)))))
           .otherwise(ptag))
    return key, txt


def _class_pairs():
    """``(ordinal, key, class, class, condition)`` of the pairs of an element's first classes."""
    tag, cls = F.col("tag"), F.col("classes")
    first3 = F.slice(cls, 1, 3)
    for i in range(3):
        for j in range(i + 1, 3):
            ci, cj = F.try_element_at(first3, F.lit(i + 1)), F.try_element_at(first3, F.lit(j + 1))
            yield 300 + 3 * i + j, _arr("tcc", tag, F.least(ci, cj), F.greatest(ci, cj)), ci, cj, (F.size(cls) >= 2) & (F.size(first3) > j)


def css_candidates(els: DataFrame) -> DataFrame:
    """Shortest-unique candidates ``(page_id, pos, ordinal, key, value)`` in
    the tool's try order."""
    tag, cls = F.col("tag"), F.col("classes")
    parts = [F.array(_cand(1, _arr("id", F.col("id")), F.concat(F.lit("#"), css_escape("id")), truthy(F.col("id"))))]
    parts.append(F.transform(cls, lambda c, i: _cand(0, _arr("tc", tag, c), F.concat(tag, F.lit("."), css_escape(c)))
                             .withField("ordinal", 100 + i)))
    parts.append(F.array(*[
        _cand(200 + j, _arr("ta", tag, a, A(a)), F.concat(tag, F.lit(f'[{a}="'), css_escape(A(a)), F.lit('"]')),
              truthy(A(a)))
        for j, a in enumerate(L.SHORTEST_ATTRS)]))
    parts.append(F.array(*[
        _cand(o, key, F.concat(tag, F.lit("."), css_escape(ci), F.lit("."), css_escape(cj)), cond) for o, key, ci, cj, cond in _class_pairs()]))
    qkey, qtxt = _parent_qual()
    has_parent = F.col("parent_pos").isNotNull()
    parts.append(F.array(_cand(400, _joined(_arr("child"), qkey, F.array(tag)),
                               F.concat(qtxt, F.lit(" > "), tag), has_parent)))
    parts.append(F.when(has_parent, F.transform(cls, lambda c, i: _cand(
        0, _joined(_arr("ccls"), qkey, F.array(tag, c)), F.concat(qtxt, F.lit(" > "), tag, F.lit("."), css_escape(c)))
        .withField("ordinal", 500 + i))).otherwise(F.array()))
    allc = F.array_compact(F.flatten(F.array(*[F.coalesce(p, F.array().cast(
        "array<struct<ordinal:int,key:array<string>,value:string>>")) for p in parts])))
    return els.select("page_id", "pos", F.inline(allc))


def css_match_keys(els: DataFrame) -> DataFrame:
    """Every CSS shape key each element satisfies: ``(page_id, key)``."""
    tag, cls = F.col("tag"), F.col("classes")
    quals = _joined(
        F.when(truthy(F.col("parent_id")), F.array(_arr("pid", F.col("parent_id")))).otherwise(F.array().cast("array<array<string>>")),
        F.transform(F.coalesce(F.col("parent_classes"), F.array().cast(KEYT)),
                    lambda c: _arr("pcls", F.col("parent_tag"), c)),
        F.array(_arr("ptag", F.col("parent_tag"))),
    )
    quals = F.when(F.col("parent_pos").isNotNull(), quals).otherwise(F.array().cast("array<array<string>>"))
    keys = _joined(
        F.when(truthy(F.col("id")), F.array(_arr("id", F.col("id")))).otherwise(F.array().cast("array<array<string>>")),
        F.transform(cls, lambda c: _arr("tc", tag, c)),
        F.transform(F.filter("attrs", lambda a: a["name"].isin(L.SHORTEST_ATTRS)),
                    lambda a: _arr("ta", tag, a["name"], a["value"])),
        F.transform(quals, lambda q: _joined(_arr("child"), q, F.array(tag))),
        F.flatten(F.transform(quals, lambda q: F.transform(cls, lambda c: _joined(_arr("ccls"), q, F.array(tag, c))))),
    )
    return els.select("page_id", F.explode(F.array_distinct(keys)).alias("key"))


def pair_match_keys(els: DataFrame, askers: DataFrame) -> DataFrame:
    """The two-class keys that elements satisfy, out of those that ``askers`` (elements
    with candidates) of the same page and tag ask for: each asked pair reads the elements
    of its rarer class only."""
    key = F.col("key")
    pairs = F.array_compact(F.array(*[F.when(cond, k) for _, k, _, _, cond in _class_pairs()]))
    asked = askers.filter(F.size("classes") >= 2).select("page_id", F.explode(pairs).alias("key")).distinct().select(
        "page_id", "key", key[1].alias("tag"), F.explode(F.array(F.struct(key[2].alias("cls"), key[3].alias("other")), F.struct(key[3].alias("cls"), key[2].alias("other")))).alias("p"))
    asked = asked.select("page_id", "key", "tag", "p.cls", "p.other")
    posts = els.filter(F.size("classes") > 0).select("page_id", "tag", "classes", F.explode("classes").alias("cls"))
    freq = posts.groupBy("page_id", "tag", "cls").agg(F.count("*").alias("n"))
    rare = asked.join(freq, ["page_id", "tag", "cls"]).groupBy("page_id", "key", "tag").agg(F.min(F.struct("n", "cls", "other")).alias("r"))
    rare = rare.select("page_id", "key", "tag", "r.cls", "r.other")
    hits = posts.filter(F.size("classes") > 1).join(rare, ["page_id", "tag", "cls"])
    return hits.filter(F.array_contains("classes", F.col("other"))).select("page_id", "key")


def _counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("page_id", "key").agg(F.count("*").alias("matches"))


def _of(els: DataFrame, targets: DataFrame | None) -> DataFrame:
    """The elements that locators are made for; all of them match."""
    return els if targets is None else els.join(targets.select("page_id", "pos"), ["page_id", "pos"], "left_semi")


def shortest_unique(els: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Shortest candidate selector matching exactly this element:
    ``(page_id, pos, shortest_unique)``; ties go to the earlier candidate."""
    els = in_document(els)
    mine = _of(els, targets)
    c = css_candidates(mine)
    keys = css_match_keys(els).unionByName(pair_match_keys(els, mine))
    j = c.join(_counts(keys), ["page_id", "key"], "left").filter(F.col("matches") == 1)
    return j.groupBy("page_id", "pos").agg(
        F.min_by("value", F.struct(F.length("value"), F.col("ordinal"))).alias("shortest_unique"))


# FIXED VALUES: attributes of the relative XPath and their try order.
XPATH_ATTRS = [("data-testid", 1), ("aria-label", 2), ("id", 3), ("name", 4), ("placeholder", 6)]


def xpath_candidates(els: DataFrame) -> DataFrame:
    tag = F.col("tag")
    cands = [
        _cand(o, _arr("xa", tag, a, A(a)), F.concat(F.lit("//"), tag, F.lit(f'[@{a}="'), A(a), F.lit('"]')),
              truthy(A(a)))
        for a, o in XPATH_ATTRS
    ]
    cands.append(_cand(5, _arr("xra", tag, A("role"), A("aria-label")),
                       F.concat(F.lit("//"), tag, F.lit('[@role="'), A("role"), F.lit('" and @aria-label="'),
                                A("aria-label"), F.lit('"]')),
                       truthy(A("role")) & truthy(A("aria-label"))))
    c = els.select("page_id", "pos", F.inline(F.array_compact(F.array(*cands))))
    bad = F.when(F.col("key")[0] == "xa", F.instr(F.col("key")[3], '"') > 0) \
        .otherwise((F.instr(F.col("key")[2], '"') > 0) | (F.instr(F.col("key")[3], '"') > 0))
    return c.withColumn("invalid", bad)


def xpath_match_keys(els: DataFrame) -> DataFrame:
    tag = F.col("tag")
    keys = _joined(
        F.transform(F.filter("attrs", lambda a: a["name"].isin([a for a, _ in XPATH_ATTRS])),
                    lambda a: _arr("xa", tag, a["name"], a["value"])),
        F.when(A("role").isNotNull() & A("aria-label").isNotNull(),
               F.array(_arr("xra", tag, A("role"), A("aria-label")))).otherwise(F.array().cast("array<array<string>>")),
    )
    # an unprefixed XPath name matches no SVG element in an HTML document
    return in_document(els).filter(~F.col("in_svg")).select("page_id", F.explode(keys).alias("key"))


def xpath_relative(els: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """First candidate with exactly one match, else the first candidate:
    ``(page_id, pos, xpath_relative, matches)``."""
    c = xpath_candidates(_of(els, targets)).join(_counts(xpath_match_keys(els)), ["page_id", "key"], "left")
    m = F.when(F.col("invalid"), F.lit(-1)).otherwise(F.coalesce(F.col("matches"), F.lit(0)))
    c = c.withColumn("m", m.cast("long"))
    return c.groupBy("page_id", "pos").agg(
        F.min_by(F.struct("value", "m"), F.struct(F.col("m") != 1, F.col("ordinal"))).alias("b")
    ).select("page_id", "pos", F.col("b.value").alias("xpath_relative"), F.col("b.m").alias("matches"))


def text_source(els_text: DataFrame, direct: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Adds ``xt_source`` (own text, else the trimmed textContent) and, when
    ``first`` is given, ``nt`` (normalized first text node)."""
    j = els_text.join(direct, ["page_id", "pos"], "left")
    src = F.when(F.coalesce(F.col("direct_text"), F.lit("")) != "", F.col("direct_text")).otherwise(js_trim("text"))
    j = j.withColumn("xt_source", src)
    if first is not None:
        j = j.join(first, ["page_id", "pos"], "left").withColumn(
            "nt", xpath_ws(F.coalesce(F.col("first_text"), F.lit("")))).drop("first_text")
    return j


PIECE = 8


def containing(texts: DataFrame, needles: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """How many texts of a (page, tag) hold each needle of ``TEXT_XPATH_EXACT``
    characters: ``(page_id, tag, needle, n_in)`` from texts ``(page_id, tag, nt, n)``.

    Texts are indexed by their pieces of ``PIECE`` characters, cut end to end. A
    needle that stands in a text covers, for its alignment, a run of whole pieces:
    of each of the ``PIECE`` possible runs the rarest piece is looked up, unless some
    piece of the run is nowhere, and what is found is verified. A text has as many
    pieces as an eighth of its characters, so a piece names its text by a digest and
    the text itself is met once for each needle; two texts of one digest cost a
    comparison more and never change a count. ``hold`` may keep the pieces to look up,
    so that no task holds the sorts of both halves."""
    t = texts.filter(F.length("nt") >= L.TEXT_XPATH_EXACT).withColumn("digest", F.xxhash64("nt"))
    # only texts of a tag that some needle of the page asks for
    t = t.join(needles.select("page_id", "tag").distinct(), ["page_id", "tag"], "left_semi")
    pieces = t.select("page_id", "tag", "digest", F.explode(F.array_distinct(F.regexp_extract_all("nt", F.lit("(?s).{%d}" % PIECE), 0))).alias("piece"))
    freq = pieces.groupBy("page_id", "tag", "piece").agg(F.count("*").alias("f"))
    starts = range(L.TEXT_XPATH_EXACT - PIECE + 1)
    runs = needles.select("page_id", "tag", "needle", F.inline(F.array(*[
        F.struct(F.lit(i % PIECE).alias("run"), F.substring("needle", i + 1, PIECE).alias("piece")) for i in starts])))
    runs = runs.join(freq, ["page_id", "tag", "piece"], "left").groupBy("page_id", "tag", "needle", "run").agg(
        F.min(F.struct("f", "piece")).alias("best"), F.bool_or(F.col("f").isNull()).alias("absent"))
    tries = hold(runs.filter("NOT absent").select("page_id", "tag", "needle", F.col("best.piece").alias("piece")).distinct())
    found = pieces.join(tries, ["page_id", "tag", "piece"]).select("page_id", "tag", "digest", "needle").distinct()
    hits = found.join(t, ["page_id", "tag", "digest"]).filter(F.instr("nt", F.col("needle")) > 0)
    return hits.groupBy("page_id", "tag", "needle").agg(F.sum("n").alias("n_in"))


def xpath_text(els_src: DataFrame, first: DataFrame | None = None, targets: DataFrame | None = None,
               hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Text XPath and its match count: ``(page_id, pos, text_selector, matches)``.
    Exact form compares the normalized *first* text node; the contains form
    looks for the first 40 characters inside it."""
    s = F.col("xt_source")
    tag = F.col("tag")
    c = _of(els_src, targets).filter((s != "") & (F.length(s) <= L.TEXT_XPATH_MAX)).select(
        "page_id", "pos", "tag", s.alias("src"))
    exact = F.length("src") <= L.TEXT_XPATH_EXACT
    snippet = F.substring("src", 1, L.TEXT_XPATH_EXACT)
    c = c.select(
        "page_id", "pos", "tag", exact.alias("exact"), snippet.alias("snip"),
        F.when(exact, F.concat(F.lit("//"), tag, F.lit("[normalize-space(text())="), xpath_literal("src"), F.lit("]")))
        .otherwise(F.concat(F.lit("//"), tag, F.lit("[contains(normalize-space(text()),"), xpath_literal(snippet),
                            F.lit(")]"))).alias("text_selector"),
        F.when(exact, F.col("src")).otherwise(snippet).alias("needle"),
    )
    # match side: normalized first text node of every element an XPath name can match
    seen = in_document(els_src).filter(~F.col("in_svg"))
    if "nt" in els_src.columns:
        ft = seen.select("page_id", "pos", "tag", "nt")
    else:
        ft = seen.select("page_id", "pos", "tag").join(first, ["page_id", "pos"], "left").select(
            "page_id", "pos", "tag", xpath_ws(F.coalesce(F.col("first_text"), F.lit(""))).alias("nt"))
    eq = ft.groupBy("page_id", "tag", "nt").agg(F.count("*").alias("n_eq"))
    ce = c.filter("exact").join(eq, (c.page_id == eq.page_id) & (c.tag == eq.tag) & (c.needle == eq.nt), "left") \
        .select(c.page_id, c.pos, c.text_selector, F.coalesce(eq.n_eq, F.lit(0)).alias("matches"))
    cc = c.filter(~F.col("exact")).select("page_id", "pos", "tag", "text_selector", "needle")
    hits = containing(ft.groupBy("page_id", "tag", "nt").agg(F.count("*").alias("n")), cc.select("page_id", "tag", "needle").distinct(), hold)
    cc = cc.join(hits, ["page_id", "tag", "needle"], "left").select(
        "page_id", "pos", "text_selector", F.coalesce("n_in", F.lit(0)).alias("matches"))
    return ce.unionByName(cc)


def ranked_selectors(els_text: DataFrame) -> DataFrame:
    """Scored selector candidates, best first: ``(page_id, pos, rank, type, value, score)``."""
    tag = F.col("tag")

    def c(typ, value, cond):
        return F.when(cond, F.struct(F.lit(typ).alias("type"), value.alias("value"),
                                     F.lit(L.SCORES[typ]).alias("score")))

    al = A("aria-label")
    cands = F.array_compact(F.array(
        c("testid", F.concat(F.lit('[data-testid="'), A("data-testid"), F.lit('"]')), truthy(A("data-testid"))),
        c("data-cy", F.concat(F.lit('[data-cy="'), A("data-cy"), F.lit('"]')), truthy(A("data-cy"))),
        c("data-test", F.concat(F.lit('[data-test="'), A("data-test"), F.lit('"]')), truthy(A("data-test"))),
        c("data-qa", F.concat(F.lit('[data-qa="'), A("data-qa"), F.lit('"]')), truthy(A("data-qa"))),
        c("id", F.concat(F.lit("#"), css_escape(A("id"))), truthy(A("id"))),
        c("name", F.concat(tag, F.lit('[name="'), A("name"), F.lit('"]')), truthy(A("name"))),
        c("aria-label", F.concat(tag, F.lit('[aria-label="'), al, F.lit('"]')), truthy(al)),
        c("role+aria-label", F.concat(tag, F.lit('[role="'), A("role"), F.lit('"][aria-label="'), al, F.lit('"]')),
          truthy(A("role")) & truthy(al)),
        c("role+text", F.concat(tag, F.lit('[role="'), A("role"), F.lit('"]')),
          truthy(A("role")) & ~truthy(al) & (F.col("preview") != "")),
        c("href", F.concat(tag, F.lit('[href="'), A("href"), F.lit('"]')), truthy(A("href"))),
        c("class-chain", F.col("selector"), F.size("classes") > 0),
    ))
    r = els_text.select("page_id", "pos", F.posexplode(cands).alias("i", "c"))
    w = Window.partitionBy("page_id", "pos").orderBy(F.desc("c.score"), "i")
    return r.select("page_id", "pos", F.row_number().over(w).cast("long").alias("rank"),
                    "c.type", "c.value", F.col("c.score").cast("long").alias("score"))


def best_selector(els_text: DataFrame) -> DataFrame:
    """``(page_id, pos, best, css, fallback)``: top ranked value (else the
    class-chain selector) and the rest joined by newlines."""
    r = ranked_selectors(els_text).groupBy("page_id", "pos").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("rs"))
    j = els_text.select("page_id", "pos", "selector").join(r, ["page_id", "pos"], "left")
    rs = F.coalesce(F.col("rs"), F.array().cast("array<struct<rank:bigint,value:string>>"))
    return j.select(
        "page_id", "pos",
        F.coalesce(F.try_element_at(rs, F.lit(1))["value"], F.col("selector")).alias("best"),
        F.col("selector").alias("css"),
        F.array_join(F.transform(F.slice(rs, 2, F.greatest(F.size(rs) - 1, F.lit(0))), lambda x: x["value"]), "\n")
        .alias("fallback"),
    )


def path_matches(els: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Match counts of the css path and absolute XPath (grouped counts)."""
    doc = in_document(els)
    cp = doc.groupBy("page_id", "css_path").agg(F.count("*").alias("css_matches"))
    xp = doc.groupBy("page_id", "xpath_absolute").agg(F.count("*").alias("xpath_matches"))
    xm = F.when(F.col("in_svg"), F.lit(0)).otherwise(F.coalesce("xpath_matches", F.lit(0))).cast("long")  # no SVG names in XPath
    return _of(els, targets).select("page_id", "pos", "css_path", "xpath_absolute", "in_svg") \
        .join(cp, ["page_id", "css_path"], "left").join(xp, ["page_id", "xpath_absolute"], "left") \
        .withColumn("xpath_matches", xm).withColumn("css_matches", F.coalesce("css_matches", F.lit(0)).cast("long")).drop("in_svg")


def locator_matches(els_src: DataFrame, first: DataFrame | None = None, targets: DataFrame | None = None,
                    hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The five fingerprint locators (of ``targets`` only, if given) with match counts and tier:
    ``(page_id, pos, strategy, value, tier, matches, unique)``."""
    su = shortest_unique(els_src, targets).select("page_id", "pos", F.lit("shortest-unique").alias("strategy"),
                                         F.col("shortest_unique").alias("value"), F.lit("stable").alias("tier"),
                                         F.lit(1).cast("long").alias("matches"), F.lit(0).alias("o"))
    xr = xpath_relative(els_src, targets).select("page_id", "pos", F.lit("xpath-relative").alias("strategy"),
                                        F.col("xpath_relative").alias("value"), F.lit("stable").alias("tier"),
                                        "matches", F.lit(1).alias("o"))
    xt = xpath_text(els_src, first, targets, hold).select("page_id", "pos", F.lit("xpath-text").alias("strategy"),
                                           F.col("text_selector").alias("value"), F.lit("stable").alias("tier"),
                                           "matches", F.lit(2).alias("o"))
    pm = path_matches(els_src, targets)
    cp = pm.select("page_id", "pos", F.lit("css-path").alias("strategy"), F.col("css_path").alias("value"),
                   F.lit("positional").alias("tier"), F.col("css_matches").alias("matches"), F.lit(3).alias("o"))
    xa = pm.select("page_id", "pos", F.lit("xpath-absolute").alias("strategy"), F.col("xpath_absolute").alias("value"),
                   F.lit("fragile").alias("tier"), F.col("xpath_matches").alias("matches"), F.lit(4).alias("o"))
    u = su.unionByName(xr).unionByName(xt).unionByName(cp).unionByName(xa)
    return u.withColumn("unique", F.col("matches") == 1)


def locator_tiers(loc: DataFrame) -> DataFrame:
    """Verified-unique locators grouped by tier in strategy order."""
    g = loc.filter("unique").groupBy("page_id", "pos").agg(
        F.array_sort(F.collect_list(F.struct("o", "value", "tier"))).alias("ls"))

    def tier(t):
        return F.array_join(F.transform(F.filter("ls", lambda x: x["tier"] == t), lambda x: x["value"]), "\n")

    return g.select("page_id", "pos", tier("stable").alias("stable"), tier("positional").alias("positional"),
                    tier("fragile").alias("fragile"))


def fingerprint(loc: DataFrame) -> DataFrame:
    """Nested fingerprint per element (css path, XPaths, shortest unique,
    text selector, tiers, verification map keyed by locator value)."""
    g = loc.groupBy("page_id", "pos").agg(
        F.array_sort(F.collect_list(F.struct("o", "strategy", "value", "tier", "matches", "unique"))).alias("ls"))

    def pick(strategy):
        return F.try_element_at(F.filter("ls", lambda x: x["strategy"] == strategy), F.lit(1))["value"]

    def tier(t):
        return F.transform(F.filter("ls", lambda x: (x["tier"] == t) & x["unique"]), lambda x: x["value"])

    ver = F.map_from_entries(F.transform(
        F.filter("ls", lambda x, i: ~F.exists(F.slice("ls", 1, i), lambda y: y["value"] == x["value"])),
        lambda x: F.struct(x["value"], F.struct(x["unique"].alias("unique"), x["matches"].alias("matches")))))
    return g.select("page_id", "pos", F.struct(
        pick("css-path").alias("cssPath"), pick("xpath-absolute").alias("xpathAbsolute"),
        pick("xpath-relative").alias("xpathRelative"), pick("shortest-unique").alias("shortestUnique"),
        pick("xpath-text").alias("textSelector"),
        F.struct(tier("stable").alias("stable"), tier("positional").alias("positional"),
                 tier("fragile").alias("fragile")).alias("stability"),
        ver.alias("verification")).alias("fingerprint"))
