"""Golden micro-pages (FIXTURES.md §4): expected outputs derived by hand."""

from pyspark.sql import functions as F

from conftest import make_tables
from weblens.functions.text import truncate_lines
from weblens.operators import locators as LC
from weblens.operators import render as R
from weblens.operators import snapshot as S
from weblens.operators.text_ops import direct_text, first_text

FX1 = ('<!DOCTYPE html><html><head><title>Sign in</title><script>var t="</p>";</script></head><body>'
       '<header id="top" class="a b c d"><h1>Welcome <b>back</b></h1></header><main><form class="login card wide">'
       '<input name="user" placeholder="User"><button class="submit-btn" aria-label="Submit" data-gtm-id="7" '
       'data-testid="go" onclick="x()">Submit</button><button class="alt"></button></form><img src="a.png">'
       '<img src="b.png" alt="B &amp; C"><svg class="i"><path d="M0"/></svg><p hidden>secret</p></main></body></html>')
FX2 = ('<div data-gallery="1" data-author="a" data-cy="c" data-v-12="" _ngcontent-x="" jsname="q" '
       'style="color: red" data-testid="t" data-foo="k">x<br>y</div>')
FX6 = "<article><p><b>one<br><p>two</p></article><ul><li>a<li>b</ul>"
NOCTX = R.Options(include_context=False)

_T = {}


def tables(spark):
    if "t" not in _T:
        _T["t"] = make_tables(spark, [(1, "https://x.test/login", FX1), (2, "", FX2),
                                      (3, "", '<p>Say "hi"</p>'), (4, "", "<p>one<i>x</i>two</p>"), (6, "", FX6)])
    return _T["t"]


def out(df):
    return df.collect()[0]["output"]


def test_clean_html_main(spark):
    t = tables(spark)
    got = out(R.clean_html(t.nodes_text, t.roots(1, "main"), NOCTX))
    assert got == ('<main><form class="login card wide"><input name="user" placeholder="User"><button '
                   'class="submit-btn" aria-label="Submit" data-testid="go" onclick="x()">Submit</button><button '
                   'class="alt"></button></form><img src="a.png"><img src="b.png" alt="B &amp; C"><svg '
                   'aria-label="vector graphic"></svg></main>')


def test_clean_html_depth0_and_text_trim(spark):
    t = tables(spark)
    assert out(R.clean_html(t.nodes_text, t.roots(1, "form"), R.Options(depth=0, include_context=False))) == \
        '<form class="login card wide">Submit</form>'
    assert out(R.clean_html(t.nodes_text, t.roots(1, "h1"), NOCTX)) == "<h1>Welcome<b>back</b></h1>"


def test_context_header(spark):
    t = tables(spark)
    got = out(R.clean_html(t.nodes_text, t.roots(1, "form"), R.Options(depth=0)))
    assert got.startswith("CONTEXT: body > main\n\n<form")


def test_structure(spark):
    t = tables(spark)
    assert out(R.structure(t.elements_text, t.roots(1, "main"), NOCTX)).split("\n") == [
        'main "Submitsecret"', '  form.login.card.wide "Submit"', "    input", '    button.submit-btn "Submit"',
        "    button.alt", "  img", "  img", "  svg", "    path"]
    assert out(R.structure(t.elements_text, t.roots(1, "header"), NOCTX)).split("\n") == [
        'header#top.a.b.c "Welcome back"', '  h1 "Welcome back"', '    b "back"']


def test_accessibility(spark):
    t = tables(spark)
    assert out(R.a11y_outline(t.elements_text, t.roots(1, "main"), NOCTX)).split("\n") == [
        '[main] "Submitsecret"', '  [form] "Submit"', "    [input]", '    [button aria-label="Submit"] "Submit"',
        "    [button] WARNING(unnamed-button)", "  [img] WARNING(missing-alt)", '  [img alt="B & C"]', "  [svg]",
        "    [path]"]


def test_attribute_rules(spark):
    t = tables(spark)
    root = t.roots(2, "div")
    want = '<div data-cy="c" style="color: red" data-testid="t" data-foo="k">xy</div>'
    assert out(R.clean_html(t.nodes_text, root, NOCTX)) == want
    assert out(R.clean_html(t.nodes_text, root, R.Options(include_context=False, keep_test_ids=False))) == want
    loose = out(R.clean_html(t.nodes_text, root, R.Options(include_context=False, strip_noise=False)))
    assert loose.count('="') == 9


def test_selectors_first_button(spark):
    t = tables(spark)
    btn = t.element(1, "button")["pos"]
    e1 = t.elements_text.filter("page_id = 1")
    ranked = LC.ranked_selectors(e1).filter(F.col("pos") == btn).orderBy("rank").collect()
    assert [(r["score"], r["value"]) for r in ranked] == [
        (100, '[data-testid="go"]'), (80, 'button[aria-label="Submit"]'),
        (60, "html > body > main > form.login.card > button.submit-btn")]
    src = LC.text_source(e1, direct_text(t.texts)).cache()
    loc = LC.locator_matches(src, first_text(t.texts)).filter(F.col("pos") == btn).collect()
    got = {r["strategy"]: (r["value"], r["matches"]) for r in loc}
    assert got["css-path"] == ("html > body > main > form > button:nth-of-type(1)", 1)
    assert got["xpath-absolute"] == ("/html/body/main/form/button[1]", 1)
    assert got["xpath-relative"] == ('//button[@data-testid="go"]', 1)
    assert got["shortest-unique"] == ("button.submit-btn", 1)
    assert got["xpath-text"] == ('//button[normalize-space(text())="Submit"]', 1)
    tiers = LC.locator_tiers(LC.locator_matches(src, first_text(t.texts))).filter(F.col("pos") == btn).collect()[0]
    assert tiers["stable"].split("\n") == ["button.submit-btn", '//button[@data-testid="go"]',
                                           '//button[normalize-space(text())="Submit"]']
    assert tiers["positional"] == "html > body > main > form > button:nth-of-type(1)"
    assert tiers["fragile"] == "/html/body/main/form/button[1]"


def test_text_xpath_quotes_and_first_text_node(spark):
    t = tables(spark)
    for pid, want, matches in ((3, '//p[normalize-space(text())=concat("Say ",\'"\',"hi",\'"\',"")]', 1),
                               (4, '//p[normalize-space(text())="one two"]', 0)):
        e = t.elements_text.filter(F.col("page_id") == pid)
        src = LC.text_source(e, direct_text(t.texts))
        r = LC.xpath_text(src, first_text(t.texts)).filter(F.col("pos") == t.element(pid, "p")["pos"]).collect()[0]
        assert (r["text_selector"], r["matches"]) == (want, matches)


def test_page_snapshot(spark):
    t = tables(spark)
    p = t.pages.filter("page_id = 1")
    snap = S.page_snapshot(p, t.elements.filter("page_id = 1"), t.elements_text.filter("page_id = 1")).collect()[0]
    assert snap["snapshot"].split("\n") == [
        "PAGE: https://x.test/login", "TITLE: Sign in", "INTERACTIVE: 2 buttons, 0 links, 1 forms, 1 inputs",
        "A11Y: 1 images missing alt text", "", "LANDMARKS:", "  header#top.a.b.c", "  main", "", "HEADINGS:",
        '  h1 "Welcome back"', "", "CURRENT_SELECTION: body"]


def test_truncation(spark):
    df = spark.createDataFrame([("a\nb\nc\nd",)], "s string")
    r = df.select(truncate_lines("s", 2).alias("x"), truncate_lines("s", 4).alias("y")).collect()[0]
    assert r["x"] == "a\nb\n... [truncated 2 more lines]"
    assert r["y"] == "a\nb\nc\nd"


def test_malformed_tree(spark):
    t = tables(spark)
    els = {(r["tag"], r["nth_of_type"]): r for r in t.elements.filter("page_id = 6").collect()}
    article, p1, p2, b = els[("article", 1)], els[("p", 1)], els[("p", 2)], els[("b", 1)]
    assert p1["parent_pos"] == article["pos"] and p2["parent_pos"] == article["pos"]
    assert b["parent_pos"] == p1["pos"] and b["end_pos"] == p1["end_pos"]
    ul = els[("ul", 1)]
    assert els[("li", 1)]["parent_pos"] == ul["pos"] and els[("li", 2)]["parent_pos"] == ul["pos"]


def test_include_hidden(spark):
    t = tables(spark)
    got = out(R.clean_html(t.nodes_text, t.roots(1, "main"), R.Options(include_context=False, include_hidden=True)))
    assert got.endswith('<svg aria-label="vector graphic"></svg><p hidden="">secret</p></main>')
    a11y = out(R.a11y_outline(t.elements_text, t.roots(1, "main"), R.Options(include_context=False,
                                                                             include_hidden=True)))
    assert a11y.split("\n")[-1] == '  [p] "secret"'


def test_declared_styles_and_html_css(spark):
    t = make_tables(spark, [(9, "", '<html><body><article style="color: red; margin: 0px; COLOR : blue !important">'
                                     '<p id="x" style="display:block;opacity:0.5">a</p></article></body></html>')])
    root = t.roots(9, "article")
    st = R.declared_styles(t.elements_text, root, NOCTX, finalize=False).collect()[0]["raw"]
    assert st == "html > body > article {\n  color: blue;\n}\n\np#x {\n  display: block;\n  opacity: 0.5;\n}"
    hc = out(R.html_css(t.nodes_text, t.elements_text, root, NOCTX))
    assert hc == ('<article style="color: red; margin: 0px; COLOR : blue !important"><p id="x" '
                  'style="display:block;opacity:0.5">a</p></article>\n\n<style>\n' + st + "\n</style>")


def test_prompt_template(spark):
    from weblens.operators.prompt import build_prompt

    df = spark.createDataFrame([("structure", "T", "https://u", 2, "a\nb")], "f string, t string, u string, n int, o string")
    got = df.select(build_prompt(F.col("f"), F.col("t"), F.col("u"), F.col("n"), F.col("o")).alias("p")).collect()[0]["p"]
    assert got.split("\n") == [
        'Below is a structural tree outline of DOM elements from "T".', "URL: https://u",
        "Elements captured: 2 | Format: Structure", "",
        'Each line shows: tag#id.classes "text preview". Indentation represents nesting depth.',
        "Use this to understand the component hierarchy and locate elements by their position in the tree.", "",
        "```", "a", "b", "```"]
    fb = df.select(build_prompt(F.lit("zzz"), F.col("t"), F.col("u"), F.col("n"), F.col("o")).alias("p")).collect()[0]["p"]
    assert fb == 'DOM capture from "T"\nURL: https://u\nElements: 2 | Format: zzz\n\na\nb'


def test_multi_format_equals_single_formats(spark):
    t = tables(spark)
    roots = t.elements_text.filter(F.col("tag").isin("main", "form", "header", "div", "article"))
    got = {(r["page_id"], r["pos"], r["format"]): r["output"] for r in R.multi_format(t.nodes_text, roots).collect()}
    want = {}
    for df in (R.clean_html(t.nodes_text, roots), R.structure(t.elements_text, roots),
               R.a11y_outline(t.elements_text, roots), R.html_css(t.nodes_text, t.elements_text, roots)):
        want.update({(r["page_id"], r["pos"], r["format"]): r["output"] for r in df.collect()})
    assert got == want and len(got) > 0


SHADOW = ('<html><body><main><x-card id="c" class="k"><b>light</b><template shadowrootmode="open"><h2 class="s">in <i>side</i></h2>'
          '<div><template shadowrootmode="open"><span>deep</span></template>mid</div>tail</template><em>after</em>'
          '<template shadowrootmode="open"><img></template></x-card><section><template shadowrootmode="closed"><button>no</button></template>x</section>'
          '<b><template shadowrootmode="open"><a href="#">no host</a></template></b></main></body></html>')


def test_shadow_roots(spark):
    """Open roots come first and one level deeper in outlines; closed roots, second
    templates and templates without a possible host show nothing."""
    t = make_tables(spark, [(1, "u", SHADOW)])
    main = t.roots(1, "main")
    assert out(R.clean_html(t.nodes_text, main, NOCTX)) == (
        '<main><x-card id="c" class="k"><template shadowrootmode="open"><h2 class="s">in<i>side</i></h2><div><template shadowrootmode="open">'
        '<span>deep</span></template>mid</div>tail</template><b>light</b><em>after</em></x-card><section>x</section><b></b></main>')
    assert out(R.structure(t.nodes_text, main, NOCTX)).split("\n") == [
        'main "lightafterx"', '  x-card#c.k "lightafter"', "    #shadow-root", '      h2.s "in side"', '        i "side"', '      div "mid"',
        "        #shadow-root", '          span "deep"', '    b "light"', '    em "after"', '  section "x"', "  b"]
    assert out(R.a11y_outline(t.nodes_text, main, R.Options(include_context=False, depth=2))).split("\n") == [
        '[main] "lightafterx"', '  [x-card] "lightafter"', "    #shadow-root", '      [h2] "in side"', '      [div] "mid"', '    [b] "light"',
        '    [em] "after"', '  [section] "x"', "  [b]"]
    assert out(R.clean_html(t.nodes_text, main, R.Options(include_context=False, depth=1))) == (
        '<main><x-card id="c" class="k">lightafter</x-card><section>x</section><b></b></main>')
    counts = S.page_counts(t.pages, t.elements).collect()[0]
    assert (counts["buttons"], counts["links"], counts["images_missing_alt"]) == (0, 0, 0)
    assert S.headings(t.elements_text).count() == 0
    span = t.elements_text.filter("tag = 'span'").collect()[0]
    assert span["css_path"] == "html > body > main > x-card > div > span" and span["context"] == ["body", "main", "x-card#c.k", "div"]
    inside = t.roots(1, "div")
    assert out(R.structure(t.nodes_text, inside, NOCTX)).split("\n") == ['div "mid"', "  #shadow-root", '    span "deep"']


def test_visibility_is_inherited(spark):
    """A root inside a hidden element is hidden unless something nearer shows it again;
    seen from outside, the hidden subtree goes as a whole."""
    html = ('<main><div style="visibility: hidden">a<section>b</section><article style="visibility:visible">c<b>d</b></article></div>'
            '<form style="visibility: hidden !important; visibility: visible">e</form><nav style="visibility: hidden; visibility: bogus; visibility: visible">f</nav></main>')
    t = make_tables(spark, [(1, "u", html)])
    assert out(R.clean_html(t.nodes_text, t.roots(1, "main"), NOCTX)) == '<main><nav style="visibility: hidden; visibility: bogus; visibility: visible">f</nav></main>'
    assert out(R.clean_html(t.nodes_text, t.roots(1, "section"), NOCTX)) == ""
    assert out(R.structure(t.nodes_text, t.roots(1, "section"), NOCTX)) == ""
    assert out(R.clean_html(t.nodes_text, t.roots(1, "article"), NOCTX)) == '<article style="visibility:visible">c<b>d</b></article>'
    assert out(R.clean_html(t.nodes_text, t.roots(1, "section"), R.Options(include_context=False, include_hidden=True))) == "<section>b</section>"
    assert sorted(r["tag"] for r in t.elements.filter("hidden").collect()) == ["div", "form", "section"]


def test_references_without_semicolon(spark):
    """Longest accepted beginning in text; in attributes only where nothing that
    could go on the name follows."""
    t = make_tables(spark, [(1, "u", '<p title="?a=1&copy=2&lt;&amp&notx&not" id="&#65&#x42;&#67=">&copy 2024 &notit; &notin; &nbsp.&ampamp; &zzz &AMP&#65</p>')])
    p = t.element(1, "p")
    assert p["text"] == "\u00a9 2024 \u00acit; \u2209 \u00a0.&amp; &zzz &A"
    assert p["attr"]["title"] == "?a=1&copy=2<&&notx\u00ac" and p["attr"]["id"] == "ABC="


def test_pages_without_regions_use_their_top_elements(spark):
    t = make_tables(spark, [(1, "u", "<div>a<p>b</p></div><span>c</span>"), (2, "u", "<div><main>x</main></div>")])
    got = {(r["page_id"], r["output"]) for r in R.clean_html(t.nodes_text, R.region_roots(t.elements), NOCTX).collect()}
    assert got == {(1, "<div>a<p>b</p></div>"), (1, "<span>c</span>"), (2, "<main>x</main>")}


def test_deep_and_misnested_pages_stay_linear(spark):
    """100,000 unclosed elements and 50,000 misnested ones: nearest ancestors, clipped ends and
    path steps without a row for each pair of nested elements."""
    from weblens.operators import elements as E
    from weblens.operators import tree

    pages = spark.createDataFrame([(1, "u", "<div>" * 100_000), (2, "u", "<div><b><i>x</b></i></div>" * 25_000)], "page_id long, url string, html string")
    n = E.build_nodes(E.core_nodes(tree.build(tree.partition_pages(pages, 2)))).cache()
    deep = n.filter("page_id = 1").agg(F.max("depth"), F.count("*"), F.max(F.size("context"))).collect()[0]
    assert tuple(deep) == (99_999, 100_000, 6)
    bad = n.filter("page_id = 2 AND tag = 'i'").join(n.filter("page_id = 2 AND tag = 'b'").select(F.col("pos").alias("parent_pos"), F.col("end_pos").alias("outer")), "parent_pos")
    assert bad.count() == 25_000 and bad.filter("end_pos > outer").count() == 0
    n.unpersist()


def test_needles_meet_texts_by_rare_pieces(spark):
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("ab c") for _ in range(r.randint(40, 200))) for _ in range(300)] + ["x" * 90, "x" * 39 + "y" + "x" * 60]
    needles = [t[i:i + 40] for t in texts[:120] for i in (0, r.randint(0, len(t) - 40))] + ["x" * 40, "q" * 40]
    a = spark.createDataFrame([(1, "p", t, 1 + i % 3) for i, t in enumerate(dict.fromkeys(texts))], "page_id long, tag string, nt string, n long")
    b = spark.createDataFrame([(1, "p", x) for x in dict.fromkeys(needles)], "page_id long, tag string, needle string")
    got = {x["needle"]: x["n_in"] for x in LC.containing(a, b).collect()}
    want = {x: sum(1 + i % 3 for i, t in enumerate(dict.fromkeys(texts)) if x in t) for x in needles}
    assert got == {k: v for k, v in want.items() if v}


def test_one_plan_serves_roots_with_their_own_options(spark):
    """Each root by its own options gives what a job with those options as constants gives."""

    t = tables(spark)
    choices = [R.Options(), R.Options(depth=0, include_context=False), R.Options(depth=1, strip_noise=False), R.Options(include_hidden=True, truncation=3),
               R.Options(include_css=False, keep_test_ids=False)]
    roots = t.elements_text.filter("tag IN ('main', 'form', 'header', 'div', 'article', 'ul')").collect()
    pick = {(r["page_id"], r["pos"]): choices[i % len(choices)] for i, r in enumerate(sorted(roots, key=lambda r: (r["page_id"], r["pos"])))}
    names = [c[4:] for c in R.Options(per_root=True).columns()]
    rows = [(k[0], k[1], *[getattr(o, n) for n in names]) for k, o in pick.items()]
    kinds = {"depth": "int", "truncation": "int"}
    opts = spark.createDataFrame(rows, "page_id long, pos long, " + ", ".join(f"opt_{n} {kinds.get(n, 'boolean')}" for n in names))
    mine = t.elements_text.join(opts, ["page_id", "pos"])
    own = R.Options(per_root=True)
    got = {(r["page_id"], r["pos"], r["format"]): r["output"]
           for df in (R.multi_format(t.nodes_text, mine, own),) for r in df.collect()}
    want = {}
    for o in choices:
        keys = [k for k, c in pick.items() if c is o]
        some = t.elements_text.join(spark.createDataFrame(keys, "page_id long, pos long"), ["page_id", "pos"])
        for df in (R.clean_html(t.nodes_text, some, o), R.structure(t.nodes_text, some, o), R.a11y_outline(t.nodes_text, some, o), R.html_css(t.nodes_text, t.elements_text, some, o)):
            want.update({(r["page_id"], r["pos"], r["format"]): r["output"] for r in df.collect()})
    assert got == want and len(got) == 4 * len(pick)


def test_a_job_brings_its_own_lists_and_templates(spark):
    import pytest

    from weblens.functions.lists import names_of
    from weblens.operators.prompt import build_prompt

    t = tables(spark)
    keep = names_of(spark.createDataFrame([("data-foo",), ("style",), (None,), ("style",)], "name string"))
    noise = names_of(spark.createDataFrame([("data-",), ("_ng",), ("js",)], "prefix string"))
    opts = R.Options(include_context=False, keep=keep, noise=noise, keep_test_ids=False)
    assert out(R.clean_html(t.nodes_text, t.roots(2, "div"), opts)) == '<div style="color: red" data-foo="k">xy</div>'
    with pytest.raises(ValueError):
        names_of(spark.range(12).select(F.col("id").cast("string")), limit=10)
    df = spark.createDataFrame([("x", "T", "u", 2, "o"), ("y", "T", "u", 3, "o"), ("z", "T", "u", 4, "o")], "f string, t string, u string, n int, o string")
    own = {"x": ["{title}: {count}", "{output}"], "y": lambda c: F.concat(c["count"], F.lit("/"), c["url"])}
    got = df.select(build_prompt(*[F.col(c) for c in "ftuno"], templates=own, fallback=["{format}?"]).alias("p")).collect()
    assert [r["p"] for r in got] == ["T: 2\no", "3/u", "z?"]
