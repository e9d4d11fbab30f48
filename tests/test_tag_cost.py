"""What reading a tag, a reference and a node's ancestors costs, and that it stays right."""

import re

from weblens.functions import lists as L
from weblens.functions.text import clean_text, decode_entities, js_trim
from weblens.operators import locators as LC
from weblens.operators import render as R
from weblens.operators.attrs import first_wins, parse_attrs
from weblens.plans import context as C


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attributes_are_cut_from_one_pass(spark):
    """The attribute pattern runs once over a tag, however many attributes it has."""
    df = spark.createDataFrame([("<a href='x' HREF=y b>",)], "raw string").select(first_wins(parse_attrs("raw")).alias("a"))
    plan = _optimized(df)
    # one more is the pass over the references of a value
    assert plan.count("regexp_extract_all") == 2
    assert [tuple(x) for x in df.first()["a"]] == [("href", "x"), ("b", "")]


def test_reference_tables_are_not_sent_as_maps(spark):
    """No task carries the thousands of names as values of a map."""
    df = spark.createDataFrame([("&eacute;&lt;&copy&nosuch;&NotEqualTilde;",)], "t string").select(decode_entities("t").alias("t"))
    assert "keys: [" not in _optimized(df)
    assert df.first()["t"] == "é<©&nosuch;≂̸"


def test_attribute_forms(spark):
    tags = {
        "<br>": [], "<br/>": [], "<A  b>": [("b", "")], "<a b = 'c  d' e=\"f=g'\" h=i/j k=>": [("b", "c  d"), ("e", "f=g'"), ("h", "i/j"), ("k", "")],
        "<a b\n=\t\"\n x \" c=d=e b=2>": [("b", "\n x "), ("c", "d=e")], "<a b=''c=\"\">": [("b", ""), ("c", "")],
        "<a é='ü&amp;&copy=1' B='&copy;'>": [("é", "ü&&copy=1"), ("b", "©")],
    }
    got = spark.createDataFrame([(t,) for t in tags], "raw string").select("raw", first_wins(parse_attrs("raw")).alias("a")).collect()
    assert {r["raw"]: [tuple(x) for x in r["a"]] for r in got} == tags


def test_texts_ask_for_one_level(spark):
    """The ancestor pass emits a row per level for elements only: a text needs its parent."""
    html = "<i>" * 9 + "t" + "</i>" * 9
    t = C.Tables(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    text = t.nodes.filter("kind = 'text'").select("parent_tag", "depth", "place").first()
    assert (text["parent_tag"], text["depth"], len(text["place"])) == ("i", 9, 1)


def test_captured_pages_move_their_html_once(spark, tmp_path):
    """The join with the log takes the partitions that the tree is built on."""
    rows = [(i, f"https://a.test/{i}", "<body><p>a</p></body>") for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    events = [(n, f"2024-01-01 00:00:{n:02}", n % 7, "click", '{"k": 1}') for n in range(20)]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, props string")
    df.selectExpr("event_id", "to_timestamp(ts) AS ts", "user_id", "event_type", "0D AS value", "props").write.parquet(f"{tmp_path}/events.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = C.captured_pages(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("\n")
        at = next(i for i, x in enumerate(lines) if "Scan parquet" in x and "html" in x)
        indent, above = lambda x: len(x) - len(x.lstrip(" :+-")), []
        for x in reversed(lines[:at]):
            if indent(x) < indent(lines[at] if not above else above[-1]):
                above.append(x)
        moves = [x for x in above if "Exchange" in x]
        assert len(moves) == 1 and "REPARTITION_BY_NUM" in moves[0]
        got = C.captured_pages(spark, str(tmp_path))
        assert sorted(r["page_id"] for r in got.collect()) == sorted({n % 7 for n in range(20) if [m % 7 for m in range(20)].count(n % 7) % 2})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_markup_is_made_once_per_node(spark):
    """Texts and start tags are cleaned below the windows that give each root its nodes."""
    html = '<main class="m"><section><p title="a &amp; b">x  &lt;\n y</p></section></main>'
    t = C.Tables(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    roots = R.region_roots(t.elements)
    p = '<p title="a &amp; b">x &lt; y</p>'
    want = {"main": f'<main class="m"><section>{p}</section></main>', "section": f"<section>{p}</section>"}
    for out in (R.clean_html(t.nodes, roots, finalize=False).withColumnRenamed("raw", "output"), R.multi_format(t.nodes, roots, R.Options(include_context=False)).filter("format = 'clean-html'")):
        above = _optimized(out).split("Window [")[0]
        assert "regexp_replace" not in above and "&quot;" not in above and "WARNING(" not in above
        tags = t.elements.select("page_id", "pos", "tag")
        assert {r["tag"]: r["output"] for r in out.join(tags, ["page_id", "pos"]).collect()} == want
    for out in (R.structure(t.nodes, roots), R.a11y_outline(t.nodes, roots)):
        above = _optimized(out).split("Window [")[0]
        assert "preview" not in above and "WARNING(" not in above


def test_style_rules_are_made_once_per_node(spark):
    """An inline style is cut into its declarations once, below the windows that give each
    root its nodes, however many properties are reported and declarations it has."""
    style = "color: red; margin: 0px; COLOR: blue !important; color: green; background: url(data:a;b); top : 1px; width: 5px;no; :x"
    html = f'<main style="{style}"><section style="display: none-such"><p style="width:2px; width:3px">x</p><p style="border: none">y</p></section></main>'
    t = C.Tables(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    roots = R.region_roots(t.elements)
    opts = R.Options(include_context=False)
    p = "p {\n  width: 3px;\n}"
    out = R.declared_styles(t.elements, roots, opts, finalize=False)
    got = {r["tag"]: r["raw"] for r in out.join(t.elements.select("page_id", "pos", "tag"), ["page_id", "pos"]).collect()}
    assert got["section"].endswith(p) and got["main"].endswith(got["section"])
    rule = got["main"].split("}")[0]
    assert rule.startswith("main {\n") and "  color: blue;\n" in rule and "  width: 5px;\n" in rule and "red" not in rule and "green" not in rule
    kept = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        for df in (out, R.html_css(t.nodes, t.elements, roots, opts), R.multi_format(t.nodes, roots, opts)):
            plan = _optimized(df)
            assert plan.count("regexp_extract_all") == 1
            assert "regexp_extract_all" not in plan.split("Window [")[0]
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", kept)
    for df in (R.html_css(t.nodes, t.elements, roots, opts), R.multi_format(t.nodes, roots, opts).filter("format = 'html-css'")):
        both = df.join(t.elements.select("page_id", "pos", "tag"), ["page_id", "pos"]).collect()
        assert {r["tag"]: r["output"].split("<style>\n")[1] for r in both} == {k: v + "\n</style>" for k, v in got.items()}


def test_locator_candidates_are_made_once(spark):
    """Asked class pairs are read from the classes, not from the candidates made again, and
    a plain name is escaped by one look at it."""
    from weblens.functions.text import css_escape

    html = '<div class="a b c">x</div><div class="a b">y</div><div class="b c"><i class="a b">z</i></div><div class="a c d">w</div>'
    t = C.Tables(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    out = LC.shortest_unique(t.elements)
    assert _optimized(out).count("inline(") == 1
    got = [r["shortest_unique"] for r in out.orderBy("pos").collect()]
    assert {"i.a", "div.d"} <= set(got)
    pairs = LC.pair_match_keys(t.elements, t.elements).groupBy("key").count().collect()
    assert {tuple(r["key"]): r["count"] for r in pairs} == {
        ("tcc", "div", "a", "b"): 2, ("tcc", "div", "a", "c"): 2, ("tcc", "div", "b", "c"): 2, ("tcc", "i", "a", "b"): 1, ("tcc", "div", "a", "d"): 1, ("tcc", "div", "c", "d"): 1}
    names = {"a": "a", "-a_1": "-a_1", "_": "_", "-": "\\-", "--x": "--x", "1a": "\\31 a", "-1": "-\\31 ", "a:b": "a\\:b", "a\n": "a\\a ", "é": "é", "": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", css_escape("n").alias("e"))
    assert {r["n"]: r["e"] for r in df.collect()} == names


def test_pieces_do_not_carry_their_text(spark):
    """A text of n characters has n / 8 pieces: with the text on each they would hold n * n / 8."""
    long = "".join(f"{i:07} " for i in range(2000))
    texts = spark.createDataFrame([(1, "p", long, 2), (1, "p", long[8:] + "q", 3), (1, "b", long, 5)], "page_id long, tag string, nt string, n long")
    needles = spark.createDataFrame([(1, "p", long[:40]), (1, "p", long[8003:8043]), (1, "p", "q" * 40), (2, "p", long[:40])], "page_id long, tag string, needle string")
    kept = []
    out = LC.containing(texts, needles, lambda df: kept.append(df) or df)
    wide = [x for x in _optimized(out).split("\n") if "piece#" in x and re.search(r"\bnt#", x) and "Generate" not in x]
    assert wide == [] and len(kept) == 1
    assert {(r["tag"], r["needle"]): r["n_in"] for r in out.collect()} == {("p", long[:40]): 2, ("p", long[8003:8043]): 5}


def test_white_space_is_what_it_is_in_the_browser(spark):
    """Every listed character and no other, and the end of a text is no line end. Members
    beyond U+00FF are looked at only for a character there."""
    chars = [*L.JS_WS_CHARS, "\x85", "\u180e", "\u200b", "\u2030", "é", "漢", "\U0001f600", "\x1f"]
    rows = [(c, f"{c}{c}a{c} b{c}") for c in chars] + [("", None)]
    df = spark.createDataFrame(rows, "c string, t string").select("c", clean_text("t").alias("clean"), js_trim("t").alias("trim"))
    ws = set(L.JS_WS_CHARS)
    for r in df.filter("c <> ''").collect():
        c = r["c"]
        assert (r["clean"], r["trim"]) == (("a b", f"a{c} b") if c in ws else (f"{c}{c}a{c} b{c}",) * 2)
    assert df.filter("c = ''").first()["trim"] is None
    ends = spark.createDataFrame([("x \x85",)], "t string").select(js_trim("t").alias("t")).first()["t"]
    assert ends == "x \x85"
    assert "&&[" in _optimized(df) and "^[" not in _optimized(df)
