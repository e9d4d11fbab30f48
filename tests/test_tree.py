"""Tree invariants and an independent sequential parse of every page."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from weblens.plans import context as C
from weblens.sources.pages import read_view


@pytest.mark.parametrize("view", ["raw", "rich", "malformed"])
def test_invariants(spark, view):
    e = C.elements(spark, SF_SMALL, view)
    p = e.alias("c").join(e.alias("p"), (F.col("c.page_id") == F.col("p.page_id"))
                          & (F.col("c.parent_pos") == F.col("p.pos")))
    bad = p.filter(~((F.col("p.pos") < F.col("c.pos")) & (F.col("c.end_pos") <= F.col("p.end_pos"))
                     & (F.col("c.depth") == F.col("p.depth") + 1)))
    assert bad.count() == 0
    e = C.paths(spark, SF_SMALL, view)  # unique in a scope: a shadow root numbers its children anew
    dup = e.groupBy("page_id", "scope", "css_path").count().filter("count > 1")
    assert dup.count() == 0
    assert e.groupBy("page_id", "scope", "xpath_absolute").count().filter("count > 1").count() == 0


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
        "wbr"}
HOSTS = ("article", "aside", "blockquote", "body", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "p", "section", "span")
BLOCKS = ("p", "div", "article", "nav", "ul", "h1", "h2", "footer", "header", "form", "section", "main")


class StackParser(HTMLParser):
    """The standard library's tokenizer with a plain stack: (tag, depth, parent
    tag) of every element in document order, inert template content left out."""

    def __init__(self):
        super().__init__()
        self.out, self.stack, self.ids, self.hosts = [], [], [], set()

    def handle_starttag(self, tag, attrs, closed=False):
        foreign = any(t in ("svg", "math") for t in [*self.stack, tag])
        if tag in BLOCKS and "p" in self.stack:
            self.pop("p")
        real = [t for t in self.stack if t != "#root"]
        mode = dict(attrs).get("shadowrootmode") if tag == "template" and self.stack else None
        host = self.stack and (self.stack[-1] in HOSTS or "-" in self.stack[-1]) and self.ids[-1] not in self.hosts
        if mode and host:
            self.hosts.add(self.ids[-1])
            self.stack.append("#root" if mode == "open" else "template")
            self.ids.append(None)
            return
        if "template" not in self.stack:
            self.out.append((tag, len(real), real[-1] if real else None))
        if tag not in VOID and not (closed and foreign):
            self.stack.append(tag)
            self.ids.append(self.getpos())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def pop(self, tag):
        while True:
            self.ids.pop()
            if self.stack.pop() == tag:
                break

    def handle_endtag(self, tag):
        if tag == "template" and "#root" in self.stack and "template" not in self.stack[self.stack[::-1].index("#root") * -1 - 1:]:
            tag = "#root"
        if tag not in ("b", "i", "span", "em", "strong", "a") and tag != "p" and tag not in self.stack and "p" in self.stack:
            return
        if tag in self.stack:
            self.pop(tag)


@pytest.mark.parametrize("view", ["raw", "rich", "malformed"])
def test_against_sequential_parse(spark, view):
    pages = read_view(spark, SF_SMALL, view).collect()
    els = C.elements(spark, SF_SMALL, view).select("page_id", "pos", "tag", "depth", "parent_tag").collect()
    by_page = {}
    for r in els:
        by_page.setdefault(r["page_id"], []).append(r)
    for p in pages:
        got = [(r["tag"], r["depth"], r["parent_tag"]) for r in sorted(by_page[p["page_id"]], key=lambda r: r["pos"])]
        parser = StackParser()
        parser.feed(p["html"])
        parser.close()
        assert got == parser.out, p["page_id"]
