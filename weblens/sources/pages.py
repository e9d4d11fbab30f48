"""Page sources: the raw ``pages`` table, the enriched ``pages_rich`` view and
the capturable-page filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import lists as L

# FIXED VALUES: anchors of the enriched test view and their replacements
# (the same replace() chain is used by the DuckDB oracle).
RICH_REPLACEMENTS = [
    ("<body>", '<body><header id="top" class="a b c d"><button data-testid="menu" data-gtm-id="7" '
               'aria-label="Menu" onclick="m()"></button></header>'),
    ("<nav>", '<nav role="navigation" aria-label="Main" class="bar wide">'),
    ('<div class="ad">', '<div class="ad slot" data-analytics="x" data-gallery="1" data-author="z" hidden>'),
    ("<article>", '<article data-v-1f="" style="color: red; margin: 0px"><form class="login card">'
                  '<input name="q" placeholder="Find"><button class="go"></button>'
                  '<button class="go" aria-label="Go">Go</button></form><img src="a.png">'
                  '<img src="b.png" alt="B &amp; C">'
                  # an open root behind a light child, one in it, a second template, references without semicolon
                  '<x-card id="card" class="host"><b>light &copy 2024 &notit; &ampx &#65</b><template shadowrootmode="open">'
                  '<h2 class="sh">shadow <i>head</i></h2><button></button><div style="color: blue"><template shadowrootmode=open>'
                  '<span>deep</span></template>inner</div> tail</template><b title="?x=1&copy=2&lt=3&amp">light2</b>'
                  '<template shadowrootmode="open"><img src="never.png"></template></x-card>'
                  '<section><template shadowrootmode="closed"><button>closed</button></template><div style="visibility:hidden">gone '
                  '<b style="visibility: visible !important; visibility: hidden">back</b><main>inherits</main><nav style="visibility:visible">nav</nav></div></section>'
                  '<x-void><template shadowrootmode="open"></template></x-void><b><template shadowrootmode="open">no host</template></b>'),
    ("<footer>", '<footer aria-hidden="true"><svg class="i"><path d="M0" aria-label="dot"/></svg>'),
    ("<h1>", '<h1 id="a\tb" style="background: url(data:image/png;base64,AA==); color: red !important; color: blue">'
             '<dialog><p>closed</p></dialog><dialog open>&eacute;&#146;&#38;lt;</dialog>'),
]

# FIXED VALUES: anchors of the malformed test view: misnesting, stray and missing
# end tags, "/>" on HTML elements, unquoted values, "<" in text, names that start
# like raw-text tags, inert template content, skipped markup.
MALFORMED_REPLACEMENTS = [
    ("<nav>", '<nav/><div><p>one</span>two</div></p><section><em>u<strong>v</section>w</em></strong>'),
    ("<article>", '<article><div><span>a</div>b</span><b>x<i>y</b>z</i><a href=/x/>link</a>'
                  "<p>a < b <? pi ?>c<p>1 <2 <3</p><style-guide kind=k>sg</style-guide><title-bar>t</title-bar>"
                  '<template><button>inert</button><img src="t.png"></template><button>live</button>'
                  '<svg viewBox="0 0 1 1"><g/><path d="M0"/></svg><math><mi/></math></ bogus></>'
                  "<script data-a='x>y'>if(a<b){}</script ><input value=a/b disabled data-x='q\"r'/><h2>caf&eacute;</h2>"),
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages(page_id, url, html)``."""
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def enrich(pages: DataFrame) -> DataFrame:
    """Deterministic ``replace()`` chain that adds ids, test ids, ARIA, noise
    attributes, forms, images, styles and hidden subtrees to every page."""
    html = F.col("html")
    for a, b in RICH_REPLACEMENTS:
        html = F.replace(html, F.lit(a), F.lit(b))
    return pages.select("page_id", "url", html.alias("html"))


def malform(pages: DataFrame) -> DataFrame:
    """``replace()`` chain that breaks every page's markup in known ways."""
    html = F.col("html")
    for a, b in MALFORMED_REPLACEMENTS:
        html = F.replace(html, F.lit(a), F.lit(b))
    return pages.select("page_id", "url", html.alias("html"))


def read_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """Pages as they are (``raw``), enriched (``rich``) or broken (``malformed``)."""
    change = {"raw": lambda p: p, "rich": enrich, "malformed": malform}[view]
    return change(read_pages(spark, sf_dir))


def read_pages_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(read_pages(spark, sf_dir))


def restricted_url(url) -> F.Column:
    """True for browser-internal URLs that cannot be captured; null/'' are allowed."""
    url = F.col(url) if isinstance(url, str) else url
    cond = F.lit(False)
    for p in L.RESTRICTED_URL_PREFIXES:
        cond = cond | url.startswith(p)
    return F.coalesce(cond, F.lit(False))


def capturable_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~restricted_url("url"))
