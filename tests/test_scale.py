"""Partitions follow the HTML."""

from weblens.operators import tree
from weblens.plans import context as C

PAGE = "<html><head><title>t</title></head><body><h1>a</h1><p>{}</p></body></html>"


def _pages(spark, path, n, words):
    rows = [(i, f"https://a.test/{i}", PAGE.format("same " * words)) for i in range(n)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")


def test_partitions_follow_the_html_not_the_files(spark, tmp_path):
    """Text that compresses to next to nothing still gets partitions of its own size."""
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    _pages(spark, small, 4, 10)
    _pages(spark, large, 40, 200_000)
    assert C.num_partitions(spark, small) == spark.sparkContext.defaultParallelism
    html = 40 * 5 * 200_000
    assert C.num_partitions(spark, large) >= html // tree.PARTITION_BYTES


def test_written_tables_are_not_cached_again(spark, tmp_path):
    _pages(spark, str(tmp_path), 4, 10)
    for df in (C.core(spark, str(tmp_path)), C.nodes(spark, str(tmp_path)), C.paths(spark, str(tmp_path))):
        assert not df.is_cached and "bucket" in df._jdf.queryExecution().executedPlan().toString().lower()


MARKUP = '<html><body class="a b"><main id="m"><p class="x y z">one <b class="x y">two</b></p><p class="x">three</p></main></body></html>'


def _marked(spark, path, ids):
    spark.createDataFrame([(i, f"https://a.test/{i}", MARKUP) for i in ids], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")


def test_written_tables_meet_without_a_sort(spark, tmp_path):
    """Buckets are written in the order of pages and places, and wide rows are written once."""
    d = str(tmp_path)
    _marked(spark, d, range(6))
    C.core(spark, d)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = C.paths(spark, d)
        plan = e._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Sort [" not in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    row = e.filter("page_id = 3 AND tag = 'b'").first()
    assert (row["css_path"], row["preview"], row["parent_tag"], row["parent_classes"]) == ("html > body > main > p:nth-of-type(1) > b", "two", "p", ["x", "y", "z"])
    from weblens.operators import locators as LC
    from weblens.plans import registry as R
    assert R.els_src(spark, d).columns == LC.SOURCE


def test_a_page_without_an_id_keeps_its_ancestors(spark, tmp_path):
    """Rows of a null page id are on the table with what their ancestors tell."""
    d = str(tmp_path)
    _marked(spark, d, [1, None])
    rows = C.elements(spark, d).select("page_id", "tag", "selector", "parent_tag", "context").collect()
    of = lambda i: sorted(tuple(map(str, r[1:])) for r in rows if r["page_id"] == i)
    assert len(rows) == 12 and of(None) == of(1)
