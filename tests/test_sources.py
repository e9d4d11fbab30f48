"""Capturable-page rule: browser-internal URLs are excluded, empty/null kept."""

from weblens.sources.pages import capturable_pages


def test_capturable_urls(spark):
    urls = [(1, "https://a.test/"), (2, "chrome://settings"), (3, "chrome-extension://x/y"), (4, "devtools://d"),
            (5, "edge://flags"), (6, "about:blank"), (7, "file:///tmp/x.html"), (8, ""), (9, None),
            (10, "http://about.test/")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    assert sorted(r["page_id"] for r in capturable_pages(df).collect()) == [1, 8, 9, 10]


def test_outputs_through_the_sink(spark, tmp_path):
    """Written by format, read with the other formats pruned, rewritten format by format."""
    from conftest import SF_SMALL
    from weblens.functions import lists as L
    from weblens.plans.registry import capture_outputs
    from weblens.sources.sinks import read_outputs, write_outputs

    path, key = str(tmp_path / "out"), ["tab", "sel_order", "format", "output"]
    out = capture_outputs(spark, SF_SMALL)
    rows = sorted(map(tuple, out.select(key).collect()))
    write_outputs(out, path)
    write_outputs(out, path)  # a job that runs again replaces its rows
    back = read_outputs(spark, path)
    assert {r.format for r in back.select("format").distinct().collect()} == set(L.FORMATS)
    assert sorted(map(tuple, back.select(key).collect())) == rows
    some = read_outputs(spark, path, ["structure"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "structure" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(some.inputFiles()) >= 1 and {r.format for r in some.select("format").distinct().collect()} == {"structure"}
    write_outputs(some.limit(1).cache(), path)
    now = {r.format: r["count"] for r in read_outputs(spark, path).groupBy("format").count().collect()}
    before = len(rows) // len(L.FORMATS)
    assert now.pop("structure") == 1 and set(now.values()) == {before}


def test_missing_shared_folder_raises_off_local_masters(monkeypatch):
    import pytest

    from weblens import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
