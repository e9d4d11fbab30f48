"""The page feed over a table that is a folder of files."""

from weblens.streaming.page_feed import stream_snapshot


def test_page_feed_reads_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"https://a.test/{i}", f"<html><head><title>t</title></head><body><h1>a</h1><p>{i}</p></body></html>") for i in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    rows = stream_snapshot(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(6))
    assert all('h1 "a"' in r["snapshot"] for r in rows)
