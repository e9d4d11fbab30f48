"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

the smallest input (sf0.001) to compile code paths; caches are then dropped
and the timed run starts from the raw parquet at $BENCH_SF_DIR. The warm-up
time is reported as ``warmup_sec`` and not included in ``value``.
``core_build`` (tokenize + window tree + bucketed write) and ``nodes_build``
(previews + ancestor pass) are reported apart, the first also as MB of HTML per
second and core; per-query numbers are the work on top of them. ``value`` is the
total wall time of that run. ``median_warm`` is the median of $BENCH_REPEATS
(5) further runs of each query on the cached tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "page_snapshot", "page_counts", "headings", "landmarks", "element_tree", "css_path", "text_content",
    "clean_html", "structure", "a11y_outline", "a11y_findings", "ranked_selectors", "locator_matches",
    "shortest_unique", "xpath_relative", "xpath_text", "token_costs", "selection_replay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from weblens.plans import context as C
    from weblens.plans.registry import QUERIES
    from weblens.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="weblens-bench")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    t_w = time.time()
    if warm_dir and os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            if name in QUERIES:
                QUERIES[name](spark, warm_dir).selectExpr("hash(*) AS h").agg({"h": "sum"}).collect()
        C.clear()
    warmup = time.time() - t_w
    t_all = time.time()
    t0 = time.time()
    n_nodes = C.core(spark, sf_dir).count()
    core_build = time.time() - t0
    t0 = time.time()
    C.nodes(spark, sf_dir).count()
    nodes_build = time.time() - t0
    times = {"core_build": round(core_build, 3), "nodes_build": round(nodes_build, 3)}
    rows = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        # force full evaluation of every column without collecting to the driver
        rows[name] = df.selectExpr("hash(*) AS h").agg({"h": "sum", "*": "count"}).collect()[0][1]
        times[name] = round(time.time() - t0, 3)
    total = time.time() - t_all
    median = {}
    for name in [n for n in HEADLINE if n in QUERIES]:
        runs = []
        for _ in range(int(os.environ.get("BENCH_REPEATS", "5"))):
            t0 = time.time()
            QUERIES[name](spark, sf_dir).selectExpr("hash(*) AS h").agg({"h": "sum"}).collect()
            runs.append(time.time() - t0)
        median[name] = round(statistics.median(runs), 3) if runs else None
    html_mb = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("sum(octet_length(html)) / 1e6 AS mb").first()[0]
    n_pages = C.pages(spark, sf_dir).count()
    print(json.dumps({
        "metric": "weblens_headline_total", "value": round(total, 3), "unit": "sec", "queries": times,
        "warmup_sec": round(warmup, 3), "session": "warm (JIT warm-up on sf0.001, caches dropped)",
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "pages": n_pages, "nodes": n_nodes,
        "pages_per_sec": round(n_pages / total, 2), "rows": rows, "median_warm": median,
        "core_build_mb_per_sec_core": round(float(html_mb) / core_build / int(cpus), 4),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
