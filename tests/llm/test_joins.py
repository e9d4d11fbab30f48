"""Hot keys: joins and ranks whose commonest key lies in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from weblens.llm import collocations, joins


@pytest.mark.parametrize("tasks", [1, 8, 1000])
def test_spread_join_is_an_inner_join(spark, tasks):
    rng = random.Random(tasks)
    keys = [0] * 400 + [1] * 100 + [rng.randrange(2, 90) for _ in range(700)]
    rows = spark.createDataFrame([(k, k % 3, i) for i, k in enumerate(keys)], "k long, j int, i long")
    facts = rows.groupBy("k", "j").agg(F.count("*").alias("times")).filter("k % 7 <> 2").withColumn("fact", F.col("k") * 10)
    got = joins.spread_join(rows, facts, ["k", "j"], "times", len(keys), tasks).select("k", "j", "i", "times", "fact").collect()
    want = [(k, k % 3, i, keys.count(k), k * 10) for i, k in enumerate(keys) if k % 7 != 2]
    assert sorted(map(tuple, got)) == sorted(want)


def test_spread_join_empty(spark):
    none = spark.createDataFrame([], "k long, i long")
    assert joins.spread_join(none, none.groupBy("k").agg(F.count("*").alias("times")), ["k"], "times", 0, 8).count() == 0


def test_ranks_of_a_language_in_many_tasks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["en"] * 8 + ["de", "und"]), f"p{i:05d}", rng.randrange(30, 60), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = collocations._ranked(df, [F.desc("score"), F.desc("a"), F.asc("phrase")]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1]))
        want += [(lang, r[1], i) for i, r in enumerate(own, 1)]
    assert sorted((r.lang, r.phrase, r["rank"]) for r in got) == sorted(want)
