"""Text-node operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions.text import js_trim


def direct_text(texts: DataFrame) -> DataFrame:
    """Own text of each element: its text nodes trimmed, blanks dropped,
    joined by one space in document order: ``(page_id, pos, direct_text)``."""
    t = texts.filter("NOT via_shadow").select("page_id", "parent_pos", "pos", js_trim("text").alias("t")).filter(
        (F.col("t") != "") & F.col("parent_pos").isNotNull())
    return t.groupBy("page_id", "parent_pos").agg(
        F.expr("listagg(t, ' ') WITHIN GROUP (ORDER BY pos)").alias("direct_text")
    ).withColumnRenamed("parent_pos", "pos")


def first_text(texts: DataFrame) -> DataFrame:
    """First text node child of each element (``text()`` in an XPath string
    function): ``(page_id, pos, first_text)``."""
    t = texts.filter(F.col("parent_pos").isNotNull() & ~F.col("via_shadow"))
    return t.groupBy("page_id", "parent_pos").agg(F.min_by("text", "pos").alias("first_text")) \
        .withColumnRenamed("parent_pos", "pos")
