"""Selections as rows: live captures (stale ones dropped), the serializable
capture row, traversal to parent / first child."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import lists as L


def live_captures(selections: DataFrame, els: DataFrame) -> DataFrame:
    """Selections whose element exists on the tab's page and can be selected,
    renumbered in selection order: ``(tab, sel_order, page_id, pos)`` plus the
    element columns."""
    e = els.filter(~F.col("tag").isin(L.UNSELECTABLE_TAGS))
    j = selections.select("tab", "element", F.col("sel_order").alias("order0")).join(
        e, (F.col("tab") == F.col("page_id")) & (F.col("element") == F.col("el_ord")))
    w = Window.partitionBy("tab").orderBy("order0")
    return j.withColumn("sel_order", F.row_number().over(w).cast("long")).drop("order0", "element")


def capture_rows(live: DataFrame, formats: DataFrame) -> DataFrame:
    """The serializable selection: id, summary, selector, tag name, and its
    outputs by format (``formats``: tab, sel_order and a format map)."""
    return live.select("tab", "sel_order",
                       F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("pos").cast("string"))
                       .alias("selection_id"),
                       "summary", "selector", F.col("tag").alias("tag_name")).join(formats, ["tab", "sel_order"])


def _last(live: DataFrame) -> DataFrame:
    m = live.groupBy("tab").agg(F.max("sel_order").alias("sel_order"))
    return live.join(m, ["tab", "sel_order"], "left_semi")


def traverse_parent(live: DataFrame) -> DataFrame:
    """Move each tab's last selection to its parent, unless there is none or
    it is the document element: ``(tab, page_id, pos_before, pos_after)``."""
    last = _last(live)
    is_doc = (F.col("depth") == 1) & (F.col("parent_tag") == "html")
    after = F.when(F.col("parent_pos").isNotNull() & ~is_doc, F.col("parent_pos")).otherwise(F.col("pos"))
    return last.select("tab", "page_id", F.col("pos").alias("pos_before"), after.alias("pos_after"))


def traverse_child(live: DataFrame, els: DataFrame) -> DataFrame:
    """Move each tab's last selection to its first element child, if any."""
    last = _last(live)
    first = els.filter(F.col("parent_pos").isNotNull()).groupBy("page_id", "parent_pos").agg(
        F.min("pos").alias("first_child")).withColumnRenamed("parent_pos", "pos")
    j = last.select("tab", "page_id", "pos").join(first, ["page_id", "pos"], "left")
    return j.select("tab", "page_id", F.col("pos").alias("pos_before"),
                    F.coalesce("first_child", "pos").alias("pos_after"))
