"""Page-level snapshot: interactive counts, images without alt, landmarks,
headings, title, and the assembled snapshot text.

All per-page work is one ``groupBy(page_id)`` or a ``row_number() <= k``
window (planned as WindowGroupLimit) on the page-partitioned element table,
so nothing here shuffles the elements again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import lists as L
from weblens.functions.text import clean_text, finalize_output
from weblens.operators.elements import in_document


def _attr(name):
    return F.col("attr")[name]


def is_button():
    return (F.col("tag") == "button") | (F.coalesce(_attr("role"), F.lit("")) == "button")


def missing_alt():
    return (F.col("tag") == "img") & (F.coalesce(_attr("alt"), F.lit("")) == "")


def page_counts(pages: DataFrame, els: DataFrame) -> DataFrame:
    """``(page_id, buttons, links, forms, inputs, images_missing_alt)``; every
    element counted once per group, zeros for a page without elements."""
    n = in_document(els).groupBy("page_id").agg(
        F.count_if(is_button()).alias("buttons"),
        F.count_if((F.col("tag") == "a") & _attr("href").isNotNull()).alias("links"),
        F.count_if(F.col("tag") == "form").alias("forms"),
        F.count_if(F.col("tag").isin(L.INPUT_TAGS)).alias("inputs"),
        F.count_if(missing_alt()).alias("images_missing_alt"),
    )
    return pages.select("page_id").join(n, "page_id", "left").fillna(0, n.columns[1:])


def first_k(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("pos")
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def headings(els_text: DataFrame) -> DataFrame:
    """First 20 h1-h3 per page in document order: ``(page_id, rank, tag, text)``."""
    h = in_document(els_text).filter(F.col("tag").isin(L.HEADING_TAGS)).select("page_id", "pos", "tag", "text")
    return first_k(h, L.SNAPSHOT_HEADINGS).select("page_id", "rank", "tag", clean_text("text").alias("text"))


def landmarks(els: DataFrame) -> DataFrame:
    """First 25 landmark elements per page: ``(page_id, rank, summary)``."""
    lm = in_document(els).filter(F.col("tag").isin(L.LANDMARK_TAGS)).select("page_id", "pos", "summary")
    return first_k(lm, L.SNAPSHOT_LANDMARKS).select("page_id", "rank", "summary")


def page_title(pages: DataFrame, els_text: DataFrame) -> DataFrame:
    """``(page_id, url, title)``: text of the first ``title`` element with ASCII
    whitespace stripped and collapsed ('' without a title)."""
    t = in_document(els_text).filter(F.col("tag") == "title").groupBy("page_id").agg(
        F.min_by("text", "pos").alias("t"))
    title = F.trim(F.regexp_replace(F.coalesce(F.col("t"), F.lit("")), "[ \t\n\f\r]+", " "))
    return pages.select("page_id", "url").join(t, "page_id", "left").select("page_id", "url", title.alias("title"))


def page_parts(pages: DataFrame, els: DataFrame, els_text: DataFrame) -> DataFrame:
    """Per page: url, title, counts, landmark and heading lines."""
    counts = page_counts(pages, els)
    lm = landmarks(els).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "summary"))).alias("lm"))
    hd = headings(els_text).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat("tag", F.lit(' "'), "text", F.lit('"')).alias("line"))))
        .alias("hd"))
    t = page_title(pages, els_text)
    return t.join(counts, "page_id", "left").join(lm, "page_id", "left").join(hd, "page_id", "left")


def snapshot_text(current) -> F.Column:
    indent = lambda arr, f: F.transform(F.coalesce(arr, F.array()), lambda x: F.concat(F.lit("  "), x[f]))
    lines = F.concat(
        F.array(
            F.concat(F.lit("PAGE: "), F.col("url")),
            F.concat(F.lit("TITLE: "), F.col("title")),
            F.format_string("INTERACTIVE: %d buttons, %d links, %d forms, %d inputs",
                            F.coalesce("buttons", F.lit(0)), F.coalesce("links", F.lit(0)),
                            F.coalesce("forms", F.lit(0)), F.coalesce("inputs", F.lit(0))),
            F.format_string("A11Y: %d images missing alt text", F.coalesce("images_missing_alt", F.lit(0))),
            F.lit(""), F.lit("LANDMARKS:"),
        ),
        indent(F.col("lm"), "summary"),
        F.array(F.lit(""), F.lit("HEADINGS:")),
        indent(F.col("hd"), "line"),
        F.array(F.lit(""), F.concat(F.lit("CURRENT_SELECTION: "), F.coalesce(current, F.lit("")))),
    )
    return F.array_join(lines, "\n")


def snapshot_for_roots(parts: DataFrame, roots: DataFrame, opts=None) -> DataFrame:
    """Snapshot output (finalized) for each root element: ``(page_id, pos, output)``."""
    from weblens.operators.render import Options, finalized

    opts = opts or Options()
    r = roots.select("page_id", "pos", F.col("summary").alias("current"), F.col("context").alias("root_context"), *opts.columns())
    j = r.join(parts, "page_id", "left")
    return j.select("page_id", "pos", F.lit("page-snapshot").alias("format"), finalized(snapshot_text(F.col("current")), opts).alias("output"))


def page_snapshot(pages: DataFrame, els: DataFrame, els_text: DataFrame, target_tag: str = "body") -> DataFrame:
    """Snapshot text per page (target = first ``body``, else the root)."""
    tgt = els.groupBy("page_id").agg(
        F.coalesce(F.min_by(F.when(F.col("tag") == target_tag, F.col("summary")),
                            F.when(F.col("tag") == target_tag, F.col("pos"))),
                   F.min_by("summary", "pos")).alias("current"),
        F.coalesce(F.min_by(F.when(F.col("tag") == target_tag, F.col("context")),
                            F.when(F.col("tag") == target_tag, F.col("pos"))),
                   F.min_by("context", "pos")).alias("chain"))
    j = page_parts(pages, els, els_text).join(tgt, "page_id", "left")
    chain = F.coalesce(F.col("chain"), F.array().cast("array<string>"))
    return j.select("page_id", finalize_output(snapshot_text(F.col("current")), chain).alias("snapshot"))
