"""Selector payload and selector document (nested, JSON-ready)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.operators import locators as LC
from weblens.operators.render import Options, finalized


def selector_payload(els_text: DataFrame, loc: DataFrame) -> DataFrame:
    """``(page_id, pos, payload)``: description, text, best/css/fallback
    selectors, ranked candidates, tag, all attributes (noise kept) and the
    fingerprint."""
    ranked = LC.ranked_selectors(els_text).groupBy("page_id", "pos").agg(
        F.array_sort(F.collect_list(F.struct("rank", "type", "value", "score"))).alias("rk"))
    fp = LC.fingerprint(loc)
    e = els_text.select("page_id", "pos", "tag", "preview", "summary", "selector", "attrs")
    j = e.join(ranked, ["page_id", "pos"], "left").join(fp, ["page_id", "pos"], "left")
    rk = F.coalesce(F.col("rk"), F.array().cast("array<struct<rank:bigint,type:string,value:string,score:bigint>>"))
    payload = F.struct(
        F.when(F.col("preview") != "", F.col("preview")).otherwise(F.col("summary")).alias("description"),
        F.col("preview").alias("text"),
        F.struct(
            F.coalesce(F.try_element_at(rk, F.lit(1))["value"], F.col("selector")).alias("best"),
            F.col("selector").alias("css"),
            F.transform(F.slice(rk, 2, F.greatest(F.size(rk) - 1, F.lit(0))), lambda x: x["value"]).alias("fallback"),
        ).alias("selectors"),
        F.transform(rk, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"),
                                           x["score"].alias("score"))).alias("rankedSelectors"),
        F.col("tag").alias("tag"),
        F.map_from_entries("attrs").alias("attributes"),
        F.col("fingerprint").alias("fingerprint"),
    )
    return j.select("page_id", "pos", payload.alias("payload"))


def selector_document(payloads: DataFrame, pages_title: DataFrame, roots: DataFrame, opts: Options = Options()) -> DataFrame:
    """One JSON document per root ``{url, title, elements: [payload]}``,
    finalized like every other output: ``(page_id, pos, format, output)``."""
    j = roots.select("page_id", "pos", F.col("context").alias("root_context"), *opts.columns()).join(payloads, ["page_id", "pos"]).join(
        pages_title, "page_id", "left")
    doc = F.to_json(F.struct(F.col("url"), F.col("title"), F.array(F.col("payload")).alias("elements")))
    return j.select("page_id", "pos", F.lit("selectors").alias("format"),
                    finalized(doc, opts).alias("output"))
