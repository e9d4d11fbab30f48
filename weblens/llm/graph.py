"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: hang a node's larger neighbours on its smallest one (or
    itself). Small star: hang a node and its smaller neighbours on the smallest."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        low = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        out = (
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
            .select("e.a", "e.b")
        )
    return out.filter("a <> b")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node is the end of one edge or the root of some, not both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.lit(1).alias("end")), F.struct(F.col("a").alias("node"), F.lit(0).alias("end")))).alias("x"))
    seen = ends.groupBy("x.node").agg(F.sum("x.end").alias("ends"), F.min("x.end").alias("root"))
    return seen.filter("ends > 1 OR (ends = 1 AND root = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of an edge: comp is the smallest node of its
    component. ``edges`` has columns a and b in any order, repeated or not; only
    one yes or no comes to the driver after each round."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    while True:
        e = cut(_star(_star(e, True), False).distinct(), "edges")
        if _is_forest_of_stars(e):
            break
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(roots)
