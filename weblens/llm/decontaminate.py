"""Benchmark decontamination by winnowing.

A document and an item share a window of ``n`` words only if they share the
k-gram that is the minimum of the window's ``n - k + 1`` k-grams. So both sides
keep just those minima (winnowing with windows of ``n - k + 1``), join on them,
and extend each hit to both sides, by at most ``n - k`` words, comparing word
by word. Every shared span of at least ``n`` words is found, nothing shorter is
reported. Items with fewer than ``n`` words are one window of their own length
L: level L keeps every L-gram (a winnowing window of 1), for those lengths only
which the benchmark has.

Scale: one pass over the documents. Their minima meet a bitmap of the items'
minima first (2 ** 24 bits whatever the benchmark's size, so that the
broadcast has a fixed bound); it lets through all true partners and the few
that collide. What is left is joined with the items by fingerprint; a passage
that a third of all documents hold is spread by a salt, to which the items'
(grouped) rows are repeated. Equal rows are grouped by id and digest, not by id.

Defined results: null and empty texts have no words and no hits; an empty
benchmark hits nothing; repeated document rows each get a row; a null item id
hits words but is not counted or listed; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.textops import ALNUM, U, buffers, grams, mix, signed, winnow, words
from weblens.session import packed, ship

WINDOW = 10
SALTS = 16
_BITS = 24

_ITEM = "item_id string, k int, fp long, ahead array<long>, back array<long>"
_DOC = "doc_id long, dig binary, n_words long, k int, fp long, pos long, ahead array<long>, back array<long>"


def _lists(h: np.ndarray, pos: np.ndarray, k: int, reach: int) -> tuple[list, list]:
    """For each place: the words from it on (k + reach), and those before it,
    nearest first (reach)."""
    s = signed(h)
    return [s[p:p + k + reach] for p in pos], [s[max(0, p - reach):p][::-1] for p in pos]


def _fingerprints(h: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    g = grams(h, k)
    at = winnow(g, w)
    return at, mix(g[at] + U(k))


def _item_rows(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, ks, fps, ahead, back = [], [], [], [], []
        for item, x in zip(b.column(0).to_pylist(), buffers(b.column(1))):
            h = words(x, ALNUM, lower=True)[2]
            if len(h) == 0:
                continue
            kk, w = (k, n - k + 1) if len(h) >= n else (len(h), 1)
            at, fp = _fingerprints(h, kk, w)
            a, c = _lists(h, at, kk, n - k if len(h) >= n else 0)
            ids += [item] * len(at)
            ks += [kk if w == 1 else 0] * len(at)
            fps.append(signed(fp))
            ahead += a
            back += c
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(ks, pa.int32()), pa.array(np.concatenate(fps) if fps else [], pa.int64()),
             pa.array(ahead, pa.list_(pa.int64())), pa.array(back, pa.list_(pa.int64()))],
            ["item_id", "k", "fp", "ahead", "back"],
        )


def _doc_rows(batches: Iterator[pa.RecordBatch], n: int, k: int, short: list[int], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document one row that counts its words (k = -1), and one for each
    kept fingerprint that the bitmap has."""
    levels = [(k, n - k + 1, 0)] + [(s, 1, s) for s in short]
    for b in batches:
        row, nw, ks, fps, pos, ahead, back = [], [], [], [], [], [], []
        for i, x in enumerate(buffers(b.column(2))):
            h = words(x, ALNUM, lower=True)[2]
            row.append([i])
            nw.append(len(h))
            ks.append([-1])
            fps.append(np.array([i], dtype=np.int64))
            pos.append([0])
            ahead.append(None)
            back.append(None)
            for kk, w, name in levels:
                at, fp = _fingerprints(h, kk, w)
                slot = fp >> U(64 - _BITS)
                ok = np.flatnonzero((bitmap[slot >> U(6)] >> (slot & U(63))) & U(1))
                if len(ok):
                    at = at[ok]
                    a, c = _lists(h, at, kk, n - k if name == 0 else 0)
                    row.append([i] * len(at))
                    nw += [None] * len(at)
                    ks.append([name] * len(at))
                    fps.append(signed(fp[ok]))
                    pos.append(at)
                    ahead += a
                    back += c
        take = pa.array(np.concatenate(row) if row else [], pa.int32())
        flat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), pa.array(nw, pa.int64()), flat(ks, pa.int32()), flat(fps, pa.int64()),
             flat(pos, pa.int64()), pa.array(ahead, pa.list_(pa.int64())), pa.array(back, pa.list_(pa.int64()))],
            ["doc_id", "dig", "n_words", "k", "fp", "pos", "ahead", "back"],
        )


def _same(a: str, b: str) -> Column:
    """Length of the common prefix of two arrays."""
    eq = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(F.concat(eq, F.array(F.lit(False))), False) - 1).cast("long")


def text_digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, dig, n_words, n_hit, items (sorted
    array of item ids), spans (hit word ranges, end exclusive, may overlap)."""
    spark = docs.sparkSession
    ship(spark)
    k = max(1, n // 2)
    items = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    marks = items.mapInArrow(lambda bs: _item_rows(bs, n, k), _ITEM)
    # at most n - 1 lengths, and at most 2 ** 18 words of 64 bits
    short = sorted(r[0] for r in marks.filter("k > 0").select("k").distinct().collect())
    bits = (
        marks.select(F.shiftrightunsigned("fp", 64 - _BITS).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect()
    )
    bitmap = np.zeros(1 << (_BITS - 6), dtype=U)
    for r in bits:
        bitmap[r["word"]] = np.int64(r["bits"]).view(U)
    shared = spark.sparkContext.broadcast(bitmap)

    found = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("dig"), F.col(text_col).alias("text"))
        .mapInArrow(lambda bs: _doc_rows(bs, n, k, short, shared.value), _DOC)
        .withColumn("salt", F.pmod(F.xxhash64("dig", "pos"), F.lit(SALTS)).cast("int"))
    )
    places = (
        marks.groupBy("k", "fp", "ahead", "back").agg(F.collect_set("item_id").alias("items"))
        .withColumnsRenamed({"ahead": "i_ahead", "back": "i_back"})
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    pairs = (
        found.join(places, ["k", "fp", "salt"], "left")
        .withColumn("fwd", _same("ahead", "i_ahead")).withColumn("bwd", _same("back", "i_back"))
        .withColumn("ok", F.when(F.col("k") == 0, (F.col("fwd") >= k) & (F.col("fwd") + F.col("bwd") >= n)).otherwise((F.col("k") > 0) & (F.col("fwd") >= F.col("k"))))
        .filter("ok OR k = -1")
    )
    span = F.when(F.col("ok"), F.struct((F.col("pos") - F.col("bwd")).alias("a"), (F.col("pos") + F.col("fwd")).alias("b")))
    merged = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"),
        ),
    )
    return (
        pairs.groupBy("doc_id", "dig")
        .agg(F.max("n_words").alias("n_words"), F.sum((F.col("k") == -1).cast("int")).alias("rows"),
             F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("ok"), F.col("items"))).alias("sets"))
        .select("doc_id", "dig", F.explode(F.sequence(F.lit(1), "rows")).alias("copy"), "n_words", merged["n"].alias("n_hit"),
                F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"), F.array_sort("spans").alias("spans"))
        .drop("copy")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    hit = decontaminate(docs, items, n, id_col, text_col).filter("n_hit > 0").select("doc_id", "dig").distinct().alias("hit")
    rows = packed(docs, id=F.col(id_col).cast("long"), dig=text_digest(text_col)).alias("rows")
    return rows.join(hit, F.col("rows.id").eqNullSafe(F.col("hit.doc_id")) & (F.col("rows.dig") == F.col("hit.dig")), "left_anti").select("row.*")
