"""Exact dedup by a tree merge of sorted digest runs.

Each row is reduced to its digest (SHA-256, byte length and a second,
independent 64-bit hash, all of which must agree) and dealt to one of
``fanout ** rounds`` slots, as many rounds as the number of rows asks for. A slot's rows form a run: one entry per digest with
the best id and the number of rows. In round r, runs whose slot numbers differ
in digit r only exchange entries: an entry goes to the run whose digit r is the
digest's own. Entries that meet are merged at every level, so ``n`` copies
spread over all runs shrink by the fan-in in each round and no task ever holds
more than a slot's share of them. After the last round the slot is decided by
the digest alone and holds one entry for it. The answers then go back along the
same path, level by level, to the rows.

Defined results: a null text counts as empty; the row with the largest id
stays, null ids rank below all others, and of rows that tie (same text and id)
exactly one stays; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.session import cut, packed

KEY = ["sha", "n_bytes", "chk"]
#: Rows of a slot, at most, when the digests are spread evenly.
SLOT_ROWS = 2_000_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, n_bytes, chk) of every row; the text is not carried on."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("sha"),
        F.octet_length(t).alias("n_bytes"), F.xxhash64(t).alias("chk"),
    )


def rounds_for(rows: int, fanout_bits: int = 3) -> int:
    """Rounds after which a slot holds at most ``SLOT_ROWS`` of evenly spread rows; two at least."""
    rounds = 2
    while rows > SLOT_ROWS << (fanout_bits * rounds):
        rounds += 1
    return rounds


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fanout_bits: int = 3, rounds: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, sha, n_bytes, chk."""
    base = cut(digests(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "digests")
    if rounds is None:
        rounds = rounds_for(base.count(), fanout_bits)
    fan, slots = 1 << fanout_bits, 1 << (fanout_bits * rounds)
    base = base.withColumn("slot0", F.pmod(F.xxhash64("rid"), F.lit(slots)).cast("int"))
    best = F.max(F.struct("doc_id", "rid")).alias("best")
    levels = [base.groupBy("slot0", *KEY).agg(best, F.count("*").alias("n"))]
    for r in range(rounds):
        here, there, unit = f"slot{r}", f"slot{r + 1}", fan ** r
        own = F.floor(F.col(here) / unit) % fan
        digit = F.shiftrightunsigned("chk", r * fanout_bits).bitwiseAND(F.lit(fan - 1).cast("long"))
        levels[r] = levels[r].withColumn(there, (F.col(here) - own * unit + digit * unit).cast("int"))
        levels.append(
            levels[r].select(there, *KEY, "best", "n")
            .repartition(slots, there).sortWithinPartitions(there, *KEY)
            .groupBy(there, *KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        )
    found = levels[rounds].select(f"slot{rounds}", *KEY, "best", "n")
    for r in range(rounds - 1, -1, -1):
        found = levels[r].select(f"slot{r}", f"slot{r + 1}", *KEY).join(found, [f"slot{r + 1}", *KEY]).drop(f"slot{r + 1}")
    return base.join(found, ["slot0", *KEY]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"), *KEY,
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are matched to their decision by id and digest, in one join. Rows that
    repeat both are copies too: one of them stays."""
    kept = (
        exact_groups(docs, id_col, text_col).groupBy("doc_id", *KEY)
        .agg(F.max("kept").alias("kept"), F.count("*").alias("twins")).filter("kept").alias("kept")
    )
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = packed(docs, id=F.col(id_col).cast("long"), sha=F.unhex(F.sha2(t, 256)), n_bytes=F.octet_length(t), chk=F.xxhash64(t)).alias("rows")
    same = F.col("rows.id").eqNullSafe(F.col("kept.doc_id"))
    for c in KEY:
        same = same & (F.col(f"rows.{c}") == F.col(f"kept.{c}"))
    found = rows.join(kept, same).select("row", "rows.id", *[f"rows.{c}" for c in KEY], "twins")
    # only rows with twins are told apart, by their number within the pair
    nth = F.row_number().over(Window.partitionBy("id", *KEY).orderBy("twins"))
    return found.withColumn("nth", F.when(F.col("twins") > 1, nth).otherwise(1)).filter("nth = 1").select("row.*")
