"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the rows by seeded hashes: the id alone decides the shard
(highest of one hash per shard, so that one more shard takes rows only into
itself), and a hash of id and text decides the bucket inside the shard. Buckets
are as many as the shard's rows and bytes ask for, so one bucket fits a task,
whatever the total. Pass two runs a Fisher-Yates shuffle over each bucket, whose
draws are hashes of seed, shard, bucket and step, and numbers it after the buckets
before it; the numbers of a shard are gapless from 0. So seed and rows alone
decide every slot, however the rows are partitioned.

Defined results: a null text has size 1 and the checksum of the empty text; all
null ids are one id and share a shard; rows that repeat id and text each get a
slot (they share a bucket, and which of them gets which slot is open); an empty
table gives an empty result; other columns are not read (``write_shards`` keeps
them all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.session import cut, packed

SEED = 20240607


def shard_of(key: Column, n: int, seed: int = SEED) -> Column:
    """The shard in 0..n-1 whose hash with the key is the highest."""
    if n == 1:
        return F.lit(0)
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(n)])["s"]


def fisher_yates(arr: Column, *seeds: Column) -> Column:
    """The array after a Fisher-Yates shuffle: from the last place down to the
    second, each is swapped with a drawn place at or before it. Places count from 0."""
    def swap(acc: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        moved = F.concat(F.slice(acc, 1, j), F.slice(acc, i + 1, 1), F.slice(acc, j + 2, i - j - 1), F.slice(acc, j + 1, 1), F.slice(acc, i + 2, F.size(acc)))
        return F.when(i == j, acc).otherwise(moved)

    return F.when(F.size(arr) > 1, F.aggregate(F.sequence(F.size(arr) - 1, F.lit(1), F.lit(-1)), arr, swap)).otherwise(arr)


def _slots(rows: DataFrame, payload: list[str], n_shards: int, rows_per_bucket: int, bucket_bytes: int, seed: int) -> DataFrame:
    """rows: (shard, rid, size, *payload), read from files. Adds ``slot``."""
    per = {r["shard"]: max(1, -(-r["n"] // rows_per_bucket), -(-r["b"] // bucket_bytes))
           for r in rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}  # one row a shard
    buckets = F.element_at(F.array(*[F.lit(per.get(s, 1)) for s in range(n_shards)]), F.col("shard") + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "rid"), buckets).cast("int"))
    before = (
        rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    )
    taken = [c for c in payload if c != "size"]
    return (
        rows.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct("rid", "size", *taken))).alias("rows"))
        .select("shard", "bucket", fisher_yates(F.col("rows"), F.lit(seed + 2), F.col("shard"), F.col("bucket")).alias("rows"))
        .join(before, ["shard", "bucket"])
        .select("shard", "first", F.posexplode("rows").alias("at", "row"))
        .select("shard", (F.col("first") + F.col("at")).alias("slot"), "row.*")
    )


def _row_key(id_col: str, text: Column, seed: int) -> Column:
    """What a row is scattered and ordered by: id and text, not where it stands."""
    return F.struct(F.xxhash64(F.lit(seed + 3), F.col(id_col), text).alias("a"), F.xxhash64(F.lit(seed + 4), text, F.col(id_col)).alias("b"))


def assign(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 1024,
           seed: int = SEED) -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    The text is read for its size and checksum and does not enter the shuffle."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    slim = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"), shard_of(F.col(id_col), n_shards, seed).alias("shard"),
            shard_of(F.col(id_col), n_shards + 1, seed).alias("grown_shard"), _row_key(id_col, t, seed).alias("rid"),
        ),
        "shards",
    )
    # no texts here: a bucket's bytes are those of its few columns
    return _slots(slim, ["doc_id", "text_crc32", "grown_shard"], n_shards, rows_per_bucket, 1 << 62, seed).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 1024,
                 bucket_bytes: int = 64 << 20, seed: int = SEED) -> None:
    """Write whole records, shuffled, to ``path/shard=<n>/``; ``slot`` is the order.

    Buckets here hold whole records: one holds ``bucket_bytes`` of text on average."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = packed(docs, shard=shard_of(F.col(id_col), n_shards, seed), rid=_row_key(id_col, t, seed), size=(F.octet_length(t) + 1).cast("long"))
    rows = cut(rows.withColumnRenamed("row", "rec"), "records")
    out = _slots(rows, ["rec"], n_shards, rows_per_bucket, bucket_bytes, seed)
    out.select("shard", "slot", F.col("rec")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
