"""Phrase collocations per language: mergeable Misra-Gries summaries, then exact counts.

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, and
these at spaces and tabs into words. A phrase is 2 to 4 words in a row within a
piece; it is frequent from ``MIN_COUNT`` occurrences in its language on.

First passes (pairs of words, then the longer phrases all of whose pairs may be
frequent): tasks count 64-bit phrase hashes and deal them to hash partitions.
Each partition merges these counts, block by block, into one Misra-Gries
summary whose capacity exceeds the partition's mass divided by ``MIN_COUNT``:
what all its cuts take off together is then below ``MIN_COUNT``, so a frequent
phrase never loses its counter. Hashes are only candidates: two phrases that
share one are counted together here, which can add a candidate and lose none.

Second pass: the surviving hashes, as a filter sized by their number up to
``FILTER_BYTES``, pick the phrases of the texts again, and Spark adds up their
occurrences by language and words themselves. What the filter lets through by
chance falls to the exact count. Beyond that size the filter only lets more
through.

Splits, scores and the removal of phrases inside longer ones are joins over
frequent phrases only. Arithmetic is on decimals of 38 digits.

Defined results: a null text is empty, a null language is ``und``; a text of any
length is read whole, in slices cut between pieces (working memory is bounded
by a slice or the longest piece); equal scores and counts rank by the phrase's
bytes; repeated rows count each time; an empty table gives no rows.

Ranks come from one sort of all languages by ranges, so a language that holds
most phrases is ranked by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.textops import buffers, mix
from weblens.session import cut, ship

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
COVERED = 80  # percent of a phrase's occurrences inside one longer phrase
#: Bytes of a task's slice of text, hash counts held before they are sent, and
#: counts merged into a summary at a time.
SLICE = 3 << 19
HELD = 1 << 20
MERGED = 1 << 20
#: Bytes of text for each hash partition.
PARTITION_BYTES = 24 << 20
#: Largest filter that goes to every task.
FILTER_BYTES = 64 << 20

U = np.uint64
_SEED = U(0xD6E8FEB86659FD93)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words:
    """The words of some texts: ``code`` (index into ``vocab``), ``piece`` and
    ``lang`` (index into ``langs``) of each, in order."""

    def __init__(self, code: np.ndarray, vocab: list[bytes], piece: np.ndarray, lang: np.ndarray, langs: list[str]):
        self.code, self.vocab, self.piece, self.lang, self.langs = code, vocab, piece, lang, langs

    def whole(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each place on lie in one piece."""
        n = len(self.code) - k + 1
        return self.piece[:n] == self.piece[k - 1:] if n > 0 else np.zeros(0, dtype=bool)


def _words(data: np.ndarray, row: np.ndarray, lang_of_row: np.ndarray, langs: list[str]) -> Words:
    m = np.zeros(len(data) + 2, dtype=np.int8)
    m[1:-1] = _WORD[data]
    d = np.diff(m)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    # the words' bytes side by side are a binary column, whose dictionary is exact
    body = _LOWER[data[m[1:-1].astype(bool)]]
    offs = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offs[1:])
    col = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(body)]).dictionary_encode()
    breaks = np.flatnonzero(_BREAK[data])
    return Words(col.indices.to_numpy(zero_copy_only=False), col.dictionary.to_pylist(), np.searchsorted(breaks, starts),
                 lang_of_row[row[starts]] if len(starts) else np.zeros(0, dtype=np.int32), langs)


def _end(t: np.ndarray) -> int:
    """Where a slice of a text ends: at the first break from ``SLICE`` on."""
    at = SLICE
    while at < len(t):
        breaks = _BREAK[t[at:at + SLICE]]
        if breaks.any():
            return at + int(breaks.argmax())
        at += SLICE
    return len(t)


def _slices(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of a batch (text, lang), some texts at a time; a long text is
    cut behind the end of a piece."""
    lang = batch.column(1).fill_null("und").dictionary_encode()
    langs, code = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    parts: list[np.ndarray] = []
    rows: list[int] = []
    size = 0
    line = np.frombuffer(b"\n", dtype=np.uint8)

    def flush() -> Words:
        data = np.concatenate(parts)
        row = np.repeat(np.array(rows), [len(p) for p in parts])
        return _words(data, row, code, langs)

    for i, t in enumerate(buffers(batch.column(0))):
        while len(t):
            piece = t[:_end(t)]
            t = t[len(piece):]
            parts += [piece, line]
            rows += [i, i]
            size += len(piece) + 1
            if size >= SLICE:
                yield flush()
                parts, rows, size = [], [], 0
    if parts:
        yield flush()


class Hashes:
    """64-bit hashes of words and languages, made once for each different one."""

    def __init__(self, bound: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def _of(self, s: bytes) -> int:
        h = self.known.get(s)
        if h is None:
            if len(self.known) >= self.bound:
                self.known.clear()
            h = self.known[s] = int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little")
        return h

    def phrases(self, w: Words, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hash of the ``k`` words from each place on, whether they lie in one piece)."""
        word = np.array([self._of(v) for v in w.vocab], dtype=U)[w.code] if w.vocab else np.zeros(0, dtype=U)
        lang = np.array([self._of(s.encode() + b" ") for s in w.langs], dtype=U)[w.lang] if len(w.lang) else np.zeros(0, dtype=U)
        g = lang.copy()
        for k in range(1, sizes.stop):
            n = len(word) - k + 1
            if n <= 0:
                return
            g = mix(g[:n] * _SEED + word[k - 1:])
            if k in sizes:
                yield k, g, w.whole(k)


class Filter:
    """Which hashes may be among the survivors: a bitmap of which every hash
    partition owns a stretch, two bits a hash."""

    def __init__(self, bits: np.ndarray, buckets: int):
        self.bits, self.buckets = bits, buckets
        self.stretch = len(bits) * 8 // buckets if buckets else 0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not self.stretch or not len(h):
            return np.zeros(len(h), dtype=bool)
        a, b = _slots(h, self.buckets, self.stretch)
        return ((self.bits[a >> U(3)] >> (a & U(7)).astype(np.uint8)) & (self.bits[b >> U(3)] >> (b & U(7)).astype(np.uint8)) & 1).astype(bool)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets)) >> U(32)


def _slots(h: np.ndarray, buckets: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    base = _bucket(h, buckets) * U(stretch)
    other = mix(h)
    return base + (other & U(0xFFFFFFFF)) % U(stretch), base + (other >> U(32)) % U(stretch)


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their counts added up."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Summary:
    """Misra-Gries summary: at most ``capacity`` counters; merging adds counts
    and takes the (capacity + 1)-th largest off all. A key's true count lies
    between its counter and its counter plus ``taken``."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        self.keys, self.counts = _add([(self.keys, self.counts), (keys, counts)])
        self.taken += taken
        over = len(self.keys) - self.capacity
        if over > 0:
            c = int(np.partition(self.counts, over - 1)[over - 1])  # the (capacity + 1)-th largest
            self.taken += c
            live = self.counts > c
            self.keys, self.counts = self.keys[live], self.counts[live] - c


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, sizes: range, known: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, counts) blocks of a task's phrase counts."""
    hashes = Hashes()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def send() -> pa.RecordBatch:
        keys, counts = _add(held)
        cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1, dtype=U))
        some = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.array([keys[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary()),
            pa.array([counts[cuts[i]:cuts[i + 1]].astype(np.int32).tobytes() for i in some], pa.binary()),
        ], ["bucket", "keys", "counts"])

    for b in batches:
        for w in _slices(b):
            pair = None
            for k, g, ok in hashes.phrases(w, range(2, sizes.stop)):
                if known is not None:
                    if k == 2:
                        pair = known.value(g) & ok
                        continue
                    # every pair inside may be frequent
                    ok = ok & np.logical_and.reduce([pair[j:j + len(g)] for j in range(k - 1)])
                g = g[ok]
                if k in sizes and len(g):
                    g.sort()
                    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                    held.append((g[first], np.diff(np.r_[first, len(g)]).astype(np.int64)))
                    size += len(first)
            if size >= HELD:
                held = [_add(held)]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield send()
                    held, size = [], 0
    if size:
        yield send()


def _summarise(table: pa.Table, min_count: int) -> pa.Table:
    """One hash partition: the keys that may be frequent."""
    counts = [np.frombuffer(c.as_py(), dtype=np.int32) for c in table.column("counts")]
    mass = sum(int(c.sum(dtype=np.int64)) for c in counts)
    s = Summary(mass // min_count + 1)
    part, size = [], 0
    for i, c in enumerate(counts):
        part.append((np.frombuffer(table.column("keys")[i].as_py(), dtype=U), c.astype(np.int64)))
        size += len(c)
        if size >= MERGED or i == len(counts) - 1:
            s.merge(*_add(part))
            part, size = [], 0
    live = s.keys[s.counts + s.taken >= min_count]
    return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "keys": pa.array([live.tobytes()], pa.binary()), "n": pa.array([len(live)], pa.int64())})


def _survivors(docs: DataFrame, buckets: int, sizes: range, known: Broadcast | None, min_count: int) -> DataFrame:
    """bucket, keys, n: hashes of phrases of these sizes that may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(batches, buckets, sizes, known)

    def summarise(table: pa.Table) -> pa.Table:
        return _summarise(table, min_count)

    blocks = docs.mapInArrow(run, "bucket int, keys binary, counts binary")
    return cut(blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(summarise, "bucket int, keys binary, n long"), "collocation-keys")


def _filter(found: DataFrame, buckets: int) -> Filter:
    """The survivors as a bitmap; every partition makes its own stretch, so
    what the driver puts together is the filter, not the hashes."""
    n = found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    if not n:
        return Filter(np.zeros(0, dtype=np.uint8), 0)
    stretch = min(16 * n, FILTER_BYTES * 8 // buckets) // 8 * 8 + 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b.column(1)[i].as_py(), dtype=U)
                own = np.zeros(stretch, dtype=np.uint8)
                base = U(b.column(0)[i].as_py() * stretch)
                for s in _slots(h, buckets, stretch):
                    own[s - base] = 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

    bits = np.zeros(stretch * buckets // 8, dtype=np.uint8)
    for r in found.select("bucket", "keys").mapInArrow(run, "bucket int, bits binary").toLocalIterator():
        at = r.bucket * stretch // 8
        bits[at:at + stretch // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return Filter(bits, buckets)


def _tuples(w: Words, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different phrase, its count) among the ``k``-word
    phrases at these places, by language and words, not by hash."""
    key = w.lang[at].astype(np.int64)
    for j in range(k):
        key = key * len(w.vocab) + w.code[at + j]
        if j < k - 1:  # numbered anew, so that the next product fits
            key = np.unique(key, return_inverse=True)[1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


def _count(batches: Iterator[pa.RecordBatch], pairs: Broadcast, longer: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lang, k, phrase, n) of the words and surviving phrases of each slice."""
    hashes = Hashes()
    for b in batches:
        for w in _slices(b):
            out = ([], [], [], [])
            vocab = w.vocab

            def put(k: int, at: np.ndarray) -> None:
                first, n = _tuples(w, at, k)
                out[0].extend([w.langs[i] for i in w.lang[first].tolist()])
                out[1].extend([k] * len(first))
                cols = [w.code[first + j].tolist() for j in range(k)]
                out[2].extend([b" ".join([vocab[c] for c in cs]) for cs in zip(*cols)])
                out[3].extend(n.tolist())

            if len(w.code):
                put(1, np.arange(len(w.code)))
            for k, g, ok in hashes.phrases(w, range(2, MAX_WORDS + 1)):
                at = np.flatnonzero(ok & (pairs if k == 2 else longer).value(g))
                if len(at):
                    put(k, at)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(out[3], pa.int64())],
                                             ["lang", "k", "phrase", "n"])


def frequent(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, k, phrase, n: exact counts of all phrases of 2 to 4 words with at
    least ``min_count`` occurrences, of all words as often (k = 1), and of all
    words together (k = 0, empty phrase)."""
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    buckets = max(2 * sc.defaultParallelism, -(-size // PARTITION_BYTES))
    sent = [sc.broadcast(_filter(_survivors(docs, buckets, range(2, 3), None, min_count), buckets))]
    sent.append(sc.broadcast(_filter(_survivors(docs, buckets, range(3, MAX_WORDS + 1), sent[0], min_count), buckets)))
    pairs, longer = sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count(batches, pairs, longer)

    counts = docs.mapInArrow(run, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    # words below the bound are in no frequent phrase; they stay in their language's total
    rare = (F.col("k") == 1) & (F.col("n") < min_count)
    total = F.array(F.struct("k", "phrase", "n"), F.struct(F.lit(0).alias("k"), F.lit("").alias("phrase"), F.col("n").alias("n")))
    rows = F.when(rare, F.slice(total, 2, 1)).when(F.col("k") == 1, total).when(F.col("n") >= min_count, F.slice(total, 1, 1))
    out = cut(counts.select("lang", F.inline(rows)).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")), "collocation-counts")
    for b in sent:
        b.destroy()
    return out


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, from 1 within their language. Languages are dealt
    by ranges of the whole order, so one may lie in many tasks: a row's rank is its
    place in its range plus the rows of its language in the ranges before."""
    dealt = cut(
        cut(rows, "collocation-scores").orderBy(F.asc("lang"), *order)
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "collocation-order")
    parts = dealt.groupBy("lang", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("lang", "part", "start", before.alias("before"))
    return dealt.join(parts, ["lang", "part"]).withColumn("rank", F.col("at") - F.col("start") + F.col("before") + 1).drop("at", "part", "start", "before")


def mine(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language."""
    f = frequent(docs, min_count)
    w = F.split("phrase", " ")
    cand = f.filter("k >= 2").select("lang", "phrase", F.col("n").alias("a"), "k", w.alias("w"))
    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("c")).select(
        "lang", "phrase", "a", "c", F.array_join(F.expr("slice(w, 1, c)"), " ").alias("head"), F.array_join(F.expr("slice(w, c + 1, size(w) - c)"), " ").alias("tail"))
    part = f.filter("k >= 1 AND k < 4").select("lang", "phrase", "n")
    scored = (
        cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
        .join(part.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
        .withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(30, 0))) DIV (CAST(l AS DECIMAL(30, 0)) + CAST(r AS DECIMAL(30, 0)))"))
        .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "c", "l", "r")).alias("m"))
        .select("lang", "phrase", "a", "m.score", "m.l", "m.r")
    )
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    around = cand.filter("k >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = scored.join(around, ["lang", "phrase"], "left").filter(
        F.expr(f"most IS NULL OR CAST(100 AS DECIMAL(3, 0)) * CAST(most AS DECIMAL(30, 0)) < CAST({COVERED} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(30, 0))"))
    best = _ranked(left.select("lang", "phrase", "a", "score", "l", "r"), [F.desc("score"), F.desc("a"), F.asc("phrase")]).filter(F.col("rank") <= top)
    n = f.filter("k = 0").select("lang", "n")
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
