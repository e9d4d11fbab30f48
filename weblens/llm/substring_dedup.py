"""Substring dedup with a compressed FM-index per shard.

A window is ``n`` consecutive words of one document; a window whose words start
anywhere else too is removed, wherever it stands.

1. Anchors: each window's smallest k-gram (rightmost if tied) is its anchor.
   Equal windows have equal anchors, so only windows whose anchor occurs twice
   or more need a search. Anchors are counted in buckets by hash.
2. Windows in a row with one anchor form a segment, routed to a shard by the
   anchor. Equal segments are merged before they travel, with a list of where
   they stand. An anchor with over ``HOT`` occurrences routes each window
   alone, by the window's own hash, so one common passage meets many shards.
3. A shard indexes its segments: suffix order, Burrows-Wheeler transform, and a
   wavelet tree of bit vectors with rank counts. Segments stream against the
   index by backward search, all in step: each keeps the longest run of words
   that occurs at least twice (its matching statistics) and reports runs of
   ``n`` words or more. Only fixed-length comparisons of 64-bit word hashes are
   ever made; nothing is sampled.
4. Intervals go back to their text, the rest is joined and hashed.

Equal texts are one class throughout: a text that stands twice loses all its
words if it has a window, and is indexed once for the sake of others.

Defined results: null texts have no words; texts shorter than a window keep all
words; repeated rows are copies; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.textops import U, buffers, grams, mix, signed, words
from weblens.session import ship

WINDOW = 35
GRAM = 8
HOT = 2000
_SHARD_BYTES = 8 << 20
_FLUSH_WORDS = 1 << 20
_ANCHOR = np.dtype([("fp", "<u8"), ("dig", "V16")])


def anchors(h: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hashes, anchor place of every window)."""
    g = grams(h, k)
    w = n - k + 1
    if len(g) < w:
        return g, np.empty(0, dtype=np.int64)
    rev = np.lib.stride_tricks.sliding_window_view(g[::-1], w).argmin(axis=1)[::-1]
    return g, np.arange(len(rev)) + (w - 1) - rev


class FMIndex:
    """Backward search over a sequence of dense symbols (0 separates segments)."""

    def __init__(self, seq: np.ndarray, depth: int):
        n, sigma = len(seq), int(seq.max()) + 1
        sa = _suffix_order(seq, depth)
        bwt = seq[sa - 1]  # sa 0 wraps to the last symbol, a separator
        self.n = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))[:-1]])
        self.bits = max(1, (sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        cur = bwt
        for lvl in range(self.bits - 1, -1, -1):
            b = (cur >> lvl) & 1
            pad = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            pad[:n] = b
            w = np.packbits(pad, bitorder="little").view("<u8")
            self.words.append(w)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w).astype(np.int64))[:-1]]))
            z = int(n - b.sum())
            self.zeros.append(z)
            cur = np.concatenate([cur[b == 0], cur[b == 1]])
        self.origin = np.zeros(sigma, dtype=np.int64)
        self.origin = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Follow places ``i`` down the tree along the bits of symbols ``c``."""
        for lvl in range(self.bits):
            blk = i >> 6
            low = (U(1) << (i & 63).astype(U)) - U(1)
            ones = self.counts[lvl][blk] + np.bitwise_count(self.words[lvl][blk] & low)
            bit = (c >> (self.bits - 1 - lvl)) & 1
            i = np.where(bit == 1, self.zeros[lvl] + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the symbol followed by what the intervals stand for."""
        at = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.first[c] - self.origin[c]
        return at[:len(c)] + base, at[len(c):] + base


def _suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least."""
    n = len(seq)
    rank, h = seq.astype(np.int64), 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:n - h] = rank[h:] + 1 if h < n else 0
        key = rank * (max(int(rank.max()), n) + 2) + nxt
        sa = np.argsort(key, kind="stable")
        k = key[sa]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = new
        h *= 2
        if new[-1] == n - 1 or h > depth:
            return sa


def matching_runs(fm: FMIndex, seq: np.ndarray, at: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of all longest runs of ``n`` or more symbols that
    the index holds at least twice, for segments seq[at:at + size]."""
    who = np.flatnonzero(size >= n)
    e = size[who].copy()
    j = e.copy()
    lo, hi = np.zeros(len(who), dtype=np.int64), np.full(len(who), fm.n, dtype=np.int64)
    out = []
    while len(who):
        nlo, nhi = fm.extend(seq[at[who] + j - 1], lo, hi)
        ok = nhi - nlo >= 2
        lo, hi, j = np.where(ok, nlo, lo), np.where(ok, nhi, hi), np.where(ok, j - 1, j)
        stop = ~ok | (j == 0)
        if stop.any():
            rep = stop & (e - j >= n)
            out.append(np.stack([who[rep], j[rep], e[rep]]))
            # the next run must not hold the word that stopped this one
            e = np.where(stop, np.where(ok, 0, np.minimum(e - 1, j - 1 + n)), e)
            lo, hi, j = np.where(stop, 0, lo), np.where(stop, fm.n, hi), np.where(stop, e, j)
            go = e >= n
            who, e, j, lo, hi = who[go], e[go], j[go], lo[go], hi[go]
    return tuple(np.concatenate(out, axis=1)) if out else (np.empty(0, dtype=np.int64),) * 3


def _anchor_rows(batches: Iterator[pa.RecordBatch], n: int, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        e = np.concatenate(held)
        b = (e["fp"] % U(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        e, b = e[order], b[order]
        at = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(at[1:], len(e))
        return pa.RecordBatch.from_arrays([pa.array(b[at].astype(np.int32)), pa.array([e[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())], ["bucket", "block"])

    for b in batches:
        for dig, x in zip(b.column(0).to_pylist(), buffers(b.column(1))):
            if dig in seen:
                continue
            seen.add(dig)
            g, a = anchors(words(x)[2], n, k)
            if len(a) == 0:
                continue
            e = np.empty(len(p := np.unique(a)), dtype=_ANCHOR)
            e["fp"], e["dig"] = mix(g[p]), np.void(dig)
            held.append(e)
            size += len(p)
            if size > 1 << 20:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket, the anchors that stand twice or more, packed by text."""
    e = np.concatenate([np.frombuffer(x.as_buffer(), dtype=_ANCHOR) for x in table.column("block")])
    e = e[np.argsort(e["fp"], kind="stable")]
    at = np.flatnonzero(np.append(True, e["fp"][1:] != e["fp"][:-1])) if len(e) else np.empty(0, np.int64)
    run = np.diff(np.append(at, len(e)))
    times = np.repeat(run, run)
    e, times = e[times > 1], times[times > 1]
    dig = np.frombuffer(e["dig"].tobytes(), dtype=np.dtype([("a", "<u8"), ("b", "<u8")]))
    order = np.lexsort((e["fp"], dig["b"], dig["a"]))
    e, times, dig = e[order], times[order], dig[order]
    at = np.flatnonzero(np.append(True, (dig[1:] != dig[:-1]))) if len(e) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(e))
    # the lowest bit of a packed anchor tells that it is hot
    fp = (e["fp"] & ~U(1)) | (times > HOT).astype(U)
    return pa.table({"dig": pa.array([e["dig"][i].tobytes() for i in at], pa.binary()),
                     "fps": pa.array([np.unique(fp[i:j]).tobytes() for i, j in zip(at, ends)], pa.binary())})


def _segments(batches: Iterator[pa.RecordBatch], n: int, k: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Segments of windows with a repeated anchor, equal ones merged."""
    merged: dict[bytes, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v[0] for v in merged.values()], pa.int32()), pa.array(list(merged), pa.binary()), pa.array([b"".join(v[1]) for v in merged.values()], pa.binary())],
            ["shard", "body", "places"])

    for b in batches:
        for dig, x, packs in zip(b.column(0).to_pylist(), buffers(b.column(1)), b.column(2).to_pylist()):
            h = words(x)[2]
            g, a = anchors(h, n, k)
            known = np.unique(np.concatenate([np.frombuffer(p, dtype="<u8") for p in packs]))
            fp = mix(g[a])
            i = np.searchsorted(known, fp & ~U(1))
            i = np.minimum(i, len(known) - 1)
            found = known[i] & ~U(1) == fp & ~U(1)
            hot = found & ((known[i] & U(1) == 1) | (known[np.minimum(i + 1, len(known) - 1)] == (fp | U(1))))
            win = np.flatnonzero(found)
            if len(win) == 0:
                continue
            new = np.append(True, (np.diff(win) != 1) | (a[win[1:]] != a[win[:-1]]) | hot[win[1:]])
            first = win[new]
            last = win[np.append(np.flatnonzero(new)[1:] - 1, len(win) - 1)]
            for s, t in zip(first.tolist(), last.tolist()):
                body = h[s:t + n].tobytes()
                place = dig + s.to_bytes(4, "little")
                if body in merged:
                    merged[body][1].append(place)
                    size += 4
                else:
                    shard = int(grams(h[s:s + n], n)[0] % U(shards)) if hot[s] else int(fp[s] % U(shards))
                    merged[body] = [shard, [place]]
                    size += t + n - s
            if size > _FLUSH_WORDS:
                yield flush()
                merged, size = {}, 0
    if merged:
        yield flush()


def _search(table: pa.Table, n: int) -> pa.Table:
    """Repeated word ranges of a shard's segments, as (dig, a, b)."""
    merged: dict[bytes, list[bytes]] = {}
    for body, places in zip(table.column("body").to_pylist(), table.column("places").to_pylist()):
        merged.setdefault(body, []).append(places)
    bodies = [np.frombuffer(x, dtype=U) for x in merged]
    where = [np.frombuffer(b"".join(p), dtype=np.dtype([("dig", "V16"), ("at", "<u4")])) for p in merged.values()]
    size = np.array([len(x) for x in bodies], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    seq = np.zeros(int((size + 1).sum()), dtype=np.int64)
    _, ids = np.unique(np.concatenate(bodies), return_inverse=True)
    body = np.ones(len(seq), dtype=bool)
    body[at + size] = False
    seq[body] = ids + 1
    single = np.array([len(p) == 1 for p in where])
    twice = np.flatnonzero(~single)
    who, a, b = matching_runs(FMIndex(seq, 2 * n + 64), seq, at, np.where(single, size, 0), n)
    who, a, b = np.concatenate([twice, who]), np.concatenate([np.zeros(len(twice), np.int64), a]), np.concatenate([size[twice], b])
    reps = np.array([len(where[i]) for i in who], dtype=np.int64)
    hits = np.concatenate([where[i] for i in who]) if len(who) else np.empty(0, where[0].dtype)
    off = hits["at"].astype(np.int64)
    raw = hits["dig"].tobytes()
    return pa.table({"dig": pa.array([raw[i:i + 16] for i in range(0, len(raw), 16)], pa.binary()), "a": off + np.repeat(a, reps), "b": off + np.repeat(b, reps)})


def _kept(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, gone, sha, texts = [], [], [], []
        for x, copies, spans in zip(buffers(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
            ws = x.tobytes().split()
            removed = 0
            total.append(len(ws))
            if copies > 1 and len(ws) >= n:
                removed, ws = len(ws), []
            elif spans:
                mark = np.zeros(len(ws) + 1, dtype=np.int64)
                s = np.array([(p["a"], p["b"]) for p in spans], dtype=np.int64)
                np.add.at(mark, s[:, 0], 1)
                np.add.at(mark, s[:, 1], -1)
                hit = np.cumsum(mark)[:-1] > 0
                removed = int(hit.sum())
                ws = [w for w, out in zip(ws, hit.tolist()) if not out]
            gone.append(removed)
            kept = b" ".join(ws)
            texts.append(kept.decode("utf-8", "replace") if removed else None)
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())],
                                         ["dig", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and
    kept_text (null where nothing was removed: the text is then as it was)."""
    spark = docs.sparkSession
    ship(spark)
    k = min(GRAM, n)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.unhex(F.md5(text)).alias("dig"), text.alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _SHARD_BYTES + 1)
    repeated = (
        src.mapInArrow(lambda bs: _anchor_rows(bs, n, k, shards), "bucket int, block binary")
        .repartition(shards, "bucket").groupBy("bucket").applyInArrow(_repeated, "dig binary, fps binary")
        .groupBy("dig").agg(F.collect_list("fps").alias("packs"))
    )
    # the filter, always true, is what the inner join below would add to its side alone
    texts = src.filter(F.col("dig").isNotNull()).groupBy("dig").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    found = (
        # `copies` comes along unused, so that both joins share one exchange of the texts
        texts.join(repeated, "dig").select("dig", "text", "packs", "copies")
        .mapInArrow(lambda bs: _segments(bs, n, k, shards), "shard int, body binary, places binary")
        .repartition(shards, "shard").groupBy("shard").applyInArrow(lambda t: _search(t, n), "dig binary, a long, b long")
        .groupBy("dig").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    done = texts.join(found, "dig", "left").select("dig", "text", "copies", "spans").mapInArrow(
        lambda bs: _kept(bs, n), "dig binary, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("dig")).join(done, "dig").drop("dig")
