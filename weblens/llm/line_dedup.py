"""Line dedup within one edit, by a join of deletion neighbourhoods.

A line is its sequence of words; the edit distance counts words. A line goes if
an earlier line (by document id, then line number) has the same words, or words
within ``1`` insertion, deletion or substitution; lines of fewer than
``MIN_WORDS`` words must be the same. Whether the earlier line itself stays does
not matter, so the result does not depend on the order of work.

1. One pass over the texts gives a row per line (its hash and place) and, packed
   by bucket, the hashes of its halves: one edit leaves the first or the last
   ``h`` words of both lines alone, h being half of the shorter one.
2. A bucket marks the halves that several different lines have, in bitmaps of
   fixed size; all others, nearly all, end here. A false mark costs work and
   changes no result.
3. For marked halves, the rest of the line travels to the task of its half. There
   all deletion variants of the rests are hashed, equal variants are joined,
   and each line is compared with the earliest partner on a variant: equal
   positions of the deleted word mean a substitution, a deletion that equals a
   whole rest means an insertion. The distance is verified on the words before
   a line is given up. The earliest place of every line is among those sent,
   whatever order a task reads in; equal ids and line numbers are ordered by
   digest. Every step is linear in the words of the group. A half
   with over ``HOT`` lines is spread by variant.
4. Decisions go back to the lines' places; texts that lose lines meet them by
   digest, the others never travel.

Equal texts are one class: its smallest id decides for itself, in the others
every line with words has an earlier one.

Defined results: null texts are empty; lines without words always stay; null
ids come after all others; rows that repeat both id and text are one document
and get the same result; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.joins import spread_join
from weblens.llm.textops import U, buffers, mix, words
from weblens.session import cut, ship

MIN_WORDS = 5
HOT = 5000
_P = 0xC2B2AE3D27D4EB4F
_PI = pow(_P, -1, 1 << 64)
_LAST = (1 << 63) - 1
_pw = [np.ones(1, dtype=U), np.ones(1, dtype=U)]

_BITS = 25
_BLOCK_BYTES = 8 << 20
_LINE = "dig binary, doc long, line_no int, n int, id long, chk int, bucket int, block binary"
_HALF = np.dtype([("key", "<u8"), ("id", "<u8"), ("text", "<u8")])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pw[0]) <= n:
        for i, base in enumerate((_P, _PI)):
            a = np.full(2 * n + 64, base, dtype=U)
            a[0] = 1
            _pw[i] = np.cumprod(a, dtype=U)
    return _pw[0], _pw[1]


def sums(h: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any run of words follows."""
    c = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * _powers(len(h))[0][:len(h)], out=c[1:])
    return c


def lines_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each line that has words, its number)."""
    starts, _, h = words(x)
    breaks = np.flatnonzero(x == 0x0A)
    line = np.searchsorted(breaks, starts)
    at = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.empty(0, np.int64)
    return h, at, line[at] if len(at) else at


def line_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ends, ids, second hashes) of lines given by their first words, and the
    halves that each may meet others on: keys and sides, side 2 * h for the
    first and 2 * h + 1 for the last h words, as far as ``use`` says."""
    end = np.append(at[1:], len(h))
    s = end - at
    c, (_, inv) = sums(h), _powers(len(h))

    def run(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix((c[z] - c[a]) * inv[a] + (z - a).astype(U))

    # unlike the running sums, no pattern of words cancels out in this one
    place = (np.arange(len(h)) - np.repeat(at, s)).astype(U)
    chk = mix(np.add.reduceat(mix(h ^ mix(place * U(0x5851F42D4C957F2D) + U(1))), at))
    # lines of n and n + 1 words meet on n // 2
    half, other = s // 2, (s - 1) // 2
    keys = np.stack([run(at, at + half) ^ half.astype(U), mix(run(end - half, end) ^ half.astype(U)),
                     run(at, at + other) ^ other.astype(U), mix(run(end - other, end) ^ other.astype(U))], axis=1)
    sides = np.stack([2 * half, 2 * half + 1, 2 * other, 2 * other + 1], axis=1)
    use = np.ones(keys.shape, dtype=bool)
    use[:, 2:] = (half != other)[:, None]
    use[s < MIN_WORDS] = False
    return end, run(at, end), (chk & U(0x7FFFFFFF)).astype(np.int32), keys, sides, use


def _places(doc: int, dig: bytes, line: np.ndarray) -> list[int]:
    """Places of lines as numbers, in the order of (doc, line number, digest)."""
    base = ((doc + _LAST + 1) << 96) + int.from_bytes(dig[:8], "big")
    return [base + (n << 64) for n in line.tolist()]


def _sooner(known: dict, key, place: int) -> bool:
    """Whether a place comes before the known one; if so, it is known from now on."""
    if key in known and known[key] <= place:
        return False
    known[key] = place
    return True


def _line_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row per line with words, texts once a task (again when a smaller id
    turns up), and packed by bucket the halves of lines, from every text that
    holds a line at an earlier place than all texts of the task before it."""
    names = ["dig", "doc", "line_no", "n", "id", "chk", "bucket", "block"]
    seen: dict[bytes, int] = {}
    known: dict[int, int] = {}
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        e = np.concatenate(held)
        b = e["key"] % U(buckets)
        order = np.argsort(b, kind="stable")
        e, b = e[order], b[order].astype(np.int64)
        cut_at = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(cut_at[1:], len(e))
        m = len(cut_at)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.int32())] * 2, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()),
             pa.array(b[cut_at].astype(np.int32)), pa.array([e[i:j].tobytes() for i, j in zip(cut_at, ends)], pa.binary())], names)

    for b in batches:
        text, no, n, ids, chk = [], [], [], [], []
        docs, digs, texts = b.column(1).to_pylist(), b.column(0).to_pylist(), list(buffers(b.column(2)))
        for i in np.argsort(np.asarray(b.column(1)), kind="stable").tolist():
            dig, x = digs[i], texts[i]
            if seen.get(dig, _LAST + 1) <= docs[i]:
                continue
            seen[dig] = docs[i]
            h, at, line = lines_of(x)
            if len(at) == 0:
                continue
            end, lid, lchk, keys, _, use = line_hashes(h, at)
            text.append(np.full(len(at), i))
            no.append(line)
            n.append(end - at)
            ids.append(lid)
            chk.append(lchk)
            use &= np.array([_sooner(known, v, p) for v, p in zip(lid.tolist(), _places(docs[i], dig, line))])[:, None]
            e = np.empty(int(use.sum()), dtype=_HALF)
            e["key"], e["id"], e["text"] = keys[use], np.repeat(lid, use.sum(axis=1)), int.from_bytes(dig[:8], "little")
            held.append(e)
            size += len(e)
            if size > 1 << 20:
                yield packed()
                held, size = [], 0
        join = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.empty(0, t)
        take = pa.array(join(text, np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), pa.array(join(no, np.int32)), pa.array(join(n, np.int32)), pa.array(join(ids, U).view(np.int64)),
             pa.array(join(chk, np.int32)), pa.nulls(len(take), pa.int32()), pa.nulls(len(take), pa.binary())], names)
    if size:
        yield packed()


LIVE, HOT_HALF, TEXT = 0, 1, 2


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket, the halves of several different lines, as bits of three
    bitmaps: shared halves, those with over ``HOT`` lines, and their texts."""
    e = np.concatenate([np.frombuffer(x.as_buffer(), dtype=_HALF) for x in table.column("block")])
    e = e[np.lexsort((e["id"], e["key"]))]
    key = e["key"]
    new_key = np.append(True, key[1:] != key[:-1])
    new_id = new_key | np.append(True, e["id"][1:] != e["id"][:-1])
    at = np.flatnonzero(new_key)
    lines = np.add.reduceat(new_id.astype(np.int64), at)
    many = np.repeat(lines > 1, np.diff(np.append(at, len(e))))
    kinds, out_words, out_bits = [], [], []
    for kind, values in ((LIVE, key[at][lines > 1]), (HOT_HALF, key[at][lines > HOT]), (TEXT, e["text"][many])):
        slot = values >> U(64 - _BITS)
        word, inv = np.unique(slot >> U(6), return_inverse=True)
        bits = np.zeros(len(word), dtype=U)
        np.bitwise_or.at(bits, inv, U(1) << (slot & U(63)))
        kinds.append(np.full(len(word), kind, dtype=np.int32))
        out_words.append(word.astype(np.int64))
        out_bits.append(bits)
    return pa.table({"kind": np.concatenate(kinds), "word": np.concatenate(out_words), "bits": np.concatenate(out_bits).view(np.int64)})


def _has(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values >> U(64 - _BITS)
    return ((bitmap[slot >> U(6)] >> (slot & U(63))) & U(1)).astype(bool)


def variants(h: np.ndarray) -> np.ndarray:
    """Hashes of a sequence without its word 0, 1, ..., and of the whole of it."""
    n = len(h)
    c, (_, inv) = sums(h), _powers(n)
    i = np.arange(n)
    out = np.empty(n + 1, dtype=U)
    out[:n] = c[i] + (c[n] - c[i + 1]) * inv[1] + U(n - 1)
    out[n] = c[n] + U(n)
    return mix(out)


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences differ by one edit at most."""
    if len(a) == len(b):
        return int((a != b).sum()) <= 1
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    pre = int(np.append(a != b[:n], True).argmax())
    post = int(np.append((a != b[1:])[::-1], True).argmax())
    return pre + post >= n


def _rests(batches: Iterator[pa.RecordBatch], maps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each line and marked half: the rest of the line, sent to the group of
    the half; of a hot half, to one group per variant. A line is sent again when
    the task meets it at an earlier place, at most once a batch."""
    sent: dict[tuple[int, int], int] = {}
    for b in batches:
        b = b.take(pa.array(np.argsort(np.asarray(b.column(1)), kind="stable")))
        group, ids, chk, doc, no, tie, rest = [], [], [], [], [], [], []
        docs, digs = b.column(1).to_pylist(), b.column(0).to_pylist()
        heads = np.array([int.from_bytes(d[:8], "little") for d in digs], dtype=U)
        wanted = np.flatnonzero(_has(maps[TEXT], heads)) if len(heads) else []
        for i, x in zip(wanted, buffers(b.column(2).take(pa.array(wanted)))):
            h, at, line = lines_of(x)
            if len(at) == 0:
                continue
            end, lid, lchk, keys, sides, use = line_hashes(h, at)
            use &= _has(maps[LIVE], keys.ravel()).reshape(keys.shape)
            place, head = _places(docs[i], digs[i], line), int.from_bytes(digs[i][:8], "big", signed=True)
            for r, k in zip(*np.nonzero(use)):
                key, side = keys[r, k], int(sides[r, k])
                if not _sooner(sent, (int(lid[r]), int(key)), place[r]):  # the task has sent this line from an earlier place
                    continue
                s, m = h[at[r]:end[r]], side // 2
                q = s[m:] if side % 2 == 0 else s[:len(s) - m]
                g = [int(keys[r:r + 1, k].view(np.int64)[0])]
                if _has(maps[HOT_HALF], keys[r:r + 1, k])[0]:
                    g = mix(variants(q) ^ mix(keys[r:r + 1, k] + U(1))).view(np.int64).tolist()
                group += g
                ids += [int(lid[r:r + 1].view(np.int64)[0])] * len(g)
                chk += [int(lchk[r])] * len(g)
                doc += [docs[i]] * len(g)
                no += [int(line[r])] * len(g)
                tie += [head] * len(g)
                rest += [q.tobytes()] * len(g)
        yield pa.RecordBatch.from_arrays(
            [pa.array(group, pa.int64()), pa.array(ids, pa.int64()), pa.array(chk, pa.int32()), pa.array(doc, pa.int64()), pa.array(no, pa.int32()),
             pa.array(tie, pa.int64()), pa.array(rest, pa.binary())],
            ["group", "id", "chk", "doc", "line_no", "tie", "rest"])


def _dominated(table: pa.Table) -> pa.Table:
    """Lines of a bucket that have an earlier line within one edit."""
    group, ids, chk, doc, no, tie = (np.asarray(table.column(c)) for c in ("group", "id", "chk", "doc", "line_no", "tie"))
    tie = tie.view(U)  # digests are in the order of unsigned bytes
    # a line may be sent several times, also by one task: its earliest place counts
    order = np.lexsort((tie, no, doc, ids, group))
    keep = order[np.append(True, (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1]))]
    group, ids, chk, doc, no, tie = (x[keep] for x in (group, ids, chk, doc, no, tie))
    rest = table.column("rest").combine_chunks()
    seqs = [np.frombuffer(rest[int(i)].as_buffer(), dtype=U) for i in keep]
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.lexsort((ids, tie, no, doc))] = np.arange(len(ids))
    size = np.array([len(s) for s in seqs], dtype=np.int64)
    v = np.concatenate([variants(s) for s in seqs])
    row = np.repeat(np.arange(len(seqs)), size + 1)
    pos = np.concatenate([np.append(np.arange(n), -1) for n in size])
    order = np.lexsort((rank[row], v, group[row]))
    v, row, pos = v[order], row[order], pos[order]
    same = (v[1:] == v[:-1]) & (group[row[1:]] == group[row[:-1]])
    new = np.flatnonzero(np.append(True, ~same))
    ends = np.append(new[1:], len(v))
    gone = np.zeros(len(ids), dtype=bool)
    for a, z in zip(new[ends - new > 1], ends[ends - new > 1]):
        r, p = row[a:z], pos[a:z]  # earliest first
        whole = {int(r[i]) for i in np.flatnonzero(p < 0)}
        first: dict[int, list[int]] = {}  # by deleted place: lines before this one, the earliest first
        before: list[int] = []  # all lines before this one
        wholes: list[int] = []
        for x, at in zip(r.tolist(), p.tolist()):
            if not gone[x]:
                # one witness is nearly always enough: hashes agree, so the words do
                for y in (before if x in whole else wholes + first.get(at, [])):
                    if ids[y] != ids[x] and within_one(seqs[x], seqs[y]):
                        gone[x] = True
                        break
            if at >= 0:
                first.setdefault(at, []).append(x)
            else:
                wholes.append(x)
            before.append(x)
    return pa.table({"id": ids[gone], "chk": chk[gone]})


def _split(batches: Iterator[pa.RecordBatch], hit: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts and digests of a text, whole and without its lines with words;
    the text itself only if it may lose lines."""
    for b in batches:
        heads = np.array([int.from_bytes(d[:8], "little") for d in b.column(1).to_pylist()], dtype=U)
        may = _has(hit, heads) if len(heads) else np.empty(0, bool)
        rows = []
        for x in buffers(b.column(3)):
            data = x.tobytes()
            parts = data.split(b"\n")
            bare = [p for p in parts if not p or p.isspace()]
            rows.append((len(parts), hashlib.sha256(data).hexdigest(), len(parts) - len(bare), hashlib.sha256(b"\n".join(bare)).hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 4
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pc.if_else(pa.array(may), b.column(3), pa.scalar(None, b.column(3).type)), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
            ["doc_id", "dig", "doc", "text", "n_lines", "sha", "n_words_lines", "sha_copy"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n_removed, kept_sha256, kept_text) of each row; the text is null where
    nothing goes."""
    for b in batches:
        rows = []
        for text, gone, own, sha, lines, sha_copy in zip(*(b.column(c).to_pylist() for c in ("text", "gone", "own", "sha", "n_words_lines", "sha_copy"))):
            if not own:  # every line with words has an earlier one
                rows.append((lines, sha_copy, None))
            elif not gone:
                rows.append((0, sha, None))
            else:
                drop = set(gone)
                kept = "\n".join(p for i, p in enumerate(text.split("\n")) if i not in drop)
                rows.append((len(drop), hashlib.sha256(kept.encode()).hexdigest(), kept))
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_lines"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))]],
                                         ["doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text"])


def _bitmaps(df: DataFrame, n: int) -> np.ndarray:
    """``n`` bitmaps from (kind, word, bits) rows, at most 2 ** (_BITS - 6) each."""
    out = np.zeros((n, 1 << (_BITS - 6)), dtype=U)
    t = df.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[np.asarray(t.column("kind")), np.asarray(t.column("word"))] = np.asarray(t.column("bits")).view(U)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256, and
    kept_text (null where nothing was removed, or only lines of a whole copy)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))  # null ids last
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("dig"), doc.alias("doc"), text.alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _BLOCK_BYTES + 1)

    told = cut(src.select("dig", "doc", "text").mapInArrow(lambda bs: _line_rows(bs, buckets), _LINE), "lines")
    lines = told.filter("bucket IS NULL").select("dig", "doc", "line_no", "n", "id", "chk")
    bits = (
        told.filter("bucket IS NOT NULL").select("bucket", "block").repartition(buckets, "bucket")
        .groupBy("bucket").applyInArrow(_shared, "kind int, word long, bits long")
    )
    maps = spark.sparkContext.broadcast(_bitmaps(bits, 3))
    dominated = (
        src.select("dig", "doc", "text").mapInArrow(lambda bs: _rests(bs, maps.value), "group long, id long, chk int, doc long, line_no int, tie long, rest binary")
        .withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
        .groupBy("bucket").applyInArrow(lambda t: _dominated(t.drop(["bucket"])), "id long, chk int").distinct().withColumn("near", F.lit(True))
    )
    firsts = lines.groupBy("id", "chk", "n").agg(F.min(F.struct("doc", "line_no", "dig")).alias("at"), F.count("*").alias("times"))
    bad = cut(firsts.join(dominated, ["id", "chk"], "left").filter("times > 1 OR near").select("id", "chk", "at", "times", F.coalesce("near", F.lit(False)).alias("near")), "bad-lines")
    gone = cut(
        spread_join(lines, bad, ["id", "chk"], "times", lines.count(), buckets)  # the commonest line may hold a third of all places
        .filter(F.col("near") | ~((F.col("at.doc") == F.col("doc")) & (F.col("at.line_no") == F.col("line_no")) & (F.col("at.dig") == F.col("dig"))))
        .groupBy("dig", "doc").agg(F.collect_list("line_no").alias("gone")), "gone")
    hit = spark.sparkContext.broadcast(_bitmaps(_text_bits(gone), 1)[0])
    rows = src.select("doc_id", "dig", "doc", "text").mapInArrow(
        lambda bs: _split(bs, hit.value), "doc_id long, dig binary, doc long, text string, n_lines long, sha string, n_words_lines long, sha_copy string")
    least = lines.groupBy("dig").agg(F.min("doc").alias("least"))  # texts without words are their own
    return (
        rows.join(least, "dig", "left").withColumn("own", F.coalesce(F.col("doc") == F.col("least"), F.lit(True))).join(gone, ["dig", "doc"], "left")
        .select("doc_id", "text", "gone", "own", "n_lines", "sha", "n_words_lines", "sha_copy")
        .mapInArrow(_kept, "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept_text string")
    )


def _text_bits(gone: DataFrame) -> DataFrame:
    """Bits of the digests' first eight bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = np.array([int.from_bytes(d[:8], "little") for d in b.column(0).to_pylist()], dtype=U)
            slot = heads >> U(64 - _BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(heads), np.int32)), pa.array((slot >> U(6)).astype(np.int64)), pa.array((U(1) << (slot & U(63))).view(np.int64))], ["kind", "word", "bits"])

    return gone.select("dig").distinct().mapInArrow(run, "kind int, word long, bits long")
