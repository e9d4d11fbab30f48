"""Jaccard self-join of word n-gram sets with a count-vector tree.

1. Every text becomes its set of hashed shingles. Equal sets are one class; from
   here on only classes matter, so copies cost one entry per task.
2. Two sets with Jaccard 0.75 share a shingle among the first
   ``n - ceil(0.75 n) + 1`` of each, in any common order. The order puts
   frequent shingles last: those that ``FREQUENT`` different sets of a chunk of
   documents hold. All documents are counted, chunk by chunk, into a bitmap of
   fixed size. A wrong guess moves a shingle in the order and changes no result.
3. These prefix shingles go, packed in blocks, to buckets by hash; shingles with
   several classes of fitting sizes give lists.
4. Lists with the same smallest class are one group with that class as its hub,
   so a family of near copies is a few groups, not one per shared shingle. Each
   class verifies its best hub, and linked classes are merged: about one check a
   member, not one a pair.
5. Groups that still hold several components are searched by a tree over count
   vectors (shingles hashed into groups, their counts taken as a point): the sum
   over the groups of the smaller upper coordinates bounds the overlap of two
   boxes, and the sum of smaller counts that of two sets. A set of n shingles
   has about n / 2 groups, a power of two, and folds onto fewer for a smaller
   partner. First each member tries its ``TOP`` best partners in larger
   components; once these are verified and merged, the groups where some pair was
   left out are searched again, and every pair in different components that
   passes the bound is verified on its whole sets.

Every pair of different sets that reaches the threshold ends in one component;
nothing is capped or sampled. A group longer than ``BLOCK`` is searched by pairs
of its blocks.

Defined results: null texts and texts without words have no shingles and link
with nothing; shorter texts are one shingle; component_id is the smallest
non-null id (null if all are); repeated rows each get a row; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.graph import components
from weblens.llm.textops import U, buffers, shingles, signed, words
from weblens.session import cut, packed, ship

SHINGLE = 5
#: Threshold as a fraction: NUM * |union| <= DEN * |intersection|.
NUM, DEN = 3, 4
GROUPS = 128  # at least
TOP = 2
FREQUENT = 3
LEAF = 32
BLOCK = 8192
_BITS = 25
_CHUNK = 1 << 22
_ENTRY = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<u4")])
_BLOCK_BYTES = 16 << 20


def _set(x: np.ndarray, k: int) -> np.ndarray:
    return shingles(words(x, lower=True)[2], k)


def _class(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefix(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The shingles that a partner must share one of: the first
    n - ceil(0.75 n) + 1, frequent ones last, else by hash."""
    n = len(s)
    p = n + (-NUM * n // DEN) + 1
    if p >= n:
        return s
    slot = s >> U(64 - _BITS)
    is_late = (late[slot >> U(6)] >> (slot & U(63))) & U(1)
    order = np.argsort((s >> U(1)) | (is_late << U(63)), kind="stable")
    return s[order[:p]]


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per text a row (doc_id, th, n, cls, vec); per chunk the frequent
    shingles as (word, bits), and the number of shingles at word -1."""
    chunk, size, seen = [], 0, set()

    def frequent() -> pa.RecordBatch:
        t, c = np.unique(np.concatenate(chunk), return_counts=True) if chunk else (np.empty(0, U), np.empty(0, int))
        slot = t[c >= FREQUENT] >> U(64 - _BITS)
        word, at = np.unique(slot >> U(6), return_inverse=True)
        bits = np.zeros(len(word), dtype=U)
        np.bitwise_or.at(bits, at, U(1) << (slot & U(63)))
        m = len(word) + 1
        none = lambda t: pa.nulls(m, t)
        return pa.RecordBatch.from_arrays(
            [none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()),
             pa.array(np.append(word.astype(np.int64), -1)), pa.array(np.append(signed(bits), size))], _NAMES)

    for b in batches:
        ns, cls, vec = [], [], []
        for x in buffers(b.column(2)):
            s = _set(x, k)
            ns.append(len(s))
            cls.append(_class(s))
            vec.append(_vector(s))
            if cls[-1] in seen:
                continue
            if size and size + len(s) > _CHUNK:
                yield frequent()
                chunk, size, seen = [], 0, set()
            seen.add(cls[-1])
            chunk.append(s)
            size += len(s)
        m = len(ns)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(cls, pa.int64()), pa.array(vec, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], _NAMES)
    if chunk:
        yield frequent()


_NAMES = ["doc_id", "th", "n", "cls", "vec", "word", "bits"]


def _emit(batches: Iterator[pa.RecordBatch], k: int, n_buckets: int, late: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Prefix entries of each class, packed by bucket."""
    seen: set[int] = set()
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        e = np.concatenate(held)
        b = e["token"] % U(n_buckets)
        order = np.argsort(b, kind="stable")
        e, b = e[order], b[order].astype(np.int64)
        at = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(at[1:], len(e))
        return pa.RecordBatch.from_arrays([pa.array(b[at].astype(np.int32)), pa.array([e[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())], ["bucket", "block"])

    for b in batches:
        for x in buffers(b.column(0)):
            s = _set(x, k)
            if len(s) == 0:
                continue
            c = _class(s)
            if c in seen:
                continue
            seen.add(c)
            p = _prefix(s, late)
            e = np.empty(len(p), dtype=_ENTRY)
            e["token"], e["cls"], e["n"] = p, c, len(s)
            held.append(e)
            size += len(p)
            if size > 1 << 20:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def _lists(table: pa.Table) -> pa.Table:
    """Lists of a bucket: classes that share a prefix shingle, cut where sizes
    cannot fit. Equal lists (they have equal ids) come once."""
    e = np.concatenate([np.frombuffer(x.as_buffer(), dtype=_ENTRY) for x in table.column("block")])
    e = e[np.argsort(e["token"], kind="stable")]
    t = e["token"]
    eq = t[1:] == t[:-1]
    e = e[np.append(eq, False) | np.append(False, eq)]
    e = e[np.lexsort((e["cls"], e["n"], e["token"]))]
    if len(e):
        keep = np.append(True, (e["token"][1:] != e["token"][:-1]) | (e["cls"][1:] != e["cls"][:-1]))
        e = e[keep]
    n = e["n"].astype(np.int64)
    new = np.append(True, (e["token"][1:] != e["token"][:-1]) | (DEN * n[:-1] < NUM * n[1:])) if len(e) else np.empty(0, bool)
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(e)))
    ids, seen = np.zeros(len(at), dtype=np.int64), set()
    ok = np.zeros(len(at), dtype=bool)
    cls = np.ascontiguousarray(e["cls"])
    for i in np.flatnonzero(run > 1):
        ids[i] = int.from_bytes(blake2b(cls[at[i]:at[i] + run[i]].tobytes(), digest_size=8).digest(), "little", signed=True)
        if ids[i] not in seen:
            seen.add(ids[i])
            ok[i] = True
    rows = np.repeat(ok, run)
    return pa.table({"list": np.repeat(ids, run)[rows], "cls": cls[rows], "n": n[rows]})


def overlap_needed(a: Column, b: Column) -> Column:
    """Smallest overlap of sets of these sizes that reaches the threshold."""
    return F.ceil(NUM * (a + b) / F.lit(NUM + DEN))


def _vector(s: np.ndarray) -> bytes:
    """Group counts of a set: one byte for the width of a count, then the counts."""
    g = max(GROUPS, 1 << (max(1, len(s) // 2) - 1).bit_length())
    v = np.bincount((s & U(g - 1)).astype(np.int64), minlength=g)
    width = 1 if v.max() < 1 << 8 else 2 if v.max() < 1 << 16 else 4
    return bytes([width]) + v.astype(f"<u{width}").tobytes()


def _counts(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=f"<u{x[0]}", offset=1).astype(np.int32)


def _fold(v: np.ndarray, g: int) -> np.ndarray:
    return v if len(v) == g else v.reshape(-1, g).sum(axis=0, dtype=np.int32)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose summed smaller counts allow the threshold."""
    for b in batches:
        ok = []
        for x, y, m in zip(b.column("va").to_pylist(), b.column("vb").to_pylist(), (np.asarray(b.column("na")) + np.asarray(b.column("nb"))).tolist()):
            p, q = _counts(x), _counts(y)
            g = min(len(p), len(q))
            ok.append((NUM + DEN) * int(np.minimum(_fold(p, g), _fold(q, g)).sum()) >= NUM * m)
        yield b.select(["a", "b", "na", "nb", "votes"]).filter(pa.array(ok, pa.bool_()))


class CountTree:
    """Packed tree over count vectors, leaves in order of size and then of the
    first groups' counts; a box holds the largest of its points' counts and the
    smallest of their sizes."""

    def __init__(self, vec: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((*vec.T[:4], n))
        self.vec, self.n = vec[self.order], n[self.order]
        self.levels = []
        hi, low = self.vec, self.n
        while len(low) > 2 * LEAF:
            at = np.arange(0, len(low), LEAF)
            hi, low = np.maximum.reduceat(hi, at, axis=0), np.minimum.reduceat(low, at)
            self.levels.append((hi, low))

    def near(self, q: np.ndarray, qn: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in tree order) of the points that may reach the threshold
        with a point, and the bounds of their overlaps."""
        nodes = np.arange(len(self.levels[-1][1]) if self.levels else len(self.n))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, low = self.levels[depth]
            ok = (NUM + DEN) * np.minimum(hi[nodes], q).sum(axis=1) >= NUM * (low[nodes] + qn)
            nodes = (nodes[ok][:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < (len(self.levels[depth - 1][1]) if depth else len(self.n))]
        top = np.minimum(self.vec[nodes], q).sum(axis=1)
        ok = (NUM + DEN) * top >= NUM * (self.n[nodes] + qn)
        return nodes[ok], top[ok]


def _search(table: pa.Table, best: int | None) -> pa.Table:
    """Pairs of one group (or of two of its blocks) in different components
    whose vectors allow the threshold: all of them, or for each member the
    ``best`` ones in larger components. A row without a pair says that
    pairs of the group were left out."""
    cls, comp, n, part = (np.asarray(table.column(c)) for c in ("cls", "comp", "n", "part"))
    vecs = [_counts(x) for x in table.column("vec").to_pylist()]
    groups = np.array([len(v) for v in vecs])
    of_comp, size = np.unique(comp, return_inverse=True)[1], np.bincount(np.unique(comp, return_inverse=True)[1])
    weight = size[of_comp]
    same_block = part.min() == part.max()
    a, b, left_out = [], [], False
    for g in np.unique(groups):
        # sizes within 3 to 4 have equal or neighbouring numbers of groups
        pts = np.flatnonzero((groups == g) | (groups == 2 * g))
        folded = np.stack([_fold(vecs[i], g) for i in pts])
        tree = CountTree(folded, n[pts])
        for i, q in zip(pts.tolist(), folded):
            if best is None and groups[i] != g:
                continue  # its smaller partners find it
            at, top = tree.near(q, int(n[i]))
            j = pts[tree.order[at]]
            ok = comp[j] != comp[i]
            if groups[i] != g:
                ok &= groups[j] == g  # two of 2 g meet in their own round
            if not same_block:
                ok &= part[j] != part[i]
            if best is None:
                ok &= (cls[j] > cls[i]) | (groups[j] != g)
            else:
                ok &= (weight[j] > weight[i]) | ((weight[j] == weight[i]) & (comp[j] < comp[i]))
            j, top = j[ok], top[ok]
            if best is not None and len(j) > best:
                left_out = True
                j = j[np.lexsort((cls[j], -top))[:best]]
            a += [cls[i]] * len(j)
            b += cls[j].tolist()
    lists = [None] * len(a)
    if left_out:
        a, b, lists = [*a, None], [*b, None], [*lists, table.column("list")[0].as_py()]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "list": pa.array(lists, pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch], k: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole sets of the texts whose hash the bitmap has, once a task."""
    seen: set[int] = set()
    for b in batches:
        cls, sets = [], []
        slot = np.asarray(b.column(1)).view(U) >> U(64 - _BITS)
        pick = np.flatnonzero((wanted[slot >> U(6)] >> (slot & U(63))) & U(1))
        for x in buffers(b.column(0).take(pa.array(pick))):
            s = _set(x, k)
            c = _class(s)
            if c not in seen:
                seen.add(c)
                cls.append(c)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "items"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("sa"), b.column("sb")):
            p, q = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(DEN * both >= NUM * (len(p) + len(q) - both))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _bitmap(df: DataFrame, col: str) -> np.ndarray:
    """Fixed-size bitmap of the top bits of a hash column (at most
    2 ** (_BITS - 6) rows of 64 bits come to the driver)."""
    slot = df.select(F.shiftrightunsigned(col, 64 - _BITS).alias("slot"))
    return _filled(slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))


def _filled(df: DataFrame) -> np.ndarray:
    """A bitmap from its (word, bits) rows."""
    out = np.zeros(1 << (_BITS - 6), dtype=U)
    t = df.select("word", "bits").toArrow()
    out[np.asarray(t.column("word"))] = np.asarray(t.column("bits")).view(U)
    return out


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their whole sets (a set
    that several tasks give makes a pair come up again, which harms nothing)."""
    return (
        pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("items").alias("sa")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("items").alias("sb")), "b")
        .mapInArrow(_verified, "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), n_shingles, cls
    (its set's id), component_id."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = src.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    told = cut(src.select("doc_id", "th", "text").mapInArrow(
        lambda bs: _describe(bs, k), "doc_id long, th long, n long, cls long, vec binary, word long, bits long"), "sets")
    rows = told.filter("cls IS NOT NULL").select("doc_id", "th", "n", "cls")
    one = told.filter("n > 0").groupBy("cls").agg(F.min("th").alias("th"), F.max("n").alias("n"), F.max("vec").alias("vec"))

    total = told.filter("word < 0").agg(F.sum("bits")).first()[0] or 0
    late = _filled(told.filter("word >= 0").groupBy("word").agg(F.bit_or("bits").alias("bits")))
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * _ENTRY.itemsize * (1 - NUM / DEN)) // _BLOCK_BYTES + 1)
    shared = spark.sparkContext.broadcast(late)
    lists = cut(
        src.select("text").mapInArrow(lambda bs: _emit(bs, k, n_buckets, shared.value), "bucket int, block binary")
        .repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_lists, "list long, cls long, n long")
        .distinct(), "lists",
    )

    # lists with the same smallest class become one: its hub and all their members
    lead = lists.groupBy("list").agg(F.min(F.struct("cls", "n")).alias("c"))
    vecs = cut(one, "vectors")
    hubs = cut(
        lists.join(lead, "list").groupBy(F.col("c.cls").alias("list"), F.col("c.n").alias("hub_n"), "cls", "n").agg(F.count("*").alias("votes")), "hubs")
    star = (
        hubs.filter("cls <> list").select(F.col("list").alias("a"), F.col("cls").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb"), "votes")
        .filter(DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb"))
    )
    va = vecs.select(F.col("cls").alias("a"), F.col("vec").alias("va"))
    vb = vecs.select(F.col("cls").alias("b"), F.col("vec").alias("vb"))
    star = cut(star.join(va, "a").join(vb, "b").mapInArrow(_bounded, "a long, b long, na long, nb long, votes long"), "stars")
    best = star.groupBy("b").agg(F.max(F.struct("votes", F.col("a").alias("a"))).alias("m")).select(F.col("m.a").alias("a"), "b")

    def sets_of(pairs: DataFrame) -> DataFrame:
        need = pairs.select("a").union(pairs.select("b")).distinct().join(vecs.select(F.col("cls").alias("a"), "th"), "a")
        wanted = spark.sparkContext.broadcast(_bitmap(need, "th"))
        return cut(
            src.select("text", "th").mapInArrow(lambda bs: _sets(bs, k, wanted.value), "cls long, items binary"), "whole")

    links = cut(_links(best, sets_of(best)), "links")
    comp = components(links)
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def search(within: DataFrame, comp: DataFrame, top: int | None) -> DataFrame:
        """Pairs of the groups that hold several components."""
        named = within.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        open_lists = (
            named.groupBy("list").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .filter("lo <> hi AND m > 2").select("list", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
        )
        parted = (
            named.join(open_lists, "list").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("list", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "cls", "comp", "n")
        )
        return cut(parted.join(vecs.select("cls", "vec"), "cls").groupBy("list", "p", "q")
                   .applyInArrow(lambda t: _search(t, top), "a long, b long, list long").distinct(), "pairs")

    def verify(pairs: DataFrame, comp: DataFrame) -> DataFrame | None:
        """Links among the pairs that are still in different components and
        were not tried before; none if there is no such pair."""
        nonlocal tried
        at_a = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        at_b = comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        new = cut(
            pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
            .join(at_a, "a", "left").join(at_b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "new")
        if new.isEmpty():
            return None
        tried = tried.union(new)
        return cut(_links(new, sets_of(new)), "links")

    # other star pairs and each member's best partners
    first = search(hubs, comp, TOP)
    found = verify(star.select("a", "b").union(first.filter("a IS NOT NULL").select("a", "b")), comp)
    if found is not None:
        links = links.union(found)
        comp = components(links)
    again = first.filter("list IS NOT NULL").select("list")
    if not again.isEmpty():
        found = verify(search(hubs.join(again, "list", "left_semi"), comp, None).select("a", "b"), comp)
        if found is not None:
            comp = components(links.union(found))

    # the smallest id of each component, by class
    ids = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    ids = ids.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lows = ids.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_class = ids.join(lows, "comp").select("cls", "component_id")
    linked = rows.filter("n > 0").join(by_class, "cls").select("doc_id", "th", F.col("n").alias("n_shingles"), "cls", "component_id")
    return linked.unionByName(rows.filter("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), "cls", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component."""
    gone = near_duplicates(docs, id_col, text_col).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "th").distinct().alias("gone")
    rows = packed(docs, id=F.col(id_col).cast("long"), th=F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("rows")
    return rows.join(gone, F.col("rows.id").eqNullSafe(F.col("gone.doc_id")) & (F.col("rows.th") == F.col("gone.th")), "left_anti").select("row.*")
