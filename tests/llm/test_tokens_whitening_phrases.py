"""Word BPE against the library, whitening against numpy and exact integers,
collocations against plain counting."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from weblens.llm import collocations, whitening, word_bpe
from weblens.llm.queries import word_model

LONG = " ".join(f"Word{i % 977}'s" for i in range(60_000))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- word BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_model())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def words():
    return word_bpe.WordEncoder(word_model())


def test_word_bpe_equals_the_library(words, library):
    r = random.Random(3)
    alphabet = ["a", "b", "th", "ing", "E", " ", "\n", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "0", "9", "É", "é", "Σ", "İ", "漢", "가", "가", "\x1c", "\x00", "...",
                "ß", "ﬁ", "ͅ", "Ᲊ", "\U00010d50", " ", "\U0001D15E", "​"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["x" * 5000, "".join(r.choice("abcdefgh") for _ in range(5000)), "!" * 3000, "<|endoftext|>" * 3, LONG]
    for t, got in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        decoded = library.decode(got.ids, skip_special_tokens=False)
        assert words.encode(t) == got.ids and words.decode(got.ids) == decoded
        assert words.digest(t) == (len(got.ids), sha(" ".join(map(str, got.ids))), sha(decoded))


def test_word_bpe_scan_and_heap_agree(words):
    r = random.Random(4)
    for _ in range(300):
        word = "".join(r.choice("thingadreé") for _ in range(r.randint(1, 80)))
        ids, starts = words._scan(words.symbols(word))
        assert ids == words._heap(words.symbols(word)) and len(ids) == len(starts)
        raw = word.encode()
        assert [len(words.token[i].replace(words.suffix, "")) for i in ids] == [b - a for a, b in zip(starts, [*starts[1:], len(raw)])]


def test_word_bpe_plain_text(words):
    assert words.plain_text(words.encode("Hello,  wörld's<|endoftext|> 12")) == "hello , wörld 's <|endoftext|> 1 2"


def test_word_bpe_on_tables(spark, library):
    rows = [(1, "Some text"), (2, None), (3, ""), (4, LONG), (None, "a"), (1, "Some text"), (5, " \n")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, n_tokens string, ids int")
    got = sorted(map(tuple, word_bpe.digests(docs, word_model()).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    enc = {r.doc_id: (r.ids, r.decoded) for r in word_bpe.encode(docs.filter("doc_id = 1"), word_model()).collect()}
    assert enc[1] == (library.encode("Some text").ids, "some</w> text</w>")
    assert word_bpe.digests(docs.limit(0), word_model()).count() == 0


# --- whitening

VECTORS = "vec_id long, embedding array<float>, n int, component string, w int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)


@pytest.mark.parametrize("values", [
    np.linspace(100, 1, 24), np.r_[[5] * 8, [5 + 1e-9] * 8, np.linspace(3, 1, 8)], np.r_[np.full(12, 2.0) + 1e-5 * np.arange(12), [1] * 9, 1e-12, 0, 0],
    np.ones(10), np.array([3.0]),
])
def test_refinement_reaches_double_precision(values):
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(len(values), len(values))))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.components(v)
    assert np.abs(e - np.sort(np.linalg.eigvalsh(v))[::-1]).max() < 1e-14 * e.max() * len(v)
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-14
    assert np.abs(v @ x - x * e).max() < 1e-13 * e.max()


def test_whitening(spark):
    r = np.random.default_rng(2)
    good = [(i, [float(np.float32(q)) for q in r.normal(size=12) * np.linspace(1, 3, 12)]) for i in range(300)]
    good += [(7, good[7][1]), (None, good[3][1])]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [1.0] * 11 + [float("inf")]), (904, [1.0] * 5), (905, [])]
    got = whitening.whiten(vectors(spark, good + bad).repartition(5)).collect()
    assert len(got) == 8 * len(good) and sorted({g.component for g in got}) == list(range(1, 9))
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in good], dtype=object)
    n, s = len(good), x.sum(axis=0)
    dev = Counter((i, int(((n * row - s) ** 2).sum())) for (i, _), row in zip(good, x))
    assert Counter((g.vec_id, int(g.deviation)) for g in got if g.component == 1) == dev
    y = np.array([[float(Fraction(int(a)) - Fraction(int(b), n)) for a, b in zip(row, s)] for row in x])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    z = {(i, k + 1): y[j] @ q[:, k] / math.sqrt(e[k]) for j, (i, _) in enumerate(good) for k in range(8)}
    for k in range(1, 9):
        mine = [g for g in got if g.component == k and g.vec_id is not None]
        sign = 1 if mine[0].whitened * z[mine[0].vec_id, k] > 0 else -1
        assert all(abs(g.whitened - sign * z[g.vec_id, k]) < 1e-9 for g in mine)
        assert all(abs(g.explained - e[k - 1] / e.sum()) < 1e-12 and g.n == n and g.identity_error < 1e-10 for g in mine)


def test_whitening_without_variance(spark):
    empty = vectors(spark, [])
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [None])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(g.component, g.n, int(g.deviation), g.whitened, g.explained, g.identity_error) for g in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 5.0]) for i in range(9)])).collect()
    assert {(g.component, g.whitened is None) for g in flat} == {(1, False), (2, True)}
    huge = whitening.whiten(vectors(spark, [(1, [3e38]), (2, [-3e38])])).collect()
    assert len({g.deviation for g in huge}) == 1 and all(abs(abs(g.whitened) - 1) < 1e-9 for g in huge)


def test_deviations_need_more_than_64_bits():
    c = whitening.Centre(10 ** 9, [5, 7 * 10 ** 9 + 1])
    w = whitening.Whitener(c, np.eye(2), 2)
    x = np.array([[10 ** 6, -4], [0, 7]], dtype=np.int64)
    assert w.deviations(x) == [sum((10 ** 9 * int(a) - s) ** 2 for a, s in zip(row, c.sums)) for row in x]


# --- collocations

def plain_phrases(rows, bound, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", t):
            ws = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {w: a for w, a in c.items() if len(w) >= 2 and a >= bound}
        rows = []
        for w, a in cand.items():
            if any(len(v) > len(w) and 100 * b >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v))) for v, b in cand.items()):
                continue
            score, k = min((2000000 * a // (c[w[:k]] + c[w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), c[w[:k]], c[w[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def phrase_rows():
    r = random.Random(8)
    ws = [*"abcde", "É", "é", "A", "\x0b", "it's", "x-y"]
    rows = [("".join(r.choice(ws) + r.choice(["  ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("...", "en"), ("one Two three four", "de")] + [("one two three four five", "de")] * 9
    rows += [("a b " * 3000 + ". c d" * 3000, "en"), ("zz " * 50, "only")]
    return rows


@pytest.mark.parametrize("bound,top", [(3, 50), (8, 2000)])
def test_collocations(spark, bound, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, l, 1, "p", 2) for t, l in rows], "text string, lang string, n long, phrase string, k int").repartition(7)
    assert sorted(map(tuple, collocations.mine(docs, top, bound).collect())) == plain_phrases(rows, bound, top)


def test_collocations_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(spark.createDataFrame([("a b", None), (None, "en")], "text string, lang string")).count() == 0


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_slices_keep_every_phrase(monkeypatch, size):
    import pyarrow as pa

    rows = phrase_rows()
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([l for _, l in rows], pa.string())], ["text", "lang"])

    def phrases():
        out = Counter()
        for w in collocations._slices(batch):
            for k in range(1, 5):
                for i in np.flatnonzero(w.whole(k)):
                    out[w.langs[w.lang[i]], tuple(w.vocab[c] for c in w.code[i:i + k])] += 1
        return out

    whole = phrases()
    monkeypatch.setattr(collocations, "SLICE", size)
    assert phrases() == whole


@pytest.mark.parametrize("seed", range(6))
def test_summaries_lose_no_frequent_key(seed):
    r = random.Random(seed)
    stream = [r.choice([1, 2, 3, r.randint(4, 400), r.randint(4, 40000)]) for _ in range(20000)]
    true, bound = Counter(stream), 200
    parts = [collocations.Summary(len(stream) // bound + 1) for _ in range(5)]
    for i in range(0, len(stream), 500):
        c = Counter(stream[i:i + 500])
        keys = np.array(sorted(c), dtype=np.uint64)
        parts[i // 500 % 5].merge(keys, np.array([c[int(k)] for k in keys]))
    total = parts[0]
    for p in parts[1:]:
        total.merge(p.keys, p.counts, p.taken)
    assert total.taken < bound and len(total.keys) <= total.capacity
    kept = dict(zip(total.keys.tolist(), total.counts.tolist()))
    assert all(true[k] - total.taken <= v <= true[k] for k, v in kept.items())
    assert all(k in kept for k, v in true.items() if v >= bound)


def test_filter_knows_its_keys():
    buckets = 3
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    stretch = 16 * 2000 // 8 * 8
    bits = np.zeros(buckets * stretch, dtype=np.uint8)
    for s in collocations._slots(h, buckets, stretch):
        bits[s] = 1
    f = collocations.Filter(np.packbits(bits, bitorder="little"), buckets)
    other = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert f(h).all() and f(other).mean() < 0.2
