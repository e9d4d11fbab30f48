"""Toxicity scores: a learned lexicon, matched with one edit by Levenshtein
automata intersected with the lexicon's trie, and weighed by context.

Lexicon and weights come from a bounded sample of labelled rows
(``TRAIN_ROWS``, the rows with the smallest hash of their id, never a held-out
one). Terms are whole words or word stems whose odds of standing in a toxic
text are high, counted over different texts, and that stand beside at least
``MIN_TOXIC`` different words on one side there, so that what near copies of
one text repeat is no term; of a stem and the words on it the
more specific one stays if it explains nearly all of the stem's hits. The
automaton of each whole word, also of one on a stem, allows one edit from
``FUZZY_FROM`` characters on; a word of the sample that stands rather in clean
texts is no misspelling of a term. The product with the trie is built as a
lazily determinised automaton, so a word costs one step per character and most
words die at once.
A hit counts less when its context window quotes or reports it. Logistic
weights over the counts give the score.

Defined results: null and empty texts score like a text without hits; without
labelled rows of both kinds every score is 0; a null id is held out; labels
that contradict each other for one id count as toxic; repeated rows each get a
row; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.textops import ALNUM_LOWER, buffers
from weblens.session import ship

TRAIN_ROWS = 6000
MAX_TERMS = 2000
MIN_TOXIC = 4
MIN_LOG_ODDS = 3.0
FUZZY_FROM = 4
STEMS = (4, 5, 6)
CONTEXT = 48
QUOTED_WEIGHT = 0.4
EDIT_WEIGHT = 0.8
N_FEATURES = 4

#: Marks and words near a hit that show a quotation or a report of it.
_QUOTE = re.compile(r"[\"“”„«»]|\b(?:quote|quoted|said|says|called|wrote|slur|word)\b")
_ANY = "\0"


class Lexicon:
    """Trie of terms with a lazily determinised edit automaton over it."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.kids: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[bool] = [False]
        self.whole: list[str | None] = [None]  # a whole word, even if it is a stem too
        self.fuzzy: list[bool] = [False]  # some term below allows an edit
        for t, stem in terms:
            at = 0
            for c in t:
                self.fuzzy[at] |= not stem and len(t) >= FUZZY_FROM
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.term.append(None)
                    self.stem.append(False)
                    self.whole.append(None)
                    self.fuzzy.append(False)
                at = self.kids[at][c]
            self.fuzzy[at] |= not stem and len(t) >= FUZZY_FROM
            if self.term[at] is None or stem:
                self.term[at], self.stem[at] = t, stem
            if not stem:
                self.whole[at] = t
        self.alphabet = {c for k in self.kids for c in k}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.rows: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, states: set[tuple[int, int]]) -> int:
        for node, e in list(states):
            if e == 0:  # the text lacks one character of the term
                states |= {(k, 1) for k in self.kids[node].values() if self.fuzzy[k]}
        key = frozenset(states)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.rows.append({})
        return self.ids[key]

    def _step(self, s: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[s]:
            if e == 0 and self.stem[node]:
                out.add((node, 0))  # a stem accepts any ending
            if c in self.kids[node]:
                k = self.kids[node][c]
                if e == 0 or self.fuzzy[k]:
                    out.add((k, e))
            if e == 0 and self.fuzzy[node]:
                out.add((node, 1))  # one character too many
                out |= {(k, 1) for k in self.kids[node].values() if self.fuzzy[k]}  # another character
        return self._state(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the best term for a word; none if no term fits."""
        s = self.start
        for c in word:
            if c not in self.alphabet:
                c = _ANY
            row = self.rows[s]
            if c not in row:
                row[c] = self._step(s, c)
            s = row[c]
            if not self.sets[s]:
                return None
        best = None
        for node, e in self.sets[s]:
            t = self.whole[node] if e else self.term[node]
            if t is not None and (e == 0 or len(t) >= FUZZY_FROM):
                best = min(best or (e, t), (e, t))
        return best and (best[1], best[0])


class Scorer:
    """Features of texts under a lexicon; remembers words without a match.
    Words in ``refused`` are no misspellings of terms."""

    def __init__(self, terms: list[tuple[str, bool]], refused: frozenset[str] = frozenset()):
        self.lex, self.refused, self.clean, self.hits = Lexicon(terms), refused, set(), {}

    def features(self, data: bytes) -> list[float]:
        ws = data.translate(ALNUM_LOWER).split()
        seen = set(ws)
        new = seen - self.clean
        found = set()
        for w in new:
            if w not in self.hits:
                s = w.decode("utf-8", "replace")
                m = self.lex.match(s)
                if m is None or (m[1] and s in self.refused):
                    self.clean.add(w)
                    continue
                self.hits[w] = m
            found.add(w)
        if len(self.clean) > 300_000:
            self.clean = set()
        if not found:
            return [0.0] * N_FEATURES
        hits = 0.0
        terms = set()
        low = data.lower()
        for w in found:
            term, edits = self.hits[w]
            terms.add(term)
            for m in re.finditer(rb"(?<![0-9a-z\x80-\xff])" + re.escape(w) + rb"(?![0-9a-z\x80-\xff])", low):
                around = low[max(0, m.start() - CONTEXT):m.start()] + b" " + low[m.end():m.end() + CONTEXT]
                hits += (QUOTED_WEIGHT if _QUOTE.search(around.decode("utf-8", "ignore")) else 1.0) * (EDIT_WEIGHT if edits else 1.0)
        n = len(ws)
        return [float(np.log1p(hits)), float(np.log1p(100.0 * hits / n)), float(np.log1p(len(terms))), 1.0]


def _terms(data: bytes) -> set[str]:
    out = set()
    for w in set(data.translate(ALNUM_LOWER).split()):
        s = w.decode("utf-8", "replace")
        if len(s) <= 24 and not s.isdigit():
            out.add(s)
            out.update(s[:k] + "*" for k in STEMS if len(s) > k)
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, side, hash of the word on that side) of all words and stems, once a text."""
    for b in batches:
        for x in buffers(b.column(0)):
            ws = [b"", *x.tobytes().translate(ALNUM_LOWER).split(), b""]
            out = set()
            for i in range(1, len(ws) - 1):
                for t in _terms(ws[i]):
                    out |= {(t, 0, zlib.crc32(ws[i - 1])), (t, 1, zlib.crc32(ws[i + 1]))}
            cols = list(zip(*sorted(out))) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()))], ["term", "side", "word"])


def pick_terms(rows: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """(term, is stem) from (term or stem*, number of toxic texts): a stem goes
    if one longer term has nearly all its texts; a stem that a kept one covers
    goes, words on it stay for their misspellings."""
    rows = [(t.rstrip("*"), t.endswith("*"), n) for t, n in rows]
    most: dict[str, int] = {}  # of the longer terms on each stem
    for t, _, n in rows:
        for k in STEMS:
            if len(t) > k:
                most[t[:k]] = max(most.get(t[:k], 0), n)
    stems = {t for t, stem, n in rows if stem and most.get(t, 0) < 0.9 * n}
    covered = lambda t: any(t[:k] in stems for k in STEMS if k < len(t))
    return sorted({(t, stem) for t, stem, _ in rows if not stem or (t in stems and not covered(t))})


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Model:
    def __init__(self, terms: list[tuple[str, bool]], weights: np.ndarray | None, bias: float, refused: frozenset[str] = frozenset()):
        self.terms, self.weights, self.bias, self.refused = terms, weights, bias, refused

    def scores(self, scorer: Scorer, texts: Iterator[np.ndarray]) -> list[float]:
        if self.weights is None:
            return [0.0 for _ in texts]
        out = []
        for x in texts:
            z = float(np.dot(self.weights, scorer.features(x.tobytes()))) + self.bias
            out.append(1.0 / (1.0 + float(np.exp(-np.clip(z, -30.0, 30.0)))))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps on the ridge-penalised logistic loss."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pen * w
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learn terms and weights from at most ``rows`` labelled rows."""
    spark = docs.sparkSession
    ship(spark)
    picked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        .select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    )
    # at most `rows` ids: a bounded broadcast; one row per id even if a table repeats it
    sample = (
        docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
        .join(F.broadcast(picked), F.col("__doc") == F.col("__id")).groupBy("__id", "toxic").agg(F.max("text").alias("text"))
        .persist()
    )
    try:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bad, good = Counter(), Counter()
            for b in batches:
                for y, x in zip(b.column(0).to_pylist(), buffers(b.column(1))):
                    (bad if y else good).update(_terms(x.tobytes()))
            keys = sorted(set(bad) | set(good))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([good[k] for k in keys], pa.int64())], ["term", "bad", "good"])

        different = sample.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
        n = {r["toxic"] != 0: r["n"] for r in different.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not n.get(True) or not n.get(False):
            return Model([], None, 0.0)
        odds = F.log((F.col("bad") + 0.5) / (n[True] + 1)) - F.log((F.col("good") + 0.5) / (n[False] + 1))
        counted = (
            different.mapInArrow(count, "term string, bad long, good long")
            .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("odds", odds).persist()
        )
        try:
            likely = counted.filter((F.col("bad") >= MIN_TOXIC) & (F.col("odds") >= MIN_LOG_ODDS))
            own = different.filter("toxic <> 0").select("text").mapInArrow(_neighbours, "term string, side int, word long").join(likely.select("term"), "term", "left_semi")
            free = own.groupBy("term", "side").agg(F.countDistinct("word").alias("n")).groupBy("term").agg(F.max("n").alias("n")).filter(F.col("n") >= MIN_TOXIC)
            best = likely.join(free.select("term"), "term", "left_semi").orderBy(F.desc("odds"), "term").limit(MAX_TERMS).collect()
            terms = pick_terms([(r["term"], r["bad"]) for r in best])

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                lex = Lexicon(terms)
                for b in batches:
                    yield b.filter(pa.array([bool((m := lex.match(t)) and m[1]) for t in b.column(0).to_pylist()], pa.bool_()))

            clean = counted.filter((F.col("odds") < 0) & ~F.col("term").endswith("*")).select("term")
            refused = frozenset(r["term"] for r in clean.mapInArrow(near, "term string").collect())
        finally:
            counted.unpersist()

        def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sc = Scorer(terms, refused)
            for b in batches:
                f = [sc.features(x.tobytes()) for x in buffers(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

        got = sample.select("toxic", "text").mapInArrow(feats, "toxic int, f array<double>").collect()
        x = np.array([r["f"] for r in got])
        y = np.array([float(r["toxic"] != 0) for r in got])
        order = np.lexsort((*x.T, y))  # the rows' order must not matter
        w, b = _logistic(x[order], y[order])
        return Model(terms, w, b, refused)
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = Scorer(model.terms, model.refused)
        for b in batches:
            s = np.array(model.scores(sc, buffers(b.column(2))), dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = Scorer(model.terms, model.refused)
        for b in batches:
            s = np.array(model.scores(sc, buffers(b.column(at))), dtype=float)
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)
