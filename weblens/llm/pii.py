"""Personal data: fixed patterns plus a character BiLSTM with a CRF.

The patterns give the base spans, over the whole text. The model is trained in
numpy on windows of at most ``TRAIN_TEXTS`` texts, an equal share for each kind
(of the texts that look like holding it, those with the smallest hash) and the
rest from any text with digits; a text gives at most ``TEXT_WINDOWS`` windows,
from all over its length, those with spans first and its kinds in turn, so no
text keeps others out. They are trained on with some spans rewritten into forms that the
patterns miss (no plus sign, other separators, digits in groups, spaced or
bracketed dots), and it adds spans. Every kind
it knows holds a digit or an at sign, so it reads the neighbourhoods of those
characters and nothing else; each neighbourhood is cut into overlapping windows
of fixed length, the windows' tag scores are averaged where they overlap
(weighted to the window's middle), and one Viterbi pass over the whole
neighbourhood decides. Added spans never overlap base ones.

Defined results: null and empty texts have no spans; without any base span in
the sample there is no model and only base spans are given; offsets are code
points; repeated rows, ties and other columns change nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.session import ship

KINDS = ["email", "ip", "card", "phone"]
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

TRAIN_TEXTS = 400
TEXT_WINDOWS = 16
WINDOW, STRIDE, MARGIN = 96, 64, 24
PIECE = 2 * WINDOW  # of a long neighbourhood, for training only
EMBED, HIDDEN, EPOCHS, BATCH, SEED = 12, 16, 8, 64, 7
STEPS = 200  # batches at least

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
#: What every text with a base span of a kind holds, for Java and Python alike.
_HINTS = [r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[ -]?[0-9]){11}", r"\+[0-9][ ().0-9-]{7}"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


#: Places (of all sequences of a group, padding included) decoded at once; length
#: from which a neighbourhood is decoded alone, and the places of its blocks.
CELLS = 1 << 17
LONG = 1 << 15
BLOCK = 1 << 13


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, in order."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        a = at
        while m and a > free and text[a - 1] in _LOCAL:
            a -= 1
        if m and a < at:
            out.append((a, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def regions(text: str) -> list[tuple[int, int]]:
    """Neighbourhoods of all digits and at signs, merged where they touch."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def encode(s: str) -> np.ndarray:
    """Character classes: printable ASCII as such, others in four groups; 0 pads."""
    return np.array([ord(c) - 31 if " " <= c <= "~" else 96 if c.isalpha() else 97 if c.isspace() else 98 for c in s], dtype=np.int64)


N_CHARS = 99


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """Character BiLSTM with CRF transitions; ``p`` holds all weights."""

    def __init__(self, p: dict[str, np.ndarray] | None = None):
        if p is None:
            r = np.random.default_rng(SEED)
            g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
            p = {"emb": g(N_CHARS, EMBED) * 3, "out": g(2 * HIDDEN, len(TAGS)), "bias": np.zeros(len(TAGS), np.float32), "trans": np.zeros((len(TAGS), len(TAGS)), np.float32)}
            for d in "fb":
                p[f"wx{d}"], p[f"wh{d}"] = g(EMBED, 4 * HIDDEN), g(HIDDEN, 4 * HIDDEN)
                b = np.zeros(4 * HIDDEN, np.float32)
                b[HIDDEN:2 * HIDDEN] = 1.0
                p[f"b{d}"] = b
        self.p = p

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H) over x (T, B, E); padding leaves the state alone."""
        wh, h = self.p[f"wh{d}"], np.zeros((x.shape[1], HIDDEN), np.float32)
        c, pre = h, x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ wh
            s = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, c2
            out[t] = h
        return out

    def scores(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (B, T, tags) of padded windows (B, T)."""
        x = self.p["emb"][ids.T]
        mask = (ids.T > 0).astype(np.float32)
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._lstm(x, mask, "f", kf), self._lstm(x, mask, "b", kb)], axis=2)
        if keep is not None:
            keep.update(x=x, h=h, f=kf, b=kb)
        return (h @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradients."""
        keep: dict = {}
        e = self.scores(ids, keep).transpose(1, 0, 2).astype(np.float64)
        tr = self.p["trans"].astype(np.float64)
        T, B, K = e.shape
        on = ids.T > 0
        y = tags.T
        al, be = np.empty_like(e), np.zeros_like(e)
        al[0] = e[0]
        for t in range(1, T):
            al[t] = np.where(on[t][:, None], _logsum(al[t - 1][:, :, None] + tr, 1) + e[t], al[t - 1])
        for t in range(T - 2, -1, -1):
            be[t] = np.where(on[t + 1][:, None], _logsum(tr + (e[t + 1] + be[t + 1])[:, None, :], 2), be[t + 1])
        z = _logsum(al[-1], 1)
        rows = np.arange(B)
        gold = np.zeros(B)
        de, dtr = np.zeros_like(e), np.zeros((K, K))
        for t in range(T):
            m = on[t]
            gold += np.where(m, e[t][rows, y[t]], 0)
            p = np.exp(al[t] + be[t] - z[:, None])
            p[rows, y[t]] -= 1
            de[t] = p * m[:, None]
            if t:
                gold += np.where(m, tr[y[t - 1], y[t]], 0)
                pair = np.exp(al[t - 1][:, :, None] + tr + (e[t] + be[t])[:, None, :] - z[:, None, None])
                dtr += (pair * m[:, None, None]).sum(axis=0)
                np.add.at(dtr, (y[t - 1][m], y[t][m]), -1)
        g = self._backward(ids, (de / B).astype(np.float32), keep)
        g["trans"] = (dtr / B).astype(np.float32)
        return float((z - gold).mean()), g

    def _backward(self, ids: np.ndarray, de: np.ndarray, keep: dict) -> dict[str, np.ndarray]:
        p, h, x = self.p, keep["h"], keep["x"]
        g = {"out": np.einsum("tbh,tbk->hk", h, de), "bias": de.sum(axis=(0, 1))}
        dh_all, dx = de @ p["out"].T, np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gwh = np.zeros_like(p[f"wh{d}"])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h0, c0, i, f, o, gg, tc, m in reversed(keep[d]):
                dh = dh + dh_all[t][:, part]
                do = m * dh * tc
                dct = dc + m * dh * o * (1 - tc * tc)
                dz = np.concatenate([m * dct * gg * i * (1 - i), m * dct * c0 * f * (1 - f), do * o * (1 - o), m * dct * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                gwh += h0.T @ dz
                dh = dz @ p[f"wh{d}"].T + (1 - m) * dh
                dc = dct * (m * f + (1 - m))
            g[f"wh{d}"] = gwh
            g[f"wx{d}"] = np.einsum("tbe,tbz->ez", x, dz_all)
            g[f"b{d}"] = dz_all.sum(axis=(0, 1))
            dx += dz_all @ p[f"wx{d}"].T
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], ids.T, dx)
        g["emb"][0] = 0
        return g

    def fit(self, ids: np.ndarray, tags: np.ndarray) -> None:
        """Adam over shuffled batches, with a fixed seed; few windows get more epochs."""
        r = np.random.default_rng(SEED)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, epochs = 0, max(EPOCHS, -(-STEPS // -(-len(ids) // BATCH)))
        for epoch in range(epochs):
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            order = r.permutation(len(ids))
            for i in range(0, len(ids), BATCH):
                _, g = self.loss(ids[order[i:i + BATCH]], tags[order[i:i + BATCH]])
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-8))
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def tag(self, parts: list[str]) -> list[np.ndarray]:
        """Tags of whole neighbourhoods: overlapping windows are scored, their
        scores averaged, and one Viterbi pass runs over each neighbourhood. Short
        ones go through in groups of like length, long ones alone and in blocks, so
        memory is bounded by ``CELLS`` places and a byte a tag of the longest one."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        while order:
            some = [order.pop()]  # the longest one left
            size = len(parts[some[0]])
            if size > LONG:
                out[some[0]] = self._tag_long(encode(parts[some[0]]))
                continue
            while order and len(some) < 256 and (len(some) + 1) * size <= CELLS and 2 * len(parts[order[-1]]) >= size:
                some.append(order.pop())
            for i, path in zip(some, self._tag_group([encode(parts[i]) for i in some])):
                out[i] = path
        return out

    def _emissions(self, spans: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
        """Averaged scores of the places a..b of each sequence, from all windows
        that hold one of them."""
        spots, rows = [], []
        total = [np.zeros((b - a, len(TAGS))) for _, a, b in spans]
        weight = [np.zeros((b - a, 1)) for _, a, b in spans]
        for i, (ids, a, b) in enumerate(spans):
            for s in range(max(0, (a - WINDOW) // STRIDE * STRIDE), max(1, len(ids) - WINDOW + STRIDE), STRIDE):
                if s >= b:
                    break
                w = ids[s:s + WINDOW]
                if s + len(w) > a:
                    spots.append((i, s, len(w)))
                    rows.append(np.pad(w, (0, WINDOW - len(w))))
        for k in range(0, len(rows), 512):
            e = self.scores(np.stack(rows[k:k + 512]))
            for (i, s, n), x in zip(spots[k:k + 512], e):
                _, a, b = spans[i]
                lo, hi = max(s, a), min(s + n, b)
                w = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1))[:, None].astype(float)[lo - s:hi - s]
                total[i][lo - a:hi - a] += w * x[lo - s:hi - s]
                weight[i][lo - a:hi - a] += w
        return [t / w for t, w in zip(total, weight)]

    def _tag_group(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        size = np.array([len(x) for x in seqs])
        e = np.zeros((int(size.max()), len(seqs), len(TAGS)))
        for b, x in enumerate(self._emissions([(x, 0, len(x)) for x in seqs])):
            e[:len(x), b] = x
        return [path[:n] for path, n in zip(self._viterbi(e, size), size)]

    def _tag_long(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long sequence: scores in blocks, one byte kept for each
        place and tag to find the way back."""
        n, K = len(ids), len(TAGS)
        tr = self.p["trans"].astype(np.float64)
        back = np.zeros((n, K), dtype=np.int8)
        best = None
        for a in range(0, n, BLOCK):
            for t, x in enumerate(self._emissions([(ids, a, min(n, a + BLOCK))])[0], a):
                if best is None:
                    best = x
                    continue
                s = best[:, None] + tr
                back[t] = s.argmax(axis=0)
                best = s.max(axis=0) + x
        path = np.empty(n, dtype=np.int64)
        cur = int(best.argmax())
        for t in range(n - 1, -1, -1):
            path[t] = cur
            cur = back[t, cur]
        return path

    def _viterbi(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        T, B, K = e.shape
        tr, best = self.p["trans"].astype(np.float64), e[0]
        back = np.zeros((T, B, K), dtype=np.int8)
        last = np.empty((T, B), dtype=np.int8)
        last[0] = best.argmax(axis=1)
        for t in range(1, T):
            s = best[:, :, None] + tr
            back[t] = s.argmax(axis=1)
            best = s.max(axis=1) + e[t]
            last[t] = best.argmax(axis=1)
        path, rows = np.zeros((B, T), dtype=np.int64), np.arange(B)
        cur = np.zeros(B, dtype=np.int64)
        for t in range(T - 1, -1, -1):
            cur = np.where(t == size - 1, last[t], cur)
            path[:, t] = cur
            cur = np.where(t <= size - 1, back[t][rows, cur], cur)
        return path


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the B I* runs."""
    out, i = [], 0
    while i < len(tags):
        t = int(tags[i])
        if t and t % 2:
            j = i + 1
            while j < len(tags) and tags[j] == t + 1:
                j += 1
            out.append((i, j, t // 2))
            i = j
        else:
            i += 1
    return out


def _variant(s: str, kind: int, r: np.random.Generator) -> str:
    """Another way to write a span of this kind, of those that change it."""
    if kind == 0:
        forms = [s.replace("@", " @ "), s.replace(".", " . "), s.replace("@", " @ ").replace(".", " . ")]
    elif kind == 1:
        forms = [s.replace(".", " . "), s.replace(".", "-"), s.replace(".", "[.]")]
    elif kind == 2:
        digits = s.replace(" ", "").replace("-", "")
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        forms = [sep.join(fours) for sep in (".", "  ", "/")]
    else:
        forms = [s.lstrip("+"), "00" + s.lstrip("+"), s.replace("-", "/"), s.replace(" ", ".")]
    forms = [f for f in forms if f != s] or [s]
    return forms[r.integers(len(forms))]


def _pieces(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(start, end, spans) of all neighbourhoods; long ones are cut, never inside a span."""
    starts = [s[0] for s in spans]
    reach = list(accumulate((s[1] for s in spans), max))
    out = []
    for a, b in regions(text):
        while a < b:
            z, i = min(b, a + PIECE), 0
            while (i := bisect_left(starts, z)) and reach[i - 1] > z and z < b:
                z = min(b, reach[i - 1])
            out.append((a, z, [s for s in spans[bisect_left(starts, a):i] if s[1] <= z]))
            a = z
    return out


def _training_order(pieces: list, r: np.random.Generator) -> list:
    """Pieces with spans first, their kinds in turn, every fourth one without."""
    pieces = [pieces[i] for i in r.permutation(len(pieces))]
    kinds = [[i for i, p in enumerate(pieces) if any(s[2] == k for s in p[2])] for k in range(len(KINDS))]
    held = list(dict.fromkeys(i for row in zip_longest(*kinds) for i in row if i is not None))
    bare = [i for i, p in enumerate(pieces) if not p[2]]
    out = []
    while held or bare:
        out += held[:3] + bare[:1]
        held, bare = held[3:], bare[1:]
    return [pieces[i] for i in out]


def text_windows(text: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """At most ``TEXT_WINDOWS`` windows (ids, tags) of one text; half keep the text, half rewrite spans."""
    r = np.random.default_rng([SEED, zlib.crc32(text.encode("utf-8", "replace"))])
    ids, tags = [], []
    for a, b, here in _training_order(_pieces(text, base_spans(text)), r):
        for rewrite in ((False, True) if here else (False,)):
            out, marks, at = "", [], a
            for x, y, kind in here:
                if x < at:
                    continue
                out += text[at:x]
                v = _variant(text[x:y], kind, r) if rewrite else text[x:y]
                marks.append((len(out), len(out) + len(v), kind))
                out += v
                at = y
            out += text[at:b]
            y = np.zeros(len(out), dtype=np.int64)
            for x, z, kind in marks:
                y[x:z] = 2 * kind + 2
                y[x] = 2 * kind + 1
            e = encode(out)
            for s in range(0, max(1, len(out) - WINDOW + STRIDE), STRIDE):
                n = len(e[s:s + WINDOW])
                ids.append(np.pad(e[s:s + WINDOW], (0, WINDOW - n)))
                tags.append(np.pad(y[s:s + WINDOW], (0, WINDOW - n)))
                if len(ids) == TEXT_WINDOWS:
                    return ids, tags
    return ids, tags


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (ids, tags) around triggers of all texts."""
    parts = [text_windows(t) for t in texts]
    ids, tags = ([w for p in parts for w in p[i]] for i in (0, 1))
    return (np.stack(ids), np.stack(tags)) if ids else (np.empty((0, WINDOW), np.int64),) * 2


def train(docs: DataFrame, text_col: str = "text", texts: int = TRAIN_TEXTS) -> Tagger | None:
    """Fit on the base spans of at most ``texts`` texts with a digit or an at sign."""
    ship(docs.sparkSession)
    seen = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9]{3}|@|[0-9]\\.[0-9]")).withColumn("h", F.xxhash64("text", F.lit(SEED)))
    # the hashes first (8 bytes a row), then the texts they stand for, each once
    marks = seen.select("h", *[F.col("text").rlike(p).alias(k) for k, p in zip(KINDS, _HINTS)])
    marks = marks.groupBy("h").agg(*[F.max(k).alias(k) for k in KINDS]).persist()
    try:
        picked: dict[int, None] = {}
        for k in KINDS:
            picked.update((r["h"], None) for r in marks.filter(k).select("h").orderBy("h").limit(texts // (len(KINDS) + 1)).collect())
        for r in marks.select("h").orderBy("h").limit(texts).collect():
            if len(picked) < texts:
                picked[r["h"]] = None
    finally:
        marks.unpersist()
    if not picked:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            rows = []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h not in done:
                    done.add(h)
                    ids, tags = text_windows(t)
                    rows.append((h, np.array(ids, np.uint8).tobytes(), np.array(tags, np.uint8).tobytes()))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()))], ["h", "ids", "tags"])

    rows = (
        seen.filter(F.col("h").isin(list(picked))).select("h", "text").mapInArrow(run, "h long, ids binary, tags binary")
        .groupBy("h").agg(F.min(F.struct("ids", "tags")).alias("w")).orderBy("h").collect()
    )
    ids, tags = (np.frombuffer(b"".join(bytes(r["w"][c]) for r in rows), np.uint8).astype(np.int64).reshape(-1, WINDOW) for c in ("ids", "tags"))
    if not (tags > 0).any():
        return None
    t = Tagger()
    t.fit(ids, tags)
    return t


def find(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the number of base spans of each kind,
    base (array of kind:start:end), spans (base and added ones), n_added."""
    ship(docs.sparkSession)
    weights = model.p if model else None
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans", "n_added"]
    show = lambda s: f"{KINDS[s[2]]}:{s[0]}:{s[1]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights) if weights else None
        for b in batches:
            base, where, parts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                base.append(base_spans(t))
                if tagger:
                    for x, y in regions(t):
                        where.append((i, x))
                        parts.append(t[x:y])
            added: list[list[tuple[int, int, int]]] = [[] for _ in base]
            for (i, at), tags in zip(where, tagger.tag(parts) if parts else []):
                added[i] += [(at + x, at + y, k) for x, y, k in spans_of(tags)]
            every = []
            for own, more in zip(base, added):
                end, fresh = 0, []
                taken = sorted((x, y) for x, y, _ in own)
                j = 0
                for s in sorted(more):
                    while j < len(taken) and taken[j][1] <= s[0]:
                        j += 1
                    if s[0] >= end and s[1] - s[0] > 2 and not any(x < s[1] and s[0] < y for x, y in taken[j:j + 8]):
                        fresh.append(s)
                        end = s[1]
                every.append((sorted(own + fresh, key=lambda s: (s[0], s[2])), len(fresh)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))],
                 pa.array([[show(s) for s in x] for x in base], pa.list_(pa.string())), pa.array([[show(s) for s in x[0]] for x in every], pa.list_(pa.string())),
                 pa.array([x[1] for x in every], pa.int64())], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, spans array<string>, n_added long")


def base_digest(text: str) -> str:
    """sha256 of the base spans of one text, as the query gives it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in base_spans(text)).encode()).hexdigest()
