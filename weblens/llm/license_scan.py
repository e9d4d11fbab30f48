"""License scan: exact notices, and fuzzy ones by pigeonhole seeds.

A notice with at most ``k`` edits, cut into ``k + 1`` pieces, holds one piece
unchanged. So every fuzzy place lies around an exact hit of some piece: the
pieces are searched as plain byte strings in the normalised text (words joined
by one space), and only the neighbourhoods of their hits go to the regex
library, whose bounded-error matching decides and gives the span. Each
neighbourhood is searched on its own, before and behind the best match in it
too; of matches that overlap, exact ones included, the better one counts.

Defined results: a null or empty text has no words, no places, score 0 and
empty label strings; a text is scanned whole whatever its length; rows are
handled one by one, so repeated rows, ties and other columns change nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.textops import ALNUM_LOWER, buffers
from weblens.session import ship

#: FIXED VALUES: base phrases and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further short notices, with labels of their own: names, first words of licence
#: texts and SPDX lines as they read once lower-cased and without punctuation.
MORE_NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd 2 clause license": "bsd",
    "bsd 3 clause license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute": "isc",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache",
    "spdx license identifier gpl": "gpl",
    "spdx license identifier bsd": "bsd",
    "spdx license identifier mpl": "mpl",
}
#: Characters per allowed edit: a notice of n characters may differ by n // 8.
CHARS_PER_EDIT = 8
_SEEN_MAX = 10_000

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"


def edits_allowed(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice cut into k + 1 pieces of near equal length, with offsets."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def _compiled(notices: tuple[tuple[str, str], ...]) -> list:
    out = []
    for phrase, label in notices:
        k = edits_allowed(phrase)
        rx = regex.compile(rb"(?be) (?:%s){e<=%d}(?= )" % (regex.escape(phrase.encode(), special_only=True), k)) if k else None
        out.append((phrase, label, k, [(o, s.encode()) for o, s in pieces(phrase, k)], rx))
    return out


def _places(norm: bytes, needle: bytes) -> list[int]:
    """All places of a byte string, overlapping ones too."""
    out, i = [], norm.find(needle)
    while i >= 0:
        out.append(i)
        i = norm.find(needle, i + 1)
    return out


def _fuzzy(norm: bytes, phrase: str, k: int, seeds: list, rx) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the non-overlapping best matches with 1..k edits,
    as byte offsets of whole words in ``norm``."""
    near: list[list[int]] = []
    for at in sorted({h - o for o, s in seeds for h in _places(norm, s)}):
        if near and at <= near[-1][0] + k:  # seeds of one match differ by its edits
            near[-1][1] = at
        else:
            near.append([at, at])
    found: set[tuple[int, int, int]] = set()
    seen: dict[bytes, list] = {}
    for first, last in near:
        # whole words only: widen to the spaces around
        lo, hi = max(0, first - k - 1), min(len(norm), last + len(phrase) + k + 2)
        lo, hi = max(0, norm.rfind(b" ", 0, lo + 1)), norm.find(b" ", hi - 1)
        around = norm[lo:len(norm) if hi < 0 else hi + 1]
        hits = seen.get(around)  # texts that are dense in notices repeat their neighbourhoods
        if hits is None:
            hits, parts = [], [(0, len(around))]
            while parts:
                a, z = parts.pop()
                m = rx.search(around, a, z)
                if m and m.start() + 1 < m.end():
                    hits.append((sum(m.fuzzy_counts), m.start(), m.end()))
                    parts += [(a, m.start() + 1), (m.end(), z)]
            if len(seen) < _SEEN_MAX:
                seen[around] = hits
        found.update((e, lo + a, lo + z) for e, a, z in hits)
    out: list[tuple[int, int, int]] = []
    for e, a, z in sorted(found):
        i = bisect_left(out, (a, z, e))
        if (i == len(out) or out[i][0] >= z) and (i == 0 or out[i - 1][1] <= a):
            out.insert(i, (a, z, e))
    return [(a + 1, z, e) for a, z, e in out if e]


def scan_text(data: bytes, notices: tuple[tuple[str, str], ...], more: tuple[tuple[str, str], ...] = ()) -> tuple:
    """(n_words, n_base, first, last, base labels, labels, score, spans) of one
    text; the places of ``more`` count for labels, score and spans only."""
    ws = data.translate(ALNUM_LOWER).split()
    norm = b" " + b" ".join(ws) + b" "
    base, score, spans, exact = set(), 0.0, [], []
    spaces: list[np.ndarray] = []

    def word_at(at: int) -> int:
        """Number of the word behind the space at ``at``; the spaces are listed once."""
        if not spaces:
            spaces.append(np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 0x20))
        return int(np.searchsorted(spaces[0], at))

    for i, (phrase, label, k, seeds, rx) in enumerate(_compiled(notices + more)):
        size = phrase.count(" ") + 1
        for at in _places(norm, b" %s " % phrase.encode()):
            w = word_at(at)
            if i < len(notices):
                exact.append(w)
                base.add(label)
            spans.append((label, w, w + size - 1, 0))
            score = 1.0
        if rx is None or not any(s in norm for _, s in seeds):
            continue
        for a, b, e in _fuzzy(norm, phrase, k, seeds, rx):
            w = word_at(a) - 1
            spans.append((label, w, w + norm.count(b" ", a, b), e))
            score = max(score, 1.0 - e / len(phrase))
    labels = {s[0] for s in spans}
    spans = sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))
    return len(ws), len(exact), min(exact, default=None), max(exact, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None,
         more: dict[str, str] | None = None) -> DataFrame:
    """One row per document: word count, exact places, labels (exact and
    fuzzy), score (1 for an exact place, else 1 - edits / length of the best
    fuzzy one) and all spans in words."""
    ship(docs.sparkSession)
    table, further = tuple((notices or NOTICES).items()), tuple((MORE_NOTICES if more is None else more).items())
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
             pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(x.tobytes(), table, further) for x in buffers(b.column(1))]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            cols[-1] = [[dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in r] for r in cols[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
