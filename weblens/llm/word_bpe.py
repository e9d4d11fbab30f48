"""Byte-pair encoding with word ends, by a contiguous array of ranks.

A text is cut at the special tokens it spells out, each section is normalised
(composed, white space to spaces, lower case) and cut into words, and a word's
bytes become symbols, the last one marked as the word's end. For a short word
arrays lie side by side: the boundaries of its parts with their ids, and for each
part the rank of the merge with the next one. The smallest rank (leftmost first) is
found by a scan, its boundary is deleted, and only the ranks of the two
neighbours are looked up again, until no part has a rank. Words of more than
``SHORT`` symbols take the same merges from a heap, so time stays near linear
in the word. Words repeat, so each worker keeps a bounded table of the short
ones it has seen.

Ranks come from the tokenizer file, whose path is a parameter. The character
classes are asked from the tokenizers library's own regex once, on the driver,
so that both use the same edition of Unicode; texts with characters newer than
Python's tables are normalised by the library.

Defined results: a null text is empty and gives no ids; a text of any length is
encoded whole; repeated rows, ties and other columns change nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.session import ship

SHORT = 64
_KNOWN_MAX = 500_000
_NONE = 1 << 60
_ROWS = 1 << 16
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")
_ENCODERS: dict[tuple, WordEncoder] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it,
    else the next free character from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


def character_classes() -> dict[str, str]:
    """Ranges of letters, numbers and white space as the library's regex sees
    them, written as the inside of a character class."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    out = {}
    for name, cls in (("letter", r"[\p{L}]+"), ("number", r"[\p{N}]+"), ("space", r"\s+")):
        runs = Split(Regex(cls), "removed", invert=True).pre_tokenize_str(every)
        # offsets count characters of the string of all points
        out[name] = "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for _, (a, b) in runs)
    return out


class WordEncoder:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str, classes: dict[str, str] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.id_of: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: rank of a pair of ids, and the id that its merge gives
        self.rank = {self.id_of[a] << 32 | self.id_of[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [self.id_of[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (*self.id_of.items(), *self.special.items())}
        self.symbol = byte_symbols()
        self.byte = {s: b for b, s in enumerate(self.symbol)}
        if any(s not in self.id_of or s + self.suffix not in self.id_of for s in self.symbol):
            raise ValueError("the vocabulary lacks a byte: unknown symbols are not handled")
        self.inner = [self.id_of[s] for s in self.symbol]
        self.last = [self.id_of[s + self.suffix] for s in self.symbol]
        c = classes or character_classes()
        # the contractions of the tokenizer's own pattern, then letters, one number, others
        head = "'s|'t|'re|'ve|'m|'ll|'d"
        self.words = re.compile(f"{head}|[{c['letter']}]+|[{c['number']}]|[^{c['space']}{c['letter']}{c['number']}]+").findall
        self.ascii_words = re.compile(rf"{head}|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+").findall
        self.sections = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known: dict[str, tuple[int, str, str]] = {}  # of runs without white space
        self.words_known: dict[str, tuple[int, str, str]] = {}

    # --- merging

    def _scan(self, parts: list[int]) -> tuple[list[int], list[int]]:
        """Merges of a short word: (id of each part, byte at which it starts).
        Three arrays lie side by side: starts, ids, and the rank of each part's
        merge with the next one."""
        rank, merged = self.rank.get, self.merged
        starts = list(range(len(parts)))
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            # delete the boundary between the parts i and i + 1
            del starts[i + 1], parts[i + 1], ranks[i]
            new = parts[i] = merged[low]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], _NONE)
        return parts, starts

    def _heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: linked parts and a heap of ranks."""
        rank, merged, n = self.rank.get, self.merged, len(parts)
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if parts[i] < 0 or nxt[i] != j or rank(parts[i] << 32 | parts[j]) != r:
                continue
            parts[i], parts[j] = merged[r], -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
                if (q := rank(parts[i] << 32 | parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (q, i, nxt[i]))
            if prev[i] >= 0 and (q := rank(parts[prev[i]] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (q, prev[i], i))
        return [p for p in parts if p >= 0]

    def symbols(self, word: str) -> list[int]:
        """Ids of a word's bytes, the last one marked as the word's end."""
        raw = word.encode("utf-8")
        inner = self.inner
        parts = [inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return parts

    def encode_word(self, word: str) -> list[int]:
        parts = self.symbols(word)
        return self._scan(parts)[0] if len(parts) <= SHORT else self._heap(parts)

    # --- texts

    def _split(self, section: str) -> list[str]:
        if section.isascii():
            return self.ascii_words(section.lower())
        if _newer().search(section):
            from tokenizers import normalizers

            text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(section)
        else:
            text = unicodedata.normalize("NFC", section).replace("Σ", "σ").lower()  # lower case letter by letter: no final sigma
        return self.words(text)

    def _cut(self, text: str) -> Iterator[tuple[str, bool]]:
        """(words or special tokens, whether special) in order."""
        if self.sections is None or "<" not in text:
            for w in self._split(text):
                yield w, False
            return
        for s in self.sections(text):
            if s in self.special:
                yield s, True
            else:
                for w in self._split(s):
                    yield w, False

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library gives them without added tokens."""
        out: list[int] = []
        for w, special in self._cut(text):
            out += [self.special[w]] if special else self.encode_word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids for a file without a decoder: tokens with a space between."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def plain_text(self, ids: list[int]) -> str:
        """Words of ids as readable text, one space after each."""
        raw = bytearray()
        for i in ids:
            t = self.token.get(i, "")
            if t in self.special:
                raw += t.encode() + b" "
                continue
            end = bool(self.suffix) and t.endswith(self.suffix)
            raw += bytes(self.byte[c] for c in (t[:-len(self.suffix)] if end else t))
            raw += b" " * end
        return raw.decode("utf-8", "replace").rstrip(" ")

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """(number of ids, ids, tokens) of a run without white space; no word,
        composition or change of case reaches beyond one."""
        rows = []
        for w in self._split(chunk):
            row = self.words_known.get(w)
            if row is None:
                ids = self.encode_word(w)
                row = (len(ids), " ".join(map(str, ids)), self.decode(ids))
                if len(w) <= SHORT:
                    if len(self.words_known) >= _KNOWN_MAX:
                        self.words_known.clear()
                    self.words_known[w] = row
            rows.append(row)
        got = rows[0] if len(rows) == 1 else (sum(r[0] for r in rows), " ".join([r[1] for r in rows]), " ".join([r[2] for r in rows]))
        if len(chunk) <= SHORT:
            if len(self.known) >= _KNOWN_MAX:
                self.known.clear()
            self.known[chunk] = got
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text)."""
        total, first = 0, True
        ids, toks = hashlib.sha256(), hashlib.sha256()
        known = self.known.get
        for section in self.sections(text) if self.sections and "<" in text else (text,):
            if section in self.special:
                rows = [(1, str(self.special[section]), section)]
            elif _SEPARATORS.search(section):  # white space to Python's split, but not to the tokenizer
                rows = [self._chunk(c) for c in _SPACES.split(section) if c]
            else:
                rows = [known(c) or self._chunk(c) for c in section.split()]
            for i in range(0, len(rows), _ROWS):
                n, a, b = zip(*rows[i:i + _ROWS])
                head = "" if first else " "
                first = False
                total += sum(n)
                ids.update((head + " ".join(a)).encode())
                toks.update((head + " ".join(b)).encode())
        return total, ids.hexdigest(), toks.hexdigest()


_NEWER: list = []


def _newer() -> re.Pattern:
    """Characters that Python's tables do not know yet (noncharacters and
    private ones aside, which no edition changes)."""
    if not _NEWER:
        runs, start = [], None
        for c in range(0x80, sys.maxunicode + 2):
            new = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
            if new and start is None:
                start = c
            elif not new and start is not None:
                runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        _NEWER.append(re.compile("[" + "".join(runs) + "]"))
    return _NEWER[0]


def encoder(path: str, classes: dict[str, str]) -> WordEncoder:
    """The process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, classes)
    return _ENCODERS[path]


def _ship_file(docs: DataFrame, path: str) -> str:
    """Send package and tokenizer file to the executors; the file is found
    there by its name."""
    ship(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _column(b: pa.RecordBatch) -> Iterator[str]:
    """Texts of a batch, a few hundred at a time as Python strings; null is empty."""
    for i in range(0, b.num_rows, 256):
        for t in b.column(1).slice(i, 256).to_pylist():
            yield t or ""


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of every row."""
    name, classes = _ship_file(docs, path), character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name), classes)
        for b in batches:
            ids = [enc.encode(t) for t in _column(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids and
    decoded texts are hashed where they are made."""
    name, classes = _ship_file(docs, path), character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name), classes)
        for b in batches:
            rows = [enc.digest(t) for t in _column(b)]
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
