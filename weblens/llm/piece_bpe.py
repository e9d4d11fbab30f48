"""SentencePiece (merge type) encoding and decoding by a prefix table.

For a text without vocabulary boundaries, the encoding of each of its prefixes
ends in exactly one token. The table holds that last token for every prefix:
an Aho-Corasick automaton lists all tokens that end at a place, and the right
one is the token whose pairing with the last token of the prefix before it
survives the merges (a pair is compatible if encoding the two strings together
gives the two tokens again). The ids are then read off backwards.

No token holds a space mark after another character, and characters outside
the vocabulary never merge; so a text falls into chunks (spaces and the
characters after them, line ends) that encode independently. Chunks repeat, so
each worker keeps a bounded table of those it has seen.

Defined results: a null text is empty and gives no ids; a text of any length is
encoded whole; repeated rows, ties and other columns change nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.session import ship

MARK = "▁"
_KNOWN_MAX = 300_000
_PAIRS_MAX = 600_000
_ENCODERS: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Encoder and decoder for one model file of merge type."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unused(i)}
        self.unk = sp.unk_id()
        plain = [i for i in range(n) if i not in self.byte_of and i not in self.special and i != self.unk]
        self.id_of = {self.piece[i]: i for i in plain}
        self.rank = {self.piece[i]: -sp.get_score(i) for i in plain}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.id_of):
            raise ValueError("a piece holds a space mark after another character: chunks would not be independent")
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.auto = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, str]] = {}
        # line ends outside the vocabulary are chunks of their own
        self.chunks = re.compile(" *[^ \n]+| +|\n").findall if "\n" not in self.chars else re.compile(" *[^ ]+| +").findall

    def merges(self, s: str) -> list[str]:
        """Plain merging: join the best pair, leftmost first, until none is left."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a`` in an encoding."""
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= _PAIRS_MAX:
                self.pairs.clear()
            x, y = self.piece[a], self.piece[b]
            ok = self.pairs[key] = self.merges(x + y) == [x, y]
        return ok

    def alone(self, b: int) -> bool:
        """Whether a token's own string encodes to it."""
        key = (-1, b)
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = self.merges(self.piece[b]) == [self.piece[b]]
        return ok

    def _run(self, s: str) -> list[int]:
        """Ids of a string of vocabulary characters."""
        n = len(s)
        last = [0] * (n + 1)  # token that ends each prefix
        size = [0] * (n + 1)
        done = 0
        pairs = self.pairs
        for end, (tok, m) in self.auto.iter(s):
            e = end + 1
            if e <= done:  # this prefix has its token
                continue
            at = e - m
            if at:
                p = last[at]
                ok = pairs.get((p, tok))
                if ok is None:
                    ok = self.compatible(p, tok)
            else:
                ok = self.alone(tok)
            if ok:
                last[e], size[e], done = tok, m, e
        if done != n:
            raise ValueError(f"prefix {done} of {n} characters has no last token")
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        run = ""
        for c in chunk:
            if c in self.chars:
                run += c
                continue
            if run:
                out += self._run(run)
                run = ""
            out += [self.byte_id[b] for b in c.encode("utf-8")] if self.byte_id else [self.unk]
        return out + self._run(run) if run else out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library gives them without extra ids."""
        if not text:
            return []
        out: list[int] = []
        for c in self.chunks(" " + text.replace(MARK, " ")):
            out += self.encode_chunk(c.replace(" ", MARK))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, byte ids as UTF-8 (broken bytes become
        U+FFFD each), space marks as spaces without the one that encoding adds."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(raw))
                raw.clear()
            if i not in self.special:
                out.append(self.piece[i])
        if raw:
            out.append(_utf8(raw))
        s = "".join(out)
        if s.startswith(MARK):
            s = s[1:]
        return s.replace(MARK, " ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text)."""
        n, ids, parts = 0, [], []
        known = self.known
        for c in self.chunks(" " + text.replace(MARK, " ")) if text else ():
            k = known.get(c)
            if k is None:
                if len(known) >= _KNOWN_MAX:
                    known.clear()
                got = self.encode_chunk(c.replace(" ", MARK))
                # the mark before a chunk's first character is kept by a stand-in, taken off below
                k = known[c] = (len(got), ",".join(map(str, got)), self.decode([self.id_of[MARK], *got]))
            n += k[0]
            ids.append(k[1])
            parts.append(k[2])
        decoded = "".join(parts)
        if decoded.startswith(" "):
            decoded = decoded[1:]
        return n, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _utf8(raw: bytearray) -> str:
    """UTF-8 text; every byte that is not part of a character becomes U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for m in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + m].decode("utf-8"))
                i += m
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def encoder(model_file: str) -> PieceEncoder:
    """The process's encoder for a model file; the file goes to the executors
    with ``addFile`` and is found there by its name."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = PieceEncoder(model_file)
    return _ENCODERS[model_file]


def _ship_model(docs: DataFrame, model_file: str) -> str:
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    sc.addFile(model_file)
    return model_file.rsplit("/", 1)[-1]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded text of every row."""
    name = _ship_model(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids and
    decoded texts are hashed where they are made."""
    name = _ship_model(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            rows = [enc.digest(t or "") for t in b.column(1).to_pylist()]
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
