"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file, from what it says itself, and composed
with each input:

  normaliser     rewrites the longest run of characters that the model's character map has, at
                 each place, drops or keeps extra spaces, puts the dummy prefix before a text
                 and writes spaces as the piece mark, all as the model's own specification asks
  pieces         reads characters and writes pieces
  byte fallback  writes a character that no piece has as its UTF-8 bytes' pieces, or as the
                 unknown piece in models without them

The segmentation is the path of least weight in the tropical semiring (minimum of sums).
In a unigram model an arc weighs the piece's negative score, an unknown character ten more
than the worst piece, and the state is the place in the text; ties go to the longer last
piece, as in the model.  In a model that merges best pairs first the state is also the piece
last written, and an arc from piece a to piece b weighs 0 if the model would leave a next
to b, and infinity if one of its merges would cross the border between them; so the only
path of finite weight is the model's own segmentation.  Where no piece of such a model
reaches across from one kind of character to the next, neither does a merge, so a text is
composed chunk by chunk.  Other kinds of models are refused.

Defined cases: null and empty texts have no tokens and decode to the empty text; a
literal piece mark in a text reads as a space; ties between equal merge scores go to the left,
as in the model; repeated rows are encoded row by row.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

MARK = "▁"
#: ASCII signs, ASCII letters and digits, or other characters next to either, behind any spaces.
_SIGN = r"\x00-\x09\x0b-\x1f\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f"
_OTHER = r"\u0180-\U0010ffff\x80-\xbf\xd7\xf7"
CHUNK = re.compile(rf" *+[^ \n{_SIGN}{_OTHER}]++(?![{_OTHER}])| *+[{_SIGN}]++(?![{_OTHER}])| *[^ \n]*[{_OTHER}][^ \n]*| +|\n")
BORDER = re.compile(rf"\n|[^ ] |[^ {_SIGN}{_OTHER}][{_SIGN}]|[{_SIGN}][^ {_SIGN}{_OTHER}]")
#: Chunks that a worker remembers, and the longest one.
MEMORY, LONGEST = 300_000, 64
#: States of a prefix of a chunk besides a piece's number.
UNKNOWN, START, UNSEEN = -1, -2, -3
INFINITY = float("inf")
#: Fixed values of the model format: kinds of models and of pieces, and how much worse than the worst piece an unknown one is.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN_PIECE, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " \u2047 "


def message(raw: bytes) -> dict[int, list]:
    """The fields of a serialised message by number: integers, 32-bit floats, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        elif tag & 7 == 5:
            value = struct.unpack_from("<f", raw, at)[0]
            at += 4
        elif tag & 7 == 1:
            value = struct.unpack_from("<d", raw, at)[0]
            at += 8
        else:
            n = varint()
            value = raw[at : at + n]
            at += n
        out.setdefault(tag >> 3, []).append(value)
    return out


def character_map(raw: bytes) -> dict[str, str]:
    """What a precompiled character map rewrites: a double-array trie of UTF-8 keys, then the replacements."""
    if not raw:
        return {}
    size = struct.unpack_from("<I", raw)[0]
    units = np.frombuffer(raw, "<u4", size // 4, 4)
    texts = raw[4 + size :]
    labels = units & np.uint32(0x800000FF)
    signs = np.arange(1, 256)
    below = lambda unit: (int(unit) >> 10) << ((int(unit) & 0x200) >> 6)
    rules, stack = {}, [(below(units[0]), b"")]
    while stack:
        base, key = stack.pop()
        at = base ^ signs
        at = at[at < len(units)]
        for k in at[labels[at] == (at ^ base)]:
            unit, name = units[k], key + bytes([int(k) ^ base])
            child = int(k) ^ below(unit)
            if unit >> 8 & 1:
                first = int(units[child]) & 0x7FFFFFFF
                rules[name.decode()] = texts[first : texts.index(b"\0", first)].decode()
            stack.append((child, name))
    return rules


class Normaliser:
    """The transducer from a text to what the pieces read; spaces stand for the piece mark."""

    def __init__(self, spec: dict[int, list]):
        said = lambda number, otherwise: bool(spec.get(number, [otherwise])[-1])
        if not said(5, True):
            raise ValueError("models that keep spaces as they are aren't supported")
        self.prefix, self.drops_spaces = said(3, True), said(4, True)
        self.rules = character_map(spec.get(2, [b""])[-1])
        self.first = {k[0] for k in self.rules}
        self.longest = max(map(len, self.rules), default=0)

    def parts(self, text: str):
        """The text in the runs that the map rewrites as one."""
        i = 0
        while i < len(text):
            n = 1
            if text[i] in self.first:
                n = next((n for n in range(min(self.longest, len(text) - i), 0, -1) if text[i : i + n] in self.rules), 1)
            run = text[i : i + n]
            yield self.rules.get(run, run)
            i += n

    def __call__(self, text: str) -> str:
        if not self.rules and not self.drops_spaces:
            out = text
        else:
            parts, after_space = [], self.drops_spaces
            for part in self.parts(text) if self.rules else text:
                if after_space:
                    part = part.lstrip(" ")
                if part:
                    parts.append(part)
                    after_space = self.drops_spaces and part.endswith(" ")
            out = "".join(parts)
        out = out.replace(MARK, " ")
        if self.drops_spaces:
            out = out.rstrip(" ")
        return " " + out if self.prefix and out else out


class PieceTransducer:
    """The composed transducer of a unigram or pair-merging model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = message(f.read())
        trainer, spec = (message(model.get(i, [b""])[-1]) for i in (2, 3))
        self.type = trainer.get(3, [UNIGRAM])[-1]
        if self.type not in (UNIGRAM, BPE):
            raise ValueError(f"models of type {self.type} aren't supported")
        if trainer.get(24, [0])[-1]:
            raise ValueError("models with the mark behind words aren't supported")
        self.normalise = Normaliser(spec)
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text_of: list[bytes] = []
        self.bytes_of = np.zeros(256, np.int64)
        self.is_byte = np.zeros(len(model[1]), bool)
        self.unknown = 0
        for i, raw in enumerate(model[1]):
            entry = message(raw)
            piece, kind = entry[1][-1].decode(), entry.get(3, [NORMAL])[-1]
            if kind == USER_DEFINED:
                raise ValueError("models with pieces of the user's own aren't supported")
            if kind == BYTE:
                value = int(piece[3:5], 16)
                self.bytes_of[value], self.is_byte[i] = i, True
                self.text_of.append(bytes([value]))
            elif kind == NORMAL:
                plain = piece.replace(MARK, " ")
                self.pieces[plain], self.score[plain] = i, entry.get(2, [0.0])[-1]
                self.text_of.append(plain.encode())
            else:
                self.text_of.append(UNKNOWN_TEXT.encode() if kind == UNKNOWN_PIECE else b"")
                if kind == UNKNOWN_PIECE:
                    self.unknown = i
        self.falls_back = bool(self.is_byte.any())
        self.chunks = CHUNK if self.type == BPE and not any(map(BORDER.search, self.pieces)) else re.compile(r"(?s).+")
        self.names = {i: p for p, i in self.pieces.items()}
        self.derived: dict[str, tuple] = {}
        self.weights: dict[int, float] = {}
        self.known: dict[str, bytes] = {}
        self.best_path = self.shortest_path if self.type == BPE else self.lightest_path
        # the trie of all pieces; of a merging model, of those that it would make out of their own characters
        self.nodes: dict[str, int] = {}
        for piece, i in self.pieces.items():
            for n in range(1, len(piece)):
                self.nodes.setdefault(piece[:n], UNKNOWN)
            if self.type == UNIGRAM or self.derivation(piece)[1][-1] == piece:
                self.nodes[piece] = i
        # weights are 32-bit numbers, as in the model
        self.weight_of = {i: np.float32(-self.score[p]) for p, i in self.pieces.items()}
        self.unknown_weight = np.float32(-min(self.score.values(), default=0.0)) + np.float32(UNKNOWN_PENALTY)

    def derivation(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """The scores of the merges that make the piece, and its left and right ends before and after each."""
        got = self.derived.get(piece)
        if got is None:
            parts = list(piece)
            scores, left, right = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = -INFINITY, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1], -INFINITY)
                    if s > best:
                        best, at = s, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                left.append(parts[0])
                right.append(parts[-1])
            got = self.derived[piece] = (scores, left, right)
        return got

    def weight(self, a: str, b: str) -> float:
        """The weight of the arc from piece a to piece b: infinite if a merge would cross."""
        scores_a, _, right = self.derivation(a)
        scores_b, left, _ = self.derivation(b)
        i = j = 0
        while True:
            cross = self.score.get(right[i] + left[j], -INFINITY)
            next_a = scores_a[i] if i < len(scores_a) else -INFINITY
            next_b = scores_b[j] if j < len(scores_b) else -INFINITY
            if cross > next_a and cross >= next_b:
                return INFINITY
            if next_a == next_b == -INFINITY:
                return 0.0
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def shortest_path(self, chunk: str) -> list[tuple[int, int]]:
        """The arcs of the path of least weight, as (piece, where it starts); a character without a piece is UNKNOWN."""
        nodes, weights, n = self.nodes, self.weights, len(chunk)
        last, back = [UNSEEN] * (n + 1), [0] * (n + 1)
        last[0] = START
        for start in range(n):
            a = last[start]
            if a == UNSEEN:
                a, back[start] = UNKNOWN, start - 1
                last[start] = a
            for end in range(start + 1, n + 1):
                i = nodes.get(chunk[start:end])
                if i is None:
                    break
                if i >= 0 and last[end] == UNSEEN:
                    if a >= 0:
                        w = weights.get(a << 20 | i)
                        if w is None:
                            w = self.weight(self.names[a], self.names[i])
                            if len(weights) < 4 * MEMORY:
                                weights[a << 20 | i] = w
                    else:
                        w = 0.0 if a == START else self.weight(chunk[back[start] : start], self.names[i])
                    if w == 0.0:
                        last[end], back[end] = i, start
        if last[n] == UNSEEN:
            last[n], back[n] = UNKNOWN, n - 1
        path, at = [], n
        while at:
            path.append((last[at], back[at]))
            at = back[at]
        return path[::-1]

    def lightest_path(self, chunk: str) -> list[tuple[int, int]]:
        """The same for a unigram model, whose arcs weigh what their pieces do."""
        nodes, n = self.nodes, len(chunk)
        least: list = [None] * (n + 1)
        last, back = [UNKNOWN] * (n + 1), [0] * (n + 1)
        least[0] = np.float32(0)
        for start in range(n):
            here, single = least[start], False
            for end in range(start + 1, n + 1):
                i = nodes.get(chunk[start:end])
                if i is None:
                    break
                if i >= 0:
                    single |= end == start + 1
                    w = here + self.weight_of[i]
                    if least[end] is None or w < least[end]:
                        least[end], last[end], back[end] = w, i, start
            if not single:
                w = here + self.unknown_weight
                if least[start + 1] is None or w < least[start + 1]:
                    least[start + 1], last[start + 1], back[start + 1] = w, UNKNOWN, start
        path, at = [], n
        while at:
            path.append((last[at], back[at]))
            at = back[at]
        return path[::-1]

    def transduce(self, chunk: str) -> bytes:
        """The ids of a chunk, as little-endian unsigned 32-bit numbers."""
        ids: list[int] = []
        for i, start in self.best_path(chunk):
            if i != UNKNOWN:
                ids.append(i)
            elif self.falls_back:
                ids += self.bytes_of[list(chunk[start].encode())].tolist()
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)  # one for a run of unknown characters
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known, parts = self.known, []
        for chunk in self.chunks.findall(self.normalise(text)):
            got = known.get(chunk)
            if got is None:
                got = self.transduce(chunk)
                if len(known) < MEMORY and len(chunk) <= LONGEST:
                    known[chunk] = got
            parts.append(got)
        return b"".join(parts)

    def decode(self, ids) -> str:
        """The text of ids: pieces' characters and bytes in order, less the dummy prefix."""
        parts = [self.text_of[i] for i in ids]
        if self.normalise.prefix or self.normalise.drops_spaces:
            for k, i in enumerate(ids):
                if self.is_byte[i] or i == self.unknown:
                    break
                bare = parts[k].removeprefix(b" ")
                # the first mark is the dummy prefix; where spaces are dropped, each piece that begins the text loses one
                seen = len(bare) < len(parts[k]) and not self.normalise.drops_spaces
                parts[k] = bare
                if bare or seen:
                    break
        return b"".join(parts).decode("utf-8", "replace")


_COMPILED: dict[str, PieceTransducer] = {}


def compiled(path: str) -> PieceTransducer:
    """One transducer a worker process; what it remembers serves later tasks too."""
    if path not in _COMPILED:
        _COMPILED[path] = PieceTransducer(path)
    return _COMPILED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of docs."""

    def run(batches):
        fst = compiled(path)
        for batch in batches:
            ids = [np.frombuffer(fst.encode(t.as_py()), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""

    def run(batches):
        fst = compiled(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fst.decode(i.as_py() or []) for i in batch.column(1)], pa.string())], ["doc_id", "text"]
            )

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip): round_trip is whether the ids decode to the text."""

    def run(batches):
        fst = compiled(path)
        for batch in batches:
            n, n_byte, crc, same = [], [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                raw = fst.encode(text)
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                n_byte.append(int(fst.is_byte[ids].sum()))
                crc.append(zlib.crc32(raw))
                same.append(fst.decode(ids.tolist()) == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, n_byte, crc)), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"],
            )

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"
    )
