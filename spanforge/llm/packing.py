"""Packing documents into windows by non-negative least squares.

Every document is cut into whole windows and a rest.  The rests' lengths make a
histogram, whose size the window bounds.  Shallow combinations of two to four lengths that
fill a window exactly are enumerated; non-negative least squares tells how often to
use each so that together they use up the histogram; the counts are rounded down to
what is there.  Residual lengths are packed greedily, largest first, as long as that
fills windows well; what then is left is laid end to end, cut where a window ends.

All of that is arithmetic on lengths.  A rest's place follows from its rank among the
rests of its length, which is counted in salted groups, so that no length, however
common, ends up in one task.

Defined cases: a null text is an empty one, whose only token is the end mark; equal
documents and repeated rows are packed row by row; a document longer than a window
spans as many as it needs; an empty table gives no pieces.  Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_batches

WINDOW, END = 2048, 1
#: Words whose ids a worker remembers.
MEMORY = 400_000
#: Lengths that are tried beside each length in combinations of three and four.
PARTNERS = 24
ROUNDS = 400
#: A greedy window may stay short by that many tokens, or more as long as padding in all
#: stays under that share; beyond that, documents are cut.
GAP, PADDING = 8, 0.002
#: The normaliser and the splitter for which texts may be encoded word by word.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Rows of one length and salt, about.
GROUP = 100_000


class WordEncoder:
    """Token ids of whole texts, remembered word by word.

    A tokenizer that lower-cases a text and splits it into words, single digits and runs of
    signs before anything else gives the words' ids in order.  A text with other characters than
    ASCII and plain Latin letters, or with the name of a special token, is encoded as a whole
    instead, and so is every text if the tokenizer's file says anything else.
    """

    ODD = re.compile("[^\\t-\\r\\x20-\\x7eÀ-ÖØ-öø-ſ]|<\\|")
    WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        said = json.loads(self.tokenizer.to_str())
        steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = steps[0].get("pattern") == {"Regex": SPLITTER} and steps[0]["invert"] and steps[0]["behavior"] == "Removed" if steps and steps[0]["type"] == "Split" else False
        bytes_ = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1].get("use_regex")
        self.by_word = bool(split and bytes_ and (said["normalizer"] or {}).get("normalizers") == NORMALISERS)
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}  # byte-level vocabularies write other bytes from 256 on
        self.spelling = [chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)]
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, word: str) -> bytes:
        """The ids of a word, straight from the merges: it needs no normalising and no splitting."""
        spelt = word if word.isascii() else "".join([self.spelling[b] for b in word.encode()])
        return np.array([t.id for t in self.merges(spelt)], "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.by_word or self.ODD.search(text):
            return self.whole(text).tobytes()
        words, known = self.WORD.findall(text.lower()), self.known
        parts = list(map(known.get, words))
        at = -1
        while True:
            try:
                at = parts.index(None, at + 1)
            except ValueError:
                return b"".join(parts)
            parts[at] = got = self.learn(words[at])
            if len(known) < MEMORY:
                known[words[at]] = got


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process; what it remembers serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_END = np.array([END], "<u4").tobytes()


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, text_hash): every document's whole windows and its rest."""

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids, start, length, crc, total, hashes = [], [], [], [], [], []
            for doc_id, text, hash_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = encode(text.as_py()) + _END
                n = len(raw) // 4
                for at in range(0, n, window):
                    part = raw[4 * at : 4 * (at + window)]
                    ids.append(doc_id)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    hashes.append(hash_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, start, length, crc, total, hashes)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_hash"],
            )

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, text_hash long")


def text_hash() -> Column:
    """Tells the texts of rows without an id, or of one id, apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


@dataclass(frozen=True)
class Plan:
    """Runs of ranks: pieces lo..hi of a length go, `copies` a window, to windows from `first` at `offset`.

    A run with copies 0 is laid end to end from position `offset` behind window `first`.
    """

    length: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    copies: np.ndarray
    window: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece: its window, its offset there, and how much of it that window takes."""
        key = lambda a, b: a * (1 << 44) + b
        at = np.searchsorted(key(self.length, self.lo), key(length, rank), side="right") - 1
        i, c = rank - self.lo[at], self.copies[at]
        k = np.maximum(c, 1)
        flat = self.offset[at] + i * length
        sequence = np.where(c > 0, self.first[at] + i // k, self.first[at] + flat // self.window)
        offset = np.where(c > 0, self.offset[at] + i % k * length, flat % self.window)
        return sequence, offset, np.minimum(length, self.window - offset)


def combinations(present: np.ndarray, weight: np.ndarray, window: int, partners: int = PARTNERS) -> np.ndarray:
    """Rows of two to four lengths (0: none) that fill the window, of lengths that there are."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    out = set()
    for a in present:
        if window - a <= a and have[window - a]:
            out.add((int(a), int(window - a), 0, 0))
    common = present[np.argsort(-weight[present], kind="stable")]
    spread = present[np.unique(np.linspace(0, len(present) - 1, min(len(present), partners)).astype(int))] if len(present) else present
    tried = np.unique(np.concatenate([common[:partners], spread]))
    for a in present:
        for b in tried:
            c = window - a - b
            if c > 0 and have[c]:
                out.add(tuple(sorted((int(a), int(b), int(c)), reverse=True)) + (0,))
    few = np.unique(np.concatenate([common[: partners // 4], spread[:: max(1, len(spread) // (partners // 4))]]))
    for a in present:
        for i, b in enumerate(few):
            for c in few[i:]:
                d = window - a - b - c
                if d > 0 and have[d]:
                    out.add(tuple(sorted((int(a), int(b), int(c), int(d)), reverse=True)))
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def nnls(columns: np.ndarray, wanted: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 of about the least |A x - wanted|, by accelerated projected gradient.

    A column of A counts the lengths of a combination; row 0 stands for no length.
    """
    size, rows = len(wanted), columns.ravel()
    of = np.repeat(np.arange(len(columns)), columns.shape[1])
    use = rows > 0
    rows, of = rows[use], of[use]
    up = lambda x: np.bincount(rows, weights=x[of], minlength=size)
    down = lambda r: np.bincount(of, weights=r[rows], minlength=len(columns))
    probe = np.ones(len(columns))
    for _ in range(20):
        probe = down(up(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0.0, y - down(up(y) - wanted) / (1.02 * norm))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / s * (z - x)
        x, t = z, s
    return x


def plan_windows(histogram: np.ndarray, window: int = WINDOW, gap: int = GAP) -> Plan:
    """histogram[n]: pieces of length n, 0 to window.  Every one of them gets a place."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used, runs, first = np.zeros(window + 1, np.int64), [], 0

    def lay(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal first
        offset = 0
        for n, copies in parts:
            runs.append((n, used[n], used[n] + copies * times, first, offset, copies))
            used[n] += copies * times
            left[n] -= copies * times
            offset += n * copies
        first += times

    if left[window]:
        lay([(window, 1)], int(left[window]))
    present = np.flatnonzero(left)
    columns = combinations(present, left, window)
    if len(columns):
        x = nnls(columns, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            lengths, copies = np.unique(columns[k][columns[k] > 0], return_counts=True)
            times = int(min(int(x[k]), (left[lengths] // copies).min()))
            if times:
                lay([(int(n), int(c)) for n, c in zip(lengths[::-1], copies[::-1], strict=True)], times)
    bad = np.zeros(window + 1, bool)
    spare = PADDING * float((histogram * np.arange(window + 1)).sum())
    while True:
        there = np.flatnonzero((left > 0) & ~bad)
        if not len(there):
            break
        top, space, parts = int(there[-1]), window, []
        while space:
            fits = np.searchsorted(there, space, side="right") - 1
            if fits < 0:
                break
            n = int(there[fits])
            copies = int(min(left[n], space // n))
            parts.append((n, copies))
            space -= n * copies
            there = there[:fits]
        times = int(min(left[n] // c for n, c in parts))
        if space > gap:
            if space * times > spare:
                bad[top] = True
                continue
            spare -= space * times
        lay(parts, times)
    at = 0
    for n in np.flatnonzero(left)[::-1]:
        runs.append((int(n), used[n], used[n] + left[n], first, at, 0))
        at += int(n * left[n])
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    return Plan(*table.T, window)


def assign(pieces: DataFrame, plan: Plan) -> DataFrame:
    """pieces with their rank: each piece's window and offset; cut pieces have ids_crc32 null and come twice."""
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # runs of at most `window` lengths

    def run(batches):
        for batch in batches:
            p = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(batch.schema.names) if k != "doc_id"}
            sequence, offset, taken = shared.value.place(p["length"], p["rank"])
            cut = np.flatnonzero(taken < p["length"])
            rows = np.concatenate([np.arange(len(sequence)), cut])
            more = np.concatenate([np.zeros(len(sequence), np.int64), np.ones(len(cut), np.int64)])
            start = p["start"][rows] + more * taken[rows]
            length = np.where(more, p["length"][rows] - taken[rows], taken[rows])
            whole = taken[rows] == p["length"][rows]
            crc = pa.array(p["ids_crc32"][rows], pa.int64(), mask=~whole)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    *(pa.array(x, pa.int64()) for x in (start, length)),
                    crc,
                    *(
                        pa.array(x, pa.int64()) for x in (
                            p["doc_tokens"][rows],
                            sequence[rows] + more,
                            np.where(more, 0, offset[rows]),
                            p["text_hash"][rows],
                            p["start"][rows],
                            p["length"][rows],
                            p["ids_crc32"][rows],
                        )
                    ),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "text_hash", "of_start", "of_length", "of_crc32"],
            )

    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_hash", "rank").mapInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, text_hash long, of_start long, of_length long, of_crc32 long",
    )


def _with_texts(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """pieces with their texts, met by id and text hash: rows that share an id, or have none, don't meet each other's."""
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), text_hash().alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = pieces.select(F.col("doc_id").alias("text_id"), F.col("text_hash").alias("hash")).distinct()
    same = lambda a, b: a["text_id"].eqNullSafe(b["text_id"]) & (a["hash"] == b["hash"])
    texts = texts.join(wanted, same(texts, wanted), "left_semi").dropDuplicates(["text_id", "text"])
    return pieces.join(texts, pieces["doc_id"].eqNullSafe(texts["text_id"]) & (pieces["text_hash"] == texts["hash"]))


def _fill_cut(cut: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """The checksums of cut pieces, from the ids of their documents alone."""
    both = _with_texts(cut, docs)

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            keep, crc = [], []
            for row in zip(
                *(
                    batch.column(batch.schema.names.index(k)).to_pylist() for k in (
                        "text", "start", "length", "of_start", "of_length", "of_crc32", "doc_tokens"
                    )
                ),
                strict=True,
            ):
                text, start, length, of_start, of_length, of_crc, total = row
                raw = encode(text) + _END
                right = len(raw) == 4 * total and zlib.crc32(raw[4 * of_start : 4 * (of_start + of_length)]) == of_crc
                keep.append(right)
                crc.append(zlib.crc32(raw[4 * start : 4 * (start + length)]))
            out = batch.select(["doc_id", "start", "length"]).to_pydict()
            rest = batch.select(["doc_tokens", "sequence_id", "offset", "text_hash"]).to_pydict()
            yield pa.RecordBatch.from_pydict({**out, "ids_crc32": crc, **rest}, schema=_PIECE).filter(pa.array(keep, pa.bool_()))

    found = both.mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, text_hash long"
    )
    return found.dropDuplicates(["sequence_id", "offset"])  # repeated ids with texts that begin alike


_PIECE = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "text_hash")])
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "text_hash")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, gap: int = GAP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, text_hash): every piece's place."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, path, window), "pieces")
    salts = max(64, pieces.count() // GROUP)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = scratch.save(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "sizes")
    histogram = np.zeros(window + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["length"]] = r["n"]
    plan = plan_windows(histogram, window, gap)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("length", "salt", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "text_hash")) - 1
    ranked = pieces.withColumn("inner", inner).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inner"))
    placed = scratch.save(assign(ranked, plan), "placed")
    whole = placed.filter(F.col("ids_crc32").isNotNull()).select(*COLUMNS)
    if not (plan.copies == 0).any():
        return whole
    return whole.unionByName(_fill_cut(placed.filter(F.col("ids_crc32").isNull()), docs, path).select(*COLUMNS))


def sequence_ids(docs: DataFrame, placed: DataFrame, path: str) -> DataFrame:
    """(sequence_id, offset, doc_id, ids): the ids of every piece, in its place."""
    both = _with_texts(placed, docs)

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids = [
                np.frombuffer(encode(t) + _END, "<u4")[s : s + n].astype(np.int32) for t, s, n in zip(
                    *(batch.column(batch.schema.names.index(k)).to_pylist() for k in ("text", "start", "length")), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(k)) for k in ("sequence_id", "offset", "doc_id")), pa.array(ids, pa.list_(pa.int32()))],
                ["sequence_id", "offset", "doc_id", "ids"],
            )

    return both.mapInArrow(run, "sequence_id long, offset long, doc_id long, ids array<int>")
