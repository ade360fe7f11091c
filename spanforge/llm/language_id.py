"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves 64 languages: its slots hold a bitmask with a bit for
each language (a bit-sliced filter), so that the AND of an n-gram's slots tells at
once every language that has it.  A document adds up, per language, how many of its
n-grams have the bit (the popcount), takes off the share that the filter's fill
would give by chance, and goes to the language with the most.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text
whose n-grams no language has goes to the first language with score 0; ties go to the
language that sorts first; without any learnable row every text is `und`.  Rows
repeat as they come.  Only doc_id, text and lang are read, so extra columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, text_batches, unit_hash

GRAM = 4
#: Learned rows a language, about: the bound of the sample that the filters are fitted on.
ROWS_PER_LANGUAGE = 2000
SLOT_BITS = 21
#: Languages a bitmask; more languages take more filters of the same size.
MASK = 64
MULTIPLIERS = (2654435761, 2246822519, 3266489917)
PIECE = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if 97 <= c <= 122 else 32 for c in range(128)]


def _codes(data: np.ndarray) -> np.ndarray:
    """The n-grams of UTF-8 bytes as 32-bit numbers, one from each byte but the last three."""
    b = _FOLD[data].astype(np.uint32)
    return b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    ends = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1]
    raw = low.buffers()[2]
    return np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8), ends


def _slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(codes * np.uint32(m)) >> np.uint32(32 - bits) for m in MULTIPLIERS]


def _pieces(ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents with a bounded number of bytes; a long document is a run by itself."""
    out, first = [], 0
    for i in range(1, len(ends)):
        if ends[i] - ends[first] > PIECE or i == len(ends) - 1:
            out.append((first, i))
            first = i
    return out


def _kind(languages: int) -> type:
    """The smallest number that has a bit for each."""
    return next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if languages <= n)


@dataclass(frozen=True)
class LanguageFilter:
    """Bit-sliced Bloom filters: bit i of a slot of slots[g] stands for languages[g * MASK + i]."""

    languages: tuple[str, ...]
    slots: tuple[np.ndarray, ...]

    @staticmethod
    def build(grams: dict[str, np.ndarray], bits: int = SLOT_BITS) -> LanguageFilter:
        languages = tuple(sorted(grams))
        filters = []
        for first in range(0, len(languages), MASK):
            group = languages[first : first + MASK]
            kind = _kind(len(group))
            slots = np.zeros(1 << bits, dtype=kind)
            for i, language in enumerate(group):
                for at in _slots(grams[language].astype(np.uint32), bits):
                    np.bitwise_or.at(slots, np.unique(at), kind(1 << i))
            filters.append(slots)
        return LanguageFilter(languages, tuple(filters))

    def bit(self, masks: list[np.ndarray], language: int) -> np.ndarray:
        """Of each mask, the bit of a language."""
        mask = masks[language // MASK]
        return (mask >> mask.dtype.type(language % MASK)) & mask.dtype.type(1)

    def chance(self) -> np.ndarray:
        """By language: how probably the filter says yes to an n-gram that it hasn't got."""
        fill = [float(self.bit(list(self.slots), i).mean()) for i in range(len(self.languages))]
        return np.array(fill) ** len(MULTIPLIERS)

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        """By filter: the bitmask of the languages that have each n-gram."""
        a, b, c = _slots(codes, int(np.log2(len(self.slots[0]))))
        return [s[a] & s[b] & s[c] for s in self.slots]

    def counts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By document: its n-grams, and by language those that the filter has."""
        n, hits = np.zeros(len(ends) - 1, np.int64), np.zeros((len(ends) - 1, len(self.languages)), np.int64)
        for first, last in _pieces(ends):
            lo, hi = int(ends[first]), int(ends[last])
            if hi - lo < GRAM:
                continue
            codes = _codes(data[lo:hi])
            masks = self.masks(codes)
            blank = (codes & 0xFFFF) == 0x2020
            for mask in masks:
                mask[blank] = 0
            starts = np.minimum(ends[first:last] - lo, len(codes))
            stops = np.clip(ends[first + 1 : last + 1] - lo - (GRAM - 1), starts, len(codes))
            total = lambda x: (lambda s: s[stops] - s[starts])(np.concatenate(([0], np.cumsum(x, dtype=np.int64))))
            n[first:last] = total(~blank)
            for i in range(len(self.languages)):
                hits[first:last, i] = total(self.bit(masks, i))
        return n, hits

    def decide(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """By text: its language, `und` without letters, and that language's share."""
        return self.judge(texts)[:2]

    def judge(self, texts: pa.Array) -> tuple[list[str], list[float], list[int]]:
        """What decide says, and by text how many n-grams it has."""
        data, ends = _lowered(texts)
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
        n, hits = self.counts(data, ends)
        f = self.chance()
        real = np.maximum(0.0, (hits - n[:, None] * f) / (1 - f))
        best, total = real.argmax(1), real.sum(1)
        share = np.divide(real.max(1), total, out=np.zeros(len(real)), where=total > 0)
        return [
            self.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)
        ], [float(s) if ok else 0.0 for s, ok in zip(share, letters, strict=True)], n.tolist()


def _filled(languages: dict[str, int], bits: int):
    """Batches of (text, lang) as the slots that their n-grams set: (filter, slot, mask), once a batch."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for language in sorted(set(langs)):
                data, ends = _lowered(batch.column(0).filter(pa.array(langs == language)))
                found = []
                for first, last in _pieces(ends):
                    lo, hi = int(ends[first]), int(ends[last])
                    if hi - lo >= GRAM:
                        codes = _codes(data[lo:hi])
                        within = np.ones(len(codes), bool)  # not from one text into the next
                        for end in ends[first + 1 : last] - lo:
                            within[max(0, end - GRAM + 1) : end] = False
                        found.append(np.unique(codes[within & ((codes & 0xFFFF) != 0x2020)]))
                if found:
                    slots = np.unique(np.concatenate(_slots(np.concatenate(found), bits)))
                    k = languages[language]
                    mask = np.array([1 << (k % MASK)], np.uint64).view(np.int64)[0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(slots), k // MASK), pa.int32()),
                            pa.array(slots.astype(np.int64)),
                            pa.array(np.full(len(slots), mask), pa.int64()),
                        ],
                        ["filter", "slot", "mask"],
                    )

    return run


def learn_languages(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, bits: int = SLOT_BITS) -> LanguageFilter:
    """Fit the filters on about `rows_per_language` learnable rows of each language, with all their n-grams.

    What reaches the driver is a row a language, and the filters' slots: two million at most for 64 languages.
    """
    text_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageFilter((), ())
    languages = tuple(sorted(sizes))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_language / n))])
    sample = known.filter(unit_hash(F.col("doc_id"), "language") < share[F.col("lang")]).select("text", "lang")
    set_ = sample.mapInArrow(_filled({k: i for i, k in enumerate(languages)}, bits), "filter int, slot long, mask long")
    whole = set_.groupBy("filter", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    number, slot, mask = (whole.column(i).to_numpy() for i in range(3))
    filters = []
    for k, first in enumerate(range(0, len(languages), MASK)):
        slots = np.zeros(1 << bits, dtype=_kind(len(languages[first : first + MASK])))
        slots[slot[number == k]] = mask[number == k].view(np.uint64).astype(slots.dtype)
        filters.append(slots)
    return LanguageFilter(languages, tuple(filters))


def predict_languages(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the filters' size is fixed

    def predict(batches):
        for batch in batches:
            lang, score = shared.value.decide(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageFilter, least: float = 0.0) -> DataFrame:
    """The rows of docs whose language is known with more than `least`; columns as they were.

    Texts with letters that are too short for an n-gram stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            judged = shared.value.judge(batch.column(at))
            yield batch.filter(pa.array([x != "und" and (s > least or not n) for x, s, n in zip(*judged, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return predict_languages(docs, learn_languages(docs))
