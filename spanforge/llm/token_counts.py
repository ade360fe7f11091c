"""Token counts by field or section, from one encoding of the whole text.

A text is encoded once, as a whole.  The tokens' bytes are the text's bytes in order, so
their spans are running sums of the tokens' lengths.  The sections are spans too; both
lists are sorted, and an interval join of the two tells which sections a token touches.
A token that touches more than one is allocated by a stated rule:

  start     to the section that its first byte is in
  majority  to the section that most of its bytes are in, the first one among equals
  split     to all of them, in proportion to their bytes

By default a text's sections are its lines, each with the line break that ends it.  Fields are
columns put together into one document, each with the separator behind it.

Defined cases: a null or empty text is one empty section without tokens; repeated rows
are counted row by row; extra columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

RULES = ("start", "majority", "split")


def line_spans(raw: bytes) -> np.ndarray:
    """Ends of the sections, in bytes: behind each line break, and at the text's end."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """By section: its tokens, and the crossing ones that touch it.  Spans are in bytes, without gaps."""
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n), np.zeros(n, np.int64)
    starts, section_starts = (np.concatenate(([0], ends[:-1])) for ends in (token_ends, section_ends))
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    counts = np.bincount(first[first == last], minlength=n).astype(float)
    cross = np.flatnonzero(first != last)
    if not len(cross):
        return counts, np.zeros(n, np.int64)
    # a row for each crossing token and section that it reaches over, as many as tokens and sections together at most
    reach = last[cross] - first[cross] + 1
    group = np.repeat(np.arange(len(cross)), reach)
    begins = np.cumsum(reach) - reach
    section = first[cross][group] + np.arange(len(group)) - begins[group]
    token = cross[group]
    size = np.minimum(token_ends[token], section_ends[section]) - np.maximum(starts[token], section_starts[section])
    crossing = np.bincount(section[size > 0], minlength=n)
    if rule == "start":
        counts += np.bincount(first[cross], minlength=n)
    elif rule == "majority":
        largest = np.flatnonzero(size == np.maximum.reduceat(size, begins)[group])
        chosen = largest[np.unique(group[largest], return_index=True)[1]]  # the first one among equals
        counts += np.bincount(section[chosen], minlength=n)
    else:
        counts += np.bincount(section, weights=size / np.add.reduceat(size, begins)[group], minlength=n)
    return counts, crossing


class ByteEncoder:
    """A byte-level BPE whose tokens' byte lengths are known."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The tokens' ends, in bytes of the text."""
        return np.cumsum(self.length[np.array(self.encode(text), np.int64)])


_ENCODERS: dict[str, ByteEncoder] = {}


def _counts(rows: DataFrame, path: str, pattern: str, rule: str, spans: Callable) -> DataFrame:
    """Counts of rows (doc_id, text, ...); spans(raw, batch, i): the ends of the sections of row i."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {', '.join(RULES)}")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("section", pa.int64()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("n_tokens", pa.float64()),
            ("n_crossing", pa.int64()),
        ]
    )

    def run(batches):
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ByteEncoder(path, pattern))
        for batch in batches:
            ids, out = [], []
            for k, (doc_id, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                text = t.as_py() or ""
                raw = text.encode()
                ends = spans(raw, batch, k)
                counts, crossing = attribute(encoder.ends(text) if raw else np.zeros(0, np.int64), ends, rule)
                if len(raw) == len(text):
                    at = ends
                else:
                    at = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[ends]
                ids += [doc_id] * len(ends)
                out.append((np.arange(len(ends)), np.concatenate(([0], at[:-1])), at, counts, crossing))
            columns = [np.concatenate([o[i] for o in out]) if out else [] for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema
            )

    text_batches(rows.sparkSession)
    found = rows.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens double, n_crossing long")
    return found if rule == "split" else found.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "majority", spans: Callable[[bytes], np.ndarray] = line_spans) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) for every section of every row of docs.

    start and end count characters; n_tokens is whole but under the rule split.  path and
    pattern: the vocabulary's ranks, and how it splits a text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _counts(rows, path, pattern, rule, lambda raw, batch, k: spans(raw))


def field_tokens(
    docs: DataFrame, id_column: str, fields: list[str], path: str, pattern: str, rule: str = "majority", separator: str = "\n"
) -> DataFrame:
    """(doc_id, field, start, end, n_tokens, n_crossing) for every field of every row of docs.

    The fields make one document, in order; a field but the last has the separator behind it, and a
    null one is empty.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    whole = [F.concat(t, F.lit(separator)) for t in texts[:-1]] + texts[-1:]
    sizes = F.array(*[F.octet_length(t).cast("long") for t in whole])
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.concat(*whole).alias("text"), sizes.alias("sizes"))
    found = _counts(rows, path, pattern, rule, lambda raw, batch, k: np.cumsum(batch.column(2)[k].as_py()))
    return found.withColumn("section", F.get(F.array(*map(F.lit, fields)), F.col("section").cast("int"))).withColumnRenamed("section", "field")
