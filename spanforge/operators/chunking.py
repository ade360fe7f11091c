"""Markdown chunks: sections at headings, long ones split at paragraphs, lines, spaces."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repair_json

CHUNK_SIZE = 6000
_HEADING = re.compile(r"(?m)^(#{1,4})[ \t]+(.+?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"(?ms)^(```|~~~).*?^\1[ \t]*$")
_TABLE_HEAD = re.compile(r"(?m)^(\|[^\n]*\|[ \t]*)\n(\|[ \t]*:?-{2,}[^\n]*\|[ \t]*)$")
CHUNK_SCHEMA = "doc_id long, seq int, text string, header_path string, char_start long, char_end long, block_hash string"


def sections(text: str) -> list[tuple[int, int, str]]:
    """(start, end, breadcrumb) of the parts between headings of level 1 to 4, headings included."""
    fenced = [m.span() for m in _FENCE.finditer(text)]
    heads = [m for m in _HEADING.finditer(text) if not any(a <= m.start() < b for a, b in fenced)]
    cuts = [0, *[m.start() for m in heads], len(text)]
    out, trail = [], {}
    if heads and text[: heads[0].start()].strip() or not heads:
        out.append((0, heads[0].start() if heads else len(text), ""))
    for i, m in enumerate(heads):
        level = len(m[1])
        trail = {k: v for k, v in trail.items() if k < level} | {level: m[2].strip()}
        out.append((m.start(), cuts[i + 2], " > ".join(trail[k] for k in sorted(trail))))
    return out


def pieces(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Spans of at most `size` characters: cut behind a blank line, else a line break, else a space, else anywhere."""
    while end - start > size:
        window = text[start : start + size]
        for sign in ("\n\n", "\n", " "):
            at = window.rfind(sign)
            if at > 0:
                cut = at + len(sign)
                break
        else:
            cut = size
        yield start, start + cut
        start += cut
    if start < end:
        yield start, end


def table_header(text: str, at: int, start: int) -> str:
    """The head of the table that position `at` is in the middle of; empty if it isn't."""
    line = text[at : text.find("\n", at) if "\n" in text[at:] else len(text)]
    if not line.lstrip().startswith("|"):
        return ""
    head = ""
    for m in _TABLE_HEAD.finditer(text, start, at):
        if all(x.lstrip().startswith("|") for x in text[m.end() + 1 : at].splitlines()):
            head = m[0] + "\n"
    return head


def chunk_markdown(text: str | None, size: int = CHUNK_SIZE) -> list[dict]:
    """A document's chunks in order; none of a null or blank text.

    A chunk that starts in the middle of a table has the table's head in front; its span
    is that of the text without it.
    """
    out: list[dict] = []
    body = text or ""
    for start, end, path in sections(body):
        for a, b in pieces(body, start, end, size):
            raw = body[a:b]
            if raw.strip():
                lead = len(raw) - len(raw.lstrip("\n"))
                a, raw = a + lead, raw.strip("\n")
                shown = table_header(body, a, start) + raw
                out.append(
                    {
                        "seq": len(out),
                        "text": shown,
                        "header_path": path,
                        "char_start": a,
                        "char_end": a + len(raw),
                        "block_hash": hashlib.sha1(shown.encode()).hexdigest(),
                    }
                )
    return out


def chunk_documents(documents: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """(doc_id, seq, text, header_path, char_start, char_end, block_hash) of every document."""
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [
                {"doc_id": i, **c} for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for c in chunk_markdown(t.as_py(), size)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNK_SCHEMA)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunks with id, prev_chunk_id and next_chunk_id; ids are padded to what a document's last chunk needs."""
    cid = F.concat_ws("_", F.col("doc_id").cast("string"), F.lpad(F.col("seq").cast("string"), 6, "0"))
    w = Window.partitionBy("doc_id").orderBy("seq")
    return chunks.withColumn("id", cid).withColumns({"prev_chunk_id": F.lag("id").over(w), "next_chunk_id": F.lead("id").over(w)})


def local_ids(items: DataFrame, chunk_id: str = "chunk_id", *references: str) -> DataFrame:
    """items with their id and references made global by the chunk's id; rows without an id go."""
    out = items.filter(F.col("id").isNotNull() & (F.trim("id") != ""))
    for c in ("id", *references):
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.concat_ws("_", F.col(chunk_id), F.col(c))))
    return out


def extract(
    chunks: DataFrame,
    extractor,
    steps: tuple[str, ...] = ("entities", "properties", "relationships"),
    done: DataFrame | None = None,
    attempts: int = 2,
) -> DataFrame:
    """(chunk_id, step, status, payload): what an injected extractor(step, text) returns, as JSON text.

    Steps that `done` has as ok aren't run again; one that fails is tried once more, then is failed.
    """
    todo = chunks.select(F.col("id").alias("chunk_id"), "text").withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    if done is not None:
        todo = todo.join(done.filter("status = 'ok'").select("chunk_id", "step"), ["chunk_id", "step"], "left_anti")

    def run(batches):
        for batch in batches:
            status, payload = [], []
            for text, step in zip(batch.column("text").to_pylist(), batch.column("step").to_pylist(), strict=True):
                got = None
                for _ in range(attempts):
                    try:
                        got = repair_json(extractor(step, text))
                    except Exception:  # noqa: BLE001  tried again, then told in the status
                        got = None
                    if got is not None:
                        break
                status.append("failed" if got is None else "ok")
                payload.append(None if got is None else json.dumps(got, sort_keys=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("step"), pa.array(status, pa.string()), pa.array(payload, pa.string())],
                ["chunk_id", "step", "status", "payload"],
            )

    return todo.mapInArrow(run, "chunk_id string, step string, status string, payload string")
