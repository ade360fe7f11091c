"""License scans by an exact set-similarity join of text blocks with templates.

Blocks are the lines of a document and, as notices are wrapped anywhere, overlapping
runs of words across line breaks: a template of n words has runs of twice s words, one
at every s words, s being the power of two from n up, so each s words lie whole in one.
A block and a template are sets of words.  The join finds every pair in which the block
holds at least `threshold` of the template's words; a run counts if no block with as
much of the same template lies in its place.  Words are
ordered by their global frequency, rarest first; a block can only reach the needed
overlap `a` of a template of n words if it has one of the template's n - a + 1 rarest
words (prefix filter), if it has a words of the vocabulary at all (length filter), and
if what is left behind the first common word on both sides makes up for the rest
(positional filter).  Pairs that pass are counted in full.  A template may have words
without which a block isn't its notice, whatever it has else: names and versions.  The templates
are a list that the caller hands in, so they go to every task and no text moves.

A match's places are the least stretches of words that hold what the threshold needs.
A match is overlaid if every one of its places overlaps one of a match with more of its
own template, or with as much of a template that has all its words and others: so CC BY-NC
displaces CC BY, and two notices in one block both stay.

Beside the join, a fixed list of phrases is looked up as consecutive words.

Defined cases: a null text is an empty one; a text without words has no places, null
first and last word, empty labels and score 0; ties and repeated rows are told row by
row; very long texts are one pass over their words.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
THRESHOLD = 0.8

#: Phrases of consecutive words, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices and licence texts, the labels of blocks that contain them, and words that such a block has in any case.
TEMPLATES = (
    ("mit", "released under the MIT License", "mit"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "permission granted",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "permission granted sublicense",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
        "permission fee granted",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache 2",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", "gnu 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", "gnu 2"),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
        "gnu 3",
    ),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either
        version 2 of the License, or (at your option) any later version.""",
        "gnu 2",
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License", "gnu lesser"),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", "gnu affero 3"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution source binary"),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        "redistribution retain reproduce",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
        "redistribution retain reproduce neither endorse",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    *(
        (
            f"cc-by{part}-4.0", f"Licensed under CC BY{part.upper()} 4.0", f"cc by 4{part.replace('-', ' ')}"
        ) for part in ("", "-nc", "-sa", "-nd", "-nc-sa", "-nc-nd")
    ),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", "cc0"),
)


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return WORD.findall(raw.lower())  # of bytes, so only A-Z change


@dataclass(frozen=True)
class Template:
    label: str
    ordered: tuple[bytes, ...]
    words: frozenset[bytes] = field(repr=False)
    needed: int
    always: frozenset[bytes] = frozenset()


class TemplateIndex:
    """Prefix postings of the templates under a global order of words."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        self.rank, self.templates, self.postings = {}, [], defaultdict(list)
        sets = [(label, frozenset(words(text)), frozenset(words(" ".join(always)))) for label, text, *always in templates]
        vocabulary = sorted({w for _, s, _ in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        for label, s, always in sets:
            if s:
                needed = max(1, math.ceil(threshold * len(s) - 1e-9))
                ordered = tuple(sorted(s, key=self.rank.__getitem__))
                for i in range(len(s) - needed + 1):
                    self.postings[ordered[i]].append((len(self.templates), i))
                self.templates.append(Template(label, ordered, s, needed, always))
        self.prefix = frozenset(self.postings)

    def match(self, block: set[bytes]) -> list[tuple[int, float]]:
        """Templates that the block contains well enough, with the share that it contains."""
        rank = self.rank
        ordered = sorted((w for w in block if w in rank), key=rank.__getitem__)
        seen, out = set(), []
        for j, w in enumerate(ordered):
            for k, i in self.postings.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)
                t = self.templates[k]
                if len(ordered) < t.needed or min(len(t.ordered) - i, len(ordered) - j) < t.needed:
                    continue
                overlap = len(t.words & block)
                if overlap >= t.needed and t.always <= block:
                    out.append((k, overlap / len(t.words)))
        return sorted(out)


def run_step(text: str) -> int:
    """Words from one run to the next: a power of two that holds the template."""
    return 1 << max(0, len(words(text)) - 1).bit_length()


class Scanner:
    """Finds the templates in the lines of a text, and in runs of words across its lines."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        listed = [t for t in templates if words(t[1])]
        self.index = TemplateIndex(listed, frequency, threshold)
        by = defaultdict(list)
        for i, (_, *rest) in enumerate(listed):
            by[run_step(rest[0])].append((i, *rest))
        self.runs = {step: TemplateIndex(some, frequency, threshold) for step, some in by.items()}  # labels are places in the whole list
        self.step = {i: step for step, some in by.items() for i, *_ in some}

    def spans(self, text: bytes, found: list[bytes], present: set[bytes]) -> list[dict]:
        if self.index.prefix.isdisjoint(present):
            return []
        possible = [i for i, _ in self.index.match(present)]
        if not possible:
            return []
        matches, starts, at = [], [], 0  # (template, share, block, start, n_words, places)
        for k, line in enumerate(text.split(b"\n")):
            block = words(line)
            starts.append(at)
            if not self.index.prefix.isdisjoint(block):
                matches += [(i, share, k, at, len(block), self.places(found, at, at + len(block), i)) for i, share in self.index.match(set(block))]
            at += len(block)
        if len(starts) > 1:
            matches += self.across(found, starts, {self.step[i] for i in possible}, matches)
        return [
            {
                "label": self.index.templates[i].label,
                "block": k,
                "start": a,
                "n_words": n,
                "containment": share,
                "overlaid": not free(places, [m[5] for m in matches if self.outdoes(m, i, share)]),
            }
            for i, share, k, a, n, places in sorted(matches, key=lambda m: (m[3], m[0], m[4]))
        ]

    def outdoes(self, other: tuple, i: int, share: float) -> bool:
        """Whether another match has more of its template, or as much of one that has all words of template i and others."""
        return other[1] > share or other[1] == share and self.index.templates[other[0]].words > self.index.templates[i].words

    def across(self, found: list[bytes], starts: list[int], steps: set[int], lines: list[tuple]) -> list[tuple]:
        """Matches of runs that cross lines and hold more of a template than the lines there, best first."""
        runs = []
        for step in sorted(steps):
            index = self.runs[step]
            for r in sorted({max(0, p // step - j) for p, w in enumerate(found) if w in index.prefix for j in (0, 1)}):
                a, b = r * step, min((r + 2) * step, len(found))
                k = bisect_right(starts, a) - 1
                if k == bisect_right(starts, b - 1) - 1:
                    continue
                runs += [(index.templates[i].label, share, k, a, b - a) for i, share in index.match(set(found[a:b]))]
        out: list[tuple] = []
        for i, share, k, a, n in sorted(runs, key=lambda m: (-m[1], m[3], m[0])):
            places = self.places(found, a, a + n, i)
            if free(places, [m[5] for m in (*lines, *out) if m[0] == i and m[1] >= share]):
                out.append((i, share, k, a, n, places))
        return out

    def places(self, found: list[bytes], a: int, b: int, i: int) -> list[tuple[int, int]]:
        """The least stretches of words a to b that hold as many of a template's words as needed."""
        t = self.index.templates[i]
        hits = [(p, w) for p, w in enumerate(found[a:b], a) if w in t.words]
        out, held, first = [], Counter(), 0
        for p, w in hits:
            held[w] += 1
            while len(held) == t.needed:
                q, v = hits[first]
                first += 1
                held[v] -= 1
                if not held[v]:
                    del held[v]
                    out.append((q, p + 1))
        return out


def free(places: list[tuple[int, int]], others: list[list[tuple[int, int]]]) -> bool:
    """Whether one of the places overlaps none of the others."""
    return any(all(b <= c or d <= a for other in others for c, d in other) for a, b in places)


def phrase_places(found: list[bytes], present: set[bytes], phrases) -> list[tuple[str, int]]:
    out = []
    for phrase, label in phrases:
        p = words(phrase)
        if present.issuperset(p):
            at = -1
            while True:
                try:
                    at = found.index(p[0], at + 1)
                except ValueError:
                    break
                if found[at : at + len(p)] == p:
                    out.append((label, at))
    return out


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_SPANS = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("block", pa.int64()),
            ("start", pa.int64()),
            ("n_words", pa.int64()),
            ("containment", pa.float64()),
            ("overlaid", pa.bool_()),
        ]
    )
)


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, places, spans) for every row of docs.

    places: every start of a phrase, with its label.  spans: every block that contains
    a template, with the template's label, the number of the block's first line in the
    text, its first word, its number of words, the share of the template that it contains
    and whether better matches overlay it.
    """
    vocabulary = frozenset(w for t in templates for w in words(t[1]))
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def count(batches):
        n = Counter()
        for batch in batches:
            for t in batch.column(1):
                n.update(vocabulary.intersection(words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    totals = rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most the templates' words
    scanner = Scanner(templates, {bytes(r["word"]): r["n"] for r in totals}, threshold)

    def scan(batches):
        for batch in batches:
            n_words, places, spans = [], [], []
            for t in batch.column(1):
                text = t.as_py() or b""
                found = words(text)
                present = set(found)
                n_words.append(len(found))
                places.append([{"label": label, "start": at} for label, at in phrase_places(found, present, phrases)])
                spans.append(scanner.spans(text, found, present))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, _PLACES), pa.array(spans, _SPANS)],
                ["doc_id", "n_words", "places", "spans"],
            )

    return rows.mapInArrow(
        scan,
        "doc_id long, n_words long, places array<struct<label:string,start:long>>, spans array<struct<label:string,block:long,start:long,n_words:long,containment:double,overlaid:boolean>>",
    )


def license_digest(found: DataFrame) -> DataFrame:
    """A row a document: base places and labels, all labels, and the best share contained.

    All matches give labels but those that better ones overlay.
    """
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.filter("spans", lambda x: ~x["overlaid"])
    base, own = F.col("places.label"), F.transform(best, lambda x: x["label"])
    n = F.size("places").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.array_min(F.col("places.start")).alias("first_word"),
        F.array_max(F.col("places.start")).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("spans.containment")), F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the digest: every block against every template, without filters."""
    cls = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listed = lambda ws: "[" + ", ".join("'" + w.decode() + "'" for w in ws) + "]"
    sets = [(label, sorted(set(words(text))), words(" ".join(always))) for label, text, *always in templates]
    values = ", ".join(
        f"({i}, '{label}', {listed(s)}, {max(1, math.ceil(threshold * len(s) - 1e-9))}, CAST({listed(always)} AS VARCHAR[]))" for i, (label, s, always) in enumerate(sets)
    )
    bases = ", ".join(f"('{label}', {listed(words(p))})" for p, label in phrases)
    return f"""
WITH d AS (SELECT doc_id, {lower.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{cls}') AS ws FROM d),
base(label, p) AS (VALUES {bases}),
place AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(p)] = p)) AS pos
  FROM w, base WHERE list_has_all(ws, p)),
b AS (SELECT doc_id, label, pos FROM place),
tpl(i, label, s, needed, always) AS (VALUES {values}),
block AS (SELECT doc_id, row_number() OVER () AS k, list_distinct(regexp_extract_all(line, '{cls}')) AS bs
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
span AS (SELECT doc_id, k, i, label, s, len(list_intersect(bs, s)) / CAST(len(s) AS DOUBLE) AS share
  FROM block, tpl WHERE len(bs) >= needed AND list_has_all(bs, always) AND len(list_intersect(bs, s)) >= needed),
top AS (SELECT doc_id, k, label FROM span x WHERE NOT EXISTS (SELECT 1 FROM span y WHERE y.k = x.k AND (y.share > x.share OR y.share = x.share AND len(y.s) > len(x.s) AND list_has_all(y.s, x.s)))),
bg AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM b GROUP BY 1),
sg AS (SELECT doc_id, max(share) AS share FROM span GROUP BY 1),
ag AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT doc_id, label FROM b
  UNION ALL SELECT doc_id, label FROM top) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(bg.n, 0) AS BIGINT) AS n_base,
  CAST(bg.lo AS BIGINT) AS first_word, CAST(bg.hi AS BIGINT) AS last_word, coalesce(bg.ls, '') AS base_labels,
  coalesce(ag.ls, '') AS labels, CASE WHEN bg.n > 0 THEN 1.0 ELSE coalesce(sg.share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bg USING (doc_id) LEFT JOIN sg USING (doc_id) LEFT JOIN ag USING (doc_id)"""
