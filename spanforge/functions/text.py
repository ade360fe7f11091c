"""Text functions as expressions: identifiers, dates, headers, markup, search terms."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with a meaning in a full-text query.
SEARCH_SPECIALS = r'[+\-&|!(){}\[\]^"~*?:\\/]'
#: Fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def sanitize_identifier(name: str) -> str:
    """A table or column name: one `_` for each sign but ASCII letters and digits, in lower case, never empty or led by a digit."""
    made = re.sub("[^A-Za-z0-9_]", "_", name).strip("_").lower() or "table"
    return f"t_{made}" if made[0].isdigit() else made


def identifier_column(c: Column) -> Column:
    """sanitize_identifier over a column."""
    signs = F.regexp_replace(c, "[\\x{10000}-\\x{10FFFF}]|[^A-Za-z0-9_]", "_")
    made = F.lower(F.regexp_replace(signs, "^_++|_++$", ""))
    made = F.when(made == "", "table").otherwise(made)
    return F.when(made.rlike("^[0-9]"), F.concat(F.lit("t_"), made)).otherwise(made)


def search_text(value: str) -> str:
    """A query without special characters and with single spaces; empty means no search."""
    return re.sub(r"\s+", " ", re.sub(SEARCH_SPECIALS, " ", value or "")).strip()


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def iso_date(c: Column) -> Column:
    """A date as ISO text: a full date at the start, a bare year or month, `15 March 2026`, `March 15, 2026`; else null."""
    t = F.trim(c)
    full = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    partial = F.regexp_extract(t, r"^(\d{4}(?:-\d{2})?)$", 1)
    day_first = r"(?i)^(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]+)\.?,?\s+(\d{4})$"
    month_first = r"(?i)^([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$"

    def made(pattern: str, day: int, month: int) -> Column:
        name = F.lower(F.regexp_extract(t, pattern, month))
        at = F.array_position(F.array(*map(F.lit, MONTHS)), name)
        at = F.when(at > 0, at).otherwise(F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name))
        text = F.concat_ws("-", F.regexp_extract(t, pattern, 3), F.lpad(at.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, pattern, day), 2, "0"))
        return F.when(t.rlike(pattern) & (at > 0) & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), text)

    return F.coalesce(F.when(full != "", full), F.when(partial != "", partial), made(day_first, 1, 2), made(month_first, 2, 1))


def header_value(text: Column, label: str) -> Column:
    """A document header's value: the table row `| Label | value |` first, then a line `Label: value`."""
    name = re.escape(label)
    row = F.regexp_extract(text, rf"(?im)^\|\s*\**{name}\**\s*\|\s*([^|\n]*?)\s*\|", 1)
    line = F.regexp_extract(text, rf"(?im)^\**{name}\**\s*:\s*\**\s*(.+?)\s*$", 1)
    return F.coalesce(F.nullif(row, F.lit("")), F.nullif(line, F.lit("")))


def leading_number(c: Column) -> Column:
    """The number that a version begins with, such as 2.1 of `v2.1 (draft)`."""
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+){0,9})", 1), F.lit(""))


def title_stem(c: Column) -> Column:
    """A title without its extension and without version or date suffixes, however many."""
    bare = F.regexp_replace(c, r"\.[A-Za-z0-9]{1,5}$", "")
    return F.lower(F.regexp_replace(bare, r"(?i)([_ -]v?\d+)+$", ""))


def frontmatter(text: Column) -> Column:
    """The block between `---` lines that a text starts with; null without one."""
    found = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    return F.when(found != "", found)


def frontmatter_map(text: Column) -> Column:
    """Its scalar entries as a map; empty if there are none or a line is malformed."""
    lines = F.filter(F.split(F.coalesce(frontmatter(text), F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    good = F.forall(lines, lambda x: x.rlike(r"^[A-Za-z_][\w -]*:(\s.*)?$"))
    pairs = F.transform(
        lines, lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"^([^:]+):", 1)), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]+:\s*", ""), "^['\"]|['\"]$", ""))
        )
    )
    unique = F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, 1000), lambda y: y["col1"] == x["col1"])))
    return F.when(good, unique).otherwise(F.create_map().cast("map<string,string>"))


def body_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")


#: Named character references.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(c: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags; blocks end lines; spaces single."""
    t = F.regexp_replace(c, r"(?is)<(script|style|head|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:/?(?:p|div|section|article|ul|ol|table|h[1-6])|br|/?li|/?tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t\x0B\f\r]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


#: Words of JSON and of a language that models mix it up with.
JSON_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
#: Quotes by the sign that opens them.
QUOTES = {'"': '"', "'": "'", "\u201c": "\u201d", "\u2018": "\u2019"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_SKIP = re.compile(r"(?:[\s,:]|//[^\n]*|/\*.*?\*/)*", re.S)
_BARE = re.compile(r"[^\s,:{}\[\]\"]+")


def _quoted(text: str, at: int) -> tuple[str, int]:
    """A text in quotes from `at` on, and where it ends; it may be cut off."""
    close, out, i = QUOTES[text[at]], [], at + 1
    while i < len(text) and text[i] != close:
        if text[i] == "\\" and i + 1 < len(text):
            code = re.compile(r"u([0-9a-fA-F]{4})").match(text, i + 1)
            out.append(chr(int(code[1], 16)) if code else ESCAPES.get(text[i + 1], text[i + 1]))
            i += 6 if code else 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out), i + 1


def _tolerant(text: str):
    """The first object or list of a text, read with whatever commas, colons, quotes and ends are missing.

    One pass with a stack of open containers, so neither depth nor length matters.
    """
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    root, stack, i = None, [], start  # of the stack: container, and the key that waits for its value

    def put(value) -> None:
        nonlocal root
        if not stack:
            root = value
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
        elif stack[-1][1] is None:
            stack[-1][1] = value if isinstance(value, str) else json.dumps(value)
        else:
            stack[-1][0][stack[-1][1]] = value
            stack[-1][1] = None

    while i < len(text):
        i = _SKIP.match(text, i).end()
        if i >= len(text):
            break
        sign = text[i]
        if sign in "{[":
            new = {} if sign == "{" else []
            put(new)
            stack.append([new, None])
            i += 1
        elif sign in "}]":
            while stack:
                done = stack.pop()[0]
                if isinstance(done, list) == (sign == "]"):
                    break
            i += 1
            if not stack:
                break
        elif sign in QUOTES:
            value, i = _quoted(text, i)
            put(value)
        else:
            word = _BARE.match(text, i)[0]
            i += len(word)
            waits = isinstance(stack[-1][0], dict) and stack[-1][1] is None
            try:
                put(word if waits else JSON_WORDS[word] if word in JSON_WORDS else json.loads(word))
            except ValueError:
                put(word)
    return root


def repair_json(raw: str | None) -> object | None:
    """What a model meant as JSON: without thoughts, fences and text around it; None if nothing is there.

    Good JSON is read as such; else comments, single or no quotes, missing or spare commas and
    texts that are cut off are put up with.
    """
    text = re.sub(r"(?s)<think>.*?</think>", "", raw or "").strip()
    fenced = re.search(r"(?s)```(?:json)?[^\S\n]*\n?(.*?)(?:```|\Z)", text)
    if fenced:
        text = fenced[1].strip()
    starts = sorted((text.find(a), text.rfind(b)) for a, b in ("{}", "[]") if a in text)
    for t in [text, *(text[i : j + 1] for i, j in starts[:1] if j > i)]:
        try:
            return json.loads(t)
        except (ValueError, RecursionError):
            pass
    return _tolerant(text)


def _repaired(raw: pd.Series) -> pd.Series:
    found = [repair_json(x) for x in raw]
    return pd.Series([None if x is None else json.dumps(x, sort_keys=True) for x in found], dtype="object")


def repaired_json(raw: Column | str) -> Column:
    """repair_json over a column, as JSON text; null if nothing parses."""
    return F.pandas_udf(_repaired, "string")(raw)
