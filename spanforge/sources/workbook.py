"""Workbooks (.xlsx, .xlsm) as rows of values, read from their XML."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The format's own number formats that show a date, and day 0.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)


def _column(reference: str) -> int:
    """The place of a cell's column, from 0: B7 is 1."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


class Workbook:
    """Visible sheets by name, in order; of a cell its value, as calculated last, and never its formula."""

    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        book = self._xml("xl/workbook.xml")
        settings = book.find(f"{_MAIN}workbookPr")
        self.epoch = EPOCH_1904 if settings is not None and settings.get("date1904") in ("1", "true") else EPOCH
        place = lambda s: (lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}")(links[s.get(_LINK)])
        self.sheets = {s.get("name"): place(s) for s in book.iter(f"{_MAIN}sheet") if s.get("state", "visible") == "visible"}
        names = self.archive.namelist()
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
        self.strings = [text(e) for e in self._xml("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, name: str):
        return ElementTree.fromstring(self.archive.read(name))

    def _date_styles(self) -> set[int]:
        styles = self._xml("xl/styles.xml")
        shown = lambda code: re.search(r"[ymdhs]", re.sub(r"\"[^\"]*\"|\\.|\[[^\]]*\]", "", code.lower())) is not None
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if shown(f.get("formatCode", ""))}
        cells = styles.find(f"{_MAIN}cellXfs")
        return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def _value(self, cell):
        kind, raw = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return raw == "1"
        if kind in ("str", "d"):
            return raw
        number = float(raw)
        if int(cell.get("s", 0)) in self.dates:
            at = self.epoch + dt.timedelta(seconds=round(number * 86400))
            return at.date() if number == int(number) else at
        return int(number) if number == int(number) and "." not in raw and "E" not in raw.upper() else number

    def rows(self, sheet: str) -> list[list]:
        """All rows of a sheet, as wide as its widest one; missing cells are None."""
        found: dict[int, dict[int, object]] = {}
        for n, row in enumerate(self._xml(self.sheets[sheet]).iter(f"{_MAIN}row")):
            at = int(row.get("r", n + 1)) - 1
            for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                found.setdefault(at, {})[_column(cell.get("r")) if cell.get("r") else k] = self._value(cell)
        width = max((max(r) + 1 for r in found.values() if r), default=0)
        return [[found.get(i, {}).get(j) for j in range(width)] for i in range(max(found, default=-1) + 1)]
