"""Slowly changing tables of type 2: open and closed versions of rows by business key.

A table has its own columns and `_valid_from` (date), `_valid_to` (date, null while open) and
`_is_current`.  A refresh compares whole rows, null-safe, and writes nothing: it returns
the new table, which the caller puts at a new path before repointing its view.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = ("_valid_from", "_valid_to", "_is_current")


def _check(df: DataFrame, key: list[str], effective: str | None) -> None:
    clash = [c for c in df.columns if c in SYSTEM]
    if clash:
        raise ValueError(f"columns {clash} are the table's own")
    missing = [c for c in [*key, *([effective] if effective else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    if not key:
        raise ValueError("a business key is needed")


def _start(effective: str | None, day: str) -> Column:
    given = F.lit(day).cast("date")
    return F.coalesce(F.col(effective).cast("date"), given) if effective else given


def seed(df: DataFrame, key: list[str], day: str | dt.date, effective: str | None = None) -> DataFrame:
    """The first load: every row open from its effective date, or from `day`."""
    _check(df, key, effective)
    return df.withColumns({"_valid_from": _start(effective, str(day)), "_valid_to": F.lit(None).cast("date"), "_is_current": F.lit(True)})


def check_columns(current: DataFrame, batch: DataFrame) -> None:
    """A batch has the table's columns, no more and no fewer."""
    own, new = {c for c in current.columns if c not in SYSTEM}, set(batch.columns)
    if own != new:
        raise ValueError(f"missing columns {sorted(own - new)}, unknown columns {sorted(new - own)}")


@dataclass(frozen=True)
class Refresh:
    """The refreshed table, and what became of the open rows."""

    table: DataFrame
    inserted: DataFrame
    closed: DataFrame
    unchanged: DataFrame

    def counts(self) -> DataFrame:
        """(inserted, closed, unchanged) in one row."""
        n = lambda df, c: df.agg(F.count("*").alias(c))
        return n(self.inserted, "inserted").crossJoin(n(self.closed, "closed")).crossJoin(n(self.unchanged, "unchanged"))


def refresh(current: DataFrame, batch: DataFrame, key: list[str], day: str | dt.date, effective: str | None = None) -> Refresh:
    """A batch that holds the whole table as of `day`.

    Open rows that the batch hasn't got alike, changed or gone, are closed at `day`; rows of the
    batch that aren't open alike are inserted from their effective date or `day`.  Rows
    that the batch repeats become so many versions.  One co-partitioned comparison: all
    columns are the join key, in both directions.
    """
    _check(batch, key, effective)
    check_columns(current, batch)
    columns = [c for c in current.columns if c not in SYSTEM]
    rows = batch.select(*columns)
    opened, past = current.filter("_is_current"), current.filter("NOT _is_current")
    alike = lambda a, b: [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in columns]
    same = opened.alias("o").join(rows.alias("b"), alike("o", "b"), "left_semi")
    gone = opened.alias("o").join(rows.alias("b"), alike("o", "b"), "left_anti")
    closed = gone.withColumns({"_valid_to": F.lit(str(day)).cast("date"), "_is_current": F.lit(False)})
    new = rows.alias("b").join(opened.alias("o"), alike("b", "o"), "left_anti")
    inserted = new.withColumns({"_valid_from": _start(effective, str(day)), "_valid_to": F.lit(None).cast("date"), "_is_current": F.lit(True)})
    out = [x.select(*current.columns) for x in (past, same, closed, inserted)]
    return Refresh(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]), out[3], out[2], out[1])


def current_view(df: DataFrame) -> DataFrame:
    return df.filter("_is_current")


def as_of_view(df: DataFrame, day: str | dt.date) -> DataFrame:
    """The rows that held on a day: [_valid_from, _valid_to)."""
    at = F.lit(str(day)).cast("date")
    return df.filter((F.col("_valid_from") <= at) & (F.col("_valid_to").isNull() | (F.col("_valid_to") > at)))


MODES = ("replace", "temporal")


def load(
    current: DataFrame | None,
    batch: DataFrame,
    mode: str,
    version: int,
    day: str | dt.date,
    key: list[str] | None = None,
    effective: str | None = None,
) -> tuple[DataFrame, int]:
    """A table after a batch, by its refresh mode, and its next version.

    replace takes the batch as it is, whatever its columns; temporal seeds a history or refreshes it.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "replace":
        return batch, version + 1
    if current is None:
        return seed(batch, key or [], day, effective), version + 1
    return refresh(current, batch, key or [], day, effective).table, version + 1
