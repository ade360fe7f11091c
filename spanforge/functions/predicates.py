"""Predicates that all operators share: domains, points in time, tombstones, selectors.

A domain is a dotted path; reading one covers its descendants.  Every predicate is a
plain Column made of comparisons with literals, so that it reaches the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_domains(value: str | Iterable[str]) -> list[str]:
    """Domains in the order given: lists are flattened, commas split, blanks and repeats dropped."""
    parts = [value] if isinstance(value, str) else list(value)
    found = dict.fromkeys(d.strip() for part in parts for d in str(part).split(",") if d.strip())
    if not found:
        raise ValueError("at least one domain is needed")
    return list(found)


def in_domains(column: Column | str, domains: str | Iterable[str], exact: bool = False) -> Column:
    """True for the domains themselves and, unless exact, for those below them."""
    c = F.col(column) if isinstance(column, str) else column
    names = normalize_domains(domains)
    test = c.isin(*names)
    if not exact:
        for d in names:
            test = test | c.startswith(f"{d}.")
    return test


def domains_touch(column: Column | str, domains: str | Iterable[str]) -> Column:
    """True if either domain lies below the other: what tables are matched by."""
    c = F.col(column) if isinstance(column, str) else column
    test = in_domains(c, domains)
    for d in normalize_domains(domains):
        test = test | F.lit(d).startswith(F.concat(c, F.lit(".")))
    return test


def domain_family(domain: str, *holders: DataFrame) -> list[str]:
    """The domain and, sorted, its descendants that any of the holders has rows in.

    One row a domain comes to the driver, which lists them.
    """
    (name,) = normalize_domains(domain)
    below = [h.filter(F.col("domain").startswith(f"{name}.")).select("domain").distinct() for h in holders]
    found = {r[0] for r in reduce(DataFrame.union, below).distinct().collect()} if below else set()
    return [name, *sorted(found)]


def valid_at(as_of: str | None, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity [start, end); rows without a bound are open there; ISO strings compare as text."""
    if as_of is None:
        return F.lit(True)
    a, b = F.col(start), F.col(end)
    return (a.isNull() | (a <= as_of)) & (b.isNull() | (b > as_of))


def snapshot_at(as_of: str, start: str = "valid_from", end: str = "valid_to") -> Column:
    """As valid_at for history, where an unknown end means closed: such rows never hold."""
    a, b = F.col(start), F.col(end)
    return (a.isNull() | (a <= as_of)) & b.isNotNull() & (b > as_of)


AS_OF = re.compile(r"\d{4}(-\d{2}(-\d{2}(T[0-9:.+Zz-]+)?)?)?")


def resolve_as_of(value: str | None, today: dt.date | None = None) -> str | None:
    """A point in time as text: nothing, today or now, or YYYY[-MM[-DD[T...]]]."""
    if value is None or not str(value).strip():
        return None
    text = str(value).strip()
    if text.lower() in ("today", "now"):
        return (today or dt.date.today()).isoformat()
    if not AS_OF.fullmatch(text):
        raise ValueError(f"{value!r} is no point in time")
    return text


def live_chunk(column: str = "deleted") -> Column:
    return ~F.coalesce(F.col(column), F.lit(False))


def live_document(column: str = "status") -> Column:
    return F.coalesce(F.col(column), F.lit("active")) != "deleted"


def selects_entity(ids: Iterable[str] = (), names: Iterable[str] = (), id_column: str = "id", name_column: str = "name") -> Column:
    """Any of the ids exactly; without ids, any of the names contained, in any case."""
    ids, names = list(ids), list(names)
    if ids:
        return F.col(id_column).isin(*ids)
    if not names:
        raise ValueError("an id or a name is needed")
    test = F.lit(False)
    for n in names:
        test = test | F.lower(F.col(name_column)).contains(n.lower())
    return test


LABEL = re.compile(r"[A-Z_][A-Z0-9_]*")


def normalize_label(value: str | None) -> str:
    """A class or relationship name in upper case with underscores; UNKNOWN for none."""
    made = re.sub(r"\W+", "_", (value or "").strip()).strip("_").upper() or "UNKNOWN"
    if not LABEL.fullmatch(made):
        raise ValueError(f"{value!r} makes no label")
    return made


def label_column(column: Column | str) -> Column:
    """normalize_label as an expression; what makes no label becomes UNKNOWN."""
    c = F.col(column) if isinstance(column, str) else column
    made = F.upper(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\W+", "_"), "^_+|_+$", ""))
    return F.when(made.rlike("^[A-Z_][A-Z0-9_]*$"), made).otherwise("UNKNOWN")


INTERNAL = ("embedding", "_prop_sources")


def without_internal(df: DataFrame) -> DataFrame:
    """df without internal columns, also inside maps of properties."""
    out = df.drop(*INTERNAL)
    for name, kind in out.dtypes:
        if kind.startswith("map<string,"):
            out = out.withColumn(name, F.map_filter(name, lambda k, _: ~k.isin(*INTERNAL)))
    return out


def flatten_props(props: Column | str) -> Column:
    """A map of properties without those that are null, empty text or an empty list."""
    return F.map_filter(props, lambda _, v: v.isNotNull() & ~v.isin("", "[]", "null"))


def envelope(domains: str | Iterable[str], **rest) -> dict:
    """What wraps a result: `domains` always, `domain` beside it if there is just one."""
    names = normalize_domains(domains)
    return {"domains": names, **({"domain": names[0]} if len(names) == 1 else {}), **rest}


MODES = {"mode": ("shortest", "all"), "degree_mode": ("relations", "mentions", "all")}


def validate(pattern: str, given: dict, needed: dict[str, tuple[str, ...]]) -> None:
    """Each needed parameter, or one of its alternatives, is there; enumerated ones have a known value."""
    for name, alternatives in needed.items():
        if not any(given.get(k) for k in (name, *alternatives)):
            raise ValueError(f"{pattern} needs {' or '.join((name, *alternatives))}")
    for name, values in MODES.items():
        if given.get(name) is not None and given[name] not in values:
            raise ValueError(f"{name} is one of {', '.join(values)}")
