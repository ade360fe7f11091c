"""Where the graph and the tables meet: key resolution, hints, classification, questions in words.

Models are injected as callables from a prompt to a text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import domains_touch, normalize_domains
from ..functions.similarity import ratio_column
from ..functions.text import repair_json
from ..plans.guard import check_read_only, isolated

KEY_THRESHOLD, CONFIDENCE_FLOOR = 0.6, 0.4
GRAINS = ("instance", "lookup", "normative")


def fusion_hints(tables: DataFrame, mappings: DataFrame, roles: DataFrame, domains) -> tuple[DataFrame, DataFrame]:
    """(domain, table, column) of bridge columns, and (domain, table) that the graph goes before.

    The latter are normative tables that are mapped to a class.
    """
    here = tables.filter(domains_touch("domain", domains))
    bridges = here.join(
        roles.filter("role = 'bridge'").select("table_id", "column"), "table_id"
    ).select("domain", F.col("name").alias("table"), "column").orderBy("domain", "table", "column")
    held = here.filter("grain = 'normative'").join(
        mappings.select("table_id").distinct(), "table_id", "left_semi"
    ).select("domain", F.col("name").alias("table")).orderBy("domain", "table")
    return bridges, held


def resolve_key(phrase: str, names: DataFrame, values: DataFrame, top_k: int = 5, threshold: float = KEY_THRESHOLD) -> DataFrame:
    """(value, source, score): what a phrase may stand for among entity names and a column's values.

    names, values: (value).  A value that both have, in any case, is one of source `both` with
    the better score; ties go to the graph.
    """
    if top_k < 1:
        raise ValueError("top_k is at least 1")
    leg = lambda df, s: df.filter("value IS NOT NULL").select("value").distinct().select("value", F.lit(s).alias("source"))
    both = leg(names, "graph").unionByName(leg(values, "column")).withColumn(
        "score", ratio_column(F.lit(phrase), "value")
    ).filter(F.col("score") >= threshold)
    one = both.groupBy(F.lower("value").alias("low")).agg(
        F.max("score").alias("score"),
        F.collect_set("source").alias("sources"),
        F.max_by("value", F.struct(F.col("source") == "graph", "score", "value")).alias("value"),
    )
    source = F.when(F.size("sources") == 2, "both").otherwise(F.get("sources", F.lit(0)))
    order = F.when(source == "column", 1).otherwise(0)
    return one.select("value", source.alias("source"), "score", order.alias("o")).orderBy(F.desc("score"), "o", "value").limit(top_k).drop("o")


def classify_columns(
    answer: str, columns: list[str], classes: list[str], confirmed: set[tuple[str, str]] = frozenset(), floor: float = CONFIDENCE_FLOOR
) -> dict:
    """A model's answer about a table as {grain, mappings, bridges}.

    Columns and classes that aren't there are dropped, and so is what it is too unsure of;
    what somebody confirmed isn't overwritten.
    """
    got = repair_json(answer)
    got = got if isinstance(got, dict) else {}
    sure = lambda x: isinstance(x, dict) and float(x.get("confidence") or 0) >= floor
    mappings = [
        {
            "column": m["column"], "entity_class": m["entity_class"], "confidence": float(m["confidence"])
        } for m in got.get("mappings") or [] if sure(m) and m.get("column") in columns and m.get("entity_class") in classes and (
            m["column"], m["entity_class"]
        ) not in confirmed
    ]
    bridges = [b["column"] for b in got.get("bridges") or [] if sure(b) and b.get("column") in columns]
    grain = got.get("grain")
    return {"grain": grain if grain in GRAINS else None, "mappings": mappings, "bridges": list(dict.fromkeys(bridges))}


def classify_table(
    prompt: str,
    model: Callable[[str], str],
    columns: list[str],
    classes: list[str],
    confirmed: set[tuple[str, str]] = frozenset(),
    known_columns: set[str] | None = None,
) -> tuple[dict, str]:
    """(classification, status): ok or failed.  With known_columns only new columns are asked about."""
    asked = [c for c in columns if known_columns is None or c not in known_columns]
    if not asked:
        return {"grain": None, "mappings": [], "bridges": []}, "ok"
    try:
        return classify_columns(model(prompt), asked, classes, confirmed), "ok"
    except Exception:  # noqa: BLE001  a step of its own, that can be done again
        return {"grain": None, "mappings": [], "bridges": []}, "failed"


def classify_all(tables: list[dict], run: Callable[[dict], str], progress: Callable[[int, int], None] | None = None) -> list[dict]:
    """Tables with the status of their classification; those that are ok aren't run again."""
    out = []
    for i, t in enumerate(tables):
        out.append(t if t.get("status") == "ok" else {**t, "status": run(t)})
        if progress:
            progress(i + 1, len(tables))
    return out


def upsert_rows(existing: DataFrame, new: DataFrame, key: list[str], confirmed: str = "confirmed") -> DataFrame:
    """existing with new rows by key; rows that somebody confirmed stay as they are."""
    held = existing.filter(F.coalesce(F.col(confirmed), F.lit(False)))
    fresh = new.select(*existing.columns).join(held.select(*key), key, "left_anti").dropDuplicates(key)
    return existing.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def confirm_rows(existing: DataFrame, where, confirmed: bool = True) -> DataFrame:
    return existing.withColumn("confirmed", F.when(where, F.lit(confirmed)).otherwise(F.col("confirmed")))


def clear_rows(existing: DataFrame, where) -> DataFrame:
    return existing.filter(~F.coalesce(where, F.lit(False)))


def check_grain(grain: str, confirmed: bool, refresh_mode: str) -> None:
    """A table confirmed as normative keeps its history."""
    if grain not in GRAINS:
        raise ValueError(f"grain is one of {', '.join(GRAINS)}")
    if grain == "normative" and confirmed and refresh_mode != "temporal":
        raise ValueError("a confirmed normative table needs temporal refresh")


def catalogue(tables: DataFrame, columns: DataFrame, mappings: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, kind, name, row_count) and edges (src, dst, rel_type, confirmed) of a domain family's tables."""
    here = tables.filter((F.col("domain") == domain) | F.col("domain").startswith(f"{domain}."))
    key = F.concat_ws("/", "domain", "name")
    cols = columns.join(here.select("table_id", key.alias("table_key")), "table_id").select(
        F.concat_ws("/", "table_key", "column").alias("key"), F.col("column").alias("name"), "table_key"
    )
    maps = mappings.join(here.select("table_id", key.alias("table_key")), "table_id")
    none = F.lit(None).cast("long")
    nodes = here.select(key.alias("key"), F.lit("Table").alias("kind"), "name", "row_count").unionByName(
        cols.select("key", F.lit("TableColumn").alias("kind"), "name", none.alias("row_count"))
    ).unionByName(
        maps.select(
            F.col("entity_class").alias("key"), F.lit("EntityClass").alias("kind"), F.col("entity_class").alias("name"), none.alias("row_count")
        ).distinct()
    )
    edges = cols.select(
        F.col("table_key").alias("src"), F.col("key").alias("dst"), F.lit("HAS_COLUMN").alias("rel_type"), F.lit(True).alias("confirmed")
    ).unionByName(
        maps.select(
            F.concat_ws("/", "table_key", "column").alias("src"), F.col("entity_class").alias("dst"), F.lit("MAPS_TO").alias("rel_type"), "confirmed"
        )
    )
    return nodes, edges


def review_queue(tables: DataFrame, mappings: DataFrame, roles: DataFrame) -> DataFrame:
    """(domain, table, open_mappings, open_roles, grain_open): tables with anything left to confirm."""
    is_open = ~F.coalesce("confirmed", F.lit(False))
    m = mappings.filter(is_open).groupBy("table_id").agg(F.count("*").alias("open_mappings"))
    r = roles.filter(is_open).groupBy("table_id").agg(F.count("*").alias("open_roles"))
    zero = F.lit(0).cast("long")
    rows = tables.join(m, "table_id", "left").join(r, "table_id", "left").withColumns(
        {
            "open_mappings": F.coalesce("open_mappings", zero),
            "open_roles": F.coalesce("open_roles", zero),
            "grain_open": F.col("grain").isNotNull() & ~F.coalesce("grain_confirmed", F.lit(False)),
        }
    )
    return rows.filter("open_mappings > 0 OR open_roles > 0 OR grain_open").select(
        "domain", F.col("name").alias("table"), "open_mappings", "open_roles", "grain_open"
    ).orderBy("domain", "table")


def placement(answer: str, vocabulary: dict[str, set[str]], floor: float = CONFIDENCE_FLOOR, most_tags: int = 5) -> dict:
    """Where a document may be filed: {field: {value, confidence, known}}, tags at most five.

    Confidence is clamped to 0..1, and what lies below the floor counts as 0.
    """
    got = repair_json(answer)
    got = got if isinstance(got, dict) else {}

    def one(field: str, x) -> dict | None:
        x = x if isinstance(x, dict) else {"value": x, "confidence": 0}
        value = str(x.get("value") or "").strip()
        if not value:
            return None
        try:
            c = min(1.0, max(0.0, float(x.get("confidence") or 0)))
        except (TypeError, ValueError):
            c = 0.0
        return {"value": value, "confidence": c if c >= floor else 0.0, "known": value in vocabulary.get(field, set())}

    out = {f: one(f, got.get(f)) for f in ("domain", "project", "area")}
    out["tags"] = [t for t in (one("tags", x) for x in (got.get("tags") or [])[:most_tags]) if t]
    return out


def schema_summary(tables: list[dict]) -> str:
    """Tables and columns as text for a prompt."""
    lines = []
    for t in tables:
        lines.append(f"{t['view']} ({t.get('row_count', '?')} rows)")
        lines += [f"  {c['name']} {c['type']}" + (f" values: {', '.join(c['sample'])}" if c.get("sample") else "") for c in t["columns"]]
    return "\n".join(lines)


def ask_tables(
    spark: SparkSession,
    question: str,
    model: Callable[[str], str],
    views: dict[str, DataFrame],
    summary: str,
    domains,
    as_of: str | None = None,
    dry_run: bool = False,
    hints: dict | None = None,
) -> dict:
    """A question answered by a query that a model writes: {domains, sql, rows, hints}.

    The query is checked to only read, and runs where only the given views are.
    """
    names = normalize_domains(domains)
    prompt = f"Tables:\n{summary}\nDomains: {', '.join(names)}\n" + (
        f"As of: {as_of}\n" if as_of else ""
    ) + f"Question: {question}\nAnswer as JSON with the key sql."
    got = repair_json(model(prompt))
    sql = got.get("sql") if isinstance(got, dict) else None
    if not sql:
        raise ValueError("the model gave no query")
    session = isolated(spark, views)
    check_read_only(session, sql, views=views)
    return {"domains": names, "sql": sql, "rows": None if dry_run else session.sql(sql), "hints": hints or {}}


def ask_graph(
    spark: SparkSession,
    question: str,
    model: Callable[[str], str],
    views: dict[str, DataFrame],
    schema: str,
    listing: dict[str, list[str]],
    domains,
    as_of: str | None = None,
    dry_run: bool = False,
    names_per_type: int = 20,
) -> dict:
    """As ask_tables over the graph's views; the query must refer to :domains, and may to :as_of."""
    names = normalize_domains(domains)
    known = "\n".join(f"{k}: {', '.join(v[:names_per_type])}" for k, v in listing.items())
    got = repair_json(
        model(f"Graph:\n{schema}\nEntities:\n{known}\nQuestion: {question}\nAnswer as JSON with the key query, which filters by :domains.")
    )
    sql = got.get("query") if isinstance(got, dict) else None
    if not sql or ":domains" not in sql:
        raise ValueError("the query must refer to :domains")
    session = isolated(spark, views)
    args = {"domains": F.array(*map(F.lit, names)), **({"as_of": as_of} if ":as_of" in sql else {})}
    check_read_only(session, sql, args, views)
    return {"domains": names, "query": sql, "rows": None if dry_run else session.sql(sql, args=args)}


def as_json(rows: DataFrame, limit: int) -> str:
    """At most `limit` rows as JSON text for an answer."""
    return json.dumps([r.asDict(recursive=True) for r in rows.limit(limit).collect()], default=str)
