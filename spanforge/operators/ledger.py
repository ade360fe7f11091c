"""Properties with their sources: ordered accretive merging, upserts, edges, retraction.

A ledger is rows (entity key, property, doc_id, ord, value).  What a property is, is the
fold of its rows in order; the fold isn't associative, so it runs over an ordered list.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINER = " | "
#: Relationship types that only the engine writes.
RESERVED = ("SUPERSEDES", "EXTRACTED_FROM", "PRIOR_STATE")


def fold_strings(values: Column) -> Column:
    """Texts in order joined with ` | `, leaving out what is part of what is there; null for none."""
    return F.aggregate(
        F.filter(
            values, lambda v: v.isNotNull() & (v != "")
        ), F.lit(None).cast("string"), lambda s, v: F.when(s.isNull(), v).when(s.contains(v), s).otherwise(F.concat(s, F.lit(JOINER), v))
    )


def fold_lists(values: Column) -> Column:
    """Lists in order joined, each element once, at its first place."""
    return F.array_distinct(F.flatten(values))


def fold_first(values: Column) -> Column:
    """The first value that isn't null."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def merge_value(old, new):
    """What a property is after a further value: lists and single values unite, texts are joined, the rest stays as it was."""
    if old is None:
        return new
    if isinstance(old, list):
        more = new if isinstance(new, list) else [new]
        return [*old, *(x for i, x in enumerate(more) if x not in old and x not in more[:i])]
    if isinstance(new, list):
        return new if old in new else [old, *new]
    if isinstance(old, str) and isinstance(new, str) and new and new not in old:
        return f"{old}{JOINER}{new}"
    return old


def _fold_json(values: pd.Series) -> pd.Series:
    out = []
    for texts in values:
        now = None
        for text in texts:
            new = json.loads(text) if text is not None else None
            now = now if new in (None, "", []) and not isinstance(new, bool) else merge_value(now, new)
        out.append(None if now is None else json.dumps(now, ensure_ascii=False))
    return pd.Series(out, dtype="object")


def fold_mixed(values: Column) -> Column:
    """An ordered array of JSON texts folded with merge_value, as JSON text: for properties of mixed types; null for none."""
    return F.pandas_udf(_fold_json, "string")(values)


def fold(ledger: DataFrame, *key: str, mixed: bool = False) -> DataFrame:
    """(key, property, value) of a ledger (key, property, doc_id, ord, value): each property folded in order.

    Values are texts; or, if `mixed`, JSON texts of strings, numbers and lists.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc_id", "value"))), lambda x: x["value"])
    return ledger.groupBy(*key, "property").agg(ordered.alias("values")).select(
        *key, "property", (fold_mixed if mixed else fold_strings)(F.col("values")).alias("value")
    ).filter("value IS NOT NULL")


def record(ledger: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """The ledger with new rows: a document's older value is replaced where it stands, others are appended.

    Rows without doc_id are what was there before there was a ledger; nothing replaces them.
    """
    on = [*key, "property", "doc_id"]
    fresh = new.groupBy(*on).agg(F.max_by("value", "ord").alias("new_value"), F.min("ord").alias("new_ord"))
    kept = ledger.join(fresh.select(*on, "new_value"), on, "left").withColumn("value", F.coalesce("new_value", "value")).select(*on, "ord", "value")
    added = fresh.join(ledger.select(*on), on, "left_anti")
    base = ledger.groupBy(*key, "property").agg((F.max("ord") + 1).alias("base"))
    place = F.row_number().over(Window.partitionBy(*key, "property").orderBy("new_ord", "doc_id")) - 1
    added = added.join(base, [*key, "property"], "left").withColumn("ord", F.coalesce("base", F.lit(0)) + place).select(
        *on, "ord", F.col("new_value").alias("value")
    )
    return kept.unionByName(added)


def drop_source(ledger: DataFrame, doc_id) -> DataFrame:
    """The ledger without what a document said; the older base stays."""
    return ledger.filter(F.col("doc_id").isNull() | (F.col("doc_id") != doc_id))


def upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, name, entity_class, domain, description, aliases): one a (name, class, domain).

    Ids that are there stay; descriptions and aliases are folded in order.
    """
    key = ["name", "entity_class", "domain"]
    both = existing.select("id", *key, "description", "aliases", F.lit(0).alias("leg"), F.lit(0).alias("ord")).unionByName(
        incoming.select("id", *key, "description", "aliases", F.lit(1).alias("leg"), F.col("ord"))
    )
    rows = F.array_sort(F.collect_list(F.struct("leg", "ord", "id", "description", "aliases")))
    out = both.groupBy(*key).agg(rows.alias("r"))
    return out.select(
        F.get("r", F.lit(0))["id"].alias("id"),
        *key,
        fold_strings(F.transform("r", lambda x: x["description"])).alias("description"),
        fold_lists(F.transform("r", lambda x: F.coalesce(x["aliases"], F.array().cast("array<string>")))).alias("aliases"),
    )


def write_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(src_id, dst_id, rel_type, doc_ids, chunk_ids): one a triple, with the union of its sources.

    Reserved types are left out; an edge that holds both ways comes with its twin.
    """
    new = incoming.filter(~F.col("rel_type").isin(*RESERVED))
    twin = new.filter(F.coalesce(F.col("bidirectional"), F.lit(False))).select(
        F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "rel_type", "doc_id", "chunk_id"
    )
    new = new.select("src_id", "dst_id", "rel_type", "doc_id", "chunk_id").unionByName(twin)
    rows = new.groupBy("src_id", "dst_id", "rel_type").agg(F.collect_set("doc_id").alias("new_docs"), F.collect_set("chunk_id").alias("new_chunks"))
    out = existing.join(rows, ["src_id", "dst_id", "rel_type"], "full_outer")
    none = F.array().cast("array<string>")
    union = lambda a, b: F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
    return out.select(
        "src_id",
        "dst_id",
        "rel_type",
        union(F.col("doc_ids"), F.col("new_docs")).alias("doc_ids"),
        union(F.col("chunk_ids"), F.col("new_chunks")).alias("chunk_ids"),
    )


def retract_edges(edges: DataFrame, doc_id: str) -> DataFrame:
    """Edges without a document as source; those it alone had go, those that never had sources stay."""
    left = F.filter("doc_ids", lambda d: d != doc_id)
    return edges.withColumn("doc_ids", left).filter(F.col("doc_ids").isNull() | (F.size("doc_ids") > 0))


def retract(doc_id: str, edges: DataFrame, ledger: DataFrame, chunks: DataFrame, chunk_links: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """Edges, ledger, chunks, chunk links and entities after a document was taken back.

    Only entities that the document touched, and that no chunk is left for, go.
    """
    gone = chunks.filter(F.col("doc_id") == doc_id).select("chunk_id")
    links = chunk_links.join(gone, "chunk_id", "left_anti")
    touched = chunk_links.join(gone, "chunk_id", "left_semi").select("entity_id").distinct()
    orphans = touched.join(links.select("entity_id"), "entity_id", "left_anti")
    return {
        "edges": retract_edges(edges, doc_id),
        "ledger": drop_source(ledger, doc_id),
        "chunks": chunks.filter(F.col("doc_id") != doc_id),
        "chunk_links": links,
        "entities": entities.join(orphans.withColumnRenamed("entity_id", "id"), "id", "left_anti"),
    }
