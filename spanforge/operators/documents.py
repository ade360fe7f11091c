"""Documents as they change: identity, deltas, metadata, deletion, commits, conversational updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METADATA = ("title", "project", "area", "tags", "author", "date")
DENORMALISED = ("project", "area", "tags")
BULK_CHARS = 500


def logical_id(domain: Column, key: Column) -> Column:
    """The identity that a document keeps over its versions."""
    return F.sha1(F.concat(domain, F.lit("\x00"), key))


def new_files(incoming: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """incoming (path, sha256, ..) with `action`: skipped for a content that is known, else ingest."""
    seen = known.select("sha256").distinct().withColumn("seen", F.lit(True))
    rows = incoming.join(seen, "sha256", "left")
    return rows.withColumn("action", F.when(F.coalesce("seen", F.lit(False)) & F.lit(not force), "skipped").otherwise("ingest")).drop("seen")


def unique_names(incoming: DataFrame, known: DataFrame, stamp: str) -> DataFrame:
    """incoming with a time stamp behind names that another identity has in the domain."""
    taken = known.select("domain", "name", F.col("logical_id").alias("other")).distinct()
    rows = incoming.join(taken, ["domain", "name"], "left")
    clash = F.col("other").isNotNull() & (F.col("other") != F.col("logical_id"))
    return rows.groupBy(*incoming.columns).agg(F.max(clash).alias("clash")).withColumn(
        "name", F.when(F.col("clash"), F.concat_ws("_", "name", F.lit(stamp))).otherwise(F.col("name"))
    ).select(*incoming.columns)


def resolve_identity(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming (id, logical_id, domain, ..) with the known id and the next version where there is one."""
    last = known.groupBy("logical_id", "domain").agg(F.max_by("id", "version").alias("known_id"), F.max("version").alias("known_version"))
    rows = incoming.join(last, ["logical_id", "domain"], "left")
    return rows.withColumns(
        {"id": F.coalesce("known_id", "id"), "version": F.coalesce(F.col("known_version") + 1, F.lit(1))}
    ).drop("known_id", "known_version")


def classify_deltas(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(logical_id, tier): domain_changed, initial, metadata_only or content.

    incoming, known: (logical_id, domain, blocks), where blocks are the chunks' hashes in order.
    """
    k = known.select("logical_id", F.col("domain").alias("known_domain"), F.col("blocks").alias("known_blocks"))
    rows = incoming.join(k, "logical_id", "left")
    same = (F.size("blocks") > 0) & (F.col("blocks") == F.col("known_blocks"))
    tier = F.when(
        F.col("known_domain").isNotNull() & (F.col("known_domain") != F.col("domain")), "domain_changed"
    ).when(F.col("known_domain").isNull(), "initial").when(same, "metadata_only").otherwise("content")
    return rows.select("logical_id", tier.alias("tier"))


def block_lists(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, blocks): each document's block hashes in order."""
    return chunks.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_hash"))), lambda x: x["block_hash"]).alias("blocks")
    )


def apply_metadata(documents: DataFrame, chunks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks with the new metadata: what it has is set, what it hasn't is cleared."""
    fields = [c for c in METADATA if c in documents.columns]
    mine = new.select("id", F.lit(True).alias("hit"), *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"new_{c}") for c in fields])
    docs = documents.join(mine, "id", "left").withColumns({c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in fields})
    shared = [c for c in DENORMALISED if c in fields and c in chunks.columns]
    parts = chunks.join(mine.select(F.col("id").alias("doc_id"), "hit", *[f"new_{c}" for c in shared]), "doc_id", "left")
    parts = parts.withColumns({c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in shared})
    return docs.select(*documents.columns), parts.select(*chunks.columns)


def named(documents: DataFrame, name: str) -> Column:
    """Documents by name or by the last part of their path, in any case."""
    wanted = name.lower()
    test = F.lower("name") == wanted
    return test | (F.lower(F.element_at(F.split("path", "/"), -1)) == wanted) if "path" in documents.columns else test


def tombstone(documents: DataFrame, chunks: DataFrame, name: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after a soft delete; nothing is lost."""
    hit = named(documents, name)
    ids = documents.filter(hit).select(F.col("id").alias("doc_id"), F.lit(True).alias("hit"))
    docs = documents.withColumns(
        {
            "status": F.when(hit, "deleted").otherwise(F.col("status")),
            "deleted_at": F.when(hit, F.lit(at)).otherwise(F.col("deleted_at") if "deleted_at" in documents.columns else F.lit(None)),
        }
    )
    parts = chunks.join(ids, "doc_id", "left").withColumn("deleted", F.coalesce("hit", "deleted")).select(*chunks.columns)
    return docs, parts


def purge(documents: DataFrame, name: str) -> DataFrame:
    """Documents after a hard delete; see ledger.retract for what else goes."""
    return documents.filter(~named(documents, name))


def reassert(entities: DataFrame, newer: DataFrame) -> DataFrame:
    """entities (id, props) with the properties that a superseding document gives itself."""
    own = newer.select("id", F.col("props").alias("own"))
    merged = F.when(F.col("own").isNull(), F.col("props")).otherwise(
        F.map_concat(F.map_filter("props", lambda k, _: ~F.array_contains(F.map_keys("own"), k)), "own")
    )
    return entities.join(own, "id", "left").withColumn("props", merged).select(*entities.columns)


STEPS = ("retract", "capture", "write", "normalise", "supersede", "snapshot", "reassert")
BEST_EFFORT = ("normalise", "supersede", "snapshot", "reassert")


def commit(state: dict, hooks: dict[str, Callable[[dict], dict]]) -> tuple[dict, dict[str, str]]:
    """A document's commit: its steps in order over a state of DataFrames; (state, what became of each step).

    The steps behind the write may fail without undoing it.
    """
    told: dict[str, str] = {}
    for step in STEPS:
        if step not in hooks:
            told[step] = "skipped"
            continue
        try:
            state = {**state, **hooks[step](state)}
            told[step] = "ok"
        except Exception as e:  # noqa: BLE001  best-effort steps are told, not raised
            if step not in BEST_EFFORT:
                raise
            told[step] = f"failed: {e}"
    return state, told


def classify_update(text: Column) -> Column:
    """What a note to the graph is: bulk, todo, atomic_fact or passage."""
    t = F.trim(text)
    todo = t.rlike(r"(?i)^(?:todo|to-do|remind me|remember to|\[ \])|^-\s*\[ \]")
    sentences = F.size(F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: s != ""))
    return F.when(F.length(t) > BULK_CHARS, "bulk").when(todo, "todo").when((sentences <= 1) & ~t.contains("\n"), "atomic_fact").otherwise("passage")


def confirm_draft(drafts: DataFrame, entities: DataFrame, chats: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, chats and mentions after drafts (chat_id, raw_text, action, entity_id, name, entity_class, domain, props) are confirmed.

    create makes an entity, link overwrites the properties of one, skip does nothing; every
    confirmed draft leaves its chat and what it mentions.
    """
    done = drafts.filter("action <> 'skip'")
    made = done.filter("action = 'create'").select(F.col("entity_id").alias("id"), "name", "entity_class", "domain", "props").dropDuplicates(["id"])
    linked = done.filter("action = 'link'").groupBy(F.col("entity_id").alias("id")).agg(F.max_by("props", "chat_id").alias("props"))
    ents = reassert(entities, linked).unionByName(made.join(entities.select("id"), "id", "left_anti").select(*entities.columns))
    said = chats.unionByName(
        done.select(F.col("chat_id").alias("id"), "raw_text", "domain").distinct().join(chats.select("id"), "id", "left_anti").select(*chats.columns)
    )
    links = mentions.unionByName(done.select("chat_id", "entity_id")).distinct()
    return ents, said, links


def export_chats(chats: DataFrame, mentions: DataFrame, entities: DataFrame, by_entity: bool = False) -> DataFrame:
    """Chats in order of session and time with their mentioned names; or (entity, texts) by entity."""
    named_ = mentions.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    if by_entity:
        rows = named_.join(chats.select(F.col("id").alias("chat_id"), "raw_text", "created_at"), "chat_id")
        return rows.groupBy("name").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("created_at", "chat_id", "raw_text"))), lambda x: x["raw_text"]).alias("texts")
        ).orderBy("name")
    lists = named_.groupBy(F.col("chat_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("mentions"))
    return chats.join(lists, "id", "left").orderBy("session_id", "created_at", "id")


def last_versions(documents: DataFrame) -> DataFrame:
    """One row a logical document: its last version."""
    w = Window.partitionBy("logical_id", "domain").orderBy(F.desc("version"))
    return documents.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")
