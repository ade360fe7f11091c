"""Documents in time: dates from headers, supersession, retirement and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import frontmatter_map, header_value, iso_date, leading_number, title_stem
from ..plans.scratch import Scratch

#: Labels that documents use for a date or version.
LABELS = {
    "valid_from": ("Effective Date", "Effective", "Valid From"),
    "valid_to": ("Expiry Date", "Valid To", "Expires"),
    "version": ("Version",),
    "supersedes": ("Supersedes", "Replaces"),
}


def lift_header(documents: DataFrame, ingested: str, labels: dict[str, tuple[str, ...]] = LABELS, date_column: str | None = "date") -> DataFrame:
    """documents with valid_from, valid_to, version_label, version_number and valid_from_inferred.

    A label's table row comes first, then a line `Label: value`, then frontmatter, then the date
    column; without any a document holds from its ingestion, and is marked so.
    """
    front = F.when(F.col("text").startswith("---"), frontmatter_map(F.col("text")))

    def found(kind: str) -> Column:
        names = labels.get(kind, ())
        return F.coalesce(
            *[header_value(F.col("text"), n) for n in names], *[front[n.lower().replace(" ", "_")] for n in names], F.lit(None).cast("string")
        )

    raw = documents.withColumns({"_from": found("valid_from"), "_to": found("valid_to"), "version_label": found("version")})
    given = [iso_date(F.col("_from"))]
    if date_column and date_column in documents.columns:
        given.append(iso_date(F.col(date_column).cast("string")))
    dated = raw.withColumns(
        {"_start": F.coalesce(*given), "valid_to": iso_date(F.col("_to")), "version_number": leading_number(F.col("version_label"))}
    )
    return dated.withColumns(
        {"valid_from": F.coalesce("_start", F.lit(ingested)), "valid_from_inferred": F.col("_start").isNull()}
    ).drop("_from", "_to", "_start")


def inherit(parent: dict, child: dict) -> dict:
    """A domain's temporal settings below its parent's.

    Defaults are overridden one by one, the child's anchor wins, document lists are joined with
    the parent's first, and the child's entity settings replace the parent's.
    """
    out = {**parent, **{k: v for k, v in child.items() if k not in ("defaults", "document", "entities")}}
    out["defaults"] = {**parent.get("defaults", {}), **child.get("defaults", {})}
    a, b = parent.get("document", {}), child.get("document", {})
    out["document"] = {k: list(dict.fromkeys([*a.get(k, []), *b.get(k, [])])) for k in dict.fromkeys([*a, *b])}
    out["entities"] = child["entities"] if child.get("entities") else parent.get("entities", {})
    return out


def entity_dates(entities: DataFrame, mapped: dict[str, str], props: str = "props") -> DataFrame:
    """entities with canonical dates from mapped properties; what doesn't parse is kept as `<date>_raw`.

    mapped: canonical name (valid_from, valid_to, event_at) to the property that holds it.
    """
    out = entities
    for name, prop in mapped.items():
        raw = F.col(props)[prop]
        parsed = iso_date(raw)
        out = out.withColumns(
            {
                name: F.coalesce(F.col(name), parsed) if name in entities.columns else parsed,
                f"{name}_raw": F.when(raw.isNotNull() & parsed.isNull(), raw),
            }
        )
    return out


def normalize_time(documents: DataFrame, chunks: DataFrame, lifted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks with dates filled in where there were none, and (documents, chunks) changed.

    Additive: a date that is there stays.  Chunks take over their document's bounds.
    """
    new = lifted.select("id", F.col("valid_from").alias("new_from"), F.col("valid_to").alias("new_to"))
    docs = documents.join(new, "id", "left").withColumn("touched", F.col("valid_from").isNull() & F.col("new_from").isNotNull())
    docs = docs.withColumns({"valid_from": F.coalesce("valid_from", "new_from"), "valid_to": F.coalesce("valid_to", "new_to")})
    bounds = docs.select(F.col("id").alias("doc_id"), F.col("valid_from").alias("doc_from"), F.col("valid_to").alias("doc_to"))
    parts = chunks.join(bounds, "doc_id", "left").withColumns(
        {"valid_from": F.coalesce("doc_from", "valid_from"), "valid_to": F.coalesce("doc_to", "valid_to")}
    ).select(*chunks.columns)
    changed = docs.agg(F.count_if("touched").alias("documents")).crossJoin(
        bounds.filter("doc_from IS NOT NULL").join(chunks.select("doc_id"), "doc_id").agg(F.count("*").alias("chunks"))
    )
    return docs.select(*documents.columns), parts, changed


#: The section that tells what a document supersedes, up to the next heading or rule.
NOTICE_SECTION = r"(?is)##\s*Supersession Notice[^\S\n]*\n(.*?)(?=\n##|\n---|\z)"
#: A superseded version, and its own date in brackets, which isn't the date of the change.
NOTICE_VERSION = r"(?i)(supersedes?[^\n]*?\bVersion\s+(\d+(?:\.\d+){0,9}))(\s*\([^)]*\))?"
NOTICE_DATE = r"(?i)effective(?:\s+date)?[:\s]+(?:from\s+)?(\d{4}-\d{2}-\d{2}|\d{1,2}\s+[a-z]+\s+\d{4})"


def notices(documents: DataFrame) -> DataFrame:
    """(id, kind, target, effective) of what documents say that they supersede, one row a kind.

    `notice`: a section called Supersession Notice names an older version.  `table`: a header row
    or line `Supersedes` names another document; `none` names nothing.  A document may have both.
    """
    empty = F.lit("")
    hinted = documents.filter(F.lower("text").contains("supersed")).select(
        "id",
        F.regexp_extract("text", NOTICE_SECTION, 1).alias("section"),
        header_value(F.col("text"), "Supersedes").alias("named"),
        header_value(F.col("text"), "Effective Date").alias("effective"),
    )
    hinted = hinted.select(
        "id",
        F.nullif(F.regexp_extract("section", NOTICE_VERSION, 2), empty).alias("version"),
        F.regexp_extract(F.regexp_replace("section", NOTICE_VERSION, "$1"), NOTICE_DATE, 1).alias("day"),
        F.trim(F.coalesce(F.nullif(F.regexp_extract("named", r"\[\[([^\]|#]+)", 1), empty), "named")).alias("named"),
        "effective",
    )
    notice = F.struct(F.lit("notice").alias("kind"), F.col("version").alias("target"), F.col("day").alias("effective"))
    name = F.when((F.col("named") != "") & (F.lower("named") != "none"), F.col("named"))
    table = F.struct(F.lit("table").alias("kind"), name.alias("target"), F.col("effective"))
    said = hinted.select("id", F.explode(F.array(notice, table)).alias("n")).select("id", "n.*").filter("target IS NOT NULL")
    return said.withColumn("effective", iso_date(F.col("effective")))


def _the_other(groups: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """asked (id, *key) with `older`: the group's only member besides id itself, if there is just one.

    groups: (*key, n, least, most), one row a key, so nothing is multiplied.
    """
    own = (F.col("least") == F.col("id")) | (F.col("most") == F.col("id"))
    other = F.when((F.col("n") == 1) & ~own, F.col("least")).when(
        (F.col("n") == 2) & own, F.when(F.col("least") == F.col("id"), F.col("most")).otherwise(F.col("least"))
    )
    return asked.join(groups, key, "left").withColumn("older", other).drop("n", "least", "most")


def resolve_versions(said: DataFrame, documents: DataFrame) -> DataFrame:
    """(newer, older, effective, kind), one a newer document at most.

    A notice's version is the one other document of that version in the domain, or else the one
    of the same stem; where that tells nothing, the document named in the table counts.
    Documents are summed up by version first; nobody meets all of a version.
    """
    docs = documents.select("id", "domain", title_stem(F.col("name")).alias("stem"), F.col("version_number").alias("target"))
    counts = (F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))
    by_stem = docs.filter("target IS NOT NULL").groupBy("domain", "target", "stem").agg(*counts)
    by_version = by_stem.groupBy("domain", "target").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    asked = said.filter("kind = 'notice'").join(docs.drop("target"), "id")
    asked = _the_other(by_version, asked, ["domain", "target"]).withColumnRenamed("older", "only")
    asked = _the_other(by_stem, asked, ["domain", "target", "stem"]).withColumn("older", F.coalesce("only", "older"))
    noticed = asked.filter("older IS NOT NULL").select(F.col("id").alias("newer"), "older", "effective", F.lit("notice").alias("kind"))
    named = said.filter("kind = 'table'").select("id", "effective", F.lower("target").alias("name"))
    own = documents.select("id", "domain")
    names = documents.groupBy("domain", F.lower(F.regexp_replace("name", r"\.[A-Za-z0-9]{1,5}$", "")).alias("name")).agg(F.max("id").alias("older"))
    tabled = named.join(own, "id").join(names, ["domain", "name"]).filter("id <> older").select(
        F.col("id").alias("newer"), "older", "effective", F.lit("table").alias("kind")
    )
    return noticed.unionByName(tabled.join(noticed.select("newer"), "newer", "left_anti"))


def family_chain(documents: DataFrame) -> DataFrame:
    """(newer, older, effective, kind): consecutive documents of one stem and domain by start; equal starts are skipped."""
    rows = documents.filter("valid_from IS NOT NULL").select("id", "domain", title_stem(F.col("name")).alias("stem"), "valid_from")
    starts = rows.groupBy("domain", "stem", "valid_from").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    w = Window.partitionBy("domain", "stem").orderBy("valid_from")
    chain = starts.withColumns({"older": F.lag("id").over(w), "older_n": F.lag("n").over(w)})
    return chain.filter("older IS NOT NULL AND n = 1 AND older_n = 1").select(
        F.col("id").alias("newer"), "older", F.col("valid_from").alias("effective"), F.lit("family").alias("kind")
    )


def detect_supersession(documents: DataFrame, families: bool = True) -> DataFrame:
    """(newer, older, effective, kind), one a pair: a notice goes before a table row, that before a family.

    Texts are read once: what they say, and what else is needed of the documents, is written first.
    """
    scratch = Scratch(documents.sparkSession, "supersession")
    said = scratch.save(notices(documents), "said")
    documents = scratch.save(documents.select("id", "domain", "name", "version_number", "valid_from"), "documents")
    found = resolve_versions(said, documents)
    if families:
        found = found.unionByName(family_chain(documents))
    order = F.when(F.col("kind") == "notice", 0).when(F.col("kind") == "table", 1).otherwise(2)
    best = found.groupBy("newer", "older").agg(
        F.min_by(F.struct("effective", "kind"), F.struct(order, F.col("effective"))).alias("b")
    ).select("newer", "older", "b.*")
    starts = documents.select(F.col("id").alias("newer"), F.col("valid_from").alias("starts"))
    return best.join(starts, "newer", "left").select("newer", "older", F.coalesce("effective", "starts").alias("effective"), "kind")


def apply_supersession(
    pairs: DataFrame, documents: DataFrame, chunks: DataFrame, entities: DataFrame, sources: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and entities after supersession.

    The older document and its chunks end when the newer one starts to hold, whatever they
    said before; entities that have no other document end then too, unless they had an end.
    sources: (entity_id, doc_id).
    """
    ends = pairs.groupBy(F.col("older").alias("id")).agg(
        F.min("effective").alias("effective"), F.min_by("newer", F.struct("effective", "newer")).alias("by")
    )
    docs = documents.join(ends, "id", "left").withColumns(
        {
            "valid_to": F.coalesce("effective", "valid_to"),
            "superseded_by": F.coalesce("by", "superseded_by") if "superseded_by" in documents.columns else F.col("by"),
        }
    )
    docs = docs.drop("effective", "by")
    parts = chunks.join(
        ends.select(F.col("id").alias("doc_id"), "effective"), "doc_id", "left"
    ).withColumn("valid_to", F.coalesce("effective", "valid_to")).select(*chunks.columns)
    only = sources.groupBy("entity_id").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    retired = only.join(ends.select(F.col("id").alias("doc_id"), "effective"), "doc_id").select(F.col("entity_id").alias("id"), "effective")
    ents = entities.join(retired, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "effective")).select(*entities.columns)
    return docs, parts, ents


def supersede_nodes(pairs: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, entities): SUPERSEDES from the newer to the older entity, which keeps any end it had."""
    edges = pairs.select(F.col("newer").alias("src_id"), F.col("older").alias("dst_id"), F.lit("SUPERSEDES").alias("rel_type"), "effective")
    ends = pairs.groupBy(F.col("older").alias("id")).agg(
        F.min("effective").alias("effective"), F.min_by("newer", F.struct("effective", "newer")).alias("by")
    )
    out = entities.join(ends, "id", "left")
    out = out.withColumns(
        {
            "valid_to": F.coalesce("valid_to", "effective"),
            "status": F.when(F.col("by").isNotNull(), "superseded").otherwise(F.col("status") if "status" in entities.columns else F.lit(None)),
            "superseded_by": F.col("by"),
        }
    )
    return edges, out.drop("effective", "by")


def snapshot_changes(before: DataFrame, after: DataFrame, history: DataFrame, newer_doc: str, at: str) -> DataFrame:
    """New rows (entity_id, props, valid_from, valid_to, closed_by, snapshot_at) for the history.

    Only properties whose value changed or went are kept, as they were before; an entity
    is recorded once a newer document.  before, after: (id, props, valid_from).
    """
    b = before.select(F.col("id").alias("entity_id"), F.col("props").alias("old"), "valid_from")
    a = after.select(F.col("id").alias("entity_id"), F.col("props").alias("new"), F.col("valid_from").alias("new_from"))
    both = b.join(a, "entity_id")
    both = both.withColumn("props", F.map_filter("old", lambda k, v: ~v.eqNullSafe(F.col("new")[k]))).filter(F.size("props") > 0)
    done = history.filter(F.col("closed_by") == newer_doc).select("entity_id").distinct()
    return both.join(done, "entity_id", "left_anti").select(
        "entity_id", "props", "valid_from", F.col("new_from").alias("valid_to"), F.lit(newer_doc).alias("closed_by"), F.lit(at).alias("snapshot_at")
    )
