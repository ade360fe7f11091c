"""Aggregates about what is stored: schemas, counts, vocabularies, overviews, profiles, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import domains_touch, in_domains, valid_at

FACETS = ("project", "area", "tags", "domain")
SAMPLE, MOST_CATEGORIES = 25, 200
#: Parts of type names that make a column numeric.
NUMERIC = ("INT", "DOUBLE", "FLOAT", "DECIMAL", "NUMERIC", "REAL", "HUGEINT")


def node_schema(nodes: DataFrame, label: str, props: str) -> DataFrame:
    """(label, property, type): distinct names and types in a map of properties."""
    each = nodes.select(F.col(label).alias("label"), F.explode(F.map_entries(props)).alias("e"))
    v = F.col("e")["value"]
    kind = F.when(v.rlike(r"^-?\d+$"), "INTEGER").when(
        v.rlike(r"^-?\d*\.\d+([eE][-+]?\d+)?$"), "FLOAT"
    ).when(v.isin("true", "false"), "BOOLEAN").when(v.rlike(r"^\["), "LIST").otherwise("STRING")
    return each.filter(v.isNotNull()).select("label", F.col("e")["key"].alias("property"), kind.alias("type")).distinct()


def relationship_schema(edges: DataFrame, props: str) -> DataFrame:
    """(rel_type, property, from_class, to_class), distinct; a type without properties has no rows."""
    return edges.select("rel_type", F.explode(F.map_keys(props)).alias("property"), "from_class", "to_class").distinct()


def structural_counts(**tables: DataFrame) -> DataFrame:
    """(kind, n): rows of each table, deleted ones included."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filing_vocabulary(documents: DataFrame, domains=None, min_count: int = 1, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, n): how often each value of each facet occurs; lists count by element.

    One pass: every document turns into its facet values, which are summed up before the shuffle.
    """
    rows = documents.filter(in_domains("domain", domains)) if domains else documents
    kinds = dict(rows.dtypes)

    def values(facet: str):
        held = F.col(facet) if kinds[facet].startswith("array") else F.array(F.col(facet))
        return F.transform(held, lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value")))

    lists = [values(f) for f in facets if f in kinds]
    each = rows.select(
        F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<struct<facet:string,value:string>>")) for x in lists])).alias("x")
    ).select("x.*")
    counted = each.filter("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= max(1, min_count)).orderBy("facet", F.desc("n"), "value")


def filing_list(documents: DataFrame, domains, tags=None, as_of: str | None = None, **equal: str) -> DataFrame:
    """Documents that meet all filters, any of the tags, latest first by modified, created or name."""
    rows = documents.filter(in_domains("domain", domains))
    for c, v in equal.items():
        rows = rows.filter(F.col(c) == v)
    if tags:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if as_of:
        rows = rows.filter(valid_at(as_of))
    latest = F.coalesce(*[F.col(c).cast("string") for c in ("modified_on", "created_on", "name") if c in rows.columns])
    return rows.orderBy(F.desc_nulls_last(latest), "id")


def entity_listing(entities: DataFrame, domains, name: str | None = None) -> DataFrame:
    """(entity_class, type, n_names, names): distinct names by class and type."""
    rows = entities.filter(in_domains("domain", domains))
    if name:
        rows = rows.filter(F.lower("name").contains(name.lower()))
    return rows.groupBy("entity_class", "type").agg(F.countDistinct("name").alias("n_names"), F.array_sort(F.collect_set("name")).alias("names"))


def domains_overview(documents: DataFrame, entities: DataFrame, tables: DataFrame | None = None, names: int = 25, classes: int = 8) -> DataFrame:
    """(domain, n_documents, documents, n_entities, classes, n_tables): what each domain holds.

    Lists keep the first names and the most frequent classes; domains with only one kind
    of content are there too.
    """
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("name"))
    docs = documents.withColumn("rank", rank).groupBy("domain").agg(
        F.count("*").alias("n_documents"), F.array_sort(F.collect_list(F.when(F.col("rank") <= names, F.col("name")))).alias("documents")
    )
    by_class = entities.groupBy("domain", "entity_class").agg(F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "entity_class"))
    found = by_class.withColumn("rank", top).groupBy("domain").agg(
        F.sum("n").alias("n_entities"), F.array_sort(F.collect_list(F.when(F.col("rank") <= classes, F.struct("rank", "entity_class")))).alias("c")
    )
    found = found.select("domain", "n_entities", F.transform("c", lambda x: x["entity_class"]).alias("classes"))
    out = docs.join(found, "domain", "full_outer")
    if tables is not None:
        out = out.join(tables.groupBy("domain").agg(F.count("*").alias("n_tables")), "domain", "full_outer")
    else:
        out = out.withColumn("n_tables", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("n_documents", "n_entities", "n_tables")}).withColumns(
        {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("documents", "classes")}
    )


def is_numeric(type_name: str) -> bool:
    return any(p in type_name.upper() for p in NUMERIC)


def profile(df: DataFrame) -> DataFrame:
    """(column, kind, null_rate, cardinality, min, max, sample): one aggregate over all columns.

    Numeric columns have their least and greatest value; others their exact number of distinct
    values, and the first values in order if there are at most 200.
    """
    kinds = dict(df.dtypes)
    sums = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        sums.append(F.count(F.col(f"`{c}`")).alias(f"v{i}"))
        if is_numeric(kinds[c]):
            sums += [F.min(f"`{c}`").cast("double").alias(f"lo{i}"), F.max(f"`{c}`").cast("double").alias(f"hi{i}")]
    one = df.agg(*sums)
    others = [c for c in df.columns if not is_numeric(kinds[c])]
    none = "array<string>"
    if others:
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in others])).alias("x")
        distinct = df.select(values).select("x.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.lit(1).alias("one"))
        rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
        # the ranks are only needed up to the sample's size: the window keeps no more of a column
        first = distinct.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE).groupBy("column").agg(
            F.array_sort(F.collect_list("value")).alias("sample")
        )
        found = distinct.groupBy("column").agg(F.count("*").alias("cardinality")).join(first, "column")
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.col("n"),
                    F.col(f"v{i}").alias("v"),
                    (F.col(f"lo{i}") if is_numeric(kinds[c]) else F.lit(None).cast("double")).alias("min"),
                    (F.col(f"hi{i}") if is_numeric(kinds[c]) else F.lit(None).cast("double")).alias("max"),
                    F.lit(is_numeric(kinds[c])).alias("numeric"),
                ) for i, c in enumerate(df.columns)
            ]
        )
    )
    out = one.select(rows.alias("x")).select("x.*")
    out = out.join(F.broadcast(found), "column", "left") if others else out.withColumns(
        {"cardinality": F.lit(None).cast("long"), "sample": F.lit(None).cast(none)}
    )
    rate = F.when(F.col("n") > 0, (F.col("n") - F.col("v")) / F.col("n")).otherwise(F.lit(0.0))
    size = F.when(~F.col("numeric"), F.coalesce("cardinality", F.lit(0).cast("long")))
    kind = F.when(F.col("numeric"), "numeric").when(size <= MOST_CATEGORIES, "categorical").otherwise("other")
    return out.select(
        "column",
        kind.alias("kind"),
        rate.alias("null_rate"),
        size.alias("cardinality"),
        "min",
        "max",
        F.when(kind == "categorical", F.coalesce("sample", F.array().cast(none))).alias("sample"),
    )


def routing(tables: DataFrame, mappings: DataFrame, roles: DataFrame, domains=None, entity_class: str | None = None) -> DataFrame:
    """(domain, table, classes, bridges): what a table's rows are about and by which columns it meets the graph."""
    rows = tables.filter(domains_touch("domain", domains)) if domains else tables
    classes = mappings.groupBy("table_id").agg(F.array_sort(F.collect_set(F.struct("entity_class", "column", "confirmed"))).alias("classes"))
    bridges = roles.filter("role = 'bridge'").groupBy("table_id").agg(F.array_sort(F.collect_set("column")).alias("bridges"))
    out = rows.join(classes, "table_id", "left").join(bridges, "table_id", "left")
    if entity_class:
        out = out.filter(F.exists("classes", lambda x: x["entity_class"] == entity_class))
    return out.select("domain", F.col("name").alias("table"), "classes", "bridges")


def progress(items: DataFrame, group: str, status: str = "status", done: tuple[str, ...] = ("ok", "skipped")) -> DataFrame:
    """(group, total, done, failed): how far each job has come."""
    return items.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(F.col(status).isin(*done)).alias("done"), F.count_if(F.col(status) == "failed").alias("failed")
    )


def session_history(sessions: DataFrame, drafts: DataFrame, domains=None, user: str | None = None, limit: int = 20) -> DataFrame:
    """(session_id, created_at, n_drafts, excerpt): update sessions, latest first, with the start of their first text."""
    rows = sessions
    if domains:
        rows = rows.filter(in_domains("domain", domains))
    if user:
        rows = rows.filter(F.col("created_by") == user)
    made = drafts.groupBy("session_id").agg(F.count("*").alias("n_drafts"), F.substring(F.min("raw_text"), 1, 80).alias("excerpt"))
    return rows.join(made, "session_id", "left").withColumn(
        "n_drafts", F.coalesce("n_drafts", F.lit(0).cast("long"))
    ).orderBy(F.desc_nulls_last("created_at"), "session_id").limit(limit)


def staged_inventory(staged: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, n_entities, n_properties, n_relationships, in_graph) of staged documents; names compare in any case."""
    there = documents.select(F.upper("name").alias("upper_name")).distinct().withColumn("in_graph", F.lit(True))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"n_{c}")
    rows = staged.select("name", n("entities"), n("properties"), n("relationships"), F.upper("name").alias("upper_name"))
    return rows.join(there, "upper_name", "left").select(
        "name", "n_entities", "n_properties", "n_relationships", F.coalesce("in_graph", F.lit(False)).alias("in_graph")
    )


def run_summary(questions: DataFrame) -> DataFrame:
    """(run_id, n, answered, failed, seconds, cost, turns) of benchmark runs."""
    return questions.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "ok").alias("answered"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("duration_s").alias("seconds"),
        F.sum("cost_usd").alias("cost"),
        F.sum("turns").alias("turns"),
    )


