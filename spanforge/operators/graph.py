"""Graph patterns over entities (id, name, entity_class, domain, ...) and edges (src_id, dst_id, rel_type, ...).

All patterns are joins.  Undirected ones look at both orientations of an edge and count a
self-loop once.  Each side that fans out is summed up before it is joined, and every
order is total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import in_domains, snapshot_at, valid_at
from ..plans.scratch import Scratch


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, rel_type, forward, ...): each edge from either end; a self-loop once."""
    rest = [c for c in edges.columns if c not in ("src_id", "dst_id")]
    out = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), F.lit(True).alias("forward"), *rest)
    back = edges.filter("src_id <> dst_id").select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), F.lit(False).alias("forward"), *rest)
    return out.unionByName(back)


def entities_of_class(entities: DataFrame, domains, entity_class: str, limit: int = 200, as_of: str | None = None) -> DataFrame:
    """Entities of a class by name."""
    rows = entities.filter((F.col("entity_class") == entity_class) & in_domains("domain", domains))
    return rows.filter(valid_at(as_of) if as_of else F.lit(True)).orderBy("name", "id").limit(limit)


def with_sources(chosen: DataFrame, chunk_links: DataFrame, chat_links: DataFrame) -> DataFrame:
    """chosen entities with their distinct chunks and chats, each list in order."""
    chunks = chunk_links.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunks"))
    chats = chat_links.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("chat_id")).alias("chats"))
    none = F.array().cast("array<string>")
    return chosen.join(chunks, "id", "left").join(chats, "id", "left").withColumns(
        {"chunks": F.coalesce("chunks", none), "chats": F.coalesce("chats", none)}
    )


def connections(chosen: DataFrame, entities: DataFrame, edges: DataFrame, domains) -> DataFrame:
    """(id, rel_type, forward, target_id, target_name, target_class): one hop to entities of the domains."""
    near = entities.filter(in_domains("domain", domains)).select(
        F.col("id").alias("b"), F.col("name").alias("target_name"), F.col("entity_class").alias("target_class")
    )
    hops = both_ways(edges).join(chosen.select(F.col("id").alias("a")), "a")
    return hops.join(near, "b").select(F.col("a").alias("id"), "rel_type", "forward", F.col("b").alias("target_id"), "target_name", "target_class")


def neighbourhood(chosen: DataFrame, entities: DataFrame, edges: DataFrame, domains) -> DataFrame:
    """chosen entities with a sorted list of their connections."""
    found = connections(chosen, entities, edges, domains)
    lists = found.groupBy("id").agg(
        F.array_sort(F.collect_set(F.struct("rel_type", "target_class", "target_name", "target_id"))).alias("connections")
    )
    return chosen.join(lists, "id", "left")


def edges_between(entities: DataFrame, edges: DataFrame, domains, a: Column, b: Column, as_of: str | None = None) -> DataFrame:
    """Edges between entities that a holds for and ones that b holds for, either way, with true start and end."""
    live = entities.filter(in_domains("domain", domains))
    live = live.filter(valid_at(as_of)) if as_of else live
    ends = live.select("id", F.col("name").alias("end_name"), a.alias("is_a"), b.alias("is_b"))
    src = ends.select(*[F.col(c).alias(f"src_{c}" if c != "id" else "src_id") for c in ends.columns])
    dst = ends.select(*[F.col(c).alias(f"dst_{c}" if c != "id" else "dst_id") for c in ends.columns])
    met = edges.join(src, "src_id").join(dst, "dst_id").filter("(src_is_a AND dst_is_b) OR (src_is_b AND dst_is_a)")
    return met.select(
        "rel_type", F.col("src_end_name").alias("from_name"), F.col("dst_end_name").alias("to_name"), "src_id", "dst_id"
    ).orderBy("rel_type", "from_name", "to_name", "src_id", "dst_id")


def neighbours_of_class(chosen: DataFrame, entities: DataFrame, edges: DataFrame, domains, entity_class: str) -> DataFrame:
    """(id, target_id, target_name, rel_type): neighbours of one class, each relationship type once."""
    return connections(chosen, entities, edges, domains).filter(F.col("target_class") == entity_class).select(
        "id", "target_id", "target_name", "rel_type"
    ).distinct()


def degrees(
    entities: DataFrame, edges: DataFrame, mentions: DataFrame, domains, mode: str = "relations", entity_class: str | None = None, top: int = 5
) -> DataFrame:
    """(id, name, degree): entities with most neighbours, most mentions, or both together.

    Relations count edges from either end, mentions distinct chats; nobody's 0 is lost.
    Each side is summed up by entity before it is joined.
    """
    if mode not in ("relations", "mentions", "all"):
        raise ValueError("mode is one of relations, mentions, all")
    rows = entities.filter(in_domains("domain", domains))
    if entity_class:
        rows = rows.filter(F.col("entity_class") == entity_class)
    rows = rows.select("id", "name")
    total = F.lit(0)
    if mode != "mentions":
        n = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_edges"))
        rows, total = rows.join(n, "id", "left"), total + F.coalesce("n_edges", F.lit(0))
    if mode != "relations":
        n = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("chat_id").alias("n_chats"))
        rows, total = rows.join(n, "id", "left"), total + F.coalesce("n_chats", F.lit(0))
    return rows.select("id", "name", total.cast("long").alias("degree")).orderBy(F.desc("degree"), "name", "id").limit(top)


def document_chunks(documents: DataFrame, chunks: DataFrame, name_part: str) -> DataFrame:
    """Chunks of documents whose name contains a text, in any case, deleted or not; by document and place."""
    found = documents.filter(F.lower("name").contains(name_part.lower())).select("doc_id", "name")
    return chunks.join(found, "doc_id").select("doc_id", "name", "chunk_id", "seq", "text").orderBy("doc_id", "seq")


def chunk_windows(chunks: DataFrame, wanted: DataFrame, expand: int = 0) -> DataFrame:
    """(chunk_id, neighbour_id, offset): up to `expand` chunks of the same document on either side.

    wanted: (chunk_id).  Only documents with a wanted chunk are ordered.
    """
    asked = wanted.select("chunk_id").distinct()
    docs = chunks.join(asked, "chunk_id", "left_semi").select("doc_id").distinct()
    placed = chunks.join(docs, "doc_id", "left_semi").withColumn(
        "place", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "chunk_id"))
    )
    mine = placed.join(asked, "chunk_id", "left_semi").select(
        "doc_id", "chunk_id", F.explode(F.sequence(F.lit(-expand), F.lit(expand))).alias("offset"), "place"
    )
    mine = mine.filter("offset <> 0").withColumn("place", F.col("place") + F.col("offset"))
    theirs = placed.select("doc_id", "place", F.col("chunk_id").alias("neighbour_id"))
    return mine.join(theirs, ["doc_id", "place"]).select("chunk_id", "neighbour_id", "offset")


def entity_context(
    chosen: DataFrame, entities: DataFrame, edges: DataFrame, chunk_links: DataFrame, chunks: DataFrame, domains, today: str, include: int = 5
) -> DataFrame:
    """(id, n_connections, chunk_ids, more_count): connections, the first chunks with text and how many are left.

    Chunks that are valid today come first, then by id.
    """
    links = chunk_links.join(chosen.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").distinct()
    current = F.coalesce(valid_at(today), F.lit(True)).cast("int")
    ranked = links.join(chunks.select("chunk_id", "text", current.alias("current")), "chunk_id")
    ordered = ranked.groupBy(F.col("entity_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("current")).alias("old"), "chunk_id"))).alias("all")
    )
    ordered = ordered.select(
        "id",
        F.transform(F.slice("all", 1, include), lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.greatest(F.size("all") - include, F.lit(0)).cast("long").alias("more_count"),
    )
    n = connections(chosen, entities, edges, domains).groupBy("id").agg(F.count("*").alias("n_connections"))
    return chosen.select("id", "name").join(n, "id", "left").join(ordered, "id", "left").select(
        "id",
        "name",
        F.coalesce("n_connections", F.lit(0)).cast("long").alias("n_connections"),
        F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
        F.coalesce("more_count", F.lit(0)).cast("long").alias("more_count"),
    )


def subgraph(chosen: DataFrame, entities: DataFrame, edges: DataFrame, domains, max_neighbours: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, name, entity_class, center), edges (src, dst, rel_type) and (id, truncated) of one hop.

    Each center keeps its neighbours that come first by name; an edge a relationship.
    """
    if not 1 <= max_neighbours <= 250:
        raise ValueError("max_neighbours is 1 to 250")
    found = connections(chosen, entities, edges, domains)
    rank = F.dense_rank().over(Window.partitionBy("id").orderBy("target_name", "target_id"))
    ranked = found.withColumn("rank", rank)
    kept = ranked.filter(F.col("rank") <= max_neighbours)
    around = kept.select(
        F.col("target_id").alias("id"), F.col("target_name").alias("name"), F.col("target_class").alias("entity_class"), F.lit(False).alias("center")
    )
    nodes = chosen.select("id", "name", "entity_class", F.lit(True).alias("center")).unionByName(around)
    nodes = nodes.groupBy("id", "name", "entity_class").agg(F.max("center").alias("center"))
    src, dst = F.when(F.col("forward"), F.col("id")).otherwise(F.col("target_id")), F.when(
        F.col("forward"), F.col("target_id")
    ).otherwise(F.col("id"))
    links = kept.select(src.alias("src"), dst.alias("dst"), "rel_type").distinct()
    truncated = ranked.groupBy("id").agg((F.max("rank") > max_neighbours).alias("truncated"))
    return nodes, links, truncated


def provenance(context: DataFrame, include: int = 8) -> DataFrame:
    """(id, sources, more_count) of an entity context, with at most `include` sources."""
    if not 1 <= include <= 50:
        raise ValueError("include is 1 to 50")
    cut = F.greatest(F.size("chunk_ids") - include, F.lit(0))
    return context.select("id", F.slice("chunk_ids", 1, include).alias("sources"), (F.col("more_count") + cut).cast("long").alias("more_count"))


def conflicts(
    conflict_edges: DataFrame,
    entities: DataFrame,
    conflict_nodes: DataFrame,
    evidence: DataFrame,
    status: str = "open",
    ids=None,
    name: str | None = None,
) -> DataFrame:
    """(conflict_id, aspect, status, severity, a_name, b_name, evidence): open conflicts by severity as text, descending.

    A conflict is told by the edge whose ends are in order; its node may be missing, and
    then it is open.
    """
    if status not in ("open", "resolved", "dismissed", "all"):
        raise ValueError("status is one of open, resolved, dismissed, all")
    one = conflict_edges.filter("src_id < dst_id").select("src_id", "dst_id", "conflict_id", "aspect").distinct()
    a = entities.select(F.col("id").alias("src_id"), F.col("name").alias("a_name"))
    b = entities.select(F.col("id").alias("dst_id"), F.col("name").alias("b_name"))
    nodes = conflict_nodes.select(F.col("id").alias("conflict_id"), "severity", F.col("status").alias("node_status"))
    proof = evidence.groupBy("conflict_id").agg(F.array_sort(F.collect_set(F.struct("side", "chunk_id"))).alias("evidence"))
    rows = one.join(a, "src_id").join(b, "dst_id").join(nodes, "conflict_id", "left").join(proof, "conflict_id", "left")
    rows = rows.withColumn("status", F.coalesce("node_status", F.lit("open")))
    if status != "all":
        rows = rows.filter(F.col("status") == status)
    if ids:
        rows = rows.filter(F.col("conflict_id").isin(*ids))
    if name:
        rows = rows.filter(F.lower("a_name").contains(name.lower()) | F.lower("b_name").contains(name.lower()))
    return rows.select(
        "conflict_id", "aspect", "status", "severity", "a_name", "b_name", "evidence"
    ).orderBy(F.desc_nulls_last("severity"), "conflict_id")


def timeline(neighbours: DataFrame) -> DataFrame:
    """Dated neighbours (event_at or valid_from) by that date, then id."""
    when = F.coalesce("event_at", "valid_from")
    return neighbours.filter(when.isNotNull()).withColumn("at", when).orderBy("at", "id")


def versions(history: DataFrame, entity_id: str | None = None, as_of: str | None = None) -> DataFrame:
    """An entity's history by start; at a point in time the version that covers it."""
    rows = history.filter(F.col("entity_id") == entity_id) if entity_id else history
    if as_of:
        rows = rows.filter(snapshot_at(as_of))
    return rows.orderBy("entity_id", F.asc_nulls_last("valid_from"), "id")


def supersession_candidates(edges: DataFrame, entities: DataFrame, source_name: str, rel_type: str, target_name: str, limit: int = 3) -> DataFrame:
    """Edges of the same source and type to another target, which a new edge may take the place of."""
    src = entities.select(F.col("id").alias("src_id"), F.col("name").alias("source_name"))
    dst = entities.select(F.col("id").alias("dst_id"), F.col("name").alias("target_name"))
    rows = edges.filter(F.col("rel_type") == rel_type).join(src, "src_id").filter(F.col("source_name") == source_name).join(dst, "dst_id")
    return rows.filter(
        F.lower("target_name") != target_name.lower()
    ).select("src_id", "rel_type", "dst_id", "target_name").distinct().orderBy("target_name", "dst_id").limit(limit)


def rank_candidates(scored: DataFrame, name: str, entity_class: str | None, domains, top: int = 5) -> DataFrame:
    """The best matches of a name among scored entities (id, name, entity_class, domain, score).

    Exact names first, then the same class, the score, and shorter names; entities of other
    domains only if the domains have none.
    """
    exact = (F.lower("name") == name.lower()).cast("int")
    same = (F.col("entity_class") == (entity_class or "")).cast("int")
    local = in_domains("domain", domains).cast("int")
    rows = scored.withColumns({"exact": exact, "same": same, "local": local})
    here = rows.agg(F.max("local").alias("any_local"))
    rows = rows.crossJoin(F.broadcast(here)).filter("local = any_local")
    return rows.orderBy(
        F.desc("exact"), F.desc("same"), F.desc("score"), F.length("name"), "id"
    ).limit(top).select("id", "name", "entity_class", "domain", "score")


def _live_hops(entities: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """(a, b, *columns): both orientations of the edges between entities that are there."""
    live = entities.select("id")
    hops = both_ways(edges).join(live.withColumnRenamed("id", "a"), "a", "left_semi").join(live.withColumnRenamed("id", "b"), "b", "left_semi")
    return hops.select("a", "b", *columns).distinct()


def _step(nodes: DataFrame, hops: DataFrame) -> DataFrame:
    """The neighbours of nodes, each once."""
    return nodes.select(F.col("id").alias("a")).join(hops, "a").select(F.col("b").alias("id")).distinct()


def shortest_path(entities: DataFrame | None, edges: DataFrame, start: str, goal: str, max_hops: int = 5) -> DataFrame:
    """(path, length): one shortest undirected path, as [node, type, node, ...]; the first by its text among equals.

    All its nodes are entities; without entities, whatever an edge names is a node.

    Edges are written once.  Both ends are searched towards each other, the smaller frontier
    first; a round writes the ids of its new nodes and nothing else.  Where the searches meet, the
    nodes that lie on shortest paths are picked level by level, and only over those are paths put together.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "path")
    found = spark.createDataFrame([], "path array<string>, length int")
    edges = edges.select("src_id", "dst_id", "rel_type")
    if entities is None:
        edges = scratch.save(edges, "edges")
    nodes = both_ways(edges).select(F.col("a").alias("id")) if entities is None else entities.select("id")
    ends = {"from": start, "to": goal}
    levels = {side: [scratch.save(nodes.filter(F.col("id") == end).limit(1), side)] for side, end in ends.items()}
    if any(level[0].isEmpty() for level in levels.values()):
        return found
    if start == goal:
        return levels["from"][0].select(F.array("id").alias("path"), F.lit(0).alias("length"))
    if entities is not None:
        for end in ("src_id", "dst_id"):
            edges = edges.join(nodes.withColumnRenamed("id", end), end, "left_semi")
        edges = scratch.save(edges.select("src_id", "dst_id", "rel_type"), "edges")
    hops = both_ways(edges).select("a", "b", "rel_type")
    sizes, met = {"from": 1, "to": 1}, None
    while met is None:
        if sum(len(level) - 1 for level in levels.values()) == max_hops:
            return found
        side = min(sizes, key=sizes.get)
        other = "to" if side == "from" else "from"
        seen = reduce(DataFrame.union, levels[side])
        new = scratch.save(_step(levels[side][-1], hops).join(seen, "id", "left_anti"), f"{side}-{len(levels[side])}")
        levels[side].append(new)
        sizes[side] = new.count()
        if not sizes[side]:
            return found
        both = new.join(levels[other][-1], "id", "left_semi")
        if not both.isEmpty():
            met = scratch.save(both, "met")
    # the nodes of shortest paths, by how far they are from the start
    on = [met]
    for level in reversed(levels["from"][:-1]):
        on.insert(0, scratch.save(level.join(_step(on[0], hops), "id", "left_semi"), f"on-{len(on)}"))
    for level in reversed(levels["to"][:-1]):
        on.append(scratch.save(level.join(_step(on[-1], hops), "id", "left_semi"), f"on-{len(on)}"))
    paths = on[0].select("id", F.array("id").alias("path"))
    for nodes in on[1:]:
        step = paths.join(hops, paths["id"] == hops["a"]).select(F.col("b").alias("id"), F.concat("path", F.array("rel_type", "b")).alias("path"))
        paths = step.join(nodes, "id", "left_semi").groupBy("id").agg(F.min("path").alias("path"))
    return paths.select("path", F.lit(len(on) - 1).alias("length"))


def all_paths(entities: DataFrame, edges: DataFrame, start: str, goal: str, max_hops: int = 5, limit: int = 3) -> DataFrame:
    """(path, length): undirected paths that use no edge twice, shortest first.

    Extended hop by hop until `limit` are found.  Only nodes that can still reach the goal in
    the hops left are followed.  Every round is written and read once.
    """
    scratch = Scratch(entities.sparkSession, "paths")
    live = entities.select("id")
    keyed = edges.select("src_id", "dst_id", "rel_type").withColumn("edge", F.concat_ws("|", "src_id", "rel_type", "dst_id"))
    hops = scratch.save(_live_hops(entities, keyed, "rel_type", "edge"), "hops")
    near = [scratch.save(live.filter(F.col("id") == goal), "near-0")]
    for k in range(1, max_hops):
        near.append(scratch.save(_step(near[-1], hops).union(near[-1]).distinct(), f"near-{k}"))
    paths = live.filter(F.col("id") == start).select("id", F.array("id").alias("path"), F.array().cast("array<string>").alias("used"))
    found, n = None, 0
    for length in range(1, max_hops + 1):
        step = paths.join(hops, paths["id"] == hops["a"]).filter(~F.array_contains("used", F.col("edge")))
        step = step.select(
            F.col("b").alias("id"), F.concat("path", F.array("rel_type", "b")).alias("path"), F.concat("used", F.array("edge")).alias("used")
        )
        step = step.join(near[max_hops - length], "id", "left_semi") if length < max_hops else step.filter(F.col("id") == goal)
        paths = scratch.save(step, f"paths-{length}")
        hit = paths.filter(F.col("id") == goal).select("path", F.lit(length).alias("length"))
        found = hit if found is None else found.unionByName(hit)
        n += hit.limit(limit).count()
        if n >= limit:
            break
    return found.orderBy("length", "path").limit(limit)
