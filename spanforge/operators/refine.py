"""Refinement: name clusters and merges, conflict candidates and verdicts, consolidation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import in_domains
from ..functions.similarity import ratio_column
from ..functions.text import repair_json
from ..plans.scratch import Scratch

MERGE_THRESHOLD, CONFLICT_THRESHOLD = 0.7, 0.75
#: Fixed values.
VERDICTS, SEVERITIES = ("conflicting", "superseded", "complementary", "unrelated"), ("low", "medium", "high")


def similar_names(entities: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """(a, b, entity_class, ratio): pairs of names of one class, in order, that are alike enough.

    An exact set-similarity join: a ratio of r needs matching characters for r / 2 of both lengths,
    and no more can match than the names have in common, counted with repeats.  So a name of n
    characters shares one of its n - ceil(n * r / (2 - r)) + 1 rarest (character, which time it stands there) with
    any name like it; only names that do so meet, once, and of those only pairs with enough in
    common are compared.
    """
    names = entities.select(F.coalesce("entity_class", F.lit("")).alias("entity_class"), "name").filter("name IS NOT NULL").distinct()
    signs = F.filter(F.split(F.lower("name"), ""), lambda c: c != "")
    nth = lambda c, i: F.concat(c, F.lit(":"), F.size(F.filter(F.slice(F.col("signs"), 1, i + 1), lambda x: x == c)).cast("string"))
    names = names.withColumn("signs", signs).withColumn("marks", F.transform("signs", nth)).withColumn("n", F.size("marks")).drop("signs")
    marked = names.select("entity_class", F.explode("marks").alias("mark"))
    common = marked.groupBy("entity_class", "mark").agg(F.count("*").alias("shared_by"))
    rarest = F.row_number().over(Window.partitionBy("entity_class", "name").orderBy("shared_by", "mark"))
    least = threshold / (2 - threshold)
    posted = names.withColumn("mark", F.explode("marks")).join(common, ["entity_class", "mark"]).withColumn("place", rarest)
    posted = posted.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("entity_class", "mark", "name", "n", "place")
    a = posted.select("entity_class", "mark", F.col("name").alias("a"), F.col("n").alias("na"))
    b = posted.select("entity_class", "mark", F.col("name").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["entity_class", "mark"]).filter(
        (F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9)
    )
    met = met.select("entity_class", "a", "b").distinct()
    of = lambda side: names.select("entity_class", F.col("name").alias(side), F.col("marks").alias(f"marks_{side}"))
    both = met.join(of("a"), ["entity_class", "a"]).join(of("b"), ["entity_class", "b"])
    enough = 2 * F.size(F.array_intersect("marks_a", "marks_b")) >= threshold * (F.size("marks_a") + F.size("marks_b")) - 1e-9
    pairs = both.filter(enough).select("entity_class", "a", "b").withColumn("ratio", ratio_column("a", "b"))
    return pairs.filter(F.col("ratio") >= threshold).select("a", "b", "entity_class", "ratio")


def components(pairs: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node that each end of the pairs (a, b) reaches."""
    scratch = Scratch(pairs.sparkSession, label)
    both = scratch.save(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(
            labels.select(F.col("node").alias("b"), F.col("component").alias("theirs")), "b"
        ).groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = scratch.save(
            hooked.join(further, "component").select("node", "was", F.least("component", "further").alias("component")), f"labels-{step}"
        )
        if moved.filter("was <> component").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")


def name_clusters(entities: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """(entity_class, cluster, name): names of one class that a chain of likeness connects."""
    key = lambda c: F.concat_ws("\x1f", "entity_class", c)
    pairs = similar_names(entities, threshold).select(key("a").alias("a"), key("b").alias("b"))
    part = lambda c, i: F.get(F.split(c, "\x1f"), F.lit(i))
    return components(pairs, "names").select(
        part("node", 0).alias("entity_class"), part("component", 1).alias("cluster"), part("node", 1).alias("name")
    )


def mergeable(proposals: DataFrame, entities: DataFrame, cross_domain: bool = False) -> DataFrame:
    """proposals (alias, canonical) with `skip`: self, cross_class, cross_domain, or null if it may go ahead."""
    info = entities.groupBy("name").agg(F.collect_set("entity_class").alias("classes"), F.collect_set("domain").alias("domains"))
    a = info.select(F.col("name").alias("alias"), F.col("classes").alias("ca"), F.col("domains").alias("da"))
    b = info.select(F.col("name").alias("canonical"), F.col("classes").alias("cb"), F.col("domains").alias("db"))
    rows = proposals.join(a, "alias", "left").join(b, "canonical", "left")
    known = (F.size("ca") > 0) & (F.size("cb") > 0)
    skip = F.when(F.col("alias") == F.col("canonical"), "self").when(F.coalesce(known & ~F.arrays_overlap("ca", "cb"), F.lit(False)), "cross_class")
    if not cross_domain:
        skip = skip.when(F.coalesce(~F.arrays_overlap("da", "db"), F.lit(False)), "cross_domain")
    return rows.select("alias", "canonical", skip.alias("skip"))


def merge_entities(merges: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after merges (alias_id, canonical_id, alias_name).

    Edge ends move to the canonical entity, doubles fall together with their sources, edges
    that become loops by it go; the canonical entity keeps its properties and learns the alias.
    """
    to = merges.select("alias_id", "canonical_id")
    src, dst = to.select(
        F.col("alias_id").alias("src_id"), F.col("canonical_id").alias("new_src")
    ), to.select(F.col("alias_id").alias("dst_id"), F.col("canonical_id").alias("new_dst"))
    moved = edges.join(src, "src_id", "left").join(dst, "dst_id", "left")
    moved = moved.withColumns({"s": F.coalesce("new_src", "src_id"), "d": F.coalesce("new_dst", "dst_id")}).filter("s <> d OR src_id = dst_id")
    out = moved.groupBy(F.col("s").alias("src_id"), F.col("d").alias("dst_id"), "rel_type").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("doc_ids", F.array().cast("array<string>")))))).alias("doc_ids")
    )
    learnt = merges.groupBy(F.col("canonical_id").alias("id")).agg(F.collect_set("alias_name").alias("learnt"))
    kept = entities.join(to.select(F.col("alias_id").alias("id")), "id", "left_anti").join(learnt, "id", "left")
    none = F.array().cast("array<string>")
    return kept.withColumn(
        "aliases", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("learnt", none)))
    ).select(*entities.columns), out


def not_refined(domains: list[str], runs: DataFrame) -> DataFrame:
    """(domain): those that no refinement has run for yet."""
    asked = runs.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    return asked.join(runs.select("domain").distinct(), "domain", "left_anti").orderBy("domain")


#: Entities of either side that are held against each other at a time, about.
BLOCK = 1024


def _near_in_blocks(rows: DataFrame, threshold: float, top_k: int, apart: bool) -> DataFrame:
    """(id_a, id_b, name_a, name_b, similarity): of each entity the `top_k` nearest of its class in every block.

    A class is dealt out into blocks by a hash of the id; a block meets a block in one
    product of two matrices of unit vectors, and passes on only what may be among the nearest.
    """
    sizes = rows.groupBy("entity_class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(sizes, "entity_class").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    kept = ("entity_class", "i", "j", "seeks", "id", "name", "domain", "embedding")
    base = placed.withColumns({"j": F.col("own"), "seeks": F.lit(False)}).withColumn("i", every).select(*kept)
    seek = placed.withColumns({"i": F.col("own"), "seeks": F.lit(True)}).withColumn("j", every).select(*kept)
    sides = base.unionByName(seek).repartition("entity_class", "i", "j").sortWithinPartitions("entity_class", "i", "j")

    def met(group):
        parts = [[r for r in group if r[0] == side] for side in (False, True)]
        if not all(parts):
            return []
        unit = [(lambda x: x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None])(np.array([r[4] for r in p], np.float64)) for p in parts]
        ids, names, domains = ([r[k] for r in parts[0]] for k in (1, 2, 3))
        order = np.argsort(np.array(ids, dtype=object), kind="stable")
        score = (1 + unit[1] @ unit[0][order].T) / 2
        out = []
        for (_, own, name, domain, _), line in zip(parts[1], score, strict=True):
            found = 0
            for k in np.argsort(-line, kind="stable"):
                at = order[k]
                if line[k] < threshold or found == top_k:
                    break
                if ids[at] != own and not (apart and domains[at] == domain):
                    found += 1
                    out.append((own, ids[at], name, names[at], float(line[k])))
        return out

    def run(batches):
        of, group = None, []
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for *key, seeks, own, name, domain, vector in zip(*columns, strict=True):
                if key != of:
                    found += met(group)
                    of, group = key, []
                group.append((seeks, own, name, domain, vector))
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, f, strict=True)) for f in found], schema=out)
        yield pa.RecordBatch.from_pylist([dict(zip(out.names, f, strict=True)) for f in met(group)], schema=out)

    kind = dict(rows.dtypes)["id"]
    out = pa.schema(
        [
            ("id_a", pa.string() if kind == "string" else pa.int64()),
            ("id_b", pa.string() if kind == "string" else pa.int64()),
            ("name_a", pa.string()),
            ("name_b", pa.string()),
            ("similarity", pa.float64()),
        ]
    )
    return sides.mapInArrow(run, f"id_a {kind}, id_b {kind}, name_a string, name_b string, similarity double")


def conflict_candidates(
    entities: DataFrame, domains: list[str], threshold: float = CONFLICT_THRESHOLD, top_k: int = 10, max_pairs: int = 200
) -> DataFrame:
    """(id_a, id_b, similarity, name_ratio): pairs of one class that may contradict each other.

    Of each entity its `top_k` nearest by vector in other domains (in its own if there is only
    one) at the threshold or above; a pair once; the most similar first.
    """
    rows = entities.filter(in_domains("domain", domains) & F.col("embedding").isNotNull()).select(
        "id",
        "name",
        F.coalesce("entity_class", F.lit("")).alias("entity_class"),
        "domain",
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    met = _near_in_blocks(rows, threshold, top_k, len(domains) > 1)
    near = met.withColumn(
        "rank", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("similarity"), "id_b"))
    ).filter(F.col("rank") <= top_k)
    first = F.col("id_a") < F.col("id_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    once = near.select(
        F.least("id_a", "id_b").alias("id_a"),
        F.greatest("id_a", "id_b").alias("id_b"),
        pick("name_a", "name_b").alias("name_a"),
        pick("name_b", "name_a").alias("name_b"),
        "similarity",
    ).groupBy("id_a", "id_b", "name_a", "name_b").agg(F.max("similarity").alias("similarity"))
    scored = once.withColumn("name_ratio", ratio_column("name_a", "name_b"))
    return scored.select("id_a", "id_b", "similarity", "name_ratio").orderBy(
        F.desc("similarity"), F.desc("name_ratio"), "id_a", "id_b"
    ).limit(max_pairs)


def evidence(links: DataFrame, chunks: DataFrame, max_chunks: int = 3, chars: int = 1200) -> DataFrame:
    """(entity_id, chunk_id, excerpt): each entity's first chunks by id, cut short."""
    rows = links.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn(
        "rank", F.row_number().over(Window.partitionBy("entity_id").orderBy("chunk_id"))
    )
    return rows.filter(F.col("rank") <= max_chunks).select("entity_id", "chunk_id", F.substring("text", 1, chars).alias("excerpt"))


def verdict(raw: str | None) -> dict:
    """A judge's answer as {verdict, severity, aspect, claim_a, claim_b}; unrelated and low unless it says so."""
    got = repair_json(raw or "")
    got = got if isinstance(got, dict) else {}
    word = lambda k, known, other: str(got.get(k, "")).strip().lower() if str(got.get(k, "")).strip().lower() in known else other
    return {
        "verdict": word("verdict", VERDICTS, "unrelated"),
        "severity": word("severity", SEVERITIES, "low"),
        **{k: str(got.get(k) or "") for k in ("aspect", "claim_a", "claim_b")},
    }


def verdict_columns(verdict_text: Column, severity_text: Column) -> tuple[Column, Column]:
    v, s = F.lower(F.trim(verdict_text)), F.lower(F.trim(severity_text))
    return F.when(v.isin(*VERDICTS), v).otherwise("unrelated"), F.when(s.isin(*SEVERITIES), s).otherwise("low")


def conflict_id(a: Column, b: Column, aspect: Column) -> Column:
    """The same for either order of the entities; another for another aspect."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(aspect, F.lit(""))), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.sha1(F.concat_ws("|", F.least(a, b), F.greatest(a, b), slug))


def materialise_conflicts(judged: DataFrame, existing: DataFrame, at: str, model: str) -> DataFrame:
    """New conflict rows (id, id_a, id_b, aspect, severity, status, detected_at, detected_by_model) that aren't there yet."""
    rows = judged.filter("verdict = 'conflicting'").withColumn("id", conflict_id(F.col("id_a"), F.col("id_b"), F.col("aspect")))
    rows = rows.groupBy("id").agg(F.min(F.struct("id_a", "id_b", "aspect", "severity")).alias("r")).select("id", "r.*")
    return rows.join(existing.select("id"), "id", "left_anti").select(
        "id",
        "id_a",
        "id_b",
        "aspect",
        "severity",
        F.lit("open").alias("status"),
        F.lit(at).alias("detected_at"),
        F.lit(model).alias("detected_by_model"),
    )


def superseded_pairs(judged: DataFrame, starts: DataFrame) -> DataFrame:
    """(newer, older) of pairs judged superseded: the later start is the newer; ties by id."""
    a, b = starts.select(
        F.col("id").alias("id_a"), F.col("valid_from").alias("from_a")
    ), starts.select(F.col("id").alias("id_b"), F.col("valid_from").alias("from_b"))
    rows = judged.filter("verdict = 'superseded'").join(a, "id_a").join(b, "id_b")
    later = (F.col("from_a") > F.col("from_b")) | ((F.col("from_a") == F.col("from_b")) & (F.col("id_a") > F.col("id_b")))
    return rows.filter("from_a IS NOT NULL AND from_b IS NOT NULL").select(
        F.when(later, F.col("id_a")).otherwise(F.col("id_b")).alias("newer"),
        F.when(later, F.col("id_b")).otherwise(F.col("id_a")).alias("older"),
        F.greatest("from_a", "from_b").alias("effective"),
    )


def resolve_conflict(conflicts: DataFrame, conflict: str, status: str, at: str, reason: str | None = None) -> DataFrame:
    """conflicts with one resolved or dismissed; an unknown id is an error."""
    if status not in ("resolved", "dismissed"):
        raise ValueError("status is resolved or dismissed")
    hit = F.col("id") == conflict
    if conflicts.filter(hit).isEmpty():
        raise KeyError(conflict)
    return conflicts.withColumns(
        {
            "status": F.when(hit, status).otherwise(F.col("status")),
            "resolved_at": F.when(hit, at).otherwise(F.col("resolved_at")),
            "resolution_reason": F.when(hit, F.lit(reason)).otherwise(F.col("resolution_reason")),
        }
    )


def consolidation_gate(entities: DataFrame, min_fragments: int = 2, force: bool = False) -> DataFrame:
    """entities (id, description, open_conflicts, chunk_ids, source_chunks) with `gate`: go, or why not."""
    fragments = F.size(F.filter(F.split(F.coalesce("description", F.lit("")), r" \| "), lambda x: F.trim(x) != ""))
    same = F.coalesce(F.array_sort("chunk_ids") == F.array_sort("source_chunks"), F.lit(False))
    gate = F.when(F.col("open_conflicts") > 0, "open_conflict").when(F.size("chunk_ids") == 0, "no_chunks")
    gate = gate.when(F.lit(force), "go").when(same, "unchanged").when(fragments < min_fragments, "too_few_fragments").otherwise("go")
    return entities.select("id", fragments.cast("long").alias("fragments"), gate.alias("gate"))


def excerpts(links: DataFrame, chunks: DataFrame, today: str, max_chunks: int = 6) -> DataFrame:
    """(entity_id, chunk_ids): the chunks to consolidate from, those that hold today first, then by id."""
    old = F.when((F.col("valid_to").isNull() | (F.col("valid_to") > today)), 0).otherwise(1)
    rows = links.join(chunks.select("chunk_id", old.alias("old")), "chunk_id")
    return rows.groupBy("entity_id").agg(
        F.transform(F.slice(F.array_sort(F.collect_set(F.struct("old", "chunk_id"))), 1, max_chunks), lambda x: x["chunk_id"]).alias("chunk_ids")
    )


def write_consolidated(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities with new (id, description, chunk_ids): the first raw description is kept, the vector is due again."""
    mine = new.select("id", F.col("description").alias("better"), F.col("chunk_ids").alias("from_chunks"))
    rows = entities.join(mine, "id", "left")
    hit = F.col("better").isNotNull()
    out = rows.withColumns(
        {
            "description_raw": F.when(hit, F.coalesce("description_raw", "description")).otherwise(F.col("description_raw")),
            "description_source_chunks": F.when(hit, F.col("from_chunks")).otherwise(F.col("description_source_chunks")),
            "embedding": F.when(hit, F.lit(None)).otherwise(F.col("embedding")),
            "description": F.coalesce("better", "description"),
        }
    )
    return out.select(*entities.columns)


#: The steps in their order.
PIPELINE = ("time", "supersession", "merge", "conflicts", "consolidate", "embed")


def run_pipeline(
    domains: list[str], steps: dict[str, Callable[[list[str], bool], object]], apply: bool = False, only: list[str] | None = None
) -> dict[str, object]:
    """Runs the refinement steps in order; each is told whether to apply or only propose.

    Conflicts are also looked for across domains if there are two or more.
    """
    unknown = [s for s in only or [] if s not in PIPELINE]
    if unknown:
        raise ValueError(f"unknown steps {unknown}")
    told: dict[str, object] = {}
    for step in PIPELINE:
        if step not in steps or (only and step not in only):
            continue
        if step == "conflicts":
            told[step] = {d: steps[step]([d], apply) for d in domains} | ({"*": steps[step](domains, apply)} if len(domains) > 1 else {})
        else:
            told[step] = steps[step](domains, apply)
    return told


