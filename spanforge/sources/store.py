"""The store of Parquet tables: versions, views by domain, bundles and snapshots."""

from __future__ import annotations

import json
import time
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identifier_column, sanitize_identifier
from .shared import SharedFiles

BUNDLE = ("document", "chunks", "entities", "properties", "relationships")
OPTIONAL = {"document": "logical_id string, version int"}
BASE_LABELS = ("Document", "DocChunk", "Entity", "UserChat", "EntityVersion", "Conflict", "RefineRun")


def view_name(domain: str, table: str) -> str:
    """The name of a domain's table among all views."""
    return f"{sanitize_identifier(domain)}__{table}"


def view_name_column(domain: Column, table: str) -> Column:
    """view_name of a column of domains."""
    return F.concat(identifier_column(domain), F.lit(f"__{table}"))


def register_views(spark: SparkSession, tables: dict[tuple[str, str], DataFrame]) -> list[str]:
    """Views `domain__table`, and the bare name of a table that only one domain has."""
    made = []
    bare = Counter(t for _, t in tables)
    for (domain, name), df in tables.items():
        df.createOrReplaceTempView(view_name(domain, name))
        made.append(view_name(domain, name))
        if bare[name] == 1:
            df.createOrReplaceTempView(name)
            made.append(name)
        else:
            spark.catalog.dropTempView(name)
    return made


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    return list(df.dtypes)


def write_version(df: DataFrame, root: str) -> str:
    """Writes a table beside its older versions and then points to it; the plan may read the older one."""
    spark = df.sparkSession
    path = f"{root}/v{time.time_ns()}"
    df.write.parquet(path)
    pointer = spark.createDataFrame([(path,)], "path string").coalesce(1)
    pointer.write.mode("overwrite").json(f"{root}/current")
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.json(f"{root}/current").first()["path"])


def write_bundle(root: str, **parts: DataFrame) -> None:
    """A document's five parts as JSON lines, one folder each."""
    for name in BUNDLE:
        if name in parts:
            parts[name].write.mode("overwrite").json(f"{root}/{name}.json")


def read_bundle(spark: SparkSession, root: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The parts that are there, of one JSON document or of lines; fields that older bundles lack are null."""
    out = {}
    for name in BUNDLE:
        path = f"{root}/{name}.json"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            continue
        reader = spark.read.option("multiLine", fs.getFileStatus(hadoop).isFile())
        df = (reader.schema(schemas[name]) if schemas and name in schemas else reader).json(path)
        for field in OPTIONAL.get(name, "").split(", ") if name in OPTIONAL else ():
            column, kind = field.split()
            if column not in df.columns:
                df = df.withColumn(column, F.lit(None).cast(kind))
        out[name] = df
    return out


def pull_bundles(spark: SparkSession, incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (name, ..), unless any of the names is there already: then nothing is taken over."""
    clash = incoming.select("name").intersect(existing.select("name")).orderBy("name").limit(20).collect()
    if clash:
        raise FileExistsError(", ".join(r["name"] for r in clash))
    return incoming


def pull(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies the documents' folders of a source to a target; the names.

    If any of them is there already, nothing is copied.
    """
    store = SharedFiles(spark)
    names, taken = store.folders(source), set(store.folders(target))
    if clash := [n for n in names if n in taken]:
        raise FileExistsError(", ".join(clash))
    for name in names:
        store.copy(f"{source}/{name}", f"{target}/{name}")
    return names


def closed_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both among the ids."""
    return edges.join(
        ids.select(F.col("id").alias("src_id")), "src_id", "left_semi"
    ).join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")


def export_graph(root: str, nodes: dict[str, DataFrame], edges: DataFrame) -> None:
    """Nodes by base label, and edges whose ends are both among them."""
    ids = None
    for label in BASE_LABELS:
        if label in nodes:
            nodes[label].write.mode("overwrite").parquet(f"{root}/nodes/{label}")
            part = nodes[label].select("id")
            ids = part if ids is None else ids.union(part)
    if ids is not None:
        closed_edges(edges, ids).write.mode("overwrite").parquet(f"{root}/edges")


def import_graph(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], DataFrame]:
    labels = SharedFiles(spark).folders(f"{root}/nodes")
    return {n: spark.read.parquet(f"{root}/nodes/{n}") for n in labels}, spark.read.parquet(f"{root}/edges")


def export_tables(spark: SparkSession, root: str, tables: dict[tuple[str, str], DataFrame], registry: list[dict]) -> None:
    """Tables by domain, and the registry's rows as they are."""
    for (domain, name), df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/tables/{domain}/{name}")
    SharedFiles(spark).write_text(f"{root}/registry.json", json.dumps(registry))


def import_tables(spark: SparkSession, root: str, defaults: dict) -> tuple[dict[tuple[str, str], DataFrame], list[dict]]:
    """What export_tables wrote; ids stay, and registry fields that an older snapshot lacks get their defaults."""
    rows = [{**defaults, **r} for r in json.loads(SharedFiles(spark).read_text(f"{root}/registry.json"))]
    return {(r["domain"], r["name"]): spark.read.parquet(f"{root}/tables/{r['domain']}/{r['name']}") for r in rows}, rows


COMPONENTS = ("graph", "structured", "documents")


def create_snapshot(spark: SparkSession, root: str, target: str, include: tuple[str, ...] = COMPONENTS) -> dict:
    """One archive of the components' folders below root, with a manifest; the manifest."""
    store, manifest, entries = SharedFiles(spark), {"version": 1, "components": {}}, []
    for c in include:
        files = store.files(f"{root}/{c}")
        entries += [(f"{c}/{name}", f"{root}/{c}/{name}") for name, _ in files]
        if store.exists(f"{root}/{c}"):
            manifest["components"][c] = {"files": len(files), "bytes": sum(n for _, n in files)}
    store.pack(target, entries, {"manifest.json": json.dumps(manifest)})
    return manifest


def analyze_snapshot(spark: SparkSession, path: str, include: tuple[str, ...] | None = None) -> dict:
    """What an archive has of the components asked for."""
    text = SharedFiles(spark).packed_text(path, "manifest.json")
    if text is None:
        raise ValueError("the file is no snapshot")
    manifest = json.loads(text)
    found = manifest["components"]
    return {
        "version": manifest["version"],
        "components": {k: v for k, v in found.items() if include is None or k in include},
        "missing": [k for k in include or () if k not in found],
    }


def restore_snapshot(spark: SparkSession, path: str, root: str, include: tuple[str, ...] | None = None) -> list[str]:
    """Puts components back in place of what is there; the components."""
    store = SharedFiles(spark)
    done = list(analyze_snapshot(spark, path, include)["components"])
    for c in done:
        store.delete(f"{root}/{c}")
    store.unpack(path, root, lambda name: name.split("/")[0] in done)
    return done


def export_document(spark: SparkSession, root: str, target: str) -> list[str]:
    """One staged document's bundle as a portable file; the names in it."""
    store = SharedFiles(spark)
    names = [n for n, _ in store.files(root)]
    store.pack(target, [(n, f"{root}/{n}") for n in names])
    return names


def import_document(spark: SparkSession, path: str, root: str) -> list[str]:
    """Unpacks a document's bundle, and nothing else that may be in the file; the names."""
    store = SharedFiles(spark)
    part = lambda name: name.split("/")[0].removesuffix(".json") in BUNDLE
    if not any(n.split("/")[0] == "document.json" for n in store.packed(path)):
        raise ValueError("the file is no document bundle")
    return store.unpack(path, root, part)
