"""What is filed, dispatched, exported and resolved: the small keyed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import chunking, documents, ledger, refine, scd2, temporal
from ..plans import bindings as B
from ..plans.bindings import with_
from ..plans.catalog import query, table
from ..sources import files
from ..sources.store import closed_edges
from .history import POLICIES, _policies, _scd2

E, D, X, C, M = B.ENTITIES_SQL, B.EDGES_SQL, B.DOCUMENTS_SQL, B.CHUNKS_SQL, B.MENTIONS_SQL


@query(
    "a2_dispatch",
    "SELECT 'f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.CSV' WHEN 1 THEN '.xlsx' ELSE '.md' END AS path, p_partkey % 3 < 2 AS structured FROM part",
)
def a2(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat(
        F.lit("f"),
        F.col("p_partkey").cast("string"),
        F.when(F.col("p_partkey") % 3 == 0, ".CSV").when(F.col("p_partkey") % 3 == 1, ".xlsx").otherwise(".md"),
    )
    return p.select(path.alias("path"), files.structured(path).alias("structured"))


@query("a12_unchanged_files", "SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0")
def a12(spark, sf):
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"),
        "o_orderkey",
    )
    odd = F.when(F.col("o_orderkey") % 3 == 1, F.lit("x")).otherwise(F.col("sha256"))
    registry = o.filter("o_orderkey % 3 <> 2").select("path", "sha256").unionByName(
        o.filter("o_orderkey % 3 <> 2").select("path", odd.alias("sha256"))
    )
    return files.unchanged(o.select("path", "sha256"), registry)


@query(
    "a13_document_dedupe",
    "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 5 = 0 AND k.text = d.text) THEN 'skipped' ELSE 'ingest' END AS action FROM documents d",
)
def a13(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return documents.new_files(d, d.filter("doc_id % 5 = 0")).select("doc_id", "action")


@query("a15_frontmatter", "SELECT c_custkey, c_name AS title, lower(c_mktsegment) AS segment FROM customer")
def a15(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat(F.lit("---\ntitle: "), "c_name", F.lit("\nsegment: '"), F.lower("c_mktsegment"), F.lit("'\n---\nbody: no\n"))
    return c.select("c_custkey", T.frontmatter_map(text).alias("m")).select(
        "c_custkey", F.col("m")["title"].alias("title"), F.col("m")["segment"].alias("segment")
    )


@query(
    "a18_snapshot_edges",
    with_(E, D) + """SELECT rel_type, count(*) AS n FROM edge WHERE src_id IN (SELECT id FROM entity WHERE entity_class <> 'CUSTOMER') AND dst_id IN (SELECT id FROM entity WHERE entity_class <> 'CUSTOMER') GROUP BY 1""",
)
def a18(spark, sf):
    kept = B.entities(spark, sf).filter("entity_class <> 'CUSTOMER'").select("id")
    return closed_edges(B.edges(spark, sf), kept).groupBy("rel_type").agg(F.count("*").alias("n"))


@query(
    "a21_chat_export",
    with_(E, M) + """SELECT conv_id || '_' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS mentions FROM conversations LEFT JOIN mention ON chat_id = conv_id || '_' || turn LEFT JOIN entity ON entity.id = entity_id WHERE role = 'user' GROUP BY 1, 2""",
)
def a21(spark, sf):
    out = documents.export_chats(_chats(spark, sf), B.mentions(spark, sf), B.entities(spark, sf))
    return out.select("id", "session_id", F.coalesce(F.array_join("mentions", ","), F.lit("")).alias("mentions"))


def _chats(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("created_at"),
        F.col("text").alias("raw_text"),
    )


@query("a21_chat_export_by_entity", with_(E, M) + """SELECT name, count(*) AS n_chats FROM mention JOIN entity ON entity.id = entity_id GROUP BY 1""")
def a21_by_entity(spark, sf):
    out = documents.export_chats(_chats(spark, sf), B.mentions(spark, sf), B.entities(spark, sf), by_entity=True)
    return out.select("name", F.size("texts").cast("long").alias("n_chats"))


@query("b7_as_of_values", "SELECT unnest(['2024', '2024-05', '2024-05-06']) AS as_of")
def b7(spark, sf):
    return spark.createDataFrame([(P.resolve_as_of(x),) for x in (" 2024", "2024-05", "2024-05-06 ")], "as_of string")


@query("b9_entity_selector", with_(E) + "SELECT id, name FROM entity WHERE contains(lower(name), 'nation_2') OR contains(lower(name), 'cold')")
def b9(spark, sf):
    return B.entities(spark, sf).filter(P.selects_entity(names=["Nation_2", "COLD"])).select("id", "name")


@query("b11_search_text", "SELECT unnest(['rate increase 2024', '']) AS query")
def b11(spark, sf):
    return spark.createDataFrame([(T.search_text(x),) for x in ("rate: +(increase)  2024~", "*?!")], "query string")


@query("b12_internal_props", "SELECT event_id, user_id FROM events")
def b12(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.lit("x").alias("embedding"),
        F.lit("y").alias("_prop_sources"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("_prop_sources"), F.lit("z")).alias("props"),
    )
    out = P.without_internal(e)
    return out.select("event_id", F.when(F.size("props") == 1, F.col("props")["user"]).cast("bigint").alias("user_id"))


@query("b13_flat_props", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM orders")
def b13(spark, sf):
    o = table(spark, sf, "orders")
    props = F.create_map(
        F.lit("status"),
        F.col("o_orderstatus"),
        F.lit("note"),
        F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(""),
        F.lit("none"),
        F.lit(None).cast("string"),
        F.lit("list"),
        F.lit("[]"),
    )
    return o.select("o_orderkey", F.size(P.flatten_props(props)).alias("n"))


@query("b16_envelope", "SELECT 'en' AS domain, 1 AS n_domains")
def b16(spark, sf):
    e = P.envelope("en")
    return spark.createDataFrame([(e["domain"], len(e["domains"]))], "domain string, n_domains int")


@query(
    "q2_schema",
    "SELECT 'orders' AS name, 'bigint' AS type, 2 AS n UNION ALL SELECT 'orders', 'string', 2 UNION ALL SELECT 'orders', "
        "'double', 1 UNION ALL SELECT 'orders', 'timestamp_ntz', 1",
)
def q2(spark, sf):
    d = spark.createDataFrame([("orders", t) for _, t in table(spark, sf, "orders").dtypes], "name string, type string")
    return d.groupBy("name", "type").agg(F.count("*").cast("int").alias("n"))


@query("q3_point_in_time", "SELECT count(*) AS n FROM customer WHERE c_custkey % 10 <> 9")
def q3(spark, sf):
    return scd2.as_of_view(_scd2(spark, sf).table, "2024-05-31").agg(F.count("*").alias("n"))


@query("t4_column_drift", "SELECT false AS same_columns")
def t4(spark, sf):
    c = table(spark, sf, "customer")
    try:
        scd2.check_columns(scd2.seed(c, ["c_custkey"], "2024-01-01"), c.withColumn("extra", F.lit(1)).drop("c_name"))
        same = True
    except ValueError:
        same = False
    return spark.createDataFrame([(same,)], "same_columns boolean")


@query("t5_refresh_dispatch", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def t5(spark, sf):
    c = table(spark, sf, "customer")
    out, version = scd2.load(None, c, "temporal", 0, "2024-01-01", ["c_custkey"])
    out, version = scd2.load(out, c, "temporal", version, "2024-02-01", ["c_custkey"])
    return out.filter(F.lit(version == 2) & F.col("_is_current")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("t13_version_resolution", f"""WITH {POLICIES} SELECT a.id AS newer, b.id AS older, a.day AS effective, CASE WHEN a.version % 3 = 0 THEN 'notice' ELSE 'table' END AS kind
FROM p a JOIN p b ON a.cust = b.cust AND b.version = a.version - 1 WHERE a.version % 3 = 0 OR a.version % 2 = 0""")
def t13(spark, sf):
    p = temporal.lift_header(_policies(spark, sf), "2024-01-01", date_column=None)
    return temporal.resolve_versions(temporal.notices(p), p)


@query("d2_table_heads", "SELECT count(*) AS n FROM region WHERE r_regionkey >= 0")
def d2(spark, sf):
    """Chunks of a document with one long table: all but the first have its head in front."""
    r = table(spark, sf, "region").withColumn(
        "text",
        F.concat(
            F.lit("# T\n| a | b |\n|---|---|\n"),
            F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | x |"))), "\n"),
        ),
    )
    chunks = chunking.chunk_documents(r.select(F.col("r_regionkey").alias("doc_id"), "text"), 300)
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("k"), F.count_if(F.col("text").contains("|---|---|")).alias("h")
    ).filter("k = h AND k > 1").agg(F.count("*").alias("n"))


@query(
    "d3_extraction",
    "SELECT step, status, count(*) AS n FROM (SELECT unnest(['entities', 'properties', 'relationships']) AS step, CASE WHEN "
        "length(text) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM benchmark) GROUP BY 1, 2",
)
def d3(spark, sf):
    def model(step, text):
        if len(text) % 7 == 0:
            raise TimeoutError
        return '```json\n[{"id": "1", "step": "%s"}]\n```' % step

    chunks = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return chunking.extract(chunks, model).groupBy("step", "status").agg(F.count("*").alias("n"))


@query(
    "d4_local_ids",
    "SELECT CASE WHEN event_id % 4 <> 0 THEN user_id || '_' || event_id END AS id, user_id || '_' || event_type AS ref FROM events WHERE event_id % 4 <> 0",
)
def d4(spark, sf):
    e = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).alias("id"),
        F.col("event_type").alias("ref"),
        F.col("user_id").cast("string").alias("chunk_id"),
    )
    return chunking.local_ids(e, "chunk_id", "ref").select("id", "ref")


#: By item modulo 6, what is written before and after twice the item's id.
BROKEN = (
    '<think>no</think>Sure: ```json\n{"v": ', ",}\n```"
), ("{'v': ", "}"), ("{v: ", ', w: "cut'), ('{"w": [1 2 3] "v": ', "}"), ('[1, {"v": ', ""), ('{"v": /* twice */ ', ' // id\n, "w": None}')


@query("d5_json_repair", "SELECT item_id, item_id * 2 AS v, item_id % 6 = 4 AS in_list FROM benchmark")
def d5(spark, sf):
    twice = (F.col("item_id") * 2).cast("string")
    raw = F.lit(None).cast("string")
    for i, (before, after) in enumerate(BROKEN):
        raw = F.when(F.col("item_id") % len(BROKEN) == i, F.concat(F.lit(before), twice, F.lit(after))).otherwise(raw)
    b = table(spark, sf, "benchmark").select("item_id", T.repaired_json(raw).alias("json"))
    found = F.coalesce(F.get_json_object("json", "$.v"), F.get_json_object("json", "$[1].v"))
    return b.select("item_id", found.cast("bigint").alias("v"), F.get_json_object("json", "$[1].v").isNotNull().alias("in_list"))


@query("d7_record", "SELECT user_id, count(DISTINCT event_id % 50) AS n FROM events GROUP BY 1")
def d7(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id",
        F.lit("kind").alias("property"),
        F.concat(F.lit("d"), (F.col("event_id") % 50).cast("string")).alias("doc_id"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("value"),
    )
    none = e.limit(0)
    return ledger.record(none, e, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("d11_purge", with_(X) + "SELECT doc_id FROM doc WHERE doc_id <> 12")
def d11(spark, sf):
    d = B.documents(spark, sf).withColumns(
        {"name": F.concat(F.lit("Doc"), F.col("doc_id").cast("string")), "path": F.concat(F.lit("/a/f"), F.col("doc_id").cast("string"))}
    )
    return documents.purge(d, "F12").select("doc_id")


@query("d17_confirm", "SELECT 'chat' || o_orderkey AS chat_id, 'e' || o_custkey AS entity_id FROM orders WHERE o_orderkey % 3 <> 2 GROUP BY ALL")
def d17(spark, sf):
    o = table(spark, sf, "orders")
    action = F.when(F.col("o_orderkey") % 3 == 0, "create").when(F.col("o_orderkey") % 3 == 1, "link").otherwise("skip")
    drafts = o.select(
        F.concat(F.lit("chat"), F.col("o_orderkey").cast("string")).alias("chat_id"),
        F.lit("text").alias("raw_text"),
        action.alias("action"),
        F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("entity_id"),
        F.lit("n").alias("name"),
        F.lit("C").alias("entity_class"),
        F.lit("d").alias("domain"),
        F.create_map(F.lit("status"), "o_orderstatus").alias("props"),
    )
    ents = drafts.select(F.col("entity_id").alias("id"), "name", "entity_class", "domain", "props").limit(0)
    chats = drafts.select(F.col("chat_id").alias("id"), "raw_text", "domain").limit(0)
    return documents.confirm_draft(drafts, ents, chats, drafts.select("chat_id", "entity_id").limit(0))[2]


@query("c2_merge_checks", with_(E) + """, c AS (SELECT name, list(DISTINCT entity_class) AS cs, list(DISTINCT domain) AS ds FROM entity GROUP BY 1),
  m AS (SELECT s_name AS alias, n_name AS canonical FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_name, s_name FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT a.s_name, b.s_name FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)
SELECT alias, canonical, CASE WHEN alias = canonical THEN 'self' WHEN NOT list_has_any(a.cs, b.cs) THEN 'cross_class' WHEN NOT list_has_any(a.ds, b.ds) THEN 'cross_domain' END AS skip FROM m JOIN c a ON a.name = alias JOIN c b ON b.name = canonical""")
def c2_checks(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    p = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("alias"), F.col("n_name").alias("canonical"))
    p = p.union(s.filter("s_suppkey % 4 = 0").select("s_name", "s_name"))
    after = s.select((F.col("s_suppkey") - 1).alias("k"), F.col("s_name").alias("canonical"))
    p = p.union(s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("alias")).join(after, "k").select("alias", "canonical"))
    return refine.mergeable(p, B.entities(spark, sf))


@query("c3_not_refined", "SELECT unnest(['b', 'd']) AS domain")
def c3(spark, sf):
    return refine.not_refined(["d", "a", "b"], spark.createDataFrame([("a", "x"), ("c", "y")], "domain string, at string"))


JUDGED = "j AS (SELECT 's' || a.s_suppkey AS id_a, 's' || b.s_suppkey AS id_b, a.s_suppkey % 3 AS k FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)"


def _judged(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    b = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"))
    k = F.col("s_suppkey") % 3
    return s.join(b, "s_suppkey").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id_a"),
        F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("id_b"),
        F.when(k == 0, "conflicting").when(k == 1, "superseded").otherwise("unrelated").alias("verdict"),
        F.lit("rate").alias("aspect"),
        F.lit("high").alias("severity"),
    )


@query(
    "c7_materialise",
    f"WITH {JUDGED} SELECT sha1(least(id_a, id_b) || '|' || greatest(id_a, id_b) || '|rate') AS id, 'open' AS status, 'm' AS detected_by_model FROM j WHERE k = 0",
)
def c7(spark, sf):
    none = spark.createDataFrame([], "id string")
    return refine.materialise_conflicts(_judged(spark, sf), none, "2024-01-01", "m").select("id", "status", "detected_by_model")


@query("c7_superseded", f"WITH {JUDGED} SELECT id_b AS newer, id_a AS older, '2024-01-02' AS effective FROM j WHERE k = 1")
def c7_superseded(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.when(F.col("s_suppkey") % 3 == 2, "2024-01-02").otherwise("2024-01-01").alias("valid_from"),
    )
    return refine.superseded_pairs(_judged(spark, sf), s)


@query("c8_resolve", "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'dismissed' ELSE 'open' END AS status FROM supplier")
def c8(spark, sf):
    none = F.lit(None).cast("string")
    c = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("open").alias("status"), none.alias("resolved_at"), none.alias("resolution_reason")
    )
    return refine.resolve_conflict(c, 3, "dismissed", "2024-01-01", "noise").select("id", "status")


@query(
    "c10_consolidation_write",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'better' ELSE p_name END AS description, CASE WHEN p_partkey % 2 "
        "= 0 THEN p_name END AS description_raw, p_partkey % 2 = 0 AS due FROM part",
)
def c10(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("description"),
        F.lit(None).cast("string").alias("description_raw"),
        F.lit(None).cast("array<string>").alias("description_source_chunks"),
        F.array(F.lit(1.0)).alias("embedding"),
    )
    new = p.filter("id % 2 = 0").select("id", F.lit("better").alias("description"), F.array(F.lit("c1")).alias("chunk_ids"))
    return refine.write_consolidated(p, new).select("id", "description", "description_raw", F.col("embedding").isNull().alias("due"))
