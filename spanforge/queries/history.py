"""Slowly changing tables, documents in time, merging and refinement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, documents, jobs, ledger, refine, scd2, temporal
from ..plans import bindings as B
from ..plans.bindings import with_
from ..plans.catalog import query, table
from ..streaming import incremental

E, D, X, C = B.ENTITIES_SQL, B.EDGES_SQL, B.DOCUMENTS_SQL, B.CHUNKS_SQL

# the current table: customers as they were; the batch: some richer, some gone, some new
OLD = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 10 <> 9"
NEW = "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 11 <> 5"


def _scd2(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )
    current = scd2.seed(c.filter("id % 10 <> 9"), ["id"], "2024-01-01")
    batch = c.filter("id % 11 <> 5").withColumn("segment", F.when(F.col("id") % 7 == 0, "MOVED").otherwise(F.col("segment")))
    return scd2.refresh(current, batch, ["id"], "2024-06-01")


SCD2_SQL = f"""WITH o AS ({OLD}), b AS ({NEW}),
  t AS (SELECT *, DATE '2024-01-01' AS f, NULL::DATE AS t, true AS c FROM (SELECT * FROM o INTERSECT SELECT * FROM b)
    UNION ALL SELECT *, DATE '2024-01-01', DATE '2024-06-01', false FROM (SELECT * FROM o EXCEPT SELECT * FROM b)
    UNION ALL SELECT *, DATE '2024-06-01', NULL, true FROM (SELECT * FROM b EXCEPT SELECT * FROM o))"""


@query("t1_scd2_refresh", SCD2_SQL + " SELECT id, name, segment, nation, f AS _valid_from, t AS _valid_to, c AS _is_current FROM t")
def t1(spark, sf):
    return _scd2(spark, sf).table


@query(
    "t1_scd2_counts",
    SCD2_SQL + " SELECT count(*) FILTER (f = DATE '2024-06-01') AS inserted, count(*) FILTER (t IS NOT NULL) AS closed, count(*) FILTER (t IS NULL AND f = DATE '2024-01-01') AS unchanged FROM t",
)
def t1_counts(spark, sf):
    return _scd2(spark, sf).counts()


@query("t2_current_view", SCD2_SQL + " SELECT segment, count(*) AS n FROM t WHERE c GROUP BY 1")
def t2(spark, sf):
    return scd2.current_view(_scd2(spark, sf).table).groupBy("segment").agg(F.count("*").alias("n"))


@query(
    "t2_as_of_view",
    SCD2_SQL + " SELECT segment, count(*) AS n FROM t WHERE f <= DATE '2024-03-01' AND (t IS NULL OR t > DATE '2024-03-01') GROUP BY 1",
)
def t2_as_of(spark, sf):
    return scd2.as_of_view(_scd2(spark, sf).table, "2024-03-01").groupBy("segment").agg(F.count("*").alias("n"))


@query("t3_seed", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS _valid_from, NULL::DATE AS _valid_to, true AS _is_current FROM orders")
def t3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return scd2.seed(o, ["o_orderkey"], "2024-01-01", "o_orderdate").drop("o_orderdate")


@query(
    "t6_date_parsing",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
)
def t6(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 4
    written = F.when(
        kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    ).when(kind == 1, F.date_format("o_orderdate", "d MMMM yyyy")).when(
        kind == 2, F.date_format("o_orderdate", "MMMM d, yyyy")
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return o.select("o_orderkey", T.iso_date(written).alias("parsed"))


def _policies(spark, sf):
    """Documents with a header table made of orders: a family a customer."""
    o = table(spark, sf, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    p = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cust"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "d MMMM yyyy").alias("said"),
        rank.alias("version"),
    )
    head = F.concat(
        F.lit("# Policy\n\n| Field | Value |\n|---|---|\n| Effective Date | "),
        "said",
        F.lit(" |\n| Version | v"),
        F.col("version").cast("string"),
        F.lit(".0 (final) |\n"),
    )
    older = F.concat(F.lit("policy"), F.col("cust").cast("string"), F.lit("_v"), (F.col("version") - 1).cast("string"))
    named = F.when(
        F.col("version") % 2 == 0, F.concat(F.lit("| Supersedes | Version x, [["), older, F.lit("]] |\n"))
    ).otherwise(F.lit("| Supersedes | None |\n"))
    notice = F.concat(
        F.lit("\n## Supersession Notice\nThis policy supersedes Version "),
        (F.col("version") - 1).cast("string"),
        F.lit(".0 (Effective Date: 2001-01-01). Effective Date: "),
        "said",
        F.lit(".\n\n## Scope\nIt supersedes Version 0.9.\n"),
    )
    text = F.concat(head, named, F.when(F.col("version") % 3 == 0, notice).otherwise(F.lit("")))
    name = F.concat(F.lit("policy"), F.col("cust").cast("string"), F.lit("_v"), F.col("version").cast("string"), F.lit(".md"))
    return p.select("id", "cust", "day", "version", name.alias("name"), F.lit("rules").alias("domain"), text.alias("text"))


POLICIES = """p AS (SELECT o_orderkey AS id, o_custkey AS cust, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)"""


@query(
    "t7_header_lift",
    f"WITH {POLICIES} SELECT id, day AS valid_from, NULL::VARCHAR AS valid_to, 'v' || version || '.0 (final)' AS version_label, version || '.0' AS version_number, false AS valid_from_inferred FROM p",
)
def t7(spark, sf):
    out = temporal.lift_header(_policies(spark, sf), "2024-01-01", date_column=None)
    return out.select("id", "valid_from", "valid_to", "version_label", "version_number", "valid_from_inferred")


@query(
    "t9_entity_dates",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_at, "
        "CASE WHEN o_orderkey % 5 = 0 THEN 'soon' END AS event_at_raw FROM orders",
)
def t9(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.create_map(
            F.lit("placed"), F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
        ).alias("props"),
    )
    return temporal.entity_dates(o, {"event_at": "placed"}).drop("props")


@query("t10_normalize_time", with_(X, C) + """, d2 AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE valid_from END AS f FROM doc)
SELECT count(*) FILTER (f IS NULL) AS documents, (SELECT count(*) FROM chunk) AS chunks FROM d2""")
def t10(spark, sf):
    d = B.documents(spark, sf)
    lifted = d.select(F.col("doc_id").alias("id"), "valid_from", "valid_to")
    docs = d.withColumns({"id": F.col("doc_id"), "valid_from": F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("valid_from"))})
    return temporal.normalize_time(docs, B.chunks(d), lifted)[2]


@query("t11_notices", f"""WITH {POLICIES} SELECT id, 'notice' AS kind, (version - 1) || '.0' AS target, day AS effective FROM p WHERE version % 3 = 0
UNION ALL SELECT id, 'table', 'policy' || cust || '_v' || (version - 1), day FROM p WHERE version % 2 = 0""")
def t11(spark, sf):
    return temporal.notices(_policies(spark, sf))


@query("t12_title_stem", f"WITH {POLICIES} SELECT id, 'policy' || cust AS stem FROM p")
def t12(spark, sf):
    return _policies(spark, sf).select("id", T.title_stem(F.col("name")).alias("stem"))


CHAIN = """chain AS (SELECT cust, day, min(id) AS id, count(*) AS n, lag(min(id)) OVER w AS older, lag(count(*)) OVER w AS older_n FROM p GROUP BY cust, day WINDOW w AS (PARTITION BY cust ORDER BY day))"""


@query(
    "t14_family_chain",
    f"WITH {POLICIES}, {CHAIN} SELECT id AS newer, older, day AS effective, 'family' AS kind FROM chain WHERE older IS NOT NULL AND n = 1 AND older_n = 1",
)
def t14(spark, sf):
    p = _policies(spark, sf).withColumn("valid_from", F.col("day"))
    return temporal.family_chain(p)


@query("t15_detect_supersession", f"""WITH {POLICIES}, {CHAIN}, told AS (SELECT a.id AS newer, b.id AS older, a.day AS effective, CASE WHEN a.version % 3 = 0 THEN 'notice' ELSE 'table' END AS kind
    FROM p a JOIN p b ON a.cust = b.cust AND b.version = a.version - 1 WHERE a.version % 3 = 0 OR a.version % 2 = 0),
  fam AS (SELECT id AS newer, older, day AS effective FROM chain WHERE older IS NOT NULL AND n = 1 AND older_n = 1)
SELECT newer, older, effective, kind FROM told UNION ALL SELECT newer, older, effective, 'family' FROM fam WHERE NOT EXISTS (SELECT 1 FROM told x WHERE x.newer = fam.newer AND x.older = fam.older)""")
def t15(spark, sf):
    p = temporal.lift_header(_policies(spark, sf), "2024-01-01", date_column=None)
    return temporal.detect_supersession(p)


@query("t16_retire", """WITH pair AS (SELECT doc_id AS newer, doc_id - 1 AS older, strftime(DATE '2024-05-01' + CAST(doc_id % 20 AS INTEGER), '%Y-%m-%d') AS effective FROM documents WHERE doc_id % 10 = 1),
  src AS (SELECT DISTINCT 'e' || (doc_id // 2) AS entity_id, doc_id FROM documents WHERE doc_id % 3 <> 0),
  single AS (SELECT entity_id, min(doc_id) AS doc_id FROM src GROUP BY 1 HAVING count(DISTINCT doc_id) = 1)
SELECT entity_id AS id, CASE WHEN hash_end IS NOT NULL THEN hash_end ELSE effective END AS valid_to FROM (SELECT s.entity_id, any_value(pair.effective) AS effective, max(CASE WHEN CAST(substr(s.entity_id, 2) AS BIGINT) % 4 = 0 THEN '2023-12-31' END) AS hash_end
  FROM (SELECT DISTINCT entity_id FROM src) s LEFT JOIN single USING (entity_id) LEFT JOIN pair ON pair.older = single.doc_id GROUP BY 1)""")
def t16(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    pairs = d.filter("doc_id % 10 = 1").select(
        F.col("doc_id").alias("newer"),
        (F.col("doc_id") - 1).alias("older"),
        F.date_format(F.date_add(F.to_date(F.lit("2024-05-01")), (F.col("doc_id") % 20).cast("int")), "yyyy-MM-dd").alias("effective"),
    )
    src = d.filter("doc_id % 3 <> 0").select(F.concat(F.lit("e"), F.floor(F.col("doc_id") / 2).cast("string")).alias("entity_id"), "doc_id")
    num = F.substring("id", 2, 20).cast("bigint")
    ents = src.select(F.col("entity_id").alias("id")).distinct().withColumn("valid_to", F.when(num % 4 == 0, "2023-12-31"))
    docs = d.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("valid_to"))
    chunks = d.select("doc_id", F.lit(None).cast("string").alias("valid_to"))
    return temporal.apply_supersession(pairs, docs, chunks, ents, src)[2]


@query(
    "t17_supersede_nodes",
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '2020-01-01' WHEN s_suppkey % 2 = 0 AND s_suppkey + 1 <= (SELECT "
        "max(s_suppkey) FROM supplier) THEN '2024-02-02' END AS valid_to, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey + 1 <= (SELECT "
        "max(s_suppkey) FROM supplier) THEN 'superseded' END AS status FROM supplier",
)
def t17(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    pairs = s.filter("id % 2 = 1").select(F.col("id").alias("newer"), (F.col("id") - 1).alias("older"), F.lit("2024-02-02").alias("effective"))
    ents = s.withColumns({"valid_to": F.when(F.col("id") % 3 == 0, "2020-01-01"), "status": F.lit(None).cast("string")})
    return temporal.supersede_nodes(pairs, ents)[1].select("id", "valid_to", "status")


@query("t18_snapshot", """SELECT c_custkey AS entity_id, 'segment' AS property, c_mktsegment AS value, '2024-01-01' AS valid_from, '2024-06-01' AS valid_to, 'doc9' AS closed_by FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 4 <> 0
  UNION ALL SELECT c_custkey, 'name', c_name, '2024-01-01', '2024-06-01', 'doc9' FROM customer WHERE c_custkey % 15 = 0 AND c_custkey % 4 <> 0""")
def t18(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    before = c.select(
        "id", F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("props"), F.lit("2024-01-01").alias("valid_from")
    )
    seg, name = F.when(F.col("id") % 6 == 0, F.lit("X")).otherwise(F.col("c_mktsegment")), F.col("c_name")
    after = c.select(
        "id",
        F.when(
            F.col("id") % 15 == 0, F.create_map(F.lit("segment"), seg)
        ).otherwise(F.create_map(F.lit("name"), name, F.lit("segment"), seg)).alias("props"),
        F.lit("2024-06-01").alias("valid_from"),
    )
    done = c.filter("id % 4 = 0").select(F.col("id").alias("entity_id"), F.lit("doc9").alias("closed_by"))
    out = temporal.snapshot_changes(before, after, done, "doc9", "2024-06-02")
    return out.select("entity_id", F.explode("props").alias("property", "value"), "valid_from", "valid_to", "closed_by")


@query("d1_chunking")
def d1(spark, sf):
    """Chunks of all documents; tests hold spans, hashes and sizes against a plain reading."""
    return chunking.chunk_documents(table(spark, sf, "documents"), 2000)


@query("d6_accretive_merge", """WITH RECURSIVE v AS (SELECT user_id, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  f AS (SELECT user_id, value, k FROM v WHERE k = 1 UNION ALL SELECT f.user_id, CASE WHEN contains(f.value, v.value) THEN f.value ELSE f.value || ' | ' || v.value END, v.k FROM f JOIN v ON v.user_id = f.user_id AND v.k = f.k + 1)
SELECT user_id, 'kind' AS property, max_by(value, k) AS value FROM f GROUP BY 1""")
def d6(spark, sf):
    return ledger.fold(_ledger(spark, sf), "user_id")


@query("d6_mixed_values", """WITH seen AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY 1, 2)
SELECT c_nationkey, 'number' AS property, CAST(min(c_custkey) AS VARCHAR) AS value FROM customer GROUP BY 1
UNION ALL SELECT c_nationkey, 'segments', '[' || string_agg('"' || c_mktsegment || '"', ', ' ORDER BY k) || ']' FROM seen GROUP BY 1""")
def d6_mixed(spark, sf):
    """Numbers, of which the first stays; segments told in a list of one at first, then alone or in lists."""
    c = table(spark, sf, "customer").select(
        "c_nationkey", F.col("c_custkey").alias("ord"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc_id"), "c_mktsegment"
    )
    first = F.col("ord") == F.min("ord").over(Window.partitionBy("c_nationkey"))
    quoted = F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))
    segment = F.when(first | (F.col("ord") % 3 == 0), F.concat(F.lit("["), quoted, F.lit("]"))).otherwise(quoted)
    numbers = c.select("c_nationkey", F.lit("number").alias("property"), "doc_id", "ord", F.col("ord").cast("string").alias("value"))
    segments = c.select("c_nationkey", F.lit("segments").alias("property"), "doc_id", "ord", segment.alias("value"))
    return ledger.fold(numbers.unionByName(segments), "c_nationkey", mixed=True)


def _ledger(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "user_id",
        F.lit("kind").alias("property"),
        F.concat(F.lit("d"), (F.col("event_id") % 50).cast("string")).alias("doc_id"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("value"),
    )


@query("d7_drop_source", "SELECT user_id, count(*) AS n FROM events WHERE event_id % 50 <> 7 GROUP BY 1")
def d7(spark, sf):
    return ledger.drop_source(_ledger(spark, sf), "d7").groupBy("user_id").agg(F.count("*").alias("n"))


@query("d8_entity_upsert", """WITH x AS (SELECT 'old' || min(p_partkey) AS id, p_name AS name, p_type AS entity_class FROM part WHERE p_partkey % 2 = 0 GROUP BY 2, 3),
  n AS (SELECT p_name AS name, p_type AS entity_class, 'new' || min(p_partkey) AS id FROM part GROUP BY 1, 2)
SELECT coalesce(x.id, n.id) AS id, n.name, n.entity_class, 'goods' AS domain FROM n LEFT JOIN x USING (name, entity_class)""")
def d8(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.col("p_type").alias("entity_class"),
        F.lit("goods").alias("domain"),
        F.col("p_brand").alias("description"),
        F.array("p_brand").alias("aliases"),
    )
    old = p.filter("p_partkey % 2 = 0").groupBy("name", "entity_class", "domain").agg(
        F.concat(F.lit("old"), F.min("p_partkey").cast("string")).alias("id"),
        F.min("description").alias("description"),
        F.min("aliases").alias("aliases"),
    )
    new = p.select(
        F.concat(F.lit("new"), F.col("p_partkey").cast("string")).alias("id"),
        "name",
        "entity_class",
        "domain",
        "description",
        "aliases",
        F.col("p_partkey").alias("ord"),
    )
    return ledger.upsert_entities(old, new).select("id", "name", "entity_class", "domain")


@query("d9_edge_union", """WITH i AS (SELECT 's' || l_suppkey AS src_id, 'p' || l_partkey AS dst_id, 'SUPPLIES' AS rel_type, 'd' || (l_orderkey % 20) AS doc_id, l_linenumber = 1 AS twin FROM lineitem),
  e AS (SELECT src_id, dst_id, rel_type, doc_id FROM i UNION SELECT dst_id, src_id, rel_type, doc_id FROM i WHERE twin)
SELECT src_id, dst_id, rel_type, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS doc_ids FROM e GROUP BY 1, 2, 3""")
def d9(spark, sf):
    return _written_edges(spark, sf).select("src_id", "dst_id", "rel_type", F.array_join("doc_ids", ",").alias("doc_ids"))


def _written_edges(spark, sf):
    li = table(spark, sf, "lineitem")
    i = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst_id"),
        F.lit("SUPPLIES").alias("rel_type"),
        F.concat(F.lit("d"), (F.col("l_orderkey") % 20).cast("string")).alias("doc_id"),
        F.col("l_orderkey").cast("string").alias("chunk_id"),
        (F.col("l_linenumber") == 1).alias("bidirectional"),
    )
    i = i.unionByName(i.withColumn("rel_type", F.lit("SUPERSEDES")))
    none = spark.createDataFrame([], "src_id string, dst_id string, rel_type string, doc_ids array<string>, chunk_ids array<string>")
    return ledger.write_edges(none, i)


@query("d10_retract", """WITH i AS (SELECT 's' || l_suppkey AS src_id, 'p' || l_partkey AS dst_id, 'd' || (l_orderkey % 20) AS doc_id, l_linenumber = 1 AS twin FROM lineitem),
  e AS (SELECT src_id, dst_id, doc_id FROM i UNION SELECT dst_id, src_id, doc_id FROM i WHERE twin)
SELECT src_id, dst_id, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS doc_ids FROM e WHERE doc_id <> 'd7' GROUP BY 1, 2""")
def d10(spark, sf):
    return ledger.retract_edges(_written_edges(spark, sf), "d7").select("src_id", "dst_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("d10_orphans", """WITH l AS (SELECT DISTINCT 'd' || (l_orderkey % 300) AS doc_id, l_partkey AS entity_id FROM lineitem)
SELECT p_partkey AS id FROM part WHERE NOT (EXISTS (SELECT 1 FROM l WHERE entity_id = p_partkey AND doc_id = 'd7') AND NOT EXISTS (SELECT 1 FROM l WHERE entity_id = p_partkey AND doc_id <> 'd7'))""")
def d10_orphans(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("d"), (F.col("l_orderkey") % 300).cast("string")).alias("doc_id"), F.col("l_partkey").alias("entity_id")
    ).distinct()
    chunks = li.select("doc_id", F.col("doc_id").alias("chunk_id")).distinct()
    links = li.select("entity_id", F.col("doc_id").alias("chunk_id"))
    ents = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return ledger.retract("d7", _written_edges(spark, sf), _ledger(spark, sf), chunks, links, ents)["entities"]


@query(
    "d11_tombstone",
    with_(X, C) + "SELECT CASE WHEN doc_id = 12 OR deleted THEN 'deleted' ELSE 'live' END AS state, count(*) AS n FROM chunk GROUP BY 1",
)
def d11(spark, sf):
    d = B.documents(spark, sf).withColumns({"id": F.col("doc_id"), "name": F.concat(F.lit("Doc"), F.col("doc_id").cast("string"))})
    _, parts = documents.tombstone(d, B.chunks(B.documents(spark, sf)), "doc12", "2024-07-01")
    return parts.groupBy(F.when(F.col("deleted"), "deleted").otherwise("live").alias("state")).agg(F.count("*").alias("n"))


@query(
    "d12_identity",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'known' || doc_id ELSE 'fresh' || doc_id END AS id, CASE WHEN doc_id % 2 = 0 "
        "THEN CAST(doc_id % 5 + 2 AS BIGINT) ELSE 1 END AS version FROM documents",
)
def d12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("x").alias("domain"))
    key = documents.logical_id(F.col("domain"), F.col("doc_id").cast("string"))
    incoming = d.select("doc_id", F.concat(F.lit("fresh"), F.col("doc_id").cast("string")).alias("id"), key.alias("logical_id"), "domain")
    known = d.filter("doc_id % 2 = 0").select(
        F.concat(F.lit("known"), F.col("doc_id").cast("string")).alias("id"),
        key.alias("logical_id"),
        "domain",
        (F.col("doc_id") % 5 + 1).alias("version"),
    )
    return documents.resolve_identity(incoming, known).select("doc_id", "id", F.col("version").cast("long").alias("version"))


@query(
    "d13_delta",
    "SELECT doc_id AS logical_id, CASE WHEN doc_id % 7 = 0 THEN 'domain_changed' WHEN doc_id % 3 = 0 THEN 'initial' WHEN "
        "doc_id % 2 = 0 THEN 'metadata_only' ELSE 'content' END AS tier FROM documents",
)
def d13(spark, sf):
    c = B.chunks(B.documents(spark, sf)).withColumn("block_hash", F.sha1("text"))
    blocks = documents.block_lists(c).join(B.documents(spark, sf).select("doc_id", "domain"), "doc_id")
    incoming = blocks.select(F.col("doc_id").alias("logical_id"), "domain", "blocks")
    known = incoming.filter("logical_id % 7 = 0 OR logical_id % 3 <> 0").withColumns(
        {
            "domain": F.when(F.col("logical_id") % 7 == 0, "gone").otherwise(F.col("domain")),
            "blocks": F.when(F.col("logical_id") % 2 == 0, F.col("blocks")).otherwise(F.array(F.lit("x"))),
        }
    )
    return documents.classify_deltas(incoming, known)


@query(
    "d14_metadata_apply",
    with_(X) +
        "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'moved' ELSE project END AS project, CASE WHEN doc_id % 2 = 0 THEN "
        "NULL ELSE domain END AS area FROM doc",
)
def d14(spark, sf):
    d = B.documents(spark, sf).select(F.col("doc_id").alias("id"), "project", F.col("domain").alias("area"))
    new = d.filter("id % 2 = 0").select("id", F.lit("moved").alias("project"))
    chunks = B.chunks(B.documents(spark, sf)).withColumns({"project": F.lit("x"), "area": F.lit("y")})
    return documents.apply_metadata(d, chunks, new)[0]


@query(
    "d15_reassert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'NEWER' ELSE c_mktsegment END AS segment, c_name AS name FROM customer"
)
def d15(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("props")
    )
    newer = c.filter("id % 3 = 0").select("id", F.create_map(F.lit("segment"), F.lit("NEWER")).alias("props"))
    return documents.reassert(c, newer).select("id", F.col("props")["segment"].alias("segment"), F.col("props")["name"].alias("name"))


@query(
    "d17_update_kinds",
    "SELECT CASE WHEN length(trim(text)) > 500 THEN 'bulk' WHEN regexp_matches(trim(text), '(?i)^(todo|to-do|remind "
        "me|remember to)') THEN 'todo' WHEN NOT contains(trim(text), chr(10)) AND "
        "len(list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: "
        "s <> '')) <= 1 THEN 'atomic_fact' ELSE 'passage' END AS kind, count(*) AS n FROM conversations GROUP BY 1",
)
def d17(spark, sf):
    return table(spark, sf, "conversations").groupBy(documents.classify_update(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("c1_name_clusters")
def c1(spark, sf):
    """Clusters of part names within a class, by difflib; tests hold it against a plain loop."""
    return refine.name_clusters(B.entities(spark, sf).filter("entity_class = 'PART'"), 0.85)


@query("c1_components", """WITH RECURSIVE least_part AS (SELECT l_orderkey, min(l_partkey) AS a FROM lineitem GROUP BY 1),
  pair AS (SELECT DISTINCT a, l_partkey AS b FROM lineitem JOIN least_part USING (l_orderkey) WHERE a < l_partkey),
  both_ways AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
  r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ways UNION
    SELECT e.b, min(r.component) FROM r JOIN both_ways e ON e.a = r.node JOIN recurring.r AS old ON old.node = e.b WHERE r.component < old.component GROUP BY e.b)
SELECT node, component FROM r""")
def c1_components(spark, sf):
    """Parts that a chain of orders connects: each order links its parts to its smallest one."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("b"))
    least = li.groupBy("l_orderkey").agg(F.min("b").alias("a"))
    pairs = li.join(least, "l_orderkey").filter("a < b").select("a", "b").distinct()
    return refine.components(pairs)


@query("c2_merge", with_(E, D) + """, m AS (SELECT 'supplier:' || s_suppkey AS alias_id, 'supplier:' || (s_suppkey - 1) AS canonical_id FROM supplier WHERE s_suppkey % 2 = 1),
  moved AS (SELECT coalesce(m.canonical_id, src_id) AS src_id, dst_id, rel_type FROM edge LEFT JOIN m ON m.alias_id = src_id WHERE rel_type IN ('SUPPLIES', 'LOCATED_IN'))
SELECT DISTINCT src_id, dst_id, rel_type FROM moved""")
def c2(spark, sf):
    s = table(spark, sf, "supplier").filter("s_suppkey % 2 = 1")
    merges = s.select(
        F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("alias_id"),
        F.concat(F.lit("supplier:"), (F.col("s_suppkey") - 1).cast("string")).alias("canonical_id"),
        F.col("s_name").alias("alias_name"),
    )
    edges = B.edges(spark, sf).filter("rel_type IN ('SUPPLIES', 'LOCATED_IN')").withColumn("doc_ids", F.array(F.lit("d1")))
    ents = B.entities(spark, sf).withColumn("aliases", F.array().cast("array<string>"))
    return refine.merge_entities(merges, ents, edges)[1].select("src_id", "dst_id", "rel_type")


COS2 = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query("c4_conflict_candidates", f"""WITH v AS (SELECT vec_id AS id, label, vec_id % 3 AS dom, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  s AS (SELECT a.id AS x, b.id AS y, (1 + {COS2}) / 2 AS similarity FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id AND a.dom <> b.dom WHERE (1 + {COS2}) / 2 >= 0.6),
  r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY similarity DESC, lpad(CAST(y AS VARCHAR), 9, '0')) AS k FROM s),
  o AS (SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, max(similarity) AS similarity FROM r WHERE k <= 10 GROUP BY 1, 2)
SELECT lpad(CAST(id_a AS VARCHAR), 9, '0') AS id_a, lpad(CAST(id_b AS VARCHAR), 9, '0') AS id_b, round(similarity, 9) AS similarity FROM o ORDER BY round(similarity, 12) DESC, id_a, id_b LIMIT 200""")
def c4(spark, sf):
    e = table(spark, sf, "embeddings")
    ents = e.select(
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"),
        F.lit("same").alias("name"),
        F.col("label").cast("string").alias("entity_class"),
        F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string")).alias("domain"),
        "embedding",
    )
    return refine.conflict_candidates(ents, ["d0", "d1", "d2"], 0.6).select("id_a", "id_b", F.round("similarity", 9).alias("similarity"))


@query(
    "c5_evidence",
    with_(X, C) +
        ", r AS (SELECT doc_id % 50 AS entity_id, chunk_id, substr(text, 1, 40) AS excerpt, row_number() OVER (PARTITION BY doc_id "
        "% 50 ORDER BY chunk_id) AS k FROM chunk) SELECT entity_id, chunk_id, excerpt FROM r WHERE k <= 3",
)
def c5(spark, sf):
    c = B.chunks(B.documents(spark, sf))
    return refine.evidence(c.select((F.col("doc_id") % 50).alias("entity_id"), "chunk_id"), c, 3, 40)


@query(
    "c6_verdicts",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'conflicting' WHEN event_type = 'view' THEN 'superseded' ELSE "
        "'unrelated' END AS verdict, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS severity FROM events",
)
def c6(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", " Conflicting").when(F.col("event_type") == "view", "SUPERSEDED").otherwise(F.col("event_type"))
    v, s = refine.verdict_columns(raw, F.when(F.col("event_id") % 3 == 0, "High").otherwise("?"))
    return e.select("event_id", v.alias("verdict"), s.alias("severity"))


@query(
    "c7_conflict_ids",
    "SELECT o_orderkey, sha1(least('a' || o_custkey, 'b' || o_orderkey) || '|' || greatest('a' || o_custkey, 'b' || "
        "o_orderkey) || '|' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-')) AS id FROM orders",
)
def c7(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        refine.conflict_id(
            F.concat(F.lit("b"), F.col("o_orderkey").cast("string")),
            F.concat(F.lit("a"), F.col("o_custkey").cast("string")),
            F.col("o_orderpriority"),
        ).alias("id"),
    )


@query(
    "c9_gate",
    """SELECT doc_id AS id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS fragments, CASE WHEN doc_id % 11 = 0 THEN 'open_conflict' WHEN doc_id % 7 = 0 THEN 'no_chunks' WHEN doc_id % 5 = 0 THEN 'unchanged' WHEN len(string_split(text, chr(10))) < 2 THEN 'too_few_fragments' ELSE 'go' END AS gate FROM documents""",
)
def c9(spark, sf):
    d = table(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("x"), x))
    none = F.array().cast("array<string>")
    chunks = F.when(F.col("doc_id") % 7 == 0, none).otherwise(F.array(F.lit("b"), F.lit("a")))
    rows = d.select(
        F.col("doc_id").alias("id"),
        F.regexp_replace(F.array_join(lines, "\n"), r" \| ", "|").alias("t"),
        F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0).alias("open_conflicts"),
        chunks.alias("chunk_ids"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("source_chunks"),
    )
    return refine.consolidation_gate(rows.withColumn("description", F.regexp_replace("t", "\n", " | ")))


@query("c9_excerpts", with_(X, C) + """, l AS (SELECT doc_id % 40 AS entity_id, chunk_id, CASE WHEN valid_to IS NULL OR valid_to > '2024-08-01' THEN 0 ELSE 1 END AS old FROM chunk), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY old, chunk_id) AS k FROM l)
SELECT entity_id, string_agg(chunk_id, ',' ORDER BY k) AS chunk_ids FROM r WHERE k <= 6 GROUP BY 1""")
def c9_excerpts(spark, sf):
    c = B.chunks(B.documents(spark, sf))
    return refine.excerpts(
        c.select((F.col("doc_id") % 40).alias("entity_id"), "chunk_id"), c, "2024-08-01"
    ).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("h3_job_status", "SELECT user_id, max_by(event_type, ts) AS status, count(*) AS n FROM events GROUP BY 1")
def h3(spark, sf):
    return jobs.last_status(table(spark, sf, "events"), "user_id", "ts", "event_type")


@query(
    "s1_tumbling_windows",
    "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def s1(spark, sf):
    out = incremental.windowed(table(spark, sf, "events"), "6 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "s2_sliding_windows",
    """SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS start FROM events) WHERE ts < start + INTERVAL 2 DAYS GROUP BY 1, 2""",
)
def s2(spark, sf):
    out = incremental.windowed(table(spark, sf, "events"), "2 days", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("s3_session_windows", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM k GROUP BY user_id, k""")
def s3(spark, sf):
    out = incremental.sessions(table(spark, sf, "events"), "2 hours")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
