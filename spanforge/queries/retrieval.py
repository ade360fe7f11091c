"""Vector and full-text search, fusion, metrics, and aggregates about what is stored."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.predicates import live_chunk
from ..functions.text import ENTITIES
from ..operators import metadata as M
from ..operators import metrics as Q
from ..operators import retrieval as R
from ..plans import bindings as B
from ..plans.bindings import with_
from ..plans.catalog import query, table
from ..sources.files import pages_to_documents

E, D, C, X, N = B.ENTITIES_SQL, B.EDGES_SQL, B.CHUNKS_SQL, B.DOCUMENTS_SQL, B.MENTIONS_SQL
VECTOR = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3)"
COS = "list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q)))"


def query_vector(spark, sf):
    return [float(x) for x in table(spark, sf, "embeddings").filter("vec_id = 3").first()["embedding"]]


def bm25_sql(rows: str, terms: list[str], k: int) -> str:
    """BM25 of rows (id, text) as a query."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""(WITH w AS (SELECT id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM ({rows})),
  st AS (SELECT count(*) AS n, avg(len(ws)) AS avgl FROM w),
  t AS (SELECT id, term, len(list_filter(ws, lambda x: x = term)) AS tf, len(ws) AS l FROM w, (VALUES {values}) q(term)),
  df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM t GROUP BY 1)
  SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgl))) AS score
  FROM t JOIN df USING (term), st WHERE tf > 0 GROUP BY id ORDER BY round(score, 12) DESC, id LIMIT {k})"""


@query(
    "v1_vector_search",
    f"WITH {VECTOR} SELECT vec_id AS id, round({COS}, 9) AS cos, round((1 + {COS}) / 2, 9) AS score FROM embeddings, q WHERE label <> 3 ORDER BY cos DESC, id LIMIT 20",
)
def v1(spark, sf):
    rows = table(spark, sf, "embeddings").filter("label <> 3")
    found = R.vector_search(rows, query_vector(spark, sf), 20, "vec_id")
    return found.select("id", F.round("cos", 9).alias("cos"), F.round("score", 9).alias("score"))


TERMS = ["the", "idiot", "thonion"]
CHUNK_ROWS = "SELECT chunk_id AS id, text FROM chunk WHERE (domain = 'en' OR starts_with(domain, 'en.')) AND NOT deleted"
CHAT_ROWS = "SELECT conv_id || '_' || turn AS id, text FROM conversations WHERE role = 'user'"


def chats(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.lit("en.chat").alias("domain")
    )


def search_chunks(spark, sf):
    return B.chunks(B.documents(spark, sf)).withColumnRenamed("chunk_id", "id")


@query(
    "v2_full_text",
    with_(X, C) + f"SELECT source, id, round(score, 9) AS score FROM (SELECT 'chunk' AS source, id, score FROM {bm25_sql(CHUNK_ROWS, TERMS, 10)} UNION ALL SELECT 'chat', id, score FROM {bm25_sql(CHAT_ROWS, TERMS, 10)}) ORDER BY round(score, 12) DESC, source DESC, id LIMIT 10",
)
def v2(spark, sf):
    found = R.full_text(search_chunks(spark, sf), chats(spark, sf), "The idiot (thonion)", "en", k=10)
    return found.select("source", "id", F.round("score", 9).alias("score"))


@query("v3_resolve_entities", with_(E) + f"""SELECT 'entity:' || id AS key, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 12) DESC, id)) AS score, NULL::INTEGER AS vector_rank, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, id) AS INTEGER) AS text_rank
  FROM {bm25_sql("SELECT id, name || ' ' || lower(entity_class) AS text FROM entity WHERE starts_with(domain, 'goods.')", ["cold", "widget"], 5)}""".replace("1.0 / (60 + row", "1::DOUBLE / (60 + row"))
def v3(spark, sf):
    ents = B.entities(spark, sf).withColumn("description", F.lower("entity_class")).withColumn("embedding", F.lit(None).cast("array<float>"))

    def down(_):
        raise ConnectionError

    return R.resolve_entities(ents, "cold widget", down, "goods")


@query("v4_rank_fusion", """WITH v AS (SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50),
  t AS (SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id % 97, doc_id) AS r FROM documents QUALIFY r <= 50)
SELECT key, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + t.r), 0), 12)::DOUBLE AS score, CAST(v.r AS INTEGER) AS vector_rank, CAST(t.r AS INTEGER) AS text_rank FROM v FULL JOIN t USING (key)""")
def v4(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    v = _rank(d.orderBy(F.desc("n_chars"), "key").limit(50), F.desc("n_chars"), F.col("key"))
    t = _rank(d.orderBy(F.col("key") % 97, "key").limit(50), F.col("key") % 97, F.col("key"))
    return R.reciprocal_rank_fusion(v, t).withColumn("score", F.round("score", 12))


def _rank(rows, *order):
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select("key", "rank")


@query("v5_hybrid", with_(X, C) + f""", {VECTOR},
  ranked AS (SELECT 'chat:' || vec_id AS key, {COS} AS cos FROM embeddings, q WHERE label = 1 ORDER BY cos DESC, vec_id LIMIT 5),
  v AS (SELECT key, row_number() OVER (ORDER BY round(cos, 12) DESC, key) AS r FROM ranked),
  t AS (SELECT 'chunk:' || id AS key, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS r FROM {bm25_sql(CHUNK_ROWS, TERMS, 5)})
SELECT key, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + t.r), 0), 12)::DOUBLE AS score, CAST(v.r AS INTEGER) AS vector_rank, CAST(t.r AS INTEGER) AS text_rank
  FROM v FULL JOIN t USING (key) ORDER BY score DESC, v.r NULLS LAST, t.r NULLS LAST LIMIT 5""")
def v5(spark, sf):
    e = table(spark, sf, "embeddings").filter("label = 1").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", F.lit("en.chat").alias("domain")
    )
    leg = R.vector_search(e, query_vector(spark, sf), 5)
    v = R.ranked(leg, F.concat(F.lit("chat:"), "id"), F.desc("cos"), F.col("id"))
    t = R.ranked(
        R.full_text(search_chunks(spark, sf), None, "the idiot thonion", "en", k=5), F.concat_ws(":", "source", "id"), F.desc("score"), F.col("id")
    )
    return R.reciprocal_rank_fusion(v, t, top=5).withColumn("score", F.round("score", 12))


@query(
    "v6_embedding_backfill", "SELECT vec_id, label, CAST(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE len(embedding) END AS INTEGER) AS size FROM embeddings"
)
def v6(spark, sf):
    e = table(spark, sf, "embeddings").withColumns(
        {"text": F.col("vec_id").cast("string"), "embedding": F.when(F.col("vec_id") % 3 == 0, F.lit(None)).otherwise(F.col("embedding"))}
    )
    return R.backfill_embeddings(e, lambda t: [float(len(t)), 1.0]).select("vec_id", "label", F.size("embedding").alias("size"))


@query("m1_node_schema", """SELECT DISTINCT event_type AS label, k AS property, CASE WHEN k = 'k' OR k = 'user' THEN 'INTEGER' ELSE 'FLOAT' END AS type
  FROM events, (VALUES ('k'), ('user'), ('value')) p(k)""")
def m1(spark, sf):
    e = table(spark, sf, "events")
    props = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("value"), F.col("value").cast("decimal(20,4)").cast("string")),
    )
    return M.node_schema(e.select("event_type", props.alias("props")), "event_type", "props")


@query(
    "m1_relationship_schema",
    with_(E, D) +
        "SELECT DISTINCT rel_type, 'weight' AS property, s.entity_class AS from_class, t.entity_class AS to_class FROM edge JOIN "
        "entity s ON s.id = src_id JOIN entity t ON t.id = dst_id WHERE rel_type IN ('BOUGHT', 'SUPPLIES')",
)
def m1r(spark, sf):
    ents = B.entities(spark, sf)
    e = B.edges(spark, sf).withColumn(
        "props",
        F.when(
            F.col("rel_type").isin("BOUGHT", "SUPPLIES"), F.create_map(F.lit("weight"), F.col("weight").cast("string"))
        ).otherwise(F.create_map().cast("map<string,string>")),
    )
    e = e.join(
        ents.select(F.col("id").alias("src_id"), F.col("entity_class").alias("from_class")), "src_id"
    ).join(ents.select(F.col("id").alias("dst_id"), F.col("entity_class").alias("to_class")), "dst_id")
    return M.relationship_schema(e, "props")


@query("m2_structural_counts", with_(E, D, X, C, N) + """SELECT 'documents' AS kind, count(*) AS n FROM doc UNION ALL SELECT 'chunks', count(*) FROM chunk UNION ALL SELECT 'entities', count(*) FROM entity
  UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'mentions', count(*) FROM mention""")
def m2(spark, sf):
    docs = B.documents(spark, sf)
    return M.structural_counts(
        documents=docs, chunks=B.chunks(docs), entities=B.entities(spark, sf), edges=B.edges(spark, sf), mentions=B.mentions(spark, sf)
    )


@query("m3_filing_vocabulary", with_(X) + """SELECT facet, value, count(*) AS n FROM (SELECT 'project' AS facet, project AS value FROM doc UNION ALL SELECT 'domain', domain FROM doc
  UNION ALL SELECT 'tags', unnest(string_split(domain, '.')) FROM doc) GROUP BY 1, 2 HAVING count(*) >= 12 ORDER BY 1, 3 DESC, 2""")
def m3(spark, sf):
    return M.filing_vocabulary(B.documents(spark, sf).withColumn("tags", F.split("domain", r"\.")), min_count=12)


@query("m4_filing_list", with_(X) + """SELECT doc_id AS id, domain, project FROM doc WHERE (domain = 'en' OR starts_with(domain, 'en.')) AND project = 'p3' AND list_has_any(string_split(domain, '.'), ['src1', 'src4'])
  AND (valid_from IS NULL OR valid_from <= '2024-07-01') AND (valid_to IS NULL OR valid_to > '2024-07-01') ORDER BY valid_from DESC, doc_id""")
def m4(spark, sf):
    d = B.documents(spark, sf).withColumns({"id": F.col("doc_id"), "tags": F.split("domain", r"\."), "created_on": F.col("valid_from")})
    return M.filing_list(d, "en", tags=["src1", "src4"], as_of="2024-07-01", project="p3").select("id", "domain", "project")


@query(
    "m5_entity_listing",
    with_(E) +
        "SELECT entity_class, split_part(domain, '.', 1) AS type, count(DISTINCT name) AS n_names, string_agg(DISTINCT name, ',' "
        "ORDER BY name) AS names FROM entity WHERE contains(lower(name), '7') GROUP BY 1, 2",
)
def m5(spark, sf):
    ents = B.entities(spark, sf).withColumn("type", F.substring_index("domain", ".", 1))
    return M.entity_listing(ents, "asia,america,africa,europe,middle east,goods", "7").withColumn("names", F.array_join("names", ","))


@query("m6_domains_overview", with_(E, X) + """, dd AS (SELECT domain, count(*) AS n_documents, string_agg('doc' || doc_id, ',' ORDER BY 'doc' || doc_id) FILTER (k <= 25) AS documents FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY 'doc' || doc_id) AS k FROM doc) GROUP BY 1),
  ec AS (SELECT domain, entity_class, count(*) AS n, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, entity_class) AS k FROM entity GROUP BY 1, 2),
  ee AS (SELECT domain, sum(n) AS n_entities, string_agg(entity_class, ',' ORDER BY k) FILTER (k <= 8) AS classes FROM ec GROUP BY 1)
SELECT domain, coalesce(n_documents, 0) AS n_documents, coalesce(documents, '') AS documents, CAST(coalesce(n_entities, 0) AS BIGINT) AS n_entities, coalesce(classes, '') AS classes, CAST(0 AS BIGINT) AS n_tables FROM dd FULL JOIN ee USING (domain)""")
def m6(spark, sf):
    docs = B.documents(spark, sf).withColumn("name", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    out = M.domains_overview(docs, B.entities(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("documents", "classes")})


PROFILED = ("p_brand", "p_type", "p_size", "p_retailprice", "p_name")


def _profile_sql():
    parts = []
    for c in PROFILED:
        if c in ("p_size", "p_retailprice"):
            parts.append(
                f"SELECT '{c}' AS \"column\", 'numeric' AS kind, CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*) AS null_rate, NULL::BIGINT AS cardinality, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, NULL::VARCHAR AS sample FROM part"
            )
        else:
            parts.append(
                f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= 200 THEN 'categorical' ELSE 'other' END, CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*), count(DISTINCT {c}), NULL, NULL, CASE WHEN count(DISTINCT {c}) <= 200 THEN (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM part WHERE {c} IS NOT NULL ORDER BY v LIMIT 25)) END FROM part"
            )
    parts.sort(key=lambda p: "AS kind" not in p)
    return " UNION ALL ".join(parts)


@query("m7_profile", _profile_sql())
def m7(spark, sf):
    return M.profile(table(spark, sf, "part").select(*PROFILED)).withColumn("sample", F.array_join("sample", ","))


def _registry(spark, sf):
    """Tables, mappings and roles over the star schema's nations: a table a nation."""
    n = table(spark, sf, "nation")
    tables = n.select(
        F.col("n_nationkey").alias("table_id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(".sub")).otherwise("")).alias("domain"),
        F.lower("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 3 == 0, "normative").when(F.col("n_nationkey") % 3 == 1, "instance").alias("grain"),
        (F.col("n_nationkey") % 2 == 0).alias("grain_confirmed"),
        F.col("n_nationkey").cast("bigint").alias("row_count"),
    )
    mappings = n.filter("n_nationkey % 4 <> 0").select(
        F.col("n_nationkey").alias("table_id"),
        F.lit("name").alias("column"),
        F.when(F.col("n_nationkey") % 5 == 0, "PART").otherwise("CUSTOMER").alias("entity_class"),
        (F.col("n_nationkey") % 2 == 1).alias("confirmed"),
    )
    roles = n.filter("n_nationkey % 2 = 1").select(
        F.col("n_nationkey").alias("table_id"),
        F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("column"),
        F.lit("bridge").alias("role"),
        (F.col("n_nationkey") % 3 == 1).alias("confirmed"),
    )
    return tables, mappings, roles


REGISTRY = """tbl AS (SELECT n_nationkey AS table_id, 'r' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '.sub' ELSE '' END AS domain, lower(n_name) AS name,
    CASE n_nationkey % 3 WHEN 0 THEN 'normative' WHEN 1 THEN 'instance' END AS grain, n_nationkey % 2 = 0 AS grain_confirmed, CAST(n_nationkey AS BIGINT) AS row_count FROM nation),
  mapping AS (SELECT n_nationkey AS table_id, 'name' AS col, CASE WHEN n_nationkey % 5 = 0 THEN 'PART' ELSE 'CUSTOMER' END AS entity_class, n_nationkey % 2 = 1 AS confirmed FROM nation WHERE n_nationkey % 4 <> 0),
  role AS (SELECT n_nationkey AS table_id, 'c' || n_nationkey AS col, n_nationkey % 3 = 1 AS confirmed FROM nation WHERE n_nationkey % 2 = 1)"""


@query(
    "m8_routing",
    f"WITH {REGISTRY} SELECT domain, name AS \"table\", entity_class, mapping.confirmed, coalesce(role.col, '') AS bridges FROM tbl JOIN mapping USING (table_id) LEFT JOIN role USING (table_id) WHERE domain = 'r1.sub' OR starts_with(domain, 'r1.sub.') OR starts_with('r1.sub', domain || '.')",
)
def m8(spark, sf):
    out = M.routing(*_registry(spark, sf), domains="r1.sub").filter("classes IS NOT NULL")
    return out.select(
        "domain", "table", F.explode("classes").alias("c"), F.coalesce(F.array_join("bridges", ","), F.lit("")).alias("bridges")
    ).select("domain", "table", "c.entity_class", "c.confirmed", "bridges")


@query(
    "m9_progress",
    "SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'view')) AS done, count(*) FILTER "
        "(event_type = 'error') AS failed FROM events GROUP BY 1",
)
def m9(spark, sf):
    e = table(spark, sf, "events").withColumn(
        "status",
        F.when(F.col("event_type") == "purchase", "ok").when(
            F.col("event_type") == "view", "skipped"
        ).when(F.col("event_type") == "error", "failed").otherwise("pending"),
    )
    return M.progress(e, "user_id")


@query(
    "m10_run_summary",
    "SELECT user_id AS run_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS answered, count(*) FILTER (event_type "
        "= 'error') AS failed, round(sum(value), 4) AS seconds, round(sum(value / 100), 6) AS cost, CAST(sum(event_id % 7) AS "
        "BIGINT) AS turns FROM events GROUP BY 1",
)
def m10(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.col("value").alias("duration_s"),
        (F.col("value") / 100).alias("cost_usd"),
        (F.col("event_id") % 7).alias("turns"),
    )
    return M.run_summary(e).withColumns({"seconds": F.round("seconds", 4), "cost": F.round("cost", 6)})


JUDGED = """ranked AS (SELECT user_id AS query_id, event_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
  rel AS (SELECT user_id AS query_id, event_id AS item_id FROM events WHERE event_type = 'purchase')"""


def _judged(spark, sf):
    e = table(spark, sf, "events")
    ranked = e.select(
        F.col("user_id").alias("query_id"),
        F.col("event_id").alias("item_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"),
    )
    return ranked, e.filter("event_type = 'purchase'").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"))


METRICS_SQL = f"""WITH {JUDGED}, hits AS (SELECT ranked.*, rel.item_id IS NOT NULL AS good FROM ranked LEFT JOIN rel USING (query_id, item_id) WHERE rank <= 10),
  s AS (SELECT query_id, count(*) AS n, count(*) FILTER (good) AS g, min(rank) FILTER (good) AS first, sum(CASE WHEN good THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY 1),
  tot AS (SELECT query_id, count(*) AS r FROM rel GROUP BY 1),
  m AS (SELECT query_id, round(coalesce(1.0 / first, 0), 9)::DOUBLE AS mrr, round(g / CAST(n AS DOUBLE), 9) AS precision, round(g / CAST(r AS DOUBLE), 9) AS recall,
    round(dcg / list_sum(list_transform(range(1, least(r, 10) + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg, CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM tot JOIN s USING (query_id))"""


@query("m11_retrieval_metrics", METRICS_SQL + " SELECT * FROM m")
def m11(spark, sf):
    out = Q.retrieval_metrics(*_judged(spark, sf), k=10)
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in ("mrr", "precision", "recall", "ndcg", "hit")])


@query(
    "m11_mean_metrics",
    METRICS_SQL + " SELECT round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit, round(0.5 * avg(mrr) + 0.5 * avg(ndcg), 6) AS composite FROM m",
)
def m11_mean(spark, sf):
    out = Q.mean_metrics(Q.retrieval_metrics(*_judged(spark, sf), k=10), {"mrr": 1.0, "ndcg": 1.0})
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("m12_session_history", """WITH s AS (SELECT user_id AS session_id, min(ts) AS created_at FROM events GROUP BY 1), d AS (SELECT user_id AS session_id, 'note ' || event_type || event_id AS raw_text FROM events WHERE event_type IN ('click', 'view'))
SELECT session_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(n, 0) AS n_drafts, excerpt FROM s LEFT JOIN (SELECT session_id, count(*) AS n, substr(min(raw_text), 1, 80) AS excerpt FROM d GROUP BY 1) USING (session_id)
  WHERE session_id % 2 = 1 ORDER BY s.created_at DESC, session_id LIMIT 20""")
def m12(spark, sf):
    e = table(spark, sf, "events")
    s = e.groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("created_at")).withColumn(
        "created_by", F.when(F.col("session_id") % 2 == 1, "ann").otherwise("bob")
    )
    d = e.filter("event_type IN ('click', 'view')").select(
        F.col("user_id").alias("session_id"), F.concat(F.lit("note "), "event_type", F.col("event_id").cast("string")).alias("raw_text")
    )
    return M.session_history(s, d, user="ann").select(
        "session_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "n_drafts", "excerpt"
    )


@query(
    "m13_staged_inventory",
    """SELECT 'DOC' || doc_id AS name, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_entities, CAST(len(lang) AS BIGINT) AS n_properties, CAST(0 AS BIGINT) AS n_relationships, doc_id % 3 = 0 AS in_graph FROM documents""",
)
def m13(spark, sf):
    d = table(spark, sf, "documents")
    staged = d.select(
        F.concat(F.lit("DOC"), F.col("doc_id").cast("string")).alias("name"),
        F.split("text", "\n").alias("entities"),
        F.split("lang", "").alias("properties"),
        F.lit(None).cast("array<string>").alias("relationships"),
    )
    staged = staged.withColumn("properties", F.array_remove("properties", ""))
    return M.staged_inventory(
        staged, d.filter("doc_id % 3 = 0").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    ).withColumn("n_relationships", F.greatest("n_relationships", F.lit(0).cast("long")))


def _html_sql(column):
    """The same steps in another dialect, whose patterns know no references back."""
    t = column
    for tag in ("script", "style", "head", "template"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<(?:/?(?:p|div|section|article|ul|ol|table|h[1-6])|br|/?li|/?tr)\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', '', 'g')"
    for name, sign in ENTITIES:
        t = f"replace({t}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '[ \\t\\x0B\\f\\r]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query("a14_html_text", f"SELECT page_id, url, {_html_sql('html')} AS text FROM pages")
def a14(spark, sf):
    return pages_to_documents(table(spark, sf, "pages"))


@query(
    "b8_live_domains",
    with_(X, C) + "SELECT domain, count(DISTINCT doc_id) AS n_documents FROM chunk WHERE NOT deleted AND length(text) > 40 GROUP BY 1",
)
def b8(spark, sf):
    return B.chunks(B.documents(spark, sf)).filter(live_chunk() & (F.length("text") > 40)).groupBy("domain").agg(
        F.countDistinct("doc_id").alias("n_documents")
    )
