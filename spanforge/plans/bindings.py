"""The graph views of the star schema: entities, edges, documents, chunks, history.

Entities are customers, suppliers, parts, nations and regions; their domain is a path of
region and nation.  Edges are foreign keys and orders.  The SQL beside each view says the
same for an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import table


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, entity_class, domain)."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", "n_name", F.lower(F.concat_ws(".", "r_name", "n_name")).alias("domain"))
    near = F.broadcast(places.select("n_nationkey", "domain"))
    parts = [
        t("customer").join(near, F.col("c_nationkey") == F.col("n_nationkey")).select(
            _id("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("CUSTOMER").alias("entity_class"), "domain"
        ),
        t("supplier").join(near, F.col("s_nationkey") == F.col("n_nationkey")).select(
            _id("supplier", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("entity_class"), "domain"
        ),
        t("part").select(
            _id("part", "p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.lit("PART").alias("entity_class"),
            F.lower(F.concat(F.lit("goods."), "p_type")).alias("domain"),
        ),
        places.select(_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("NATION").alias("entity_class"), "domain"),
        t("region").select(
            _id("region", "r_regionkey").alias("id"),
            F.col("r_name").alias("name"),
            F.lit("REGION").alias("entity_class"),
            F.lower("r_name").alias("domain"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ENTITIES_SQL = """entity AS (
  WITH place AS (SELECT n_nationkey, n_name, lower(r_name || '.' || n_name) AS domain FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT 'customer:' || c_custkey AS id, c_name AS name, 'CUSTOMER' AS entity_class, domain FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'SUPPLIER', domain FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'PART', lower('goods.' || p_type) FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'NATION', domain FROM place
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'REGION', lower(r_name) FROM region)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_id, dst_id, rel_type, weight): BOUGHT and SUPPLIES are summed up from the order lines."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = t("orders").select("o_orderkey", "o_custkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    supplies = lines.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    one = F.lit(1.0).alias("weight")
    parts = [
        bought.select(
            _id("customer", "o_custkey").alias("src_id"), _id("part", "l_partkey").alias("dst_id"), F.lit("BOUGHT").alias("rel_type"), "weight"
        ),
        supplies.select(
            _id("supplier", "l_suppkey").alias("src_id"), _id("part", "l_partkey").alias("dst_id"), F.lit("SUPPLIES").alias("rel_type"), "weight"
        ),
        t("customer").select(
            _id("customer", "c_custkey").alias("src_id"), _id("nation", "c_nationkey").alias("dst_id"), F.lit("LOCATED_IN").alias("rel_type"), one
        ),
        t("supplier").select(
            _id("supplier", "s_suppkey").alias("src_id"), _id("nation", "s_nationkey").alias("dst_id"), F.lit("LOCATED_IN").alias("rel_type"), one
        ),
        t("nation").select(
            _id("nation", "n_nationkey").alias("src_id"), _id("region", "n_regionkey").alias("dst_id"), F.lit("PART_OF").alias("rel_type"), one
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES_SQL = """edge AS (
  SELECT 'customer:' || o_custkey AS src_id, 'part:' || l_partkey AS dst_id, 'BOUGHT' AS rel_type, sum(l_quantity) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'SUPPLIES', sum(l_quantity) FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN', 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 1.0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF', 1.0 FROM nation)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, domain, project, valid_from, valid_to, status): a document a row."""
    d = table(spark, sf_dir, "documents")
    day = lambda n: F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.pmod("doc_id", F.lit(n))).cast("int")), "yyyy-MM-dd")
    return d.select(
        "doc_id",
        "text",
        F.concat_ws(".", "lang", "source").alias("domain"),
        F.concat(F.lit("p"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("project"),
        day(300).alias("valid_from"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit(None)).otherwise(
            F.date_format(F.date_add(F.to_date(F.lit("2024-06-01")), F.pmod("doc_id", F.lit(200)).cast("int")), "yyyy-MM-dd")
        ).alias("valid_to"),
        F.when(F.pmod("doc_id", F.lit(13)) == 0, "deleted").otherwise(F.lit(None)).alias("status"),
    )


DOCUMENTS_SQL = """doc AS (SELECT doc_id, text, lang || '.' || source AS domain, 'p' || (doc_id % 7) AS project,
  strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS valid_from,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE strftime(DATE '2024-06-01' + CAST(doc_id % 200 AS INTEGER), '%Y-%m-%d') END AS valid_to,
  CASE WHEN doc_id % 13 = 0 THEN 'deleted' END AS status FROM documents)"""


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, seq, text, domain, valid_from, valid_to, deleted): the lines of each document, in order."""
    parts = docs.select(
        "doc_id",
        "domain",
        "valid_from",
        "valid_to",
        (F.coalesce(F.col("status"), F.lit("active")) == "deleted").alias("deleted"),
        F.posexplode(F.split("text", "\n")).alias("seq", "text"),
    )
    return parts.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.lpad(F.col("seq").cast("string"), 5, "0")).alias("chunk_id"),
        "doc_id",
        "seq",
        "text",
        "domain",
        "valid_from",
        "valid_to",
        "deleted",
    )


CHUNKS_SQL = """chunk AS (SELECT doc_id || '_' || lpad(CAST(seq AS VARCHAR), 5, '0') AS chunk_id, doc_id, seq, line AS text, domain, valid_from, valid_to,
  coalesce(status, 'active') = 'deleted' AS deleted
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS seq FROM doc))"""


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity_id, price, valid_from, valid_to): an order holds until the customer's next one."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        _id("order", "o_orderkey").alias("id"),
        _id("customer", "o_custkey").alias("entity_id"),
        F.col("o_totalprice").alias("price"),
        day.alias("valid_from"),
        F.lead(day).over(w).alias("valid_to"),
    )


HISTORY_SQL = """history AS (SELECT 'order:' || o_orderkey AS id, 'customer:' || o_custkey AS entity_id, o_totalprice AS price,
  strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
  lead(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chat_id, entity_id): a user's turn mentions the parts whose number its length leads to."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    n = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("n"))
    return c.crossJoin(F.broadcast(n)).select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chat_id"),
        F.concat(F.lit("part:"), F.pmod(F.length("text") + F.col("conv_id"), F.col("n")).cast("string")).alias("entity_id"),
    )


MENTIONS_SQL = """mention AS (SELECT conv_id || '_' || turn AS chat_id, 'part:' || ((length(text) + conv_id) % (SELECT max(p_partkey) + 1 FROM part)) AS entity_id
  FROM conversations WHERE role = 'user')"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
