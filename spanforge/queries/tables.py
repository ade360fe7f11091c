"""The structured store: SQL over registered tables, classification state, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import normalize_domains
from ..functions.text import identifier_column
from ..operators import fusion
from ..plans import bindings as B
from ..plans.bindings import with_
from ..plans.catalog import query, table
from ..plans.guard import asof_join, run_sql
from ..sources.store import view_name_column
from .retrieval import REGISTRY, _registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _views(spark, sf):
    return {t: table(spark, sf, t) for t in TABLES}


#: Queries that mean the same in both dialects, or are rewritten by the guard: (name, here, there).
SAME = {
    "q_inner_join": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "q_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey",
    "q_full_join":
        "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE "
        "c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey > 9 GROUP BY "
        "1) b ON c_nationkey = s_nationkey",
    "q_cross_join": "SELECT r_name, x FROM region CROSS JOIN (SELECT 1 AS x UNION ALL SELECT 2) t",
    "q_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "q_anti": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 45)",
    "q_null_safe":
        "SELECT count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer) a JOIN "
        "(SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k",
    "q_lateral":
        "SELECT n_nationkey, top.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey "
        "ORDER BY c_acctbal DESC, c_custkey LIMIT 2) top",
    "q_pricing_summary":
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, "
        "round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM "
        "lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "q_revenue":
        "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND "
        "l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24",
    "q_region_volume":
        "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS volume FROM lineitem JOIN orders ON l_orderkey = "
        "o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = "
        "r_regionkey GROUP BY r_name",
    "q_filter_clause": "SELECT event_type, count(*) FILTER (WHERE value > 100) AS high, count(*) AS n FROM events GROUP BY ALL",
    "q_grouping_sets": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "q_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "q_rollup": "SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)",
    "q_median": "SELECT event_type, round(median(value), 6) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM events GROUP BY event_type",
    "q_having_distinct": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 5",
    "q_window_rank":
        "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r, "
        "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS d FROM orders",
    "q_window_rows":
        "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT "
        "ROW), 6) AS running, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "q_window_range":
        "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING "
        "AND CURRENT ROW) AS n FROM orders",
    "q_window_ntile":
        "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q, "
        "round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 9) AS p FROM customer",
    "q_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5",
    "q_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "q_except_all": "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity < 25 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity < 10",
    "q_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "q_case_scalar":
        "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, replace(p_name, 'widget', 'W') AS r, CASE WHEN "
        "p_size > 25 THEN 'big' ELSE 'small' END AS s, coalesce(nullif(p_brand, 'Brand#1'), 'none') AS b FROM part",
    "q_like_ilike": "SELECT p_partkey FROM part WHERE p_name LIKE '%cold%' OR p_brand ILIKE 'brand#2%'",
    "q_math":
        "SELECT c_custkey, round(abs(c_acctbal), 1) AS a, CAST(floor(c_acctbal / 100) AS BIGINT) AS f, round(sqrt(abs(c_acctbal)), "
        "6) AS s, c_custkey % 7 AS m FROM customer",
    "q_date_parts":
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS "
        "INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q FROM orders",
    "q_interval": "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS due FROM orders",
    "q_scalar_subquery": "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey)",
    "q_cte":
        "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1), m AS (SELECT max(t) AS t FROM big) SELECT "
        "o_custkey FROM big JOIN m ON big.t >= m.t * 0.8",
    "q_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r",
    "q_values": "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(k, v) WHERE v IS NOT NULL",
}
#: Queries whose two dialects differ.
PAIRS = {
    "q_qualify": (
        "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    ) * 2,
    "q_exclude": ("SELECT * EXCLUDE (p_name, p_type) FROM part",) * 2,
    "q_pivot": (
        "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))",
        "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS o, sum(l_quantity) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1",
    ),
    "q_lateral_alias": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, net * (1 + l_tax) AS gross FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, net * (1 + l_tax) AS gross FROM lineitem",
    ),
    "q_unpivot": (
        "SELECT l_orderkey, l_linenumber, k, v FROM lineitem UNPIVOT (v FOR k IN (l_quantity, l_tax))",
        "SELECT l_orderkey, l_linenumber, k, v FROM (SELECT l_orderkey, l_linenumber, 'l_quantity' AS k, l_quantity AS v FROM "
            "lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)",
    ),
    "q_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "q_arrays": (
        "SELECT p_partkey, array_join(array_sort(transform(split(p_name, ' '), x -> upper(x))), '-') AS words, "
            "size(filter(split(p_name, ' '), x -> length(x) > 4)) AS n FROM part",
        "SELECT p_partkey, array_to_string(list_sort(list_transform(string_split(p_name, ' '), lambda x: upper(x))), '-') AS "
            "words, CAST(len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4)) AS INTEGER) AS n FROM part",
    ),
    "q_explode": (
        "SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS word",
        "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
    ),
    "q_map": (
        "SELECT c_custkey, map('segment', c_mktsegment, 'name', c_name)['segment'] AS s FROM customer",
        "SELECT c_custkey, c_mktsegment AS s FROM customer",
    ),
    "q_listagg": (
        "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "q_regex": (
        "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, regexp_replace(c_name, '[0#]+', '') AS bare FROM customer",
        "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, regexp_replace(c_name, '[0#]+', '', 'g') AS bare FROM customer",
    ),
    "q_string_split": (
        "SELECT p_partkey, string_split(p_brand, '#')[1] AS n FROM part", "SELECT p_partkey, string_split(p_brand, '#')[2] AS n FROM part"
    ),
    "q_group_frame": (
        "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM "
            "(SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS g FROM events)",
        "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events",
    ),
    "q_date_trunc": (
        "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1",
        "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1",
    ),
}


def _add(name, here, there):
    @query(name, there)
    def run(spark, sf):
        return run_sql(spark, here, _views(spark, sf))


for _name, _sql in SAME.items():
    _add(_name, _sql, _sql)
for _name, (_here, _there) in PAIRS.items():
    _add(_name, _here, _there)


@query(
    "q_range_join",
    "SELECT c_custkey, count(*) AS n FROM customer JOIN (SELECT s_suppkey, s_acctbal - 50 AS lo, s_acctbal + 50 AS hi FROM "
        "supplier) s ON c_acctbal BETWEEN lo AND hi GROUP BY 1",
)
def q_range_join(spark, sf):
    """A band join: both sides go to buckets of the band's width, and meet in equal ones."""
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") - 50).alias("lo"), (F.col("s_acctbal") + 50).alias("hi"))
    bucket = lambda c: F.floor(F.col(c) / 100)
    s = s.withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", bucket("c_acctbal").alias("bucket"))
    return c.join(s, "bucket").filter("c_acctbal BETWEEN lo AND hi").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query(
    "q_asof_join",
    "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts - INTERVAL 9490 DAY AS at FROM events) e ASOF LEFT "
        "JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = "
        "o.o_custkey AND e.at >= o.o_orderdate",
)
def q_asof_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), (F.col("ts") - F.expr("INTERVAL 9490 DAYS")).alias("at"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return asof_join(e, o, ["k"], "at", "o_orderdate").select("event_id", "o_orderkey")


@query(
    "q_union_by_name",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS name FROM supplier",
)
def q_union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("a7_identifiers", """SELECT DISTINCT p_name, p_size, CASE WHEN x = '' THEN 'table' WHEN regexp_matches(x, '^[0-9]') THEN 't_' || x ELSE x END AS ident
FROM (SELECT p_name, p_size, lower(trim(regexp_replace(CASE WHEN p_size % 2 = 0 THEN p_size || ' -- ' ELSE ' Ä(' END || p_name || '! (é)', '[^A-Za-z0-9_]', '_', 'g'), '_')) AS x FROM part)""")
def a7(spark, sf):
    raw = F.concat(
        F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" -- "))).otherwise(" Ä("), "p_name", F.lit("! (é)")
    )
    return table(spark, sf, "part").select("p_name", "p_size", identifier_column(raw).alias("ident")).distinct()


@query(
    "a10_introspection",
    "SELECT 'customer' AS \"table\", unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS "
        "\"column\", unnest(['bigint', 'string', 'int', 'double', 'string']) AS type",
)
def a10(spark, sf):
    return spark.createDataFrame([("customer", c, t) for c, t in table(spark, sf, "customer").dtypes], "table string, column string, type string")


@query("b1_domains", "SELECT unnest(['en', 'de.src3', 'fr']) AS domain")
def b1(spark, sf):
    return spark.createDataFrame([(d,) for d in normalize_domains(["en, de.src3", " en ", "fr,"])], "domain string")


@query("a9_view_names", "SELECT DISTINCT lang || '_' || source || '__' || 'documents' AS view_name FROM documents")
def a9(spark, sf):
    return B.documents(spark, sf).select(view_name_column(F.col("domain"), "documents").alias("view_name")).distinct()


@query(
    "f1_fusion_bridges",
    f"WITH {REGISTRY} SELECT domain, name AS \"table\", col AS \"column\" FROM tbl JOIN role USING (table_id) WHERE domain IN ('r1', 'r2') OR starts_with(domain, 'r1.') OR starts_with(domain, 'r2.')",
)
def f1(spark, sf):
    return fusion.fusion_hints(*_registry(spark, sf), ["r1", "r2"])[0]


@query(
    "f1_fusion_quarantine",
    f"WITH {REGISTRY} SELECT domain, name AS \"table\" FROM tbl WHERE grain = 'normative' AND table_id IN (SELECT table_id FROM mapping) AND (domain IN ('r0', 'r3') OR starts_with(domain, 'r0.') OR starts_with(domain, 'r3.'))",
)
def f1_quarantine(spark, sf):
    return fusion.fusion_hints(*_registry(spark, sf), ["r0", "r3"])[1]


@query("f2_resolve_key")
def f2(spark, sf):
    """Part names and brands that a phrase may stand for, by difflib; tests hold it against a plain loop."""
    p = table(spark, sf, "part")
    return fusion.resolve_key("cold widgets", p.select(F.col("p_name").alias("value")), p.select(F.col("p_type").alias("value")), 10)


@query(
    "f4_upsert",
    f"WITH {REGISTRY}, n AS (SELECT n_nationkey AS table_id, 'name' AS col, 'SUPPLIER' AS entity_class FROM nation) SELECT n.table_id, 'name' AS \"column\", CASE WHEN m.confirmed THEN m.entity_class ELSE n.entity_class END AS entity_class FROM n LEFT JOIN mapping m USING (table_id)",
)
def f4(spark, sf):
    _, mappings, _ = _registry(spark, sf)
    new = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("table_id"),
        F.lit("name").alias("column"),
        F.lit("SUPPLIER").alias("entity_class"),
        F.lit(False).alias("confirmed"),
    )
    return fusion.upsert_rows(mappings, new, ["table_id", "column"]).select("table_id", "column", "entity_class")


@query(
    "f6_catalogue_edges",
    f"WITH {REGISTRY} SELECT domain || '/' || name || '/name' AS src, entity_class AS dst, 'MAPS_TO' AS rel_type, confirmed FROM tbl JOIN mapping USING (table_id) WHERE domain = 'r1' OR starts_with(domain, 'r1.') UNION ALL SELECT domain || '/' || name, domain || '/' || name || '/name', 'HAS_COLUMN', true FROM tbl WHERE domain = 'r1' OR starts_with(domain, 'r1.')",
)
def f6(spark, sf):
    tables, mappings, _ = _registry(spark, sf)
    columns = tables.select("table_id", F.lit("name").alias("column"))
    return fusion.catalogue(tables, columns, mappings, "r1")[1]


@query("f8_review_queue", f"""WITH {REGISTRY}, r AS (SELECT domain, name AS "table", coalesce(m.n, 0) AS open_mappings, coalesce(o.n, 0) AS open_roles, grain IS NOT NULL AND NOT grain_confirmed AS grain_open FROM tbl
  LEFT JOIN (SELECT table_id, count(*) AS n FROM mapping WHERE NOT confirmed GROUP BY 1) m USING (table_id) LEFT JOIN (SELECT table_id, count(*) AS n FROM role WHERE NOT confirmed GROUP BY 1) o USING (table_id))
SELECT * FROM r WHERE open_mappings > 0 OR open_roles > 0 OR grain_open""")
def f8(spark, sf):
    return fusion.review_queue(*_registry(spark, sf))


@query("q4_ask_tables", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def q4(spark, sf):
    """A question through a fixed model, run where only the given views are."""
    model = lambda _: '```json\n{"sql": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"}\n```'
    return fusion.ask_tables(spark, "customers by segment", model, {"customer": table(spark, sf, "customer")}, "customer", "en")["rows"]


@query("q5_ask_graph", with_(B.ENTITIES_SQL) + "SELECT entity_class, count(*) AS n FROM entity WHERE starts_with(domain, 'asia.') GROUP BY 1")
def q5(spark, sf):
    model = lambda _: '{"query": "SELECT entity_class, count(*) AS n FROM entity WHERE exists(:domains, d -> startswith(domain, concat(d, \'.\'))) GROUP BY 1"}'
    return fusion.ask_graph(
        spark, "what is in asia", model, {"entity": B.entities(spark, sf)}, "entity(id, name, entity_class, domain)", {}, "asia"
    )["rows"]
