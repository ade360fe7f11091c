"""Small cases with stated results."""

import datetime as dt
import subprocess
import sys
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

import spanforge.queries  # noqa: F401  registers
from spanforge.functions import predicates as P
from spanforge.functions import text as T
from spanforge.functions.similarity import ratio
from spanforge.operators import chunking, documents, fusion, graph, jobs, ledger, metadata, metrics, refine, retrieval, scd2, temporal
from spanforge.plans import guard
from spanforge.queries import steps
from spanforge.plans.catalog import ORACLE_SQL, QUERIES
from spanforge.sources import files, store
from spanforge.streaming import incremental

from .conftest import DATA, ROOT


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*(order or df.columns)).collect())


# domains, points in time, selectors


def test_domains_are_flattened_and_deduplicated():
    assert P.normalize_domains("a, b,a ,") == ["a", "b"]
    assert P.normalize_domains(["b,c", "a"]) == ["b", "c", "a"]
    with pytest.raises(ValueError):
        P.normalize_domains(" , ")


def test_a_domain_covers_its_descendants_only(spark):
    d = spark.createDataFrame([("bank",), ("banking",), ("bank.x",), ("b_nk.x",), (None,)], "domain string")
    assert rows(d.filter(P.in_domains("domain", "bank"))) == [("bank",), ("bank.x",)]
    assert rows(d.filter(P.in_domains("domain", "bank", exact=True))) == [("bank",)]
    assert rows(d.filter(P.domains_touch("domain", "bank.x.y"))) == [("bank",), ("bank.x",)]


def test_domain_predicates_reach_the_scan(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").filter(P.in_domains("lang", "en"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "StringStartsWith(lang,en.)" in plan


def test_validity_is_half_open_and_open_ended(spark):
    d = spark.createDataFrame(
        [(1, "2024-01-01", "2024-02-01"), (2, None, None), (3, "2024-02-01", None), (4, None, "2024-01-15")],
        "id int, valid_from string, valid_to string",
    )
    assert rows(d.filter(P.valid_at("2024-02-01")), "id") == [(2,), (3,)]
    assert rows(d.filter(P.snapshot_at("2024-01-10")), "id") == [(1,), (4,)]


@pytest.mark.parametrize(
    ("given", "want"), [(None, None), ("", None), ("today", "2024-05-06"), ("2024", "2024"), ("2024-05-06T10:00", "2024-05-06T10:00")]
)
def test_as_of(given, want):
    assert P.resolve_as_of(given, dt.date(2024, 5, 6)) == want


def test_as_of_rejects_other_text():
    with pytest.raises(ValueError):
        P.resolve_as_of("last week")


def test_labels():
    assert P.normalize_label("works at!") == "WORKS_AT"
    assert P.normalize_label(None) == "UNKNOWN"
    with pytest.raises(ValueError):
        P.normalize_label("9 lives")


def test_parameters_are_checked():
    P.validate("p", {"entity_id": "x"}, {"entity": ("entity_id",)})
    with pytest.raises(ValueError):
        P.validate("p", {}, {"entity": ("entity_id",)})
    with pytest.raises(ValueError):
        P.validate("p", {"mode": "widest"}, {})


def test_envelope():
    assert P.envelope("a")["domain"] == "a"
    assert "domain" not in P.envelope("a,b")


# text


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("2024-03-15T10:00", "2024-03-15"),
        ("2024-03", "2024-03"),
        ("15 March 2026", "2026-03-15"),
        ("March 5, 2026", "2026-03-05"),
        ("2026", "2026"),
        ("soon", None),
        ("31 February 2026", None),
        (None, None),
    ],
)
def test_iso_dates(spark, given, want):
    assert spark.createDataFrame([(given,)], "d string").select(T.iso_date(F.col("d"))).first()[0] == want


def test_title_stems(spark):
    d = spark.createDataFrame([("Policy_v2.md",), ("policy_2026_02.md",), ("Policy",)], "n string")
    assert {r[0] for r in d.select(T.title_stem(F.col("n"))).collect()} == {"policy"}


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("my--file name (1)", "my__file_name__1"),
        ("Ärger x", "rger_x"),
        ("2024 rates", "t_2024_rates"),
        (" _ ", "table"),
        ("", "table"),
        ("a_b", "a_b"),
    ],
)
def test_identifiers_map_each_sign(spark, name, want):
    assert T.sanitize_identifier(name) == want
    assert spark.range(1).select(T.identifier_column(F.lit(name)).alias("x")).first()["x"] == want


def test_identifiers():
    assert [T.sanitize_identifier(x) for x in ("My File!", "2024 data", "--")] == ["my_file", "t_2024_data", "table"]


def test_frontmatter(spark):
    d = spark.createDataFrame([("---\ntitle: A b\ndate: '2024-01-02'\n---\nbody",), ("no\n---\nx: y\n---",), ("---\nbad line\n---\n",)], "t string")
    assert [r[0] for r in d.select(T.frontmatter_map(F.col("t"))).collect()] == [{"title": "A b", "date": "2024-01-02"}, {}, {}]


def test_pages_lose_markup(spark):
    html = "<html><head><title>x</title></head><body><script>var a='<p>';</script><p>One&nbsp;&amp; two</p><!-- no --><p>three<br>four</p></body></html>"
    assert spark.createDataFrame([(html,)], "h string").select(T.html_text(F.col("h"))).first()[0] == "One & two\nthree\nfour"


JSON = {
    "<think>x</think>```json\n[1, 2,]\n```": [1, 2],
    'Sure: {"a": {"b": [1, 2, 3,],},} done': {"a": {"b": [1, 2, 3]}},
    "{'a': 'it\\'s', b: True, c_d: None}": {"a": "it's", "b": True, "c_d": None},
    '{"a": 1 "b": [1 2 3] "c": "x"}': {"a": 1, "b": [1, 2, 3], "c": "x"},
    '[{"a": "x"}, {"a": "y", "b": [1, 2': [{"a": "x"}, {"a": "y", "b": [1, 2]}],
    '{"a": "cut of': {"a": "cut of"},
    '{"a": -1.5e3, // note\n "b": /* no */ 2}': {"a": -1500.0, "b": 2},
    "{\u201ca\u201d: \u201cx\u201d}": {"a": "x"},
    '{"a": "line\nbreak", "b": "\\u00e9"}': {"a": "line\nbreak", "b": "é"},
    "no json": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("raw", JSON)
def test_json_repair(raw):
    assert T.repair_json(raw) == JSON[raw]


def test_json_repair_takes_deep_and_long_texts():
    assert T.repair_json("[" * 100_000) is not None
    assert len(T.repair_json("[" + "1 " * 50_000)) == 50_000


def test_mixed_values_are_merged():
    cases = [
        (None, 1, 1),
        ([1, 2], [2, 3], [1, 2, 3]),
        ([1], 1, [1]),
        ([1], "x", [1, "x"]),
        ("x", ["x", "y"], ["x", "y"]),
        ("z", ["x"], ["z", "x"]),
        ("ab", "b", "ab"),
        ("a", "b", "a | b"),
        ("a", "", "a"),
        (3, 4, 3),
        (True, "x", True),
        (2, [2, 3], [2, 3]),
    ]
    for old, new, want in cases:
        assert ledger.merge_value(old, new) == want


def test_ratio_is_difflibs_and_ordered():
    assert ratio("tide", "diet") == SequenceMatcher(None, "tide", "diet").ratio() == 0.25
    assert ratio("diet", "tide") == 0.5
    assert ratio("A", "a") == 1.0 and ratio(None, "a") == 0.0


# slowly changing tables


def test_scd2_history(spark):
    current = scd2.seed(spark.createDataFrame([(1, "A", 10), (2, "B", 20), (3, "C", 30)], "id int, name string, amount int"), ["id"], "2024-01-01")
    batch = spark.createDataFrame([(1, "A", 10), (2, "B", 25), (4, "D", 40)], "id int, name string, amount int")
    r = scd2.refresh(current, batch, ["id"], "2024-06-01")
    assert tuple(r.counts().first()) == (2, 2, 1)
    a, b = dt.date(2024, 1, 1), dt.date(2024, 6, 1)
    assert sorted(map(tuple, r.table.collect()), key=str) == sorted(
        [(1, "A", 10, a, None, True), (2, "B", 20, a, b, False), (2, "B", 25, b, None, True), (3, "C", 30, a, b, False), (4, "D", 40, b, None, True)],
        key=str,
    )
    again = scd2.refresh(r.table, batch, ["id"], "2024-07-01")
    assert tuple(again.counts().first()) == (0, 0, 3)
    assert rows(scd2.as_of_view(r.table, "2024-03-01"), "id") == [(1,), (2,), (3,)]
    assert rows(scd2.current_view(r.table), "id") == [(1,), (2,), (4,)]


def test_scd2_null_keys_and_errors(spark):
    df = spark.createDataFrame([(None, "A"), (1, None)], "id int, name string")
    current = scd2.seed(df, ["id"], "2024-01-01")
    assert tuple(scd2.refresh(current, df, ["id"], "2024-02-01").counts().first()) == (0, 0, 2)
    with pytest.raises(ValueError):
        scd2.seed(df, ["nope"], "2024-01-01")
    with pytest.raises(ValueError):
        scd2.seed(df.withColumn("_valid_to", F.lit(1)), ["id"], "2024-01-01")
    with pytest.raises(ValueError):
        scd2.refresh(current, df.withColumn("x", F.lit(1)), ["id"], "2024-02-01")


def test_scd2_effective_date(spark):
    df = spark.createDataFrame([(1, "2023-05-05"), (2, None)], "id int, eff string")
    assert [
        r["_valid_from"] for r in scd2.seed(df, ["id"], "2024-01-01", "eff").orderBy("id").collect()
    ] == [dt.date(2023, 5, 5), dt.date(2024, 1, 1)]


# ranking


def test_fusion_lifts_what_both_legs_have(spark):
    v = spark.createDataFrame([("a", 1), ("b", 2)], "key string, rank int")
    t = spark.createDataFrame([("b", 1), ("c", 2)], "key string, rank int")
    assert [r["key"] for r in retrieval.reciprocal_rank_fusion(v, t).collect()] == ["b", "a", "c"]


def test_empty_searches_find_nothing(spark):
    d = spark.createDataFrame([("1", "a b")], "id string, text string")
    assert retrieval.bm25(d, " *? ").collect() == []


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, item_id string, rank int")
    good = spark.createDataFrame([("q", "y"), ("q", "z"), ("r", "a")], "query_id string, item_id string")
    got = {r["query_id"]: r for r in metrics.retrieval_metrics(ranked, good, 5).collect()}
    assert (got["q"]["mrr"], got["q"]["precision"], got["q"]["recall"], got["r"]["mrr"]) == (0.5, 0.5, 0.5, 0.0)
    assert metrics.token_f1("the cat sat", "a cat ran") == 0.5
    assert metrics.rouge_l("a b c d", "x b d") == pytest.approx(4 / 6)


# graph


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame([(x, x.upper(), "T", "d") for x in "abcdef"], "id string, name string, entity_class string, domain string")
    r = spark.createDataFrame(
        [("a", "b", "R"), ("b", "c", "R"), ("c", "d", "R"), ("a", "d", "S"), ("e", "e", "R")], "src_id string, dst_id string, rel_type string"
    )
    return e, r


def test_shortest_path(small):
    e, r = small
    assert graph.shortest_path(e, r, "a", "c").first()["path"] == ["a", "R", "b", "R", "c"]
    assert graph.shortest_path(e, r, "a", "f").collect() == []
    assert graph.shortest_path(e, r, "a", "a").first()["length"] == 0


def test_shortest_path_over_edges_alone(small):
    e, r = small
    assert graph.shortest_path(e.filter("id <> 'b'"), r, "a", "c").first()["path"] == ["a", "S", "d", "R", "c"]
    assert graph.shortest_path(None, r, "a", "c").first()["path"] == ["a", "R", "b", "R", "c"]
    assert graph.shortest_path(None, r, "a", "c", max_hops=1).collect() == []
    assert graph.shortest_path(None, r, "a", "f").collect() == []


@pytest.mark.parametrize(("goal_nation", "regions", "n"), [(1, (0, 1), 0), (0, (0, 1), 1), (0, (1,), 1)])
def test_shortest_path_query_as_its_sql(spark, tmp_path, goal_nation, regions, n):
    """a path of four hops is beyond the SQL, and nodes without a row of their own are not."""
    tables = {
        "region": ([(k, f"R{k}") for k in regions], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(0, "C0", 0)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(0, "S0", goal_nation)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(0, "P0", "T")], "p_partkey long, p_name string, p_type string"),
        "orders": ([(0, 0)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(0, 0, 0, 1.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"),
    }
    con = duckdb.connect()
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["g5_shortest_path"](spark, str(tmp_path)).collect()]
    assert got == con.execute(ORACLE_SQL["g5_shortest_path"]).fetchall() and len(got) == n


def test_all_paths_use_no_edge_twice(small):
    e, r = small
    assert [x["path"] for x in graph.all_paths(e, r, "a", "d").collect()] == [["a", "S", "d"], ["a", "R", "b", "R", "c", "R", "d"]]


def test_degree_counts_loops_once_and_keeps_nobody(small, spark):
    e, r = small
    none = spark.createDataFrame([], "chat_id string, entity_id string")
    got = {x["id"]: x["degree"] for x in graph.degrees(e, r, none, "d", top=10).collect()}
    assert got == {"a": 2, "b": 2, "c": 2, "d": 2, "e": 1, "f": 0}


# documents, ledger, refinement


def test_chunks_have_spans_breadcrumbs_and_stable_hashes():
    text = "intro\n\n# A\nalpha\n\n## B\n" + "word " * 60 + "\n\n# C\n| x | y |\n|---|---|\n" + "| 1 | 2 |\n" * 20
    got = chunking.chunk_markdown(text, 120)
    assert [c["seq"] for c in got] == list(range(len(got)))
    assert {c["header_path"] for c in got} == {"", "A", "A > B", "C"}
    for c in got:
        assert c["text"].endswith(text[c["char_start"] : c["char_end"]])
    tables = [c for c in got if c["header_path"] == "C"]
    assert len(tables) > 1 and all("|---|---|" in c["text"] for c in tables)
    assert [c["block_hash"] for c in got] == [c["block_hash"] for c in chunking.chunk_markdown(text, 120)]
    assert chunking.chunk_markdown(None) == [] and chunking.chunk_markdown(" \n") == []


def test_registered_chunks_cover_their_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for c in QUERIES["d1_chunking"](spark, DATA).collect():
        assert texts[c["doc_id"]][c["char_start"] : c["char_end"]] in c["text"] and len(c["text"]) <= 2000


def test_ledger_folds_in_order_and_forgets_a_source(spark):
    lg = spark.createDataFrame(
        [("e", "p", "d1", 0, "A"), ("e", "p", "d2", 1, "B"), ("e", "p", "d3", 2, "A")],
        "k string, property string, doc_id string, ord int, value string",
    )
    assert ledger.fold(lg, "k").first()["value"] == "A | B"
    assert ledger.fold(ledger.drop_source(lg, "d2"), "k").first()["value"] == "A"
    new = spark.createDataFrame([("e", "p", "d1", 0, "Z"), ("e", "p", "d9", 1, "Q")], lg.schema)
    assert ledger.fold(ledger.record(lg, new, "k"), "k").first()["value"] == "Z | B | A | Q"


def test_delta_tiers(spark):
    inc = spark.createDataFrame(
        [("a", "x", ["1"]), ("b", "x", ["1"]), ("c", "x", ["1"]), ("d", "x", [])], "logical_id string, domain string, blocks array<string>"
    )
    known = spark.createDataFrame([("a", "y", ["1"]), ("c", "x", ["1"]), ("d", "x", [])], inc.schema)
    assert rows(documents.classify_deltas(inc, known)) == [("a", "domain_changed"), ("b", "initial"), ("c", "metadata_only"), ("d", "content")]


def test_commit_tells_what_failed():
    def boom(_):
        raise RuntimeError("no")

    state, told = documents.commit({}, {"write": lambda s: {"n": 1}, "snapshot": boom})
    assert state == {"n": 1} and told["write"] == "ok" and told["snapshot"].startswith("failed")
    with pytest.raises(RuntimeError):
        documents.commit({}, {"write": boom})


NOTICES = {
    1: "# P\n\n## Supersession Notice\n\nThis document, effective 3 June 2024, supersedes **Complaints** Version 1.2 (Effective Date: 2020-05-01).\n\n---\nEffective Date: 1999-01-01\n",
    2: "| Effective Date | 1 July 2024 |\n| Supersedes | [[old policy#a]] |\n",
    3: "This supersedes Version 3. Effective 2024-01-01",
    4: "| Supersedes | Version 2.0, [[policy_x]] |\n\n## Supersession Notice\nSupersedes Version 2.0 (Effective Date 2026-01-15). Effective Date: 2026-03-01\n## Next\n",
    5: "| Supersedes | None |\n\n## Supersession Notice\nNothing.\n",
    6: None,
}


def test_notices_and_rows_are_both_read(spark):
    got = temporal.notices(spark.createDataFrame(list(NOTICES.items()), "id int, text string")).collect()
    want = [
        (1, "notice", "1.2", "2024-06-03"),
        (2, "table", "old policy", "2024-07-01"),
        (4, "notice", "2.0", "2026-03-01"),
        (4, "table", "policy_x", None),
    ]
    assert sorted((r["id"], r["kind"], r["target"], r["effective"]) for r in got) == want


def test_versions_name_one_document_or_none(spark):
    docs = [
        (1, "d", "a_v1.md", "1.0"),
        (2, "d", "a_v2.md", "2.0"),
        (3, "d", "b_v1.md", "1.0"),
        (4, "d", "c.md", "4.0"),
        (5, "e", "z.md", "9.0"),
        (6, "d", "a_v3.md", "1.0"),
        (7, "d", "y.md", None),
    ]
    said = [
        (2, "notice", "1.0"),
        (3, "notice", "1.0"),
        (4, "notice", "2.0"),
        (5, "notice", "4.0"),
        (4, "table", "A_V1"),
        (7, "table", "c"),
        (1, "notice", "7.7"),
        (1, "table", "b_v1"),
    ]
    d = spark.createDataFrame(docs, "id int, domain string, name string, version_number string")
    s = spark.createDataFrame([(*x, None) for x in said], "id int, kind string, target string, effective string")
    got = sorted((r["newer"], r["older"], r["kind"]) for r in temporal.resolve_versions(s, d).collect())
    # version 1.0 has two documents of a's stem besides 2, and none of b's besides 3
    assert got == [(1, 3, "table"), (4, 2, "notice"), (7, 4, "table")]


def test_temporal_settings_are_inherited():
    got = temporal.inherit(
        {"defaults": {"a": 1, "b": 2}, "document": {"l": ["x"]}, "entities": {"E": 1}, "anchor": "p"},
        {"defaults": {"b": 3}, "document": {"l": ["y", "x"]}, "anchor": "c"},
    )
    assert got == {"defaults": {"a": 1, "b": 3}, "document": {"l": ["x", "y"]}, "entities": {"E": 1}, "anchor": "c"}


def test_names_cluster_within_a_class_only(spark):
    names = [("Acme Corp", "ORG"), ("Acme Corp.", "ORG"), ("ACME Corp Ltd", "ORG"), ("Acme Corp", "PLACE"), ("Zebra", "ORG")]
    d = spark.createDataFrame(names, "name string, entity_class string")
    got = rows(refine.name_clusters(d, 0.7), "entity_class", "name")
    assert got == [("ORG", "ACME Corp Ltd"), ("ORG", "Acme Corp"), ("ORG", "Acme Corp.")]
    want = sorted((a, b) for a, ca in names for b, cb in names if ca == cb and a < b and ratio(a, b) >= 0.7)
    assert rows(refine.similar_names(d, 0.7), "a", "b") == want


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
def test_no_pair_of_similar_names_is_lost(spark, threshold):
    """Brute force: difflib over all pairs of a class."""
    import random

    rng = random.Random(4)
    names = {("A" if i % 2 else "B", "".join(rng.choice("aabcdeE  é") for _ in range(rng.randint(0, 9)))) for i in range(160)}
    names |= {("A", "cold widget"), ("A", "cold widgets"), ("A", "Cold Widget"), (None, "x"), (None, "xx")}
    d = spark.createDataFrame(sorted(names, key=str), "entity_class string, name string")
    got = {(r["entity_class"], r["a"], r["b"]): r["ratio"] for r in refine.similar_names(d, threshold).collect()}
    want = {}
    for kind, a in names:
        for other, b in names:
            if kind == other and a < b and a and b and ratio(a, b) >= threshold:
                want[kind or "", a, b] = ratio(a, b)
    assert got == want


def test_conflict_blocks_change_nothing(spark, monkeypatch):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    ents = e.select(
        "vec_id",
        F.col("vec_id").alias("id"),
        F.lit("same").alias("name"),
        F.col("label").cast("string").alias("entity_class"),
        F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string")).alias("domain"),
        "embedding",
    )
    one = refine.conflict_candidates(ents, ["d0", "d1", "d2"], 0.6, max_pairs=500).collect()
    monkeypatch.setattr(refine, "BLOCK", 7)
    many = refine.conflict_candidates(ents, ["d0", "d1", "d2"], 0.6, max_pairs=500).collect()
    assert [r[:2] for r in one] == [r[:2] for r in many] and len(one) > 50
    assert [r["similarity"] for r in one] == pytest.approx([r["similarity"] for r in many])
    assert refine.conflict_candidates(ents.limit(0), ["d0"], 0.6).collect() == []


def test_conflict_ids_know_no_order(spark):
    d = spark.createDataFrame([("x", "y")], "a string, b string")
    i = lambda p, q, aspect: d.select(refine.conflict_id(F.col(p), F.col(q), F.lit(aspect))).first()[0]
    assert i("a", "b", "Interest Rate") == i("b", "a", "interest-rate!") != i("a", "b", "fee")


def test_verdicts_default():
    assert refine.verdict("junk")["verdict"] == "unrelated"
    assert refine.verdict('{"verdict": "Conflicting", "severity": "HIGH"}')["severity"] == "high"


def test_merges_are_checked(spark):
    e = spark.createDataFrame(
        [("a", "P", "d1"), ("b", "P", "d1"), ("c", "Q", "d1"), ("z", "P", "d2")], "name string, entity_class string, domain string"
    )
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("a", "z")], "alias string, canonical string")
    assert [r["skip"] for r in refine.mergeable(p, e).orderBy("canonical").collect()] == ["self", None, "cross_class", "cross_domain"]


def test_refinement_runs_in_order():
    seen = []
    steps = {s: (lambda d, a, s=s: seen.append((s, tuple(d), a))) for s in refine.PIPELINE}
    refine.run_pipeline(["x", "y"], steps)
    assert [s for s, _, _ in seen] == ["time", "supersession", "merge", "conflicts", "conflicts", "conflicts", "consolidate", "embed"]
    assert not any(a for _, _, a in seen)


# fusion and guards


def test_key_resolution(spark):
    v = lambda *x: spark.createDataFrame([(i,) for i in x], "value string")
    got = fusion.resolve_key("Loan", v("loan", "Loans", "Zebra"), v("LOAN", "Lion"), 5).collect()
    assert [(r["value"], r["source"], round(r["score"], 3)) for r in got] == [
        ("loan", "both", 1.0), ("Loans", "graph", 0.889), ("Lion", "column", 0.75)
    ]
    assert len(fusion.resolve_key("Loan", v("loan", "Loans"), v(), 1).collect()) == 1
    with pytest.raises(ValueError):
        fusion.resolve_key("x", v("x"), v("x"), 0)


def test_registered_key_resolution(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet").collect()
    scores = {}
    for r in part:
        for v in (r["p_name"], r["p_type"]):
            scores[v.lower()] = ratio("cold widgets", v)
    want = sorted((s for s in scores.values() if s >= 0.6), reverse=True)[:10]
    assert [r["score"] for r in QUERIES["f2_resolve_key"](spark, DATA).collect()] == pytest.approx(want)


def test_classification_drops_what_is_made_up():
    answer = '{"grain": "odd", "mappings": [{"column": "a", "entity_class": "X", "confidence": 0.9}, {"column": "zz", "entity_class": "X", "confidence": 1}, {"column": "b", "entity_class": "X", "confidence": 0.1}], "bridges": [{"column": "b", "confidence": 0.5}]}'
    got = fusion.classify_columns(answer, ["a", "b"], ["X"])
    assert got["grain"] is None and [m["column"] for m in got["mappings"]] == ["a"] and got["bridges"] == ["b"]
    assert fusion.classify_columns(answer, ["a", "b"], ["X"], {("a", "X")})["mappings"] == []


def test_placement_is_clamped():
    got = fusion.placement(
        '{"domain": {"value": "a", "confidence": 7}, "area": {"value": "b", "confidence": 0.2}, "tags": ["1","2","3","4","5","6"]}', {"domain": {"a"}}
    )
    assert got["domain"] == {"value": "a", "confidence": 1.0, "known": True} and got["area"]["confidence"] == 0.0 and len(got["tags"]) == 5


def test_normative_tables_keep_history():
    fusion.check_grain("normative", False, "replace")
    with pytest.raises(ValueError):
        fusion.check_grain("normative", True, "replace")


def test_guards(spark):
    assert guard.looks_read_only("select 1") and not guard.looks_read_only("drop table x") and not guard.looks_read_only("select 'set'")
    guard.check_read_only(spark, "select 'set' as load")


@pytest.mark.parametrize(("sql", "good"), steps.STATEMENTS)
def test_statements_read_given_views_only(spark, sql, good):
    views = {"v": spark.range(5), "parts": spark.range(2)}
    if good:
        assert guard.run_sql(spark, sql, views).collect() is not None
    else:
        with pytest.raises(PermissionError):
            guard.run_sql(spark, sql, views)


def test_files_cannot_be_read_by_path_even_unguarded(spark):
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND|UNSUPPORTED|not found"):
        guard.isolated(spark, {}).sql("select * from text.`/etc/hostname`").collect()


def test_views_out_of_scope_are_unreachable(spark):
    spark.range(3).createOrReplaceTempView("hidden")
    assert guard.run_sql(spark, "select count(*) as n from t", {"t": spark.range(5)}).first()["n"] == 5
    with pytest.raises(Exception, match="hidden"):
        guard.run_sql(spark, "select * from hidden", {"t": spark.range(5)})


FIRST_COLUMNS = """
from pyspark.sql import SparkSession, functions as F
from spanforge.plans import guard
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, n string, r int")
b = spark.createDataFrame([(1, "asia"), (2, "africa")], "rk int, rn string")
v = a.join(b, F.col("r") == F.col("rk")).select("k", F.concat_ws(".", "rn", "n").alias("domain"))
sql = "select k from v where exists(array('asia'), d -> startswith(domain, concat(d, '.')))"
print("found", [r["k"] for r in guard.run_sql(spark, sql, {"v": v}).collect()])
"""


def test_lambdas_over_the_first_columns_of_a_process():
    """in a process of its own, as columns are numbered from its start."""
    got = subprocess.run([sys.executable, "-c", FIRST_COLUMNS], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "found [1]" in got.stdout, got.stderr[-2000:]


def test_asof_joins_written_as_such_are_refused():
    with pytest.raises(ValueError):
        guard.to_spark("select * from a asof join b on a.t >= b.t")


# sources, jobs, streams


def test_csv_types_and_headers(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden/x.csv").write_text("a\n1\n")
    (tmp_path / "t.csv").write_text("id,ok,day\n1,Yes,2024-01-02\n2,no,2024-01-03\n")
    (tmp_path / "bad.csv").write_text("a,,c\n1,2,3\n")
    assert dict(files.read_csv(spark, f"{tmp_path}/t.csv").dtypes) == {"id": "bigint", "ok": "boolean", "day": "date"}
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/bad.csv")
    found = files.discover(spark, str(tmp_path), content=True)
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["bad.csv", "t.csv"]
    assert files.load_table(spark, f"{tmp_path}/t.csv", f"{tmp_path}/out/t") == 2
    assert files.source_tables("/x/My Book.xlsx", ["One", "Two"]) == {"my_book__one": "One", "my_book__two": "Two"}


def test_versions_can_be_refreshed_from_themselves(spark, tmp_path):
    root = f"{tmp_path}/t"
    store.write_version(spark.range(3), root)
    store.write_version(store.read_version(spark, root).unionAll(spark.range(2)), root)
    assert store.read_version(spark, root).count() == 5


def test_views_and_bundles_and_snapshots(spark, tmp_path):
    made = store.register_views(spark, {("a", "t"): spark.range(1), ("b", "t"): spark.range(2), ("b", "u"): spark.range(3)})
    assert made == ["a__t", "b__t", "b__u", "u"]
    store.write_bundle(f"{tmp_path}/g/doc", document=spark.createDataFrame([("1", "n")], "id string, name string"))
    got = store.read_bundle(spark, f"{tmp_path}/g/doc")
    assert got["document"].first()["logical_id"] is None and list(got) == ["document"]
    store.export_document(spark, f"{tmp_path}/g/doc", f"{tmp_path}/d.zip")
    assert store.import_document(spark, f"{tmp_path}/d.zip", f"{tmp_path}/back")
    nodes = {"Entity": spark.createDataFrame([("a",), ("b",)], "id string")}
    store.export_graph(f"{tmp_path}/root/graph", nodes, spark.createDataFrame([("a", "b"), ("a", "z")], "src_id string, dst_id string"))
    assert store.create_snapshot(spark, f"{tmp_path}/root", f"{tmp_path}/s.zip")["components"]["graph"]["files"] > 0
    assert store.analyze_snapshot(spark, f"{tmp_path}/s.zip", ("graph", "structured"))["missing"] == ["structured"]
    store.restore_snapshot(spark, f"{tmp_path}/s.zip", f"{tmp_path}/again")
    assert store.import_graph(spark, f"{tmp_path}/again/graph")[1].count() == 1
    with pytest.raises(FileExistsError):
        store.pull_bundles(spark, spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([("x",)], "name string"))


def test_jobs_fail_with_a_file_and_can_be_retried():
    def work(path, _):
        if path == "b":
            raise OSError("gone")
        return "ok"

    (job,) = jobs.run_jobs([{"id": 1, "created_at": 1, "files": [{"path": "a"}, {"path": "b"}]}], work)
    assert job["status"] == "failed" and [f["status"] for f in job["files"]] == ["ok", "failed"]
    assert [f["status"] for f in jobs.retry(job)["files"]] == ["ok", "pending"]


QUESTIONS = {
    "# Set\r\n\r\n## Q7 — Rates\r\n**Question:** What is\r\nthe rate?\r\n\r\n**Evaluation comment:** cites 3%\r\n\r\n## Notes\r\nnone\r\n## Fees\r\n**Question** Any fee?": [
        (1, "Q07", "Rates", "What is\nthe rate?", "cites 3%"), (2, "Q02", "Fees", "Any fee?", None)
    ],
    "intro\n**Question:** One?\n**Evaluation comment:** yes\n**question:** Two?": [(1, "Q01", None, "One?", "yes"), (2, "Q02", None, "Two?", None)],
    "# Alpha\nbody one\n\n# Empty\n\n# Q12: Beta\nbody two": [(1, "Q01", "Alpha", "body one", None), (2, "Q12", "Beta", "body two", None)],
    "1. One?\n- Why?\nnot this\n  * 2. Two?  \n": [(1, "Q01", None, "One?", None), (2, "Q02", None, "Why?", None), (3, "Q03", None, "Two?", None)],
    "": [],
    "nothing asked\n": [],
}


@pytest.mark.parametrize("text", QUESTIONS)
def test_question_files(text):
    got = jobs.parse_questions(text)
    assert [(q["seq"], q["qid"], q["title"], q["question"], q["eval_comment"]) for q in got] == QUESTIONS[text]


def test_schema_prompts():
    entities = jobs.parse_entities(steps.PROMPTS["entities_prompt"])
    assert entities == [
        {"class": "LOAN", "description": "Money lent to somebody.", "types": ["fixed loan", "open loan"]},
        {"class": "BRANCH", "description": "A place.", "types": []},
    ]
    properties = jobs.parse_properties(steps.PROMPTS["properties_prompt"])
    assert properties == {
        "LOAN": [{"name": "rate", "hint": "e.g., 3%"}, {"name": "term", "hint": ""}], "BRANCH": [{"name": "opening hours", "hint": ""}]
    }
    assert jobs.parse_relationships(steps.PROMPTS["relationships_prompt"]) == [
        {"a": "LOAN", "b": "BRANCH", "types": ["given_by", "paid_at", "kept_at"]}
    ]
    assert jobs.parse_entities("LOAN: money") == [] == jobs.parse_relationships("A ↔ B:\n  x")
    assert jobs.parse_properties("") == {}


def test_schemas_are_harmonised_once():
    parent = {"entity_types": ["PERSON", "LOAN", "BRANCH"], **steps.PROMPTS}
    rule = "━" * 9
    child = {
        "entity_types": ["PERSON"],
        "entities_prompt": f"{rule}\nENTITY TYPES YOU MUST EXTRACT:\n{rule}\n\nPERSON\n  Somebody.\n\n{rule}\nEXTRACTION RULES:\n{rule}\n1. No.\n",
        "relationships_prompt": "no rules here",
    }
    new, added = jobs.harmonise(child, parent)
    assert added == ["BRANCH", "LOAN"] and new["entity_types"] == ["BRANCH", "LOAN", "PERSON"] and "properties_prompt" not in new
    assert [e["class"] for e in jobs.parse_entities(new["entities_prompt"])] == ["PERSON", "BRANCH", "LOAN"]
    assert new["entities_prompt"].count("EXTRACTION RULES:") == 1 and new["entities_prompt"].endswith(f"{rule}\n1. No.\n")
    assert new["relationships_prompt"] == "no rules here\n\n\n\nLOAN ↔ BRANCH:\n  given_by, paid_at,\n  kept_at"
    assert jobs.harmonise(new, parent) == (new, [])


def test_profile_kinds(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", None)], "n int, s string, z string")
    got = {r["column"]: r for r in metadata.profile(d).collect()}
    assert (got["n"]["kind"], got["n"]["min"], got["n"]["max"]) == ("numeric", 1.0, 2.0)
    assert (got["s"]["kind"], got["s"]["sample"], got["z"]["null_rate"], got["z"]["cardinality"]) == ("categorical", ["a", "b"], 1.0, 0)
    many = spark.range(300).select(F.col("id").cast("string").alias("s"))
    assert metadata.profile(many).first()["kind"] == "other"
    assert metadata.profile(many.limit(0)).first()["null_rate"] == 0.0


def test_a_stream_refreshes_a_table(spark, tmp_path):
    src = f"{tmp_path}/in"
    ev = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_type")
    for i in range(2):
        ev.filter(F.col("user_id") % 2 == i).write.mode("append").parquet(src)
    seen = []
    incremental.each_batch(incremental.read_events(spark, src, ev.schema, 1), lambda df, i: seen.append(df.count()), f"{tmp_path}/cp")
    assert sum(seen) == ev.count() and len(seen) > 1


def test_late_rows_are_left_out_of_stream_windows(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS ts, 'a' AS event_type, 1.0D AS value").write.parquet(src)
    stream = incremental.windowed(incremental.read_events(spark, src, "ts timestamp, event_type string, value double"), "1 hour", late="10 minutes")
    q = stream.writeStream.format("memory").queryName("late").outputMode("complete").option(
        "checkpointLocation", f"{tmp_path}/cp"
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("late").first()["n"] == 1


# registered queries over whole tables


def test_components_are_those_of_all_orders(spark):
    orders = {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r["l_orderkey"], set()).add(r["l_partkey"])
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for parts in orders.values():
        if len(parts) > 1:
            for p in parts:
                a, b = find(min(parts)), find(p)
                label[max(a, b)] = min(a, b)
    assert rows(QUERIES["c1_components"](spark, DATA), "node", "component") == sorted((i, find(i)) for i in label)


def test_components_of_few_orders(spark, tmp_path):
    lines = [(1, 5), (1, 9), (2, 9), (2, 7), (3, 4), (3, 3), (3, 4), (41, 8), (41, 8), (40, 3), (40, 2), (40, 6), (81, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(QUERIES["c1_components"](spark, str(tmp_path)), "node", "component")
    assert got == [(2, 2), (3, 2), (4, 2), (5, 5), (6, 2), (7, 5), (9, 5)]


#: Parts of the registered SQL that leave rows out.
SUBSETS = {
    "q_unpivot": " WHERE l_orderkey % 50 = 0",
    "q_lateral_alias": " WHERE l_linenumber = 1 AND l_orderkey % 10 = 0",
    "d9_edge_union": " WHERE l_linenumber <= 2",
    "d10_retract": " WHERE l_linenumber <= 2",
    "g12_chunk_window": "WHERE m.seq % 5 = 0",
}


@pytest.mark.parametrize("name", sorted(SUBSETS))
def test_query_takes_the_whole_table(name, spark, same):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name].replace(SUBSETS[name], ""))


def test_edges_and_windows_by_brute_force(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").collect()
    want = {}
    for s, p, o, n in lines:
        for ends in [(f"s{s}", f"p{p}"), (f"p{p}", f"s{s}")][: 2 if n == 1 else 1]:
            want.setdefault(ends, set()).add(f"d{o % 20}")
    listed = lambda d: sorted((*k, ",".join(sorted(v))) for k, v in d.items() if v)
    assert rows(QUERIES["d9_edge_union"](spark, DATA), "src_id", "dst_id", "doc_ids") == listed(want)
    assert rows(QUERIES["d10_retract"](spark, DATA), "src_id", "dst_id", "doc_ids") == listed({k: v - {"d7"} for k, v in want.items()})
    assert QUERIES["q_unpivot"](spark, DATA).count() == 2 * len(lines) and QUERIES["q_lateral_alias"](spark, DATA).count() == len(lines)


def test_every_domain_has_a_view_name(spark, tmp_path):
    docs = [(i, "x", f"l-{i % 3}", f"src{i}") for i in range(2500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted({(store.view_name(f"{lang}.{source}", "documents"),) for _, _, lang, source in docs})
    assert len(want) == 2500 and rows(QUERIES["a9_view_names"](spark, str(tmp_path))) == want
