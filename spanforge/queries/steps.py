"""Operators that work on short lists at the driver: one fixed case each, as rows."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.predicates import validate
from ..operators import documents, fusion, jobs, refine, temporal
from ..plans.catalog import query, table
from ..plans.guard import isolated, run_sql
from ..plans.scratch import Scratch
from ..sources import files, store
from ..sources.shared import SharedFiles


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


@query(
    "a5_source_tables",
    "SELECT * FROM (VALUES ('my_book__one', 'One'), ('my_book__two_b', 'Two B'), ('t_2024_rates', 'Only'), ('prices', NULL)) t(name, sheet)",
)
def a5(spark, sf):
    found = files.source_tables(
        "/x/My Book.xlsx", ["One", "Two B"]
    ) | files.source_tables("2024-rates.xlsm", ["Only"]) | files.source_tables("a/Prices.csv")
    return rows(spark, "name string, sheet string", *found.items())


@query("a6_header_check", "SELECT * FROM (VALUES ('a,b', true), ('a,,c', false), ('a, ', false)) t(header, good)")
def a6(spark, sf):
    def good(header):
        try:
            files.check_header(header.split(","))
        except ValueError:
            return False
        return True

    return rows(spark, "header string, good boolean", *((h, good(h)) for h in ("a,b", "a,,c", "a, ")))


@query("b15_parameters", "SELECT * FROM (VALUES ('pattern5', true), ('pattern6', false), ('pattern9', false)) t(pattern, good)")
def b15(spark, sf):
    def good(pattern, given, needed):
        try:
            validate(pattern, given, needed)
        except ValueError:
            return False
        return True

    cases = [
        ("pattern5", {"source_id": "x", "target": "y", "mode": "all"}, {"source": ("source_id",), "target": ()}),
        ("pattern6", {"source": "x"}, {"source": (), "target": ()}),
        ("pattern9", {"degree_mode": "some"}, {}),
    ]
    return rows(spark, "pattern string, good boolean", *((c[0], good(*c)) for c in cases))


@query(
    "f3_classification",
    "SELECT * FROM (VALUES ('segment', 'CUSTOMER', 0.9, 'instance', 'name')) t(\"column\", entity_class, confidence, grain, bridges)".replace("0.9", "0.9::DOUBLE"),
)
def f3(spark, sf):
    answer = {
        "grain": "instance",
        "mappings": [
            {"column": "segment", "entity_class": "CUSTOMER", "confidence": 0.9},
            {"column": "ghost", "entity_class": "CUSTOMER", "confidence": 1},
            {"column": "name", "entity_class": "CUSTOMER", "confidence": 0.3},
        ],
        "bridges": [{"column": "name", "confidence": 0.4}],
    }
    got, _ = fusion.classify_table("", lambda _: json.dumps(answer), ["segment", "name"], ["CUSTOMER"])
    return rows(
        spark,
        "column string, entity_class string, confidence double, grain string, bridges string",
        *((m["column"], m["entity_class"], m["confidence"], got["grain"], ",".join(got["bridges"])) for m in got["mappings"]),
    )


@query(
    "f5_grain_rule",
    "SELECT * FROM (VALUES ('normative', true, 'replace', false), ('normative', true, 'temporal', true), ('normative', false, "
        "'replace', true), ('lookup', true, 'replace', true)) t(grain, confirmed, mode, good)",
)
def f5(spark, sf):
    def good(*case):
        try:
            fusion.check_grain(*case)
        except ValueError:
            return False
        return True

    cases = [("normative", True, "replace"), ("normative", True, "temporal"), ("normative", False, "replace"), ("lookup", True, "replace")]
    return rows(spark, "grain string, confirmed boolean, mode string, good boolean", *((*c, good(*c)) for c in cases))


@query(
    "f7_placement",
    "SELECT * FROM (VALUES ('domain', 'bank', 1.0::DOUBLE, true), ('area', 'ops', 0.0, false), ('tags', 'x', 0.5, false)) t(field, value, confidence, known)",
)
def f7(spark, sf):
    got = fusion.placement(
        json.dumps(
            {"domain": {"value": "bank", "confidence": 3}, "area": {"value": "ops", "confidence": 0.39}, "tags": [{"value": "x", "confidence": 0.5}]}
        ),
        {"domain": {"bank"}},
    )
    found = [("domain", got["domain"]), ("area", got["area"]), *(("tags", t) for t in got["tags"])]
    return rows(
        spark, "field string, value string, confidence double, known boolean", *((f, x["value"], x["confidence"], x["known"]) for f, x in found)
    )


@query("f9_bulk_classification", "SELECT * FROM (VALUES ('a', 'ok', false), ('b', 'ok', true), ('c', 'failed', true)) t(name, status, ran)")
def f9(spark, sf):
    ran = set()

    def run(t):
        ran.add(t["name"])
        return "failed" if t["name"] == "c" else "ok"

    out = fusion.classify_all([{"name": "a", "status": "ok"}, {"name": "b", "status": "failed"}, {"name": "c"}], run)
    return rows(spark, "name string, status string, ran boolean", *((t["name"], t["status"], t["name"] in ran) for t in out))


@query(
    "t8_inheritance",
    "SELECT * FROM (VALUES ('anchor', 'child'), ('defaults.from', 'child'), ('defaults.to', 'parent'), ('document.date', 'x,y,z')) t(setting, value)",
)
def t8(spark, sf):
    got = temporal.inherit(
        {"anchor": "parent", "defaults": {"from": "parent", "to": "parent"}, "document": {"date": ["x", "y"]}},
        {"anchor": "child", "defaults": {"from": "child"}, "document": {"date": ["y", "z"]}},
    )
    return rows(
        spark,
        "setting string, value string",
        ("anchor", got["anchor"]),
        ("defaults.from", got["defaults"]["from"]),
        ("defaults.to", got["defaults"]["to"]),
        ("document.date", ",".join(got["document"]["date"])),
    )


@query(
    "d16_commit",
    "SELECT * FROM (VALUES (1, 'retract', 'ok'), (2, 'capture', 'skipped'), (3, 'write', 'ok'), (4, 'normalise', 'failed: "
        "late'), (5, 'supersede', 'skipped'), (6, 'snapshot', 'ok'), (7, 'reassert', 'skipped')) t(seq, step, status)",
)
def d16(spark, sf):
    def late(_):
        raise TimeoutError("late")

    same = lambda state: {}
    _, told = documents.commit({}, {"retract": same, "write": same, "normalise": late, "snapshot": same})
    return rows(spark, "seq int, step string, status string", *((i + 1, s, told[s]) for i, s in enumerate(documents.STEPS)))


@query(
    "c11_pipeline",
    "SELECT * FROM (VALUES (1, 'time', 'a,b'), (2, 'merge', 'a,b'), (3, 'conflicts', 'a'), (4, 'conflicts', 'b'), (5, "
        "'conflicts', 'a,b'), (6, 'embed', 'a,b')) t(seq, step, domains)",
)
def c11(spark, sf):
    seen = []

    def step(name):
        return lambda domains, apply: seen.append((name, ",".join(domains)))

    refine.run_pipeline(["a", "b"], {s: step(s) for s in ("embed", "merge", "time", "conflicts")})
    return rows(spark, "seq int, step string, domains string", *((i + 1, *s) for i, s in enumerate(seen)))


_RULE = "━" * 20
PROMPTS = {
    "entities_prompt": f"Extract.\n\n{_RULE}\nENTITY TYPES YOU MUST EXTRACT:\n{_RULE}\nUse ONLY these entity_classes.\n\nLOAN\n  Money lent\n  to somebody.\n  example type values: fixed loan | open loan\n\nBRANCH\n  A place.\n\n{_RULE}\nEXTRACTION RULES:\n{_RULE}\n1. Do not invent.\n",
    "properties_prompt": f"Enrich.\n\nFor LOAN, consider:\n  - rate (e.g., 3%)\n  - term\n\nFor BRANCH, consider:\n  - opening hours\n\n{_RULE}\nKEY RULES FOR PROPERTIES:\n{_RULE}\n- Do not invent.\n",
    "relationships_prompt": f"Identify.\n\n{_RULE}\nCOMMON rel_type VALUES:\n{_RULE}\n\nLOAN ↔ BRANCH:\n  given_by, paid_at,\n  kept_at\n\n{_RULE}\nEXTRACTION RULES:\n{_RULE}\n",
}


@query(
    "h1_harmonise", "SELECT * FROM (VALUES ('BRANCH', true, true), ('LOAN', true, true), ('PERSON', false, true)) t(entity_type, added, in_prompt)"
)
def h1(spark, sf):
    own = PROMPTS["entities_prompt"].replace("LOAN", "PERSON").replace("BRANCH\n  A place.\n\n", "")
    child, added = jobs.harmonise({"entity_types": ["PERSON"], "entities_prompt": own}, {"entity_types": ["PERSON", "LOAN", "BRANCH"], **PROMPTS})
    told = {e["class"] for e in jobs.parse_entities(child["entities_prompt"])}
    return rows(spark, "entity_type string, added boolean, in_prompt boolean", *((t, t in added, t in told) for t in child["entity_types"]))


@query("h2_schema_prompts", """SELECT * FROM (VALUES ('entity', 'LOAN', 'fixed loan|open loan'), ('entity', 'BRANCH', ''), ('property', 'LOAN.rate', 'e.g., 3%'), ('property', 'LOAN.term', ''),
  ('property', 'BRANCH.opening hours', ''), ('relationship', 'LOAN BRANCH', 'given_by|paid_at|kept_at')) t(kind, name, value)""")
def h2(spark, sf):
    found = [("entity", e["class"], "|".join(e["types"])) for e in jobs.parse_entities(PROMPTS["entities_prompt"])]
    found += [("property", f"{k}.{p['name']}", p["hint"]) for k, ps in jobs.parse_properties(PROMPTS["properties_prompt"]).items() for p in ps]
    found += [("relationship", f"{r['a']} {r['b']}", "|".join(r["types"])) for r in jobs.parse_relationships(PROMPTS["relationships_prompt"])]
    return rows(spark, "kind string, name string, value string", *found)


@query("h3_job_queue", "SELECT * FROM (VALUES ('j1', 'done', 'ok,ok'), ('j2', 'failed', 'failed,ok')) t(id, status, files)")
def h3(spark, sf):
    def work(path, _):
        if path == "bad":
            raise OSError("gone")
        return "ok"

    out = jobs.run_jobs(
        [
            {"id": "j2", "created_at": 2, "files": [{"path": "bad"}, {"path": "b"}]},
            {"id": "j1", "created_at": 1, "files": [{"path": "a"}, {"path": "c", "status": "ok"}]},
        ],
        work,
    )
    return rows(spark, "id string, status string, files string", *((j["id"], j["status"], ",".join(f["status"] for f in j["files"])) for j in out))


QUESTION_FILES = (
    "# Set\n\n## Q7 — Rates\n**Question:** What is the rate?\n\n**Evaluation comment:** cites 3%\n\n## Fees\n**Question:** Any fee?\n",
    "**Question:** One?\n**Evaluation comment:** yes\n**Question:** Two?",
    "# Alpha\nbody one\n\n# Q12: Beta\nbody two",
    "1. One?\n- Why?\nnot this\n",
)


@query("h4_question_files", """SELECT * FROM (VALUES (1, 1, 'Q07', 'Rates', 'What is the rate?', 'cites 3%'), (1, 2, 'Q02', 'Fees', 'Any fee?', NULL), (2, 1, 'Q01', NULL, 'One?', 'yes'), (2, 2, 'Q02', NULL, 'Two?', NULL),
  (3, 1, 'Q01', 'Alpha', 'body one', NULL), (3, 2, 'Q12', 'Beta', 'body two', NULL), (4, 1, 'Q01', NULL, 'One?', NULL), (4, 2, 'Q02', NULL, 'Why?', NULL)) t(file, seq, qid, title, question, eval_comment)""")
def h4(spark, sf):
    got = [(i, q) for i, text in enumerate(QUESTION_FILES, 1) for q in jobs.parse_questions(text)]
    return rows(
        spark,
        "file int, seq int, qid string, title string, question string, eval_comment string",
        *((i, q["seq"], q["qid"], q["title"], q["question"], q["eval_comment"]) for i, q in got),
    )


#: Statements over the views v and parts, and whether the guard lets them by.
STATEMENTS = (
    ("SELECT count(*) AS n FROM v", True),
    ("WITH w AS (SELECT id FROM v) SELECT * FROM w JOIN parts USING (id)", True),
    ("SELECT (SELECT max(id) FROM v) AS m", True),
    ("SELECT id FROM v WHERE EXISTS (SELECT 1 FROM parts x WHERE x.id = v.id)", True),
    ("SELECT upper('drop table v') AS t", True),
    ("SELECT id, row_number() OVER (ORDER BY id DESC) AS k FROM range(3)", True),
    ("SELECT * FROM hidden", False),
    ("SELECT * FROM other.v", False),
    ("SELECT * FROM parquet.`/tmp/x`", False),
    ("SELECT * FROM text.`/etc/hostname`", False),
    ("SELECT (SELECT count(*) FROM text.`/etc/hostname`) AS n", False),
    ("WITH w AS (SELECT * FROM csv.`/etc/passwd`) SELECT 1 AS one", False),
    ("SELECT id FROM v WHERE id IN (SELECT value FROM text.`/etc/hostname`)", False),
    ("SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", False),
    ("SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS home", False),
    ("SELECT id FROM v ORDER BY reflect('java.lang.Math', 'random')", False),
    ("SELECT try_reflect('java.lang.System', 'gc') AS x FROM (SELECT id FROM v)", False),
    ("SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home') AS home", False),
    ("SELECT input_file_name() AS f FROM v", False),
    ("SELECT TRANSFORM (id) USING 'cat' AS (x) FROM v", False),
    ("SELECT * FROM sql_keywords()", False),
    ("SHOW TABLES", False),
    ("DESCRIBE v", False),
    ("EXPLAIN SELECT 1", False),
    ("DROP TABLE v", False),
    ("INSERT INTO v VALUES (1)", False),
    ("CREATE VIEW w AS SELECT 1 AS one", False),
    ("SET a = 1", False),
    ("CACHE TABLE v", False),
    ("TRUNCATE TABLE v", False),
    ("EXECUTE IMMEDIATE 'SELECT 1'", False),
)


def _let_by(spark, sql):
    try:
        run_sql(spark, sql, {"v": spark.range(5), "parts": spark.range(2)})
    except PermissionError:
        return False
    return True


def _values(statements):
    return ", ".join(f"('{sql.replace(chr(39), chr(39) * 2)}', {str(good).lower()})" for sql, good in statements)


@query("b14_read_only", f"SELECT * FROM (VALUES {_values(STATEMENTS)}) t(statement, let_by)")
def b14(spark, sf):
    return rows(spark, "statement string, let_by boolean", *((sql, _let_by(spark, sql)) for sql, _ in STATEMENTS))


@query("a11_isolated_views", "SELECT * FROM (VALUES ('given', 5), ('outside', NULL), ('outside, as a file', NULL)) t(\"view\", n)")
def a11(spark, sf):
    """What a query sees of the caller's session: the views handed in, under their names, and nothing else."""
    spark.range(9).createOrReplaceTempView("outside")
    found = []
    for name, source in (("given", "given"), ("outside", "outside"), ("outside, as a file", f"parquet.`{sf}/region.parquet`")):
        try:
            found.append((name, isolated(spark, {"given": spark.range(5)}).sql(f"SELECT count(*) AS n FROM {source}").first()["n"]))
        except AnalysisException:
            found.append((name, None))
    spark.catalog.dropTempView("outside")
    return rows(spark, "view string, n int", *found)


def _root(spark, label):
    return Scratch(spark, label).root


@query("a1_discovery", "SELECT * FROM (VALUES ('a.csv', 4, true), ('b/notes.md', 3, false), ('b/rates.XLSX', 2, true)) t(path, length, structured)")
def a1(spark, sf):
    root, store_ = _root(spark, "a1"), SharedFiles(spark)
    for name, text in {"b/notes.md": "hey", "a.csv": "x\n1\n", ".git/x.csv": "x", "b/.y.csv": "x", "b/rates.XLSX": "PK"}.items():
        store_.write_text(f"{root}/{name}", text)
    found = files.discover(spark, root)
    return found.select(
        F.regexp_replace("path", f"^.*{root.rsplit('/', 1)[-1]}/", "").alias("path"), F.col("length").cast("int").alias("length"), "structured"
    )


@query(
    "a3_csv_table",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, c_custkey % 2 = 0 AS even, "
        "CAST(DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS DATE) AS day FROM customer",
)
def a3(spark, sf):
    """The customers written as CSV files, loaded as a typed table, and read again."""
    root = _root(spark, "a3")
    c = table(spark, sf, "customer").withColumns(
        {
            "even": F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("no"),
            "day": F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("c_custkey") % 300).cast("int")),
        }
    )
    c.write.option("header", True).csv(f"{root}/customers.csv")
    files.load_table(spark, f"{root}/customers.csv", f"{root}/table")
    return spark.read.parquet(f"{root}/table")


@query(
    "a4_sheet",
    "SELECT * FROM (VALUES (1, 'north', 0.5::DOUBLE, DATE '2024-02-29', true), (2, NULL, 2.0, DATE '1999-12-31', false)) t(id, "
        "place, rate, day, open)".replace("(1, 'n", "(1::BIGINT, 'n"),
)
def a4(spark, sf):
    root = _root(spark, "a4")
    SharedFiles(spark).write_bytes(f"{root}/rates.xlsx", small_workbook())
    assert files.sheets(spark, f"{root}/rates.xlsx") == ["Rates", "Other"]
    return files.read_sheet(spark, f"{root}/rates.xlsx", "Rates", header_row=1)


def small_workbook() -> bytes:
    """A workbook of three sheets, one of them hidden and one empty, whose first row is a title."""
    main, links = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = [
        '<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row>',
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c><c r="D2" t="s"><v>3</v></c><c r="E2" t="s"><v>4</v></c></row>',
        '<row r="3"><c r="A3"><v>1</v></c><c r="B3" t="s"><v>5</v></c><c r="C3"><f>1/2</f><v>0.5</v></c><c r="D3" '
            's="1"><v>45351</v></c><c r="E3" t="b"><v>1</v></c></row>',
        '<row r="5"><c r="A5"><v>2</v></c><c r="C5"><v>2</v></c><c r="D5" s="1"><v>36525</v></c><c r="E5" t="b"><v>0</v></c></row>',
    ]
    sheet = lambda rows: f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>'
    strings = "".join(f"<si><t>{x}</t></si>" for x in ("id", "place", "rate", "day", "open", "north"))
    listed = (("Rates", "visible"), ("Secret", "hidden"), ("Empty", "visible"), ("Other", "visible"))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i}" state="{v}" r:id="r{i}"/>' for i, (n, v) in enumerate(listed, 1)
        ) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, 5)
        ) + "</Relationships>",
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{strings}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet(cells),
        "xl/worksheets/sheet2.xml": sheet(cells),
        "xl/worksheets/sheet3.xml": sheet([]),
        "xl/worksheets/sheet4.xml": sheet(cells[:1]),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@query(
    "a8_staging",
    "SELECT 'staged' AS \"table\", count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'F' UNION ALL "
        "SELECT 'target', count(*), max(o_totalprice) FROM orders WHERE o_orderstatus = 'O'",
)
def a8(spark, sf):
    """A batch staged from a file beside its target, which stays as it was."""
    scratch, o = Scratch(spark, "a8"), table(spark, sf, "orders")
    o.filter("o_orderstatus = 'O'").write.parquet(f"{scratch.root}/target")
    o.filter("o_orderstatus = 'F'").write.option("header", True).csv(f"{scratch.root}/batch.csv")
    staged = files.stage(spark, f"{scratch.root}/batch.csv", scratch)
    total = lambda df, name: df.agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("most")
    ).select(F.lit(name).alias("table"), "n", "most")
    return total(staged, "staged").unionByName(total(spark.read.parquet(f"{scratch.root}/target"), "target"))


def _bundle(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    document = d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("lang").alias("domain"))
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return {"document": document, "chunks": chunks}


BUNDLE_SQL = "SELECT CAST(doc_id AS VARCHAR) AS id, 'doc' || doc_id AS name, lang AS domain, NULL::VARCHAR AS logical_id, NULL::INTEGER AS version, length(text) AS n FROM documents WHERE text IS NOT NULL"


def _read_bundle(spark, root):
    got = store.read_bundle(spark, root)
    return got["document"].join(
        got["chunks"].select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")), "id"
    ).select("id", "name", "domain", "logical_id", "version", "n")


@query("a16_bundle", BUNDLE_SQL)
def a16(spark, sf):
    """All documents as a bundle of JSON files, read again; fields that it lacks are null."""
    root = _root(spark, "a16")
    store.write_bundle(root, **_bundle(spark, sf))
    return _read_bundle(spark, root)


@query("a22_portable_document", BUNDLE_SQL)
def a22(spark, sf):
    """The same through one portable file, which also has things that aren't taken over."""
    root = _root(spark, "a22")
    store.write_bundle(f"{root}/staged", **_bundle(spark, sf))
    SharedFiles(spark).write_text(f"{root}/staged/other.txt", "x")
    store.export_document(spark, f"{root}/staged", f"{root}/one.zip")
    names = store.import_document(spark, f"{root}/one.zip", f"{root}/back")
    assert "other.txt" not in names and names
    return _read_bundle(spark, f"{root}/back")


@query("a17_pull", "SELECT * FROM (VALUES (1, 'a,b', 2), (2, 'clash: a', 3), (3, 'd', 4)) t(seq, pulled, n)")
def a17(spark, sf):
    """Folders of documents pulled from three sources; one name that is there stops a whole pull."""
    root, store_, told = _root(spark, "a17"), SharedFiles(spark), []
    for seq, names in enumerate(("ab", "ac", "d"), 1):
        for n in names:
            store_.write_text(f"{root}/source{seq}/{n}/document.json", "{}")
        if seq == 2:
            store_.write_text(f"{root}/target/own/document.json", "{}")
        try:
            pulled = ",".join(store.pull(spark, f"{root}/source{seq}", f"{root}/target"))
        except FileExistsError as e:
            pulled = f"clash: {e}"
        told.append((seq, pulled, len(store_.folders(f"{root}/target"))))
    return rows(spark, "seq int, pulled string, n int", *told)


@query(
    "a19_structured_snapshot",
    "SELECT 7 AS id, 'r1' AS domain, 'nation' AS \"table\", 'lookup' AS grain, count(*) AS n FROM nation UNION ALL SELECT 9, "
        "'r2', 'supplier', 'instance', count(*) FROM supplier",
)
def a19(spark, sf):
    """Tables and their registry out and in again; a field that the snapshot lacks gets its default, ids stay."""
    root = _root(spark, "a19")
    tables = {("r1", "nation"): table(spark, sf, "nation"), ("r2", "supplier"): table(spark, sf, "supplier")}
    store.export_tables(
        spark, root, tables, [{"id": 7, "domain": "r1", "name": "nation"}, {"id": 9, "domain": "r2", "name": "supplier", "grain": "instance"}]
    )
    back, registry = store.import_tables(spark, root, {"grain": "lookup"})
    return rows(
        spark,
        "id int, domain string, table string, grain string, n long",
        *((r["id"], r["domain"], r["name"], r["grain"], back[r["domain"], r["name"]].count()) for r in registry),
    )


@query("a20_snapshot", """SELECT 'nodes' AS part, count(*) AS n FROM part UNION ALL SELECT 'edges', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'missing components', 1""")
def a20(spark, sf):
    """A graph and a table in one archive, put back elsewhere."""
    root = _root(spark, "a20")
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).distinct()
    store.export_graph(f"{root}/live/graph", {"Entity": nodes}, edges)
    store.export_tables(spark, f"{root}/live/structured", {("r1", "nation"): table(spark, sf, "nation")}, [{"domain": "r1", "name": "nation"}])
    store.create_snapshot(spark, f"{root}/live", f"{root}/all.zip")
    told = store.analyze_snapshot(spark, f"{root}/all.zip", store.COMPONENTS)
    store.restore_snapshot(spark, f"{root}/all.zip", f"{root}/again")
    found, links = store.import_graph(spark, f"{root}/again/graph")
    tables, _ = store.import_tables(spark, f"{root}/again/structured", {})
    counts = (
        ("nodes", found["Entity"].count()),
        ("edges", links.count()),
        ("nation", tables["r1", "nation"].count()),
        ("missing components", len(told["missing"])),
    )
    return rows(spark, "part string, n long", *counts)
