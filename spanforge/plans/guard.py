"""Queries from outside: read only, in a session of their own, in Spark's dialect."""

from __future__ import annotations

import re

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Verbs that a read-only query hasn't got, for the guard by words.
VERBS = (
    "insert",
    "update",
    "delete",
    "merge",
    "create",
    "drop",
    "alter",
    "truncate",
    "replace",
    "copy",
    "attach",
    "detach",
    "load",
    "install",
    "set",
    "pragma",
    "call",
)


def looks_read_only(sql: str) -> bool:
    """The guard by words: a single statement that begins like a query and has no other verb in it.

    It also turns down a harmless text that has such a word in it.
    """
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    if ";" in text or not re.match(r"(?i)(select|with|from|values|table|\()", text):
        return False
    return not re.search(rf"(?i)\b({'|'.join(VERBS)})\b", text)


#: Nodes that a query may be made of, as Spark's parser names them.  All others are turned down:
#: commands, writes, scripts, names put together at run time, time travel.
NODES = frozenset(
    """Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedWith Generate LateralJoin
    AsOfJoin Pivot Unpivot UnresolvedHint UnresolvedHaving UnresolvedInlineTable ResolvedInlineTable LocalRelation OneRowRelation UnresolvedRelation Sample
    UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases WithWindowDefinition Window UsingJoin Tail UnionLoop UnionLoopRef""".split()
)
#: Functions that reach outside the rows, though they are built in: other code, files, the session.
REFUSED = frozenset(
    """reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length from_avro to_avro from_protobuf to_protobuf
    current_user session_user user current_catalog current_database current_schema version spark_partition_id raise_error assert_true""".split()
)
#: Functions that may stand where a table does.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())


def _parts(names) -> list[str]:
    return [names.apply(i) for i in range(names.size())]


def _nodes(spark: SparkSession, root):
    """All nodes of a parsed statement: plans, expressions, subqueries and common tables, however nested."""
    stack = [root]
    is_product = spark.sparkContext._jvm.java.lang.Class.forName("scala.Product").isInstance
    while stack:
        node = stack.pop()
        if not isinstance(node, JavaObject):
            continue
        name = node.getClass().getName()
        if name.startswith("scala.collection."):
            inner = node.iterator()
        elif name.startswith(("scala.Tuple", "scala.Some")):
            inner = node.productIterator()
        elif name.startswith("org.apache.spark.sql.") and not name.startswith(
            ("org.apache.spark.sql.catalyst.trees.", "org.apache.spark.sql.types.")
        ):
            yield name.rsplit(".", 1)[-1], node
            if not is_product(node):
                continue
            inner = node.productIterator()
        else:
            continue
        while inner.hasNext():
            stack.append(inner.next())


def check_read_only(spark: SparkSession, sql: str, args: dict | None = None, views=None) -> None:
    """The guard by plan: raises unless the statement, as Spark parses it, only reads what it may.

    It may be made of NODES, name single-part relations among `views` (the session's own tables and
    views if none are given) or its own common tables, and call built-in functions but for REFUSED ones.
    """
    jvm = spark.sparkContext._jvm
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    is_plan = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance
    builtin = getattr(getattr(jvm, "org.apache.spark.sql.catalyst.analysis.FunctionRegistry$"), "MODULE$").builtin()
    known = {v.lower() for v in (views if views is not None else (t.name for t in spark.catalog.listTables()))}
    common, relations = set(), []
    for name, node in _nodes(spark, parsed):
        if "UnresolvedIdentifier" in name or is_plan(node) and name not in NODES:
            raise PermissionError(f"only queries that read are allowed, not {name}")
        if name == "UnresolvedWith":
            found = node.cteRelations()
            common |= {found.apply(i)._1().lower() for i in range(found.size())}
        elif name == "UnresolvedRelation":
            relations.append(_parts(node.multipartIdentifier()))
        elif name == "UnresolvedTableValuedFunction":
            parts = _parts(node.name())
            if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                raise PermissionError(f"the table function {'.'.join(parts)} isn't allowed")
        elif name in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = _parts(node.nameParts()) if name == "UnresolvedFunction" else [node.name().funcName()]
            identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[-1].lower())
            if len(parts) != 1 or parts[0].lower() in REFUSED or not builtin.functionExists(identifier):
                raise PermissionError(f"the function {'.'.join(parts)} isn't allowed")
    for parts in relations:
        if len(parts) != 1 or parts[0].lower() not in known | common:
            raise PermissionError(f"there is no view {'.'.join(parts)} here")


#: Column numbers that views don't have: more than a lambda function names its variables times.
LOW_IDS = 1000


def _renumbered(df: DataFrame) -> JavaObject:
    """df's plan with its columns numbered afresh, as the second side of a self-join is.

    Spark compares filters in a form that numbers the variables of a lambda function from 0, and there
    it loses sight of a column of the same number.  The first columns of a process have such
    numbers, and a filter that reads one could be pushed to where the column isn't.
    """
    ids = getattr(getattr(df.sparkSession._jvm, "org.apache.spark.sql.catalyst.expressions.NamedExpression$"), "MODULE$")
    while ids.newExprId().id() < LOW_IDS:
        pass
    return df.crossJoin(df)._jdf.logicalPlan().children().apply(1)


def isolated(spark: SparkSession, views: dict[str, DataFrame]) -> SparkSession:
    """A session that has the views and none of the caller's, and reads no files by their paths.

    It shares the caller's catalogue of persistent tables, as any session does: those
    are out of reach only for statements that check_read_only has let by.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in views.items():
        moved = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, _renumbered(df))
        type(df)(moved, session).createOrReplaceTempView(name)
    return session


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """A query that only reads over the given views, or over the session's own."""
    session = isolated(spark, views) if views is not None else spark
    text = to_spark(sql)
    check_read_only(session, text, views=views)
    return session.sql(text)


#: Function names of the other dialect and what they are called here.
RENAMED = {
    "list_contains": "array_contains",
    "list_distinct": "array_distinct",
    "list_sort": "array_sort",
    "list_transform": "transform",
    "list_filter": "filter",
    "list_concat": "concat",
    "unnest": "explode",
    "array_to_string": "array_join",
    "strptime": "to_timestamp",
    "string_agg": "listagg",
    "len": "length",
}


def _outside_quotes(sql: str, change) -> str:
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\")", sql)
    return "".join(p if i % 2 else change(p) for i, p in enumerate(parts))


def to_spark(sql: str) -> str:
    """The constructs of the other dialect that Spark lacks, rewritten; what can't be is refused.

    * EXCLUDE becomes EXCEPT, renamed functions get their names here, QUALIFY becomes a filter
    around the query, and string_split splits at a text and not at a pattern.
    """

    def change(part: str) -> str:
        if re.search(r"(?i)\bpositional\s+join\b", part):
            raise ValueError("a positional join has no meaning without an order")
        if re.search(r"(?i)\basof\s+(left\s+)?join\b", part):
            raise ValueError("write an as-of join with asof_join")
        part = re.sub(r"(?i)\*\s+exclude\s*\(", "* EXCEPT (", part)
        part = re.sub(r"(?i)\*\s+exclude\s+(\w+)", r"* EXCEPT (\1)", part)
        for a, b in RENAMED.items():
            part = re.sub(rf"(?i)\b{a}\s*\(", f"{b}(", part)
        return part

    text = _outside_quotes(sql.strip().rstrip(";"), change)
    text = re.sub(
        r"(?i)\bstring_split\s*\(\s*([\w.]+)\s*,\s*'((?:[^']|'')*)'\s*\)", lambda m: f"split({m[1]}, '{re.escape(m[2]) if m[2] else ''}')".replace("\\", "\\\\"), text
    )
    at = _outermost(text, "qualify")
    start = _outermost(text, "from")
    if at is None or start is None or not re.match(r"(?i)select\b", text):
        return text
    ends = [x for x in (_outermost(text, "order by", at), _outermost(text, "limit", at)) if x is not None]
    end = min(ends, default=len(text))
    chosen, source, test = text[len("select") : start], text[start:at], text[at + len("qualify") : end]
    return f"SELECT * EXCEPT (_qualified) FROM (SELECT {chosen.strip()}, ({test.strip()}) AS _qualified {source.strip()}) WHERE _qualified {text[end:]}".strip()


def _outermost(sql: str, word: str, start: int = 0) -> int | None:
    """Where a word stands outside of brackets and quotes; None if it doesn't."""
    depth, quote = 0, ""
    pattern = re.compile(rf"(?i)\b{word.replace(' ', chr(92) + 's+')}\b")
    for i, c in enumerate(sql):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif depth == 0 and i >= start and pattern.match(sql, i) and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_")):
            return i
    return None


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, how: str = "left") -> DataFrame:
    """Every left row with the last right row of the same keys that isn't later.

    Both sides become one stream by key and time, over which the last right row is carried
    forward; so each row moves once, and nothing is multiplied.
    """
    extra = [c for c in right.columns if c not in on]
    lcols = [c for c in left.columns if c not in on]
    a = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"), F.lit(None).alias("_r"))
    b = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_l"), F.struct(*extra).alias("_r"))
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    if how == "inner":
        rows = rows.filter("_r IS NOT NULL")
    return rows.select(*on, *[F.col("_l")[c].alias(c) for c in lcols], *[F.col("_r")[c].alias(f"{c}_right" if c in lcols else c) for c in extra])
