"""Quality rules as a ledger of failure bits.

Every rule is evaluated once a document.  The ledger keeps what was measured and one
number whose bits tell which rules the document failed.  A policy is a versioned mask
over those bits, so policies are applied, compared and ablated by bitwise operations on the
ledger, without reading a text again.  DataFrame functions only.

Repeated three-word windows are found within the row: the windows' 64-bit hashes are
sorted together with their places, equal neighbours are repeats, and their places are
counted once.  No words are shuffled.  (Two different windows of a text of 20,000 words
have the same hash once in 10^11 texts.)

Defined cases: a null text is an empty one, with all counts 0, which fails for having too few
words; texts of one or two words have no windows; repeated rows are measured row by row;
extra columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, and the signs that count as symbols.
WORD, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # over the measurements, in integers


#: A rule's place is its bit.  Rules are only ever added at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("endless", "n_words > 1000000"),
)


def mask(*names: str) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


BASE = mask("few_words", "repeated_windows")
#: Versioned policies: which failures count.
POLICIES = {
    "base": BASE,
    "2024.1": BASE | mask("many_symbols", "short_words", "long_words", "repeated_lines"),
    "2024.1-strict": BASE | mask("many_symbols", "short_words", "long_words", "repeated_lines", "endless"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, *MEASURES) for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), 1).alias("w"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS[1:]}+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("w")
    grams = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i"))
    )
    rows = rows.select(
        "doc_id",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, grams).alias("grams"),
    )
    rows = rows.withColumn("distinct", F.size(F.array_distinct("grams.g")) == F.size("grams"))
    rows = rows.withColumn("sorted", F.when(~F.col("distinct"), F.sort_array("grams"))).drop("grams", "distinct")
    at = lambda k: F.get("sorted", k)["g"]
    twice = F.filter("sorted", lambda x, k: (x["g"] == at(k - 1)) | (x["g"] == at(k + 1)))
    rows = rows.withColumn("places", F.transform(twice, lambda x: x["i"])).drop("sorted")
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda i: F.array(i, i + 1, i + 2)))))
    return rows.withColumn("n_repeat_words", F.when(F.col("places").isNull(), F.lit(0)).otherwise(covered).cast("long")).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, *MEASURES, failed): failed has bit i if RULES[i] failed."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed", failed)


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def verdicts(entries: DataFrame, policy: str = "2024.1") -> DataFrame:
    """(doc_id, n_words, the measured counts, base_failed, kept, failed) under a policy."""
    kept = passes("base") & passes(policy)
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes("base")).alias("base_failed"),
        kept.alias("kept"),
        "failed",
    )


def ablation(entries: DataFrame, policy: str = "2024.1") -> DataFrame:
    """(rule, failed, only, kept_without): a row for each rule of the policy, from one pass.

    failed: documents that fail the rule; only: those that fail no other rule of the
    policy; kept_without: what the policy would keep without the rule.
    """
    m = POLICIES[policy]
    used = [i for i in range(len(RULES)) if m >> i & 1]
    live = F.col("failed").bitwiseAND(F.lit(m))
    sums = [F.count_if(live == 0).alias("kept")]
    sums += [F.count_if(live.bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}") for i in used]
    sums += [F.count_if(live == 1 << i).alias(f"o{i}") for i in used]
    total = entries.agg(*sums)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(RULES[i].name).alias("rule"),
                    F.col(f"f{i}").alias("failed"),
                    F.col(f"o{i}").alias("only"),
                    (F.col("kept") + F.col(f"o{i}")).alias("kept_without"),
                ) for i in used
            ]
        )
    )
    return total.select(rows.alias("r")).select("r.*")


def kept_by_policy(entries: DataFrame) -> DataFrame:
    """(policy, documents, kept): what every version of the policy keeps, from one pass over the ledger."""
    counts = [F.count_if(F.col("failed").bitwiseAND(F.lit(m)) == 0).alias(f"p{i}") for i, m in enumerate(POLICIES.values())]
    total = entries.agg(F.count("*").alias("documents"), *counts)
    rows = [F.struct(F.lit(name).alias("policy"), F.col("documents"), F.col(f"p{i}").alias("kept")) for i, name in enumerate(POLICIES)]
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _entries_sql() -> str:
    """The ledger as a common table f, by windows and groups over exploded words."""
    bits = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM p) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^{SYMBOLS[1:]}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)"""


def oracle_sql(policy: str = "2024.1") -> str:
    """DuckDB SQL for the verdicts."""
    return _entries_sql() + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {BASE}) <> 0 AS base_failed,
  (failed & {BASE | POLICIES[policy]}) = 0 AS kept, failed FROM f"""


def ablation_sql(policy: str = "2024.1") -> str:
    """DuckDB SQL for the ablation: the policy's kept documents are counted again without each rule."""
    m = POLICIES[policy]
    rows = [
        f"SELECT '{r.name}' AS rule, count(*) FILTER (failed & {1 << i} <> 0) AS failed, count(*) FILTER (failed & {m} = {1 << i}) AS \"only\", "
        f"count(*) FILTER (failed & {m & ~(1 << i)} = 0) AS kept_without FROM f"
        for i, r in enumerate(RULES)
        if m >> i & 1
    ]
    return _entries_sql() + " " + " UNION ALL ".join(rows)


def kept_by_policy_sql() -> str:
    rows = [f"SELECT '{name}' AS policy, count(*) AS documents, count(*) FILTER (failed & {m} = 0) AS kept FROM f" for name, m in POLICIES.items()]
    return _entries_sql() + " " + " UNION ALL ".join(rows)
