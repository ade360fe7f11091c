"""Retrieval and answer metrics over ranked results and judgments."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, mrr, precision, recall, ndcg, hit) at k for every query with judgments.

    ranked: (query_id, item_id, rank from 1); relevant: (query_id, item_id).  Precision
    divides by what was retrieved up to k; a query without results scores 0.
    """
    total = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant.distinct().withColumn("good", F.lit(1)), ["query_id", "item_id"], "left")
    gain = F.when(F.col("good") == 1, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(F.lit(0.0))
    sums = hits.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.count("good").alias("n_good"),
        F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"),
        F.sum(gain).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = F.lit(0.0)
    return total.join(sums, "query_id", "left").select(
        "query_id",
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("n_good") / F.col("n"), zero).alias("precision"),
        F.coalesce(F.col("n_good") / F.col("n_relevant"), zero).alias("recall"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
        F.coalesce((F.col("n_good") > 0).cast("double"), zero).alias("hit"),
    )


def mean_metrics(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: the mean of each metric, and their weighted mean as `composite`."""
    names = [c for c in metrics.columns if c != "query_id"]
    weights = weights or dict.fromkeys(names, 1.0)
    means = metrics.agg(*[F.avg(c).alias(c) for c in names])
    total = sum(weights.values())
    composite = sum((F.col(c) * F.lit(w / total) for c, w in weights.items()), F.lit(0.0))
    return means.withColumn("composite", composite)


def answer_words(text: str | None) -> list[str]:
    """Lower-case words without articles and punctuation."""
    return [w for w in re.sub(r"[^\w\s]", " ", (text or "").lower()).split() if w not in ("a", "an", "the")]


def token_f1(given: str | None, wanted: str | None) -> float:
    a, b = answer_words(given), answer_words(wanted)
    if not a or not b:
        return float(a == b)
    same = sum((Counter(a) & Counter(b)).values())
    return 2 * same / (len(a) + len(b)) if same else 0.0


def rouge_l(given: str | None, wanted: str | None) -> float:
    """F-measure of the longest common subsequence of words."""
    a, b = answer_words(given), answer_words(wanted)
    if not a or not b:
        return float(a == b)
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0


def answer_metrics(answers: DataFrame) -> DataFrame:
    """answers (.., given, wanted) with exact_match, f1 and rouge_l."""

    @F.pandas_udf("struct<exact_match:double,f1:double,rouge_l:double>")
    def scored(given: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        pairs = list(zip(given, wanted, strict=True))
        return pd.DataFrame(
            {
                "exact_match": [float(answer_words(a) == answer_words(b)) for a, b in pairs],
                "f1": [token_f1(a, b) for a, b in pairs],
                "rouge_l": [rouge_l(a, b) for a, b in pairs],
            }
        )

    return answers.withColumn("m", scored("given", "wanted")).select(*answers.columns, "m.*")
