"""Retrieval: exact vector search, BM25, reciprocal-rank fusion and what is made of them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import in_domains, live_chunk, valid_at
from ..functions.text import search_text, tokens

K1, B, RRF_K = 1.2, 0.75, 60


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if either vector is zero or null."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p)))
    return F.when(norm > 0, dot / norm)


def index_score(cos: Column) -> Column:
    """Cosine similarity on the scale 0 to 1 that thresholds refer to."""
    return (1 + cos) / 2


def vector_search(rows: DataFrame, query: list[float], k: int = 5, id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """rows' k nearest by cosine similarity, after all filters; (id, cos, score)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(id_column).alias("id"), cosine(F.col(vector_column), q).alias("cos")).filter("cos IS NOT NULL")
    return scored.withColumn("score", index_score(F.col("cos"))).orderBy(F.desc("cos"), "id").limit(k)


def vector_search_chunks(chunks: DataFrame, chats: DataFrame, query: list[float], domains, as_of: str | None = None, k: int = 5) -> DataFrame:
    """(source, id, cos, score): chunks and chats each by their best k, then the best k of both.

    Points in time and deletions hold for chunks only: chats have neither.
    """
    live = chunks.filter(in_domains("domain", domains) & live_chunk())
    live = live.filter(valid_at(as_of)) if as_of else live
    legs = [
        vector_search(live, query, k).select(F.lit("chunk").alias("source"), "id", "cos", "score"),
        vector_search(chats.filter(in_domains("domain", domains)), query, k).select(F.lit("chat").alias("source"), "id", "cos", "score"),
    ]
    return legs[0].unionByName(legs[1]).orderBy(F.desc("cos"), "source", "id").limit(k)


def postings(rows: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """(term, id, tf, length): the table that full-text search reads; worth keeping for many searches."""
    words = rows.select(F.col(id_column).alias("id"), tokens(F.col(text_column)).alias("words"))
    each = words.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
    return each.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def bm25(rows: DataFrame, query: str, k: int = 5, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """(id, score): rows with any of the query's terms, best first; none for an empty query.

    One pass tells rows, words and each term's documents; only rows with a term move.
    """
    terms = sorted(set(tokens_of(query)))
    if not terms:
        return rows.sparkSession.createDataFrame([], f"id {dict(rows.dtypes)[id_column]}, score double")
    words = rows.select(F.col(id_column).alias("id"), tokens(F.col(text_column)).alias("words"))
    counted = words.select(
        "id", F.size("words").alias("length"), *[(F.size("words") - F.size(F.array_remove("words", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    )
    stats = counted.agg(
        F.count("*").alias("n"), F.avg("length").alias("avg_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    )
    scored = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}").cast("double")
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return scored.select("id", total.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def tokens_of(query: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", search_text(query).lower()) if w]


def full_text(chunks: DataFrame, chats: DataFrame | None, query: str, domains, as_of: str | None = None, k: int = 5) -> DataFrame:
    """(source, id, score): chunks and, if there are any, chats, each by their best k, then the best k of both."""
    live = chunks.filter(in_domains("domain", domains) & live_chunk())
    live = live.filter(valid_at(as_of)) if as_of else live
    out = bm25(live, query, k).select(F.lit("chunk").alias("source"), F.col("id").cast("string").alias("id"), "score")
    if chats is not None:
        out = out.unionByName(
            bm25(chats.filter(in_domains("domain", domains)), query, k).select(
                F.lit("chat").alias("source"), F.col("id").cast("string").alias("id"), "score"
            )
        )
    return out.orderBy(F.desc("score"), F.desc("source"), "id").limit(k)


def reciprocal_rank_fusion(vector: DataFrame, text: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """(key, score, vector_rank, text_rank) of two legs (key, rank): the sum of 1 / (k + rank).

    Ties go to the vector leg's order, then to the text leg's.
    """
    v = vector.select("key", F.col("rank").cast("int").alias("vector_rank"))
    t = text.select("key", F.col("rank").cast("int").alias("text_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = v.join(t, "key", "full_outer").withColumn("score", part("vector_rank") + part("text_rank"))
    out = both.select("key", "score", "vector_rank", "text_rank").orderBy(
        F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank"), "key"
    )
    return out.limit(top) if top else out


def ranked(leg: DataFrame, key: Column, *order: Column) -> DataFrame:
    """(key, rank) of a leg that has been cut to its best rows: a few, so one window holds them."""
    return leg.select(key.alias("key"), *leg.columns).withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    ).select("key", "rank")


def hybrid(chunks: DataFrame, chats: DataFrame, vector: list[float], query: str, domains, as_of: str | None = None, k: int = 5) -> DataFrame:
    """Vector and full-text search, each cut to its best k, fused and cut to the best k."""
    key = F.concat_ws(":", "source", F.col("id").cast("string"))
    v = ranked(vector_search_chunks(chunks, chats, vector, domains, as_of, k), key, F.desc("cos"), F.col("source"), F.col("id"))
    t = ranked(full_text(chunks, chats, query, domains, as_of, k), key, F.desc("score"), F.desc("source"), F.col("id"))
    return reciprocal_rank_fusion(v, t, top=k)


def resolve_entities(entities: DataFrame, phrase: str, embed: Callable[[str], list[float]] | None, domains, k: int = 5) -> DataFrame:
    """Entities by name and description in full text, fused with vector search; without vectors if embedding fails."""
    here = entities.filter(in_domains("domain", domains))
    text = here.select("id", F.concat_ws(" ", "name", "description").alias("text"))
    key = F.concat(F.lit("entity:"), F.col("id").cast("string"))
    t = ranked(bm25(text, phrase, k), key, F.desc("score"), F.col("id"))
    v = None
    if embed is not None:
        try:
            vector = embed(phrase)
        except Exception:  # noqa: BLE001  search goes on with what the text says
            vector = None
        if vector:
            v = ranked(vector_search(here, vector, k), key, F.desc("cos"), F.col("id"))
    if v is None:
        v = t.filter("false")
    return reciprocal_rank_fusion(v, t, top=k)


def backfill_embeddings(
    rows: DataFrame, embed: Callable[[str], list[float]], text_column: str = "text", vector_column: str = "embedding"
) -> DataFrame:
    """rows with null vectors filled from their text; one that fails stays null."""
    @F.pandas_udf("array<float>")
    def filled(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else [float(x) for x in embed(t)])
            except Exception:  # noqa: BLE001  a row of its own
                out.append(None)
        return pd.Series(out)

    missing = rows.filter(F.col(vector_column).isNull()).withColumn(vector_column, filled(F.col(text_column)))
    return rows.filter(F.col(vector_column).isNotNull()).unionByName(missing.select(*rows.columns))
