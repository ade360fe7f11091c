"""Approximate nearest neighbours with a permutation index.

Pivots are a bounded sample of distinct vectors.  A vector is represented by its nearest
pivots in the order of their distance, a prefix of its permutation, and posted in the
inverted files of its POSTED nearest ones.  The index is a table (pivot, slot, id, prefix, vector)
that is built once over all rows; a pivot's file is cut into slots of about SLOT rows by a
hash of the row, so a file that holds a third of all rows is many slots.

A query goes to the files of its LOOKED nearest pivots, and to no others.  There the
footrule distance of the two permutations (the sum over pivots of how far their places lie
apart, where a pivot beyond a prefix has the place after it) ranks the candidates: those
within the query's own limit are reranked by exact distance, and each slot passes on its
nearest k.  The limit is the footrule distance that a share RERANKED of all vectors keeps,
read off a bounded sample, so it depends on the query and not on how rows are dealt out.
A candidate that shares several files with a query is looked at in the first only.

Queries that find fewer than k candidates are held against all rows, in blocks.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, and neither do rows without an id.  Ties go to the smaller
id; rows that repeat an id count once, at their least distance; a query's own id is
no candidate; of rows that repeat a query's id the one of the least vector asks.  With fewer candidates than asked for, all are returned; an empty
table gives an empty result.  Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Pivots, and places of a permutation that are kept; nearest pivots under which a vector is posted, and a query looks.
PIVOTS, PREFIX, POSTED, LOOKED = 512, 128, 4, 127
#: Share of all vectors that a query's limit lets by, and vectors that it is read off.
RERANKED, SAMPLE = 0.25, 4096
#: Rows of a slot, and rows that a task makes at a time for lists, about.
SLOT, LISTED = 4096, 16_384
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(F.forall(v, fine) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size(v) == (size["n"] if size else 0))


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most n distinct vectors, the first ones by a hash of their values."""
    hashed = rows.select(F.xxhash64("vector").alias("h"), "vector")
    picked = hashed.join(
        hashed.select("h").distinct().orderBy("h").limit(n), "h"
    ).groupBy("h").agg(F.min("vector").alias("vector")).orderBy("h").collect()
    return np.array([r["vector"] for r in picked], np.float64) if picked else np.zeros((0, 0))


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """By row, the nearest pivots from near to far; ties go to the first."""
    far = (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :length].astype(np.uint16)


class Permutations:
    """What every task needs: the pivots, and the sample that limits are read off."""

    def __init__(self, pivots: np.ndarray, drawn: np.ndarray, share: float):
        self.pivots, self.length = pivots, min(PREFIX, len(pivots))
        self.looked, self.posted = min(LOOKED, len(pivots)), min(POSTED, len(pivots))
        self.drawn = prefixes(drawn, pivots, self.length)
        # RERANKED of the sample and 64 more, so that small tables lose nothing
        self.rank = min(len(drawn) - 1, int(np.ceil(share * len(drawn))) + 64)

    def places(self, prefix: np.ndarray) -> np.ndarray:
        """Each pivot's place in a prefix, or the place after it."""
        out = np.full(len(self.pivots), self.length, np.int16)
        out[prefix] = np.arange(self.length, dtype=np.int16)
        return out

    def footrule(self, places: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The distance of one permutation, given by its places, to others, given by their prefixes."""
        at = places[others]
        total = self.length * (self.length + 1) // 2
        # pivots that only the first has count for how far they stand before the end
        return (np.abs(at - np.arange(self.length, dtype=np.int16)) + at).sum(1, dtype=np.int32) + (total - self.length * self.length)

    def limit(self, places: np.ndarray) -> int:
        """The footrule distance that candidates of a query may have at most."""
        apart = self.footrule(places, self.drawn)
        return int(np.partition(apart, self.rank)[self.rank])


def least(ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids, each once at its least distance."""
    first = np.lexsort((ids, distance))
    _, keep = np.unique(ids[first], return_index=True)
    keep = first[np.sort(keep)[:k]]
    return ids[keep], distance[keep]


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _arrow(query_ids, found) -> pa.RecordBatch:
    n = [len(a) for a, _ in found]
    ids = np.concatenate([a for a, _ in found]) if found else []
    scores = np.concatenate([d for _, d in found]) if found else []
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array(query_ids, np.int64), n), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())],
        ["query_id", "vec_id", "score"],
    )


def _lists(rows: DataFrame, shared, n: str) -> DataFrame:
    """(pivot, id, prefix, limit, vector): a row for each of a vector's first `n` pivots, posted or looked; limit is a query's."""

    def run(batches):
        model = shared.value
        many = getattr(model, n)
        step = max(1, LISTED // many)
        for part in (batch.slice(first, step) for batch in batches for first in range(0, len(batch), step)):
            prefix = prefixes(_vectors(part.column(1)), model.pivots, model.length)
            at = pa.array(np.repeat(np.arange(len(part)), many))
            limits = [model.limit(model.places(p)) if n == "looked" else None for p in prefix]
            columns = [part.column(0), pa.array([p.tobytes() for p in prefix], pa.binary()), pa.array(limits, pa.int32()), part.column(1)]
            pivot = pa.array(prefix[:, :many].ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([pivot, *(c.take(at) for c in columns)], ["pivot", "id", "prefix", "limit", "vector"])

    return rows.select("id", "vector").mapInArrow(run, "pivot int, id long, prefix binary, limit int, vector array<double>")


def build_index(rows: DataFrame, shared, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The inverted files (pivot, slot, id, prefix, vector), and (pivot, slots) of each."""
    posted = scratch.save(_lists(rows, shared, "posted"), "posted")
    sizes = scratch.save(posted.groupBy("pivot").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots")), "sizes")
    slot = F.pmod(F.xxhash64("id", "vector"), F.col("slots")).cast("int")
    return posted.join(F.broadcast(sizes), "pivot").withColumn("slot", slot).drop("slots"), sizes  # at most PIVOTS rows


def _search(index: DataFrame, asked: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, vec_id, score): of every slot, the k nearest within each query's limit."""
    sides = index.withColumn("seeks", F.lit(False)).unionByName(asked.withColumn("seeks", F.lit(True)))
    sides = sides.select(
        "pivot", "slot", "seeks", "id", "prefix", "limit", "vector"
    ).repartition("pivot", "slot").sortWithinPartitions("pivot", "slot", "seeks")

    def held(model, pivot, rows):
        """A slot's ids, prefixes and vectors, and its rows' nearer posted pivots; those that aren't are a pivot that no query has."""
        ids, others, x = (np.array(c) for c in zip(*rows, strict=True))
        posted = others[:, : model.posted]
        return ids, others, x, np.where(np.cumsum(posted == pivot, 1) == 0, posted, len(model.pivots))

    def one(model, files, q, prefix, limit, vector):
        ids, others, x, nearer = files
        places = model.places(prefix)
        near = (model.footrule(places, others) <= limit) & (ids != q)
        # looked at elsewhere, if a nearer posted pivot of the candidate is among the query's too
        near &= ~(np.append(places, model.length)[nearer] < model.looked).any(1)
        at = np.flatnonzero(near)
        return least(ids[at], np.sqrt(((x[at] - vector) ** 2).sum(1)), k)

    def run(batches):
        model = shared.value
        of, rows, files = None, [], None
        for batch in batches:
            pivot, slot, seeks, ids, limits = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            prefix = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(len(batch), -1)
            x = _vectors(batch.column(6))
            asking, found = [], []
            for i in range(len(batch)):
                if (pivot[i], slot[i]) != of:
                    of, rows, files = (pivot[i], slot[i]), [], None
                if not seeks[i]:
                    rows.append((ids[i], prefix[i].copy(), x[i].copy()))  # a slot's rows, SLOT about
                elif rows:
                    files = files or held(model, pivot[i], rows)
                    asking.append(ids[i])
                    found.append(one(model, files, ids[i], prefix[i], limits[i], x[i]))
            yield _arrow(asking, found)

    return sides.mapInArrow(run, FOUND)


def _search_all(rows: DataFrame, asked: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of all rows to each of few queries, in blocks of queries against blocks of rows."""
    n_rows, n_asked = (max(1, -(-df.count() // block)) for df in (rows, asked))
    deal = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.select("id", "vector", deal(n_rows).alias("b")).withColumn("a", every(n_asked)).withColumn("seeks", F.lit(False))
    seek = asked.select("id", "vector", deal(n_asked).alias("a")).withColumn("b", every(n_rows)).withColumn("seeks", F.lit(True))
    sides = base.unionByName(seek).select("a", "b", "seeks", "id", "vector").repartition("a", "b").sortWithinPartitions("a", "b", "seeks")

    def run(batches):
        of, rows_ = None, []
        for batch in batches:
            asking, found = [], []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for a, b, seeks, i, x in zip(*columns, _vectors(batch.column(4)), strict=True):
                if (a, b) != of:
                    of, rows_ = (a, b), []
                if not seeks:
                    rows_.append((i, x.copy()))
                elif rows_:
                    ids, base_ = (np.array(c) for c in zip(*rows_, strict=True))
                    asking.append(i)
                    found.append(least(ids[ids != i], np.sqrt(((base_[ids != i] - x) ** 2).sum(1)), k))
            yield _arrow(asking, found)

    return sides.mapInArrow(run, FOUND)


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int = 10, pivots: int = PIVOTS, share: float = RERANKED
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first.

    queries: rows of the same columns.  score is the Euclidean distance in double precision.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows, asked = usable(vectors, id_column, vector_column), usable(queries, id_column, vector_column)
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    drawn = sample(rows, max(pivots, SAMPLE))
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(Permutations(drawn[:pivots], drawn, share))
    index, sizes = build_index(rows, shared, scratch)
    looking = _lists(asked.select("id", "vector"), shared, "looked").join(F.broadcast(sizes), "pivot")
    looking = looking.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    found = scratch.save(_nearest_of(_search(index, looking, shared, k), k), "found")
    scratch.drop("posted", "sizes")
    enough = min(k, rows.select("id").distinct().limit(k + 1).count() - 1)
    counts = asked.join(found.groupBy(F.col("query_id").alias("id")).count(), "id", "left")
    short = scratch.save(counts.filter(F.coalesce("count", F.lit(0)) < enough).select("id", "vector"), "short")
    if short.isEmpty():
        return found
    rest = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return rest.unionByName(_nearest_of(_search_all(rows, short, k), k))
