"""Helpers shared by the training-data operators: tables, splits, samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import table
from ..plans.scratch import Scratch

__all__ = ["DOCUMENT_COLUMNS", "IdFilter", "Scratch", "held_out", "table", "text_batches", "unit_hash"]

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that models never learn from; null ids learn."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unit_hash(column: Column, seed: str) -> Column:
    """A fixed number in [0, 1) for a value: the basis of repeatable samples."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) / F.lit(float(1 << 30))


BATCH_KEY, TEXTS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def text_batches(spark: SparkSession) -> None:
    """Sends at most TEXTS_A_BATCH rows at a time to Python, in this session, unless somebody chose less.

    Texts and sets are wide: batches of Spark's usual 10,000 take hundreds of MB beside the heap.
    """
    if int(spark.conf.get(BATCH_KEY)) > TEXTS_A_BATCH:
        spark.conf.set(BATCH_KEY, str(TEXTS_A_BATCH))


class IdFilter:
    """A Bloom filter of ids, of at most MOST_BITS bits (32 MB), for use before a shuffle.

    It never says no to an id that was put in, so a join after it stays exact; beyond some
    50 million ids it says yes to ever more others, and saves less.  Ids stay on the
    executors: only the filter's words, bounded by its size, come to the driver.
    """

    MOST_BITS, PROBES, BITS_AN_ID = 1 << 28, 3, 16

    def __init__(self, ids: DataFrame, column: str):
        spark = ids.sparkSession
        wanted = max(1 << 12, ids.count() * self.BITS_AN_ID)
        self.bits = min(self.MOST_BITS, 1 << (wanted - 1).bit_length())
        at = ids.select(F.explode(self.probes(F.col(column))).alias("p"))
        words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("v")).toArrow()
        filled = np.zeros(self.bits // 64, np.int64)
        filled[words.column("w").to_numpy()] = words.column("v").to_numpy()
        self.words = spark.sparkContext.broadcast(filled)

    def probes(self, value: Column) -> Column:
        """The places of an id's bits."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(self.bits)) for i in range(self.PROBES)])

    @staticmethod
    def hits(words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether all bits of a row of places are set."""
        return ((words[places >> 6] >> (places & 63)) & 1).astype(bool).all(1)

    def maybe(self, value: Column) -> Column:
        """False for ids that certainly weren't put in; null ids aren't."""
        shared = self.words

        @F.pandas_udf("boolean")
        def inside(places):
            import pandas as pd

            return pd.Series(IdFilter.hits(shared.value, np.stack(places.to_numpy())) if len(places) else [], dtype=bool)

        return F.coalesce(value.isNotNull() & inside(self.probes(value)), F.lit(False))
