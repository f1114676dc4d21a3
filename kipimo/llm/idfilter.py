"""A bit table of ids of fixed size, to leave most rows out of a join."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 32_768
PARTS = 256


def slot(*columns) -> Column:
    """The bit of a key."""
    return F.pmod(F.xxhash64(*columns), F.lit(PART * PARTS))


def slots(keys: np.ndarray) -> np.ndarray:
    """The bits of keys that are hashes already (``HashFilter``)."""
    return (keys.view(np.uint64) % np.uint64(PART * PARTS)).astype(np.int64)


class IdFilter:
    """Which slots are taken: one megabyte, however many keys there are.

    A key that was put in is always found; others are found by chance, the more the
    fuller the table is.  So it may only leave out rows that a join would find nothing
    for, and a full table costs speed, not results.
    """

    def __init__(self, keys: DataFrame, *columns):
        at = self._slot(*columns)
        rows = (
            keys.select(F.floor(at / PART).cast("int").alias("part"), (at % PART).alias("bit"))
            .groupBy("part")
            .agg(F.bitmap_construct_agg("bit").alias("bits"))
            .collect()  # PARTS rows of 4 KB at most
        )
        table = np.zeros((PARTS, PART // 8), np.uint8)
        for row in rows:
            table[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(np.unpackbits(table, bitorder="little"))

    @staticmethod
    def _slot(*columns) -> Column:
        return slot(*columns)

    def rows(self, df: DataFrame, *columns, found: bool = True) -> DataFrame:
        """The rows of ``df`` whose key's slot is taken, or is not."""
        shared = self.shared
        wide = df.withColumn("_slot", slot(*columns))
        at = len(df.columns)

        def chosen(batches):
            taken = shared.value
            for batch in batches:
                keep = taken[batch.column(at).to_numpy(zero_copy_only=False)].astype(bool)
                yield batch.filter(pa.array(keep if found else ~keep)).select(list(range(at)))

        return wide.mapInArrow(chosen, df.schema)


class HashFilter(IdFilter):
    """The same for a column of 64-bit hashes, which tasks look up by ``slots``."""

    @staticmethod
    def _slot(column) -> Column:
        return F.col(column).bitwiseAND(F.lit(PART * PARTS - 1))


def without(docs: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose ``column`` (null included) is not in ``gone``.

    Only rows whose slot is taken go through the join.
    """
    listed = IdFilter(gone, column)
    named = gone.select(F.col(column).alias("_gone")).distinct()
    stay = listed.rows(docs, column).join(named, F.col(column).eqNullSafe(F.col("_gone")), "left_anti")
    return listed.rows(docs, column, found=False).unionByName(stay)
