"""Joins of a large table with one that is unique by its key, whatever the size of either; and the spreading of small inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table is sent to every task.
BROADCAST_BYTES = 32 << 20


def fits(side: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table, which should be written already, is small enough for every task; ``row_bytes`` bounds a row."""
    return side.count() * row_bytes <= most


def lookup_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], spread: Column | str, row_bytes: int = 64, most: int = BROADCAST_BYTES, how: str = "left", ways: int = 32) -> DataFrame:
    """``rows`` with what ``side``, unique by ``keys``, has for their keys (``how``: left or inner).

    A side of ``most`` bytes or less is broadcast, and the rows aren't shuffled. A larger one is repeated in ``ways`` parts
    and joined by key and part, where a row's part is a hash of ``spread``: no key then gathers its rows in one task. Both
    ways give the same rows. Null keys find nothing; an empty table on either side is fine.
    """
    if fits(side, row_bytes, most):
        return rows.join(F.broadcast(side), list(keys), how)
    parts = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(ways)).cast("int"))
    return salted.join(parts, [*keys, "_part"], how).drop("_part")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the session has cores, dealt out over these; other scans as they are.

    For what costs far more by the row than its shuffle, such as work on texts in Python: a table of one small file would
    else be one task. Rows and results don't change.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
