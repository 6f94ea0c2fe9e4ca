"""Equi-joins of large tables on texts that begin alike, and sides that are few rows.

A sort-merge join orders both sides by its keys. Household and row ids differ in their last letters only, so every
comparison reads both texts to the end. Led by a hash of the keys, most comparisons end at one long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "_hash"
#: Rows of a written table up to which all tasks are sent it.
FEW = 10_000


def key_hash(keys: list[str], spread: str | None = None) -> Column:
    """A hash of the keys. With `spread`, rows that lack a key have that column's hash: they meet nothing, so they need
    not lie in one place."""
    found = F.xxhash64(*keys)
    if spread is None:
        return found
    lacking = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return F.when(lacking, F.xxhash64(spread)).otherwise(found)


def sent_if_few(side: DataFrame) -> DataFrame:
    """A written side of a join, with the hint to send it to all tasks if it is few rows, else to merge. Spark goes by the
    bytes on disk, which for rows that are much alike say little of those that the driver would hold."""
    return F.broadcast(side) if side.count() <= FEW else side.hint("merge")


def hashed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", spread: str | None = None) -> DataFrame:
    """left.join(right, keys, how) for inner, left, left_semi and left_anti joins. `spread`: a column of the left side that
    tells many of its rows apart, where many lack a key."""
    return left.withColumn(HASH, key_hash(keys, spread)).join(right.withColumn(HASH, key_hash(keys)), [HASH, *keys], how).drop(HASH)
