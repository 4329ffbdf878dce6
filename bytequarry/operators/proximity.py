"""Joins of places: THEN and WITHIN, as window frames over offsets of the same document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAR = 2**31 - 1


def _tagged(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc, offset, l, r): distinct places, and on which sides they occur."""
    both = left.select("doc", "offset", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("doc", "offset", F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy("doc", "offset").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def _next(side: str, low: int, high: int):
    """The least offset on a side at a distance of low to high."""
    w = Window.partitionBy("doc").orderBy("offset").rangeBetween(low, high)
    return F.min(F.when(F.col(side) == 1, F.col("offset"))).over(w)


def then(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """doc, offset of left places whose next right place is 1 to ``distance`` bytes on; none if there is one at the place itself.

    A negative distance gives right places with a left place up to so many bytes on.
    """
    rows = _tagged(left, right)
    if distance < 0:
        return rows.withColumn("next", _next("l", 1, -distance)).filter("r = 1 and next is not null").select("doc", "offset")
    return rows.withColumn("next", _next("r", 0, distance)).filter("l = 1 and next > offset").select("doc", "offset")


def within(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """doc, offset of the earlier of a left and a right place at most ``distance`` bytes apart."""
    rows = _tagged(left, right).withColumn("to_r", _next("r", 0, distance)).withColumn("to_l", _next("l", 1, distance))
    return rows.filter("l = 1 and to_r is not null or r = 1 and to_l is not null").select("doc", "offset")
