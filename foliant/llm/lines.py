"""Positions on a line: running sums that no single task has to make alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders at a time, on average.
ROWS = 20_000


def positions(df: DataFrame, group: str, key: Column, size: str, name: str, rows: int) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the group's rows that come before, in the order of ``key``.

    ``key`` is a hash (long) that spreads rows evenly; ``rows`` is about the number of rows. A group
    is cut by ranges of the hash into parts of about ROWS rows; parts are summed first, and a
    second sum runs over the parts. A hot group is thus ordered by many tasks. Rows that tie in
    the hash must be told apart by the column uid.
    """
    parts = max(16, 1 << max(0, (rows // ROWS)).bit_length())
    keyed = df.withColumn("_key", key).withColumn("_part", F.shiftrightunsigned(F.col("_key"), 64 - (parts.bit_length() - 1)).cast("long"))
    sums = keyed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_g", "_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_part").orderBy("_key", "uid").rowsBetween(Window.unboundedPreceding, -1)
    own = keyed.withColumn("_own", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    found = own.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return found.withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_key", "_part", "_g", "_p", "_base", "_own")
