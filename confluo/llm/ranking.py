"""Exact ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window task sorts, about.
BUCKET = 1 << 15


def buckets_for(rows: int) -> int:
    """A power of two that leaves about BUCKET rows (of all groups together) in each."""
    n = 1
    while n * BUCKET < rows and n < 1 << 22:
        n *= 2
    return n


def ranked(df: DataFrame, group: list[str], order: Column, *, buckets: int, ties: list[Column] | None = None, name: str = "rank") -> DataFrame:
    """Adds the gapless rank (from 0) of each row within its group, by ``order``, a uniform long.

    A group is cut by the leading bits of ``order`` into buckets, which are
    numbered by their sizes (partial counts) and ranked apart. So no task sorts
    a whole group, and a rank costs one shuffle of the rows. ``ties`` makes the
    order total; rows that agree in them too are interchangeable.
    """
    bits = max(0, buckets.bit_length() - 1)
    key = df.withColumn("__o", order)
    key = key.withColumn("__b", F.shiftrightunsigned("__o", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = key.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    # shiftrightunsigned makes __b the order of the unsigned value; so does the flipped sign here
    within = Window.partitionBy(*group, "__b").orderBy(F.col("__o").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), *(ties or []))
    numbered = key.withColumn("__r", F.row_number().over(within) - 1)
    return numbered.join(starts, [*group, "__b"]).withColumn(name, F.col("__at") + F.col("__r")).drop("__o", "__b", "__r", "__at")
