"""A filter of hashes as one array of longs, built and asked with native expressions.

It keeps most rows without a partner from being shuffled for a join, however large the other side is.  It never says no to
a hash that it holds, so the join behind it gives the same rows with any size of filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the most longs that a filter has (8 MB); beyond, it lets more through.
BITS = 10
MOST_LONGS = 1 << 20


def bloom_filter(hashes: DataFrame) -> DataFrame:
    """One row with the filter ``bits`` of a table of one column, 64-bit hashes, sized by their number.

    The longs are made in as many tasks as there are partitions and put in order in one, which gets at most
    ``MOST_LONGS`` of them.
    """
    (name,) = hashes.columns
    n = hashes.count()
    longs = min(MOST_LONGS, max(16, 1 << max(0, (BITS * n // 64)).bit_length()))
    place, bit = _place(F.col(name), F.lit(longs))
    made = hashes.select(place.alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    dense = hashes.sparkSession.range(longs).withColumnRenamed("id", "place").join(made, "place", "left")
    both = dense.agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    return both.select(F.col("all.bits").alias("bits"))


def _place(value: Column, longs: Column) -> tuple[Column, Column]:
    return F.pmod(F.shiftrightunsigned(value, 6), longs).cast("int"), F.pmod(value, F.lit(64)).cast("int")


def may_hold(bits: Column, value: Column) -> Column:
    """Whether the filter may hold the hash; true for every hash that it was made of."""
    place, bit = _place(value, F.size(bits))
    return F.call_function("shiftright", F.get(bits, place), bit).bitwiseAND(F.lit(1).cast("long")) == 1
