"""Sessions of audit entries: runs of entries of a group without a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_MINUTES = 30


def sessions(entries: DataFrame, gap_minutes: int = GAP_MINUTES, by: Sequence[str] = ("database",), at: str = "ts") -> DataFrame:
    """``by``, started, ended (the last entry), queries and redactions of every session; batch only.

    An entry belongs to the session before it if it comes within the gap.  Entries without a time are left out; a null
    group is a group.  Entries of one group and one slot of the gap's length are in one session, so they are combined
    in each task, and only slots are put in order: a group costs as many rows as its time has slots, not as it has entries.
    """
    micros = gap_minutes * 60_000_000
    time = F.unix_micros(F.col(at).cast("timestamp"))
    timed = entries.where(F.col(at).isNotNull()).withColumn("_slot", F.floor(time / micros))
    slots = timed.groupBy(*by, "_slot").agg(
        F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum("redactions"), F.lit(0)).cast("bigint").alias("redactions"),
    )
    order = Window.partitionBy(*by).orderBy("_slot")
    quiet = F.unix_micros(F.col("started").cast("timestamp")) - F.unix_micros(F.lag("ended").over(order).cast("timestamp"))
    first = slots.withColumn("_first", F.coalesce((quiet > micros).cast("int"), F.lit(1)))
    numbered = first.withColumn("_session", F.sum("_first").over(order))
    return numbered.groupBy(*by, "_session").agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("queries").alias("queries"), F.sum("redactions").alias("redactions")
    ).drop("_session")
