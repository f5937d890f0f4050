"""Audit entries as streams: roll-ups in event-time windows, sessions, replays dropped, queries matched with outcomes.

Two ways to count in windows.  ``write_rollup`` keeps no state and counts every entry, however late.  ``write_closed_rollup``
keeps open windows in the state store, gives each window once, when the watermark has passed it, and drops entries that
come after that; ``late_entries`` tells how many these were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_KEYS = ("window_start", "database", "status")


def windowed_rollup(audit: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Queries and redactions per tumbling window, database and status; batch or stream.

    In a stream, state holds only the windows the watermark has not closed,
    and each micro-batch is combined per task before it is shuffled.
    """
    timed = audit.withWatermark("ts", lateness) if audit.isStreaming else audit
    return (
        timed.groupBy(F.window("ts", window).alias("w"), "database", "status")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.coalesce(F.sum("redactions"), F.lit(0)).cast("bigint").alias("redactions"),
        )
        .select(F.col("w.start").alias("window_start"), "database", "status", "queries", "redactions")
    )


def write_rollup(audit: DataFrame, path: str, checkpoint: str, window: str = "1 hour") -> StreamingQuery:
    """Roll up a stream of audit entries; runs until the input is used up.

    Each micro-batch writes its own partial sums to a folder named after the
    batch, so a batch that is run again replaces what it wrote.  Nothing is
    kept in state: open windows are there at once, and an entry, however late,
    counts in its window.  ``read_rollup`` adds the parts up.
    """

    def write(batch: DataFrame, number: int) -> None:
        windowed_rollup(batch, window).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = audit.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Every window seen so far, closed or open."""
    parts = spark.read.parquet(path)
    sums = [F.sum(c).alias(c) for c in ("queries", "redactions")]
    return parts.groupBy(*_KEYS).agg(*sums)


def _run(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a stateful stream gives, each micro-batch to its own folder, so that one run again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """Everything a stateful stream has given so far."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


CLOSING_TIME = "9000-01-01"


def closing_entry(spark: SparkSession, schema: T.StructType, at: str = "ts", **values: object) -> DataFrame:
    """One entry far in the future with its time, and ``values`` for some columns; all others are null.

    Delivered behind the last entry of a finished log, it moves the watermark past every window, session and match.  Its
    own window never closes, so it is in no roll-up.  A stream that is joined by a key needs one in each closing entry,
    as rows without a key are taken out before the watermark sees them; a stream that hands rows on hands it on too, to
    be left out by its time.
    """
    given = {at: CLOSING_TIME, **values}
    cells = [F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).select(*cells)


def write_closed_rollup(
    audit: DataFrame, path: str, checkpoint: str, window: str = "1 hour", lateness: str = "10 minutes"
) -> StreamingQuery:
    """Roll up a stream and write each window once it is closed; runs until the input is used up.

    A window is closed when an entry ``lateness`` behind its end was seen in an earlier micro-batch.  Later entries of it
    are dropped.  State holds the open windows only.
    """
    return _run(windowed_rollup(audit, window, lateness), path, checkpoint)


def late_entries(seen: DataFrame, closed: DataFrame) -> DataFrame:
    """Entries that came after their window had closed: by window, database and status, their number and redactions.

    ``seen`` is what ``write_rollup`` counted of the same input, ``closed`` what ``write_closed_rollup`` gave.  Windows
    behind the last closed one are open, so nothing of theirs is late yet.
    """
    last = closed.agg(F.max("window_start").alias("last"))
    ours, theirs = seen.alias("s"), closed.alias("c")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in _KEYS]
    both = ours.join(theirs, same[0] & same[1] & same[2], "left").join(F.broadcast(last))  # one row
    missing = {n: F.col(f"s.{n}") - F.coalesce(F.col(f"c.{n}"), F.lit(0)) for n in ("queries", "redactions")}
    found = both.where(F.col("s.window_start") <= F.col("last"))
    return found.select(*[F.col(f"s.{k}") for k in _KEYS], *[c.alias(n) for n, c in missing.items()]).where("queries > 0")


def session_rollup(audit: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """``sessions`` by database of a stream: database, started, ended, queries, redactions.

    State holds the sessions that may still grow or merge; a session is given when no entry can join it any more.
    """
    merged = audit.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "database")
    totals = merged.agg(
        F.max("ts").alias("ended"), F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("redactions"), F.lit(0)).cast("bigint").alias("redactions")
    )
    return totals.select("database", F.col("w.start").alias("started"), "ended", "queries", "redactions")


def write_sessions(audit: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> StreamingQuery:
    """Write each session once it has ended; runs until the input is used up."""
    return _run(session_rollup(audit, gap, lateness), path, checkpoint)


def without_replays(entries: DataFrame, key: Sequence[str], lateness: str = "10 minutes") -> DataFrame:
    """The first entry of every key: what an input that delivers at least once holds once.

    In a stream a key is remembered for ``lateness`` behind its first entry, so state does not grow with the log; a replay
    after that counts as new, and an entry that late is dropped by the watermark.  Entries without a time or key count
    as one key each way.
    """
    if not entries.isStreaming:
        return entries.dropDuplicates(list(key))
    return entries.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(key))


def write_without_replays(entries: DataFrame, key: Sequence[str], path: str, checkpoint: str, lateness: str = "10 minutes") -> StreamingQuery:
    """Write every entry once, however often it is delivered; runs until the input is used up."""
    return _run(without_replays(entries, key, lateness), path, checkpoint)


def match_outcomes(log: DataFrame, outcomes: DataFrame, within: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Every query of a log with the outcomes that its ``query_id`` has within the time, or with none.

    ``log`` has query_id, ts and database, ``outcomes`` query_id, ts and status.  In a stream, state holds the queries whose time
    is not over and the outcomes that came before their query; both go when the watermark of the slower side has
    passed them, and a query without an outcome is given then.
    """
    if log.isStreaming:
        log, outcomes = log.withWatermark("ts", lateness), outcomes.withWatermark("ts", lateness)
    asked, answered = log.alias("q"), outcomes.alias("o")
    bounded = (F.col("o.ts") >= F.col("q.ts")) & (F.col("o.ts") <= F.col("q.ts") + F.expr(f"INTERVAL '{within}'"))
    met = asked.join(answered, (F.col("q.query_id") == F.col("o.query_id")) & bounded, "left_outer")
    return met.select("q.query_id", "q.ts", "q.database", F.col("o.ts").alias("answered"), "o.status")


def write_matches(log: DataFrame, outcomes: DataFrame, path: str, checkpoint: str, within: str = "10 minutes", lateness: str = "10 minutes") -> StreamingQuery:
    """Write the matches of two streams; runs until both are used up."""
    return _run(match_outcomes(log, outcomes, within, lateness), path, checkpoint)
