"""Redact a stream: the batch projections, unchanged, with the counts of every micro-batch in a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lacuna.functions.names import unused
from lacuna.operators.governed import redact_by_source
from lacuna.operators.redact import redact_observed
from lacuna.policy import RedactPolicy


def write_redacted(
    stream: DataFrame, policy: RedactPolicy, path: str, checkpoint: str, counts: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Redact everything available into ``path`` and the redactions of each micro-batch into ``counts``.

    Rows and counts of a micro-batch go to folders named after it, so a batch
    that is run again replaces both.  No shuffle and no state store; a restart
    continues from ``checkpoint``.  The folders are called ``batch=...``, or
    longer if the rows have a column of that name; ``read_redacted`` reads the rows alone.
    """
    folder = unused("batch", stream.columns)

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        redact_observed(batch, policy, seen).write.mode("overwrite").format(fmt).save(f"{path}/{folder}={number}")
        names = ", ".join(f"{n} bigint" for n in seen.get)
        row = batch.sparkSession.createDataFrame([tuple(seen.get.values())], names)
        row.write.mode("overwrite").parquet(f"{counts}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_redacted(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows that a redacting stream wrote, with their own columns only."""
    return spark.read.option("recursiveFileLookup", "true").format(fmt).load(path)


def write_redacted_by_source(
    stream: DataFrame,
    source: str,
    rules: Callable[[SparkSession], DataFrame],
    path: str,
    checkpoint: str,
    policy: RedactPolicy | None = None,
) -> StreamingQuery:
    """``redact_by_source`` on everything available, with the rules as they are when a micro-batch runs.

    ``rules`` is called for each micro-batch, so a rule that changes holds from the next one on.  The rules are reduced
    and, if small, broadcast; the rows of the stream are not counted, shuffled or kept in state.
    """
    folder = unused("batch", stream.columns)

    def write(batch: DataFrame, number: int) -> None:
        done = redact_by_source(batch, source, rules(batch.sparkSession), policy=policy)
        done.write.mode("overwrite").parquet(f"{path}/{folder}={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def observed_counts(spark: SparkSession, counts: str) -> DataFrame:
    """One row: the counts of all micro-batches added up."""
    parts = spark.read.parquet(counts).drop("batch")
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
