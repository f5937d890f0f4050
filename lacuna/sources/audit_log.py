"""The audit table on storage: JSON lines (or Parquet), append only, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lacuna.functions.wire import wire_json

AUDIT_SCHEMA = (
    "ts timestamp, database string, status string, sql string, reason string, error string, "
    "rows bigint, redactions bigint, truncated boolean, duration_ms double"
)


def parse_audit_lines(lines: DataFrame, column: str = "value", schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Audit rows from text lines; blank lines and lines that are not a JSON object are skipped.

    A field whose value has another type than the schema's is null, and the
    rest of its entry stays.  Works on a stream as well.
    """
    text = F.col(column)
    # As a map of texts, every JSON object can be read, whatever its fields hold.
    is_entry = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull()
    entry = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return lines.where(is_entry).select(entry.alias("e")).select("e.*")


def read_audit(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Every well-formed entry below ``path``."""
    return parse_audit_lines(spark.read.text(path), schema=schema)


def stream_audit(
    spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    """Entries as files arrive below ``path``."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_audit_lines(reader.text(path), schema=schema)


def append_audit(audit: DataFrame, path: str, fmt: str = "json") -> None:
    """Append audit rows.  JSON keeps microseconds and writes nulls out."""
    if fmt == "json":
        wire_json(audit, "value").write.mode("append").text(path)
    else:
        audit.write.mode("append").format(fmt).save(path)


def stream_to_audit(audit: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Append a stream of audit rows, each exactly once; runs until the input is used up."""
    rows = wire_json(audit, "value") if fmt == "json" else audit
    writer = rows.writeStream.format("text" if fmt == "json" else fmt).outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
