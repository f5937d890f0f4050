"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.names import unused
from lacuna.llm.common import map_arrow, ship_by_value

ship_by_value(__name__)

#: Every shard is numbered in so many parts, so that no task holds a whole shard.
PARTS = 64
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """int32 shard of each 64-bit key, by Lamping and Veach's "A Fast, Minimal Memory, Consistent Hash Algorithm".

    A key walks over the shard counts at which it would move and stays at the last one below ``shards``; a key moves
    at count n + 1 with probability 1 / (n + 1), and only into the new shard.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at, to = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = to[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = 2147483648.0 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        to[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[to[live] < shards]
    return at.astype(np.int32)


def with_shards(df: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """Append for each (column, number of shards) the shard of ``key``; columns of the same names are replaced.

    Integer keys are hashed as they are, others by xxhash64 of their text; a null key always goes where 0 goes.
    """
    plain = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = F.col(f"`{key}`").cast("long") if plain else F.xxhash64(F.col(f"`{key}`").cast("string"))
    own = unused("_key", df.columns, counts)
    base = df.drop(*counts).withColumn(own, F.coalesce(number, F.lit(0).cast("long")))
    position = base.columns.index(own)

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            keys = batch.column(position).to_numpy()
            return [pa.array(jump_hash(keys, n)) for n in counts.values()]

        return compute

    return map_arrow(base, [T.StructField(name, T.IntegerType()) for name in counts], make).drop(own)


def with_slots(df: DataFrame, shard: str, order: list[str], parts: int = PARTS) -> DataFrame:
    """Append ``slot``: the row's place in its shard, gapless from 0.

    A shard is numbered in ``parts`` parts by a hash of the ordering columns.  The counts of the parts, shards x parts
    rows, give every part its first slot; within a part the order decides.  Rows equal in all ordering columns get
    consecutive slots in any order.
    """
    cells = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = cells.groupBy(shard, "_part").count()
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*order)) - 1
    numbered = cells.withColumn("_within", within).join(F.broadcast(first), (F.col(shard) == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return numbered.withColumn("slot", F.col("_first") + F.col("_within")).drop("_s", "_p", "_part", "_first", "_within")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16, ``text_crc32`` its CRC-32 (null: that of nothing).
    ``grown_shard`` is the shard with one shard more: the same, or the new one.  Rows with one key, hot or not, share a
    shard and are numbered in parts.  Only the key, the size and the checksum are shuffled.  An empty table gives none.
    """
    bare = docs.select(F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = with_shards(bare, key, {"shard": shards, "grown_shard": shards + 1}).withColumn("law", F.lit("key"))
    return with_slots(placed, "shard", [key, "text_crc32", "size"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, key: str = "doc_id") -> None:
    """Write the rows with all their columns below ``path``, one folder ``shard=n`` for each shard that has rows."""
    with_shards(docs, key, {"shard": shards}).write.partitionBy("shard").parquet(path)
