"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.sources.sizing import shared_base


def ship_by_value(module: str) -> None:
    """Send a module's functions to the workers by value, so that they need not find the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)

#: A filter of hashes has so many bits for each, and 2 to this power at most; beyond, it lets more through.
FILTER_BITS = 8
FILTER_POWER = 30
FILTER_BLOCKS = 64


def worker_state() -> dict:
    """What a worker process keeps from task to task; functions sent by value have no globals of their own there."""
    return sys.modules.setdefault("_lacuna_worker_state", types.ModuleType("_lacuna_worker_state")).__dict__


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors reach: below ``spark.checkpoint.dir``, else below the warehouse."""
    base = shared_base(spark)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While jobs run inside, Arrow batches have so many rows at most, which bounds the memory of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True for rows that no model may learn from; a null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(True))


def map_arrow(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Append columns computed per Arrow batch; columns of the same names are replaced.

    ``make`` runs once per task and returns the function that gives the new columns of a batch, in order.
    """
    kept = df.drop(*[f.name for f in fields])
    names = [*kept.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            compute = compute or make()
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch)], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


class HashFilter:
    """A bit for each of many hashes, by their leading bits; without false negatives."""

    def __init__(self, bits: np.ndarray, power: int):
        self.bits, self.power = bits, power

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.power)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def hash_filter(hashes: DataFrame) -> HashFilter:
    """The filter of a table of one column, 64-bit hashes, sized by their number; each block of it is made by one task."""
    n, (name,) = hashes.count(), hashes.columns
    power = min(FILTER_POWER, max(16, (FILTER_BITS * max(1, n) - 1).bit_length()))
    shift = power - (FILTER_BLOCKS - 1).bit_length()

    def fill(table: pa.Table) -> pa.Table:
        at = (table.column(name).to_numpy().view(np.uint64) >> np.uint64(64 - power)).astype(np.int64) & ((1 << shift) - 1)
        bits = np.zeros(1 << shift, bool)
        bits[at] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    blocks = hashes.withColumn("block", F.shiftrightunsigned(name, 64 - power + shift).cast("int")).groupBy("block").applyInArrow(fill, "block int, bits binary")
    bits = np.zeros((FILTER_BLOCKS, 1 << (shift - 3)), np.uint8)
    for row in blocks.collect():  # as large as the filter
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return HashFilter(bits.ravel(), power)
