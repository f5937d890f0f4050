"""Size checks that decide between physical strategies before a job runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Below this many bytes per core a scan yields less than one split per core.
SMALL_BYTES_PER_CORE = 4 * 1024 * 1024
# A lookup side is broadcast only when it was counted and has at most this many rows ...
BROADCAST_MAX_ROWS = 200_000
# ... and at most this many characters of text in its widest form.
BROADCAST_MAX_CHARS = 64 * 1024 * 1024
# A limit collects its candidates from at most this many tasks.
TOP_N_TASKS = 10_000


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate (no job); None where it is not exposed."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def is_small(df: DataFrame, bytes_per_core: int = SMALL_BYTES_PER_CORE) -> bool:
    """True if the input is estimated to hold at most this much per core."""
    size = estimated_bytes(df)
    return size is not None and size <= df.sparkSession.sparkContext.defaultParallelism * bytes_per_core


def spread_small(df: DataFrame) -> DataFrame:
    """Give every core work when the input is a few small files.

    A small Parquet file is read by one task, which starves CPU-heavy
    projections.  Only inputs below ``SMALL_BYTES_PER_CORE`` per core are
    redistributed; anything larger already has more splits than cores and is
    never shuffled.
    """
    if df.isStreaming or not is_small(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def fits_broadcast(df: DataFrame) -> bool:
    """Count a lookup side and measure its text: True if it is proven small.

    One aggregate, combined per task: a large side costs a scan and moves one row per task.
    """
    size = F.lit(0)
    for f in df.schema.fields:
        size = size + F.coalesce(F.length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("chars")).first()
    return row["n"] <= BROADCAST_MAX_ROWS and (row["chars"] or 0) <= BROADCAST_MAX_CHARS


def few_tasks(df: DataFrame) -> DataFrame:
    """At most ``TOP_N_TASKS`` tasks ahead of a limit.

    A limit sends up to n rows from every task to one; merging partitions
    without a shuffle bounds that on tables of a million splits and changes
    nothing on smaller ones.
    """
    return df.coalesce(TOP_N_TASKS)


def pinned(df: DataFrame) -> DataFrame | None:
    """A small table as a local one, worked out by one job; None if it is beyond the bounds of a broadcast.

    At most ``BROADCAST_MAX_ROWS + 1`` rows reach the driver.
    """
    if not fits_broadcast(df):
        return None
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def lookup_join(
    big: DataFrame, small: DataFrame, key: str, how: str = "left", hot_share: float = 0.01, fits: bool | None = None
) -> DataFrame:
    """Left or inner join of ``big`` to a table with one row per ``key``.

    Proven small (or known to be by ``fits``): broadcast, no shuffle of
    ``big``.  Otherwise the keys are counted; a key with more than
    ``hot_share`` of the rows is hot, and there are at most 1 / ``hot_share``
    of them.  The lookup rows of the hot keys are therefore few and are
    broadcast, while all other rows join by shuffle.  Rows with a null key
    have no lookup row and are not shuffled.  Both ways give the same rows.
    """
    if fits_broadcast(small) if fits is None else fits:
        return big.join(F.broadcast(small), key, how)
    there = F.col(key).isNotNull()
    counts = big.where(there).groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("count") > hot_share * total).select(key).collect()]
    known = big.where(there)
    if hot:
        is_hot = F.col(key).isin(hot)
        spread = known.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how)
        joined = spread.unionByName(known.where(~is_hot).join(small, key, how))
    else:
        joined = known.join(small, key, how)
    if how != "left":
        return joined
    return joined.unionByName(big.where(~there), allowMissingColumns=True)


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """From now on the session's Arrow batches have so many rows at most: whole texts take memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    if before <= 0 or before > rows:
        spark.conf.set(name, str(rows))


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the warehouse, which on a cluster must not be a local path then."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if (base.startswith(("/", "file:")) or ":" not in base) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, else below the warehouse: storage every executor can reach."""
    return f"{shared_base(spark)}/lacuna/{purpose}-{uuid.uuid4().hex}"
