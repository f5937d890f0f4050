"""As-of join: for each row the version that was in force at its time.

Rows and versions are united and swept in order of time, each cell of a key and a bucket of time by itself.  What a cell
inherits from earlier ones is worked out from the versions alone and enters it as one more version, so no cell waits for
another.  A cell with many rows is spread over several places, to each of which its versions go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.nested import name

#: Time is cut into so many buckets between the first and the last version.
BUCKETS = 256
#: A cell with more rows is spread over places of about so many.
ROWS_PER_PLACE = 200_000


def _number(c: Column, dtype: T.DataType) -> Column:
    """A time as a number; times with and without zone in microseconds."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    return c


def as_of_join(
    rows: DataFrame,
    versions: DataFrame,
    key: str | None,
    at: str,
    version_key: str | None,
    since: str,
    values: Sequence[str],
    rows_per_place: int | None = None,
) -> DataFrame:
    """All rows and columns of ``rows`` with ``values`` of the version of its key with the latest ``since`` up to ``at``.

    Rows before the first version of their key, and rows with a null key or time, get nulls.  Versions with a null key or
    time hold for no row.  Of versions with one key and time the greatest by ``values`` holds, so these have an order (no
    maps).  With ``key`` and ``version_key`` None all versions hold for all rows.  Columns of ``rows`` named like
    ``values`` are replaced.

    The rows are shuffled once, to their cell.  Only bounds, counts of hot cells and the versions travel besides.
    """
    limit = rows_per_place or ROWS_PER_PLACE
    frame = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    place_of = {n: f"c{i}" for i, n in reversed(list(enumerate(rows.columns)))}
    one = F.lit("")
    time = _number(F.col(place_of[at]), frame.schema[place_of[at]].dataType)
    left = frame.select((F.col(place_of[key]) if key else one).alias("k"), time.alias("t"), F.struct("*").alias("row"))
    began = _number(F.col(name(since)), versions.schema[since].dataType)
    value = F.struct(*[F.col(name(v)).alias(f"v{i}") for i, v in enumerate(values)])
    right = versions.select((F.col(name(version_key)) if version_key else one).alias("k"), began.alias("t"), value.alias("value"))
    right = right.where("k IS NOT NULL AND t IS NOT NULL").groupBy("k", "t").agg(F.max("value").alias("value"))

    bounds = right.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    lo, hi = (bounds["lo"], bounds["hi"]) if bounds["lo"] is not None else (0, 0)
    width = max((hi - lo) / BUCKETS, 1e-9)
    bucket = F.greatest(F.least(F.floor((F.col("t") - F.lit(lo)) / F.lit(width)), F.lit(BUCKETS)), F.lit(-1)).cast("int")
    left, right = left.withColumn("b", bucket), right.withColumn("b", bucket)

    plain = [F.col(f"row.{f.name}") for f in frame.schema.fields if isinstance(f.dataType, T.AtomicType)]
    timed = F.col("k").isNotNull() & F.col("t").isNotNull()
    dated = left.where(timed)
    cells = dated.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"))
    hot = cells.where(F.col("n") > limit).select("k", "b", F.ceil(F.col("n") / limit).cast("int").alias("places"))
    hot = F.broadcast(hot)  # at most one cell per ``limit`` rows
    spread = dated.join(hot, ["k", "b"], "left").withColumn("place", F.coalesce(F.pmod(F.xxhash64("t", *plain), F.col("places")), F.lit(0)).cast("int"))
    spread = spread.select("k", "b", "place", "t", F.lit(2).alias("kind"), F.col("row"), F.lit(None).cast(right.schema["value"].dataType).alias("value"))

    # The last version of every earlier bucket of the key, for the cells that rows are in.
    own = right.groupBy("k", "b").agg(F.max_by("value", "t").alias("last"))
    every = cells.select("k", "b").unionByName(own.select("k", "b")).distinct().join(own, ["k", "b"], "left")
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    brought = every.withColumn("value", F.last("last", ignorenulls=True).over(earlier)).where("value IS NOT NULL")
    entering = brought.select("k", "b", F.lit(None).cast(right.schema["t"].dataType).alias("t"), F.lit(0).alias("kind"), "value")
    known = entering.unionByName(right.select("k", "b", "t", F.lit(1).alias("kind"), "value"))
    known = known.join(hot, ["k", "b"], "left").withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1))).drop("places")

    sweep = Window.partitionBy("k", "b", "place").orderBy(F.asc_nulls_first("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = spread.unionByName(known, allowMissingColumns=True)
    found = both.withColumn("value", F.last("value", ignorenulls=True).over(sweep)).where("kind = 2").select("row", "value")
    never = left.where(~timed).select("row", F.lit(None).cast(right.schema["value"].dataType).alias("value"))
    out = found.unionByName(never)
    replaced = {v.lower() for v in values}
    kept = [F.col(f"row.c{i}").alias(n) for i, n in enumerate(rows.columns) if n.lower() not in replaced]
    return out.select(*kept, *[F.col(f"value.v{i}").alias(v) for i, v in enumerate(values)])
