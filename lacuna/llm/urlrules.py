"""URL rules by a sort-merge range join on reversed-host keys.

A host reads backwards in its key, ``net.example.blog.``, so that all hosts below a rule's host form an interval of the
sort order: the keys that start with the rule's key.  These intervals nest or are disjoint.  A sweep over rules and
URLs in one sort order therefore needs, at any URL, only the stack of the rule that started last: the rules whose
intervals were open when it started, and of these the ones still open at the URL.

Everything is DataFrame operations.  URLs and rules are ranged by (key, spread) into cells, a hot host being cut by the
spread; each cell is swept by a window, and what was on the stack where a cell starts comes from the last rule of the
cells before it, one row per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import materialise

RULE_TYPE = "array<struct<size:int,host:int,path:string,rule:string,verdict:string,key:string>>"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, _lower(host)).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.locate("://", url)
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, path).otherwise("")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot; an empty host has an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for every host with rules, the rules of this host and of those above it, longest first.

    ``rules`` has host, path and verdict.  The hosts above a rule are found by an equi-join on the prefixes of its key,
    as many as it has labels.  Nulls count as empty texts; a rule with an empty host fits no host and is left out; of
    rules for the same host and path, the strictest verdict (first in the alphabet, so allow before block) would be
    arbitrary, so the later one in the alphabet, ``block``, holds.
    """
    clean = rules.select(_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host"), "path", F.concat("host", "path").alias("rule"), "verdict", "key"
    )
    own = clean.groupBy("key").agg(F.collect_list(entry).alias("own"))
    labels = F.split("key", r"\.")
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("above"))
    joined = above.join(own.select(F.col("key").alias("above"), "own"), "above")
    return joined.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("own")), asc=False).cast(RULE_TYPE).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", cells: int | None = None) -> DataFrame:
    """Append ``host``, ``path``, ``rule`` and ``verdict`` to every row; columns of the same names are replaced.

    ``rules`` has host, path and verdict.  A rule fits its host and all subdomains if the URL's path starts with the
    rule's path; of the rules that fit, the longest (host and path together, then the host alone) wins, and without one
    the verdict is ``default`` and the rule null.  Null URLs and URLs without ``://`` have empty host and path and fit
    no rule.  Repeated rows are judged alike.  Without rules every URL gets the default.  Only the URL and the other
    columns given are shuffled, so pass few columns.

    ``cells`` is the number of key ranges, by default the session's shuffle partitions.
    """
    spark = pages.sparkSession
    cells = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = pages.drop("host", "path", "rule", "verdict")
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row")
    urls = base.select(host_key(url_host(F.col(url))).alias("key"), F.lit(1).alias("kind"), F.xxhash64(*base.columns).alias("spread"), F.lit(None).cast(RULE_TYPE).alias("stack"), row)
    starts = rule_stacks(rules).select("key", F.lit(0).alias("kind"), F.lit(-(2**63)).cast("long").alias("spread"), "stack", F.lit(None).cast(urls.schema["row"].dataType).alias("row"))
    events = urls.unionByName(starts).repartitionByRange(cells, "key", "kind", "spread").withColumn("cell", F.spark_partition_id())
    events = materialise(events, "urlrules")  # a row's cell must not change between the two uses
    last = events.where("kind = 0").groupBy("cell").agg(F.max_by("stack", "key").alias("carried"))
    held = events.select("cell").distinct().join(last, "cell", "left")  # one row per cell
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("cell", F.last("carried", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("cell").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("started", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").join(F.broadcast(carried), "cell")
    judged = swept.select("row", "key", F.coalesce("started", "carried").alias("stack"), url_path(F.col("row").getField(url)).alias("path"))
    open_rules = F.filter("stack", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    judged = judged.withColumn("found", F.get(open_rules, F.lit(0)))
    own = [F.col("row").getField(c).alias(c) for c in base.columns]
    return judged.select(*own, url_host(F.col("row").getField(url)).alias("host"), "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
