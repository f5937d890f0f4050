"""Audit of how filters interact: what each removes in every order in which they could run.

Four conditions are read off each text.  The fifth, a copy of an earlier document, is a left-semi self-join on a hash, the
exact text and a smaller id.  The ids it gives are united with those of the other failures, and the combinations of failed
filters are counted per part.  Everything else follows from how many documents pass each subset of the filters.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import materialise
from lacuna.sources.sizing import lookup_join

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: So many documents of one text are looked at in one place.
ROWS_PER_PLACE = 20_000
#: So many hashes of repeated texts, three numbers each, are broadcast at most.
BROADCAST_ROWS = 500_000


def failed_alone(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def bits(words: Column) -> Column:
        few = F.size(words) < 50
        dull = 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long")
        loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long")
        marked = text.rlike(r"[#$%&*|]")
        return sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate((few, dull, loud, marked))), F.lit(0))

    return F.element_at(F.transform(F.array(words), bits), 1)  # the words are taken once


def copies(docs: DataFrame) -> DataFrame:
    """The rows (id, text, hash, ...) whose text is that of a smaller id: a left-semi join on hash, text and smaller id.

    Only hashes that two ids share go into it.  One row of each of their texts, that with the least id, stands for the
    smaller ids, and meets the documents of a frequent text in several places.
    """
    ids = docs.where("id IS NOT NULL")
    shared = ids.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("greatest"), F.count(F.lit(1)).alias("rows")).where("least < greatest")
    shared = materialise(shared.select("hash", "least", F.ceil(F.col("rows") / ROWS_PER_PLACE).alias("places")), "audit-shared")
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = ids.join(F.broadcast(shared) if few else shared, "hash")
    smaller = met.groupBy("hash", "text").agg(F.min("id").alias("id"), F.max("places").alias("places"))
    smaller = smaller.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1))).alias("s")
    later = met.where("id > least").withColumn("place", F.pmod(F.xxhash64("id"), F.col("places"))).alias("d")
    same = (F.col("d.hash") == F.col("s.hash")) & (F.col("d.place") == F.col("s.place")) & (F.col("d.text") == F.col("s.text"))
    return later.join(smaller, same & (F.col("s.id") < F.col("d.id")), "left_semi")


def combinations(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, failed, good, toxic, documents): the documents by the bits of the filters they fail and by their labels."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id}`").alias("id"), content.alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    base = base.withColumn("hash", F.xxhash64("text"))
    alone = base.select("id", "hash", "part", failed_alone(F.col("text")).alias("failed"), F.lit(1).cast("long").alias("documents"))
    again = copies(base).select("id", "hash", "part", F.lit(16).alias("failed"), F.lit(0).cast("long").alias("documents"))
    failed = alone.unionByName(again).groupBy("id", "hash", "part").agg(F.bit_or("failed").alias("failed"), F.sum("documents").alias("documents"))
    failed = materialise(failed.drop("hash"), "audit-failed")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    judged = lookup_join(failed.where("id IS NOT NULL"), marks, "id").unionByName(failed.where("id IS NULL"), allowMissingColumns=True)
    never = F.lit(False)
    judged = judged.withColumns({"good": F.coalesce("good", never), "toxic": F.coalesce("toxic", never)})
    return judged.groupBy("part", "failed", "good", "toxic").agg(F.sum("documents").alias("documents"))


def steps() -> list[dict]:
    """All orders of the filters, step by step: the bits before the step and that of its filter."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            out.append({"filter_order": "".join(order), "step": k + 1, "before": before, "bit": bit})
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, filter order and step: what the step's filter keeps and removes.

    The filters: A under 50 words, B under 65 % distinct words, C over 5 % capitals A-Z, D one of ``#$%&*|``, E a text equal
    to that of a smaller id.  Counts per part: ``kept`` and ``removed`` by the step, ``redundant`` (the filter's failures that
    went before), ``unique_fails`` (failures of this filter only), ``good_lost`` and ``toxic_lost`` (removed ones labelled
    so), ``shapley`` (the filter's removals added up over all orders).

    A null text is empty and equal to empty texts; a null id is neither smaller nor larger than any; a null part is the empty
    string.  Repeated rows count each time and are no copies of each other.  Several labels of an id count as the
    highest.  Other columns are not read.  An empty table gives no row.
    """
    found = combinations(docs, labels, id, text, part)
    subsets = range(1 << len(FILTERS))
    weights = {"kept": F.col("documents"), "good": F.when(F.col("good"), F.col("documents")), "toxic": F.when(F.col("toxic"), F.col("documents"))}
    passing = [
        F.array(*[F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(s) == 0, w)), F.lit(0)).cast("long") for s in subsets]).alias(f"{name}_by")
        for name, w in weights.items()
    ]
    parts = found.groupBy("part").agg(*passing)
    order = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    rows = parts.select("*", F.explode(order).alias("at")).select("part", *[f"{name}_by" for name in weights], "at.*")

    def passes(name: str, subset: Column) -> Column:
        return F.element_at(f"{name}_by", subset + 1)

    before, bit = F.col("before"), F.col("bit")
    after = before + bit
    last = len(FILTERS) - 1
    shapley = sum(
        (
            F.when(bit.bitwiseAND(s) == 0, factorial(s.bit_count()) * factorial(last - s.bit_count()) * (passes("kept", F.lit(s)) - passes("kept", F.lit(s).bitwiseOR(bit)))).otherwise(0)
            for s in subsets
            if s.bit_count() <= last
        ),
        F.lit(0).cast("long"),
    )
    removed = passes("kept", before) - passes("kept", after)
    every = len(subsets) - 1
    return rows.select(
        "part", "filter_order", "step",
        passes("kept", after).alias("kept"),
        removed.alias("removed"),
        (passes("kept", F.lit(0)) - passes("kept", bit) - removed).alias("redundant"),
        (passes("kept", every - bit) - passes("kept", F.lit(every))).alias("unique_fails"),
        (passes("good", before) - passes("good", after)).alias("good_lost"),
        (passes("toxic", before) - passes("toxic", after)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
