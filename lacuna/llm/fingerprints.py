"""Fingerprints of documents: a Merkle tree over sections, paragraphs and runs of words, in native expressions.

A section ends behind blank lines, a paragraph behind a line end, a leaf after four words or a word with punctuation at its
end.  All of them together are the text.  A leaf's digest is SHA-256 of its text, that of every node above SHA-256 of the
digests below in hexadecimal, so equal roots mean equal texts, and branches with unequal digests lead to what differs.

A fingerprint is written ``root|section:paragraph=leaf,leaf;paragraph=leaf|section:...``: the whole digest of the root, eight
digits of sections and paragraphs, six of leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import materialise

#: Where a section ends, what a paragraph is, and a leaf: up to four words of 64 characters, or blanks alone.
SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
BLANK, NO_BLANK, PLAIN = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D.!?,;:]"
LEAF = rf"{BLANK}*(?:{NO_BLANK}{{0,63}}{PLAIN}{BLANK}+){{0,3}}{NO_BLANK}{{1,64}}{BLANK}*|{BLANK}+"
LEAF_DIGITS, NODE_DIGITS = 6, 8
#: Rows of one key may lie in so many ranges.
COPY_PARTS = 64
#: The bounds of ranges are searched in steps of so many.
STEP = 256


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _paragraph(leaves: Column) -> Column:
    prints = F.array_join(F.transform(leaves, lambda d: F.substring(d, 1, LEAF_DIGITS)), ",")
    return _once(_digest(leaves), lambda d: F.struct(d.alias("digest"), F.concat(F.substring(d, 1, NODE_DIGITS), F.lit("="), prints).alias("body")))


def _section(paragraphs: Column) -> Column:
    digests = F.transform(paragraphs, lambda p: p["digest"])
    body = F.array_join(F.transform(paragraphs, lambda p: p["body"]), ";")
    return _once(_digest(digests), lambda d: F.struct(d.alias("digest"), F.concat(F.substring(d, 1, NODE_DIGITS), F.lit(":"), body).alias("body")))


def _tree(text: Column) -> Column:
    sections = F.filter(F.split(text, SECTION_END, -1), lambda s: s != "")
    paragraphs = F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)))
    leaves = F.transform(paragraphs, lambda s: F.transform(s, lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))))
    return F.transform(leaves, lambda s: _section(F.transform(s, _paragraph)))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    tree = _tree(F.coalesce(text.cast("string"), F.lit("")))
    return _once(tree, lambda t: F.concat(_digest(F.transform(t, lambda s: s["digest"])), F.array_join(F.transform(t, lambda s: F.concat(F.lit("|"), s["body"])), "")))


def root(print_: Column) -> Column:
    """The root's digest; equal for equal texts only."""
    return F.substring(print_, 1, 64)


def _leaves(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(print_, F.lit(rf"[=,]([0-9a-f]{{{LEAF_DIGITS}}})"), F.lit(1)))


def likeness(left: Column, right: Column) -> Column:
    """1 if the roots are equal, else twice the distinct leaves that both have by those of each: from 0 to 1."""
    pair = F.struct(_leaves(left).alias("l"), _leaves(right).alias("r"))

    def share(p: Column) -> Column:
        both = F.size(p["l"]) + F.size(p["r"])
        return F.when(both > 0, 2.0 * F.size(F.array_intersect(p["l"], p["r"])) / both).otherwise(0.0)

    return F.when(root(left) == root(right), F.lit(1.0)).otherwise(_once(pair, share))


def changed_paragraphs(left: Column, right: Column) -> Column:
    """Where ``left`` differs from ``right``: (section, paragraph), from 0, of its paragraphs that ``right`` does not have.

    Only sections that ``right`` does not have are looked into.
    """
    digits = rf"[0-9a-f]{{{NODE_DIGITS}}}"
    others = F.regexp_extract_all(right, F.lit(rf"\|({digits}):"), F.lit(1))
    known = F.regexp_extract_all(right, F.lit(rf"[:;]({digits})="), F.lit(1))
    sections = F.slice(F.split(left, r"\|"), 2, 1 << 30)

    def inside(section: Column, at: Column) -> Column:
        found = F.transform(
            F.regexp_extract_all(section, F.lit(rf"[:;]({digits})="), F.lit(1)),
            lambda p, k: F.when(~F.array_contains(known, p), F.struct(at.alias("section"), k.alias("paragraph"))),
        )
        return F.when(F.array_contains(others, F.substring(section, 1, NODE_DIGITS)), F.slice(found, 1, 0)).otherwise(F.filter(found, lambda x: x.isNotNull()))

    return F.flatten(F.transform(sections, inside))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All rows and columns with the fingerprint of the text; a column of its name is replaced.  One projection."""
    return docs.withColumn(name, fingerprint(F.col(f"`{text}`")))


def with_next(docs: DataFrame, key: list[str], carried: str) -> DataFrame:
    """Every row with ``carried`` of the next one in order of ``key``, as column ``next``; the first follows the last.

    The keys alone are sorted into ranges, whose first keys are the bounds.  Every row then goes, once, to the task of its
    range, and so does a copy of the first row of the range behind, so that the last row of a range sees its follower.
    Rows of one key are spread over ranges, which is right as rows equal in key are equal in ``carried`` too.
    """
    spark = docs.sparkSession
    order = [F.asc_nulls_first(k) for k in [*key, "_copy"]]
    keyed = docs.withColumn("_copy", F.pmod(F.monotonically_increasing_id(), F.lit(COPY_PARTS)))
    own = F.struct(*key, "_copy")
    ranges = keyed.select(*key, "_copy").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    first = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.min(own).alias("first"))
    bounds = materialise(first.agg(F.sort_array(F.collect_list("first")).alias("bounds")), "range-bounds")  # one for each range
    found = F.expr(
        f"size(filter(slice(bounds, (top - 1) * {STEP} + 1, {STEP}), b -> b <= own)) + (top - 1) * {STEP}"
    )
    marked = keyed.withColumns({"own": own, "bounds": bounds.scalar()})
    marked = marked.withColumn("top", F.expr(f"greatest(1, size(filter(sequence(1, greatest(1, size(bounds)), {STEP}), i -> bounds[i - 1] <= own)))"))
    rows = marked.withColumn("_range", found).drop("own", "bounds", "top")
    # Behind each range stands a guest, the first row of the next range.
    guest = bounds.select(F.size("bounds").alias("n"), F.posexplode("bounds").alias("place", "first"))
    guest = guest.select(F.when(F.col("place") == 0, F.col("n")).otherwise(F.col("place")).alias("_range"), *[F.col(f"first.{k}").alias(f"_first_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_first_{k}"))
    guests = docs.join(F.broadcast(guest), same).groupBy("_range").agg(F.first(carried).alias(carried))
    both = rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)), allowMissingColumns=True)
    follower = F.lead(carried).over(Window.partitionBy("_range").orderBy("_guest", *order))
    return both.withColumn("next", follower).where(~F.col("_guest")).drop("_copy", "_range", "_guest")


def compare_with_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed.

    The edited text has its last quarter, rounded down, replaced by as many first characters of the next document, or all
    if it has fewer.  Next is by id, then by a hash of the text; after the last comes the first, so a single document is
    its own.  ``changed`` has the paragraphs of the text that the edited one does not have.

    Null texts are empty, null ids come first, repeated rows follow each other.  Other columns are not read.  An empty
    table gives no row.
    """
    bare = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = with_next(bare.withColumn("hash", F.xxhash64("text")), ["id", "hash"], "text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited"))
    prints = {"fingerprint": "text", "edited_fingerprint": "edited", "follower": "next"}
    rows = rows.select("id", "n_chars", "edited", *[fingerprint(F.col(t)).alias(p) for p, t in prints.items()])
    own, other = F.col("fingerprint"), F.col("edited_fingerprint")
    return rows.select(
        F.col("id").alias(id), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(own, other).alias("near_edited"), likeness(own, F.col("follower")).alias("near_next"), changed_paragraphs(own, other).alias("changed"),
    )
