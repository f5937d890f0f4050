"""A corpus pipeline of five stages, each an operator of ``lacuna.llm``; its tables go through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, jaccard, langid, linededup, packing
from lacuna.llm.common import held_out, materialise
from lacuna.llm.queries import END_ID, TOKENIZER
from lacuna.sources.sizing import bounded_batches

#: A document is rejected if its best language has less than this share of its n-grams.
LEAST_LANGUAGE_SCORE = 0.5
#: Documents are near duplicates from this Jaccard similarity, in a hundred, of their sets of so many words' shingles.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def _aside(docs: DataFrame, *added: str) -> DataFrame:
    """The documents with the columns renamed that are called like those that an operator adds."""
    return docs.withColumnsRenamed({c: f"{c}_of_input_{i}" for i, c in enumerate(docs.columns) if c in added})


def _back(kept: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns of the documents, each as it went in."""
    names = {c: f"{c}_of_input_{i}" if c in added else c for i, c in enumerate(docs.columns)}
    return kept.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was recognised; those without a letter or mostly of unknown n-grams go."""
    bounded_batches(spark)
    model = langid.fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    judged = langid.predict(_aside(docs, "lang_pred", "score"), model)
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return _back(kept, docs, "lang_pred", "score")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; those with no word left go.  ``n_chars`` follows the text."""
    bounded_batches(spark)
    result = linededup.remove_repeated(_aside(docs, "removed")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _back(result.withColumn("n_chars", changed), docs, "removed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked ones: that with the smallest id; of rows equal in id and text, one."""
    bounded_batches(spark)
    classes = jaccard.jaccard_components(docs, size=NEAR_SIZE, percent=NEAR_PERCENT)
    least = classes.where("is_least").select("doc_id", "text_hash").distinct().toDF("least_id", "least_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("mark"))
    same = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("mark") == F.col("least_hash"))
    best = rows.join(least, same, "left_semi").dropDuplicates(["doc_id", "mark"])
    return best.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    bounded_batches(spark)
    added = ("n_words", "n_hit", "n_items", "items", "hit_spans")
    found = decontaminate.find_contamination(_aside(docs, *added), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(found.where(~decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))), docs, *added)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    bounded_batches(spark)
    return packing.pack(docs, TOKENIZER, END_ID)


STAGES = [
    ("language", identify_language),
    ("line_dedup", remove_repeated_passages),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack),
]

#: Learned filters and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
