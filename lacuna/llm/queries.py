"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import collocations, decontaminate, filteraudit, fingerprints, jaccard, langid, linededup, linequality, packing, puquality, sharding, urlrules, warc
from lacuna.llm.common import held_out
from lacuna.llm.oracles import ORACLES, URL_RULES
from lacuna.sources.sizing import bounded_batches

__all__ = ["ORACLES", "QUERIES"]

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARDS = 40


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {listed} AS rules(verdict, host, path)")
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return urlrules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    records, _ = warc.archive(_table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(documents, _table(spark, folder, "benchmark"))
    digest = decontaminate.items_digest(F.col("items")).alias("items_sha256")
    verdict = decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, verdict)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.remove_repeated(_table(spark, folder, "documents").select("doc_id", "text"))


def op5_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    learnt = ~held_out(F.col("doc_id"), 5, 0)
    model = puquality.fit(documents.where(learnt), _table(spark, folder, "labels").where(learnt))
    scored = puquality.score(documents, model)
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", predicted)


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    classes = jaccard.jaccard_components(_table(spark, folder, "documents"), size=3, percent=90)
    return classes.select("doc_id", "n_shingles", "component_id")


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.where(~held_out(F.col("doc_id"), 4, 2)))
    judged = langid.predict(documents.drop("lang"), model)
    return judged.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), TOKENIZER, END_ID)
    length = F.floor(F.octet_length("ids") / 4).alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return linequality.judge(_table(spark, folder, "documents"))


def op10_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(_table(spark, folder, "documents"), SHARDS)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, folder, "documents")).drop("changed")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    root = str(Path(__file__).resolve().parents[2])
    if root not in sys.path:
        sys.path.insert(0, root)
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_rules, op2_warc, op3_decontaminate, op4_line_dedup, op5_pu_quality, op6_jaccard_join, op7_language, op8_packing,
        op9_line_quality, op10_jump_shards, op11_collocations, op12_filter_audit, op13_fingerprints, pipeline,
    )
}
