"""The packed sequences themselves."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lacuna.llm import packing
from lacuna.llm.queries import op8_packing


def test_pieces_hold_the_token_ids(spark, odd, none):
    """The ids of a document's pieces are its text's and the end; sequences are gapless; blocks are cut inside documents."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = sorted([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in odd.collect())
    for block in (packing.BLOCK_TOKENS, 5_000):
        rows = packing.pack(odd.coalesce(1), "word_bpe_49k.json", 2, block=block).collect()
        docs, sequences, key = [], defaultdict(list), None
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(sequences[r["sequence_id"]]) == r["offset"]
            sequences[r["sequence_id"]] += ids
            if r["start"] == 0:
                docs.append([])
            assert r["start"] == len(docs[-1])
            docs[-1] += ids
        assert sorted(docs) == want and max(map(len, sequences.values())) <= 4096
    assert packing.pack(none, "word_bpe_49k.json", 2).count() == 0


def test_query_and_stage(spark):
    """The query's columns come from the ids; the pipeline's last stage gives the ids out."""
    pytest.importorskip("public_tokenizers")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = {(r["sequence_id"], r["offset"]): r for r in corpus_pipeline.pack(spark, docs, folder).collect()}
    got = op8_packing(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for r in got.collect():
        ids = packed[r["sequence_id"], r["offset"]]["ids"]
        assert (len(ids), zlib.crc32(ids)) == (4 * r["length"], r["ids_crc32"])
