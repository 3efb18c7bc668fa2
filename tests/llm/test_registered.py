"""Every text query without a SQL twin, as registered: one row per document (or more, as stated) under its columns."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import TEXT_QUERIES, TEXT_TWINS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_token_shards": ["slot", "shard", "ids_crc32"],
    "op5_secret_scan": ["doc_id", "is_secret"],
    "op6_pack": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_token_counts": ["doc_id", "n_words", "n_pieces"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_permutation_index": ["query_id", "rank", "vec_id", "score"],
    "pipeline": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
}
ONE_EACH = {"op1_mix_sources", "op2_language_id", "op7_token_counts", "op8_simhash", "op9_lm_score"}


def test_all_are_listed():
    assert set(COLUMNS) == set(TEXT_QUERIES) - set(TEXT_TWINS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_as_registered(spark, name):
    rows = TEXT_QUERIES[name](spark, SF_DIR).collect()
    assert rows and set(COLUMNS[name]) <= set(rows[0].__fields__)
    if name in ONE_EACH:
        docs = [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(docs)
