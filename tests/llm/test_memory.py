"""What a task holds at once: bytes of a batch, vocabularies, remembered pieces."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.llm import langid, near_dedup, packing, simhash, tokens
from panelweave.llm.common import located
from panelweave.llm.components import connected
from panelweave.session import BATCH_BYTES, BATCH_LIMIT, FILE_ROWS, materialize

OPERATORS = {
    "language_id": langid.identified_rows,
    "near_dedup": near_dedup.one_of_each,
    "simhash": lambda docs: simhash.fingerprints(located(docs)),
    "pack": packing.pack,
}


@pytest.fixture
def limit(spark):
    """The session as it comes, without a limit of its own, and as it was afterwards."""
    before = spark.conf.getAll.get(BATCH_LIMIT)
    spark.conf.unset(BATCH_LIMIT)
    yield spark
    spark.conf.unset(BATCH_LIMIT)
    if before is not None:
        spark.conf.set(BATCH_LIMIT, before)


def largest(df) -> tuple[int, int]:
    """Bytes of text and rows of the largest batch that a Python worker gets."""

    def size(batches):
        for b in batches:
            yield pd.DataFrame({"bytes": [int(b.text.str.len().sum()) if "text" in b else 0], "rows": [len(b)]})

    return tuple(df.mapInPandas(size, "bytes long, rows long").agg(F.max("bytes"), F.max("rows")).first())


def texts(spark, rows: int):
    words = F.concat_ws(" ", F.lit("word"), F.col("id").cast("string"), F.repeat(F.lit("letters of one text "), 150))
    return spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"))


@pytest.mark.parametrize("name", OPERATORS)
def test_texts_reach_a_worker_in_bounded_batches(limit, name):
    docs = texts(limit, 1500)
    assert largest(docs)[0] > 2 * BATCH_BYTES  # Spark's own limits hand all of them over
    OPERATORS[name](docs.limit(20))
    assert largest(docs)[0] <= BATCH_BYTES * 1.1
    assert largest(limit.range(0, 10_000, 1, 1))[1] == 10_000  # short rows travel as before


def test_a_limit_of_the_session_stays(limit):
    limit.conf.set(BATCH_LIMIT, "64k")
    packing.pack(texts(limit, 5))
    assert limit.conf.get(BATCH_LIMIT) == "64k"


def test_results_do_not_depend_on_the_batches(limit):
    docs = texts(limit, 300)
    found = {}
    for size in ("1k", "64m"):
        limit.conf.set(BATCH_LIMIT, size)
        found[size] = sorted(map(tuple, packing.pack(docs).collect()))
    assert found["1k"] == found["64m"]


def test_the_second_vocabulary_is_read_when_needed():
    tokenizer = tokens.PieceTokenizer()
    usual = [tokenizer.ids(t).tolist() for t in ("usual words, and more", "Straße 12\nline", None)]
    assert "exact" not in vars(tokenizer)
    other = tokenizer.ids("two  blanks and 中文").tolist()
    assert "exact" in vars(tokenizer)
    encode = lambda t: tokenizer.exact.encode(t, add_special_tokens=False).ids
    assert usual == [encode("usual words, and more"), encode("Straße 12\nline"), []]
    assert other == encode("two  blanks and 中文")


def test_a_worker_remembers_a_bounded_number_of_pieces():
    tokenizer = tokens.PieceTokenizer()
    for start in range(0, 300_000, 100_000):
        list(tokenizer.all_ids([f"p{i} p{i + 1}" for i in range(start, start + 100_000, 2)]))
    assert len(tokenizer.code) <= 250_000


def files(df) -> int:
    return df.select(F.input_file_name()).distinct().count()


def test_small_tables_do_not_have_a_file_for_each_shuffle_partition(spark):
    at_once = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 60)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chains = spark.range(0, 4000).filter("id % 8 > 0").select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
        found = connected(chains)
        assert files(found) <= at_once
        assert {(r.node, r.root) for r in found.collect()} == {(i, i - i % 8) for i in range(4000) if i % 8}
        counted = spark.range(0, 4000).groupBy((F.col("id") % 3999).alias("key")).count()
        assert files(materialize(counted, "few", 4000)) <= at_once
        assert files(materialize(counted, "many", 20 * FILE_ROWS)) == max(20, at_once)  # more rows, more files
        assert files(materialize(counted, "unknown")) == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
