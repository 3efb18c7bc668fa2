"""The registered queries of the text operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import exact_dedup, langid, lexical_search, line_dedup, lm_score, mixing, packing, permutation_index, prefix_trie, secret_scan, simhash, token_counts, token_shards
from panelweave.llm.common import located

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_TWINS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(located(documents(spark, sf)))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").cast("bigint").alias("draws"))


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(documents(spark, sf))


@query
def op3_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return token_shards.write_shards(docs, token_shards.shard_folder(docs))


@query
def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact_dedup.dedup(documents(spark, sf))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL_TWINS["op4_exact_dedup"] = r"""
WITH body AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
    min(doc_id) OVER (PARTITION BY body) AS keep_id,
    count(*) OVER (PARTITION BY body) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
    sha256(body) AS text_sha256
FROM body
"""


@query
def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf))


@query
def op6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf))


@query
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf))


@query
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash(documents(spark, sf))


@query
def op9_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.lm_score(documents(spark, sf))


@query
def op10_permutation_index(spark: SparkSession, sf: str) -> DataFrame:
    return permutation_index.search(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query
def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_digests(documents(spark, sf))


SQL_TWINS["op11_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM lines
), shared AS (
    SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 40
    GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone
    FROM keyed k LEFT JOIN shared s USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie_digests(spark.read.parquet(f"{sf}/conversations.parquet"))


# 3988292384 is the reversed polynomial of CRC-32.
SQL_TWINS["op12_prefix_trie"] = """
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS rank
    FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS step
    FROM range(256) r(i)
), convs AS (
    SELECT c, c - c % 5 AS base, xor(list_reduce(
        list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: xor(a // 256, step[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT c FROM turns), crc
), given AS (
    SELECT v.c, v.base, v.h, count(t.c) AS given
    FROM convs v LEFT JOIN turns t ON t.c = v.base AND t.rank < v.h GROUP BY v.c, v.base, v.h
), built AS (
    SELECT g.c, t.rank + 1 AS depth, t.role, t.text FROM given g JOIN turns t ON t.c = g.base AND t.rank < g.given
    UNION ALL
    SELECT g.c, t.rank - g.h + g.given + 1, t.role, t.text FROM given g JOIN turns t ON t.c = g.c AND t.rank >= g.h
), way AS (
    SELECT c, depth, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY depth) AS prefix, strlen(text) AS bytes
    FROM built
    UNION ALL
    SELECT c, 0, [], 0 FROM convs
), named AS (
    SELECT c, depth, bytes, min(c) OVER (PARTITION BY depth, prefix) AS node, depth = max(depth) OVER (PARTITION BY c) AS ends
    FROM way
), nodes AS (
    SELECT node, depth, count(*) AS n_convs, any_value(bytes) AS bytes,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM named GROUP BY node, depth
), linked AS (
    SELECT n.*, a.node AS parent FROM nodes n LEFT JOIN named a ON a.c = n.node AND a.depth = n.depth - 1
), counted AS (
    SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l
    LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL) k
        ON k.parent = l.node AND k.depth = l.depth
), totals AS (
    SELECT a.node, a.depth, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved
    FROM counted n JOIN named a ON a.c = n.node AND a.depth <= n.depth GROUP BY a.node, a.depth
)
SELECT node AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves,
    saved AS saved_tokens, ends_sha256
FROM counted JOIN totals USING (node, depth)
"""


@query
def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


SQL_TWINS["op13_lexical_search"] = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL
    SELECT 'i', item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark
), terms AS (
    SELECT kind, id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
    FROM words GROUP BY ALL
), sizes AS (
    SELECT id AS doc_id, sum(tf)::BIGINT AS n FROM terms WHERE kind = 'd' GROUP BY id
), corpus AS (
    SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), held AS (
    SELECT term, count(*) AS df FROM terms WHERE kind = 'd' GROUP BY term
), gains AS (
    SELECT t.id AS doc_id, t.term,
        floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
            * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS gain
    FROM terms t JOIN held USING (term) JOIN sizes s ON s.doc_id = t.id, corpus
    WHERE t.kind = 'd'
), scores AS (
    SELECT i.id AS item_id, g.doc_id, sum(g.gain)::BIGINT AS score
    FROM terms i JOIN gains g USING (term) WHERE i.kind = 'i' GROUP BY ALL HAVING sum(g.gain) > 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 50
"""
