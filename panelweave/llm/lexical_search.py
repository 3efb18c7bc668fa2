"""Ranked lexical search with each distinct bag of words scored once.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased. A
document is restricted to the vocabulary of the items, as sorted term numbers with their
occurrences, and given its length norm m. Documents with the same hash of (m, vector) and, as
the grouping compares the whole of it, the same vector form a class. A class is scored once
against all items; a task keeps the best classes per item, and the best of all tasks are
expanded to their members by ascending id.

A class needs only its ``k`` smallest ids, since no item lists more; they are cut per task
before the exchange, so a class with a third of all documents moves ``k`` rows a task. An item
needs only its first ``k`` classes by (score, smallest id): each of them has a member that
comes before any of a later class. Both are exact.

The items are the query set: they pass the driver in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_BYTES`` of text (one item at least), and only a block's vocabulary is sent to tasks.
Another block is another pass over the documents.

Null and empty texts have no term, count for nothing and are never found. A document without
an id comes after all others of its score; rows that share an id are documents of their own, and
so are items. Items without a term, and empty tables, give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import quoted
from panelweave.session import materialize

RESULT = "item_id long, rank int, doc_id long, score long"
BLOCK_ITEMS = 4096
BLOCK_BYTES = 8_000_000
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PIECE = 1 << 20  # bytes of a text cut into terms at a time
CELLS = 1 << 20  # scores and matches a task holds at a time


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    plain = text.translate(TERMS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items with their terms, in bounded blocks; those without a term are left out."""
    block, held = [], 0
    slim = items.select(quoted(item_id).cast("bigint").alias("item_id"), quoted(text).cast("string").cast("binary").alias("body"))
    for row in slim.filter("body is not null").toLocalIterator():
        terms = {t for some in terms_of(bytes(row["body"])) for t in some}
        if block and (len(block) == BLOCK_ITEMS or held + len(row["body"]) > BLOCK_BYTES):
            yield block
            block, held = [], 0
        if terms:
            block.append((row["item_id"], terms))
            held += len(row["body"])
    if block:
        yield block


def bags(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """``(place, doc_id, n, ids, tfs)`` of each document with a term; ``vocabulary`` is a broadcast dict."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            sizes, ends, ids, tfs = [], [0], [], []
            for body in batch.column("body"):
                n, own = 0, Counter()
                for terms in terms_of(body.as_py() or b""):
                    n += len(terms)
                    own.update(map(number, terms))
                own.pop(None, None)
                for i, tf in sorted(own.items()):
                    ids.append(i)
                    tfs.append(tf)
                sizes.append(n)
                ends.append(len(ids))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "ids", "tfs"],
            )

    slim = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), quoted(text).cast("string").cast("binary").alias("body"))
    counted = slim.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<long>").filter("n > 0")
    return materialize(counted.select(F.monotonically_increasing_id().alias("place"), "*"), "bags")


def classes_of(found: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(class_id, nth, no_id, doc_id, m, ids, tfs)``: up to ``k`` members of each class, the vector with the first."""
    norm = F.expr(f"cast(50 + (cast(50 * n as decimal(38, 0)) * {n_docs}) div {n_terms} as bigint)")
    keyed = found.filter(F.size("ids") > 0).select("place", "doc_id", F.col("doc_id").isNull().alias("no_id"), norm.alias("m"), "ids", "tfs")
    keyed = keyed.withColumn("hash", F.xxhash64("m", "ids", "tfs"))
    own = Window.partitionBy("hash", "m", "ids", "tfs").orderBy("no_id", "doc_id", "place")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = keyed.select("*", F.row_number().over(own).alias("nth"), F.first("place").over(upto).alias("class_id")).filter(F.col("nth") <= k)
    first = F.col("nth") == 1
    vector = [F.when(first, F.col(c)).alias(c) for c in ("m", "ids", "tfs")]
    return materialize(numbered.select("class_id", "nth", "no_id", "doc_id", *vector), "classes")


class Best:
    """The first ``k`` classes of each item so far, by score and smallest id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)  # a lower score cannot enter
        self.rows = {c: np.empty(0, np.int64) for c in ("item", "score", "class_id", "no_id", "doc_id")}
        self.grown = 0

    def add(self, rows: dict[str, np.ndarray]) -> None:
        self.rows = {c: np.concatenate([old, rows[c]]) for c, old in self.rows.items()}
        self.grown += len(rows["item"])
        if self.grown > CELLS:
            self.cut()

    def cut(self) -> None:
        r = self.rows
        order = np.lexsort((r["doc_id"], r["no_id"], -r["score"], r["item"]))
        item = r["item"][order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[nth < self.k]
        last = order[nth == self.k - 1]
        self.least[r["item"][last]] = r["score"][last]
        self.rows = {c: v[kept] for c, v in r.items()}
        self.grown = 0


def score_classes(numbered: DataFrame, model, n_items: int, k: int) -> DataFrame:
    """``(item, score, class_id, no_id, doc_id)``: per task, the first ``k`` classes of each item."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, starts, posted = model.value
        best = Best(n_items, k)
        for batch in batches:
            sizes = batch["ids"].map(len).to_numpy()
            ids = np.concatenate([*batch["ids"], np.empty(0, np.int32)]).astype(np.int64)
            tfs = np.concatenate([*batch["tfs"], np.empty(0, np.int64)]).astype(np.int64)
            m = batch["m"].to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), sizes)
            gain = weight[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[owner]))
            fan = starts[ids + 1] - starts[ids]
            work = np.concatenate([[0], np.cumsum(fan)])
            ends = np.cumsum(sizes)
            at = 0
            while at < len(batch):
                first = ends[at] - sizes[at]
                upto = int(np.searchsorted(work[ends], work[first] + CELLS, side="right"))
                upto = max(at + 1, min(upto, at + max(1, CELLS // n_items)))
                some = slice(first, ends[upto - 1])
                times = fan[some]
                inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                items = posted[np.repeat(starts[ids[some]], times) + inner]
                total = np.zeros((upto - at) * n_items, np.int64)
                np.add.at(total, np.repeat(owner[some] - at, times) * n_items + items, np.repeat(gain[some], times))
                row, item = np.nonzero(total.reshape(-1, n_items) >= best.least)
                own = {c: batch[c].to_numpy()[at + row].astype(np.int64) for c in ("class_id", "no_id", "doc_id")}
                best.add({"item": item, "score": total[row * n_items + item], **own})
                at = upto
        best.cut()
        yield pd.DataFrame(best.rows)

    slim = numbered.filter("nth = 1").select("class_id", F.col("no_id").cast("int").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "m", "ids", "tfs")
    return slim.mapInPandas(score, "item long, score long, class_id long, no_id long, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], RESULT)
    for block in item_blocks(items, item_id, item_text):
        out = out.unionByName(_search_block(spark, docs, block, k, doc_id, text))
    return out


def _search_block(spark: SparkSession, docs: DataFrame, block: list, k: int, doc_id: str, text: str) -> DataFrame:
    words = sorted(set().union(*(terms for _, terms in block)))
    number = {w: i for i, w in enumerate(words)}
    vocabulary = spark.sparkContext.broadcast(number)
    found = bags(docs, vocabulary, doc_id, text)
    vocabulary.unpersist()
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], RESULT)
    holders = found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    df = np.zeros(len(words), np.int64)
    for row in holders.toLocalIterator():  # no more rows than the block has words
        df[row["id"]] = row["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    pairs = np.array(sorted((number[t], i) for i, (_, terms) in enumerate(block) for t in terms), np.int64)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
    model = spark.sparkContext.broadcast((weight, starts, pairs[:, 1].copy()))

    numbered = classes_of(found, n_docs, n_terms, k)
    each = Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "doc_id", "class_id")
    top = materialize(score_classes(numbered, model, len(block), k), "scored_classes")
    model.unpersist()
    top = top.withColumn("nth", F.row_number().over(each)).filter(F.col("nth") <= k).select("item", "score", "class_id")
    members = numbered.select("class_id", "no_id", "doc_id")
    ranked = top.join(members, "class_id").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "doc_id", "class_id")))
    named = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], "item long, item_id long")
    ranked = ranked.filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")
    return ranked.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
