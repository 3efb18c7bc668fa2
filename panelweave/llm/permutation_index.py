"""Nearest neighbours by a permutation index.

Pivots are a hashed sample of distinct vectors, about the square root of the row count. A
vector is represented by its ``ORDER`` nearest pivots in order, so a posting is as long at any
number of pivots, and posted in the inverted files of the first ``POSTED`` of them. A query
visits the files of its nearest third of the pivots; in each file the postings are ranked by
the footrule distance between the two orders (a pivot missing from one counts as last), the
best share of them is compared on the vectors, and the best of all files are the answer.

A file with many postings is dealt over cells, postings chunks times query chunks, so a very
common vector costs no task more than a cell. Pivots are bounded by the parameter, the rest
never leaves the executors. Vectors travel at the width they are stored in; distances are
taken in doubles.

Vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows without id. A repeated id counts once, at its nearest.
Ties go to the smaller id. Equal vectors are candidates of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from panelweave.llm.common import quoted

SEED = 77
MOST_PIVOTS = 8192
POSTED = 4
ORDER = 96  # pivots of an order
VISITED = 1 / 3
RERANKED, LEAST_RERANKED = 0.2, 256
CELL = 4096  # postings of a cell
QUERIES = 8192  # queries of a cell
BLOCK = 1000  # vectors held against all pivots at a time
ROW = "pivot int, salt int, chunk int, query boolean, id long, near binary, vec binary"


def usable(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``(id, vec)`` of the rows that take part, as doubles."""
    own = vectors.select(quoted(vec_id).cast("bigint").alias("id"), quoted(vec).cast("array<double>").alias("vec"))
    good = own.filter(
        "id is not null and vec is not null and size(vec) > 0"
        " and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)"
    )
    width = good.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return good.filter(F.size("vec") == (width["width"] if width else 0))


def choose_pivots(good: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` distinct vectors, those whose id has the smallest hash."""
    rows = good.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(4 * count).select("vec").collect()
    found = list(dict.fromkeys(tuple(r.vec) for r in rows))[:count]
    return np.array(found, np.float64)


def order_of(vecs: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    gap = (pivots**2).sum(axis=1)[None, :] - 2 * vecs @ pivots.T
    if length >= gap.shape[1]:
        return np.argsort(gap, axis=1, kind="stable").astype(np.int16)
    some = np.sort(np.argpartition(gap, length, axis=1)[:, :length], axis=1)
    inside = np.argsort(np.take_along_axis(gap, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, inside, axis=1).astype(np.int16)


def footrule(query: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Distance of a query's order to each posting's, given each pivot's place in the postings (their length if absent).

    A pivot of the query adds how far its places are apart. The pivots the query lacks add as
    much in total as the places of its own add up to, less a constant that is left out.
    """
    own = np.arange(len(query), dtype=np.int16)[:, None]
    place = places[query]
    return np.maximum(2 * place - own, own).sum(axis=0, dtype=np.int64)


def _answers(pivots: int, k: int, share: float, least: int, width: str):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        asked, posted = cell[cell["query"]], cell[~cell["query"]].sort_values("id")
        posted = posted.drop_duplicates(["id", "vec"])
        found: list[tuple] = []
        if len(asked) and len(posted):
            ids = posted.id.to_numpy()
            near = np.frombuffer(b"".join(posted.near), np.int16).reshape(len(ids), -1)
            vecs = np.frombuffer(b"".join(posted.vec), width).reshape(len(ids), -1).astype(np.float64)
            m = near.shape[1]
            places = np.full((pivots, len(ids)), m, np.int16)
            places[near, np.arange(len(ids))[:, None]] = np.arange(m, dtype=np.int16)
            repeated = bool((ids[1:] == ids[:-1]).any())
            top = min(len(ids), max(least, int(np.ceil(share * len(ids)))) + 1)
            number = np.arange(len(ids))  # ids ascend, so ties go to the smaller
            for qid, order, vec in zip(asked.id, asked.near, asked.vec):
                some = number
                if top < len(ids):
                    far = footrule(np.frombuffer(order, np.int16), places) * len(ids) + number
                    some = np.sort(np.argpartition(far, top - 1)[:top])
                some = some[ids[some] != qid]
                gap = np.sqrt(((vecs[some] - np.frombuffer(vec, width)) ** 2).sum(axis=1))
                best = np.argsort(gap, kind="stable")
                if repeated:
                    best = best[np.sort(np.unique(ids[some[best]], return_index=True)[1])]
                best = best[:k]
                found.append((qid, ids[some[best]], gap[best]))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        asks, answers, gaps = zip(*found)
        return pd.DataFrame({"query_id": np.repeat(asks, [len(a) for a in answers]), "vec_id": np.concatenate(answers), "score": np.concatenate(gaps)})

    return run


def search(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    vec: str = "embedding",
    vec_id: str = "vec_id",
    posted: int = POSTED,
    order: int = ORDER,
    visited: float = VISITED,
    share: float = RERANKED,
    least: int = LEAST_RERANKED,
    most_pivots: int = MOST_PIVOTS,
    cell: int = CELL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    good = usable(vectors, vec, vec_id)
    n, n_queries = good.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    pivots = choose_pivots(good, max(1, min(most_pivots, int(n**0.5))))
    count = len(pivots)
    visits = min(count, max(16, int(np.ceil(count * visited))))
    order, posted = min(count, max(order, posted)), min(count, posted)
    element = vectors.schema[vec].dataType
    single = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    width = "<f4" if single else "<f8"  # of a vector between tasks
    shared = spark.sparkContext.broadcast(pivots)

    def first_pivots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                near = order_of(np.stack(batch.vec.iloc[at : at + BLOCK].to_numpy()), shared.value, posted)
                yield pd.DataFrame({"pivot": near.ravel().astype(np.int32)})

    sizes = np.zeros(max(1, count), np.int64)  # one number per pivot
    if n:
        for r in good.select("vec").mapInPandas(first_pivots, "pivot int").groupBy("pivot").count().collect():
            sizes[r["pivot"]] = r["count"]
    salts = np.maximum(1, -(-sizes // cell))
    chunks = max(1, -(-int(n_queries) * visits // max(1, count) // QUERIES))

    def rows(who: np.ndarray, pivot, salt, chunk, query: bool, ids, near, vecs) -> pd.DataFrame:
        return pd.DataFrame(
            {"pivot": pivot.astype(np.int32), "salt": salt.astype(np.int32), "chunk": chunk.astype(np.int32), "query": query, "id": ids[who],
             "near": [near[i].tobytes() for i in who], "vec": [vecs[i].astype(width).tobytes() for i in who]}
        )

    def spread(who, pivot, other, copies) -> tuple:
        """Copies 0..copies-1 of each row, numbered."""
        number = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        return np.repeat(who, copies), np.repeat(pivot, copies), np.repeat(other, copies), number

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.iloc[at : at + BLOCK]
                ids, vecs = some.id.to_numpy(), np.stack(some.vec.to_numpy())
                near = order_of(vecs, shared.value, order)
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                who = np.repeat(np.arange(len(ids)), posted)
                pivot = near[:, :posted].ravel().astype(np.int64)
                salt = (mixed[who] % salts[pivot].astype(np.uint64)).astype(np.int64)
                yield rows(*_order(spread(who, pivot, salt, np.full(len(who), chunks)), False), False, ids, near, vecs)
                asks = np.nonzero(ids % every == 0)[0]
                who = np.repeat(asks, visits)
                pivot = order_of(vecs[asks], shared.value, visits).ravel().astype(np.int64)
                chunk = (mixed[who] % np.uint64(chunks)).astype(np.int64)
                yield rows(*_order(spread(who, pivot, chunk, salts[pivot]), True), True, ids, near, vecs)

    cells = good.mapInPandas(post, ROW).groupBy("pivot", "salt", "chunk")
    found = cells.applyInPandas(_answers(count, k, share, least, width), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _order(spread: tuple, query: bool) -> tuple:
    """Row, pivot, salt, chunk: a posting is copied to every chunk, a query to every salt."""
    who, pivot, own, number = spread
    return (who, pivot, number, own) if query else (who, pivot, own, number)
