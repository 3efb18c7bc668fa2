"""Language-model scoring by prediction by partial matching over bytes.

Text is lower-cased (A-Z), white space becomes one space, and a closing byte ends it. A trie
of byte contexts up to ``ORDER`` long is counted over all training documents. A symbol is
coded in the longest context seen; where the context does not hold it, an escape is coded
(its chance estimated from the distinct symbols, method C) and the next shorter context
follows, with the symbols of the longer one excluded. The code length is the document's log10
probability.

The trie is a table of all its nodes; nothing is pruned, so what is learned grows with the text. The
chance of a symbol depends on it and its context alone: each distinct gram (a symbol with ``ORDER`` bytes of
context) is worked out once. A gram seen in training is answered by its own node; grams that only held-out
texts have climb down the orders by joins, a round each. The ``MOST`` most frequent grams
at most travel to every task with their chances; a document's other grams are joined and added up.

The base score needs the count of every word. Words with at least ``WORD_SHARE`` of all
tokens, at most 1/WORD_SHARE of them, are looked up in the task; the others are joined.

Null text is empty and still holds its end. A null id counts as the empty text for the split.
With nothing to learn from, all symbols are equally likely.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import held, join_spread, quoted
from panelweave.session import materialize

ORDER = 5  # bytes of context
MOST = 1 << 20  # grams that every task is sent; the others are joined
WORD_SHARE = 2.0**-20
EDGE = 10  # the byte before and after a text; never inside one
CHUNK = 2_000_000  # positions sorted at a time
HELD_GRAMS, HELD_WORDS = 2_000_000, 400_000  # counts a task holds before it sends them on
ROWS = 100_000  # rows handed over at a time
TEXTS = 250  # texts scored at a time
DOC_BITS = 16  # documents of a chunk, beside a gram of ORDER + 1 bytes


def spelled(text: str | None) -> bytes:
    return b" ".join(text.encode("utf-8", "replace").lower().split()) if text else b""


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Sorted ``gram << DOC_BITS | document`` of bounded chunks, with the documents' first number and count.

    A gram is a coded byte with its ORDER bytes of context; a text longer than a chunk is cut
    with its context kept.
    """
    pad = bytes([EDGE]) * ORDER
    parts: list[bytes] = []
    sizes: list[int] = []
    first = 0

    def cut() -> np.ndarray:
        flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        gram = np.zeros(len(flat) - ORDER, np.uint64)
        for j in range(ORDER + 1):
            gram = (gram << np.uint64(8)) | flat[j : len(flat) - ORDER + j]
        lengths = np.array(sizes)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), lengths)[ORDER:]
        coded = np.ones(len(flat), bool)
        coded[np.concatenate([[0], ends[:-1]])[:, None] + np.arange(ORDER)] = False
        key = ((gram << np.uint64(DOC_BITS)) | owner)[coded[ORDER:]]
        key.sort()
        return key

    total = 0
    for i, text in enumerate(texts):
        whole = pad + text + bytes([EDGE])
        for at in range(0, len(whole) - ORDER, CHUNK):
            piece = whole[at : at + CHUNK + ORDER]
            if parts and (total + len(piece) > CHUNK + 8 * ORDER or len(parts) == 1 << DOC_BITS):
                yield cut(), first, len(parts)
                parts, sizes, total = [], [], 0
            if not parts:
                first = i
            elif at:  # never: a cut text starts a chunk of its own
                raise AssertionError
            parts.append(piece)
            sizes.append(len(piece))
            total += len(piece)
            if at or len(whole) - ORDER > CHUNK:
                yield cut(), first, len(parts)
                parts, sizes, total = [], [], 0
    if parts:
        yield cut(), first, len(parts)


def runs(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often (or with what total) they occur."""
    if not len(values):
        return values, np.empty(0, np.int64)
    at = np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0]
    if counts is None:
        return values[at], np.diff(at, append=len(values))
    return values[at], np.add.reduceat(counts, at)


def merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    return runs(keys[order], counts[order])


def count_corpus(train: DataFrame) -> DataFrame:
    """``(kind, gram, word, n)`` over training texts: kind 0..ORDER are grams with so many bytes of context, -1 words.

    The end of a text is the empty word.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[bytes] = Counter()
        grown = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def grams_out(full: tuple) -> Iterator[pd.DataFrame]:
            keys, n = full
            for k in range(ORDER, -1, -1):
                for at in range(0, len(keys), ROWS):
                    yield pd.DataFrame({"kind": k, "gram": keys[at : at + ROWS].view(np.int64), "word": "", "n": n[at : at + ROWS]})
                low = keys & np.uint64((1 << (8 * k)) - 1)
                order = np.argsort(low, kind="stable")
                keys, n = runs(low[order], n[order])

        def words_out() -> Iterator[pd.DataFrame]:
            items = iter(words.items())
            while some := list(itertools.islice(items, ROWS)):
                yield pd.DataFrame({"kind": -1, "gram": 0, "word": [w.decode("utf-8", "replace") for w, _ in some], "n": [n for _, n in some]})
            words.clear()

        for batch in batches:
            texts = [spelled(t) for t in batch["text"]]
            for t in texts:
                words.update(t.split(b" ") if t else ())
            words[b""] += len(texts)
            for keys, _, _ in grams(texts):
                grown = merged(grown, runs(keys >> np.uint64(DOC_BITS)))
            if len(grown[0]) > HELD_GRAMS:
                yield from grams_out(grown)
                grown = (grown[0][:0], grown[1][:0])
            if len(words) > HELD_WORDS:
                yield from words_out()
        yield from grams_out(grown)
        yield from words_out()

    found = train.mapInPandas(count, "kind int, gram long, word string, n long")
    return materialize(found.groupBy("kind", "gram", "word").agg(F.sum("n").alias("n")).filter("n > 0"), "lm_counts")


def _low(gram: Column, size: int) -> Column:
    """The last ``size`` bytes of a gram."""
    return gram.bitwiseAND(F.lit((1 << (8 * size)) - 1))


def contexts(counts: DataFrame) -> list[DataFrame]:
    """Per order k the table ``context, den, escape, next_den, next_escape`` of natural logs.

    ``den`` and ``escape`` hold where a text enters the trie in this context; ``next_*`` are those of
    the context one shorter once the symbols of this one are excluded.
    """
    tables = []
    for k in range(ORDER + 1):
        own = counts.filter(F.col("kind") == k).select("gram", "n", F.shiftright("gram", 8).alias("context"))
        if k:
            # The same symbols one order lower: their counts there are what exclusion takes away.
            shorter = counts.filter(F.col("kind") == k - 1).select(F.col("gram").alias("low"), F.col("n").alias("low_n"))
            own = own.withColumn("low", _low(F.col("gram"), k)).join(shorter, "low")
        sums = [F.sum("n").alias("total"), F.count("*").alias("distinct")]
        table = own.groupBy("context").agg(*sums, *([F.sum("low_n").alias("gone")] if k else []))
        table = table.withColumns({"den": F.log(F.col("total") + F.col("distinct")), "escape": F.log(F.col("distinct") / (F.col("total") + F.col("distinct")))})
        if k:
            above = tables[-1].select(F.col("context").alias("suffix"), F.col("total").alias("t"), F.col("distinct").alias("d"))
            table = table.withColumn("suffix", _low(F.col("context"), k - 1)).join(above, "suffix")
            left = F.col("d") - F.col("distinct")
            rest = F.col("t") - F.col("gone") + left
            table = table.withColumns({"next_den": F.when(rest > 0, F.log(rest)), "next_escape": F.when(left > 0, F.log(left / rest)).otherwise(F.lit(0.0))})
        else:
            table = table.withColumns({"next_den": F.lit(None).cast("double"), "next_escape": F.lit(None).cast("double")})
        tables.append(materialize(table.select("context", "total", "distinct", "den", "escape", "next_den", "next_escape"), f"lm_contexts_{k}"))
    return tables


def known_chances(counts: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``gram, n, log_chance`` of every gram of full length seen in training."""
    own = counts.filter(F.col("kind") == ORDER).select("gram", "n", F.shiftright("gram", 8).alias("context"))
    return own.join(tables[ORDER].select("context", "den"), "context").select("gram", "n", (F.log("n") - F.col("den")).alias("log_chance"))


def unseen_chances(wanted: DataFrame, counts: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``gram, log_chance`` of grams of full length that training does not have.

    A round per order: the context and the gram are looked up; contexts of up to two bytes, and grams of
    two, are so few that they are sent along.
    """
    none = F.lit(None).cast("double")
    open_ = wanted.select("gram", F.lit(0.0).alias("log_chance"), F.lit(False).alias("entered"), none.alias("next_den"), none.alias("next_escape"), F.lit(False).alias("done"))
    for k in range(ORDER, -1, -1):
        few = (lambda t, size: F.broadcast(t) if size <= 2 else t)
        table = tables[k].select("context", "den", "escape", F.col("next_den").alias("after_den"), F.col("next_escape").alias("after_escape"), F.lit(True).alias("known"))
        gram = _low(F.col("gram"), k + 1)
        rows = open_.withColumn("context", F.shiftright(gram, 8)).join(few(table, k), "context", "left")
        if k < ORDER:
            own = counts.filter(F.col("kind") == k).select(F.col("gram").alias("node"), "n")
            rows = rows.withColumn("node", gram).join(few(own, k + 1), "node", "left")
        else:
            rows = rows.withColumn("n", F.lit(None).cast("bigint"))
        den = F.when(F.col("entered"), F.col("next_den")).otherwise(F.col("den"))
        escape = F.when(F.col("entered"), F.col("next_escape")).otherwise(F.col("escape"))
        known = F.col("known").isNotNull()
        step = F.when(F.col("n").isNotNull(), F.log("n") - den).when(known, escape).otherwise(F.lit(0.0))
        rows = rows.select(
            "gram",
            F.when(F.col("done"), F.col("log_chance")).otherwise(F.col("log_chance") + step).alias("log_chance"),
            (F.col("entered") | known).alias("entered"),
            F.col("after_den").alias("next_den"),
            F.col("after_escape").alias("next_escape"),
            (F.col("done") | F.col("n").isNotNull()).alias("done"),
        )
        open_ = materialize(rows, f"lm_unseen_{k}")
    symbols = tables[0].agg(F.max("distinct")).first()[0] or 0
    floor = -float(np.log(max(1, 256 - symbols)))
    return open_.select("gram", F.when(F.col("done"), F.col("log_chance")).otherwise(F.col("log_chance") + floor).alias("log_chance"))


class Frequent:
    """Grams that a task can answer itself, in sorted arrays."""

    def __init__(self, gram: np.ndarray, log_chance: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.log_chance = gram[order], log_chance[order]


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table (0 where absent) and whether each is there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    hit = table[at] == wanted
    return np.where(hit, at, 0), hit


def text_scores(known: Frequent, texts: list[bytes]) -> tuple[np.ndarray, list, list]:
    """Natural log probability of what is known of each text, and its other grams with how often they occur."""
    out = np.zeros(len(texts))
    other: list[list[np.ndarray]] = [[] for _ in texts]
    times_of: list[list[np.ndarray]] = [[] for _ in texts]
    for keys, first, size in grams(texts):
        pairs, times = runs(keys)
        gram, owner = (pairs >> np.uint64(DOC_BITS)).view(np.int64), (pairs & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
        place, hit = find(known.gram, gram)
        if hit.any():
            out[first : first + size] += np.bincount(owner[hit], known.log_chance[place[hit]] * times[hit], size)
        missed = np.nonzero(~hit)[0]
        missed = missed[np.argsort(owner[missed], kind="stable")]
        at = np.searchsorted(owner[missed], np.arange(size + 1))
        for i in np.nonzero(np.diff(at))[0]:
            own = missed[at[i] : at[i + 1]]
            other[first + i].append(gram[own])
            times_of[first + i].append(times[own])
    joined = lambda parts: [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
    return out, joined(other), joined(times_of)


def most_frequent(known: DataFrame, most: int) -> Frequent:
    """The grams of the highest counts, whole powers of two at a time, ``most`` at most."""
    sizes = known.groupBy((F.length(F.bin("n")) - 1).alias("power")).count().collect()
    room, least = most, 64
    for r in sorted(sizes, key=lambda r: -r["power"]):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["power"]
    table = known.filter(F.col("n") >= F.lit(1 << least if least < 63 else (1 << 63) - 1)).select("gram", "log_chance").toArrow()
    return Frequent(table.column("gram").to_numpy(), table.column("log_chance").to_numpy())


def lm_score(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    parts: int = 7,
    part: int = 2,
    most: int = MOST,
    word_share: float = WORD_SHARE,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document."""
    spark = docs.sparkSession
    key = quoted(doc_id).cast("bigint")
    slim = docs.select(key.alias("doc_id"), quoted(text).cast("string").alias("text"), held(quoted(doc_id), parts, part).alias("held_out"))
    counts = count_corpus(slim.filter(~F.col("held_out")).select("text"))
    words = counts.filter("kind = -1")
    sums = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("n")))).first()
    n_train, n_distinct, n_ends = (int(x or 0) for x in sums)

    tables = contexts(counts)
    known = materialize(known_chances(counts, tables), "lm_known")
    answered = spark.sparkContext.broadcast(most_frequent(known, most))
    frequent = words.filter((F.col("word") != "") & (F.col("n") >= F.lit(word_share * n_train))).select("word", "n").toPandas()
    common = spark.sparkContext.broadcast(dict(zip((w.encode() for w in frequent.word), np.log10(frequent.n.to_numpy() + 1.0).tolist())))
    end_log = float(np.log10(n_ends + 1))
    schema = (
        "uid long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, score double, "
        "rare array<string>, rare_n array<int>, grams array<long>, grams_n array<long>"
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs, model = common.value, answered.value
        uid = TaskContext.get().partitionId() << 33
        for batch in (whole[at : at + TEXTS] for whole in batches for at in range(0, len(whole), TEXTS)):
            texts = [spelled(t) for t in batch["text"]]
            tokens, known, base, rare, rare_n = [], [], [], [], []
            for t in texts:
                own = Counter(t.split(b" ")) if t else {}
                other = [w for w in own if w not in logs]
                seldom = {w: own[w] for w in other}
                sure = [(logs[w], n) for w, n in own.items() if w in logs]
                n_own = sum(own.values())
                tokens.append(n_own + 1)
                known.append(n_own - sum(seldom.values()) + (n_ends > 0))
                base.append(sum(a * n for a, n in sure) + end_log)
                rare.append([w.decode("utf-8", "replace") for w in other])
                rare_n.append(list(seldom.values()))
            found, other, times = text_scores(model, texts)
            yield pd.DataFrame(
                {"uid": np.arange(uid, uid + len(texts)), "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": tokens,
                 "n_known": known, "base": base, "score": found, "rare": rare, "rare_n": rare_n, "grams": other, "grams_n": times}
            )
            uid += len(texts)

    scored = slim.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(score, schema)
    scored = materialize(scored, "lm_scored")
    seldom = scored.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times"))
    joined = seldom.join(words.select("word", "n"), "word", "left")
    rest = joined.groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rest"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rest_known"),
    )
    climbed = _other_grams(scored, known, counts, tables)
    total = float(np.log10(n_train + n_distinct + 1))
    both = scored.drop("rare", "rare_n", "grams", "grams_n").join(rest, "uid", "left").join(climbed, "uid", "left")
    return both.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        ((F.col("score") + F.coalesce("climbed", F.lit(0.0))) / F.lit(float(np.log(10)))).alias("score"),
    )


def _other_grams(scored: DataFrame, known: DataFrame, counts: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``uid, climbed``: the log chances of the grams that the tasks could not answer, added up per document."""
    seldom = scored.select("uid", F.explode(F.arrays_zip("grams", "grams_n")).alias("g")).select("uid", F.col("g.grams").alias("gram"), F.col("g.grams_n").alias("times"))
    wanted = seldom.groupBy("gram").agg(F.count("*").alias("weight")).join(known.select("gram", "log_chance"), "gram", "left")
    wanted = materialize(wanted, "lm_wanted")
    unseen = unseen_chances(wanted.filter("log_chance is null"), counts, tables)
    unseen = unseen.join(wanted.select("gram", "weight"), "gram").select("gram", "weight", "log_chance")
    chances = materialize(wanted.filter("log_chance is not null").select("gram", "weight", "log_chance").unionByName(unseen), "lm_chances")
    joined = join_spread(seldom, chances, ["gram"], "weight")
    return joined.groupBy("uid").agg(F.sum(F.col("times") * F.col("log_chance")).alias("climbed"))
