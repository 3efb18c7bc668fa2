"""Language identification: words first, shorter and shorter character n-grams for unseen words.

A word the model knows is scored by its log frequency in each language. An unseen word is
scored by its n-grams (edges marked) of the longest length of which any is known, as their
mean log frequency; if none is known at length 1 it says nothing. A document's score is the
share of the best language among the languages' likelihoods.

The model is fitted on at most about ``SAMPLE`` labelled documents per language, chosen by a
hash of the id, and keeps every word and n-gram of them: the sample bounds it. Everything is
scored, whole.

Null text and text without letters: ``und``, score 0. Without any labelled document there is
nothing to predict: ``und``, score 0. Ties go to the first language by code point.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import held, id_key, quoted
from panelweave.session import materialize, small_batches

SAMPLE = 1500  # labelled documents per language, about
LONGEST = 5  # letters of the longest n-gram
SMOOTH = 0.5
MEMO = 200_000  # words whose scores a task remembers
NONE = "und"
LETTERS = r"\p{L}[\p{L}\p{M}]*"


def words_of(text: str | None) -> list[str]:
    return regex.findall(LETTERS, text.lower()) if text else []


def ngrams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def learned_counts(docs: DataFrame, text: str, lang: str, doc_id: str, learn: Column, sample: int) -> DataFrame:
    """``(lang, kind, item, n)``: kind 0 words, otherwise n-grams of that length, over the sampled documents."""
    labelled = docs.select(quoted(lang).cast("string").alias("lang"), quoted(text).cast("string").alias("text"), id_key(quoted(doc_id)).alias("id"), learn.alias("learn"))
    labelled = labelled.filter("learn and lang is not null and text is not null")
    # One number per language; the texts of a language never meet in one task.
    shares = [(r.lang, min(1.0, sample / r["count"])) for r in labelled.groupBy("lang").count().collect()]
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares for x in pair]), F.col("lang")) if shares else F.lit(0.0)
    point = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.filter(point < share).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, Counter] = {}
        for batch in batches:
            for lang_, body in zip(batch["lang"], batch["text"]):
                tables.setdefault(lang_, Counter()).update(words_of(body))
        for lang_, own in tables.items():
            for k in range(LONGEST + 1):  # one length at a time is held
                found: Counter = own if k == 0 else Counter()
                for w, n in own.items() if k else ():
                    for g in ngrams(w, k):
                        found[g] += n
                if found:
                    yield pd.DataFrame({"lang": lang_, "kind": k, "item": list(found), "n": list(found.values())})

    return chosen.mapInPandas(count, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies per language of words and n-grams, found by a 64-bit hash of (length, item).

    Sorted arrays of numbers: a few dozen bytes an entry, on the driver and in every task.
    """

    def __init__(self, langs: list[str], kinds: np.ndarray, items: np.ndarray, columns: np.ndarray, n: np.ndarray, smooth: float = SMOOTH):
        self.langs = langs
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        for kind in range(LONGEST + 1):
            own = kinds == kind
            keys, place = np.unique(items[own], return_inverse=True)
            table = np.zeros((len(keys), len(langs)))
            np.add.at(table, (place, columns[own]), n[own])
            total = table.sum(axis=0) + smooth * max(1, len(keys))
            self.keys.append(keys)
            self.logs.append(np.log((table + smooth) / total))

    def find(self, kind: int, items: list[str]) -> np.ndarray:
        """The row of each item in ``logs[kind]``, -1 where it is unknown."""
        keys = self.keys[kind]
        hashes = np.fromiter((xxhash.xxh64_intdigest(i, 42) for i in items), np.uint64, len(items)).view(np.int64)
        if not len(keys):
            return np.full(len(items), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def words(self, words: list[str]) -> np.ndarray:
        """One row of log frequencies per word: its own, or the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        place = self.find(0, words)
        out[place >= 0] = self.logs[0][place[place >= 0]]
        open_ = np.nonzero(place < 0)[0]
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            grams = [ngrams(words[i], n) for i in open_]
            owner = np.repeat(np.arange(len(open_)), [len(g) for g in grams])
            place = self.find(n, [g for own in grams for g in own])
            hit = place >= 0
            times = np.bincount(owner[hit], minlength=len(open_))
            total = np.zeros((len(open_), len(self.langs)))
            np.add.at(total, owner[hit], self.logs[n][place[hit]])
            known = times > 0
            out[open_[known]] = total[known] / times[known, None]
            open_ = open_[~known]
        return out


class Scorer:
    """Scores texts and remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(self.model.langs)), np.float64)

    def _learn(self, new: set[str]) -> None:
        if len(self.place) + len(new) > MEMO and self.place:
            raise OverflowError
        words, at = list(new), len(self.place)
        while at + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at : at + len(words)] = self.model.words(words)
        self.place.update(zip(words, range(at, at + len(words))))

    def text(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return NONE, 0.0
        new = set(words).difference(self.place)
        if new:
            try:
                self._learn(new)
            except OverflowError:
                self.forget()
                self._learn(set(words))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        total = np.bincount(at, minlength=0)
        seen = np.nonzero(total)[0]
        score = total[seen] @ self.rows[seen]
        odds = np.exp(score - score.max())
        best = int(np.argmax(odds))
        return self.model.langs[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame, text: str, lang: str, doc_id: str, learn: Column, sample: int = SAMPLE) -> Model:
    """The model, bounded by the sample; only numbers come to the driver."""
    small_batches(docs.sparkSession)
    counts = materialize(learned_counts(docs, text, lang, doc_id, learn, sample), "lang_counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    named = F.element_at(F.create_map(*[F.lit(x) for pair in zip(langs, range(len(langs))) for x in pair]), F.col("lang")) if langs else F.lit(0)
    table = counts.select("kind", F.xxhash64("item").alias("item"), named.alias("lang"), "n").toArrow()
    return Model(langs, *(table.column(c).to_numpy() for c in ("kind", "item", "lang", "n")))


def detector(model: Model, docs: DataFrame):
    """Column function: text to ``struct<lang: string, score: double>``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.text(t) for t in texts], columns=["lang", "score"])

    return detect


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", parts: int = 5, part: int = 0, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per document; rows of the held-out part are not learned from."""
    out = held(quoted(doc_id), parts, part)
    detect = detector(fit(docs, text, lang, doc_id, ~out, sample), docs)
    found = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), out.alias("held_out"), detect(quoted(text).cast("string")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def identified_rows(docs: DataFrame, least: float = 0.5, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> DataFrame:
    """The rows of ``docs`` with a language of at least this score.

    Where no row is labelled nothing can be told apart, and only rows without letters go.
    """
    model = fit(docs, text, lang, doc_id, ~held(quoted(doc_id), parts, part))
    if not model.langs:
        return docs.filter(F.coalesce(quoted(text).cast("string"), F.lit("")).rlike(r"\p{L}"))
    detect = detector(model, docs)
    found = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), detect(quoted(text).cast("string")).alias("found"))
    return found.filter((F.col("found.lang") != NONE) & (F.col("found.score") >= least)).select("doc.*")
