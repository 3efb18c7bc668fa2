"""Secret scanning with a random forest that removes false positives.

Candidates are, in whole texts, keys of a known form wherever they stand, values of 6 characters
or more, of any length, assigned with = or : to a credential name, and elsewhere runs of 12 or more
token characters with a digit or both cases.
Each is described by its length, its character transitions and classes, how much of it
dictionary words cover, what its path looks like, and the words beside it. A forest trained
on labelled findings tells secrets from the rest.

A table of labelled findings (``doc_id, start, label``) trains it; see :func:`scan_secrets`. Without one,
findings that a strict rule is sure of are used: a random value assigned to a credential name, a key with a known
prefix and the body of a private key are secrets; addresses, numbers, hosts and dictionary compounds are not. Training takes at most about
``SAMPLE`` findings, chosen by hash; everything is scored.

The dictionary is the words with at least ``WORD_SHARE`` of all words, at most 1/WORD_SHARE.
Null and empty texts have no findings. If training sees one class only, the rule decides
(with a warning), and random-looking values that it is not sure of count as secrets.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted
from panelweave.session import materialize

SAMPLE = 20_000
WORD_SHARE = 2.0**-15
CANDIDATE = re.compile(r"[A-Za-z0-9_+/.@:\-]{12,}={0,2}")
CREDENTIAL = r"token|secret|passw|passphrase|passcode|pwd|api_?key|private_?key|access_?key|credential|auth"
ASSIGNED = re.compile(
    rf"(?i)(?:(?:{CREDENTIAL})\w{{0,40}}|(?<![a-z])pass)[\"']?[ \t]{{0,8}}[=:][ \t]{{0,8}}"
    r"(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"'`,;]{6,}))"
)
# Public forms of keys.
KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}"
    r"|[sr]k_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])"
)
PRIVATE = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----([A-Za-z0-9+/=\s]+)")
NAMES = re.compile(rf"(?i)(?:{CREDENTIAL})\w*$|(?<![a-z])pass$")
PLACES = re.compile(r"(?i)(?:test|example|sample|doc|spec|fixture)")
ADDRESS = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|(?:\d{1,3}\.){3}\d{1,3}|[\d\-:./+]+|(?:https?:)?/?/?[\w-]+(?:\.[\w-]+)+(?:[/:].*)?")
FEATURES = (
    "length transitions digits uppers hexes entropy coverage longest_word separators in_url in_address"
    " path_hint named assigned quoted before_length after_length"
).split()
SCHEMA = "doc_id string, start long, length long, sha256 string, rule int, " + ", ".join(f"f_{f} double" for f in FEATURES)


def classes(text: str) -> str:
    return "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in text)


def describe(text: str, start: int, end: int, path: str, dictionary: set[str], private: bool = False) -> tuple[int, list[float]]:
    """The sure label of a candidate (1 secret, 0 not, -1 unknown) and its features."""
    value = text[start:end]
    n, kinds = len(value), classes(value)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    runs = re.findall(r"[^\W\d_]+", value.lower())
    covered = sum(len(r) for r in runs if r in dictionary)
    before = text[max(0, start - 40) : start]
    gap = re.search(r"[\s\"'=:]*$", before)[0]
    name = before[: len(before) - len(gap)]
    word_before = re.search(r"\w*$", name)[0]
    word_after = re.match(r"\W*(\w*)", text[end : end + 40])[1]
    named = bool(NAMES.search(word_before))
    assigned, in_quotes = bool(re.search(r"[=:]", gap)), gap[-1:] in "\"'" and bool(gap)
    address = bool(ADDRESS.fullmatch(value.strip(".:")))
    features = [
        n, changes / n, kinds.count("d") / n, kinds.count("u") / n, sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        entropy, covered / n, max(map(len, runs), default=0), kinds.count("s"), "://" in before[-10:] + value, address,
        bool(PLACES.search(path)), named, assigned, in_quotes, len(word_before), len(word_after),
    ]
    random = in_quotes or (any(c.isdigit() for c in value) and covered < 0.5 * n)
    given = named and assigned and random and entropy > 3 and not address
    sure = 1 if given or private or KEY.fullmatch(value) else 0 if address or covered >= 0.8 * n else -1
    return sure, [float(f) for f in features]


def is_candidate(value: str) -> bool:
    return any(c.isdigit() for c in value) or (any(c.isupper() for c in value[1:]) and any(c.islower() for c in value))


def candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether it lies in a private key, of each candidate; assigned values come whole."""
    keys = [m.span(1) for m in PRIVATE.finditer(text)]

    def runs(start: int, end: int) -> Iterator[tuple[int, int, bool]]:
        for m in CANDIDATE.finditer(text, start, end):
            private = any(a <= m.start() and m.end() <= z for a, z in keys)
            if private or is_candidate(m[0]):
                yield m.start(), m.end(), private

    # Known keys stand for themselves, whatever surrounds them; values that hold one give way to it.
    whole = [m.span() for m in KEY.finditer(text)]
    given = [m.span(m.lastindex) for m in ASSIGNED.finditer(text)]
    starts = [a for a, _ in whole]

    def clear(start: int, end: int) -> bool:
        at = bisect.bisect_right(starts, start) - 1
        before = at >= 0 and whole[at][1] > start
        return not before and not (at + 1 < len(whole) and whole[at + 1][0] < end)

    at = 0
    for start, end in sorted(whole + [s for s in given if clear(*s) and not text[s[0] : s[1]].isspace()]):
        yield from runs(at, start)
        yield start, end, False
        at = end
    yield from runs(at, len(text))


def dictionary_of(docs: DataFrame, text: str, share: float = WORD_SHARE) -> set[str]:
    """Frequent words of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                found.update(t.lower().split() if t else ())
            if len(found) > 1_000_000:
                yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    words = docs.select(quoted(text).cast("string").alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words.withColumn("word", F.regexp_extract("word", r"[\p{L}]+", 0)).filter("length(word) > 2"), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    kept = words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(total * share))
    return {r.word for r in kept.select("word").collect()}


def findings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = "source", dictionary: set[str] | None = None) -> DataFrame:
    """Every candidate with its features and the rule's label."""
    words = dictionary_of(docs, text) if dictionary is None else dictionary
    shared = docs.sparkSession.sparkContext.broadcast(words)
    where = quoted(path).cast("string") if path in docs.columns else F.lit(None).cast("string")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for key, body, place in zip(batch["doc_id"], batch["text"], batch["path"]):
                for start, end, private in candidates(body or ""):
                    sure, features = describe(body, start, end, place or "", known, private)
                    digest = hashlib.sha256(body[start:end].encode("utf-8", "replace")).hexdigest()
                    out.append((key, start, end - start, digest, sure, *features))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "start", "length", "sha256", "rule", *[f"f_{f}" for f in FEATURES]])

    slim = docs.select(quoted(doc_id).cast("bigint").cast("string").alias("doc_id"), quoted(text).cast("string").alias("text"), where.alias("path"))
    return slim.mapInPandas(scan, SCHEMA)


def score(found: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE, trees: int = 60, depth: int = 8) -> DataFrame:
    """``found`` with ``score``, the forest's share for secret; trained on ``labelled`` or on the sure findings."""
    columns = [f"f_{f}" for f in FEATURES]
    train = labelled if labelled is not None else found.filter("rule >= 0").withColumn("label", F.col("rule").cast("double"))
    per = train.groupBy("label").agg(F.count("*").alias("n"))
    counts = {r.label: r.n for r in per.collect()}
    if len(counts) < 2:
        warnings.warn("findings of one class only: the rule decides instead of a forest")
        likely = (F.col("f_entropy") > 3) & (F.col("f_coverage") < 0.3) & (F.col("f_in_address") == 0) & (F.col("f_in_url") == 0)
        return found.withColumn("score", F.when(F.col("rule") >= 0, F.col("rule")).otherwise(likely.cast("int")).cast("double"))
    # Half of the sample for each class; the choice depends on the finding alone.
    point = F.pmod(F.xxhash64("doc_id", "start", "sha256"), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*[F.lit(float(x)) for k, n in counts.items() for x in (k, min(1.0, sample / 2 / n))]), F.col("label").cast("double"))
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    chosen = assembler.transform(train.filter(point < share)).select("features", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(chosen)
    scored = forest.transform(assembler.transform(found))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    path: str | None = "source",
    least: float = 0.5,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, start, length, sha256, score, is_secret`` for every candidate; ``start`` counts characters.

    ``labelled`` holds findings people have judged: ``doc_id``, ``start`` and ``label`` (1 secret, 0 not). The forest
    learns from the candidates at those places; labels at other places are of no use to it.
    """
    found = materialize(findings(docs, text, doc_id, path), "findings")
    judged = None
    if labelled is not None:
        places = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("start").cast("bigint").alias("start"), F.col("label").cast("double").alias("label"))
        judged = materialize(found.join(places.filter("label is not null").dropDuplicates(["doc_id", "start"]), ["doc_id", "start"]), "judged")
    out = score(found, judged)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "start", "length", "sha256", "score", (F.col("score") >= least).alias("is_secret"))
