"""Line deduplication against brute force."""

from __future__ import annotations

import random
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelweave.llm import line_dedup
from panelweave.llm.common import join_spread

SCHEMA = "doc_id long, text string, file string, row long, line string, hash string, doc string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least_chars: int, least_docs: int) -> Counter:
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rank = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if not (len(holders.get(key(line), ())) >= least_docs and max(holders[key(line)], key=rank) != i)
        ]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    stock = ["", " ", "short", "An ordinary line", "ÉTÉ und Straße", "İstanbul line", "x" * 39, "Y" * 40, "é" * 12, "\x85nel\x85", "tail end"]
    out = []
    for i in range(50):
        lines = [draw.choice(stock) for _ in range(draw.choice([0, 1, 5, 30]))]
        lines = [draw.choice([s, s.upper(), f" \t{s}\r", f"\x0b{s}\x0c"]) for s in lines]
        out.append((i, "\n".join(lines)))
    out += [(50, None), (51, ""), (52, "\n\n"), (None, "An ordinary line\nshort"), (None, "An ordinary line"), out[3], out[3], out[7]]
    out.append((-5, "An ordinary line"))
    out.append((60, "An ordinary line\n" * 20000 + "end"))
    return out


@pytest.mark.parametrize("least", [(1, 3), (12, 5), (40, 5), (1, 1)])
def test_against_brute_force(spark, rows, least):
    docs = spark.createDataFrame([(i, t, "clash", 7, "l", "h", "d") for i, t in rows], SCHEMA)
    found = line_dedup.line_dedup(docs, least_chars=least[0], least_docs=least[1])
    got = Counter((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect())
    assert got == brute(rows, *least)


def test_rows_keep_their_columns(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 7, "l", "h", "d") for i, t in rows], SCHEMA)
    out = line_dedup.deduped_rows(docs, least_chars=1, least_docs=3)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((k[0], k[3]) for k in brute(rows, 1, 3).elements())


def test_empty_and_whole_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup.line_digests(none).collect() == []
    same = spark.createDataFrame([(i, "A" * 50) for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(same).select("doc.doc_id", "n_dropped", "kept").collect()}
    assert [got[i].kept for i in range(6)] == [""] * 5 + ["A" * 50] and got[0].n_dropped == 1


def test_hot_keys_are_spread(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("place"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 0")
    got = join_spread(rows, table, ["k"], "n")
    want = rows.join(table, "k")
    assert got.columns == ["k", "place", "n"] and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert join_spread(rows, table, ["k"], "n", "left").count() == 20000
