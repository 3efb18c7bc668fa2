"""Ranked search against brute force, with ties, copies, nulls and long texts."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest

from panelweave.llm import lexical_search

SCHEMA = "doc_id long, text string, place long, n long, ids string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text) -> list[str]:
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k: int) -> dict:
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = defaultdict(list)
    for item, text in items:
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1):
            out[item].append((rank, None if none else i, -score))
    return {item: sorted(rows, key=str) for item, rows in out.items()}


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(13)
    words = ["alpha", "Beta", "BETA", "été", "ÉTÉ", "日本", "x1", "the", "the", "the", "rare-one", "a_b", "\x85", "\xa0nbsp"]
    out = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 6, 60])))) for i in range(150)]
    out += [(1000 - i, "the alpha, the beta!") for i in range(120)]
    out += [(None, "the alpha, the beta!"), (None, "alpha"), (5, "alpha rare"), (5, "alpha rare"), (200, None), (201, ""), (202, " .;\n"), out[3], out[3]]
    out.append((203, "the alpha x1 " * 40000 + "rare"))
    return out


@pytest.fixture(scope="module")
def items():
    return [(0, "alpha BETA the"), (1, "été rare"), (2, None), (3, ""), (4, "unknown words"), (5, "the"), (6, "日本 x1 a b \x85"), (7, "alpha alpha")]


def found(spark, docs, items, k):
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], SCHEMA)
    own = spark.createDataFrame(items, "item_id long, text string")
    out = defaultdict(list)
    for r in lexical_search.search(table, own, k).collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {item: sorted(rows, key=str) for item, rows in out.items()}


@pytest.mark.parametrize("k", [50, 3])
def test_against_brute_force(spark, docs, items, k):
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_blocks_pieces_and_chunks(spark, docs, items, monkeypatch):
    """The same rows whatever the bounds of blocks, pieces and chunks."""
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    monkeypatch.setattr(lexical_search, "CELLS", 20)
    assert found(spark, docs, items, 10) == brute(docs, items, 10)


def test_empty(spark, docs, items):
    assert found(spark, [], items, 5) == {} and found(spark, docs, [(None, None)], 5) == {}
    assert found(spark, [(1, None), (2, " ")], items, 5) == {}
    assert found(spark, docs, [(None, "alpha")], 5) == brute(docs, [(None, "alpha")], 5)
