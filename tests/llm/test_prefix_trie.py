"""The prefix trie against plain Python, with bands of different heights and nulls, ties and long conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from panelweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, depth long, n1 string, file string"


def ordered(rows) -> dict:
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in convs.items()}


def grafted(convs: dict) -> dict:
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) // 5 * 5 * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs: dict) -> Counter:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = Counter()
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out[(min(own), len(node), parent, len(own), children[node], leaves[node], saved[node], digest)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    out = []
    for c in [*range(-12, 60), 10**12, 10**12 + 1]:
        for t in range(draw.choice([1, 2, 5, 12, 20])):
            turn = draw.choice([t, t, t, None])
            out.append((c, turn, draw.choice(["user", "bot", None]), draw.choice(["", "é日", "same", "other", None])))
    out += [(None, 0, "user", "lost"), out[0], out[0], out[40]]
    out += [(100 + i, 0, "user", "hello") for i in range(30)] + [(100 + i, 1, "bot", "very " * 500) for i in range(30)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("height", [2, 3, 8])
def test_grafted_trie(spark, rows, height):
    got = Counter(tuple(r) for r in prefix_trie.trie_digests(table(spark, rows), height).collect())
    assert got == brute(grafted(ordered(rows)))


def test_plain_trie_of_long_conversations(spark, monkeypatch):
    """Chains far longer than a band and than a block: bands of bands, and sums over blocks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", "x" if t < 100 + c // 4 else str(c % 4)) for c in range(12) for t in range(130)]
    rows += [(20 + c, 0, "user", "x") for c in range(10)]
    way = prefix_trie.paths(prefix_trie.sequences(prefix_trie.ordered_turns(table(spark, rows))))
    nodes = prefix_trie.trie(way, 3).join(prefix_trie.ends(way), prefix_trie.KEY, "left")
    nothing = hashlib.sha256().hexdigest()
    got = Counter(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256 or nothing)
        for r in nodes.collect()
    )
    assert got == brute(ordered(rows))


def test_empty(spark, rows):
    assert prefix_trie.trie_digests(table(spark, [])).collect() == []
    assert prefix_trie.trie_digests(table(spark, [(None, 1, "a", "b")])).collect() == []
    one = [tuple(r) for r in prefix_trie.trie_digests(table(spark, [(3, None, None, None)])).collect()]
    assert Counter(one) == brute(grafted(ordered([(3, None, None, None)])))
