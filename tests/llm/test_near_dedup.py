"""The pipeline's near copies against a comparison of all pairs."""

import random

import pytest

import corpus_pipeline
from panelweave.llm import near_dedup, simhash


def shingles(text, width=5):
    words = text.lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_force(texts, least=0.8):
    """The smallest id of each group that pairs of the similarity connect."""
    sets = {k: shingles(t or "") for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            union = len(sets[a] | sets[b])
            if a < b and (not union or len(sets[a] & sets[b]) / union >= least):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in texts if find(k) == k}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        out.append(base)
        for swaps in (1, 2, 3, 4, 6, 8):  # similarities on both sides of 0.8
            copy = list(base)
            for at in rng.sample(range(len(copy)), swaps):
                copy[at] = rng.choice(words)
            out.append(copy)
    made = [" ".join(w) for w in out] + ["a b", "A  b", "a c", None, "", " "]
    rng.shuffle(made)
    return dict(enumerate(made))


@pytest.mark.parametrize("chunk", [near_dedup.CHUNK, 400])
def test_one_of_each_equals_all_pairs(spark, texts, chunk):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.one_of_each(docs, chunk=chunk).collect()}
    assert kept == brute_force(texts)


def test_pipeline_stage_drops_copies_of_eight_tenths(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    copy = list(base)
    for at in (30, 70, 120, 160):
        copy[at] = "x"
    other = [f"w{rng.randrange(3000)}" for _ in range(200)]
    a, b = " ".join(base), " ".join(copy)
    assert 0.8 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.85
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 4  # four bits of four words do not reach it
    rows = [(1, a), (2, b), (3, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3}


def test_stage_takes_candidates_from_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(2000)]
    near = [*base[:1000], "x", *base[1001:]]
    other = [f"w{rng.randrange(3000)}" for _ in range(2000)]
    rows = [(i, " ".join(words)) for i, words in enumerate((base, near, other), 1)]
    assert (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count() <= 4
    monkeypatch.setattr(near_dedup, "bands", lambda hashes: hashes[:0].view("int64"))  # the anchors alone
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.one_of_each(docs).collect()} == {1, 3}
