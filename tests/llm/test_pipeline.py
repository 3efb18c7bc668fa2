"""The corpus pipeline stage by stage against plain Python, with planted copies, junk, nulls and clashing names."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelweave.llm.packing import CAPACITY, END
from panelweave.llm.tokens import PieceTokenizer
from tests.llm.test_near_dedup import shingles

SCHEMA = "doc_id long, text string, lang string, source string, file string, row long, sequence_id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(21)
    stock = {"en": [f"the{i}ing" for i in range(300)], "de": [f"über{i}keit" for i in range(300)]}
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        out.append((i, " ".join(draw.choices(stock[lang], k=draw.choice([30, 60, 200]))), lang, draw.choice("abc")))
    near = out[7][1].split()
    out += [(100 + i, out[i][1].replace(" ", " \t"), out[i][2], "a") for i in (3, 4, 4, 5)]  # exact but for white space
    out += [(200 + i, " ".join([*near, f"the{i}ing"]), "en", "b") for i in range(4)]  # near copies of 7
    out += [(300, None, "en", "a"), (301, "", "de", "b"), (302, "123 456 !!", None, "a"), (303, "the1ing " * 3000, "en", None), (None, out[9][1], "en", "c")]
    return out


@pytest.fixture(scope="module")
def stages(spark, rows):
    """The rows after each stage."""
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        out.append(docs.collect())
    return out


def test_language_stage_keeps_clean_documents(stages):
    got = Counter(r.doc_id for r in stages[1])
    assert got == Counter(r.doc_id for r in stages[0] if r.doc_id not in (300, 301, 302))
    assert stages[1][0].__fields__ == stages[0][0].__fields__


def test_exact_stage(stages):
    first: dict = {}
    for r in stages[1]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        first[key] = min(first.get(key, 10**9), 10**9 if r.doc_id is None else r.doc_id)
    assert Counter(r.doc_id for r in stages[2]) == Counter(first.values()) and None not in {r.doc_id for r in stages[2]}


def test_near_stage(stages):
    sets = {r.doc_id: shingles(r.text) for r in stages[2]}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            low = min(label[j] for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
            changed, label[i] = changed or low < label[i], min(low, label[i])
    assert {r.doc_id for r in stages[3]} == {i for i, one in label.items() if i == one}
    assert not {200, 201, 202, 203} & {r.doc_id for r in stages[3]} and 7 in {r.doc_id for r in stages[3]}


def test_mixing_stage(stages):
    size, taken = defaultdict(int), defaultdict(int)
    texts = {r.doc_id: r.text for r in stages[3]}
    for r in stages[3]:
        size[r.source] += len(WORD.findall(r.text))
    times = Counter()
    for r in stages[4]:
        taken[r.source] += len(WORD.findall(r.text))
        times[r.doc_id] += 1
        assert texts[r.doc_id].startswith(r.text) and len(r.text) > 0
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * size[s]}
        target |= {s: 2 * size[s] if s in over else share * weight[s] for s in over or open_}
        left -= sum(2 * size[s] for s in over)
        open_ -= over or set(open_)
    assert max(times.values()) <= 2 and all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_packing_stage(stages):
    tokenizer = PieceTokenizer()
    sequences = defaultdict(list)
    for p in stages[5]:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts][:-1]])) and sum(n for _, n in parts) <= CAPACITY
    want = Counter()
    for r in stages[4]:
        want[r.doc_id] += len(tokenizer.exact.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for p in stages[5]:
        got[p.doc_id] += p.length
    assert got == want
    whole = {r.doc_id: [*tokenizer.exact.encode(r.text, add_special_tokens=False).ids, END] for r in stages[4]}
    once = {i for i, n in Counter(r.doc_id for r in stages[4]).items() if n == 1}
    for p in stages[5]:
        if p.doc_id in once:
            assert zlib.crc32(np.array(whole[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32


def test_empty_tables_and_the_runner(spark, rows, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0
        if name != "pack":
            assert out.columns == none.columns
    spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.filter(F.col("length") > CAPACITY).count() == 0 and found.count() > 60
