"""Text operators against brute force, on small tables with nulls, ties, empties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import exact_dedup, langid, lm_score, mixing, packing, permutation_index, secret_scan, simhash, token_counts, token_shards
from panelweave.llm.common import located
from panelweave.llm.tokens import PieceTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, file string, row long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta", "été", "über", "日本", "x1y2", "omega.", "the"]
    out = []
    for i in range(60):
        body = " ".join(draw.choice(words) for _ in range(draw.choice([1, 3, 40, 200])))
        out.append((i, body, draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", None]), "clash", i))
    out += [(60, None, "en", "a", None, 0), (61, "", None, None, None, 0), (62, " \t\n ", "en", "b", "", 1)]
    out += [(63, out[3][1].replace(" ", "  "), "en", "c", "", 1), (None, out[4][1], "en", "c", "", 1), out[5], out[5]]
    out.append((64, "longtext " * 30000, "en", "a", "", 2))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_dedup(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    got = exact_dedup.dedup(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    sizes = {hashlib.sha256(t.encode()).hexdigest(): (min(i for i in ids if i is not None), len(ids)) for t, ids in groups.items()}
    assert all(sizes[r.digest] == (r.keep_id, r.group_size) for r in got)
    weak = exact_dedup.dedup(docs, digest=lambda c: F.substring(exact_dedup.sha256(c), 1, 1)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in weak) == Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert exact_dedup.unique_rows(docs).count() == len(groups) and exact_dedup.dedup(none).count() == 0


def test_dedup_checks_bytes_across_calls(spark, tmp_path):
    """A digest that tells texts apart by length only: every call decides on the texts of all calls."""
    calls = [[(5, "aa"), (2, "aa"), (9, "ccc")], [(3, "bb"), (1, "aa"), (4, "bb")], [(0, "bb"), (8, "aa"), (7, "ddd"), (6, "ccc")], [(10, "e" * 5)]]
    seen: list = []
    for rows in calls:
        seen += rows
        got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda c: F.length(c).cast("string"), state_dir=str(tmp_path))
        alike = {i: [j for j, t in seen if t == text] for i, text in rows}
        want = Counter((i, min(same), len(same), min(same) == i) for i, same in alike.items())
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want


def test_simhash_components(spark, docs, rows, none):
    got = simhash.simhash(docs).collect()
    prints = np.array([simhash.fingerprint(r[1]) for r in rows], np.int64).view(np.uint64)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min(label[j] for j in range(len(rows)) if np.bitwise_count(prints[i] ^ prints[j]) <= 4)
            changed, label[i] = changed or low < label[i], min(low, label[i])
    least = defaultdict(lambda: 10**9)
    for r, one in zip(rows, label):
        least[one] = min(least[one], r[0] if r[0] is not None else 10**9)
    want = Counter((r[0], f"{p:016x}", least[one]) for r, p, one in zip(rows, prints, label))
    assert Counter(tuple(r) for r in got) == want and simhash.simhash(none).count() == 0
    assert simhash.one_of_each(docs).count() == len(set(label))


def test_simhash_crowded_anchor(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**62, 3)
    fps = np.unique(np.concatenate([base, base[0] ^ np.bitwise_or.reduce(1 << draw.integers(0, 62, (400, 3)), axis=1)]))
    nodes = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    linked = {tuple(r) for r in simhash.links(nodes, 4, cell=16).collect()}
    assert len(linked) < 40 * len(fps)
    assert {x for pair in linked for x in pair} >= {int(x) for x in fps if np.bitwise_count(x ^ base[0]) <= 3}


def test_pack_round_trip(docs, rows, none):
    tokenizer = PieceTokenizer()
    pieces = packing.pack(docs).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    want = Counter()
    for r in rows:
        ids = [*tokenizer.exact.encode(r[1] or "", add_special_tokens=False).ids, packing.END]
        for p in pieces:
            if p.doc_id == r[0] and p.doc_tokens == len(ids):
                own = np.array(ids[p.start : p.start + p.length], "<u4")
                assert zlib.crc32(own.tobytes()) == p.ids_crc32
        want[r[0]] += len(ids)
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want and packing.pack(none).count() == 0


def test_fast_ids_equal_the_tokenizers():
    tokenizer, draw = PieceTokenizer(), random.Random(1)
    parts = ["a", "b'", "'s", " ", "\n", "\t", "1", "é", ".", "!!", "  ", "Ā", "日", "<|endoftext|>", "\x00", " the", "\x85", "\xa0"]
    for text in ["", *("".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(3000))]:
        assert tokenizer.ids(text).tolist() == tokenizer.exact.encode(text, add_special_tokens=False).ids


def test_mixing(docs, rows, none):
    got = mixing.mix_plan(located(docs), block_words=64, shard_words=256).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * size[s]}
        for s in over or set(open_):
            target[s] = 2 * size[s] if over else share * weight[s]
        left -= sum(2 * size[s] for s in over)
        open_ -= over or set(open_)
    taken = defaultdict(int)
    by_id = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken <= 2 * r.size and abs(r.target - target[by_id[r.doc_id]]) < 1e-6 and r.source_size == size[by_id[r.doc_id]]
        taken[by_id[r.doc_id]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mix_plan(located(docs), block_words=64, shard_words=256).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and abs(sum(len(WORD.findall(r.text)) for r in mixed.collect()) - sum(taken.values())) == 0
    assert mixing.mix_plan(located(none)).count() == 0


def test_language_id(spark, docs, none):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[60].lang_pred == got[61].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(none).count() == 0
    made = [(i, "the house of words" if i % 2 else "la maison des mots", "en" if i % 2 else "fr") for i in range(80)]
    own = spark.createDataFrame(made, "doc_id long, text string, lang string")
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in langid.identify(own).collect())
    assert langid.identified_rows(own).count() == 80 and langid.identified_rows(own.withColumn("lang", F.lit(None))).count() == 80


def test_language_id_against_brute_force(spark, docs, rows):
    """Word-first backoff worked out with plain counters over every learned document."""
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.identify(docs).collect())
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    counts: dict = defaultdict(Counter)  # (kind, language) -> items
    for i, text, lang, *_ in rows:
        if lang and text and not held(i):
            for w in langid.words_of(text):
                counts[0, lang][w] += 1
                for k in range(1, langid.LONGEST + 1):
                    marked = f"^{w}$" if k > 1 else w
                    for at in range(len(marked) - k + 1):
                        counts[k, lang][marked[at : at + k]] += 1
    langs = sorted({lang for _, lang in counts})
    known = {k: set().union(*(counts[k, lang] for lang in langs)) for k in range(langid.LONGEST + 1)}

    def log(kind, item, lang):
        own = counts[kind, lang]
        return np.log((own[item] + langid.SMOOTH) / (sum(own.values()) + langid.SMOOTH * len(known[kind])))

    def word(w, lang):
        if w in known[0]:
            return log(0, w, lang)
        for k in range(langid.LONGEST, 0, -1):
            marked = f"^{w}$" if k > 1 else w
            seen = [g for g in (marked[at : at + k] for at in range(len(marked) - k + 1)) if g in known[k]]
            if seen:
                return np.mean([log(k, g, lang) for g in seen])
        return 0.0

    want, memo = Counter(), {}
    for i, text, *_ in rows:
        words = Counter(langid.words_of(text))
        score = np.zeros(len(langs))
        for w, n in words.items():
            memo.setdefault(w, np.array([word(w, lang) for lang in langs]))
            score += n * memo[w]
        odds = np.exp(score - score.max())
        best = int(np.argmax(odds))
        want[(i, held(i), langs[best], round(float(odds[best] / odds.sum()), 6)) if words else (i, held(i), "und", 0.0)] += 1
    assert got == want


def learned(texts: list[bytes]) -> dict:
    """Context (0 to ORDER bytes) to symbol counts."""
    counts: dict = defaultdict(Counter)
    for t in texts:
        whole = bytes([lm_score.EDGE]) * lm_score.ORDER + t + bytes([lm_score.EDGE])
        for at in range(lm_score.ORDER, len(whole)):
            for k in range(lm_score.ORDER + 1):
                counts[whole[at - k : at]][whole[at]] += 1
    return counts


def partial_matching(counts: dict, text: bytes) -> float:
    """log10 probability, symbol by symbol, with the exclusions spelled out."""
    whole = bytes([lm_score.EDGE]) * lm_score.ORDER + text + bytes([lm_score.EDGE])
    out, memo = 0.0, {}
    for at in range(lm_score.ORDER, len(whole)):
        gram = whole[at - lm_score.ORDER : at + 1]
        if gram not in memo:
            log, gone = 0.0, set()
            for k in range(lm_score.ORDER, -1, -1):
                seen = counts.get(gram[lm_score.ORDER - k : lm_score.ORDER], {})
                open_ = {s: n for s, n in seen.items() if s not in gone}
                if gram[-1] in open_:
                    log += np.log10(open_[gram[-1]] / (sum(open_.values()) + len(open_)))
                    break
                if open_:
                    log += np.log10(len(open_) / (sum(open_.values()) + len(open_)))
                gone |= set(seen)
            else:
                log -= np.log10(max(1, 256 - len(counts.get(b"", {}))))
            memo[gram] = log
        out += memo[gram]
    return out


@pytest.mark.parametrize("settings", [{}, {"most": 0, "word_share": 1.0}, {"most": 200}])
def test_language_model(docs, rows, none, settings):
    got = lm_score.lm_score(docs, **settings).collect()
    words = lambda t: [w.lower() for w in WORD.findall(t or "")]
    train = [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2]
    assert len(train) < len(rows)
    counts = Counter(w for r in train for w in words(r[1]))
    counts[""] = len(train)
    n, v = sum(counts.values()), len(counts)
    model = learned([lm_score.spelled(r[1]) for r in train])
    want = Counter()
    for r in rows:
        own = [*words(r[1]), ""]
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        score = partial_matching(model, lm_score.spelled(r[1]))
        want[(r[0], len(own), sum(counts[w] > 0 for w in own), n, round(base, 4), round(score, 4))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    assert lm_score.lm_score(none).count() == 0


def test_language_model_of_unseen_text(spark):
    """Held-out texts with contexts and symbols that training lacks; and nothing to learn from."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "the cat sat on the mat") for i in range(200) if i not in held] + [(held[0], "the mat sat"), (held[1], "Zürich 日本!"), (held[2], None)]
    got = {r.doc_id: r.score for r in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    model = learned([lm_score.spelled(t) for i, t in rows if i not in held])
    for i in held[:3]:
        assert abs(got[i] - partial_matching(model, lm_score.spelled(dict(rows)[i]))) < 1e-9
    alone = lm_score.lm_score(spark.createDataFrame([(held[0], "ab")], "doc_id long, text string")).first()
    assert abs(alone.score + 3 * np.log10(256)) < 1e-9


def test_chances_add_up(spark):
    train = spark.createDataFrame([("the cat sat on the mat. the hat.",)], "text string")
    counts = lm_score.count_corpus(train)
    tables = lm_score.contexts(counts)
    known = {r.gram: r.log_chance for r in lm_score.known_chances(counts, tables).collect()}
    for context in (b"the h", b"zzthe", b"zzzzz"):
        every = [int.from_bytes(context + bytes([b]), "big") for b in range(256)]
        wanted = spark.createDataFrame([(g,) for g in every if g not in known], "gram long")
        rest = {r.gram: r.log_chance for r in lm_score.unseen_chances(wanted, counts, tables).collect()}
        assert len(rest) + sum(g in known for g in every) == 256
        assert abs(sum(np.exp(rest.get(g, known.get(g))) for g in every) - 1) < 1e-9


def test_nearest_neighbours(spark):
    draw = np.random.default_rng(2)
    vecs = [(i, draw.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    odd = [(500, None), (600, [0.0] * 8), (700, [1.0, None] + [1.0] * 6), (800, [float("nan")] * 8), (900, [1.0]), (None, [1.0] * 8)]
    got = permutation_index.search(spark.createDataFrame(vecs + odd + vecs[:5], "vec_id long, embedding array<double>"), cell=64).collect()
    ids, x = np.array([i for i, _ in vecs]), np.array([v for _, v in vecs])
    found = 0
    for q in (0, 100, 200, 300, 400):
        gap = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for _, i in sorted(zip(gap, ids)) if i != q][:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(abs(gap[i] - s) < 1e-12 for _, i, s in own)
        found += len(set(best) & {i for _, i, _ in own})
    assert found >= 45 and {r.query_id for r in got} == {0, 100, 200, 300, 400}
    assert permutation_index.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_piece_counts(docs, rows, none):
    pieces = set(token_counts.read_pieces("piece_bpe_32k.model"))

    def greedy(text: str) -> int:
        total = 0
        while text:
            n = next((n for n in range(min(40, len(text)), 0, -1) if text[:n] in pieces), 0)
            total += 1 if n else len(text[0].encode())
            text = text[max(1, n) :]
        return total

    want = Counter((r[0], len(WORD.findall(r[1] or "")), sum(greedy("▁" + w) for w in WORD.findall(r[1] or ""))) for r in rows if len(r[1] or "") < 5000)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs).collect() if r.doc_id != 64)
    assert got == want and token_counts.token_counts(none).count() == 0


def test_token_shards(docs, none):
    path = token_shards.shard_folder(docs)
    got = token_shards.write_shards(docs, path, length=128, shard_sequences=64).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got))) and len({r.shard for r in got}) > 1
    for r in got[:40]:
        ids = token_shards.read_run(path, r.shard, r.byte_offset // 256, 1, 128)[0]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
    for size in (1, 2, 5, 1000):
        assert sorted(token_shards.permute(np.arange(size), size).tolist()) == list(range(size))
    assert token_shards.write_shards(none, token_shards.shard_folder(none)).count() == 0


def test_secrets(spark, none):
    draw = random.Random(4)
    made = []
    for i in range(60):
        value = "".join(draw.choice("0123456789abcdef") for _ in range(40))
        made.append((i, f'set token = "{value}" and mail a{i}.b@mail{i}.example.com or {draw.randint(10**15, 10**16)}', "src"))
    got = secret_scan.scan_secrets(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()
    assert all(r.is_secret == (r.length == 40) for r in got) and sum(r.is_secret for r in got) == 60
    assert secret_scan.scan_secrets(none).count() == 0
