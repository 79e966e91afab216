"""Operators that judge, link, mix or place documents, against plain Python on the awkward rows and on real ones."""

import math
import os
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from webtables.llm import decontaminate, jaccard, language, mixing, quality, sharding, toxicity, words  # noqa: E402
from webtables.llm.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_words_are_found_and_hashed_alike_for_any_piece_size(monkeypatch):
    texts = [r[1] for r in cases.awkward_rows()]
    found, codes = words.text_words(pa.array(texts, pa.string()))
    assert [int(b - a) for a, b in zip(found.bounds, found.bounds[1:])] == [len(cases.spaced(t)) for t in texts]
    plain = [w.translate(cases.FOLD) for t in texts for w in cases.spaced(t)]
    assert len(set(codes.tolist())) == len(set(plain))
    monkeypatch.setattr(words, "PIECE", 16)
    assert (words.text_words(pa.array(texts, pa.string()))[1] == codes).all()


def test_long_words_are_cut_without_loss():
    data, offsets = words.flat(pa.array(["ab", "x" * 25, "yy"]))
    parts = words.split_long(words.runs(data, offsets, words.LETTERS), 10)
    assert (parts.end - parts.start).tolist() == [2, 10, 10, 5, 2] and parts.bounds.tolist() == [0, 1, 4, 5]


# mixing


def test_targets_stop_at_the_cap_and_share_the_excess():
    assert mixing.targets([10, 90, 100], [5, 2, 1]) == [30, Fraction(340, 3), Fraction(170, 3)]
    assert sum(mixing.targets([10, 90, 100], [5, 2, 1])) == 200
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(5)
    size, chance, draw = rng.integers(1, 500, 400).astype(float), np.full(400, 0.37), rng.random(400)
    out = np.array(mixing.flight(size.tolist(), chance.tolist(), draw.tolist(), False))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs((out * size).sum() - (chance * size).sum()) < 1e-4 and abs(out.sum() - chance.sum()) < 1e-6
    landed = np.array(mixing.flight(size.tolist(), chance.tolist(), draw.tolist(), True))
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (chance * size).sum()) <= 5


def test_flight_is_unbiased():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 100, 9).astype(float).tolist()
    mean = np.mean([mixing.flight(size, [0.3] * 9, rng.random(9).tolist(), False) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05


def test_mixture_of_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 9)  # several rounds
    rows = QUERIES["op2_mix_sources"](spark, SMALL).collect()
    again = QUERIES["op2_mix_sources"](spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == 200
    taken, own = Counter(), {}
    for r in rows:
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        own[r.source] = r
    place = {s: i for i, s in enumerate(sorted(own))}
    wanted = mixing.targets([own[s].source_size for s in sorted(own)], [(5, 2, 1)[i % 3] for i in range(len(own))])
    longest = max(r.size for r in rows)
    for s in own:
        assert own[s].target == float(wanted[place[s]]) and abs(taken[s] - own[s].target) <= longest


def test_a_long_text_in_a_source_beside_a_large_one(spark):
    rng = np.random.default_rng(6)
    sizes = [(s, int(n)) for s, count, most in (("large", 9000, 490), ("small", 500, 490)) for n in rng.integers(1, most, count)]
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate(sizes + [("large", 20000), ("small", 20000)])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    misses = []
    for seed in (1, 2, 3):
        found = mixing.mixture(docs, mixing.cycle(3, 4), seed=seed).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
        misses += [abs(r.taken - r.target) for r in found.collect()]
    assert len(misses) == 6 and max(misses) <= 2


def test_mixture_of_awkward_rows(spark):
    rows = mixing.mixture(cases.awkward(spark)).collect()
    assert len(rows) == len(cases.awkward_rows())
    size = {(r[0], r[3]): len(cases.spaced(r[1])) for r in cases.awkward_rows() if r[0] != 12}
    assert all(r.size == size[r.doc_id, r.source] for r in rows if r.doc_id not in (None, 12))
    whole = mixing.mix_documents(cases.awkward(spark))
    assert whole.columns == cases.awkward(spark).columns
    counts = Counter((r.doc_id, r.source) for r in whole.collect())
    copies = Counter()
    for r in rows:
        copies[r.doc_id, r.source] += r.copies
    assert counts == +copies
    assert mixing.mixture(cases.nothing(spark)).count() == 0 and mixing.mix_documents(cases.nothing(spark)).count() == 0


# toxicity


def test_toxicity_separates_held_out_texts(spark):
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = cases.prose(i, 60) + (f" lousy{'abcdefg'[i % 7]}{i % 13}" if toxic else "") + " " + cases.prose(i + 7, 30)
        rows.append((i, text, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = {r.doc_id: r for r in toxicity.judged(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) and 0 <= found[i].score <= 1 for i in found)
    assert np.mean([found[i].predicted == (i % 4 == 0) for i in held]) > 0.95


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 16)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    docs = cases.awkward(spark)
    rows = toxicity.judged(docs, labels).collect()
    assert len(rows) == len(cases.awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    same = defaultdict(set)
    for r in rows:
        if r.doc_id == 2:
            same[2].add(r.score)
    assert len(same[2]) == 1
    assert toxicity.clean_documents(docs, labels).columns == docs.columns
    assert toxicity.judged(cases.nothing(spark), labels).count() == 0
    assert {r.predicted for r in toxicity.judged(docs, labels.where("false")).collect()} == {0}


# decontamination


@pytest.mark.parametrize("block", [8 << 20, 150])
def test_overlap_with_the_benchmark(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, " ".join(cases.PROSE.split()[2:18])), (1, "green birds watch"), (None, "one two"), (4, None), (5, ""), (6, " ".join(cases.prose(1, 30000).split()[29000:29020])), (7, "two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = cases.awkward(spark)
    rows = decontaminate.find_overlap(docs, benchmark).collect()
    wanted = sorted(repr((i, *cases.overlap(t, items))) for i, t, *_ in cases.awkward_rows())
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows) == wanted
    assert max(r.longest for r in rows) == 20
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and {r.hits for r in clean.collect()} <= {"h"}
    assert clean.count() == sum(not r.contaminated for r in rows)
    assert decontaminate.find_overlap(cases.nothing(spark), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.find_overlap(docs, benchmark.where("false")).collect())


def test_suffix_arrays_cut_in_pieces_find_the_same(spark, monkeypatch, documents):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    blocks = decontaminate.tests(items)
    texts = pa.array([t for _, t, _ in documents])
    whole = decontaminate.search(texts, blocks)
    monkeypatch.setattr(decontaminate, "ARRAY_WORDS", 37)
    assert [a.to_pylist() for a in decontaminate.search(texts, blocks)] == [a.to_pylist() for a in whole]
    query = {r.doc_id: r for r in QUERIES["op5_decontaminate"](spark, SMALL).collect()}
    for i, t, _ in documents:
        r = query[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == cases.overlap(t, items)


# language model


def test_language_model_base_columns_and_gain(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op6_language_model"](spark, SMALL).collect()}
    tokens = {i: cases.spaced((t or "").translate(cases.FOLD)) + [None] for i, t, _ in documents}
    count = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(t)
    total, kinds = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[x] > 0 for x in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in t))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_the_stated_mixture(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK_TOKENS", 50)
    texts = [(i, " ".join("abcdeab"[(i * j + j) % 7] for j in range(12))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    training, held = F.col("doc_id") < 30, F.col("doc_id") % 5 == 0
    rows = {r.doc_id: r for r in language.score_documents(docs, training, held).collect()}
    weights = {}
    monkeypatch.setattr(language, "learn", lambda cells, kinds, own=language.learn: weights.setdefault("w", own(cells, kinds)))
    again = {r.doc_id: r for r in language.score_documents(docs, training, held).collect()}
    assert {i: again[i].score for i in again} == pytest.approx({i: rows[i].score for i in rows})
    word, pair, total, w = Counter(), Counter(), 0, weights["w"]
    for i, t in texts[:30]:
        own = ["^", *t.split(), "$"]
        word.update(own)
        pair.update(zip(own, own[1:]))
        total += len(own) - 1
    kinds = len(word) - 1
    for i, t in texts:
        own, value = ["^", *t.split(), "$"], 0.0
        for u, v in zip(own, own[1:]):
            b = 0 if not word[u] else int(math.log2(word[u])) + 1
            value += math.log10(w[b][0] * pair[u, v] / max(word[u], 1) + w[b][1] * word[v] / total + w[b][2] / (kinds + 1))
        assert rows[i].score == pytest.approx(value)
    assert np.allclose(w.sum(1), 1) and (w[:, 2] > 0).all()


def test_language_model_of_awkward_rows(spark):
    rows = language.scored(cases.awkward(spark)).collect()
    assert len(rows) == len(cases.awkward_rows()) and all(np.isfinite(r.score) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i is None, i or 0, len(cases.spaced(t)) + 1) for i, t, *_ in cases.awkward_rows())
    assert language.scored(cases.nothing(spark)).count() == 0


# n-gram Jaccard join


def _expected(rows):
    """Classes and links of (doc_id, text) rows without null ids."""
    sets = [cases.shingle_set(t) for _, t in rows]
    pairs = cases.jaccard_pairs(sets)
    degree = Counter(i for p in pairs for i in p)
    root = cases.groups(len(rows), pairs)
    low: dict = {}
    for (i, _), g in zip(rows, root):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [(i, (low.get(g) if sets[k] else i), degree[k]) for k, ((i, _), g) in enumerate(zip(rows, root))]


@pytest.mark.parametrize("tile", [1024, 3])
def test_join_of_awkward_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = [(r[0], r[1]) for r in cases.awkward_rows()]
    found = jaccard.link_documents(cases.awkward(spark)).collect()
    assert sorted(map(repr, ((r.doc_id, r.class_id, r.n_links) for r in found))) == sorted(map(repr, _expected(rows)))
    kept = jaccard.unique_documents(cases.awkward(spark))
    assert kept.columns == cases.awkward(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 9, 11, 12, 12, 13, 15, 16]
    assert jaccard.link_documents(cases.nothing(spark)).count() == 0


def test_join_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    rows = [(i, " ".join(w if (i * 13 + j) % 97 else f"new{i}" for j, w in enumerate(cases.prose(5, 150).split()))) for i in range(120)]
    rows += [(200 + i, cases.prose(6, 80)) for i in range(40)] + [(300 + i, cases.prose(50 + i, 40)) for i in range(30)]
    found = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == sorted(_expected(rows))


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = jaccard.least_equal(0.8, 1e-6)
    assert len(fewest) == jaccard.STEPS and fewest == sorted(fewest)
    from math import comb
    for step, least in enumerate(fewest, 1):
        n = step * jaccard.STEP
        p = 0.8 + 0.2 / 256
        assert sum(comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(least)) < 1e-3


# quality


def test_quality_measures_and_cascade(spark, documents):
    for query, rows in ((QUERIES["op8_quality_rules"](spark, SMALL), [(i, t) for i, t, _ in documents]), (quality.measured(cases.awkward(spark)), [(r[0], r[1]) for r in cases.awkward_rows()])):
        found = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in query.collect())
        assert found == sorted(repr((i, *cases.base_measures(t))) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in quality.measured(cases.awkward(spark)).collect())


def test_order_of_rules_does_not_change_the_verdict(spark, documents):
    texts = pa.array([t for _, t, _ in documents])
    rules = (*quality.BASE_RULES, *quality.RULES)
    kept, by = quality.cascade(texts, rules)
    assert (kept == quality.cascade(texts, rules[::-1])[0]).all() and (kept == ~np.any([r.rejects(texts) for r in rules], axis=0)).all()
    assert [b is None for b in by] == kept.tolist()
    calls = []
    spy = quality.Rule("spy", lambda t: calls.append(len(t)) or np.zeros(len(t), dtype=bool))
    quality.cascade(texts, (rules[0], spy))
    assert calls == [int((~rules[0].rejects(texts)).sum())]
    docs = cases.awkward(spark)
    judged = quality.judged(docs)
    assert judged.count() == docs.count() and quality.judged(cases.nothing(spark)).count() == 0
    assert [c for c in docs.columns if c != "kept"] + ["kept", "rejected_by"] == judged.columns


def test_rules_run_by_rejection_per_cost(spark):
    def slow(text):
        import time

        time.sleep(0.05)
        return np.ones(len(text), dtype=bool)

    rules = [quality.Rule("slow", slow), quality.Rule("never", lambda t: np.zeros(len(t), dtype=bool)), quality.Rule("fast", lambda t: np.ones(len(t), dtype=bool))]
    assert [r.name for r in quality.ordered(cases.awkward(spark), rules)] == ["fast", "slow", "never"]


# sharding


@pytest.mark.parametrize("bits", [8, 2])
def test_shards_are_near_equal_and_slots_gapless(spark, monkeypatch, bits):
    monkeypatch.setattr(sharding, "LEAST_BITS", bits)
    rows = [(i, cases.prose(i, 20)) for i in range(600)] + [(1000 + i, "copy of one text " * 5) for i in range(500)] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_documents(docs, 16, 0.01).collect()
    size, slots, at = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        at[r.text].add(r.shard)
    assert len(found) == len(rows) and set(size) == set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    longest = max(r.size for r in found)
    assert max(size.values()) - min(size.values()) <= 2 * (longest + 0.01 * sum(size.values()) / 16) + 2
    assert sum(len(v) > 1 for v in at.values()) <= 1  # only the group that is larger than a shard
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, sharding.shard_documents(docs.repartition(5), 16, 0.01).collect()), key=repr)


def test_shards_of_awkward_rows(spark):
    docs = cases.awkward(spark)
    found = sharding.shard_documents(docs, 4)
    assert found.count() == docs.count() and set(docs.columns) <= set(found.columns)
    slots = defaultdict(list)
    for r in found.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(cases.nothing(spark), 16).count() == 0
