"""The pipeline on planted documents, stage by stage against brute force, and cases that once lost rows."""

import os
import random
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from webtables.llm import decontaminate, jaccard, language, mixing, toxicity, urlfilter  # noqa: E402
from webtables.llm.queries import QUERIES, URL_RULES  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NICE, RUDE = "green calm river bird tree stone cloud garden morning paper", "vilefool grubswine snotrag crudoaf slagbeast"


def planted():
    draw, rows, toxic = random.Random(7), [], {}
    plain = lambda n: " ".join(draw.choice(NICE.split()) + str(draw.randrange(300)) for _ in range(n))
    for i in range(400):
        words = plain(draw.randrange(20, 90)).split()
        toxic[i] = int(i % 5 == 0)
        for _ in range(len(words) // 5 if toxic[i] else 0):
            words.insert(draw.randrange(len(words)), draw.choice(RUDE.split()))
        rows.append([i, " ".join(words)])
    rows += [[400 + i, rows[2 * i + 1][1]] for i in range(20)]  # exact copies, some of them toxic
    rows += [[500 + i, " ".join(w if k != 7 else "new" for k, w in enumerate(rows[2 * i + 2][1].split()))] for i in range(20)]
    items = [(k, plain(25)) for k in range(5)]
    rows += [[600 + i, f"{plain(15)} {' '.join(items[i % 5][1].split()[3:18])} {plain(9)}"] for i in range(10)]
    rows += [[700, None], [701, ""], [702, "short one"], [703, "short one"], [704, rows[1][1]], [704, plain(40)], [None, plain(30)], [None, rows[3][1]]]
    rows = [(i, t, "en", None if k % 11 == 0 else f"s{k % 4}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return rows, items, toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted"))
    rows, items, toxic = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def held(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_stages_against_brute_force(spark, folder, tmp_path):
    rows, items, toxic = planted()
    docs, outputs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = held(docs)
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[:5] == COLUMNS
        outputs.append((name, before, docs))
    by = {name: (before, after) for name, before, after in outputs}

    before, after = by["toxicity"]
    kept = held(after)
    marks = set(RUDE.split())
    assert kept == [r for r in before if not marks & set((r[1] or "").split())]  # every planted one goes, nothing else

    before, after = by["ngram_jaccard_join"]
    root = cases.groups(len(before), cases.jaccard_pairs([cases.shingle_set(r[1]) for r in before]))
    classes, kept = defaultdict(list), Counter(held(after))
    for r, g in zip(before, root):
        classes[g if cases.shingle_set(r[1]) else ("none", r[0], r[1])].append(r)
    assert sum(kept.values()) == len(classes)
    for members in classes.values():
        winners = [m for m in members if kept[m]]
        assert len(winners) == 1 and winners[0][0] == min((m[0] for m in members if m[0] is not None), default=None)

    before, after = by["benchmark_decontamination"]
    assert held(after) == [r for r in before if not cases.overlap(r[1], items)[4]] and len(before) - after.count() == 10

    before, after = by["mixing_sources"]
    size = Counter()
    for r in before:
        size[r[3]] += len(cases.spaced(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    taken, copies = Counter(), Counter(held(after))
    for r, n in copies.items():
        assert r in before and n <= 3
        taken[r[3]] += n * len(cases.spaced(r[1]))
    longest = max(len(cases.spaced(r[1])) for r in before)
    assert all(abs(taken[s] - goal[s]) <= longest for s in order)
    assert all(size[s] * 3 >= goal[s] - 1e-6 for s in order) and abs(float(sum(goal.values())) - sum(size.values())) < 1e-6

    before, after = by["sharding"]
    placed = after.collect()
    assert held(after) == before and {r.shard for r in placed} <= set(range(16))
    slots, weight = defaultdict(list), Counter()
    for r in placed:
        assert r.size == len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
        weight[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(weight.values()) - min(weight.values()) <= 2 * (max(r.size for r in placed) + 0.01 * sum(weight.values()) / 16) + 2

    again = sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=repr)
    assert again == sorted(map(tuple, placed), key=repr)


def test_registered_queries_on_planted_documents(spark, folder):
    rows, items, toxic = planted()
    judged = QUERIES["op4_toxicity"](spark, folder).collect()
    assert len(judged) == len(rows)
    text = defaultdict(set)
    for r in rows:
        text[r[0]].add(bool(set(RUDE.split()) & set((r[1] or "").split())))
    assert all(r.predicted in text[r.doc_id] for r in judged)
    linked = QUERIES["op7_ngram_jaccard_join"](spark, folder).collect()
    pairs = cases.jaccard_pairs([cases.shingle_set(r[1]) for r in rows])
    degree = Counter(i for p in pairs for i in p)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_links) for r in linked) == sorted((r[0] is None, r[0] or 0, degree[k]) for k, r in enumerate(rows))
    sharded = QUERIES["op10_sharding"](spark, folder).collect()
    assert len(sharded) == len(rows) and {r.shard for r in sharded} == set(range(16))


def test_an_id_that_repeats_with_another_text_keeps_it(spark):
    a, b, c = cases.prose(1, 50), cases.prose(2, 50), cases.prose(3, 50)
    near = lambda t: t + " end"
    rows = [(1, a), (5, near(a)), (5, b), (7, near(b)), (None, c), (None, near(c)), (8, ""), (8, ""), (9, None)]
    kept = jaccard.unique_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r.doc_id, r.text) for r in kept)
    assert found.pop((None, c), 0) + found.pop((None, near(c)), 0) == 1
    assert found == {(1, a): 1, (5, b): 1, (8, ""): 1, (9, None): 1}


def longest_match(text, items):
    words, best = cases.lettered(text), 0
    for _, body in items:
        own = cases.lettered(body)
        need = min(decontaminate.WINDOW, len(own))
        for i in range(len(words)):
            for j in range(len(own)):
                n = 0
                while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                    n += 1
                if own and n >= need:
                    best = max(best, n)
    return best


def test_longest_match_follows_every_item(spark):
    start = cases.prose(1, 12)
    items = [("a", f"{start} {cases.prose(2, 20)}"), ("b", f"{start} {cases.prose(3, 28)}"), ("c", "x y")]
    draw = random.Random(3)
    noise = lambda n: " ".join(draw.choice("ab") for _ in range(n))
    items += [(f"n{k}", noise(25)) for k in range(6)]
    docs = [(0, items[0][1]), (1, items[1][1]), (2, f"{start} {cases.prose(2, 7)} x y"), (3, "x y"), (4, None)] + [(10 + k, noise(60)) for k in range(12)]
    rows = decontaminate.find_overlap(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: r.longest for r in rows} == {i: longest_match(t, items) for i, t in docs}
    assert [r.longest for r in sorted(rows, key=lambda r: r.doc_id)][:4] == [32, 40, 19, 2]


def test_any_column_name_is_carried(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "", "p", "q", "r", "s")], "page_id long, url string, html string, _action string, _blocked string, action string, `_key` string")
    out = urlfilter.filter_urls(pages, URL_RULES)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert out.drop("host", "path").collect()[0] == (1, "http://a.net/x", "", "p", "q", "r", "s", "net/", "block")
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4)], "doc_id long, text string, source string, _unit_n int, unit_n int, size int, `index` int")
    assert mixing.mix_documents(docs).collect() == docs.collect()


def test_ids_of_any_type_and_repeated_labelled_ids(spark):
    docs = spark.createDataFrame([("x", "a b c"), ("y", None), (None, "a")], "doc_id string, text string")
    assert sorted(((r.doc_id, r.n_tokens) for r in language.scored(docs).collect()), key=repr) == [("x", 4), ("y", 1), (None, 2)]
    rows = [(3, f"{NICE} {k}") for k in range(300)] + [(k, f"{NICE if k % 2 else RUDE} {k}") for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(3, 0)] + [(k, 1 - k % 2) for k in range(100, 160)], "doc_id long, toxic int")
    judged = toxicity.judged(docs, labels).collect()
    assert len(judged) == len(rows) and all(r.predicted == int(r.doc_id >= 100 and r.doc_id % 2 == 0) for r in judged)
    assert toxicity.judged(docs.where(F.lit(False)), labels).count() == 0
