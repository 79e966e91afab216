"""Merkle manifest against trees built level by level in plain Python."""

import hashlib
import zlib

import cases
import pytest
from pyspark.sql import functions as F

from webtables.llm import merkle

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return H("".join(field(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(nodes, fanout):
    """Siblings (left, right) of each node up to the root, and the root."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for i, place in enumerate(at):
            run = runs[place // fanout]
            paths[i].append((run[: place % fanout], run[place % fanout + 1 :]))
        level, at = [H("".join(r)) for r in runs], [p // fanout for p in at]
    return paths, level[0] if level else None


def plain(rows, fanout=16):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((row["doc_id"], leaf_of(row, row["text"]), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = climb([leaf for _, leaf, _ in groups[source]], fanout)
    tops, root = climb([trees[s][1] for s in order], fanout)
    out = []
    for source, above in zip(order, tops):
        for (doc_id, leaf, row), path in zip(groups[source], trees[source][0]):
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            value = leaf_of(row, row["text"] and row["text"].translate(low)) if tampered else leaf
            for left, right in path + above:
                value = H("".join(left + [value] + right))
            proof = H("".join("".join(left + right) for left, right in path + above))
            out.append((doc_id, leaf, trees[source][1], root, proof, value, value == root))
    return sorted(out, key=repr)


def small(monkeypatch, fanout, levels):
    real = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a: real(*a, fanout=fanout, levels=levels))


def found(df):
    return sorted((tuple(r) for r in merkle.verified_documents(df).collect()), key=repr)


def test_awkward_rows(spark):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in cases.awkward_rows()]
    assert found(cases.awkward(spark)) == plain(rows)
    assert found(cases.nothing(spark)) == []
    one = rows[:1]
    assert found(cases.awkward(spark).where("doc_id = 1")) == plain(one)


@pytest.mark.parametrize("fanout,levels,parts", [(2, 1, 3), (2, 3, 7), (3, 2, 1), (16, 2, 9)])
def test_many_levels(spark, monkeypatch, fanout, levels, parts):
    rows = [dict(doc_id=i % 640, source="hot" if i % 3 else f"s{i % 7}", lang="en", n_chars=i % 5, text=f"Text {i % 50}") for i in range(700)]
    rows += [dict(doc_id=1, source=None, lang=None, n_chars=None, text=None)] * 2 + [dict(doc_id=5, source="alone", lang="x", n_chars=1, text="A")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)
    small(monkeypatch, fanout, levels)
    assert found(df) == plain(rows, fanout)


def test_manifest_keeps_all_columns(spark):
    df = spark.createDataFrame([(i, f"g{i % 2}", i, i, i) for i in range(40)], "idx long, grp string, n long, block long, `top.x` long")
    df = df.withColumn("leaf", F.unhex(F.sha2(F.col("idx").cast("string"), 256)))
    out = merkle.manifest(df, "grp", ["idx"])
    assert out.columns == [*df.columns, "subroot", "root", "witness"]
    assert out.where(merkle.folded(F.col("leaf"), F.col("witness")) == F.col("root")).count() == 40
    assert sorted(tuple(r) for r in out.select(*[f"`{c}`" for c in df.columns]).collect()) == sorted(tuple(r) for r in df.collect())
    with pytest.raises(ValueError):
        merkle.manifest(df.drop("leaf"), "grp", ["idx"])
