"""Packing: exact round trip of every id, little padding, the same ids in both tokenizer libraries."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from webtables.llm import packing

import cases

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def whole(rows, wanted, length=packing.LENGTH):
    """Documents put together again from their pieces; sequences without a gap and within length."""
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert documents.keys() == wanted.keys()
    for doc_id, pieces in documents.items():
        spread = sorted(pieces)
        found = []
        for start, ids, total, length_ in spread:
            assert len(ids) == 4 * length_ and length_ > 0
            found.append((start, ids, total))
        joined = {}
        for start, ids, total in found:
            joined.setdefault(start, []).append(ids)
        copies = len(wanted[doc_id])
        if copies == 1:
            at = 0
            for start, ids, total in found:
                assert start == at and total == len(wanted[doc_id][0])
                at += len(ids) // 4
            assert b"".join(i for _, i, _ in found) == np.array(wanted[doc_id][0], "<u4").tobytes()
        else:
            assert sum(len(i) for _, i, _ in found) == 4 * sum(map(len, wanted[doc_id]))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding, sum(n for p in sequences.values() for _, n in p)


def wanted_ids(rows, tokenizer):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1])
    return out


def test_libraries_agree(tokenizer):
    encode = packing.encoder(SPEC)
    texts = ["", " ", "a" * 5000, " " * 5000 + "w", "\n" * 3000 + "x", "é\U0001f600‍" * 300, "<|endoftext|> x<|endoftext|>",
             "　\x1f\x85  x \r\n\t y'S 'll don't I'LL 12٣٤ ²½ _#$﻿\x00a\x7f", cases.prose(3, 300)]
    draw = random.Random(1)
    texts += ["".join(draw.choice("ab \n\t'é漢1.,- S") for _ in range(400)) for _ in range(50)]
    for text in texts:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


def test_other_tokenizers_run_in_their_own_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    assert packing.encoder(open(path, encoding="utf-8").read())("Some Words, here").tolist() == own.encode("Some Words, here", add_special_tokens=False).ids


@pytest.mark.parametrize("parts", [1, 5, 150])
def test_round_trip(spark, tokenizer, parts):
    draw = random.Random(parts)
    rows = [(i, cases.prose(i, draw.choice([0, 1, 5, 40, 300, 900, 4000]))) for i in range(200)] + [(None, "x y"), (500, None), (501, ""), (600, "twice"), (600, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    padding, total = whole(packing.pack_documents(df, SPEC).collect(), wanted_ids(rows, tokenizer))
    assert padding <= 0.005 * total


def test_small_windows_and_awkward_rows(spark, tokenizer):
    rows = [r[:2] for r in cases.awkward_rows()]
    found = packing.pack_documents(cases.awkward(spark), SPEC, length=16, most=2, room=0).collect()
    padding, _ = whole(found, wanted_ids(rows, tokenizer), 16)
    assert padding == 0
    assert packing.pack_documents(cases.nothing(spark), SPEC).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(cases.nothing(spark), SPEC, length=100)


def test_open_windows_are_bounded():
    emitted, packer = [], None
    packer = packing.Packer(emitted.append, 64, 3, 4)
    draw, total = random.Random(2), 0
    for i in range(500):
        n = draw.randrange(1, 64)
        total += n
        packer.add([packing.Part(i, 0, np.arange(n, dtype="<u4"), n)], n)
        assert len(packer.open) <= 3 and len(packer.windows) == len(packer.open)
    sizes = [sum(len(p.ids) for p in w) for w in emitted]
    assert all(60 <= s <= 64 for s in sizes)
    packer.finish()
    assert sum(len(p.ids) for w in emitted for p in w) == total


def test_sequences_and_query(spark):
    from webtables.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pieces = packing.pack_documents(docs, SPEC).cache()
    ids = {}
    for r in pieces.collect():
        ids.setdefault(r.sequence_id, []).append((r.offset, np.frombuffer(r.ids, "<u4").tolist()))
    found = packing.sequences(pieces, pad=7).collect()
    assert len(found) == len(ids)
    for r in found:
        joined = [i for _, p in sorted(ids[r.sequence_id]) for i in p]
        assert r.ids[: r.tokens] == joined and set(r.ids[r.tokens :]) <= {7}
        assert len(r.ids) in (2048, r.tokens)
    got = QUERIES["op11_packing"](spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in got) == sorted((r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in pieces.collect())
    pieces.unpersist()
