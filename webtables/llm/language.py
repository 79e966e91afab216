"""Language-model scores by deleted interpolation.

The probability of a word after another is a mixture of the bigram, unigram and uniform estimates. The weights depend
on how often the context was seen (one set per power of two) and are learned by expectation-maximisation on held-out
training texts against the counts of the other ones.

Counting and look-up share one exchange. Texts are packed in blocks; a block sends each distinct n-gram once, with
its count, to the part that owns the n-gram; the part adds up and answers with the totals in the same order. So the
work grows with the distinct n-grams of the blocks, and a frequent n-gram costs one entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold, need, slices, written
from .words import FOLDED, SPACED, mix, text_words

BLOCK_TOKENS = 500_000
PART_TOKENS = 500_000  # training and other tokens for each part of the n-grams of one length
LEAST_BITS, MOST_BITS = 8, 29  # of a key that name its part; a key travels without its leading byte
HELD_OUT_PARTS = 10  # one in so many training texts serves the mixture weights
ROUNDS = 60
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
COUNTED, HELD_OUT, UNSEEN = 0, 1, 2  # kinds of blocks

_BLOCK = "block long, kind int, doc_id array<{}>, size array<int>, vocabulary binary, codes binary"
_ENTRY = "part int, block long, kind int, keys binary, counts binary"
_REPLY = "block long, part int, kind int, total binary, kept binary"


def _packed(kind: int, block: int, held: list[tuple]) -> pa.RecordBatch:
    ids = pa.concat_arrays([h[0] for h in held])
    size = np.concatenate([h[1] for h in held]).astype(np.int32)
    vocabulary, codes = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(size))]
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([kind], pa.int32()), *lists, pa.array([vocabulary.tobytes()], pa.binary()),
         pa.array([codes.astype(np.int32).tobytes()], pa.binary())], [f.split()[0] for f in _BLOCK.split(", ")])


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text with the end token after its words, and tokens per text."""
    words, codes = text_words(text, SPACED, FOLDED)
    return np.insert(codes, words.bounds[1:], END), np.diff(words.bounds) + 1


def _pack(batches):
    """Rows (doc_id, kind, text) as blocks of one kind; a block ends when it holds enough tokens."""
    base, made = TaskContext.get().partitionId() << 32, 0
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for part in slices(batch, 2):
            kinds = part.column(1).to_numpy(zero_copy_only=False)
            for kind in np.unique(kinds).tolist():
                rows = pa.array(np.flatnonzero(kinds == kind))
                tokens, size = _tokens(part.column(2).take(rows))
                held.setdefault(kind, []).append((part.column(0).take(rows), size, tokens))
                if sum(len(h[2]) for h in held[kind]) >= BLOCK_TOKENS:
                    yield _packed(kind, base + made, held.pop(kind))
                    made += 1
    for kind, rest in held.items():
        yield _packed(kind, base + made, rest)
        made += 1


def _unpacked(vocabulary: bytes, codes: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, token codes, codes of the tokens before (-1 at a text's begin), bigram keys."""
    vocabulary, code = np.frombuffer(vocabulary, dtype=np.uint64), np.frombuffer(codes, dtype=np.int32)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[np.cumsum(size) - size] = -1
    context = np.where(before >= 0, vocabulary[before], START)
    return vocabulary, code, before, mix(context * _PAIR + vocabulary[code])


def _part_bits(tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (tokens // PART_TOKENS).bit_length()))


def _sender(bits: int):
    def run(batches):
        for batch in batches:
            yield from _entries(batch, bits)

    return run


def _owners(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that own some of the sorted keys, and where the keys of each begin, with the end of all."""
    owner = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, dtype=np.int64)
    return owner[begin], np.append(begin, len(keys))


def _entries(batch: pa.RecordBatch, bits: int):
    for block, kind, size, words, codes in zip(*(batch.column(i).to_pylist() for i in range(5))):
        vocabulary, code, _, pair = _unpacked(words, codes, np.array(size, dtype=np.int64))
        pairs, often = np.unique(pair, return_counts=True)
        out = []
        for first, keys, counts in ((0, pairs, often), (1 << bits, vocabulary, np.bincount(code, minlength=len(vocabulary)))):
            if kind == UNSEEN:
                counts = np.zeros(len(keys), dtype=np.int64)
            low = keys.view(np.uint8).reshape(-1, 8)[:, :7]
            owner, ends = _owners(keys, bits)
            for p, a, b in zip(owner.tolist(), ends[:-1], ends[1:]):
                out.append((first + p, block, kind, low[a:b].tobytes(), _squeeze(counts[a:b]) if kind != UNSEEN else b""))
        columns = list(zip(*out))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in _ENTRY.split(", ")])


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow as 8-byte numbers."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype(np.int64).tobytes()


def _stretch(data: bytes, count: int) -> np.ndarray:
    out = np.frombuffer(data, dtype=np.uint8, count=count).astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype=np.int64, offset=count) if len(data) > count else out[out == 255]
    return out


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of one part: for each block the totals over all training texts, for held-out ones also those without them.

    The row of block -1 holds the number of distinct training keys, with and without the held-out texts.
    """
    part = table["part"][0].as_py()
    blocks, kinds = table["block"].to_pylist(), table["kind"].to_pylist()
    packed, counts = table["keys"].to_pylist(), table["counts"].to_pylist()
    sizes = [len(k) // 7 for k in packed]
    keys = np.zeros((sum(sizes), 8), dtype=np.uint8)
    keys[:, :7] = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, 7)
    keys, at = np.unique(keys.view(np.uint64).reshape(-1), return_inverse=True)
    total, kept, low = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64), 0
    places = []
    for kind, size, count in zip(kinds, sizes, counts):
        place = at[low : low + size]
        low += size
        places.append(place)
        if kind != UNSEEN:  # keys of one block are distinct
            values = _stretch(count, size)
            total[place] += values
            if kind == COUNTED:
                kept[place] += values
    out = [(-1, part, -1, np.int64((total > 0).sum()).tobytes(), np.int64((kept > 0).sum()).tobytes())]
    for block, kind, place in zip(blocks, kinds, places):
        out.append((block, part, kind, _squeeze(total[place]), _squeeze(kept[place]) if kind == HELD_OUT else b""))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(_REPLY.split(", "), zip(*out), types)})


def _lookup(blocks: pa.Table, replies: pa.Table, column: str, bits: int) -> tuple | None:
    """doc_id, tokens per text, and per token: count of the pair, of the word, of the context."""
    if not blocks.num_rows:
        return None
    size = np.array(blocks["size"][0].as_py(), dtype=np.int64)
    vocabulary, code, before, pair = _unpacked(blocks["vocabulary"][0].as_py(), blocks["codes"][0].as_py(), size)
    pairs, at = np.unique(pair, return_inverse=True)
    parts, blobs = replies["part"].to_numpy(), replies[column].to_pylist()
    found = []
    order = {int(p): i for i, p in enumerate(parts)}
    for first, keys in ((0, pairs), (1 << bits, vocabulary)):
        owner, ends = _owners(keys, bits)
        found.append(np.concatenate([_stretch(blobs[order[first + p]], int(n)) for p, n in zip(owner.tolist(), np.diff(ends))]))
    word = found[1][code]
    end = found[1][np.searchsorted(vocabulary, END)]  # every text is begun once and ended once
    context = np.where(before >= 0, found[1][before], end)
    return blocks["doc_id"].combine_chunks().flatten(), size, found[0][at], word, context


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of log2 of its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def _cells(total: int, bits: int):
    """Held-out tokens added up over cells of bucket, bigram estimate and unigram estimate (tenths of log10)."""
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        found = _lookup(blocks, replies, "kept", bits)
        names = ("bucket", "pair", "word", "n", "pair_sum", "word_sum")
        if found is None:
            return pa.table({n: pa.array([], pa.int64() if i < 4 else pa.float64()) for i, n in enumerate(names)})
        _, _, pair, word, context = found
        p2, p1 = pair / np.maximum(context, 1), word / max(total, 1)
        cell = lambda p: np.where(p > 0, np.floor(10 * np.log10(np.maximum(p, 1e-30))).astype(np.int64), -999)
        keys, at = np.unique(np.stack([bucket(context), cell(p2), cell(p1)]), axis=1, return_inverse=True)
        at = at.reshape(-1)
        sums = [np.bincount(at), np.bincount(at, p2), np.bincount(at, p1)]
        return pa.table({n: pa.array(v) for n, v in zip(names, [*keys, *sums])})

    return run


def learn(cells: list[tuple], kinds: int) -> np.ndarray:
    """Mixture weights (bucket x bigram, unigram, uniform) by EM over cells (bucket, n, mean bigram, mean unigram).

    One imagined token for each component keeps every weight above 0. A bucket without held-out tokens takes the
    weights of the one below it. Contexts never seen have no bigram estimate.
    """
    weights = np.zeros((65, 3))
    last = np.array([0.3, 0.6, 0.1])
    for b in range(65):
        own = np.array([c[1:] for c in cells if c[0] == b], dtype=float).reshape(-1, 3)
        if len(own):
            chance = np.stack([own[:, 1], own[:, 2], np.full(len(own), 1 / (kinds + 1))], axis=1)
            w = last.copy()
            if b == 0:
                w = np.array([0.0, 0.8, 0.2])
            for _ in range(ROUNDS):
                share = chance * w
                share *= (own[:, 0] / np.maximum(share.sum(1), 1e-300))[:, None]
                w = share.sum(0) + (w > 0)
                w /= w.sum()
            if b:
                last = w
        else:
            w = last if b else np.array([0.0, 0.8, 0.2])
        weights[b] = w
    return weights


def _score(weights: np.ndarray, total: int, kinds: int, bits: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        found = _lookup(blocks, replies, "total", bits)
        if found is None:
            return pa.table({"doc_id": pa.array([], blocks.schema.field("doc_id").type.value_type), "kind": pa.array([], pa.int32()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        ids, size, pair, word, context = found
        first = np.cumsum(size) - size
        w = weights[bucket(context)]
        p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(total, 1)) + w[:, 2] / (kinds + 1)
        base = np.log10((word + 1) / (total + (kinds + 1)))
        return pa.table({
            "doc_id": ids, "kind": pa.array(np.full(len(size), blocks["kind"][0].as_py()), pa.int32()), "n_tokens": pa.array(size),
            "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), first)),
            "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(np.log10(p), first))})

    return run


def score_documents(docs: DataFrame, training: Column, held_out: Column) -> DataFrame:
    """doc_id, trained (boolean), n_tokens, n_known, train_tokens, base_score, score of every document.

    ``training`` tells the texts whose counts the model uses, ``held_out`` those of them that serve the mixture weights
    (a null counts as false). Tokens are words between ASCII white space, A-Z folded, and one end per text, so null,
    empty and blank texts have one token. Without training texts every known count is 0 and a token has the uniform
    probability. Repeated rows are counted as often as they occur; ids may be null and of any type; no other column is read.
    """
    need(docs, "doc_id", "text")
    kind = F.when(F.coalesce(training, F.lit(False)), F.when(F.coalesce(held_out, F.lit(False)), HELD_OUT).otherwise(COUNTED)).otherwise(UNSEEN)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = written(docs.select("doc_id", kind.cast("int").alias("kind"), "text").mapInArrow(_pack, _BLOCK.format(id_type)))
    size = F.aggregate("size", F.lit(0).cast("bigint"), lambda a, b: a + b)
    tokens = {k: n for k, n in blocks.groupBy("kind").agg(F.sum(size)).collect()}
    bits = _part_bits(sum(tokens.values()))
    entries = blocks.select("block", "kind", "size", "vocabulary", "codes").mapInArrow(_sender(bits), _ENTRY)
    replies = written(entries.groupBy("part").applyInArrow(_add_up, _REPLY))

    kinds = replies.where((F.col("block") == -1) & (F.col("part") >= 1 << bits)).select("total", "kept").collect()
    all_kinds, kept_kinds = (sum(int(np.frombuffer(r[i], dtype=np.int64)[0]) for r in kinds) for i in (0, 1))
    kept_tokens = tokens.get(COUNTED, 0)
    all_tokens = kept_tokens + tokens.get(HELD_OUT, 0)

    def answered(some: DataFrame, answers: DataFrame, function, schema: str) -> DataFrame:
        return some.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(function, schema)

    cells = answered(
        blocks.where(F.col("kind") == HELD_OUT), replies.where(F.col("kind") == HELD_OUT).select("block", "part", "kept"), _cells(kept_tokens, bits),
        "bucket long, pair long, word long, n long, pair_sum double, word_sum double")
    cells = cells.groupBy("bucket", "pair", "word").agg(F.sum("n"), F.sum("pair_sum"), F.sum("word_sum")).collect()
    weights = learn([(b, n, x / n, y / n) for b, _, _, n, x, y in sorted(map(tuple, cells))], kept_kinds)
    rows = answered(
        blocks, replies.where(F.col("block") >= 0).select("block", "part", "total"), _score(weights, all_tokens, all_kinds, bits),
        f"doc_id {id_type}, kind int, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", (F.col("kind") != UNSEEN).alias("trained"), "n_tokens", "n_known", F.lit(all_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def scored(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those whose id is not in fold 2 of 7."""
    training = fold(F.col("doc_id"), 7) != 2
    weights = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT_PARTS)) == 0
    rows = score_documents(docs, training, weights)
    return rows.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
