"""Toxicity by two class-conditional Kneser-Ney models over the spelling of words.

One model is trained on texts labelled toxic, one on ordinary texts. Each spells a word byte by byte from up to
``ORDER - 1`` bytes before; long contexts are counted by class with absolute discount, shorter ones by the number of
distinct bytes seen before them, and n-grams of up to ``SHARED`` bytes are counted over both classes. So an expression
that is rare in either class, or a new form of a known stem, is judged by what it shares with others. The
log-likelihood ratio of each word is normalised by length; a text is read by its mean ratio and by its highest words,
and a logistic calibration on labelled texts kept out of the counts turns these into a score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import annotate, fold, hidden, need, slices
from .words import LETTERS, flat, runs, span_codes, split_long

PER_CLASS = 6000  # labelled texts per class, chosen by the hash of the id; a third of them serves the calibration
ORDER, SHARED = 6, 2
DISCOUNT = 0.8
HIGHEST, FEATURES = 3, 4
BEGIN, FINISH = 2, 3  # bytes that no word holds
PIECE = 50_000  # distinct words spelled at a time
LONGEST_WORD = 1000  # bytes; a longer word is read in pieces
SLICE_BYTES = 2 << 20  # text read at a time
KNOWN_WORDS = 1 << 19  # distinct words whose ratio a task remembers


class Level(NamedTuple):
    """Counts of one n-gram length, by class; codes are the packed bytes, last byte lowest."""

    grams: np.ndarray
    count: np.ndarray  # classes x grams
    contexts: np.ndarray
    total: np.ndarray  # classes x contexts
    kinds: np.ndarray


class Model(NamedTuple):
    levels: list[Level]
    weight: np.ndarray  # calibration: one weight per feature, then the intercept


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words with a mark before and after each, A-Z folded; place in the word; word of each byte."""
    size = end - start + 2
    kind = np.int32 if size.sum() < 1 << 31 else np.int64  # all words of the sample are spelled at once
    first = (np.cumsum(size) - size).astype(kind)
    word = np.repeat(np.arange(len(start), dtype=kind), size)
    place = np.arange(size.sum(), dtype=kind) - first[word]
    source = np.clip(start[word] + place - 1, 0, max(len(data) - 1, 0))
    out = data[source] if len(data) else np.zeros(0, dtype=np.uint8)
    out = np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)
    out[first] = BEGIN
    out[first + size - 1] = FINISH
    return out, place, word


def codes(data: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end at each byte, and whether the word reaches so far back."""
    total = np.zeros(len(data), dtype=np.uint64)
    for j in range(length):
        total[j:] |= data[: len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    return total, place >= max(length - 1, 1)


def build(data: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> list[Level]:
    """Levels from distinct words and their weight by class (2 x words)."""
    letters, place, word = spelled(data, start, end)
    levels: list[Level] = []
    above: tuple[np.ndarray, np.ndarray] | None = None
    for length in range(ORDER, 0, -1):
        code, there = codes(letters, place, length)
        anchored = there & (place == length - 1) if length > 1 else np.zeros(len(code), dtype=bool)
        used = there if length == ORDER else anchored
        keys, values = [code[used]], [weight[:, word[used]]]
        if above is not None:
            keys.append(above[0] & np.uint64((1 << 8 * length) - 1))
            values.append((above[1] > 0).astype(float))
        keys, values = np.concatenate(keys), np.concatenate(values, axis=1)
        grams, at = np.unique(keys, return_inverse=True)
        count = np.stack([np.bincount(at, v, len(grams)) for v in values])
        above = grams, count
        if length <= SHARED:
            count = np.repeat(count.sum(0, keepdims=True), 2, axis=0)
        contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
        total = np.stack([np.bincount(at, c, len(contexts)) for c in count])
        kinds = np.stack([np.bincount(at, c > 0, len(contexts)) for c in count]).astype(float)
        levels.append(Level(grams, count, contexts, total, kinds))
    return levels[::-1]


def _look(keys: np.ndarray, sought: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    known = keys[at] == sought
    return [np.where(known, v[at], 0.0) for v in values]


def ratios(levels: list[Level], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio, toxic against ordinary, of each word."""
    out = np.zeros(len(start))
    if not levels or not len(levels[0].grams):
        return out
    for at in range(0, len(start), PIECE):
        letters, place, word = spelled(data, start[at : at + PIECE], end[at : at + PIECE])
        chance = np.full((2, len(letters)), 1 / 256)
        for length, level in enumerate(levels, 1):
            code, there = codes(letters, place, length)
            i = np.flatnonzero(there)
            count = _look(level.grams, code[i], [level.count[0], level.count[1]])
            found = _look(level.contexts, code[i] >> np.uint64(8), [level.total[0], level.total[1], level.kinds[0], level.kinds[1]])
            for c in (0, 1):
                safe = np.maximum(found[c], 1e-9)
                seen = np.maximum(count[c] - DISCOUNT, 0.0) / safe + DISCOUNT * found[2 + c] / safe * chance[c, i]
                # weights of rare words are fractions, so a context may hold less than its discounts
                chance[c, i] = np.where(found[c] > 0, np.clip(seen, 1e-12, 1.0), chance[c, i])
        ratio = np.where(place > 0, np.log(chance[1]) - np.log(chance[0]), 0.0)
        out[at : at + PIECE] = np.bincount(word, ratio, min(PIECE, len(start) - at))
    return out


class Known:
    """Ratios of the words that a task has met, by the hash of the word; forgotten when they are too many."""

    def __init__(self, levels: list[Level]):
        self.levels, self.code, self.ratio = levels, np.zeros(0, dtype=np.uint64), np.zeros(0)

    def of(self, data: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ratios of distinct words, given in the order of their hashes."""
        place = np.searchsorted(self.code, code)
        new = np.ones(len(code), dtype=bool)
        if len(self.code):
            new = self.code[np.minimum(place, len(self.code) - 1)] != code
        out = np.empty(len(code))
        out[~new] = self.ratio[place[~new]]
        order = np.argsort(start[new])  # spans are read in text order
        value = np.empty(len(order))
        value[order] = ratios(self.levels, data, start[new][order], end[new][order])
        out[new] = value
        if len(self.code) + len(value) > KNOWN_WORDS:
            self.code, self.ratio = code, out
        else:
            self.code, self.ratio = np.insert(self.code, place[new], code[new]), np.insert(self.ratio, place[new], value)
        return out


def features(known: Known, text: pa.Array) -> np.ndarray:
    """Per text: mean ratio of its words, mean of the highest three, of the highest, log of its words."""
    data, offsets = flat(text)
    words, rows = split_long(runs(data, offsets, LETTERS), LONGEST_WORD), len(text)
    code, first, at = np.unique(span_codes(data, words.start, words.end), return_index=True, return_inverse=True)
    ratio, size = known.of(data, code, words.start[first], words.end[first])[at], np.diff(words.bounds)
    some = np.maximum(size, 1)
    out = [np.bincount(words.row, ratio, rows) / some]
    ranked = np.lexsort((-ratio, words.row))
    best = np.where(np.arange(len(ratio)) - words.bounds[words.row[ranked]] < HIGHEST, ratio[ranked], 0.0)
    out.append(np.bincount(words.row[ranked], best, rows) / np.minimum(some, HIGHEST))
    top = np.zeros(rows)
    top[size > 0] = ratio[ranked][words.bounds[:-1][size > 0]]
    out += [top, np.log1p(size)]
    return np.stack(out, axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge; ``prior`` is the share of label 1 among all labels."""
    if not len(y) or y.min() == y.max():
        return np.concatenate([np.zeros(x.shape[1]), [1.0 if len(y) and y.max() else -1.0]])
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (share * (y - p)) - 1e-3 * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return w


def scores(known: Known, weight: np.ndarray, text: pa.Array) -> np.ndarray:
    x = features(known, text)
    return 1 / (1 + np.exp(-np.clip(x @ weight[:-1] + weight[-1], -30, 30)))


def _word_weights(batches):
    """Distinct words of each text by class, added up over some texts; words stay bytes."""
    for part in (p for batch in batches for p in slices(batch, 0, SLICE_BYTES)):
        text, toxic = part.column(0), part.column(1).to_numpy(zero_copy_only=False)
        data, offsets = flat(text)
        words = split_long(runs(data, offsets, LETTERS), LONGEST_WORD)
        code = span_codes(data, words.start, words.end)
        order = np.lexsort((code, words.row))
        code, row = code[order], words.row[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        code, row, order = code[new], row[new], order[new]
        _, first, at = np.unique(code, return_index=True, return_inverse=True)
        counts = [np.bincount(at, toxic[row] == c, len(first)).astype(np.int64) for c in (0, 1)]
        spans = [(words.start[order[i]], words.end[order[i]]) for i in first]
        yield pa.RecordBatch.from_arrays(
            [pa.array([data[a:b].tobytes().lower() for a, b in spans], pa.binary()), pa.array(counts[0]), pa.array(counts[1])], ["word", "n0", "n1"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model from at most ``per_class`` labelled documents of each class outside the held-out fold.

    ``labels`` has doc_id and toxic; rows with another label than 0 or 1 or without an id are left out, and of
    repeated labels the largest counts. Of documents that repeat a labelled id, the text with the smallest hash is read.
    Without any label, without documents, or with one class only, every text gets one constant score. Null texts are
    empty; other columns of either table are not looked at.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = chosen[0].union(chosen[1]).withColumn("role", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_class ids at most
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"), F.first("role").alias("role"))
    counted = sample.where(~F.col("role")).select("text", "toxic").mapInArrow(_word_weights, "word binary, n0 long, n1 long")
    rows = counted.groupBy("word").agg(F.sum("n0"), F.sum("n1")).toArrow()
    word = rows.column(0).combine_chunks().cast(pa.binary())
    order = pc.sort_indices(word).to_numpy()  # bytewise
    data, offsets = flat(word.take(pa.array(order)))
    weight = np.stack([rows.column(k).to_numpy()[order].astype(float) for k in (1, 2)])
    levels = build(data, offsets[:-1], offsets[1:], weight) if len(order) else []
    shared = spark.sparkContext.broadcast([tuple(level) for level in levels])  # plain arrays, which any worker can read

    def measure(batches):
        known = Known([Level(*v) for v in shared.value])
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                x = features(known, part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1)], ["x", "toxic"])

    fitted = sample.where("role").select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").collect()
    shared.destroy()
    fitted.sort(key=lambda r: (r[1], r[0]))
    x, y = np.array([r[0] for r in fitted]).reshape(len(fitted), FEATURES), np.array([r[1] for r in fitted])
    return Model(levels, calibrate(x, y, prior))


def scored(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all by default) and ``score``; a null text scores like the empty one."""
    need(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(([tuple(level) for level in model.levels], model.weight))
    held: list[Known] = []  # one per task

    def measure(text):
        levels, weight = shared.value
        if not held:
            held.append(Known([Level(*v) for v in levels]))
        return [pa.array(scores(held[0], weight, text))]

    return annotate(docs, docs.columns if carry is None else carry, "score double", measure, SLICE_BYTES)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; repeated rows get equal scores."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    rows = scored(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return rows.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their own columns whose score is below one half."""
    own, restore = hidden(docs, "text")
    return scored(own, train(docs, labels)).where(F.col("score") < 0.5).select(restore)
