"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes every document floor(r) times and some once more. Which ones is
decided by the cube method: each document starts with the probability r - floor(r); three undecided documents
of a source at a time move along the one direction that changes neither the expected words nor the expected
number of documents, until one of them is decided. At most two documents of a block stay undecided; they meet
those of other blocks in the next round, and the last two of a source are landed on the nearest total. As these
two are often the longest texts, a source's last block then exchanges a few taken texts for left ones of another
length (in a source of many blocks a sample of decided ones comes along for this), which keeps the number of documents and brings the words closer to the target.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import annotate, hidden, need, written
from .words import SPACED, flat, mix, runs

BLOCK = 4_000  # undecided units one task holds at a time
MAX_SOURCES = 100_000  # a mixture is a stated list of sources; more of them are an error, not a cut
NEAR = 1e-9
EXCHANGES = 6


def cycle(*weights: int) -> Callable[[int], int]:
    """Weight by the place of a source in code point order, null last."""
    return lambda place: weights[place % len(weights)]


def word_count(column: pa.Array) -> pa.Array:
    data, offsets = flat(column)
    words = runs(data, offsets, SPACED)
    return pa.array(np.diff(words.bounds), pa.int64())


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = Fraction(1), cap: int = 3) -> list[Fraction]:
    """Words each source should give: by weight, at most ``cap`` times its size, the excess shared anew by weight."""
    goal, total = [Fraction(0)] * len(sizes), share * sum(sizes)
    left, free = total, set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] > cap * sizes[i] * weight} if weight else set()
        if not full:
            for i in free:
                goal[i] = left * weights[i] / weight if weight else Fraction(0)
            break
        for i in full:
            goal[i] = Fraction(cap * sizes[i])
            left -= goal[i]
        free -= full
    return goal


def flight(size: list[float], chance: list[float], draw: list[float], land: bool, start: list[float] | None = None) -> list[float]:
    """Chances after the flight; all but two are 0 or 1. With ``land`` these two are decided as well.

    ``start`` has the chances before any flight, by which units that an earlier one decided are exchange partners.
    """
    out, held = list(chance), []
    for k in range(len(size)):
        if NEAR < out[k] < 1 - NEAR:
            held.append(k)
        else:
            out[k] = float(round(out[k]))
        if len(held) < 3:
            continue
        a, b, c = held
        move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = min(((1 - out[i]) / m if m > 0 else out[i] / -m) for i, m in zip(held, move) if m)
        down = min((out[i] / m if m > 0 else (1 - out[i]) / -m) for i, m in zip(held, move) if m)
        step = up if draw[c] * (up + down) < down else -down
        for i, m in zip(held, move):
            out[i] += step * m
        for i in held:
            if not NEAR < out[i] < 1 - NEAR:
                out[i] = float(round(out[i]))
        held = [i for i in held if 0 < out[i] < 1]
    if land and held:
        best = min(product((0.0, 1.0), repeat=len(held)), key=lambda x: (abs(sum((v - out[i]) * size[i] for i, v in zip(held, x))), abs(sum(v - out[i] for i, v in zip(held, x))), x))
        for i, v in zip(held, best):
            out[i] = v
    if land:
        return exchange(np.array(size), np.array(chance), np.array(out), np.array(chance if start is None else start)).tolist()
    return out


def exchange(size: np.ndarray, chance: np.ndarray, taken: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Swap taken units for left ones, a few at most, while that brings the words nearer to their expectation.

    Units whose chance ``start`` was open before any flight may be swapped. Flights keep the expected words, so those of
    ``chance`` are the ones to come near to.
    """
    free = (start > NEAR) & (start < 1 - NEAR)
    for _ in range(EXCHANGES):
        off = float(((taken - chance) * size).sum())
        on, left = np.flatnonzero(free & (taken == 1)), np.flatnonzero(free & (taken == 0))
        if not len(on) or not len(left):
            break
        left = left[np.argsort(size[left], kind="stable")]
        at = np.searchsorted(size[left], size[on] - off)
        near = np.stack([np.clip(at - 1, 0, len(left) - 1), np.clip(at, 0, len(left) - 1)])
        miss = np.abs(off - size[on] + size[left[near]])
        side, k = np.unravel_index(np.argmin(miss), miss.shape)
        if miss[side, k] >= abs(off):
            break
        taken[on[k]], taken[left[near[side, k]]] = 0, 1
    return taken


def _flier(seed: int):
    return lambda table: _fly(table.drop_columns(["block"]), table["blocks"][0].as_py() == 1, seed)


def _fly(table: pa.Table, land: bool, seed: int) -> pa.Table:
    key = table["unit_key"].to_numpy()
    size = table["size"].to_numpy().astype(float)
    order = np.lexsort((key, -size))  # long documents are decided first, so short ones are left to land
    draw = mix(key.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) / 2.0**64
    chance, start = table["chance"].to_numpy(), table["start"].to_numpy()
    moved = np.empty(len(key))
    moved[order] = flight(size[order].tolist(), chance[order].tolist(), draw[order].tolist(), land, start[order].tolist())
    return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(moved))


def decisions(sized: DataFrame, weight: Callable[[int], int], share: Fraction, cap: int, seed: int) -> DataFrame:
    """One row per distinct (doc_id, source, size): rows n, whole copies of each, rows ``extra`` that get one more.

    Equal rows form one unit: of n equal rows with chance p, floor(n p) get a copy for sure and one more may.
    """
    spark = sized.sparkSession
    units = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("unit_key", F.xxhash64("doc_id", "source", "size")))
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")), F.count("*")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    goal = targets([r[1] for r in found], [weight(i) for i in range(len(found))], share, cap)
    ratio = [g / r[1] if r[1] else Fraction(0) for g, r in zip(goal, found)]
    plan = [(r[0], r[1], float(g), int(x), float(x - int(x)), -(-r[2] // BLOCK)) for r, g, x in zip(found, goal, ratio)]
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, whole int, share double, blocks int")
    joined = units.join(F.broadcast(plan.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")  # at most MAX_SOURCES rows
    due = F.col("n") * F.col("share")
    joined = joined.withColumns({"sure": F.floor(due + NEAR), "chance": F.greatest(due - F.floor(due + NEAR), F.lit(0.0))})
    # of a source of many blocks, half a block of units go on to its last round as partners for the exchange
    partner = F.pmod(F.xxhash64("unit_key", F.lit("partner")), F.col("blocks").cast("bigint") * BLOCK) < BLOCK // 2
    joined = joined.withColumns({"start": F.col("chance"), "partner": partner})

    decided, current, level = [], joined, 0
    most = max((-(-r[2] // BLOCK) for r in found), default=0)
    while True:
        block = F.pmod(F.xxhash64("unit_key", F.lit(level)), F.col("blocks"))
        moved = written(current.withColumn("block", block.cast("bigint")).groupBy("source", "block").applyInArrow(_flier(seed), current.schema))
        if most <= 1:
            decided.append(moved)
            break
        # a source in its one block is landed; of the others, undecided units and the partners go on
        on = (F.col("blocks") > 1) & (F.col("partner") | ((F.col("chance") > 0) & (F.col("chance") < 1)))
        decided.append(moved.where(~on))
        fewer = F.greatest(F.ceil(F.col("blocks") * 2 / BLOCK), F.lit(1)).cast("int")
        current, level, most = moved.where(on).withColumn("blocks", fewer), level + 1, -(-most * 2 // BLOCK)
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    return result.withColumn("extra", (F.col("sure") + F.col("chance")).cast("bigint")).drop("sure", "chance", "share", "blocks", "start", "partner")


def _copies(index: Column) -> Column:
    return F.col("whole") + (index <= F.col("extra")).cast("int")


def mixture(docs: DataFrame, weight: Callable[[int], int] = cycle(5, 2, 1), share: Fraction = Fraction(1), cap: int = 3, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Null text has size 0, null source is the last source. Documents without words have copies but take no words; a
    source without words has the target 0. The same table gives the same rows for any partitioning. An empty table
    gives an empty table. Columns other than doc_id, text, source are not looked at.
    """
    need(docs, "doc_id", "text", "source")
    sized = annotate(docs.select("doc_id", "source", "text"), ["doc_id", "source"], "size long", lambda text: [word_count(text)])
    units = decisions(sized, weight, share, cap, seed)
    rows = units.withColumn("index", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return rows.withColumn("copies", _copies(F.col("index"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, weight: Callable[[int], int] = cycle(5, 2, 1), share: Fraction = Fraction(1), cap: int = 3, seed: int = 1) -> DataFrame:
    """The documents of the mixture with their own columns, each as often as the mixture takes it.

    See :func:`mixture`. Among rows with equal id, source and size, those whose text has the smaller hash get the
    additional copy.
    """
    need(docs, "doc_id", "text", "source")
    own, restore = hidden(docs, "doc_id", "text", "source")
    sized = annotate(own, own.columns, "size long", lambda text: [word_count(text)])
    units = decisions(sized.select("doc_id", "source", "size"), weight, share, cap, seed)
    units = units.select([F.col(c).alias(f"unit_{c}") for c in ("doc_id", "source", "size", "n", "whole", "extra")])
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("text"))
    rows = sized.withColumn("index", F.row_number().over(same) if units.agg(F.max("unit_n")).first()[0] not in (None, 1) else F.lit(1))
    joined = rows.join(units, F.col("doc_id").eqNullSafe(F.col("unit_doc_id")) & F.col("source").eqNullSafe(F.col("unit_source")) & (F.col("size") == F.col("unit_size")))
    copies = F.col("unit_whole") + (F.col("index") <= F.col("unit_extra")).cast("int")
    return joined.where(copies > 0).withColumn("repeat", F.explode(F.sequence(F.lit(1), copies))).select(restore)
