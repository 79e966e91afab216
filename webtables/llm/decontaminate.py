"""Benchmark decontamination with suffix arrays over the training words.

Every task builds a suffix array of the words of its documents, binary-searches every suffix of the benchmark items
in it and so finds all verbatim matches, their places and their lengths. The array is sparse: places whose first
words start no benchmark suffix are left out, because no suffix can match there for the words that count.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import annotate, free_name, hidden, need, written
from .words import LETTERS, covered, text_words

WINDOW = 10
BLOCK_BYTES = 8 << 20  # benchmark text that travels with one job; a larger benchmark is searched in blocks
ARRAY_WORDS = 4_000_000  # words under one suffix array; longer batches are cut with an overlap
LEAD = 2

_FIELDS = "n_words long, hits array<struct<start:long,length:long>>, items array<string>, longest long"


class Tests(NamedTuple):
    """Benchmark windows of one width, each text of a window once, and the items that hold it."""

    width: int
    suffix: np.ndarray  # windows x width word codes, in suffix order
    lead: np.ndarray  # sorted codes of their first words
    owners: list[list[str]]
    codes: np.ndarray  # words of the items, one after the other
    end: np.ndarray  # end of the item that each of them is in
    array: np.ndarray  # their places in the order of all that follows in the item, if at least a window does
    first: np.ndarray  # of each window, where the places that start with it begin in the array, and the end of all


def tests(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[Tests]:
    words, codes = text_words(pa.array([t for _, t in items], pa.string()), LETTERS)
    size = np.diff(words.bounds)
    end = np.repeat(words.bounds[1:], size)
    rank = ranks(codes, end)
    out = []
    for width in np.unique(np.minimum(size[size > 0], window)).tolist():
        of = np.minimum(size, window)[words.row] == width
        place = np.flatnonzero(of & (np.arange(len(codes)) + width <= end))
        array = place[np.argsort(rank[place], kind="stable")]
        window_words = codes[array[:, None] + np.arange(width)]
        new = np.concatenate([[True], (window_words[1:] != window_words[:-1]).any(axis=1)])
        first = np.append(np.flatnonzero(new), len(array))
        owners = [sorted({items[i][0] for i in words.row[array[a:b]]}) for a, b in zip(first[:-1], first[1:])]
        suffix = window_words[new]
        lead = _lead(suffix.reshape(-1), np.arange(len(suffix)) * width, min(LEAD, width))
        out.append(Tests(width, suffix, np.unique(lead), owners, codes, end, array, first))
    return out


def ranks(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rank of what follows each place up to the end of its item, found by doubling; an item that ends comes first."""
    rank, reach, place = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1, 1, np.arange(len(codes))
    longest = int((end - place).max()) if len(codes) else 0
    while reach < longest:
        then = np.where(place + reach < end, rank[np.minimum(place + reach, len(codes) - 1)], 0)
        rank = np.unique(rank * (len(codes) + 2) + then, return_inverse=True)[1].astype(np.int64) + 1
        reach *= 2
    return rank


def _lead(codes: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    return codes[place] if width == 1 else codes[place] * np.uint64(0x9E3779B97F4A7C15) + codes[place + 1]


def suffix_array(codes: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Given places in the order of the ``width`` words that start there."""
    return place[np.lexsort(tuple(codes[place + j] for j in reversed(range(width))))]


def _bound(codes: np.ndarray, array: np.ndarray, suffix: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every suffix at once: first array place not before it, or first one after it."""
    low, high = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(array), dtype=np.int64)
    width = suffix.shape[1]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        there = codes[array[middle][:, None] + np.arange(width)]
        differ = there != suffix[open_]
        first = np.argmax(differ, axis=1)
        rows = np.arange(len(open_))
        same = ~differ[rows, first]
        before = (there[rows, first] < suffix[open_, first]) & ~same
        right = before | same if after else before
        low[open_] = np.where(right, middle + 1, low[open_])
        high[open_] = np.where(right, high[open_], middle)


def matches(codes: np.ndarray, row: np.ndarray, test: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a benchmark window starts, in order, and the number of the window."""
    width, found, numbers = test.width, [], []
    step = ARRAY_WORDS
    for at in range(0, len(codes), step):
        part, rows = codes[at : at + step + width - 1], row[at : at + step + width - 1]
        place = np.flatnonzero(rows[: len(rows) - width + 1] == rows[width - 1 :])
        lead = _lead(part, place, min(LEAD, width))
        at_lead = np.minimum(np.searchsorted(test.lead, lead), len(test.lead) - 1)
        array = suffix_array(part, place[test.lead[at_lead] == lead], width)
        if not len(array):
            continue
        low, high = _bound(part, array, test.suffix, False), _bound(part, array, test.suffix, True)
        count = high - low
        take = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        found.append(array[take] + at)
        numbers.append(np.repeat(np.arange(len(count)), count))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, number = np.concatenate(found), np.concatenate(numbers)
    order = np.argsort(place, kind="stable")
    return place[order], number[order]


def _longest(codes: np.ndarray, row: np.ndarray, place: np.ndarray, number: np.ndarray, test: Tests, rows: int) -> np.ndarray:
    """Length of the longest verbatim match of each text. The suffixes of the benchmark that a match may still follow lie
    side by side in their array; each further word narrows that range on both sides by binary search."""
    best = np.zeros(rows, dtype=np.int64)
    length, alive = np.full(len(place), test.width, dtype=np.int64), np.arange(len(place))
    low, high, depth = test.first[number], test.first[number + 1], test.width

    def narrowed(low: np.ndarray, high: np.ndarray, word: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            at = test.array[middle] + depth
            over = at >= test.end[test.array[middle]]  # what has ended comes before every word
            there = test.codes[np.minimum(at, len(test.codes) - 1)]
            right = over | (there < word[open_]) | ((there == word[open_]) & after)
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)

    while len(alive):
        at = place[alive] + depth
        fit = at < len(codes)
        fit[fit] = row[at[fit]] == row[place[alive[fit]]]
        alive, at, low, high = alive[fit], at[fit], low[fit], high[fit]
        low, high = narrowed(low, high, codes[at], False), narrowed(low, high, codes[at], True)
        on = low < high
        alive, low, high, depth = alive[on], low[on], high[on], depth + 1
        length[alive] += 1
    np.maximum.at(best, row[place], length)
    return best


def search(text: pa.Array, blocks: list[Tests]) -> list[pa.Array]:
    words, codes = text_words(text, LETTERS)
    rows, total = len(text), len(codes)
    inside, longest = np.zeros(total, dtype=bool), np.zeros(rows, dtype=np.int64)
    owned: dict[int, set[str]] = {}
    for test in blocks:
        place, number = matches(codes, words.row, test)
        if not len(place):
            continue
        inside |= covered(words.bounds, place, test.width, total)
        longest = np.maximum(longest, _longest(codes, words.row, place, number, test, rows))
        pairs = np.unique(words.row[place] * len(test.owners) + number)
        for pair in pairs.tolist():
            owned.setdefault(pair // len(test.owners), set()).update(test.owners[pair % len(test.owners)])
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = words.bounds[1:-1]
    cut = cut[(cut > 0) & (cut < total)]
    cut = cut[inside[cut] & inside[cut - 1]] if total else cut  # a run that goes on in the next text is two
    first, last = np.union1d(first, cut), np.union1d(last, cut)
    row = words.row[first] if total else first
    spans = pa.StructArray.from_arrays([pa.array(first - words.bounds[row], pa.int64()), pa.array(last - first, pa.int64())], ["start", "length"])
    hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), spans)
    items = pa.array([sorted(owned.get(i, ())) for i in range(rows)], pa.list_(pa.string()))
    return [pa.array(np.diff(words.bounds), pa.int64()), hits, items, pa.array(longest, pa.int64())]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES) if size else 1
    if count == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]


def find_overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all by default) and what each document shares with the benchmark.

    New columns: n_words; hits, the runs of words (start, length) that lie in an occurrence of a benchmark window;
    items, the ids of the items with such a window, sorted as text; longest, the words of the longest verbatim match;
    n_hit, n_items, items_sha256, contaminated. A window is ``window`` words in a row, or all words of a shorter item.
    Null and empty texts have no words; a null item id counts as the empty text; items without words match nothing.
    An empty benchmark leaves every document clean. A benchmark beyond ``BLOCK_BYTES`` is searched in blocks, each
    against all documents, and the blocks are then joined per document. Repeated rows get equal results.
    """
    need(docs, "text")
    need(benchmark, "item_id", "text")
    carry = docs.columns if carry is None else carry
    pairs = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    parts, blocks = [], _blocks(pairs)
    number = free_name(docs, "_row")
    if len(blocks) > 1:
        docs = written(docs.withColumn(number, F.monotonically_increasing_id()))
        carry = [*carry, number]
    for block in blocks:
        chosen = tests([(r[0], r[1]) for r in block.collect()], window)  # at most about BLOCK_BYTES of text
        parts.append(annotate(docs, carry, _FIELDS, _searcher(chosen)))
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        kept = [c for c in found.columns if c not in ("n_words", "hits", "items", "longest", number)]
        found = found.groupBy(number).agg(
            *[F.first(f"`{c}`").alias(c) for c in kept], F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.max("longest").alias("longest")).drop(number)
        found = found.withColumn("hits", F.expr(_UNION))
    return found.withColumns({
        "n_hit": F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, hit: total + hit["length"]),
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
        "contaminated": F.size("hits") > 0,
    })


# runs of several blocks made one: in order, a run that starts inside or right after the last one extends it
_UNION = """aggregate(array_sort(hits), cast(array() as array<struct<start:bigint,length:bigint>>), (done, hit) ->
  if(size(done) > 0 and hit.start <= element_at(done, -1).start + element_at(done, -1).length,
     concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start,
       greatest(element_at(done, -1).length, hit.start + hit.length - element_at(done, -1).start) as length))),
     concat(done, array(hit))))"""


def _searcher(chosen: list[Tests]):
    return lambda text: search(text, chosen)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents, with their own columns, that share no window with the benchmark."""
    own, restore = hidden(docs, "text")
    return find_overlap(own, benchmark, window).where(~F.col("contaminated")).select(restore)
