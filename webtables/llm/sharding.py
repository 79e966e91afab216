"""Shards of near equal bytes by histogram sort.

The key of a document is the pair (hash of the text, hash of the id), so equal texts are neighbours in key order
and stay in one shard unless a shard border must cut their group to keep the sizes near equal. The borders are
found by counting: every round adds up the exact bytes below a grid of candidate borders and refines only the
cells in which a border still lies, until each border is within the tolerance. The rows themselves then move once.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, free_name, need

RANGE_BYTES = 64 << 20  # rows move in ranges of about so many bytes
LEAST_BITS, MOST_BITS = 8, 16  # of the first grid; the driver sees at most 2**16 sums a round
STEP_BITS = 12
LOW = -(1 << 63)


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(1)


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """All columns of ``docs`` and size, text_crc32, law, shard, slot, grown_shard, text_key, id_key.

    Law ``bytes``: each border between two shards lies within ``tolerance`` of a shard's size from its place, or at
    the nearest edge of the one row that covers that place. ``slot`` numbers the rows of a shard from 0 without gaps.
    Null text has size 1 and forms a group of its own apart from the empty text. Rows that repeat both text and id
    have one key and stay together. A null id is a key like any other. An empty table gives an empty table. Input
    columns named like a computed one are replaced.
    """
    need(docs, "doc_id", "text")
    keyed = docs.withColumns({
        "size": text_size(F.col("text")),
        "text_crc32": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("bigint")),
        "text_key": F.xxhash64("text"),
        "id_key": F.xxhash64("doc_id"),
    })
    narrow = cut(keyed.select("text_key", "id_key", "size"))
    total, rows = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * total // RANGE_BYTES).bit_length()))
    first = _histogram(narrow, bits)
    borders = _borders(narrow, first, total, shards, max(1, int(tolerance * total / shards)), bits)

    key, other = F.col("text_key"), F.col("id_key")
    shard = F.lit(0)
    for text_key, id_key in borders:
        shard = shard + ((key > text_key) | ((key == text_key) & (other >= id_key))).cast("int") if text_key < 1 << 63 else shard
    cell, part = free_name(docs, "_cell"), free_name(docs, "_part")
    limit = 4 * rows // (1 << bits) + 1000  # a cell of more rows is dealt out by the id
    hot = {p: -(-count // limit) for p, _, count in first if count > limit}
    placed = lambda df: df.withColumns({"shard": shard, cell: F.shiftright("text_key", 64 - bits)}).transform(lambda d: _split(d, cell, part, hot))

    offset = free_name(docs, "_offset")
    before = Window.partitionBy("shard").orderBy(cell, part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed(narrow).groupBy("shard", cell, part).agg(F.count("*").alias(offset))
    offsets = offsets.withColumn(offset, F.coalesce(F.sum(offset).over(before), F.lit(0)))  # at most 2**16 cells and the parts of hot ones
    inside = Window.partitionBy("shard", cell, part).orderBy("text_key", "id_key", F.col("doc_id"))
    return (
        placed(keyed)
        .withColumn("slot", F.row_number().over(inside).cast("bigint") - 1)
        .join(F.broadcast(offsets), ["shard", cell, part])
        .withColumns({"slot": F.col("slot") + F.col(offset), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
        .drop(cell, part, offset)
    )


def _split(df: DataFrame, cell: str, part: str, hot: dict[int, int]) -> DataFrame:
    if not hot:
        return df.withColumn(part, F.lit(0).cast("bigint"))
    parts = F.lit(1)
    for size in sorted(set(hot.values())):
        parts = F.when(F.col(cell).isin([p for p, n in hot.items() if n == size]), size).otherwise(parts)
    return df.withColumn(part, F.shiftright((F.shiftright("id_key", 32) + F.lit(1 << 31)) * parts, 32))


def _histogram(narrow: DataFrame, bits: int) -> list[tuple]:
    """Leading bits of the text's hash, bytes, rows."""
    cells = narrow.groupBy(F.shiftright("text_key", 64 - bits).cast("bigint").alias("p"))
    return sorted(tuple(r) for r in cells.agg(F.sum("size"), F.count("*")).collect())


def _refined(narrow: DataFrame, cells: set[tuple], done: int, bits: int) -> dict[tuple, list[tuple]]:
    """Sums by ``bits`` leading key bits (of 128) inside the cells, which have ``done`` leading bits."""
    def lead(count: int) -> list[Column]:
        text = F.shiftright("text_key", 64 - min(count, 64)).cast("bigint")
        return [text, F.shiftright("id_key", 128 - count).cast("bigint") if count > 64 else F.lit(0).cast("bigint")]

    inside = F.lit(False)
    for a, b in cells:
        text, other = lead(done)
        inside = inside | ((text == a) & (other == b))
    text, other = lead(done)
    more, rest = lead(bits)
    found: dict[tuple, list[tuple]] = {c: [] for c in cells}
    for a, b, c, d, size, rows in narrow.where(inside).groupBy(text.alias("a"), other.alias("b"), more.alias("c"), rest.alias("d")).agg(F.sum("size"), F.count("*")).collect():
        found[(a, b)].append(((c, d), size, rows))
    return {c: sorted(v) for c, v in found.items()}


def _edge(cell: tuple[int, int], bits: int, upper: bool) -> tuple[int, int]:
    """First key of a cell, or first key after it."""
    a, b = cell
    if bits <= 64:
        return ((a + upper) << (64 - bits), LOW)
    b = (b + upper) << (128 - bits)
    return (a, b) if b < 1 << 63 else (a + 1, LOW)


def _borders(narrow: DataFrame, first: list[tuple], total: int, shards: int, tolerance: int, bits: int) -> list[tuple[int, int]]:
    found: dict[int, tuple[int, int]] = {}
    grid = {None: [((p, 0), size, rows) for p, size, rows in first]}
    open_at = {i: (None, 0) for i in range(1, shards)} if first else {}  # border -> cell it lies in, bytes below that cell
    done = 0
    while open_at:
        still: dict[int, tuple[tuple, int]] = {}
        for i, (cell, below) in open_at.items():
            cells, goal = grid[cell], i * total // shards
            ends = list(accumulate((size for _, size, _ in cells), initial=below))
            k = min(max(1, bisect_left(ends, goal)), len(cells))
            lower, upper = goal - ends[k - 1], ends[k] - goal
            if min(lower, upper) <= tolerance or cells[k - 1][2] == 1 or bits == 128:
                found[i] = _edge(cells[k - 1][0], bits, upper < lower)
            else:
                still[i] = (cells[k - 1][0], ends[k - 1])
        open_at, done = still, bits
        if still:
            bits = 64 if done < 64 < done + STEP_BITS else min(128, done + STEP_BITS)
            grid = _refined(narrow, {c for c, _ in still.values()}, done, bits)
    return [found[i] for i in sorted(found)]
