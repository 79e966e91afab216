"""Words of whole texts, found and hashed over Arrow buffers.

All work is on the UTF-8 bytes of a batch at once: a byte table tells word bytes from the rest, and the hash
of any byte span comes from prefix sums, so no Python code runs per word. Texts of any length are taken
whole; only the temporary arrays of the hashing are cut into pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
FOLDED = _CODES[_FOLD]
EXACT = _CODES

_SPACE = np.ones(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True

SPACED = _SPACE  # runs of anything but ASCII white space
LETTERS = _ALNUM  # runs of ASCII letters, digits and non-ASCII characters


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    start: np.ndarray  # byte offset of each word in the flat buffer
    end: np.ndarray
    row: np.ndarray  # text each word belongs to
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Longest runs of bytes of the table, never across two texts."""
    inside = table[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edges] = False
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(start, end, row, bounds)


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit hash of each span ``start:end``; spans are in order and do not overlap. Equal bytes, equal hash."""
    out = np.empty(len(start), dtype=np.uint64)
    most = min(PIECE, len(data)) + 1
    up, down = _powers(_BASE, most), _powers(_INVERSE, most)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            low = start[i]
            j = int(np.searchsorted(end, low + PIECE, side="right"))
            if j <= i:
                out[i] = _long_code(data, int(low), int(end[i]), codes, up)
                i += 1
                continue
            piece = codes[data[low : end[j - 1]]]
            piece *= up[: len(piece)]
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(piece, out=sums[1:])
            out[i:j] = (sums[end[i:j] - low] - sums[start[i:j] - low]) * down[start[i:j] - low]
            i = j
        return mix(out ^ (end - start).astype(np.uint64))


def _long_code(data: np.ndarray, low: int, high: int, codes: np.ndarray, up: np.ndarray) -> int:
    total = 0
    for at in range(low, high, PIECE):
        piece = codes[data[at : min(high, at + PIECE)]]
        value = int((piece * up[: len(piece)]).sum(dtype=np.uint64))
        total += value * pow(_BASE, at - low, 1 << 64)
    return total & _MASK


def window_codes(codes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside one text, and the place of its first word."""
    count = len(codes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            total = total * _WORD_BASE + codes[j : j + count]
    place = np.flatnonzero(row[:count] == row[width - 1 :])
    return mix(total[place]), place


def text_words(column: pa.Array, table: np.ndarray = SPACED, codes: np.ndarray = FOLDED) -> tuple[Words, np.ndarray]:
    """Words of each text and their hashes."""
    data, offsets = flat(column)
    words = runs(data, offsets, table)
    return words, span_codes(data, words.start, words.end, codes)


def covered(bounds: np.ndarray, place: np.ndarray, width: np.ndarray | int, total: int) -> np.ndarray:
    """Mark each of ``total`` words that lies in one of the runs ``place:place + width``."""
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + width, -1)
    return np.cumsum(change[:-1]) > 0


def per_row(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of a value per word over each text; texts without words give 0."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def split_long(words: Words, most: int) -> Words:
    """Words with those of more than ``most`` bytes cut into pieces, so that none is longer."""
    size = words.end - words.start
    if not len(size) or size.max() <= most:
        return words
    pieces = -(-size // most)
    index = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(words.start, pieces) + index * most
    end = np.minimum(start + most, np.repeat(words.end, pieces))
    bounds = np.concatenate([[0], np.cumsum(pieces)])[words.bounds]
    return Words(start, end, np.repeat(words.row, pieces), bounds)
