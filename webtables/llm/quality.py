"""Quality rules as a short-circuit cascade.

Each rule looks at whole texts and says which it rejects. On a sample every rule is run alone, which gives its cost
and the share it rejects; the rules then run in the order of rejection per cost, each only over the texts that all
rules before it have kept. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import annotate, need
from .words import EXACT, LETTERS, SPACED, Words, covered, flat, per_row, runs, span_codes, window_codes

SAMPLE_ROWS = 2000  # expected size of the sample on which rules are timed
WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True


class Rule(NamedTuple):
    name: str
    rejects: Callable[[pa.Array], np.ndarray]  # whole texts -> boolean per text


def _byte_sum(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(chosen[data], dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def n_words(text: pa.Array) -> np.ndarray:
    return np.diff(runs(*flat(text), SPACED).bounds)


def word_chars(text: pa.Array) -> np.ndarray:
    """Code points inside words: bytes of words that do not continue a character."""
    chosen = SPACED.copy()
    chosen[0x80:0xC0] = False
    return _byte_sum(*flat(text), chosen)


def n_symbols(text: pa.Array) -> np.ndarray:
    return _byte_sum(*flat(text), _SYMBOL)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each line that holds a word."""
    table = np.ones(256, dtype=bool)
    table[10] = False
    lines = runs(data, offsets, table)
    words = runs(data, offsets, SPACED)
    full = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    return lines.start[full], lines.end[full], lines.row[full]


def n_dup_lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the text, and all lines with a word."""
    data, offsets = flat(text)
    start, end, row = line_spans(data, offsets)
    code = span_codes(data, start, end, EXACT)
    order = np.lexsort((code, row))
    again = np.zeros(len(code), dtype=np.int64)
    again[1:] = (code[order][1:] == code[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order], again, len(text)).astype(np.int64), np.bincount(row, minlength=len(text))


def n_repeat_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words inside windows of eight words that the text holds twice or more, and all words."""
    data, offsets = flat(text)
    words: Words = runs(data, offsets, SPACED)
    code, place = window_codes(span_codes(data, words.start, words.end, EXACT), words.row, WINDOW)
    order = np.argsort(code, kind="stable")
    code, place = code[order], place[order]
    # equal windows of one text are neighbours once their texts are in order too, which the stable sort keeps
    row = words.row[place]
    same = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    hit = np.zeros(len(code), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    inside = covered(words.bounds, place[hit], WINDOW, len(words.start))
    return per_row(words.bounds, inside.astype(np.int64)), np.diff(words.bounds)


def base_failed(words: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    return (words < 20) | (100 * repeated > 30 * words)


def _letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(text)
    return _byte_sum(data, offsets, _UPPER), _byte_sum(data, offsets, _LOWER)


def _few(text: pa.Array) -> np.ndarray:
    return n_words(text) < 20


def _symbols(text: pa.Array) -> np.ndarray:
    return n_symbols(text) > 0.1 * n_words(text)


def _word_length(text: pa.Array) -> np.ndarray:
    words, chars = n_words(text), word_chars(text)
    return (chars < 2 * words) | (chars > 15 * words)


def _capitals(text: pa.Array) -> np.ndarray:
    upper, lower = _letters(text)
    return upper > 0.6 * (upper + lower)


def _wordless(text: pa.Array) -> np.ndarray:
    """Fewer than 7 in 10 words hold a letter."""
    data, offsets = flat(text)
    table = LETTERS.copy()
    table[48:58] = False
    words, parts = runs(data, offsets, SPACED), runs(data, offsets, table)
    lettered = np.searchsorted(parts.start, words.end) > np.searchsorted(parts.start, words.start)
    return 10 * per_row(words.bounds, lettered.astype(np.int64)) < 7 * np.diff(words.bounds)


def _dup_lines(text: pa.Array) -> np.ndarray:
    again, lines = n_dup_lines(text)
    return again > 0.5 * lines


def _stutter(text: pa.Array) -> np.ndarray:
    """More than 3 in 10 words equal the word before them."""
    data, offsets = flat(text)
    words = runs(data, offsets, SPACED)
    code = span_codes(data, words.start, words.end)
    same = np.zeros(len(code), dtype=np.int64)
    same[1:] = (code[1:] == code[:-1]) & (words.row[1:] == words.row[:-1])
    return 10 * per_row(words.bounds, same) > 3 * np.diff(words.bounds)


def _repeats(text: pa.Array) -> np.ndarray:
    repeated, words = n_repeat_words(text)
    return 100 * repeated > 30 * words


BASE_RULES = (Rule("few_words", _few), Rule("repeated_words", _repeats))
RULES = (
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("capitals", _capitals),
    Rule("wordless", _wordless),
    Rule("dup_lines", _dup_lines),
    Rule("stutter", _stutter),
)


def ordered(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by texts rejected per second on a sample of about ``rows`` documents, the best first.

    The sample only orders the rules. Names break ties, so rules that reject nothing come last in name order.
    """
    count = docs.count()
    sample = docs.select("text") if count <= rows else docs.select("text").sample(rows / count, 7)

    def measure(batches):
        for batch in batches:
            text, out = batch.column(0), []
            for rule in rules:
                start = time.perf_counter()
                rejected = int(rule.rejects(text).sum())
                out.append((rule.name, time.perf_counter() - start, rejected))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["name", "seconds", "rejected"])

    found = sample.mapInArrow(measure, "name string, seconds double, rejected long").groupBy("name").agg(F.sum("seconds"), F.sum("rejected")).collect()
    gain = {name: rejected / max(seconds, 1e-9) for name, seconds, rejected in found}
    return sorted(rules, key=lambda r: (-gain.get(r.name, 0.0), r.name))


def cascade(text: pa.Array, rules: Sequence[Rule]) -> tuple[np.ndarray, list[str | None]]:
    """Verdict per text and the rule that rejected it; each rule sees only what those before it kept."""
    alive, by = np.arange(len(text)), [None] * len(text)
    for rule in rules:
        if not len(alive):
            break
        part = text if len(alive) == len(text) else text.take(pa.array(alive))
        rejected = rule.rejects(part)
        for i in alive[rejected]:
            by[i] = rule.name
        alive = alive[~rejected]
    kept = np.zeros(len(text), dtype=bool)
    kept[alive] = True
    return kept, by


def judged(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *RULES), order: bool = True) -> DataFrame:
    """All columns of ``docs`` and ``kept`` (boolean), ``rejected_by`` (first rule of the chosen order that rejects).

    Null and empty texts have no words and fail the rule on few words. Rows are judged one by one, so repeated rows
    get equal verdicts. Input columns named like a new one are replaced.
    """
    need(docs, "text")
    chosen = ordered(docs, rules) if order else list(rules)

    def measure(text):
        kept, by = cascade(text, chosen)
        return [pa.array(kept), pa.array(by, pa.string())]

    return annotate(docs, docs.columns, "kept boolean, rejected_by string", measure)


def measured(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the base measures of each whole text, base_failed, and kept by the base rules and the cascade.

    Null, empty and blank texts have no words and fail. Repeated rows are rows of their own with equal results; null ids
    are kept; an empty table gives an empty table; columns other than doc_id and text are not looked at.
    """
    need(docs, "doc_id", "text")
    chosen = ordered(docs, rules)

    def measure(text):
        repeated, words = n_repeat_words(text)
        failed = base_failed(words, repeated)
        kept = np.zeros(len(text), dtype=bool)
        passed = np.flatnonzero(~failed)
        if len(passed):
            kept[passed] = cascade(text.take(pa.array(passed)), chosen)[0]
        longs = [words, word_chars(text), n_symbols(text), n_dup_lines(text)[0], repeated]
        return [pa.array(x, pa.int64()) for x in longs] + [pa.array(failed), pa.array(kept)]

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return annotate(docs.select("doc_id", "text"), ["doc_id"], fields, measure)
