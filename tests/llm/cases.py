"""Documents with every awkward case, and plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

FOLD = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key long, kept boolean, hits string, found string, host string, n_lines int, `odd name.x` string"
PROSE = "the quick brown fox jumps over one lazy dog while ten green birds watch from a tall old tree near the river bank and sing"


def prose(start: int, count: int) -> str:
    return " ".join(f"word{(start * 7919 + i * i * 31 + i) % 9973}" for i in range(count))


def awkward_rows() -> list[tuple]:
    texts = [
        (1, PROSE, "en", "b"), (2, PROSE + " today", "en", "b"), (2, PROSE + " today", "en", "b"), (3, PROSE.upper(), "en", None),
        (4, None, "en", "b"), (None, PROSE, None, None), (None, None, None, None), (5, "", "en", ""), (6, " \t\n\x0b ", "en", "é"),
        (7, "one two", "en", "z"), (8, "one two", "en", "z"), (9, prose(1, 30000), "en", "b"), (10, prose(1, 30000) + " end", "en", "b"),
        (11, "x" * 50000, "en", "z"), (12, "line one is here\nline one is here\n\nline two", "en", "b"), (12, "line one is here\nother", "de", "b"),
        (13, prose(2, 60), "en", "b"), (14, prose(2, 59) + " changed", "en", "b"), (15, prose(3, 40), "fr", "c"), (15, prose(3, 40), "fr", "c"),
        (16, "ünïcode wörds \U0001f600 ñandú " * 12, "es", "c"),
    ]
    return [(i, t, la, so, None if t is None else len(t), 5, 0.5, 1, True, "h", "f", "o", 3, "odd") for i, t, la, so in texts]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lettered(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = spaced((text or "").translate(FOLD))
    if 0 < len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def groups(count: int, linked) -> list[int]:
    parent = list(range(count))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(count)]


def jaccard_pairs(sets: list[frozenset], least: float = 0.8) -> list[tuple[int, int]]:
    holders: dict = {}
    out = []
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders.get(x, ()))
        out += [(j, i) for j, k in common.items() if k >= least * (len(s) + len(sets[j]) - k) - 1e-9]
        for x in s:
            holders.setdefault(x, []).append(i)
    return out


def overlap(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    owners: dict = {}
    for item, body in items:
        words = lettered(body)
        width = min(window, len(words))
        for i in range(len(words) - width + 1 if width else 0):
            owners.setdefault(tuple(words[i : i + width]), set()).add("" if item is None else str(item))
    words = lettered(text)
    hit, found = [0] * len(words), set()
    for width in {len(k) for k in owners}:
        for i in range(len(words) - width + 1):
            if own := owners.get(tuple(words[i : i + width])):
                found |= own
                hit[i : i + width] = [1] * width
    return len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0


def base_measures(text: str | None) -> tuple:
    words, seen, again = spaced(text), set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), failed
