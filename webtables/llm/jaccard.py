"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word shingles. Equal sets are one class from the start. MinHash bands give candidate links; the
classes they connect are compared in tiles of bounded size, so that no group is ever held by one task and no pair is
ever a row. In a tile, MinHash values are compared a few at a time; a pair is dropped as soon as the posterior
probability that it reaches the threshold falls below the tolerance, and what remains is verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import annotate, hidden, need, written
from .components import components
from .words import SPACED, mix, text_words, window_codes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6  # a pair at the threshold shares no band with probability (1 - 0.8**6)**32 < 1e-4
STEP, STEPS = 16, 4  # MinHash values compared at once, and how often before the exact check
TOLERANCE = 1e-6
TILE = 1024  # classes on one side of a tile
PAIRS = 1 << 20  # pairs compared at a time
CHUNK = 1 << 17  # shingles hashed at a time
COLUMNS = 4096
_UNIT = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (hash, text), in text order then hash order.

    A text of fewer words than a shingle, but not none, has one shingle of all its words.
    """
    words, codes = text_words(text, SPACED)
    code, place = window_codes(codes, words.row, width)
    row = words.row[place]
    size = np.diff(words.bounds)
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        total = size[short].astype(np.uint64)
        for j in range(width - 1):
            there = size[short] > j
            total[there] = mix(total[there] * _UNIT + codes[words.bounds[short[there]] + j])
        code, row = np.concatenate([code, total]), np.concatenate([row, short])
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], row[new]


def _minhash(code: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values of each of the sets ``bounds[i]:bounds[i + 1]``, none of them empty."""
    factor = mix(np.arange(1, count + 1, dtype=np.uint64) * _UNIT) | np.uint64(1)
    out = np.empty((len(bounds) - 1, count), dtype=np.uint64)
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, side="right")) - 1)
        part, first = code[bounds[i] : bounds[j]], bounds[i:j] - bounds[i]
        buffer = np.empty_like(part)
        for k in range(count):
            np.multiply(part, factor[k], out=buffer)
            out[i:j, k] = np.minimum.reduceat(buffer, first)
        i = j
    return mix(out)


def signatures(text: pa.Array, width: int) -> list[pa.Array]:
    """Hash of the shingle set, its size, one byte per MinHash value, one key per band; null keys for texts without words."""
    code, row = shingles(text, width)
    size = np.bincount(row, minlength=len(text))
    full = np.flatnonzero(size)
    bounds = np.concatenate([[0], np.cumsum(size[full])])
    key = np.zeros(len(text), dtype=np.uint64)
    if len(full):
        key[full] = mix(np.add.reduceat(mix(code + _UNIT), bounds[:-1]) ^ size[full].astype(np.uint64))
    least = _minhash(code, bounds, BANDS * ROWS)
    band = np.zeros((len(full), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        band = mix(band * _UNIT + least[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
    sign = (least[:, : STEP * STEPS] & np.uint64(255)).astype(np.uint8)
    there = size > 0
    blobs = [None] * len(text)
    for i, r in enumerate(full):
        blobs[r] = sign[i].tobytes()
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there * BANDS)]), pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
    return [pa.array(key.view(np.int64), mask=~there), pa.array(size, pa.int64()), pa.array(blobs, pa.binary()), lists]


def least_equal(threshold: float, tolerance: float) -> list[int]:
    """For each step, the fewest equal MinHash bytes with which a pair stays in the race.

    The prior of the similarity s is uniform; a byte agrees with probability s + (1 - s) / 256.
    """
    s = np.linspace(0, 1, 2001)
    chance = np.clip(s + (1 - s) / 256, 1e-12, 1 - 1e-12)
    out = []
    for step in range(1, STEPS + 1):
        n = step * STEP
        for m in range(n + 1):
            weight = m * np.log(chance) + (n - m) * np.log1p(-chance)
            weight = np.exp(weight - weight.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                out.append(m)
                break
    return out


def pruned(sign: np.ndarray, a: np.ndarray, b: np.ndarray, fewest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no step drops."""
    equal = np.zeros(len(a), dtype=np.int64)
    for step, least in enumerate(fewest):
        columns = slice(step * STEP, (step + 1) * STEP)
        part = sign[:, columns]
        equal += (part[a] == part[b]).sum(1)
        stay = equal >= least
        a, b, equal = a[stay], b[stay], equal[stay]
    return a, b


def verified(sets: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair reaches the threshold exactly."""
    if len(a) <= 2000:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], dtype=np.int64)
    else:
        used = np.union1d(a, b)
        code = np.concatenate([sets[i] for i in used])
        owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
        _, at, often = np.unique(code, return_inverse=True, return_counts=True)
        shared = often[at] > 1
        number = np.cumsum(often > 1) - 1
        at, owner = number[at[shared]], owner[shared]
        total = np.zeros((len(used), len(used)), dtype=np.float32)
        for low in range(0, int(at.max()) + 1 if len(at) else 0, COLUMNS):
            here = (at >= low) & (at < low + COLUMNS)
            part = np.zeros((len(used), COLUMNS), dtype=np.float32)
            part[owner[here], at[here] - low] = 1
            total += part @ part.T
        common = total[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)
    union = size[a] + size[b] - common
    return common >= threshold * union - 1e-9


def _blocks(group: np.ndarray, side: np.ndarray):
    """Index pairs of one tile, a bounded number at a time: both of one group, and of different sides if there are two."""
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]]))
    held_a, held_b, held = [], [], 0
    for low, high in zip(edges[:-1], edges[1:]):
        member = order[low:high]
        first, second = member[side[member] == 0], member[side[member] == 1]
        if len(second):
            lists = [(np.repeat(first[i : i + max(1, PAIRS // len(second))], len(second)), np.tile(second, len(first[i : i + max(1, PAIRS // len(second))]))) for i in range(0, len(first), max(1, PAIRS // len(second)))]
        else:
            i, j = np.triu_indices(len(first), 1)
            lists = [(first[i[k : k + PAIRS]], first[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
        for a, b in lists:
            held_a.append(a)
            held_b.append(b)
            held += len(a)
            if held >= PAIRS:
                yield np.concatenate(held_a), np.concatenate(held_b)
                held_a, held_b, held = [], [], 0
    if held:
        yield np.concatenate(held_a), np.concatenate(held_b)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def _joiner(threshold: float, fewest: list[int]):
    def tile(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy()
        group, side = table["root"].to_numpy(), table["side"].to_numpy()
        size, copies = table["n"].to_numpy(), table["copies"].to_numpy()
        sign = np.frombuffer(b"".join(table["sign"].to_pylist()), dtype=np.uint8).reshape(len(key), -1)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].to_pylist()]
        links, parent = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
        for a, b in _blocks(group, side):
            fit = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
            a, b = pruned(sign, a[fit], b[fit], fewest)
            good = verified(sets, size, a, b, threshold)
            a, b = a[good], b[good]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for i, j in zip(a.tolist(), b.tolist()):
                i, j = _root(parent, i), _root(parent, j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
        top = np.array([_root(parent, i) for i in range(len(key))], dtype=np.int64)
        found = np.flatnonzero(links)
        return pa.table({"key": pa.array(key[found]), "links": pa.array(links[found]), "top": pa.array(key[top[found]] if len(found) else key[:0])})

    return tile


def _shingler(width: int):
    def measure(text: pa.Array) -> list[pa.Array]:
        code, row = shingles(text, width)
        ends = np.searchsorted(row, np.arange(len(text) + 1))
        return [pa.array([code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())]

    return measure


def _classes(docs: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_key, n shingles, key of their set or null), and per key: root of its class, copies, links
    to other keys, low_id, the smallest id of the class."""
    rows = written(annotate(
        docs.withColumn("text_key", F.xxhash64("text")), ["doc_id", "text_key"],
        "key long, n long, sign binary, bands array<long>", lambda text: signatures(text, width)))
    full = rows.where(F.col("key").isNotNull())
    sets = written(full.groupBy("key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("low_id"), F.first("n").alias("n"), F.first("sign").alias("sign"),
        F.first("bands").alias("bands"), F.min(F.struct("text_key", "doc_id")).alias("example")))

    band = sets.select("key", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    edges = band.join(shared.select("band", "low"), "band").where(F.col("key") != F.col("low")).select(F.col("key").alias("a"), F.col("low").alias("b"))
    candidates = written(components(edges))

    sizes = candidates.groupBy("root").agg(F.count("*").alias("m"))
    small = sizes.agg(F.sum(F.when(F.col("m") <= TILE, F.col("m")))).first()[0] or 0
    bins = -(-small // TILE) or 1
    members = candidates.join(sizes, "root").join(sets.drop("bands", "low_id"), F.col("node") == F.col("key")).withColumns({
        "parts": F.ceil(F.col("m") / TILE).cast("int"),
        "text_key": F.col("example.text_key"), "example_id": F.col("example.doc_id")}).drop("example", "node", "m")
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(
        members, ["text_key"]).where(F.col("doc_id").eqNullSafe(F.col("example_id")))
    carry = ["key", "root", "n", "copies", "sign", "parts"]
    whole = annotate(texts, carry, "shingles binary", _shingler(width)).dropDuplicates(["key"])
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    tiles = whole.withColumns({"part": part, "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).select(
        *carry[:5], "shingles", (F.col("part") > F.col("other")).cast("int").alias("side"),
        F.when(F.col("parts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("unit"),
        F.when(F.col("parts") > 1, F.least("part", "other")).otherwise(-1).alias("i"), F.greatest("part", "other").alias("j"))
    found = written(tiles.groupBy("unit", "i", "j").applyInArrow(_joiner(threshold, least_equal(threshold, TOLERANCE)), "key long, links long, top long"))

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("key").alias("a"), F.col("top").alias("b")))
    named = sets.select("key", "copies", "low_id").join(classes.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    named = written(named.withColumns({"root": F.coalesce("root", "key"), "links": F.coalesce("links", F.lit(0))}))
    lowest = named.groupBy("root").agg(F.min("low_id").alias("class_id"))
    return rows.select("doc_id", "text_key", "key", "n"), named.join(lowest, "root").select("key", "root", "class_id", "copies", "links")


def link_documents(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, n_shingles.

    Two documents are linked if the Jaccard similarity of their sets of word shingles (words between ASCII white
    space, A-Z folded) is ``threshold`` or more. n_links counts the other documents a document is linked to, copies
    included, n_copies the documents with an equal set, itself included. class_id is the smallest doc_id of the
    connected group. A text of fewer words than a shingle is one shingle; null, empty and blank texts have none, no
    links, and are their own class. Null ids and repeated rows are rows like any other; a class of null ids only has
    a null class_id. An empty table gives an empty table.
    """
    need(docs, "doc_id", "text")
    rows, named = _classes(docs.select("doc_id", "text"), width, threshold)
    return rows.join(named.drop("root"), "key", "left").select(
        "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"), F.col("n").alias("n_shingles"))


def unique_documents(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group with its own columns: the one with the smallest id, a null id last, of equal ids the
    one whose text has the smallest hash. Documents are told apart by id and text, so an id that repeats with unlike texts
    loses only the texts that are copies. Of rows that repeat id and text one stays. Texts without words are no copies of
    each other. An empty table gives an empty table.
    """
    need(docs, "doc_id", "text")
    own, restore = hidden(docs, "doc_id", "text")
    rows, named = _classes(own.select("doc_id", "text"), width, threshold)
    # a class of one key with one copy keeps its document; of others the losers are named
    crowded = named.groupBy("root").agg(F.sum("copies").alias("size")).where("size > 1").select("root")
    members = rows.join(named.select("key", "root"), "key").join(crowded, "root").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("who"))
    winners = members.groupBy("root").agg(F.min("who").alias("winner"))
    gone = members.distinct().join(winners, "root").where(F.col("who") != F.col("winner")).select(F.col("who.doc_id").alias("_id"), F.col("who.text_key").alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    kept = own.join(gone, same, "left_anti")
    repeated = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).where("rows > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])).select(restore)
