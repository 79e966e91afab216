"""Packing of tokenised documents into training sequences by bounded-space online best fit.

Each task keeps at most ``OPEN`` open windows. A document fills whole windows by itself first; its rest goes to the open
window that it leaves the least room in. If it fits in none and no further window may be opened, the fullest one is
emitted: with the head of the rest where its room is more than ``ROOM`` tokens, padded where it is not. What is open
when a task ends is merged in the same way by groups of ``MERGE`` tasks, then by groups of such groups. The last group
puts its windows end to end; the remainder that fills no window goes out in sequences of powers of two, which need no
padding.

No rows are moved but those of open windows, a few per task.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import need, slices, written

LENGTH, OPEN, ROOM, MERGE = 2048, 64, 8, 64
END = 1
BATCH_BYTES = 4 << 20

# fixed value: the split of a text that byte-level vocabularies of this family are built on
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte that each printable stand-in of a byte-level vocabulary means: printable Latin-1 bytes stand for themselves,
    the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(spec: str):
    """Function text -> array of ids for a tokenizer file, given as its JSON text.

    Special tokens that occur in a text are ordinary text. Byte-level BPE with the common split runs the same merges in
    ``tiktoken``, several times as fast as in ``tokenizers``, which runs every other file.
    """
    read = json.loads(spec)
    model, split = read["model"], read["pre_tokenizer"] or {}
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if model["type"] == "BPE" and read["normalizer"] is None and usual.items() <= split.items() and not any(model.get(o) for o in options):
        import tiktoken

        letters, added = _byte_of(), {t["content"] for t in read["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merges = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.asarray(merges.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


class Part(NamedTuple):
    """Ids of a document from a place on."""

    doc_id: object
    start: int
    ids: np.ndarray
    doc_tokens: int


def cut(parts: list[Part], size: int) -> tuple[list[Part], list[Part]]:
    """The first ``size`` ids of some parts, and the others."""
    head = []
    for i, part in enumerate(parts):
        if len(part.ids) > size:
            first = part._replace(ids=part.ids[:size])
            return head + [first] * (size > 0), [part._replace(start=part.start + size, ids=part.ids[size:])] + parts[i + 1 :]
        head.append(part)
        size -= len(part.ids)
    return head, []


class Packer:
    """Open windows by the room that they have left; ``emit`` gets each finished one."""

    def __init__(self, emit, length: int = LENGTH, most: int = OPEN, room: int = ROOM):
        self.emit, self.length, self.most, self.room = emit, length, most, room
        self.open: list[tuple[int, int]] = []  # (room left, number), least room first
        self.windows: dict[int, list[Part]] = {}
        self.count = 0

    def add(self, parts: list[Part], size: int) -> None:
        while size >= self.length:
            head, parts = cut(parts, self.length)
            self.emit(head)
            size -= self.length
        parts = [p if p.ids.base is None else p._replace(ids=p.ids.copy()) for p in parts]  # a view would hold its whole document
        while size:
            best = bisect_left(self.open, (size, -1))
            if best < len(self.open):
                left, number = self.open.pop(best)
                self.windows[number] += parts
                if left == size:
                    self.emit(self.windows.pop(number))
                else:
                    insort(self.open, (left - size, number))
                return
            if len(self.open) < self.most:
                self.windows[self.count] = parts
                insort(self.open, (self.length - size, self.count))
                self.count += 1
                return
            left, number = self.open.pop(0)
            window = self.windows.pop(number)
            if left > self.room:
                head, parts = cut(parts, left)
                window, size = window + head, size - left
            self.emit(window)

    def leftovers(self) -> list[list[Part]]:
        """Open windows, fullest first."""
        return [self.windows[number] for _, number in self.open]

    def finish(self) -> None:
        """Put what is open end to end; the last remainder goes out by powers of two."""
        parts = [p for w in self.leftovers() for p in w]
        size = sum(len(p.ids) for p in parts)
        while size:
            step = self.length if size >= self.length else 1 << (size.bit_length() - 1)
            head, parts = cut(parts, step)
            self.emit(head)
            size -= step


PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, bin long"


def _schemas(id_type):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("doc_id", id_type), *StructType.fromDDL(PIECE)])
    return schema, to_arrow_schema(schema)


class Rows:
    """Pieces of windows as rows; ``base`` is the first sequence number of the task."""

    def __init__(self, schema: pa.Schema, base: int, place: int):
        self.schema, self.base, self.place, self.columns, self.bytes = schema, base, place, [[] for _ in schema.names], 0

    def put(self, window: list[Part], open_: bool = False) -> None:
        offset = 0
        for part in window:
            row = (part.doc_id, part.start, len(part.ids), part.ids.tobytes(), part.doc_tokens, self.base, offset, open_, self.place)
            for column, value in zip(self.columns, row):
                column.append(value)
            offset += len(part.ids)
        self.base += 1
        self.bytes += 4 * offset + 64 * len(window)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.schema.types)], schema=self.schema)
        self.columns, self.bytes = [[] for _ in self.schema.names], 0
        return out


def _first_pass(spec, schema: pa.Schema, length: int, most: int, room: int, end: int):
    def run(batches):
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        rows, encode = Rows(schema, place << 33, place), encoder(spec.value)
        packer = Packer(rows.put, length, most, room)
        for batch in batches:
            for piece in slices(batch, 1):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1)):
                    ids = np.append(encode(text.as_py() or ""), np.array([end], dtype="<u4"))
                    packer.add([Part(doc_id, 0, ids, len(ids))], len(ids))
                    if rows.bytes >= BATCH_BYTES:
                        yield rows.batch()
        for window in packer.leftovers():
            rows.put(window, True)
        yield rows.batch()

    return run


def _merge_pass(schema: pa.Schema, tier: int, last: bool, length: int, most: int, room: int):
    """Merges the open windows of one bin."""

    def run(key, table):
        place = key[0].as_py()
        rows = Rows(schema, (tier << 58) + (place << 33), place)
        packer = Packer(rows.put, length, most, room)
        order = np.lexsort((table.column("offset").to_numpy(), table.column("sequence_id").to_numpy()))
        windows: dict[int, list[Part]] = {}
        for r in table.select(["doc_id", "start", "ids", "doc_tokens", "sequence_id"]).take(pa.array(order)).to_pylist():
            part = Part(r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"])
            windows.setdefault(r["sequence_id"], []).append(part)
        sized = [(sum(len(p.ids) for p in w), w) for w in windows.values()]
        for size, window in sorted(sized, key=lambda x: -x[0]):  # stable, so by number among equals
            packer.add(window, size)
        if last:
            packer.finish()
        else:
            for window in packer.leftovers():
                rows.put(window, True)
        return pa.Table.from_batches([rows.batch()], schema)

    return run


def pack_documents(docs: DataFrame, spec: str, length: int = LENGTH, most: int = OPEN, room: int = ROOM, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id (of any type) and text; further columns are ignored. ``spec`` is the JSON text of a tokenizer
    file. A document is the ids of its whole text and then ``end``; a null text is empty, so it is ``end`` alone. Each id
    is in one piece. ``ids`` are little-endian unsigned 32-bit numbers. Sequences have at most ``length`` ids, a power of
    two. Null and repeated ids are ids like any other. An empty table gives an empty table.
    """
    need(docs, "doc_id", "text")
    if length & (length - 1):
        raise ValueError(f"length must be a power of two: {length}")
    schema, arrow = _schemas(docs.schema["doc_id"].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary, a few MB at any size of the data
    found = written(docs.select("doc_id", "text").mapInArrow(_first_pass(shared, arrow, length, most, room, end), schema))
    done, tier = [found.where("NOT open")], 0
    bins = found.where("open").agg(F.max("bin")).first()[0]
    while bins is not None:
        tier, bins = tier + 1, bins // MERGE
        merge = _merge_pass(arrow, tier, bins == 0, length, most, room)
        binned = found.where("open").withColumn("bin", F.floor(F.col("bin") / MERGE))
        found = written(binned.groupBy("bin").applyInArrow(merge, schema))
        done.append(found.where("NOT open"))
        if not bins:
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("open", "bin")


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """One row per sequence: sequence_id, tokens (without padding), ids as an array, padded to ``length`` where the number
    of tokens is no power of two."""
    # a sequence has at most ``length`` pieces
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    flat = F.hex(F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])))
    place = lambda i: F.substring(flat, F.lit(8) * i + 1, F.lit(8))
    swapped = lambda i: F.concat(*[F.substring(place(i), k, 2) for k in (7, 5, 3, 1)])
    ids = F.transform(F.sequence(F.lit(0), F.col("tokens").cast("int") - 1), lambda i: F.conv(swapped(i), 16, 10).cast("int"))
    padding = F.when(F.bit_count("tokens") == 1, 0).otherwise(length - F.col("tokens")).cast("int")
    return parts.select("sequence_id", "tokens", F.concat(ids, F.array_repeat(F.lit(pad), padding)).alias("ids"))
