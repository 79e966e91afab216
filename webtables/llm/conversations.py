"""Repair of the turn structure of conversations by a parallel Viterbi search with rank convergence.

A conversation shall read ``system? (user assistant)+`` or be empty. Four states say what was put out last; each row is
kept, given another role or deleted, and empty turns may be inserted. What a rest of the rows costs from each state is a
vector of four costs, found from the last row backwards.

Rows are range-sorted by conversation and turn and cut into chunks of at most ``ROWS`` rows and ``BYTES`` bytes of text.
A conversation that lies inside one task as one chunk is repaired there. For all others every chunk starts from a
speculative vector, as if the conversation ended behind it. Fix-up passes replace that by the vector that the chunks
behind it lead to, until every chunk's vector differs from the one its neighbour hands over by a constant at most. Each
pass doubles the number of chunks that a vector has gone through, so chunks that forget nothing, such as long runs of
truncated rows, cost a logarithmic number of passes and not one each. The stitched costs then drive the trace: a chunk
traces all four states it may be entered in, the same passes settle which one it is, and the edits are read off.

What a task holds is a chunk; only the text of one result, the audit, grows with its conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from .common import need, written

ROWS, BYTES = 1024, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 50  # more than any cost

# what was put out last: nothing, system, user, assistant
START, SYSTEM, USER, ASSISTANT = range(4)
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # state after the one turn that may be inserted or given a role
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FITS = {"su", "ua", "au"}
SOUND, BLANK, DUPLICATE, SHORT = range(4)  # faults
CLOSED = (0, 2 * INSERT, INSERT, 0)  # costs behind the last row


def _kinds() -> list[tuple[str, int]]:
    return [(initial, fault) for initial in ("s", "u", "a", "") for fault in (SOUND, SHORT)] + [("", BLANK)]


KINDS = _kinds()
GONE = KINDS.index(("", BLANK))  # rows that must be deleted
CODE = {k: i for i, k in enumerate(KINDS)}


def kind(role: str, fault: int) -> int:
    """What the search needs to know of a row."""
    return GONE if fault in (BLANK, DUPLICATE) else CODE[role[:1] if role[:1] in KEPT else "", fault]


def options(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state as (initial, cost, state after), ASCII order."""
    out = [("D", DELETE, state)]
    if code != GONE:
        initial, fault = KINDS[code]
        more = TRUNCATED if fault == SHORT else 0
        if state in KEPT.get(initial, {}):
            out.append(("K", KEEP + more, KEPT[initial][state]))
        out.append(("R", REROLE + more, TURN[state]))
    return out


OPTIONS = [[options(code, state) for state in range(4)] for code in range(len(KINDS))]


def before(code: int, after: tuple) -> tuple:
    """Costs in front of a row from the costs behind it."""
    costs = [min(cost + after[then] for _, cost, then in OPTIONS[code][state]) for state in range(4)]
    for _ in range(3):  # an insertion may be followed by another
        for state, then in TURN.items():
            costs[state] = min(costs[state], INSERT + costs[then])
    return tuple(min(c, FAR) for c in costs)


class Costs:
    """Steps back over rows; few vectors differ by more than a constant, so a step is looked up after its first time."""

    def __init__(self):
        self.known = {}

    def back(self, code: int, after: tuple) -> tuple:
        low = min(after)
        shape = code, tuple(min(a - low, FAR) for a in after)
        if shape not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[shape] = before(code, shape[1])
        return tuple(min(c + low, FAR) for c in self.known[shape])

    def vectors(self, codes: bytes, end: tuple) -> list[tuple]:
        """Costs in front of each row, and behind the last."""
        out = [end]
        for code in reversed(codes):
            out.append(self.back(code, out[-1]))
        return out[::-1]

    def matrix(self, codes: bytes) -> list[int]:
        """Least costs from each state in front of the rows to each state behind them, row by row."""
        ends = []
        for state in range(4):
            vector = tuple(0 if s == state else FAR for s in range(4))
            for code in reversed(codes):
                vector = self.back(code, vector)
            ends.append(vector)
        return [ends[then][state] for state in range(4) for then in range(4)]


def trace(codes: bytes, vectors: list[tuple], state: int, last: bool) -> tuple[str, int, int, list[tuple]]:
    """Audit, cost, state behind the rows and what is put out as (row or None, state), by the least edit of least cost."""
    audit, total, out, i = [], 0, [], 0
    while True:
        here = vectors[i][state]
        if i == len(codes):
            if not last or state in (START, ASSISTANT):
                return "".join(audit), total, state, out
            letter, cost, then = "I", INSERT, TURN[state]
        else:
            edits = OPTIONS[codes[i]][state]
            letter, cost, then = edits[0]
            if cost + vectors[i + 1][then] != here:
                if INSERT + vectors[i][TURN[state]] == here:
                    letter, cost, then = "I", INSERT, TURN[state]
                else:
                    letter, cost, then = next(e for e in edits[1:] if e[1] + vectors[i + 1][e[2]] == here)
        audit.append(letter)
        total += cost
        if letter != "D":
            out.append((None if letter == "I" else i, then if letter != "K" else -1))
        i += letter != "I"
        state = then


class Chunk:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv):
        self.conv, self.turns, self.roles, self.texts, self.faults, self.size = conv, [], [], [], [], 0

    def add(self, turn, role, text, fault) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.roles) >= ROWS or self.size >= BYTES

    def codes(self) -> bytes:
        return bytes(kind(r, f) for r, f in zip(self.roles, self.faults))

    def measures(self) -> dict:
        """What is counted; a sum over chunks needs the turns and initials at their ends as well."""
        turns = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "n": len(self.roles), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "kinds": len(set(turns)),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(SHORT),
            "illegal": sum(a + b not in FITS for a, b in zip(initials, initials[1:])),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None}


def put_out(roles: list[str], texts: list[str], out: list[tuple]) -> list[tuple[str, str]]:
    """Repaired rows (role, text)."""
    return [("" if row is None else texts[row], roles[row] if state < 0 else ROLE[state])[::-1] for row, state in out]


MEASURES = "n long, low long, high long, kinds long, blank long, duplicate long, truncated long, illegal long, first string, last string"
PIECE = "audit string, cost long, turns array<struct<role:string,text:string>>"


def _arrow(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def _schema(conv_type, ddl: str):
    return StructType([StructField("conv_id", conv_type), *StructType.fromDDL(ddl)])


CHUNK = f"place long, whole boolean, {MEASURES}, {PIECE}, roles array<string>, texts array<string>, codes binary, matrix array<long>"


def _chunker(schema: pa.Schema):
    """Cuts sorted rows (conv_id, turn, role, text, fault, present) into chunks and repairs those that are whole."""

    def run(batches):
        from pyspark import TaskContext

        costs, base, count = Costs(), TaskContext.get().partitionId() << 33, 0
        chunk, opened, ready = None, True, []  # opened: the chunk may go on from the task or chunk before

        def row(closed: bool) -> dict:
            nonlocal count
            codes = chunk.codes()
            out = {"conv_id": chunk.conv, "place": base + count, "whole": closed and not opened, **chunk.measures()}
            count += 1
            if out["whole"]:
                audit, cost, _, found = trace(codes, costs.vectors(codes, CLOSED), START, True)
                turns = [{"role": r, "text": t} for r, t in put_out(chunk.roles, chunk.texts, found)]
                return out | {"audit": audit, "cost": cost, "turns": turns}
            return out | {"roles": chunk.roles, "texts": chunk.texts, "codes": codes, "matrix": costs.matrix(codes)}

        for batch in batches:
            for conv, turn, role, text, fault, present in zip(*[c.to_pylist() for c in batch.columns]):
                if chunk is None:
                    chunk = Chunk(conv)
                elif conv != chunk.conv:
                    ready.append(row(True))
                    chunk, opened = Chunk(conv), False
                elif chunk.full() and present:
                    ready.append(row(False))
                    chunk, opened = Chunk(conv), True
                if present:
                    chunk.add(turn, role, text, fault)
                if len(ready) >= 256 or ready and chunk.size > BYTES // 2:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
        if chunk is not None:
            ready.append(row(False))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    return run


def _entries(schema: pa.Schema):
    """For each chunk, given the costs behind it: the state behind it for each state it may be entered in."""

    def run(batches):
        costs = Costs()
        for batch in batches:
            maps = []
            for codes, end, last in zip(*[batch.column(c).to_pylist() for c in ("codes", "end", "is_last")]):
                vectors = costs.vectors(codes, tuple(end))
                then = [trace(codes, vectors, state, last)[2] for state in range(4)]
                maps.append([0 if then[state] == t else FAR for state in range(4) for t in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("chain", "idx", "n")] + [pa.array(maps, schema.field("matrix").type)], schema=schema)

    return run


def _traced(schema: pa.Schema):
    """Edits of each chunk from the state it is entered in."""

    def run(batches):
        costs = Costs()
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time
                got = batch.slice(i, 1).to_pylist()[0]
                vectors = costs.vectors(got["codes"], tuple(got["end"]))
                audit, cost, _, out = trace(got["codes"], vectors, got["entry"].index(0), got["is_last"])
                turns = [{"role": r, "text": t} for r, t in put_out(got["roles"], got["texts"], out)]
                yield pa.RecordBatch.from_pylist([{k: got.get(k) for k in schema.names} | {"audit": audit, "cost": cost, "turns": turns}], schema)

    return run


def times(a: Column, b: Column) -> Column:
    """Product of two matrices of costs, sums for products and least values for sums."""
    return F.array(*[F.least(F.lit(FAR), *[a[4 * i + k] + b[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)])


def applied(a: Column, v: Column) -> Column:
    return F.array(*[F.least(F.lit(FAR), *[a[4 * i + k] + v[k] for k in range(4)]) for i in range(4)])


def shape(v: Column) -> Column:
    """A vector of costs less its least one, so that vectors that differ by a constant are equal."""
    low = F.array_min(v)
    return F.transform(v, lambda x: F.when(x >= FAR, F.lit(FAR)).otherwise(x - low))


def _vector(values) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def settled(chain: DataFrame, end: tuple, guess: tuple) -> DataFrame:
    """(chain, idx, vector): the vector that each matrix of a chain is applied to, up to a constant.

    ``chain`` has chain, idx from 0 to n - 1, n and matrix. The last matrix is applied to ``end``. Others start from
    ``guess`` put through what follows them, as far as a pass has got, and are done when the vector of each is the
    product of the matrix and vector that follow.
    """
    reach, product = 1, chain
    while True:
        rest = product.select(
            "chain", (F.col("idx") - 1).alias("idx"),
            applied(F.col("matrix"), F.when(F.col("idx") + reach >= F.col("n"), _vector(end)).otherwise(_vector(guess))).alias("rest"))
        vectors = chain.join(rest, ["chain", "idx"], "left").withColumn("vector", shape(F.coalesce("rest", _vector(end)))).drop("rest")
        vectors = written(vectors)
        handed = vectors.where("idx > 0").select("chain", (F.col("idx") - 1).alias("idx"), shape(applied(F.col("matrix"), F.col("vector"))).alias("handed"))
        if vectors.join(handed, ["chain", "idx"]).where(F.col("vector") != F.col("handed")).isEmpty():
            return vectors.select("chain", "idx", "vector")
        further = product.select("chain", (F.col("idx") - reach).alias("idx"), F.col("matrix").alias("further"))
        product = written(product.join(further, ["chain", "idx"], "left").withColumn(
            "matrix", F.when(F.col("further").isNull(), F.col("matrix")).otherwise(times(F.col("matrix"), F.col("further")))).drop("further"))
        reach *= 2


def chained(chunks: DataFrame) -> DataFrame:
    """Chunks with their chain (place of the first chunk of the conversation), idx in it and n.

    The chunks that a conversation has in one task are numbered in a row, so only one row per conversation and task is
    added up in order.
    """
    parts = chunks.groupBy(F.col("conv_id").alias("_conv"), F.shiftright("place", 33).alias("_part")).agg(F.min("place").alias("_low"), F.count("*").alias("_here"))
    conv = Window.partitionBy("_conv")
    parts = parts.withColumns({
        "_before": F.coalesce(F.sum("_here").over(conv.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n_chunks": F.sum("_here").over(conv), "chain": F.min("_low").over(conv)})
    found = chunks.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.shiftright("place", 33) == F.col("_part")))
    idx = F.col("place") - F.col("_low") + F.col("_before")
    return found.select(*chunks.columns, "chain", idx.alias("idx"), "n_chunks")


def faulted(df: DataFrame, present: Column) -> DataFrame:
    """Rows with null role and text as one space, their fault, and a key of role and text."""
    rows = df.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        present.alias("present"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = written(rows.withColumns({"key": key, "rid": F.monotonically_increasing_id()}))
    place = F.struct("turn", "rid")  # null turns first; rows that repeat a turn and text in the order they were read
    earliest = rows.where("present").groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min(place).alias("earliest"), F.count("*").alias("copies"))
    earliest = earliest.where("copies > 1").drop("copies")
    rows = rows.join(earliest, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(bare == "", BLANK).when(F.col("earliest").isNotNull() & (place > F.col("earliest")), DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), SHORT).otherwise(SOUND))
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "present", "key", "rid")


def pieces(df: DataFrame, present: Column | None = None) -> DataFrame:
    """Chunks of all conversations with their edits: conv_id, chain, idx, n_chunks, the counts, audit, cost, turns."""
    need(df, "conv_id", "turn", "role", "text")
    rows = faulted(df, F.lit(True) if present is None else present)
    order = ["conv_id", "turn", "key", "rid"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault", "present")
    conv_type = df.schema["conv_id"].dataType
    schema = _schema(conv_type, CHUNK)
    chunks = written(rows.mapInArrow(_chunker(_arrow(schema)), schema))
    counts = [f.split()[0] for f in MEASURES.split(", ")]
    shared = ["conv_id", "chain", "idx", "n_chunks", *counts, "audit", "cost", "turns"]
    whole = chunks.where("whole").withColumns({"chain": F.col("place"), "idx": F.lit(0).cast("bigint"), "n_chunks": F.lit(1).cast("bigint")}).select(*shared)

    split = written(chained(chunks.where("NOT whole").drop("audit", "cost", "turns", "whole")))
    chain = split.select("chain", "idx", F.col("n_chunks").alias("n"), "matrix")
    ends = settled(chain, CLOSED, CLOSED).withColumnRenamed("vector", "end")
    known = split.join(ends, ["chain", "idx"]).withColumn("is_last", F.col("idx") == F.col("n_chunks") - 1)

    # states are settled along the chain the other way round, by transposed maps
    map_schema = StructType.fromDDL("chain long, idx long, n long, matrix array<long>")
    maps = known.select("chain", "idx", F.col("n_chunks").alias("n"), "codes", "end", "is_last")
    maps = maps.mapInArrow(_entries(_arrow(map_schema)), map_schema)
    turned = F.array(*[F.col("matrix")[4 * j + i] for i in range(4) for j in range(4)])
    maps = written(maps.select("chain", (F.col("n") - 1 - F.col("idx")).alias("idx"), "n", turned.alias("matrix")))
    one = lambda state: tuple(0 if s == state else FAR for s in range(4))
    entries = settled(maps, one(START), one(ASSISTANT)).withColumnRenamed("vector", "entry").withColumnRenamed("idx", "back")
    known = known.withColumn("back", F.col("n_chunks") - 1 - F.col("idx")).join(entries, ["chain", "back"])
    out_schema = _schema(conv_type, f"chain long, idx long, n_chunks long, {MEASURES}, {PIECE}")
    read = known.select("conv_id", "chain", "idx", "n_chunks", *counts, "roles", "texts", "codes", "end", "entry", "is_last")
    return whole.union(read.mapInArrow(_traced(_arrow(out_schema)), out_schema).select(*shared))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(schema: pa.Schema):
    """One row per conversation from its chunks in order; text is hashed as it comes and never held."""

    def run(batches):
        state, ready = None, []

        def result() -> dict:
            gaps = state["high"] - state["low"] + 1 - state["kinds"] if state["low"] is not None else 0
            return {k: state[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {
                "gaps": gaps, "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()}

        for batch in batches:
            for i in range(batch.num_rows):
                got = batch.slice(i, 1).to_pylist()[0]
                if state is None or state["chain"] != got["chain"]:
                    if state is not None:
                        ready.append(result())
                    state = {"conv_id": got["conv_id"], "chain": got["chain"], "audit": [], "hash": hashlib.sha256(), "any": False, "low": None, "high": None, "initial": None}
                    state |= dict.fromkeys(("kinds", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
                for k in ("kinds", "blank", "duplicate", "truncated", "illegal", "cost"):
                    state[k] += got[k]
                if got["n"]:
                    state["illegal"] += state["initial"] is not None and state["initial"] + got["first"] not in FITS
                    state["initial"] = got["last"]
                if got["low"] is not None:
                    state["kinds"] -= state["high"] == got["low"]
                    state["low"] = got["low"] if state["low"] is None else state["low"]
                    state["high"] = got["high"]
                state["audit"].append(got["audit"])
                for turn in got["turns"]:
                    state["hash"].update(("\n" if state["any"] else "").encode() + f"{turn['role']}:{turn['text']}".encode())
                    state["any"] = True
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([result()], schema)

    return run


def repair_summary(df: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``df`` has conv_id, turn, role, text; further columns are ignored. Rows are taken by turn, null first, rows of one
    turn by a hash of role and text, so repeated rows follow each other. A null role or text is one space. Rows where
    ``present`` is false only name their conversation; one without other rows has zeros, no audit and the hash of
    nothing. A null conv_id is a conversation. An empty table gives an empty table. The hash of a conversation has to
    read its text in order, so one task reads it, chunk by chunk.
    """
    found = pieces(df, present)
    schema = _schema(df.schema["conv_id"].dataType, SUMMARY)
    one = found.where("n_chunks = 1")
    many = found.where("n_chunks > 1").repartition("chain").sortWithinPartitions("chain", "idx")
    run = _summed(_arrow(schema))
    return one.mapInArrow(run, schema).union(many.mapInArrow(run, schema))


def repaired_turns(df: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired rows: conv_id, chunk, place (in the chunk), role, text; defined as in ``repair_summary``."""
    found = pieces(df, present).select("conv_id", F.col("idx").alias("chunk"), F.posexplode("turns").alias("place", "turn"))
    return found.select("conv_id", "chunk", "place", "turn.role", "turn.text")


def damaged(df: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn`` modulo 20, nulls as one space, and ``present``.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes
    it the user's.
    """
    need(df, "conv_id", "turn", "role", "text")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        (F.col("hit") != 0).alias("present"))
