"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups, and a witness for every row.

A tree takes ``FANOUT`` consecutive nodes as one run and hashes the run to a node of the next level until one node is
left. Rows are ranked within their group by a range sort. Aligned blocks of ``FANOUT ** LEVELS`` nodes are then read by
one task each, which appends node after node: a node joins the open run of its level, a full run becomes a node of the
level above. A witness is begun when its node is appended and hangs on the open run, so that each sibling that completes
later extends it; an open run is shared by all witnesses below it, which are therefore kept once. The roots of the blocks
are appended to a further tree in the same way, and what that tree attests is joined to the blocks below.

No task sees more than one block, however large a group is.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import need, written

FANOUT, LEVELS = 16, 2
SIZE = 32  # bytes of a digest
WITNESS = "array<struct<place:int,siblings:binary>>"


def sealed(*parts: Column) -> Column:
    """SHA-256, as bytes, of text columns put together."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def field(value: Column) -> Column:
    """A value with the number of its bytes in front; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` written with ``idx``, the place of a row in its group from 0, and ``n``, the rows of the group.

    Nulls come first. The sort is by ranges of group and order, so a large group is spread over many tasks; places are
    the row's place in its task and the number of rows of the group in the tasks before.
    """
    sorted_rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = written(sorted_rows.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy(F.col(group).alias("_group"), F.col("part").alias("_part")).agg(F.min("at").alias("low"), F.count("*").alias("here"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "before": F.coalesce(F.sum("here").over(before), F.lit(0)), "n": F.sum("here").over(Window.partitionBy("_group"))})
    found = rows.join(parts, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("idx", F.col("at") - F.col("low") + F.col("before")).select(*df.columns, "idx", "n")


class Run:
    """Digests of an open or closed run; ``above`` is the run that its node joined and the place there."""

    __slots__ = ("digests", "above")

    def __init__(self):
        self.digests, self.above = [], None


class Appender:
    """Append-only tree over the nodes of one block; at most one run is open on each level."""

    def __init__(self, fanout: int):
        self.fanout, self.open = fanout, []

    def append(self, digest: bytes, below: Run | None = None, level: int = 0) -> Run:
        """Add a node; ``below`` is the run it stands for. Witnesses below ``below`` go on with the run returned."""
        if level == len(self.open):
            self.open.append(Run())
        run = self.open[level]
        if below is not None:
            below.above = run, len(run.digests)
        run.digests.append(digest)
        if len(run.digests) == self.fanout:
            self._close(level)
        return run

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], Run()
        self.append(hashlib.sha256(b"".join(run.digests).hex().encode()).digest(), run, level + 1)

    def finish(self, height: int) -> bytes:
        """Close what is open up to ``height`` levels; the root of the block."""
        for level in range(height):
            if level < len(self.open) and self.open[level].digests:
                self._close(level)
        return self.open[height].digests[0]


def witness(run: Run, height: int) -> list[dict]:
    """Places and siblings above the node of ``run``, inside a block of ``height`` levels."""
    out = []
    for _ in range(height - 1):
        run, place = run.above
        out.append({"place": place, "siblings": b"".join(run.digests[:place] + run.digests[place + 1 :])})
    return out


def levels_of(nodes: int, fanout: int) -> int:
    """Levels of hashing until one of so many nodes is left."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // fanout), height + 1
    return height


def _block(fanout: int, levels: int, schema: pa.Schema):
    """Reads one block (group, block, idx, n, digest, payload); a row per run of its nodes."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("idx").to_numpy(), kind="stable"))).combine_chunks()
        digests, total = table.column("digest").to_pylist(), table.column("n")[0].as_py()
        height = levels if total > fanout**levels else levels_of(total, fanout)
        tree, runs = Appender(fanout), []
        for digest in digests:
            run = tree.append(digest)
            if not runs or runs[-1] is not run:
                runs.append(run)
        root = tree.finish(height)
        ends = np.cumsum([len(r.digests) for r in runs])
        members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), table.column("payload").combine_chunks())
        first = table.slice(0, 1)
        same = lambda name: pa.concat_arrays([first.column(name).combine_chunks()] * len(runs))
        joined = [b"".join(r.digests) if height else None for r in runs]  # a lone node is its own tree, without a level
        return pa.Table.from_arrays([
            same("grp"), same("block"), same("n"), pa.array(range(len(runs)), pa.int32()), members, pa.array(joined, pa.binary()),
            pa.array([witness(r, height) if height else [] for r in runs], schema.field("inner").type), pa.array([root] * len(runs), pa.binary())],
            schema=schema)

    return grow


def _schema_of(nodes: DataFrame) -> tuple:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, StructField, StructType

    named = {f.name: f for f in StructType.fromDDL(f"n long, run int, digests binary, inner {WITNESS}, root binary")}
    out = StructType([
        StructField("grp", nodes.schema["grp"].dataType), StructField("block", nodes.schema["idx"].dataType), named["n"], named["run"],
        StructField("members", ArrayType(nodes.schema["payload"].dataType)), named["digests"], named["inner"], named["root"]])
    return out, to_arrow_schema(out)


def grow(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes`` (grp, idx, n, digest, payload), as two tables for ``attested``.

    Runs (grp, block, run, members, digests, inner) hold the nodes with what their block attests; blocks (grp, block,
    above, top) what is attested of a block further up, and the root of the group.
    """
    width = fanout**levels
    spark_schema, arrow_schema = _schema_of(nodes)
    keyed = nodes.withColumn("block", F.floor(F.col("idx") / width))
    runs = written(keyed.groupBy("grp", "block").applyInArrow(_block(fanout, levels, arrow_schema), spark_schema))
    roots = runs.where("run = 0").select("grp", "block", F.ceil(F.col("n") / width).alias("n"), F.col("root").alias("digest"))
    blocks = roots.where("n = 1").select("grp", "block", F.array().cast(WITNESS).alias("above"), F.col("digest").alias("top"))
    if (roots.agg(F.max("n")).first()[0] or 0) > 1:
        more = roots.where("n > 1").select("grp", F.col("block").alias("idx"), "n", "digest", F.struct("block").alias("payload"))
        higher = attested(*grow(more, fanout, levels))
        blocks = blocks.union(higher.select("grp", "payload.block", "witness", "top"))
    return runs.drop("n", "root"), written(blocks)


def attested(runs: DataFrame, blocks: DataFrame, *more: str) -> DataFrame:
    """Every node: grp, payload, witness (its siblings, level by level), top (root of its group), columns ``more`` of blocks."""
    above = blocks.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "above", "top", *more)
    found = runs.join(above, (F.col("block") == F.col("_block")) & F.col("grp").eqNullSafe(F.col("_grp")))
    found = found.select("grp", "digests", F.concat("inner", "above").alias("upper"), "top", *more, F.posexplode("members").alias("place", "payload"))
    cut = (F.col("place") * SIZE).cast("int")
    others = F.concat(F.col("digests").substr(F.lit(1), cut), F.col("digests").substr(cut + SIZE + 1, F.octet_length("digests")))
    own = F.array(F.struct(F.col("place").alias("place"), others.alias("siblings")))
    return found.select("grp", "payload", F.when(F.col("digests").isNull(), F.col("upper")).otherwise(F.concat(own, "upper")).alias("witness"), "top", *more)


def folded(digest: Column, path: Column) -> Column:
    """Root that a digest and a witness lead to."""
    def step(value, level):
        cut = (level["place"] * SIZE).cast("int")
        joined = F.concat(level["siblings"].substr(F.lit(1), cut), value, level["siblings"].substr(cut + 1, F.octet_length(level["siblings"])))
        return sealed(F.lower(F.hex(joined)))

    return F.aggregate(path, digest, step)


def proof_text(path: Column) -> Column:
    """All siblings of a witness as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda level: F.lower(F.hex(level["siblings"]))), "")


def manifest(rows: DataFrame, group: str, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """All columns of ``rows``, which has a digest ``leaf`` (binary), and subroot, root (binary) and witness.

    Leaves of one value of ``group`` (null is a value) ascend by ``order``, null first, then by leaf; groups ascend by
    their value, null first. The witness leads from the leaf over the subroot to the root. Rows that repeat everything
    are leaves of their own. An empty table gives an empty table. Columns named like a new one are replaced; any other
    column may have any name.
    """
    need(rows, "leaf", group, *order)
    carried = [c for c in rows.columns if c not in ("subroot", "root", "witness")]
    names = {c: f"c{i}" for i, c in enumerate(carried)}
    plain = rows.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    placed = ranked(plain, names[group], [names[c] for c in order] + [names["leaf"]])
    nodes = placed.select(F.col(names[group]).alias("grp"), "idx", "n", F.col(names["leaf"]).alias("digest"), F.struct(*names.values()).alias("payload"))
    runs, blocks = grow(nodes, fanout, levels)

    tops = ranked(blocks.where("block = 0").select(F.lit(0).alias("all"), "grp", "top"), "all", ["grp"])
    tops = tops.select(F.col("all").alias("grp"), "idx", "n", F.col("top").alias("digest"), F.struct(F.col("grp").alias("of"), F.col("top").alias("subroot")).alias("payload"))
    tops = attested(*grow(tops, fanout, levels)).select("payload.of", "payload.subroot", "witness", F.col("top").alias("root"))
    blocks = blocks.join(tops, F.col("grp").eqNullSafe(F.col("of"))).select(
        "grp", "block", F.concat("above", "witness").alias("above"), F.col("subroot").alias("top"), "root")
    found = attested(runs, blocks, "root")
    return found.select(*[F.col(f"payload.{n}").alias(c) for c, n in names.items()], F.col("top").alias("subroot"), "root", "witness")


def document_leaf(text: Column) -> Column:
    """Digest of a document's columns with ``text`` in place of its own."""
    return sealed(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def verified_documents(docs: DataFrame) -> DataFrame:
    """Manifest of documents by source and doc_id, each checked against its witness after some were tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root (hex text) and verified. Tampering lower-cases A-Z in
    the text of documents whose id has a crc32 that 5 divides; a null id has none. Null values are part of the leaf.
    """
    need(docs, "doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(
        "doc_id", "source", document_leaf(F.col("text")).alias("leaf"),
        F.when(hit, document_leaf(lower_ascii(F.col("text")))).alias("tampered"))
    found = manifest(rows, "source", ["doc_id"])
    text = lambda c: F.lower(F.hex(c))
    found = found.withColumn("folded", folded(F.coalesce("tampered", "leaf"), F.col("witness")))
    return found.select(
        "doc_id", *[text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof_text(F.col("witness")), 256).alias("proof_sha256"),
        text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
