"""Helpers the operators of this subpackage share: tables, written steps, key checks, folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share; a temporary one only in a local session that names none."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set(SETTING, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Rows written with checkpoint(), so that a lost executor does not repeat the steps before."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, compression: str = "snappy", key: str | None = None) -> DataFrame:
    """Rows written as a Parquet table under a fresh name in the shared folder and read back.

    The shuffle files of the step are removed with its end, not when the driver happens to collect its garbage. With
    ``key`` the rows lie in as many buckets of that column as a shuffle has partitions, so that joins by it and groupings
    that hold it do not shuffle them; the table is in the catalog while it is written only.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path, known = f"{shared_folder(spark)}/llm/{name}", f"spark_catalog.default.llm_{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        if key is None:
            df.write.parquet(path, compression=compression)
        else:
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.bucketBy(buckets, key).saveAsTable(known, format="parquet", path=path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if key is None:
        out = spark.read.schema(df.schema).parquet(path)
    else:
        out = spark.table(known)
        spark.sql(f"DROP TABLE {known}")  # the files stay
    out._written_to = path
    return out


def removed(*steps: DataFrame) -> None:
    """Deletes the files of ``written`` steps; only for steps of which all that was made is written itself."""
    for step in steps:
        spark = step.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(step._written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of crc32 of the id as text; an id of null is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts), F.lit(0).cast("bigint"))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}; found {', '.join(df.columns)}")


def columns(df: DataFrame, *left_out: str) -> list[Column]:
    """The columns of a frame, whatever they are called, but for those left out."""
    return [F.col(f"`{c}`").alias(c) for c in df.columns if c not in left_out]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    while name in df.columns:
        name = f"_{name}"
    return name


def hidden(df: DataFrame, *kept: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``kept`` renamed out of the way of computed ones, and what brings the names back."""
    names = {c: c if c in kept else f"_own_{i}" for i, c in enumerate(df.columns)}
    return df.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


SLICE_BYTES = 8 << 20


def slices(batch, text: int, most: int = SLICE_BYTES):
    """Rows of a batch, so many at a time that their texts hold about ``most`` bytes; a longer text comes alone."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(size.searchsorted(before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def annotate(df: DataFrame, carry: list[str], fields: str, measure, most: int = SLICE_BYTES) -> DataFrame:
    """Columns ``carry`` of ``df`` and new ones that ``measure(text column) -> list of Arrow arrays`` computes.

    ``fields`` is the DDL of the new columns; they replace carried ones of the same name. The work is done batch by
    batch in the tasks that read the rows, without a shuffle; Spark bounds a batch by rows and by bytes, and ``measure``
    sees texts of about ``most`` bytes at once. A text that is carried is sent once.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructField, StructType

    new = StructType.fromDDL(fields)
    carry = [c for c in carry if c not in new.fieldNames()]
    plain = [f"c{i}" for i in range(len(carry))]  # whatever the columns are called
    schema = StructType([StructField(p, df.schema[c].dataType, True) for p, c in zip(plain, carry)] + list(new))

    text = carry.index("text") if "text" in carry else len(carry)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, most):
                kept = [part.column(i) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(kept + measure(part.column(text)), schema.fieldNames())
            pa.default_memory_pool().release_unused()

    read = df.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(carry, plain)], *[F.col("text").alias("text")] * (text == len(carry)))
    return read.mapInArrow(run, schema).toDF(*carry, *new.fieldNames())
