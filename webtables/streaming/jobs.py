"""Structured Streaming jobs over the batch operators, run until the available input is used up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import beacons
from ..sources import sinks


def parquet_stream(spark: SparkSession, folder: str, name: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Stream over the Parquet files of one table; the schema is that of the files already there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def beacon_stream(requests: DataFrame, path: str, checkpoint: str):
    """Parse arriving beacon requests and append them; stateless, so it scales with its input partitions."""
    return append_to(beacons.parse_beacons(requests), path, checkpoint)


def reflection_counts(events: DataFrame, time: str = "ts") -> DataFrame:
    """Counts per half-hour bucket, emitted once the bucket is older than the 30 minutes granted to late events."""
    timed = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", "30 minutes")
    buckets = timed.groupBy(F.window("__time", "30 minutes").alias("bucket")).agg(F.count("*").alias("n"))
    end = F.col("bucket.end")
    return buckets.select(
        F.col("bucket.start").alias("bucket_start"), (end + F.expr("INTERVAL 30 MINUTES")).alias("available_at"), "n"
    )


def reflection_stream(events: DataFrame, path: str, checkpoint: str, time: str = "ts"):
    return append_to(reflection_counts(events, time), path, checkpoint)


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str | None = None):
    """Keyed report table refreshed per micro-batch.

    Each batch writes only its own rows, one per key, into the partition of its query and number, so a repeated batch
    replaces itself and the table is never rewritten. A query with a fresh checkpoint counts its batches from 0 again,
    but is another query and comes after all before it. :func:`read_upserted` merges on read, :func:`compact` bounds how
    much there is to merge.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = sinks.one_per_key(batch, keys, order)
        rows.write.mode("overwrite").parquet(f"{path}/query={_query_folder(batch.sparkSession, path, query)}/batch={batch_id}")

    return updates.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _query_folder(spark: SparkSession, path: str, query: str) -> str:
    """Name of a query's part of a table, the number of queries before it in front; the one it has, if it has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/query=*")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    names = [f.getPath().getName().removeprefix("query=") for f in found]
    own = [n for n in names if n.endswith(f"_{query}")]
    return own[0] if own else f"{max((int(n.split('_')[0]) for n in names), default=0) + 1:09d}_{query}"


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Current table: for every key the row of its newest batch, or the greatest by ``order`` over all batches.

    Batches of a later query are newer than those of one before; batches stored without a query are the oldest.
    """
    rows = spark.read.option("basePath", path).parquet(path)
    age = F.struct(*[F.coalesce(F.col(c), F.lit("" if c == "query" else -1)) for c in ("query", "batch") if c in rows.columns])
    rank = age if order is None else F.struct(F.col(order), age)
    return sinks.one_per_key(rows, keys, rank).drop("query", "batch")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], order: str | None = None) -> None:
    """Write the merged table to a new path as the oldest batch, the base for later ones."""
    read_upserted(spark, path, keys, order).write.parquet(f"{target}/query=000000000_base/batch=-1")
