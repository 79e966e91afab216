"""Files written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..sources.readers import read_table
from ..sources.workdir import fresh_path
from .registry import query

_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def write_result(spark, sf):
    """Overwrite, then append: the two halves come back as one table without stray headers."""
    path = fresh_path(spark, "result")
    customers = read_table(spark, sf, "customer")
    sinks.write_result(customers.filter("c_acctbal >= 0"), path)
    sinks.write_result(customers.filter("c_acctbal < 0"), path, "append")
    return readers.read_result(spark, path, _CUSTOMER)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def load_delimited(spark, sf):
    source, target = fresh_path(spark, "delimited"), fresh_path(spark, "loaded")
    sinks.write_result(read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), source)
    sinks.load_delimited(spark, source, target, "c_custkey bigint, c_name string, c_acctbal double")
    return spark.read.parquet(target)


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def write_table(spark, sf):
    path = fresh_path(spark, "table")
    events = read_table(spark, sf, "events").select("event_id", "event_type")
    sinks.write_table(events, path, "overwrite", partition_by=["event_type"])
    sinks.write_table(events.filter("event_type = 'error'"), path, "append", partition_by=["event_type"])
    return spark.read.parquet(path)


@query(
    """
    SELECT kind, event_id, value FROM (SELECT event_type AS kind, event_id, value FROM events WHERE event_type NOT IN ('click', 'error')
      UNION ALL SELECT event_type, event_id, 0.0 FROM events WHERE event_type IN ('click', 'error'))
    """
)
def replace_group_partitions(spark, sf):
    """Only the partitions of the incoming groups are rewritten."""
    path = fresh_path(spark, "groups")
    events = read_table(spark, sf, "events").select(F.col("event_type").alias("kind"), "event_id", "value")
    sinks.write_table(events, path, "overwrite", partition_by=["kind"])
    incoming = events.filter("kind IN ('click', 'error')").select(
        F.concat(F.lit(" "), F.col("kind")).alias("kind"), "event_id", F.lit(0.0).alias("value")
    )
    sinks.replace_group_partitions(incoming, path, ["kind"])
    return spark.read.parquet(path)


@query(
    """
    SELECT trim(p_brand) AS "Key", arg_max(p_type, p_partkey) AS kind, arg_max(p_name, p_partkey) AS name FROM part GROUP BY p_brand
    """
)
def key_value_tsv(spark, sf):
    path = fresh_path(spark, "classification")
    rows = read_table(spark, sf, "part").select(
        F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("Key"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), "p_partkey"
    )
    sinks.write_result(rows, path, delimiter="\t")
    return readers.read_key_value_tsv(spark, path, ["kind", "name"], order="p_partkey")


@query("SELECT count(*) AS row_count, true AS chunks_fit FROM orders")
def write_chunked(spark, sf):
    """Rows read back from the chunks, and whether every chunk file keeps to the limit."""
    path = fresh_path(spark, "chunks")
    sinks.write_chunked(read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), path, 4000)
    back = spark.read.schema("o_orderkey bigint, o_orderpriority string").option("header", True).option("sep", "\t").csv(path)
    sizes = back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("row_count"), F.bool_and(F.col("n") <= 4000).alias("chunks_fit"))
