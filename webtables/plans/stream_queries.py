"""Streaming jobs over the driver tables, run to the end of the input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.workdir import fresh_path
from ..streaming import jobs
from . import views
from .registry import query


@query(
    """
    SELECT seq, regexp_extract(url, '/ss/([^/?]+)', 1) AS rsid,
           CASE WHEN body <> '' THEN regexp_extract(body, 'pageName=([^&]*)', 1) ELSE regexp_extract(url, 'pageName=([^&]*)', 1) END AS page_name
    FROM request_rows
    """,
    "request_rows",
)
def beacon_stream(spark, sf):
    path = fresh_path(spark, "beacons")
    requests = jobs.parquet_stream(spark, sf, "events").selectExpr(*views._REQUESTS).select("seq", "url", "body")
    jobs.beacon_stream(requests, path, fresh_path(spark, "beacons-state")).awaitTermination()
    value = F.col("variables")
    return spark.read.parquet(path).select("seq", value["rsid"].alias("rsid"), value["pageName"].alias("page_name"))


@query(
    """
    WITH b AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS bucket_start, strftime(start + INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S') AS available_at, n FROM b
    WHERE start + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)
    """
)
def reflection_stream(spark, sf):
    """Buckets the watermark has closed; later ones are still open when the input ends."""
    path = fresh_path(spark, "buckets")
    events = jobs.parquet_stream(spark, sf, "events").select("ts")
    jobs.reflection_stream(events, path, fresh_path(spark, "buckets-state")).awaitTermination()
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("bucket_start", "available_at")]
    return spark.read.parquet(path).select(*shown, "n")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_stream(spark, sf):
    path = fresh_path(spark, "latest")
    updates = jobs.parquet_stream(spark, sf, "events").select("user_id", "event_id", "event_type")
    jobs.upsert_stream(updates, path, fresh_path(spark, "latest-state"), ["user_id"], "event_id").awaitTermination()
    return jobs.read_upserted(spark, path, ["user_id"], "event_id")
