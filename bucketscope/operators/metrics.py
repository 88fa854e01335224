"""Request metrics and usage: hourly counters, activity, usage, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("PUT", "GET", "DELETE", "HEAD")


def counters() -> list[Column]:
    """Nine counters of a group of requests: a list request counts as a list only, negative bytes as none."""
    by_method = [F.count_if(~F.col("is_list") & (F.col("method") == m)).alias(f"{m.lower()}_count") for m in METHODS]
    return [
        F.count(F.lit(1)).alias("request_count"),
        F.count_if("is_error").alias("error_count"),
        F.sum(F.greatest("ingress_bytes", F.lit(0))).alias("ingress_bytes"),
        F.sum(F.greatest("egress_bytes", F.lit(0))).alias("egress_bytes"),
        *by_method,
        F.count_if("is_list").alias("list_count"),
        F.max("occurred_at").alias("last_activity_at"),
    ]


COUNTS = ("request_count", "error_count", "ingress_bytes", "egress_bytes", "put_count", "get_count", "delete_count", "head_count", "list_count")


def hourly_by_bucket(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "occurred_at").cast("timestamp_ntz").alias("hour_utc"), "bucket").agg(*counters())


def hourly(by_bucket: DataFrame) -> DataFrame:
    return by_bucket.groupBy("hour_utc").agg(*[F.sum(c).alias(c) for c in COUNTS])


def padded(hours: DataFrame, start: str, end: str) -> DataFrame:
    """A row for every hour of [start, end), with zeros where nothing happened."""
    spark = hours.sparkSession
    frame = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - interval 1 hour, interval 1 hour)")).alias("hour_utc"))
    return frame.join(hours, "hour_utc", "left").select("hour_utc", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def between(log: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open range of time."""
    return log.filter(F.expr(f"occurred_at >= timestamp_ntz'{start}' and occurred_at < timestamp_ntz'{end}'"))


def activity(by_bucket: DataFrame, n: int) -> DataFrame:
    """The buckets used last, up to n of 1 to 50."""
    out = by_bucket.filter("bucket <> ''").groupBy("bucket").agg(F.sum("request_count").alias("request_count"), F.sum("error_count").alias("error_count"), F.max("last_activity_at").alias("last_activity_at"))
    return out.orderBy(F.desc("last_activity_at"), F.desc("request_count"), "bucket").limit(max(1, min(n, 50)))


def usage(current: DataFrame) -> DataFrame:
    return current.groupBy("bucket").agg(F.count(F.lit(1)).alias("object_count"), F.sum("content_length").alias("total_bytes"))


def bucket_usage(buckets: DataFrame, current: DataFrame) -> DataFrame:
    """Every bucket, with zeros for those without objects."""
    return buckets.join(usage(current), "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("object_count", "total_bytes")])


def with_usage(active: DataFrame, used: DataFrame, n: int = 5) -> DataFrame:
    """Active buckets with their usage; without any activity the largest buckets instead."""
    rows = active.join(used, "bucket", "left").select("bucket", "request_count", F.coalesce("object_count", F.lit(0)).alias("object_count"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))
    largest = used.orderBy(F.desc("total_bytes"), "bucket").limit(n).select("bucket", F.lit(0).cast("long").alias("request_count"), "object_count", "total_bytes")
    none = active.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").drop("n")
    return rows.unionByName(largest.join(F.broadcast(none), how="inner"))


def peak_overlap(log: DataFrame, seconds: int) -> DataFrame:
    """bucket, peak: most requests at once, each lasting so many seconds.

    Starts and ends are summed by hour first; only these sums are carried along a bucket, and the
    requests are put in order within their hour, so that no task holds a bucket's whole log.
    """
    from pyspark.sql import Window

    ends = F.col("t") + F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    starts = log.select("bucket", F.col("occurred_at").alias("t"), F.lit(1).alias("n"), "event_id")
    moves = starts.union(starts.select("bucket", ends, F.lit(-1), "event_id")).withColumn("slice", F.date_trunc("hour", "t"))
    sums = moves.groupBy("bucket", "slice").agg(F.sum("n").alias("net"))
    earlier = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("bucket", "slice", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket", "slice").orderBy("t", "n", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    highest = moves.withColumn("now", F.sum("n").over(within)).groupBy("bucket", "slice").agg(F.max("now").alias("most"))
    return highest.join(carried, ["bucket", "slice"]).groupBy("bucket").agg(F.max(F.col("before") + F.col("most")).alias("peak"))
