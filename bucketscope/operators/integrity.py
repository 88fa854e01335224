"""Integrity: health of objects, scrub, consistency, repair queue, garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def object_health(shards: DataFrame, read_quorum: int, write_quorum: int) -> DataFrame:
    """object_no and its flags, from parts and their shards."""
    parts = shards.groupBy("object_no", "part_no").agg(F.count(F.lit(1)).alias("shards"), F.count_if(F.col("status") == "available").alias("ok"))
    return parts.groupBy("object_no").agg(
        F.count(F.lit(1)).alias("parts"),
        F.bool_or(F.col("ok") < read_quorum).alias("unrecoverable"),
        F.bool_or(F.col("ok") < write_quorum).alias("under_replicated"),
        F.bool_or(F.col("ok") < F.col("shards")).alias("degraded"),
    )


def health(shards: DataFrame, read_quorum: int, write_quorum: int) -> DataFrame:
    flags = object_health(shards, read_quorum, write_quorum)
    return flags.agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if("degraded").alias("degraded"),
        F.count_if("unrecoverable").alias("unrecoverable"),
        F.count_if("under_replicated").alias("under_replicated"),
        F.count_if(F.expr("degraded and not unrecoverable")).alias("recoverable_degraded"),
    )


def scrub(shards: DataFrame) -> DataFrame:
    """Missing shards are not among the checked ones."""
    c = lambda s: F.count_if(F.col("status") == s)
    return shards.agg((F.count(F.lit(1)) - c("missing")).alias("checked"), c("missing").alias("missing"), c("corrupt").alias("corrupt"), F.count_if(F.col("status") != "available").alias("queued"))


def consistency(shards: DataFrame, copies: int) -> DataFrame:
    """One reason for each object that needs repair, the first that holds."""
    rows = shards.groupBy("object_no").agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "available").alias("ok"))
    reason = F.when(F.col("ok") == 0, "ManifestMissing").when(F.col("missing") > 0, "ShardMissing").when(F.col("ok") < copies, "UnderReplicated")
    return rows.withColumn("reason", reason).filter("reason is not null").select("object_no", "reason", "missing", "ok")


def queue_status(most: int) -> str:
    return f"case when attempts >= {most} or status = 'Failed' then 'Failed' when next_day > 30 then 'RetryScheduled' else 'Pending' end"


def queue(heal: DataFrame, most: int) -> DataFrame:
    rows = heal.withColumn("s", F.expr(queue_status(most)))
    failed = F.col("s") == "Failed"
    return rows.groupBy("reason").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~failed).alias("pending"),
        F.count_if(failed).alias("failed"),
        F.count_if((F.col("attempts") > 0) & ~failed).alias("retryable"),
        F.count_if(F.col("attempts") >= most).alias("at_most_attempts"),
        F.min(F.when(~failed, F.col("queued_at"))).alias("oldest_queued_at"),
    )


def priority(heal: DataFrame, most: int, n: int = 25) -> DataFrame:
    rows = heal.withColumn("s", F.expr(queue_status(most))).withColumn("prio", F.expr("case s when 'Failed' then 3 when 'RetryScheduled' then 2 else 1 end"))
    return rows.orderBy(F.desc("prio"), F.expr("coalesce(timestamp_ntz'1998-01-01' + make_dt_interval(next_day), queued_at)"), "queued_at", "object_no").limit(n).select("object_no", F.col("s").alias("state"), "prio", "attempts")


def backoff() -> str:
    """Seconds before the next attempt: doubling from 15, 900 at most."""
    return "least(900, 15 * cast(power(2, least(greatest(attempts - 1, 0), 6)) as int))"


def garbage(files: DataFrame, referenced: DataFrame, before: str, limit: int | None = None) -> DataFrame:
    """Files that nothing refers to, old enough (strictly), by class; temporary files need no reference check."""
    temp = F.expr("startswith(path, '.sys/tmp/') or endswith(path, '.tmp')")
    old = files.filter(F.expr(f"modified_at < timestamp_ntz'{before}'"))
    orphans = old.filter(~temp).join(referenced.select("path").distinct(), "path", "left_anti").unionByName(old.filter(temp))
    kind = F.when(temp, "temp").when(F.col("path").contains("/multipart-"), "multipart").otherwise("replica")
    rows = orphans.select("path", "size", kind.alias("kind"))
    return rows if limit is None else rows.orderBy("path").limit(limit)
