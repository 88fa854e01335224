"""Lifecycle rules: which objects, versions and uploads they act on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketscope.operators import namespace

#: bucket, rule number, prefix, days for current objects, days for others, enabled.
RULES = [("b0", 1, "y=1995/", 30, 7, True), ("b1", 1, "y=1996/", 400, 30, True), ("b1", 2, "y=1997/m=0", 10, None, True), ("b2", 1, "", 900, 90, True), ("b3", 1, "y=199", None, 365, True), ("b4", 1, "", 1, 1, False)]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "bucket string, rule_no int, prefix string, current_days int, other_days int, enabled boolean")


def _due(rows: DataFrame, ruled: DataFrame, days: str, now: str) -> DataFrame:
    """Rows that a rule's prefix covers and that are old enough, the boundary included. Rules are few for each bucket."""
    pairs = rows.join(F.broadcast(ruled.filter(f"enabled and {days} is not null")), "bucket").filter("startswith(key, prefix)")
    return pairs.filter(F.expr(f"last_modified <= timestamp_ntz'{now}' - make_dt_interval({days})"))


def expired(versions: DataFrame, ruled: DataFrame, now: str) -> DataFrame:
    return _due(namespace.current(versions), ruled, "current_days", now).select("bucket", "rule_no", F.lit("expire").alias("action"), "key", "version_id")


def expired_noncurrent(versions: DataFrame, ruled: DataFrame, now: str) -> DataFrame:
    """By a version's own age; markers that are not current go, too."""
    return _due(namespace.noncurrent(versions), ruled, "other_days", now).select("bucket", "rule_no", F.lit("noncurrent").alias("action"), "key", "version_id")


def plan(versions: DataFrame, ruled: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    """All actions; with a limit, the first in order of bucket, rule, action and key."""
    actions = expired(versions, ruled, now).union(expired_noncurrent(versions, ruled, now))
    return actions if limit is None else actions.orderBy("bucket", "rule_no", "action", "key", "version_id").limit(limit)
