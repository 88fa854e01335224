"""Administration: access keys, coding profiles, rate profiles, tasks, counters of health, alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscope.functions.scalar import let

# Names and order of task groups.
TASK_GROUPS = ["cluster", "repair", "rebalance", "lifecycle", "replication"]
# Profile, requests, seconds.
LOGIN, CONSOLE, STORE = ("console-login", 10, 60), ("console-api", 600, 60), ("s3", 1200, 60)
# Alert, severity, minutes that it must hold, condition over a snapshot's gauges.
ALERT_RULES = [
    ("NodeOffline", "critical", 2, "nodes_offline > 0"),
    ("DiskOffline", "critical", 2, "disks_offline > 0"),
    ("ReplicaFileMissing", "critical", 1, "files_missing > 0"),
    ("ReadQuorumLost", "critical", 1, "read_quorum_lost > 0"),
    ("ObjectDegraded", "warning", 5, "recoverable_degraded > 0"),
    ("UnderReplicated", "warning", 5, "under_replicated > 0"),
    ("RepairBacklog", "warning", 10, "repair_pending > 0"),
    ("RepairAttemptsExhausted", "critical", 1, "repair_exhausted > 0"),
    ("TaskFailures", "warning", 2, "task_failures > 0"),
    ("MultiNodeWriteRisk", "critical", 1, "write_risk > 0"),
    ("CapacityLow", "warning", 10, "capacity_available < 0.15 * capacity_total"),
    ("CapacityLowWatermark", "warning", 5, "low_watermark_disks > 0"),
    ("FaultDomainsAtRisk", "warning", 5, "min_fault_domains > 0 AND pools_below > 0"),
    ("CapacityCritical", "critical", 2, "capacity_available < 0.05 * capacity_total"),
]


def access_keys(requests: DataFrame, bootstrap: str) -> DataFrame:
    """The keys that requests (seq, made_at, access_key, op, policy) leave: access_key, created_at, has_policy.

    A key that exists is not created again; the bootstrap key is never deleted; a policy is put
    only on a key that exists, and only if it isn't blank. All by sums over keys, without a sort.
    """
    op = lambda x: F.col("op") == x
    gone = requests.filter(op("delete") & (F.col("access_key") != bootstrap)).groupBy("access_key").agg(F.max("seq").alias("gone"))
    rows = requests.filter(~op("delete")).join(gone, "access_key", "left").filter("gone is null or seq > gone")
    created = F.when(op("create"), F.col("seq"))
    changed = F.when((op("put") & (F.trim("policy") != "")) | op("drop"), F.col("seq"))
    policy = F.when(op("drop"), "").otherwise(F.coalesce(F.trim("policy"), F.lit("")))
    found = rows.groupBy("access_key").agg(
        F.min(created).alias("created"), F.min_by("made_at", created).alias("created_at"), F.min_by(policy, created).alias("first"), F.max(changed).alias("changed"), F.max_by(policy, changed).alias("last")
    )
    return found.filter("created is not null").select("access_key", "created_at", F.expr("if(changed > created, last, first) <> ''").alias("has_policy"))


def coding_profiles(log: DataFrame, default: tuple[str, int, int]) -> DataFrame:
    """profile_id, data_shards, parity_shards, enabled from a log (seq, profile_id, doc; null: deleted), by id; the default profile where none is left."""
    doc = F.from_json("doc", "data_shards int, parity_shards int, enabled boolean").alias("d")
    last = log.groupBy("profile_id").agg(F.max_by("doc", "seq").alias("doc")).filter("doc is not null").select("profile_id", doc).select("profile_id", "d.*")
    one = log.sparkSession.createDataFrame([(*default, True)], last.schema)
    none = last.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return last.union(one.join(none).select(*last.columns)).orderBy("profile_id")


def rate_profile(path: str, is_store: str) -> Column:
    """(name, permits, window_s) of a request; null if none limits it."""
    made = lambda p: F.struct(F.lit(p[0]).alias("profile"), F.lit(p[1]).alias("permits"), F.lit(p[2]).alias("window_s"))
    low = F.lower(path)
    return F.when(low == "/api/console/auth/login", made(LOGIN)).when((low == "/api/console") | low.startswith("/api/console/"), made(CONSOLE)).when(F.col(is_store), made(STORE))


def client(forwarded: str, address: str) -> Column:
    """The first hop of a forwarded request, else the address."""
    return F.when(F.trim(forwarded) != "", F.trim(F.split_part(F.col(forwarded), F.lit(","), F.lit(1)))).otherwise(F.coalesce(address, F.lit("unknown")))


def tasks(runs: DataFrame) -> DataFrame:
    """Each task's counts and last run, from runs (category, task_id, status, completed_at, result), in the order of groups."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TASK_GROUPS)), F.col("category")), F.lit(0)) - 1, F.lit(100))
    last = F.max_by(F.struct("status", F.left("result", F.lit(512)).alias("result")), F.struct("completed_at", "status", "result"))
    rows = runs.groupBy("category", "task_id").agg(F.count_if(F.expr("status = 'Succeeded'")).alias("succeeded"), F.count_if(F.expr("status = 'Failed'")).alias("failed"), F.max("completed_at").alias("completed_at"), last.alias("last"))
    return rows.select(order.cast("int").alias("group_order"), "category", "task_id", "succeeded", "failed", "completed_at", "last.status", "last.result").orderBy("group_order", "category", "task_id")


def health_counters(objects: DataFrame, shards: DataFrame, read: int, write: int, data_shards: int | None = None) -> DataFrame:
    """Counters of objects (object_no), their parts and shards. An object without any part is lost in every sense, but not degraded; coded parts need data_shards different places."""
    ok = F.col("status") == "available"
    parts = shards.groupBy("object_no", "part_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.size(F.collect_set(F.when(ok, F.col("set_index")))).alias("places"))
    lost = F.col("places") < data_shards if data_shards else F.col("ok") < max(1, read)
    by_object = parts.groupBy("object_no").agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.bool_or(lost).alias("lost"), F.bool_or(lost | (F.col("ok") < max(1, read))).alias("unread"), F.bool_or(F.col("ok") < max(1, write)).alias("unwritten")
    )
    rows = objects.select("object_no").distinct().join(by_object, "object_no", "left")
    counted = {
        "objects": "true",
        "without_manifest": "n is null",
        "missing_objects": "n is null or ok < n",
        "degraded": "ok < n",
        "recoverable_degraded": "ok < n and not lost",
        "unrecoverable": "n is null or lost",
        "read_quorum_lost": "n is null or unread",
        "write_quorum_lost": "n is null or unwritten",
        "under_replicated": "n is null or unwritten",
    }
    total = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    return rows.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in counted.items()], total("n").alias("records"), total("ok").alias("existing_files"), total(F.expr("n - ok")).alias("missing_files"))


def alerts(snapshots: DataFrame) -> DataFrame:
    """Alerts that held for their rule's time: alert, severity, since, until. Snapshots (taken_at, gauges) follow one another; one that breaks a condition starts it afresh.

    A rule is one partition of a row for each snapshot: it grows with time, not with data.
    """
    rules = [F.struct(F.lit(a).alias("alert"), F.lit(s).alias("severity"), F.lit(m).alias("minutes"), F.coalesce(F.expr(e), F.lit(False)).alias("holds")) for a, s, m, e in ALERT_RULES]
    rows = snapshots.select("taken_at", F.inline(F.array(*rules)))
    broken = F.sum(F.when(F.col("holds"), 0).otherwise(1)).over(Window.partitionBy("alert").orderBy("taken_at"))
    held = rows.withColumn("broken", broken).filter("holds").groupBy("alert", "severity", "minutes", "broken").agg(F.min("taken_at").alias("since"), F.max("taken_at").alias("until"))
    return held.filter(F.expr("until >= since + make_interval(0, 0, 0, 0, 0, minutes)")).select("alert", "severity", "since", "until")


# Headers that a bucket may set, limits of its metadata.
HEADERS = {"cache-control": "Cache-Control", "content-disposition": "Content-Disposition", "content-language": "Content-Language", "expires": "Expires"}
MOST_ENTRIES, MOST_CHARS, MOST_NAME = 20, 1024, 64


def bucket_settings(headers: str, metadata: str) -> Column:
    """(outcome, headers, metadata): settings of a bucket made regular, or the first rule that they break.

    Names are trimmed, headers in their usual form, metadata in lower case without the protocol's
    prefix; blank values go; of names that become equal the last stays. Null maps are empty.
    """
    trimmed = lambda x: f"regexp_replace({x}, '^\\\\s+|\\\\s+$', '')"
    entries = lambda m, name: f"transform(map_entries(coalesce({m}, cast(map() as map<string, string>))), e -> struct({name} as k, {trimmed('e.value')} as v))"
    usual = f"map({', '.join(repr(x) for p in HEADERS.items() for x in p)})"
    head = entries(headers, f"try_element_at({usual}, lower({trimmed('e.key')}))")
    meta = entries(metadata, f"lower(regexp_replace({trimmed('e.key')}, '^(?i)x-amz-meta-', ''))")
    bad_value = f"length(e.v) > {MOST_CHARS} or e.v rlike '[\\\\r\\\\n]'"
    date = "coalesce(try_to_timestamp(e.v), try_to_timestamp(regexp_replace(e.v, '^[A-Za-z]{3}, ', ''), \"dd MMM yyyy HH:mm:ss 'GMT'\")) is null"
    # Later entries win: from the last to the first, each name's first entry stays.
    last = lambda a: let("w", f"reverse(filter({a}, e -> e.v <> ''))", let("k", "transform(w, e -> e.k)", "map_from_entries(reverse(transform(array_distinct(k), n -> w[array_position(k, n) - 1])))"))
    outcome = f"""case when exists(x.h, e -> e.k is null) then 'unsupported header'
      when exists(x.h, e -> {bad_value}) then 'invalid header value'
      when exists(x.h, e -> e.k = 'Expires' and e.v <> '' and {date}) then 'invalid date'
      when exists(x.m, e -> not e.k rlike '^[a-z0-9_.-]{{1,{MOST_NAME}}}$') then 'invalid metadata name'
      when exists(x.m, e -> {bad_value}) then 'invalid metadata value'
      when size(array_distinct(transform(filter(x.m, e -> e.v <> ''), e -> e.k))) > {MOST_ENTRIES} then 'too many entries' else 'ok' end"""
    kept = lambda a: f"if(o = 'ok', {last(a)}, null)"
    return F.expr(let("x", f"struct({head} as h, {meta} as m)", let("o", outcome, f"struct(o as outcome, {kept('x.h')} as headers, {kept('x.m')} as metadata)")))
