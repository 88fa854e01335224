"""All queries by name, each with its SQL where SQL can express it. Names end in the survey's ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.functions import erasure, scalar
from bucketscope.operators import cluster, integrity, lifecycle, metrics, multipart, namespace, policy
from bucketscope.plans import registry
from bucketscope.plans.registry import query
from bucketscope.sources.adapters import entity, sql
from bucketscope.streaming import requests

START, END = "2023-12-31 00:00:00", "2024-02-01 00:00:00"
NOW = "1998-06-01 00:00:00"
SEED, COPIES, LEAST, PERCENT = "seed", 2, 50_000, 15


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_metrics(spark, sf_dir)


_HOURLY = """hb AS (SELECT date_trunc('hour', occurred_at) AS hour_utc, bucket, count(*) AS request_count, count(*) FILTER (is_error) AS error_count,
  CAST(sum(greatest(ingress_bytes, 0)) AS BIGINT) AS ingress_bytes, CAST(sum(greatest(egress_bytes, 0)) AS BIGINT) AS egress_bytes,
  count(*) FILTER (NOT is_list AND method = 'PUT') AS put_count, count(*) FILTER (NOT is_list AND method = 'GET') AS get_count,
  count(*) FILTER (NOT is_list AND method = 'DELETE') AS delete_count, count(*) FILTER (NOT is_list AND method = 'HEAD') AS head_count,
  count(*) FILTER (is_list) AS list_count, max(occurred_at) AS last_activity_at FROM request_log GROUP BY 1, 2)"""
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in metrics.COUNTS)
_PADDED = f"""{sql('request_log').rstrip()}, {_HOURLY}, p AS (SELECT g.h AS hour_utc, {_SUMS} FROM (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h) g LEFT JOIN hb ON hb.hour_utc = g.h GROUP BY 1)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "request_log")


@query("hourly_metrics_a03_a04_a05_a06_f14", f"{_PADDED} SELECT * FROM p")
def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.padded(metrics.hourly(metrics.hourly_by_bucket(metrics.between(_log(spark, sf_dir), START, END))), START, END)


@query("hourly_by_bucket_a03_t01", f"{sql('request_log').rstrip()}, {_HOURLY} SELECT * FROM hb")
def _hourly_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hourly_by_bucket(_log(spark, sf_dir))


@query("dashboard_totals_a22", f"{_PADDED} SELECT count(*) AS hours, count(*) FILTER (request_count = 0) AS empty_hours, {_SUMS} FROM p")
def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("hours"), F.count_if(F.col("request_count") == 0).alias("empty_hours"), *[F.sum(c).alias(c) for c in metrics.COUNTS])


_ACTIVITY = "act AS (SELECT bucket, CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(error_count) AS BIGINT) AS error_count, max(last_activity_at) AS last_activity_at FROM hb WHERE bucket <> '' GROUP BY 1 ORDER BY 4 DESC, 2 DESC, 1 LIMIT 5)"


@query("bucket_activity_a07_p06", f"{sql('request_log').rstrip()}, {_HOURLY}, {_ACTIVITY} SELECT * FROM act")
def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.activity(metrics.hourly_by_bucket(_log(spark, sf_dir)), 5)


@query(
    "bucket_summary_a08_p06",
    f"{sql('request_log')} SELECT count(*) AS request_count, count(*) FILTER (is_error) AS error_count, CAST(coalesce(sum(egress_bytes), 0) AS BIGINT) AS egress_bytes, max(occurred_at) AS last_activity_at FROM request_log WHERE bucket = 'b3' AND occurred_at >= TIMESTAMP '2024-01-10' AND occurred_at < TIMESTAMP '2024-01-12'",
)
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.between(_log(spark, sf_dir).filter("bucket = 'b3'"), "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    return rows.agg(F.count(F.lit(1)).alias("request_count"), F.count_if("is_error").alias("error_count"), F.coalesce(F.sum("egress_bytes"), F.lit(0)).alias("egress_bytes"), F.max("occurred_at").alias("last_activity_at"))


_LATEST = "lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY last_modified DESC, version_id DESC) AS r FROM object_versions) WHERE r = 1), cur AS (SELECT * EXCLUDE (r) FROM lat WHERE NOT is_delete_marker)"
_VERSIONS = f"{sql('object_versions').rstrip()}, {_LATEST}"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "object_versions")


@query("current_objects_w01_p02_u06", f"{_VERSIONS} SELECT * FROM cur")
def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.current(_versions(spark, sf_dir))


@query("storage_metrics_a01", f"{_VERSIONS} SELECT (SELECT count(DISTINCT bucket) FROM object_versions) AS buckets, count(*) AS objects, CAST(coalesce(sum(content_length), 0) AS BIGINT) AS total_bytes FROM cur")
def _storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets count whether they have current objects or not."""
    rows = _versions(spark, sf_dir)
    used = metrics.bucket_usage(rows.select("bucket").distinct(), namespace.current(rows))
    return used.agg(F.count(F.lit(1)).alias("buckets"), F.sum("object_count").alias("objects"), F.sum("total_bytes").alias("total_bytes"))


@query("bucket_usage_a02_j01_p04", f"{_VERSIONS}, b AS (SELECT DISTINCT bucket FROM object_versions UNION SELECT 'empty') SELECT b.bucket, count(cur.key) AS object_count, CAST(coalesce(sum(content_length), 0) AS BIGINT) AS total_bytes FROM b LEFT JOIN cur USING (bucket) GROUP BY 1")
def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _versions(spark, sf_dir)
    buckets = rows.select("bucket").distinct().union(spark.range(1).select(F.lit("empty")))
    return metrics.bucket_usage(buckets, namespace.current(rows))


@query(
    "recent_buckets_j02",
    f"{sql('request_log', 'object_versions').rstrip()}, {_HOURLY}, {_ACTIVITY}, {_LATEST}, u AS (SELECT bucket, count(*) AS object_count, CAST(sum(content_length) AS BIGINT) AS total_bytes FROM cur GROUP BY 1) SELECT act.bucket, request_count, coalesce(object_count, 0) AS object_count, coalesce(total_bytes, 0) AS total_bytes FROM act LEFT JOIN u USING (bucket)",
)
def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_usage(_activity(spark, sf_dir), metrics.usage(namespace.current(_versions(spark, sf_dir))))


_ENTRIES = "ent AS (SELECT bucket, CASE WHEN contains(rest, '/') THEN 'y=1996/' || split_part(rest, '/', 1) || '/' ELSE key END AS entry, contains(rest, '/') AS is_prefix, count(*) AS n_keys, CAST(sum(content_length) AS BIGINT) AS total_bytes FROM (SELECT *, substr(key, 8) AS rest FROM cur WHERE starts_with(key, 'y=1996/')) GROUP BY ALL)"


@query("list_objects_l01_l02_p01_p03", f"{_VERSIONS}, {_ENTRIES} SELECT * FROM ent")
def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.entries(namespace.current(_versions(spark, sf_dir)), "y=1996/", "/")


@query("list_objects_page_l01_l04_l05", f"{_VERSIONS}, {_ENTRIES}, pg AS (SELECT *, row_number() OVER (ORDER BY entry) AS rn, count(*) OVER () > 4 AS truncated FROM ent WHERE bucket = 'b2' AND entry > 'y=1996/m=03/') SELECT bucket, entry, is_prefix, n_keys, total_bytes, truncated FROM pg WHERE rn <= 4")
def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.page(_entries(spark, sf_dir).filter("bucket = 'b2'"), "y=1996/m=03/", 4)


@query("versions_is_latest_j06", f"{_VERSIONS} SELECT v.*, v.version_id = lat.version_id AS is_latest FROM object_versions v JOIN lat USING (bucket, key)")
def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.with_latest_flag(_versions(spark, sf_dir))


@query("version_rank_w02", f"{sql('object_versions')} SELECT *, CAST(row_number() OVER (PARTITION BY bucket, key ORDER BY last_modified DESC, version_id) AS INTEGER) AS rn FROM object_versions")
def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.version_rank(_versions(spark, sf_dir))


@query("noncurrent_versions_j07_u03", f"{_VERSIONS} SELECT v.* FROM object_versions v ANTI JOIN cur USING (bucket, key, version_id)")
def _noncurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.noncurrent(_versions(spark, sf_dir))


_STATE = "st AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM mutations) WHERE r = 1 AND NOT deleted)"


@query("log_replay_s05", f"{sql('mutations').rstrip()}, {_STATE} SELECT * FROM st")
def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.replayed(entity(spark, sf_dir, "mutations"), "seq")


@query("prefix_scan_s07", f"{sql('mutations').rstrip()}, {_STATE} SELECT * FROM st WHERE starts_with(key, 'k:000') AND key > 'k:00020' ORDER BY key LIMIT 20")
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.scanned(_replay(spark, sf_dir), "k:000", "k:00020", 20)


@query("point_lookup_s06", f"{sql('mutations').rstrip()}, {_STATE} SELECT * FROM st WHERE key = 'k:00042'")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir).filter("key = 'k:00042'")


@query("store_stats_s10", f"{sql('mutations').rstrip()}, {_STATE} SELECT (SELECT count(*) FROM st) AS key_count, (SELECT CAST(sum(strlen(key) + strlen(value) + 12) AS BIGINT) FROM mutations) AS log_bytes")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = entity(spark, sf_dir, "mutations")
    size = log.agg(F.sum(F.octet_length("key") + F.octet_length("value") + 12).cast("long").alias("log_bytes"))
    return namespace.replayed(log, "seq").agg(F.count(F.lit(1)).alias("key_count")).join(size)


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {n}, '{p}', {'NULL' if c is None else c}, {'NULL' if o is None else o}, {e})" for b, n, p, c, o, e in lifecycle.RULES) + ") t(bucket, rule_no, prefix, current_days, other_days, enabled))"
_NON = "non AS (SELECT v.* FROM object_versions v ANTI JOIN cur USING (bucket, key, version_id))"
_DUE = lambda rows, days, action: f"SELECT x.bucket, rule_no, '{action}' AS action, key, version_id FROM {rows} x JOIN rules USING (bucket) WHERE enabled AND {days} IS NOT NULL AND starts_with(key, prefix) AND last_modified <= TIMESTAMP '{NOW}' - to_days(CAST({days} AS INTEGER))"


@query("lifecycle_expire_m12_j14_p07", f"{_VERSIONS}, {_RULES} {_DUE('cur', 'current_days', 'expire')}")
def _expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.expired(_versions(spark, sf_dir), lifecycle.rules(spark), NOW)


@query("lifecycle_noncurrent_m13", f"{_VERSIONS}, {_RULES}, {_NON} {_DUE('non', 'other_days', 'noncurrent')}")
def _expire_noncurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.expired_noncurrent(_versions(spark, sf_dir), lifecycle.rules(spark), NOW)


@query("lifecycle_batch_w09", f"{_VERSIONS}, {_RULES}, {_NON} SELECT * FROM ({_DUE('cur', 'current_days', 'expire')} UNION ALL {_DUE('non', 'other_days', 'noncurrent')}) ORDER BY bucket, rule_no, action, key, version_id LIMIT 200")
def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.plan(_versions(spark, sf_dir), lifecycle.rules(spark), NOW, 200)


_ON = "disk_status = 'Online' AND node_status = 'Online'"
_CAP = lambda keys: f"SELECT {keys}CAST(sum(t) AS BIGINT) AS total_bytes, CAST(sum(a) AS BIGINT) AS available_bytes FROM (SELECT {keys}node_id, coalesce('g' || CAST(capacity_group AS VARCHAR), 'd' || CAST(disk_id AS VARCHAR)) AS own, min(total_bytes) AS t, min(available_bytes) AS a FROM disks WHERE {_ON} GROUP BY ALL)"


def _disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "disks")


@query("cluster_summary_a10_a26", f"{sql('disks')} SELECT *, greatest(0, total_bytes - available_bytes) AS used_bytes FROM (SELECT count(DISTINCT node_id) AS nodes, count(DISTINCT node_id) FILTER (node_status = 'Online') AS nodes_online, count(*) AS disks, count(*) FILTER ({_ON}) AS disks_online FROM disks), ({_CAP('')})")
def _cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.summary(_disks(spark, sf_dir))


@query("capacity_dedup_a11", f"{sql('disks')} {_CAP('pool_id, ')} GROUP BY pool_id")
def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.distinct_capacity(_disks(spark, sf_dir).filter(cluster.ONLINE), "pool_id")


@query("pool_rollup_a12_j03", f"{sql('disks').rstrip()}, c AS ({_CAP('pool_id, ')} GROUP BY pool_id), n AS (SELECT pool_id, count(DISTINCT node_id) AS nodes, count(*) AS disks FROM disks GROUP BY 1) SELECT * FROM n LEFT JOIN c USING (pool_id)")
def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.pools(_disks(spark, sf_dir))


_W = f"available_bytes - greatest({LEAST}, CAST(ceil(total_bytes * {PERCENT} / 100.0) AS BIGINT)) > 0"


@query("capacity_admission_a14_p24", f"{sql('disks').rstrip()}, w AS (SELECT pool_id, {_W} AS w, available_bytes FROM disks WHERE {_ON}), p AS (SELECT pool_id, bool_or(w) AS w FROM w GROUP BY 1) SELECT (SELECT count(*) FROM w WHERE w) AS writable_disks, (SELECT count(*) FROM w WHERE NOT w) AS low_disks, (SELECT count(*) FROM p WHERE w) AS writable_pools, (SELECT count(*) FROM p WHERE NOT w) AS low_pools, (SELECT max(available_bytes) FROM w WHERE w) AS largest_writable")
def _admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.admission(_disks(spark, sf_dir), LEAST, PERCENT)


@query("placement_policy_a15_f33", f"{sql('disks')} SELECT pool_id, count(DISTINCT fault_domain) AS domains, count(DISTINCT fault_domain) >= 3 AS meets FROM disks WHERE {_ON} AND {_W} GROUP BY 1")
def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.fault_domains(_disks(spark, sf_dir), LEAST, PERCENT, 3)


#: Bytes and percent that must stay free after a write.
ROOM = f"available_bytes - content_length >= greatest({LEAST}, CAST(ceil(total_bytes * {PERCENT} / 100.0) AS BIGINT)) AND available_bytes >= content_length"
CANDIDATES = f"""c AS (SELECT bucket, key, version_id, disk_id, node_id, pool_id, coalesce(nullif(trim(fault_domain), ''), node_id) AS fault_domain FROM object_versions, disks WHERE {_ON} AND {ROOM}),
  e AS (SELECT bucket, key, version_id, pool_id FROM c GROUP BY ALL HAVING count(*) >= {COPIES} AND count(DISTINCT fault_domain) >= 2),
  w AS (SELECT version_id, arg_min(pool_id, substr(sha256(concat('{SEED}|', bucket, '|', key, '|', version_id, '|', pool_id, '|pool')), 1, 16)) AS pool_id FROM e GROUP BY 1)"""
PLACED = f"""{CANDIDATES},
  s AS (SELECT c.*, substr(sha256(concat('{SEED}|', bucket, '|', key, '|', version_id, '||', fault_domain, '|', node_id, '|', CAST(disk_id AS VARCHAR))), 1, 16) AS score FROM c JOIN w USING (version_id, pool_id)),
  t AS (SELECT *, row_number() OVER (PARTITION BY version_id, fault_domain ORDER BY score, node_id, disk_id) AS d, row_number() OVER (PARTITION BY version_id, node_id ORDER BY score, node_id, disk_id) AS n FROM s),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY version_id ORDER BY CASE WHEN d = 1 THEN 0 WHEN n = 1 THEN 1 ELSE 2 END, score, node_id, disk_id) AS INTEGER) AS replica FROM t)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.placed(_versions(spark, sf_dir), _disks(spark, sf_dir), SEED, COPIES, 2, LEAST, PERCENT)


@query(
    "placement_w04_w06_j15_p25",
    f"""{sql('object_versions', 'disks').rstrip()}, {PLACED}
  SELECT o.bucket, o.key, o.version_id, r.replica, r.pool_id, r.disk_id, r.node_id, r.fault_domain, r.score
  FROM object_versions o LEFT JOIN (SELECT * FROM r WHERE replica <= {COPIES}) r USING (version_id)""",
)
def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object of every bucket; those that no pool has room for come without a replica."""
    return placed(spark, sf_dir)


_FLAGS = "pt AS (SELECT object_no, part_no, count(*) AS shards, count(*) FILTER (status = 'available') AS ok FROM shards GROUP BY ALL), fl AS (SELECT object_no, count(*) AS parts, bool_or(ok < 1) AS unrecoverable, bool_or(ok < 2) AS under_replicated, bool_or(ok < shards) AS degraded FROM pt GROUP BY 1)"


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "shards")


@query("object_health_flags_a09", f"{sql('shards').rstrip()}, {_FLAGS} SELECT * FROM fl")
def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.object_health(_shards(spark, sf_dir), 1, 2)


@query("object_health_a09", f"{sql('shards').rstrip()}, {_FLAGS} SELECT count(*) AS objects, count(*) FILTER (degraded) AS degraded, count(*) FILTER (unrecoverable) AS unrecoverable, count(*) FILTER (under_replicated) AS under_replicated, count(*) FILTER (degraded AND NOT unrecoverable) AS recoverable_degraded FROM fl")
def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.health(_shards(spark, sf_dir), 1, 2)


@query("scrub_a18", f"{sql('shards')} SELECT count(*) FILTER (status <> 'missing') AS checked, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'corrupt') AS corrupt, count(*) FILTER (status <> 'available') AS queued FROM shards")
def _scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.scrub(_shards(spark, sf_dir))


@query("consistency_a17", f"{sql('shards').rstrip()}, g AS (SELECT object_no, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'available') AS ok FROM shards GROUP BY 1), h AS (SELECT object_no, CASE WHEN ok = 0 THEN 'ManifestMissing' WHEN missing > 0 THEN 'ShardMissing' WHEN ok < 2 THEN 'UnderReplicated' END AS reason, missing, ok FROM g) SELECT * FROM h WHERE reason IS NOT NULL")
def _consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.consistency(_shards(spark, sf_dir), 2)


@query("shard_disk_join_j11_j18", f"{sql('shards', 'disks')} SELECT node_id, disk_status, count(*) AS shards, CAST(sum(size) AS BIGINT) AS total_bytes FROM shards JOIN disks USING (disk_id) GROUP BY ALL")
def _by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir).join(_disks(spark, sf_dir), "disk_id").groupBy("node_id", "disk_status").agg(F.count(F.lit(1)).alias("shards"), F.sum("size").alias("total_bytes"))


_QS = integrity.queue_status(5)


def _heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "heal_queue")


@query("repair_queue_a13", f"{sql('heal_queue')} SELECT reason, count(*) AS total, count(*) FILTER (s <> 'Failed') AS pending, count(*) FILTER (s = 'Failed') AS failed, count(*) FILTER (attempts > 0 AND s <> 'Failed') AS retryable, count(*) FILTER (attempts >= 5) AS at_most_attempts, min(queued_at) FILTER (s <> 'Failed') AS oldest_queued_at FROM (SELECT *, {_QS} AS s FROM heal_queue) GROUP BY 1")
def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.queue(_heal(spark, sf_dir), 5)


@query("repair_priority_w08", f"{sql('heal_queue')} SELECT object_no, s AS state, CASE s WHEN 'Failed' THEN 3 WHEN 'RetryScheduled' THEN 2 ELSE 1 END AS prio, attempts FROM (SELECT *, {_QS} AS s FROM heal_queue) ORDER BY prio DESC, coalesce(TIMESTAMP '1998-01-01' + to_days(next_day), queued_at), queued_at, object_no LIMIT 25")
def _priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.priority(_heal(spark, sf_dir), 5)


@query("retry_backoff_f16_t07", f"{sql('heal_queue')} SELECT object_no, attempts, CAST({integrity.backoff()} AS INTEGER) AS wait_s FROM heal_queue WHERE attempts > 0 AND coalesce(next_day, 0) <= 30")
def _backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heal(spark, sf_dir).filter("attempts > 0 and coalesce(next_day, 0) <= 30").select("object_no", "attempts", F.expr(integrity.backoff()).cast("int").alias("wait_s"))


@query(
    "garbage_j10_a19_p08_u02",
    f"{sql('shards').rstrip()}, r AS (SELECT DISTINCT path FROM shards WHERE object_no % 5 <> 0), f AS (SELECT CASE WHEN object_no % 50 = 0 THEN path || '.tmp' WHEN object_no % 20 = 5 THEN replace(path, 'objects/', 'objects/multipart-') ELSE path END AS path, size, modified_at FROM shards), "
    "g AS (SELECT *, starts_with(path, '.sys/tmp/') OR ends_with(path, '.tmp') AS temp FROM f WHERE modified_at < TIMESTAMP '1997-01-01') SELECT path, size, CASE WHEN temp THEN 'temp' WHEN contains(path, '/multipart-') THEN 'multipart' ELSE 'replica' END AS kind FROM g WHERE temp OR path NOT IN (SELECT path FROM r)",
)
def _garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shards(spark, sf_dir)
    path = F.expr("case when object_no % 50 = 0 then concat(path, '.tmp') when object_no % 20 = 5 then replace(path, 'objects/', 'objects/multipart-') else path end")
    files = rows.select(path.alias("path"), "size", "modified_at")
    return integrity.garbage(files, rows.filter("object_no % 5 <> 0"), "1997-01-01 00:00:00")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "parts")


_SLICES = "sl AS (SELECT key, part_no, substr(text, CAST((part_no - 1) * 1000 + 1 AS BIGINT), 1000) AS body FROM (SELECT key, text, unnest(generate_series(1, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS part_no FROM parts))"


@query("multipart_etag_a20_f17", f"{sql('parts').rstrip()}, {_SLICES} SELECT key, md5(unhex(string_agg(md5(body), '' ORDER BY part_no))) || '-' || CAST(count(*) AS STRING) AS etag, CAST(sum(length(body)) AS BIGINT) AS content_length FROM sl GROUP BY key")
def _etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multipart.etag(multipart.sliced(_parts(spark, sf_dir), 1000))


@query("part_offsets_w12_s17", f"{sql('parts').rstrip()}, {_SLICES} SELECT key, CAST(part_no AS INTEGER) AS part_no, CAST(length(body) AS BIGINT) AS size, CAST(coalesce(sum(length(body)) OVER (PARTITION BY key ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM sl")
def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multipart.offsets(multipart.sliced(_parts(spark, sf_dir), 1000))


@query("part_checks_w10_w11", f"{sql('shards').rstrip()}, p AS (SELECT object_no AS key, set_index AS pos, CASE WHEN object_no % 17 = 0 THEN 8 - set_index ELSE set_index END AS part_no, size FROM shards), q AS (SELECT *, coalesce(part_no > lag(part_no) OVER w, true) AS ok, row_number() OVER w = count(*) OVER (PARTITION BY key) AS last FROM p WINDOW w AS (PARTITION BY key ORDER BY pos, part_no, size)) SELECT key, bool_and(ok) AS in_order, bool_and(last OR size >= 5) AS large_enough, count(*) AS parts FROM q GROUP BY key")
def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shards(spark, sf_dir).select(F.col("object_no").alias("key"), F.col("set_index").alias("pos"), F.expr("case when object_no % 17 = 0 then 8 - set_index else set_index end").alias("part_no"), "size")
    return multipart.checked(rows, 5)


@query("multipart_split_x02", f"{sql('parts').rstrip()}, n AS (SELECT key, size, unnest(generate_series(1, greatest(1, CAST(ceil(size / 4096.0) AS BIGINT)))) AS n FROM parts) SELECT key, CAST(n AS INTEGER) AS part_no, CAST((n - 1) * 4096 AS BIGINT) AS \"offset\", CAST(least(4096, size - (n - 1) * 4096) AS BIGINT) AS length FROM n")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multipart.split(_parts(spark, sf_dir), 4096)


@query("object_checksums_s16_f17_f19", f"{sql('parts')} SELECT doc_id, key, md5(text) AS etag, sha256(text) AS sha256, substr(sha256(key), 1, 8) AS key_hash, CAST(strlen(text) AS BIGINT) AS content_length FROM parts")
def _checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("doc_id", "key", F.md5("text").alias("etag"), F.sha2("text", 256).alias("sha256"), F.left(F.sha2("key", 256), F.lit(8)).alias("key_hash"), F.octet_length("text").cast("long").alias("content_length"))


@query("audit_tail_l11", f"{sql('audit_log')} SELECT * FROM audit_log ORDER BY id DESC LIMIT 100")
def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "audit_log").orderBy(F.desc("id")).limit(100)


_RANGES = "CASE doc_id % 5 WHEN 0 THEN 'bytes=0-99' WHEN 1 THEN 'bytes=100-' WHEN 2 THEN 'bytes=-50' WHEN 3 THEN 'bytes=900-100' ELSE concat('bytes=', CAST(doc_id AS STRING), '-', CAST(doc_id + 500 AS STRING)) END"


@query(
    "range_parse_p17",
    f"{sql('parts').rstrip()}, h AS (SELECT doc_id, size, {_RANGES} AS header FROM parts), x AS (SELECT *, TRY_CAST(regexp_extract(header, '^bytes=([0-9]*)-([0-9]*)$', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(header, '^bytes=([0-9]*)-([0-9]*)$', 2) AS BIGINT) AS b FROM h), y AS (SELECT *, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN greatest(0, size - b) END AS f, CASE WHEN a IS NULL OR b IS NULL THEN size - 1 ELSE least(b, size - 1) END AS l FROM x) SELECT doc_id, size, header, CASE WHEN f <= l AND f < size THEN f END AS first_byte, CASE WHEN f <= l AND f < size THEN l END AS last_byte FROM y",
)
def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.byte_range(_parts(spark, sf_dir).select("doc_id", "size", F.expr(_RANGES).alias("header")), "header", "size")


@query("url_address_p21", f"{sql('urls').rstrip()}, p AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS p FROM urls) SELECT page_id, url, host, split_part(p, '/', 1) AS bucket, CASE WHEN instr(p, '/') > 0 THEN substr(p, instr(p, '/') + 1) ELSE '' END AS key FROM p")
def _address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.address(entity(spark, sf_dir, "urls"))




@query("bucket_names_p16", f"{sql('parts').rstrip()}, n AS (SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN concat('10.0.0.', CAST(doc_id AS STRING)) WHEN 0 THEN replace(key, '/', '-') WHEN 1 THEN upper(key) WHEN 2 THEN replace(key, '/', '..') WHEN 4 THEN substr(key, 1, 2) ELSE concat('-', key) END AS name FROM parts) SELECT doc_id, name, regexp_matches(name, '^[a-z0-9][a-z0-9.-]{{1,61}}[a-z0-9]$') AND NOT regexp_matches(name, '[.][.]|[.]-|-[.]') AND NOT regexp_matches(name, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS valid FROM n")
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("case doc_id % 6 when 3 then concat('10.0.0.', cast(doc_id as string)) when 0 then replace(key, '/', '-') when 1 then upper(key) when 2 then replace(key, '/', '..') when 4 then substr(key, 1, 2) else concat('-', key) end")
    return _parts(spark, sf_dir).select("doc_id", name.alias("name")).withColumn("valid", policy.valid_bucket("name"))


#: bucket, policy. Scalars and arrays, one statement and several, principals by name, an unreadable policy.
POLICIES = [
    ("b1", '{"Statement": [{"Effect": "Allow", "Principal": "*", "Action": ["s3:Get*", "s3:ListBucket"], "Resource": "arn:aws:s3:::b1/*"}]}'),
    ("b2", '{"Statement": [{"Effect": "allow", "Principal": {"AWS": ["u1", "u2"]}, "Action": "s3:*", "Resource": ["b2/*"]}, {"Effect": "Deny", "Principal": "*", "Action": "s3:DeleteObject", "Resource": "*"}]}'),
    ("b3", '{"Statement": {"Effect": "Deny", "Principal": {"AWS": "u103"}, "Action": "s3:GetObject", "Resource": "*"}}'),
    ("b4", '{"Statement": ['),
    ("b5", '{"Statement": [{"Effect": "Allow", "Action": "s3:*", "Resource": "*"}]}'),
    ("b6", '{"Statement": [{"Effect": "Maybe", "Principal": "*", "Action": "s3:*", "Resource": "*"}, {"Effect": "Allow", "Principal": "*", "Action": ["s3:Put*", 7], "Resource": ["arn:aws:s3:::b6/k1*"]}]}'),
    ("b7", " "),
]
#: access key, its policy.
KEY_POLICIES = [(f"u{i}", '{"Statement": [{"Effect": "Allow", "Action": ["s3:Get*", "s3:Put*"], "Resource": "*"}]}') for i in range(0, 200, 3)]
_ACTION = "concat('s3:', CASE method WHEN 'GET' THEN 'GetObject' WHEN 'PUT' THEN 'PutObject' WHEN 'HEAD' THEN 'HeadObject' ELSE 'DeleteObject' END)"
_ASKED = f"""SELECT event_id, nullif(bucket, '') AS bucket, CASE WHEN is_list THEN NULL ELSE concat('k', CAST(event_id % 30 AS STRING)) END AS key, CASE WHEN is_list THEN 's3:ListBucket' ELSE {_ACTION} END AS action,
  concat('u', CAST(user_id AS STRING)) AS access_key, event_id % 5 <> 0 AS signed, event_id % 11 <> 0 AS valid, method = 'PUT' AS needs_key FROM request_log"""


def _values(rows: list[tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ")"


_LIST = lambda j: f"CASE json_type({j}) WHEN 'VARCHAR' THEN [{j} ->> '$'] WHEN 'ARRAY' THEN list_transform(list_filter(CAST({j} AS JSON[]), lambda e: json_type(e) = 'VARCHAR'), lambda e: e ->> '$') ELSE [] END"
_LIKE = lambda v, p: f"{v} LIKE replace(replace(replace(replace({p}, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%') ESCAPE '!'"


def _decided(name: str, source: str, by: str, key_mode: bool) -> str:
    """CTEs of the decisions of each request by the policies of one kind."""
    return f"""{name}_st AS (SELECT k, x ->> '$.Effect' AS effect, {_LIST("x -> '$.Action'")} AS actions, {_LIST("x -> '$.Resource'")} AS resources,
    CASE json_type(x, '$.Principal') WHEN 'VARCHAR' THEN [x ->> '$.Principal'] WHEN 'OBJECT' THEN {_LIST("x -> '$.Principal.AWS'")} ELSE [] END AS who, json_type(x, '$.Principal') IS NULL AS open
    FROM (SELECT k, unnest(CASE json_type(j, '$.Statement') WHEN 'ARRAY' THEN CAST(json_extract(j, '$.Statement') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(j, '$.Statement')] ELSE [] END) AS x
          FROM (SELECT k, CAST(CASE WHEN json_valid(policy) THEN policy ELSE '{{}}' END AS JSON) AS j FROM {source}))),
  {name}_bad AS (SELECT k FROM {source} WHERE trim(policy) <> '' AND NOT json_valid(policy)),
  {name} AS (SELECT event_id, bool_or(lower(effect) = 'deny') AS deny, bool_or(lower(effect) = 'allow') AS allow FROM asked JOIN {name}_st ON k = {by}
    WHERE len(list_filter(actions, lambda a: {_LIKE('action', 'a')})) > 0 AND (list_contains(who, '*') OR list_contains(who, principal) OR ({key_mode} AND open))
      AND len(list_filter(resources, lambda r: len(list_filter(cands, lambda c: {_LIKE('c', 'r')})) > 0)) > 0 GROUP BY 1)"""


def _asked_sql(principal: str) -> str:
    return f"""asked AS (SELECT *, {principal} AS principal, CASE WHEN bucket IS NULL THEN ['arn:aws:s3:::*', '*'] WHEN key IS NULL THEN ['arn:aws:s3:::' || bucket, bucket] ELSE ['arn:aws:s3:::' || bucket || '/' || key, bucket || '/' || key] END AS cands FROM ({_ASKED})),
  bp AS (SELECT * FROM {_values(POLICIES)} t(k, policy)), kp AS (SELECT * FROM {_values(KEY_POLICIES)} t(k, policy)), {_decided('bd', 'bp', 'bucket', False)}"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ASKED.replace("FROM request_log", "FROM {log}"), log=_log(spark, sf_dir))


@query(
    "policy_decisions_p10_p11_p12_p13_p14",
    f"""{sql('request_log').rstrip()}, {_asked_sql('access_key')}
  SELECT a.event_id, a.bucket, a.key, a.action, a.principal, CASE WHEN a.bucket IN (SELECT k FROM bd_bad) OR deny THEN 'Deny' WHEN allow THEN 'Allow' ELSE 'Neutral' END AS decision
  FROM asked a LEFT JOIN bd USING (event_id)""",
)
def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).select("event_id", "bucket", "key", "action", F.col("access_key").alias("principal"))
    return policy.decide(asked, spark.createDataFrame(POLICIES, "bucket string, policy_json string"))


@query(
    "authorization_p15",
    f"""{sql('request_log').rstrip()}, {_asked_sql("CASE WHEN signed AND valid THEN access_key END")}, {_decided('kd', 'kp', 'principal', True)}
  SELECT event_id, CASE WHEN signed AND NOT valid THEN 'bad signature' WHEN kp.k IS NOT NULL AND (coalesce(kd.deny, false) OR NOT coalesce(kd.allow, false)) THEN 'denied by key policy'
    WHEN bucket IS NULL THEN CASE WHEN signed AND valid THEN 'ok' ELSE 'key required' END WHEN bucket IN (SELECT k FROM bd_bad) OR coalesce(bd.deny, false) THEN 'denied by bucket policy'
    WHEN NOT (signed AND valid) AND (needs_key OR NOT coalesce(bd.allow, false)) THEN 'key required' ELSE 'ok' END AS outcome
  FROM asked LEFT JOIN bd USING (event_id) LEFT JOIN kd USING (event_id) LEFT JOIN kp ON kp.k = principal""",
)
def _authorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, keys = spark.createDataFrame(POLICIES, "bucket string, policy_json string"), spark.createDataFrame(KEY_POLICIES, "access_key string, key_policy string")
    return policy.authorize(_asked(spark, sf_dir), policies, keys).select("event_id", "outcome")


@query("scalar_text_f01_f02_f05_f06_f08", f"{sql('object_versions')} SELECT version_id, lower(trim(concat(' \"', upper(etag), '\" '), ' \"')) AS etag, lower(hex(encode(key))) AS key_hex, lpad(CAST(content_length AS STRING), 12, '0') AS padded, coalesce(nullif(regexp_extract(key, '([^/]+)/*$', 1), ''), key) AS file_name FROM object_versions")
def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _versions(spark, sf_dir).withColumn("quoted", F.expr("concat(' \"', upper(etag), '\" ')"))
    return rows.select("version_id", scalar.etag("quoted").alias("etag"), scalar.hexed("key").alias("key_hex"), F.lpad(F.col("content_length").cast("string"), 12, "0").alias("padded"), scalar.file_name("key").alias("file_name"))


@query("dates_f10_f11_f12_f13", f"{sql('request_log')} SELECT event_id, date_trunc('hour', occurred_at) AS hour_utc, lpad(CAST(epoch_us(occurred_at) * 10 + 621355968000000000 AS STRING), 20, '0') AS ticks, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') AS iso, occurred_at - INTERVAL 24 HOUR AS day_before FROM request_log")
def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("event_id", F.date_trunc("hour", "occurred_at").cast("timestamp_ntz").alias("hour_utc"), scalar.ticks("occurred_at").alias("ticks"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.expr("occurred_at - interval 24 hours").alias("day_before"))


@query("upload_concurrency_t05", f"{sql('request_log').rstrip()}, u AS (SELECT event_id, occurred_at AS s, occurred_at + INTERVAL 600 SECOND AS e, bucket FROM request_log WHERE method = 'PUT'), d AS (SELECT bucket, s AS t, 1 AS n, event_id FROM u UNION ALL SELECT bucket, e, -1, event_id FROM u), c AS (SELECT bucket, sum(n) OVER (PARTITION BY bucket ORDER BY t, n, event_id ROWS UNBOUNDED PRECEDING) AS now FROM d) SELECT bucket, CAST(max(now) AS BIGINT) AS peak FROM c GROUP BY 1")
def _concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.peak_overlap(_log(spark, sf_dir).filter("method = 'PUT'"), 600)


@query("method_routing_t04", f"{sql('request_log')} SELECT CASE WHEN bucket = '' THEN 'console' ELSE 's3' END AS profile, is_list, method, count(*) AS requests FROM request_log GROUP BY ALL")
def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy(F.expr("case when bucket = '' then 'console' else 's3' end").alias("profile"), "is_list", "method").agg(F.count(F.lit(1)).alias("requests"))


@query("rate_limit_t02_t03")
def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.limited(_log(spark, sf_dir), 3, 24 * 3600.0)


@query("erasure_round_trip_f22_f23_f24")
def _erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded into 4 + 2 shards, two of them lost, decoded again."""
    lost = F.expr("array(doc_id % 6, (doc_id + 1) % 6)")
    return erasure.round_trips(_parts(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"), lost.alias("lost")), 4, 2)


@query("erasure_quorum_f26_p30", "SELECT CAST(k AS INTEGER) AS data_shards, CAST(m AS INTEGER) AS parity_shards, CAST(CASE WHEN k = m THEN k + 1 ELSE k END AS INTEGER) AS write_quorum, k <= 32 AND m <= 16 AND k + m <= 48 AS valid FROM range(1, 41) a(k), range(0, 21) b(m)")
def _quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 41).select(F.col("id").cast("int").alias("data_shards"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("parity_shards"))
    return rows.withColumn("write_quorum", F.expr("case when data_shards = parity_shards then data_shards + 1 else data_shards end")).withColumn("valid", F.expr("data_shards <= 32 and parity_shards <= 16 and data_shards + parity_shards <= 48"))


@query("request_signature_f18")
def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).withColumn("day", F.date_format("occurred_at", "yyyyMMdd"))
    return rows.select("event_id", erasure.signature(F.concat(F.lit("key-"), F.col("user_id").cast("string")), F.col("day"), F.lit("local"), F.concat_ws("\n", "method", "bucket")).alias("signature"))


from bucketscope.plans import admin, more, records, store  # noqa: E402, F401  (they register their queries)
