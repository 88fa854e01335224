"""Queries of administration. Imported by the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.operators import admin
from bucketscope.plans.registry import query
from bucketscope.sources.adapters import entity, sql

_KEY_REQUESTS = """SELECT event_id AS seq, occurred_at AS made_at, concat('u', CAST(user_id AS STRING)) AS access_key, CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'put' WHEN 2 THEN 'drop' WHEN 3 THEN 'delete' ELSE 'create' END AS op,
  CASE event_id % 3 WHEN 0 THEN ' ' ELSE concat('p', CAST(event_id AS STRING)) END AS policy FROM {log} UNION ALL SELECT -1, TIMESTAMP_NTZ '1992-01-01 00:00:00', 'u0', 'create', ''"""


@query(
    "access_keys_m20_l10",
    f"""{sql('request_log').rstrip()}, q AS ({_KEY_REQUESTS.format(log='request_log').replace('TIMESTAMP_NTZ', 'TIMESTAMP')}),
  e AS (SELECT *, coalesce(last_value(CASE WHEN op = 'create' THEN true WHEN op = 'delete' AND access_key <> 'u0' THEN false END IGNORE NULLS) OVER (PARTITION BY access_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM q),
  f AS (SELECT *, CASE op WHEN 'create' THEN NOT there WHEN 'delete' THEN access_key <> 'u0' WHEN 'put' THEN there AND trim(policy) <> '' ELSE there END AS done FROM e)
  SELECT access_key, arg_max(made_at, seq) FILTER (op = 'create') AS created_at, arg_max(CASE WHEN op = 'drop' THEN '' ELSE trim(policy) END, seq) <> '' AS has_policy FROM f WHERE done GROUP BY 1 HAVING arg_max(op, seq) <> 'delete'""",
)
def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys newest first, without their secrets."""
    requests = spark.sql(_KEY_REQUESTS, log=entity(spark, sf_dir, "request_log"))
    return admin.access_keys(requests, "u0").orderBy(F.desc("created_at"), "access_key")


_PROFILES = """SELECT event_id AS seq, concat('ec-', CAST(user_id % 12 AS STRING)) AS profile_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('{"data_shards": ', CAST(event_id % 8 + 1 AS STRING), ', "parity_shards": ', CAST(event_id % 3 + 1 AS STRING), ', "enabled": ', CASE WHEN event_id % 5 = 0 THEN 'false' ELSE 'true' END, '}') END AS doc FROM request_log"""
_PROFILES_SQL = f"""{sql('request_log').rstrip()}, l AS ({_PROFILES}), k AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq DESC) AS rn FROM l),
  p AS (SELECT profile_id, CAST(doc ->> '$.data_shards' AS INTEGER) AS data_shards, CAST(doc ->> '$.parity_shards' AS INTEGER) AS parity_shards, CAST(doc ->> '$.enabled' AS BOOLEAN) AS enabled FROM k WHERE rn = 1 AND doc IS NOT NULL),
  d AS (SELECT * FROM p UNION ALL SELECT 'default', 4, 2, true WHERE NOT EXISTS (SELECT 1 FROM p))"""


@query("coding_profiles_l16_s21", f"{_PROFILES_SQL} SELECT * FROM d")
def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.sql(_PROFILES.replace("FROM request_log", "FROM {log}").replace("'{\"", "'{{\"").replace("'}'", "'}}'"), log=entity(spark, sf_dir, "request_log"))
    return admin.coding_profiles(log, ("default", 4, 2))


@query("coding_profile_counts_a16", f"{_PROFILES_SQL} SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled FROM d")
def _profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))


_PATH = "CASE event_id % 5 WHEN 0 THEN '/API/console/auth/login' WHEN 1 THEN '/api/console/buckets' WHEN 2 THEN '/api/consoles' WHEN 3 THEN '/metrics' ELSE concat('/', bucket, '/k') END"
_FORWARDED = "CASE event_id % 3 WHEN 0 THEN concat(' 10.0.0.', CAST(user_id AS STRING), ' , 10.9.9.9') WHEN 1 THEN ' ' END"


@query(
    "rate_profiles_t04",
    f"""{sql('request_log')} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'console-login' WHEN 1 THEN 'console-api' WHEN 4 THEN 's3' END AS profile, CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 600 WHEN 4 THEN 1200 END AS permits,
  CASE WHEN event_id % 5 IN (0, 1, 4) THEN 60 END AS window_s, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || CAST(user_id AS STRING) WHEN event_id % 2 = 0 THEN '10.1.1.1' ELSE 'unknown' END AS client FROM request_log""",
)
def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity(spark, sf_dir, "request_log").select("event_id", F.expr(_PATH).alias("path"), F.expr(_FORWARDED).alias("forwarded"), F.expr("if(event_id % 2 = 0, '10.1.1.1', null)").alias("address"), F.expr("event_id % 5 = 4").alias("is_store"))
    return rows.select("event_id", admin.rate_profile("path", "is_store").alias("p"), admin.client("forwarded", "address").alias("client")).select("event_id", "p.*", "client")


_RUNS = """SELECT CASE object_no % 6 WHEN 0 THEN 'cluster' WHEN 1 THEN 'repair' WHEN 2 THEN 'rebalance' WHEN 3 THEN 'lifecycle' WHEN 4 THEN 'replication' ELSE 'custom' END AS category, concat('task-', CAST(object_no % 18 AS STRING)) AS task_id,
  CASE attempts WHEN 0 THEN 'Succeeded' WHEN 6 THEN 'Failed' ELSE 'Skipped' END AS status, queued_at AS completed_at, object_no AS run_no, concat('run ', lpad(CAST(object_no AS STRING), 600, '0')) AS result FROM {heal}"""
_RUNS_SQL = f"{sql('heal_queue').rstrip()}, r AS ({_RUNS.format(heal='heal_queue')})"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RUNS, heal=entity(spark, sf_dir, "heal_queue"))


@query(
    "task_groups_a24_l15",
    f"""{_RUNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY category, task_id ORDER BY completed_at DESC, status DESC, result DESC) AS rn FROM r)
  SELECT CAST(CASE category WHEN 'cluster' THEN 0 WHEN 'repair' THEN 1 WHEN 'rebalance' THEN 2 WHEN 'lifecycle' THEN 3 WHEN 'replication' THEN 4 ELSE 100 END AS INTEGER) AS group_order, category, task_id, count(*) FILTER (status = 'Succeeded') AS succeeded, count(*) FILTER (status = 'Failed') AS failed,
  max(completed_at) AS completed_at, any_value(status) FILTER (rn = 1) AS status, any_value(substr(result, 1, 512)) FILTER (rn = 1) AS result FROM n GROUP BY ALL""",
)
def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.tasks(_runs(spark, sf_dir))


@query("task_history_l13", f"{_RUNS_SQL} SELECT task_id, category, status, completed_at, run_no FROM r WHERE task_id = 'task-3' ORDER BY completed_at DESC, run_no DESC LIMIT 200")
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's newest runs, 200 at most: a page."""
    return _runs(spark, sf_dir).filter("task_id = 'task-3'").select("task_id", "category", "status", "completed_at", "run_no").orderBy(F.desc("completed_at"), F.desc("run_no")).limit(200)


@query(
    "health_counters_a09",
    f"""{sql('heal_queue', 'shards').rstrip()}, s AS (SELECT * FROM shards WHERE object_no % 37 <> 0), p AS (SELECT object_no, part_no, count(*) AS n, count(*) FILTER (status = 'available') AS ok FROM s GROUP BY ALL),
  o AS (SELECT object_no, sum(n) AS n, sum(ok) AS ok, min(ok) AS least FROM p GROUP BY 1), h AS (SELECT heal_queue.object_no, n, ok, least FROM heal_queue LEFT JOIN o USING (object_no))
  SELECT count(*) AS objects, count(*) FILTER (n IS NULL) AS without_manifest, count(*) FILTER (n IS NULL OR ok < n) AS missing_objects, count(*) FILTER (ok < n) AS degraded, count(*) FILTER (ok < n AND least >= 1) AS recoverable_degraded, count(*) FILTER (n IS NULL OR least < 1) AS unrecoverable,
  count(*) FILTER (n IS NULL OR least < 1) AS read_quorum_lost, count(*) FILTER (n IS NULL OR least < 2) AS write_quorum_lost, count(*) FILTER (n IS NULL OR least < 2) AS under_replicated, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, CAST(coalesce(sum(ok), 0) AS BIGINT) AS existing_files, CAST(coalesce(sum(n - ok), 0) AS BIGINT) AS missing_files FROM h""",
)
def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.health_counters(entity(spark, sf_dir, "heal_queue"), entity(spark, sf_dir, "shards").filter("object_no % 37 <> 0"), 1, 2)


_GAUGES = """SELECT taken_at, e % 4 AS nodes_offline, p % 3 AS disks_offline, e AS files_missing, greatest(0, e - 3) AS read_quorum_lost, p % 2 AS recoverable_degraded, n % 5 AS under_replicated, n % 3 AS repair_pending, greatest(0, e - 4) AS repair_exhausted, e % 2 AS task_failures,
  CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS write_risk, p AS capacity_available, n AS capacity_total, n % 4 AS low_watermark_disks, 2 AS min_fault_domains, p % 4 AS pools_below
  FROM (SELECT date_trunc('hour', occurred_at) AS taken_at, count(*) AS n, sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS e, sum(CASE WHEN method = 'PUT' THEN 1 ELSE 0 END) AS p FROM {log} GROUP BY 1)"""
_ISLANDS = " UNION ALL ".join(f"SELECT '{a}' AS alert, '{s}' AS severity, {m} AS minutes, taken_at, row_number() OVER (ORDER BY taken_at) - row_number() OVER (PARTITION BY {e} ORDER BY taken_at) AS island, {e} AS holds FROM g" for a, s, m, e in admin.ALERT_RULES)


@query("alert_rules_t09", f"{sql('request_log').rstrip()}, g AS ({_GAUGES.format(log='request_log')}), i AS ({_ISLANDS}), j AS (SELECT alert, severity, minutes, island, min(taken_at) AS since, max(taken_at) AS until FROM i WHERE holds GROUP BY ALL) SELECT alert, severity, since, until FROM j WHERE until >= since + to_minutes(minutes)")
def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen rules over hourly snapshots."""
    return admin.alerts(spark.sql(_GAUGES, log=entity(spark, sf_dir, "request_log")).withColumn("taken_at", F.col("taken_at").cast("timestamp_ntz")))


_CASE = "content_length % 7"


@query(
    "bucket_settings_p29",
    f"""{sql('object_versions')} SELECT version_id, CASE {_CASE} WHEN 1 THEN 'unsupported header' WHEN 2 THEN 'invalid header value' WHEN 3 THEN 'invalid date' WHEN 4 THEN 'invalid metadata name' WHEN 5 THEN 'invalid metadata value' WHEN 6 THEN 'too many entries' ELSE 'ok' END AS outcome,
  CASE WHEN {_CASE} = 0 THEN 'max-age=' || CAST(content_length AS VARCHAR) END AS cache_control, CASE WHEN {_CASE} = 0 THEN etag END AS owner, CASE WHEN {_CASE} = 0 THEN 1 END AS n FROM object_versions""",
)
def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case for each rule."""
    headers = f"case {_CASE} when 1 then map('Server', 'x') when 2 then map('expires', concat('a', char(10), 'b')) when 3 then map('Expires', 'soon') else map(' CACHE-control ', concat(' max-age=', content_length), 'Expires', if(content_length % 2 = 0, ' ', 'Tue, 06 May 2031 07:08:09 GMT')) end"
    metadata = f"case {_CASE} when 4 then map('a b', 'x') when 5 then map('a', repeat('x', 1025)) when 6 then map_from_arrays(transform(sequence(1, 21), i -> concat('k', i)), transform(sequence(1, 21), i -> 'v')) else map('X-Amz-Meta-Owner', concat(etag, ' '), 'none', ' ') end"
    rows = entity(spark, sf_dir, "object_versions").select("version_id", F.expr(headers).alias("h"), F.expr(metadata).alias("m")).select("version_id", admin.bucket_settings("h", "m").alias("s"))
    return rows.select("version_id", "s.outcome", F.col("s.headers").getItem("Cache-Control").alias("cache_control"), F.col("s.metadata").getItem("owner").alias("owner"), F.size("s.metadata").alias("n")).withColumn("n", F.when(F.col("outcome") == "ok", F.col("n")))
