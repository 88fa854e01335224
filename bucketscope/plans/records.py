"""Queries over single records and roll-ups of maintenance runs. Imported by the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.operators import integrity, namespace, records
from bucketscope.plans import catalog
from bucketscope.plans.registry import query
from bucketscope.sources.adapters import entity, sql

_HEX = lambda x: f"lower(hex(encode({x})))"


@query("store_keys_s11_f05", f"{sql('object_versions')} SELECT 'v:' || {_HEX('bucket')} || ':' || {_HEX('key')} || ':' || {_HEX('version_id')} AS store_key, bucket, key, version_id FROM object_versions")
def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys made, and their parts read back from the keys alone."""
    rows = entity(spark, sf_dir, "object_versions").select(records.store_key("v", "bucket", "key", "version_id").alias("store_key"))
    return rows.select("store_key", *[records.key_part("store_key", i).alias(c) for i, c in enumerate(("bucket", "key", "version_id"), 1)])


_ASKS = "SELECT bucket, key, CASE content_length % 4 WHEN 0 THEN version_id WHEN 1 THEN 'none' WHEN 2 THEN ' ' END AS asked, version_id AS request_id FROM {rows}"


@query(
    "object_lookup_p05",
    f"""{catalog._VERSIONS}, q AS ({_ASKS.format(rows='object_versions')})
  SELECT q.*, coalesce(v.etag, cur.etag) AS etag, CASE WHEN v.etag IS NULL AND cur.etag IS NULL THEN CASE WHEN coalesce(trim(asked), '') = '' THEN 'NoSuchKey' ELSE 'NoSuchVersion' END ELSE 'ok' END AS outcome
  FROM q LEFT JOIN object_versions v ON v.bucket = q.bucket AND v.key = q.key AND v.version_id = q.asked AND NOT v.is_delete_marker
  LEFT JOIN cur ON cur.bucket = q.bucket AND cur.key = q.key AND coalesce(trim(asked), '') = ''""",
)
def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity(spark, sf_dir, "object_versions")
    return records.found(spark.sql(_ASKS, rows=rows), rows, namespace.current(rows))


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with versions, and an empty one."""
    return entity(spark, sf_dir, "object_versions").select("bucket").distinct().union(spark.range(1).select(F.lit("empty")))


@query("create_bucket_m01", f"{sql('object_versions').rstrip()}, b AS (SELECT DISTINCT bucket FROM object_versions UNION SELECT 'empty'), r AS (SELECT i AS seq, 'b' || CAST(i % 12 AS VARCHAR) AS bucket FROM range(24) t(i)) SELECT seq, bucket, CASE WHEN seq < 12 AND bucket NOT IN (SELECT bucket FROM b) THEN 'created' ELSE 'BucketAlreadyExists' END AS outcome FROM r")
def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.range(24).select(F.col("id").alias("seq"), F.expr("concat('b', id % 12)").alias("bucket"))
    return records.created(asked, _buckets(spark, sf_dir))


@query("delete_bucket_m02", f"{sql('object_versions').rstrip()}, b AS (SELECT DISTINCT bucket FROM object_versions), r AS (SELECT 'b' || CAST(i AS VARCHAR) AS bucket FROM range(12) t(i) UNION ALL SELECT 'empty') SELECT bucket, CASE WHEN bucket = 'empty' THEN 'deleted' WHEN bucket IN (SELECT bucket FROM b) THEN 'BucketNotEmpty' ELSE 'NoSuchBucket' END AS outcome FROM r")
def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.range(12).select(F.expr("concat('b', id)").alias("bucket")).union(spark.range(1).select(F.lit("empty")))
    return records.deleted(asked, _buckets(spark, sf_dir), entity(spark, sf_dir, "object_versions"), entity(spark, sf_dir, "uploads"))


@query("list_buckets_l09", f"{sql('object_versions')} SELECT bucket, min(last_modified) AS created_at FROM object_versions GROUP BY 1 ORDER BY 1")
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name; created with the first version."""
    return entity(spark, sf_dir, "object_versions").groupBy("bucket").agg(F.min("last_modified").alias("created_at")).orderBy("bucket")


_TAGS = "'env=' || CAST(content_length % 3 AS VARCHAR)"


@query("tags_f28_m22", f"{sql('object_versions')} SELECT version_id, CASE content_length % 4 WHEN 0 THEN NULL WHEN 1 THEN {_TAGS} ELSE 'new' END AS env, CASE content_length % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n FROM object_versions")
def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tags replace all old ones; an empty set removes them; versions without a request keep theirs."""
    rows = entity(spark, sf_dir, "object_versions").select("version_id", "content_length", F.expr("map('env', concat('env=', content_length % 3), 'team', 'a')").alias("tags"))
    asked = rows.select("version_id", F.expr("case content_length % 4 when 0 then cast(map() as map<string, string>) when 1 then null else map('env', 'new') end").alias("new")).filter("new is not null")
    put = rows.join(asked, "version_id", "left").withColumn("tags", F.coalesce("new", "tags"))
    return put.select("version_id", F.col("tags").getItem("env").alias("env"), F.size("tags").alias("n"))


_DOC = "'{\"' || CASE event_id % 3 WHEN 0 THEN 'BucketName' WHEN 1 THEN 'bucketName' ELSE 'bucket' END || '\": \"b' || CAST(event_id % 10 AS STRING) || '\", \"maxItems\": ' || CASE event_id % 4 WHEN 0 THEN '\"12\"' WHEN 1 THEN '7' WHEN 2 THEN '\"x\"' ELSE 'null' END || '}'"


@query("lenient_json_f31_s21", f"{sql('request_log')} SELECT event_id, {_DOC} AS doc, 'b' || CAST(event_id % 10 AS STRING) AS bucket, CAST(CASE event_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 7 ELSE 100 END AS BIGINT) AS max_items FROM request_log")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity(spark, sf_dir, "request_log").select("event_id", F.expr(_DOC).alias("doc"))
    return rows.select("event_id", "doc", records.json_field("doc", "BucketName", "bucketName", "bucket").alias("bucket"), records.json_long("doc", 100, "MaxItems", "maxItems").alias("max_items"))


_RAW = "CASE object_no % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'retryscheduled' WHEN 2 THEN 'odd' WHEN 3 THEN ' ' END"


@query(
    "statuses_f34",
    f"""{sql('heal_queue')} SELECT object_no, CASE WHEN s ILIKE 'failed' THEN 'Failed' WHEN s ILIKE 'retryscheduled' OR (attempts > 0 AND length(trim(s)) > 0) THEN 'RetryScheduled' ELSE 'Pending' END AS status,
  CASE object_no % 3 WHEN 0 THEN 'Enabled' WHEN 1 THEN 'Suspended' ELSE 'Off' END AS versioning FROM (SELECT *, {_RAW} AS s FROM heal_queue)""",
)
def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity(spark, sf_dir, "heal_queue").withColumn("s", F.expr(_RAW)).withColumn("v", F.expr("case object_no % 3 when 0 then 'ENABLED' when 1 then 'suspended' end"))
    return rows.select("object_no", records.heal_status("s", "attempts").alias("status"), records.versioning_status("v").alias("versioning"))


@query(
    "key_names_p16_p28",
    f"""{sql('parts')} SELECT doc_id, doc_id % 4 <> 1 AND strlen(k) BETWEEN 1 AND 1024 AND doc_id % 4 <> 2 AS valid, n BETWEEN 1048576 AND 5497558138880 AS limit_ok
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN key WHEN 1 THEN key || chr(10) WHEN 2 THEN '' ELSE repeat('é', CAST(doc_id % 1000 AS INTEGER)) || 'k' END AS k, doc_id * 1048576 AS n FROM parts)""",
)
def _key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity(spark, sf_dir, "parts").withColumn("k", F.expr("case doc_id % 4 when 0 then key when 1 then concat(key, char(10)) when 2 then '' else concat(repeat('é', cast(doc_id % 1000 as int)), 'k') end"))
    return rows.select("doc_id", records.valid_key("k").alias("valid"), F.expr("doc_id * 1048576").between(*records.UPLOAD_LIMITS).alias("limit_ok"))


@query(
    "shard_paths_p31",
    f"{sql('shards')} SELECT object_no, set_index, CASE object_no % 6 WHEN 0 THEN 'not relative' WHEN 1 THEN 'traversal' WHEN 2 THEN 'not a data file' WHEN 3 THEN 'not a data file' WHEN 4 THEN 'not relative' ELSE 'ok' END AS outcome FROM shards",
)
def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("case object_no % 6 when 0 then concat('/', path) when 1 then concat('objects/../', path) when 2 then concat(path, '/XL.meta') when 3 then concat('tmp/', path) when 4 then ' ' else path end")
    return entity(spark, sf_dir, "shards").withColumn("p", path).select("object_no", "set_index", records.shard_path("p").alias("outcome"))


@query(
    "text_escapes_f03_f04_f07",
    f"{sql('parts')} SELECT doc_id, substr(text, 1, 512) AS short, md5(url_encode(text)) AS encoded_md5, text AS decoded, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS xml_md5, text AS from_xml FROM parts",
)
def _escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes there and back: what is read from an escaped text is the text."""
    rows = entity(spark, sf_dir, "parts").select("doc_id", "text", records.percent_encoded("text").alias("e"), records.xml_escaped("text").alias("x"))
    return rows.select("doc_id", F.left("text", F.lit(512)).alias("short"), F.md5("e").alias("encoded_md5"), F.url_decode("e").alias("decoded"), F.md5("x").alias("xml_md5"), records.xml_unescaped("x").alias("from_xml"))


@query("canonical_query_f20", f"{sql('object_versions')} SELECT version_id, list_aggregate(list_sort(['prefix=' || url_encode(key), 'list-type=2', 'delimiter=%2F', 'marker=' || url_encode(etag || ' *~')]), 'string_agg', '&') AS canonical FROM object_versions")
def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.expr("array(named_struct('name', 'prefix', 'value', key), named_struct('name', 'list-type', 'value', '2'), named_struct('name', 'delimiter', 'value', '/'), named_struct('name', 'marker', 'value', concat(etag, ' *~')))")
    return entity(spark, sf_dir, "object_versions").withColumn("pairs", pairs).select("version_id", records.canonical_query("pairs").alias("canonical"))


_SPANS = "SELECT upload_id, CAST(floor(sum(size) / 4) AS BIGINT) AS first_byte, CAST(floor(sum(size) / 2) AS BIGINT) AS last_byte FROM {parts} GROUP BY upload_id"


@query(
    "range_parts_s17",
    f"""{sql('upload_parts').rstrip()}, r AS ({_SPANS.format(parts='upload_parts')}), p AS (SELECT *, sum(size) OVER (PARTITION BY upload_id ORDER BY part_number, size ROWS UNBOUNDED PRECEDING) AS stop FROM upload_parts),
  x AS (SELECT upload_id, part_number, stop - size AS start, stop, first_byte, last_byte + 1 AS until FROM p JOIN r USING (upload_id))
  SELECT upload_id, part_number, CAST(greatest(first_byte - start, 0) AS BIGINT) AS skip, CAST(least(until, stop) - greatest(first_byte, start) AS BIGINT) AS length FROM x WHERE least(until, stop) > greatest(first_byte, start)""",
)
def _range_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second quarter of every upload, as pieces of its parts."""
    parts = entity(spark, sf_dir, "upload_parts")
    return records.parts_of_range(parts, spark.sql(_SPANS, parts=parts))


@query("readable_shard_s14", f"{sql('shards')} SELECT object_no, part_no, arg_min(disk_id, struct_pack(a := set_index, b := disk_id)) AS disk_id, min(set_index) AS set_index FROM shards WHERE status = 'available' GROUP BY 1, 2")
def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part, the first copy that can be read."""
    return entity(spark, sf_dir, "shards").filter("status = 'available'").groupBy("object_no", "part_no").agg(F.min_by("disk_id", F.struct("set_index", "disk_id")).alias("disk_id"), F.min("set_index").alias("set_index"))


_STALE = "CASE WHEN object_no % 9 = 0 THEN 'other' ELSE md5(CAST(object_no AS STRING)) END"


@query("stale_repairs_j12", f"{sql('object_versions', 'heal_queue').rstrip()}, {catalog._LATEST}, h AS (SELECT *, {_STALE} AS object_id FROM heal_queue) SELECT object_no, attempts, cur.object_id IS NULL AS stale FROM h LEFT JOIN cur ON cur.object_id = h.object_id")
def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of objects that were replaced or deleted since they were queued."""
    top = namespace.current(entity(spark, sf_dir, "object_versions")).select("object_id", F.lit(True).alias("known"))
    rows = entity(spark, sf_dir, "heal_queue").withColumn("object_id", F.expr(_STALE)).join(top, "object_id", "left")
    return rows.select("object_no", "attempts", F.col("known").isNull().alias("stale"))


@query("repair_histogram_a13", f"{sql('heal_queue')} SELECT {integrity.queue_status(5)} AS state, count(*) AS items, min(queued_at) AS oldest, max(queued_at) AS newest FROM heal_queue GROUP BY 1")
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "heal_queue").groupBy(F.expr(integrity.queue_status(5)).alias("state")).agg(F.count(F.lit(1)).alias("items"), F.min("queued_at").alias("oldest"), F.max("queued_at").alias("newest"))


@query("consistency_totals_a17", f"{sql('shards').rstrip()}, o AS (SELECT object_no, count(*) AS n, count(*) FILTER (status = 'missing') AS gone, count(*) FILTER (status = 'available') AS ok FROM shards GROUP BY 1) SELECT count(*) AS checked, count(*) FILTER (ok < 2) AS under_replicated, CAST(sum(gone) AS BIGINT) AS missing_files, count(*) FILTER (gone > 0 OR ok < 2) AS queued FROM o")
def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repair for each object that lacks files or copies."""
    rows = entity(spark, sf_dir, "shards").groupBy("object_no").agg(F.count_if(F.expr("status = 'missing'")).alias("gone"), F.count_if(F.expr("status = 'available'")).alias("ok"))
    return rows.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.expr("ok < 2")).alias("under_replicated"), F.sum("gone").alias("missing_files"), F.count_if(F.expr("gone > 0 or ok < 2")).alias("queued"))


@query("pool_dashboard_a23", f"{sql('disks').rstrip()}, c AS ({catalog._CAP('pool_id, ')} GROUP BY pool_id) SELECT pool_id, count(*) AS drives, count(*) FILTER (disk_status = 'Online') AS online_drives, coalesce(any_value(total_bytes_1), 0) AS total_bytes, coalesce(any_value(free_1), 0) AS free_bytes, greatest(0, coalesce(any_value(total_bytes_1), 0) - coalesce(any_value(free_1), 0)) AS used_bytes FROM disks LEFT JOIN (SELECT pool_id, total_bytes AS total_bytes_1, available_bytes AS free_1 FROM c) USING (pool_id) GROUP BY pool_id")
def _pool_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bucketscope.operators import cluster

    disks = entity(spark, sf_dir, "disks")
    drives = disks.groupBy("pool_id").agg(F.count(F.lit(1)).alias("drives"), F.count_if(F.expr("disk_status = 'Online'")).alias("online_drives"))
    sized = drives.join(cluster.distinct_capacity(disks.filter(cluster.ONLINE), "pool_id"), "pool_id", "left")
    return sized.selectExpr("pool_id", "drives", "online_drives", "coalesce(total_bytes, 0) as total_bytes", "coalesce(available_bytes, 0) as free_bytes", "greatest(0, coalesce(total_bytes, 0) - coalesce(available_bytes, 0)) as used_bytes")


@query(
    "health_badge_a25",
    f"""{sql('disks', 'shards', 'heal_queue').rstrip()}, {catalog._FLAGS} SELECT (SELECT count(DISTINCT node_id) FROM disks WHERE node_status <> 'Online') + (SELECT count(*) FROM disks WHERE disk_status <> 'Online')
  + (SELECT greatest(count(*) FILTER (unrecoverable), count(*) FILTER (under_replicated)) FROM fl) + (SELECT count(*) FROM heal_queue WHERE {integrity.queue_status(5)} = 'Failed') AS badge""",
)
def _badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline nodes and disks, objects at risk and failed repairs, in one number."""
    disks = entity(spark, sf_dir, "disks").agg(F.countDistinct(F.expr("case when node_status <> 'Online' then node_id end")).alias("nodes"), F.count_if(F.expr("disk_status <> 'Online'")).alias("disks"))
    failed = entity(spark, sf_dir, "heal_queue").agg(F.count_if(F.expr(f"{integrity.queue_status(5)} = 'Failed'")).alias("failed"))
    health = integrity.health(entity(spark, sf_dir, "shards"), 1, 2)
    return disks.join(health).join(failed).select(F.expr("nodes + disks + greatest(unrecoverable, under_replicated) + failed").alias("badge"))


@query("abort_uploads_m14", f"{sql('uploads')} SELECT bucket, key, upload_id FROM uploads WHERE starts_with(key, 'y=1996/') AND initiated_at <= TIMESTAMP '{catalog.NOW}' - to_days(800)")
def _aborted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads under a rule's prefix that were begun so many days ago, or more."""
    return entity(spark, sf_dir, "uploads").filter(F.expr(f"startswith(key, 'y=1996/') and initiated_at <= timestamp_ntz'{catalog.NOW}' - interval 800 days")).select("bucket", "key", "upload_id")
