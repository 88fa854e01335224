"""Queries over the store's writes: multipart uploads, deletions by versioning, pages with folding, copies. Imported by the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.operators import multipart, namespace
from bucketscope.plans.registry import query
from bucketscope.sources.adapters import entity, sql

#: Least size of a part that is not the last: 5 MiB, fixed by the protocol.
LEAST_PART = 5 * 1024 * 1024


@query(
    "list_parts_l07",
    f"""{sql('upload_parts').rstrip()}, n AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY part_number, size) AS rn, count(*) OVER (PARTITION BY upload_id) > 3 AS truncated FROM upload_parts WHERE part_number > 1),
  p AS (SELECT * FROM n WHERE rn <= 3)
  SELECT upload_id, part_number, size, etag, truncated, CASE WHEN truncated THEN max(part_number) OVER (PARTITION BY upload_id) ELSE 0 END AS next_marker FROM p""",
)
def _parts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every upload, the page of three parts behind part 1."""
    return multipart.part_pages(entity(spark, sf_dir, "upload_parts"), 1, 3)


_FOLDED = lambda rows, prefix, delimiter, order, most: f"""fe AS (SELECT *, CASE WHEN contains(substr(key, {len(prefix) + 1}), '{delimiter}') THEN '{prefix}' || split_part(substr(key, {len(prefix) + 1}), '{delimiter}', 1) || '{delimiter}' ELSE key END AS entry,
    contains(substr(key, {len(prefix) + 1}), '{delimiter}') AS is_prefix FROM {rows} WHERE starts_with(key, '{prefix}')),
  fg AS (SELECT entry, is_prefix, key, {order}, row_number() OVER (PARTITION BY CASE WHEN is_prefix THEN entry ELSE key || chr(1) || CAST({order} AS VARCHAR) END ORDER BY key, {order}) AS k FROM fe),
  fh AS (SELECT *, row_number() OVER (ORDER BY key, {order}) AS place, count(*) OVER () > {most} AS truncated FROM fg WHERE k = 1),
  fp AS (SELECT * FROM fh WHERE place <= {most})
  SELECT entry, is_prefix, key, {order}, truncated, CASE WHEN truncated THEN last_value(key) OVER w END AS next_key, CASE WHEN truncated THEN last_value({order}) OVER w END AS next_{order}
  FROM fp WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""  # noqa: E731


@query("list_uploads_l08", f"{sql('uploads').rstrip()}, u AS (SELECT * FROM uploads WHERE bucket = 'b2' AND (key > 'y=1993/m=02/' OR (key = 'y=1993/m=02/' AND upload_id > ''))), {_FOLDED('u', 'y=199', '/c=', 'upload_id', 20)}")
def _uploads_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket's uploads behind a marker, folded by month."""
    rows = entity(spark, sf_dir, "uploads").filter("bucket = 'b2' and (key > 'y=1993/m=02/' or (key = 'y=1993/m=02/' and upload_id > ''))")
    return namespace.folded_page(rows, "y=199", "/c=", 20, "key", "upload_id")


_RANKED = "v AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket, key ORDER BY last_modified DESC, version_id) AS INTEGER) AS rn FROM object_versions WHERE bucket = 'b3')"


@query("list_versions_folded_l06", f"{sql('object_versions').rstrip()}, {_RANKED}, {_FOLDED('v', 'y=1996/', '/c=1', 'rn', 40)}")
def _versions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket's versions, the newest of a key first; keys beyond a delimiter are folded, the rest listed."""
    ranked = namespace.version_rank(entity(spark, sf_dir, "object_versions").filter("bucket = 'b3'"))
    return namespace.folded_page(ranked, "y=1996/", "/c=1", 40, "key", "rn")


_ASKED = "ask AS (SELECT upload_id, pos, part_number, lower(trim(etag, '\"')) AS etag FROM asked_parts WHERE NOT leave_out)"
_DONE = f"""jn AS (SELECT ask.*, s.etag AS own, s.size, row_number() OVER w AS i, count(*) OVER (PARTITION BY ask.upload_id) AS n, lag(ask.part_number) OVER w AS before
    FROM ask LEFT JOIN upload_parts s ON s.upload_id = ask.upload_id AND s.part_number = ask.part_number WINDOW w AS (PARTITION BY ask.upload_id ORDER BY pos, ask.part_number)),
  er AS (SELECT *, CASE WHEN own IS NULL OR own <> etag THEN 'InvalidPart' WHEN i < n AND size < {LEAST_PART} THEN 'EntityTooSmall' END AS e FROM jn),
  dn AS (SELECT upload_id, CASE WHEN bool_or(coalesce(before >= part_number, false)) THEN 'InvalidPartOrder' ELSE coalesce(arg_min(e, i) FILTER (e IS NOT NULL), 'ok') END AS outcome,
    md5(unhex(string_agg(own, '' ORDER BY i))) || '-' || CAST(count(*) AS VARCHAR) AS etag, CAST(sum(size) AS BIGINT) AS content_length, CAST(count(*) AS INTEGER) AS parts FROM er GROUP BY 1)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "asked_parts").filter("not leave_out").drop("leave_out")


@query("complete_uploads_m10_j08", f"{sql('upload_parts', 'asked_parts').rstrip()}, {_ASKED}, {_DONE} SELECT upload_id, outcome, CASE WHEN outcome = 'ok' THEN etag END AS etag, CASE WHEN outcome = 'ok' THEN content_length END AS content_length, CASE WHEN outcome = 'ok' THEN parts END AS parts FROM dn")
def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multipart.completed(_asked(spark, sf_dir), entity(spark, sf_dir, "upload_parts"), LEAST_PART)


@query("left_over_parts_j09", f"{sql('upload_parts', 'asked_parts').rstrip()}, {_ASKED}, {_DONE} SELECT s.* FROM upload_parts s JOIN dn ON dn.upload_id = s.upload_id AND outcome = 'ok' ANTI JOIN ask ON ask.upload_id = s.upload_id AND ask.part_number = s.part_number")
def _left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, stored = _asked(spark, sf_dir), entity(spark, sf_dir, "upload_parts")
    return multipart.left_over(asked, stored, multipart.completed(asked, stored, LEAST_PART))


@query("abandoned_uploads_m11", f"{sql('uploads', 'upload_parts').rstrip()}, h AS (SELECT upload_id, count(*) AS parts, CAST(sum(size) AS BIGINT) AS bytes FROM upload_parts GROUP BY 1) SELECT uploads.*, coalesce(parts, 0) AS parts, coalesce(bytes, 0) AS bytes FROM uploads LEFT JOIN h USING (upload_id) WHERE initiated_at < TIMESTAMP '1995-01-01'")
def _abandoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multipart.abandoned(entity(spark, sf_dir, "uploads"), entity(spark, sf_dir, "upload_parts"), "1995-01-01 00:00:00")


#: Every third key of a bucket is deleted in one of four ways.
_WAY = "CAST(split_part(key, 'c=', 2) AS INTEGER) % 5"
_STATUS = "CASE WHEN bucket < 'b4' THEN 'Enabled' WHEN bucket < 'b6' THEN 'Suspended' ELSE 'Off' END"
_REQUESTS = f"""kk AS (SELECT bucket, key, {_WAY} AS way, max_by(version_id, struct_pack(a := last_modified, b := version_id)) AS top, min(version_id) AS first_id FROM object_versions GROUP BY 1, 2, 3),
  rq AS (SELECT bucket, key, CASE way WHEN 1 THEN top WHEN 2 THEN first_id WHEN 3 THEN 'none' END AS asked, {_STATUS} AS versioning, 'mark-' || md5(bucket || key) AS marker_id, top FROM kk WHERE way < 4),
  gn AS (SELECT *, coalesce(asked, CASE WHEN versioning <> 'Enabled' THEN top END) AS gone, asked IS NULL AND versioning = 'Enabled' AS marks FROM rq)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity(spark, sf_dir, "object_versions")
    keys = rows.groupBy("bucket", "key").agg(F.max_by("version_id", F.struct("last_modified", "version_id")).alias("top"), F.min("version_id").alias("first_id"))
    keys = keys.withColumn("way", F.expr("cast(split_part(key, 'c=', 2) as int) % 5")).filter("way < 4")
    return keys.select("bucket", "key", F.expr("case way when 1 then top when 2 then first_id when 3 then 'none' end").alias("version_id"), F.expr(_STATUS).alias("versioning"), F.expr("concat('mark-', md5(concat(bucket, key)))").alias("marker_id"))


@query(
    "delete_outcome_m04_m05_m06_m07_a21",
    f"""{sql('object_versions').rstrip()}, {_REQUESTS}
  SELECT gn.bucket, gn.key, asked, CASE WHEN marks THEN marker_id ELSE asked END AS version_id, CASE WHEN marks THEN true ELSE asked IS NOT NULL AND coalesce(v.is_delete_marker, false) END AS is_delete_marker, marks OR v.key IS NOT NULL AS found
  FROM gn LEFT JOIN object_versions v ON v.bucket = gn.bucket AND v.key = gn.key AND v.version_id = gn.gone""",
)
def _delete_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.delete_objects(entity(spark, sf_dir, "object_versions"), _requests(spark, sf_dir), "1999-01-01 00:00:00")[0]


@query(
    "versions_after_delete_m04_m05_m06",
    f"""{sql('object_versions').rstrip()}, {_REQUESTS},
  af AS (SELECT bucket, key, version_id, last_modified, is_delete_marker FROM object_versions v WHERE NOT EXISTS (SELECT 1 FROM gn WHERE gn.bucket = v.bucket AND gn.key = v.key AND gn.gone = v.version_id)
         UNION ALL SELECT bucket, key, marker_id, TIMESTAMP '1999-01-01', true FROM gn WHERE marks),
  nw AS (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY last_modified DESC, version_id DESC) = 1 AS newest FROM af)
  SELECT nw.bucket, nw.key, version_id, last_modified, is_delete_marker, newest AND NOT coalesce(gn.asked IS NULL AND gn.key IS NOT NULL AND NOT marks, false) AS is_current FROM nw LEFT JOIN gn USING (bucket, key)""",
)
def _after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version that is left, the markers made, and which of them a plain read finds."""
    rows = entity(spark, sf_dir, "object_versions").select("bucket", "key", "version_id", "last_modified", "is_delete_marker")
    return namespace.delete_objects(rows, _requests(spark, sf_dir), "1999-01-01 00:00:00")[1]


@query(
    "copy_source_p22_f04",
    f"""{sql('object_versions').rstrip()}, h AS (SELECT version_id, CASE WHEN content_length % 2 = 0 THEN '/' ELSE '' END || bucket || '/' || replace(replace(key, '=', '%3D'), '/', CASE WHEN content_length % 3 = 0 THEN '%2F' ELSE '/' END) || CASE WHEN content_length % 5 = 0 THEN '?versionId=' || version_id ELSE '' END AS header, bucket, key, content_length FROM object_versions)
  SELECT version_id, header, bucket AS source_bucket, key AS source_key, CASE WHEN content_length % 5 = 0 THEN version_id END AS source_version FROM h""",
)
def _copy_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy's source header, read back: an optional slash, bucket, percent-encoded key, optional version."""
    made = "concat(if(content_length % 2 = 0, '/', ''), bucket, '/', replace(replace(key, '=', '%3D'), '/', if(content_length % 3 = 0, '%2F', '/')), if(content_length % 5 = 0, concat('?versionId=', version_id), ''))"
    rows = entity(spark, sf_dir, "object_versions").select("version_id", F.expr(made).alias("header"))
    return namespace.copy_source(rows, "header")


@query(
    "copy_directive_f29_m08",
    f"""{sql('object_versions')} SELECT version_id, CASE WHEN content_length % 3 = 0 THEN 'new' ELSE 'old' END AS owner, CASE WHEN content_length % 3 = 0 THEN CASE WHEN content_length % 2 = 0 THEN 'no-store' END WHEN content_length % 2 = 0 THEN 'no-store' ELSE 'max-age=1' END AS cache_control FROM object_versions""",
)
def _directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REPLACE takes the request's metadata and headers as they are; COPY the source's, but for headers that the request names."""
    rows = entity(spark, sf_dir, "object_versions").select("version_id", F.expr("if(content_length % 3 = 0, 'replace', 'COPY')").alias("directive"), F.expr("map('owner', 'old')").alias("source"), F.expr("map('owner', 'new')").alias("own"), F.lit("max-age=1").alias("source_cache"), F.expr("if(content_length % 2 = 0, 'no-store', null)").alias("own_cache"))
    replace = F.upper("directive") == "REPLACE"
    return rows.select("version_id", F.when(replace, F.col("own")).otherwise(F.col("source")).getItem("owner").alias("owner"), F.when(replace, F.col("own_cache")).otherwise(F.coalesce("own_cache", "source_cache")).alias("cache_control"))
