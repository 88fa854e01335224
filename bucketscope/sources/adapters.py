"""The store's entities from the driver's tables. Each column is one expression that Spark SQL and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: entity: (table, {column: expression}).
ENTITIES: dict[str, tuple[str, dict[str, str]]] = {
    "request_log": (
        "events",
        {
            "event_id": "event_id",
            "occurred_at": "ts",
            "user_id": "user_id",
            "bucket": "CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('b', CAST(user_id % 10 AS STRING)) END",
            "method": "CASE event_type WHEN 'click' THEN 'PUT' WHEN 'signup' THEN 'HEAD' WHEN 'purchase' THEN 'DELETE' ELSE 'GET' END",
            "is_list": "event_id % 7 = 0",
            "is_error": "event_type = 'error'",
            "ingress_bytes": "CASE WHEN event_type = 'click' THEN CAST(floor(value * 1000) AS BIGINT) ELSE CAST(0 AS BIGINT) END",
            "egress_bytes": "CASE WHEN event_type IN ('view', 'error') THEN CAST(floor(value * 1000) AS BIGINT) ELSE CAST(0 AS BIGINT) END",
        },
    ),
    "object_versions": (
        "orders",
        {
            "bucket": "concat('b', CAST(o_custkey % 8 AS STRING))",
            "key": "concat('y=', CAST(year(o_orderdate) AS STRING), '/m=', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/c=', CAST(o_custkey % 50 AS STRING))",
            "version_id": "lpad(CAST(o_orderkey AS STRING), 20, '0')",
            "object_id": "md5(CAST(o_orderkey AS STRING))",
            "etag": "md5(concat('etag-', CAST(o_orderkey AS STRING)))",
            "content_length": "CAST(floor(o_totalprice) AS BIGINT)",
            "last_modified": "o_orderdate",
            "is_delete_marker": "(o_orderstatus = 'F' AND o_orderkey % 11 = 0)",
        },
    ),
    "shards": (
        "lineitem",
        {
            "object_no": "l_orderkey",
            "part_no": "CAST(l_linenumber % 2 AS INT)",
            "set_index": "CAST(l_linenumber AS INT)",
            "disk_id": "l_suppkey",
            "size": "CAST(l_quantity AS BIGINT)",
            "path": "concat('objects/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING))",
            "status": "CASE WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN 'missing' WHEN l_partkey % 97 = 0 THEN 'corrupt' ELSE 'available' END",
            "modified_at": "l_shipdate",
        },
    ),
    "uploads": (
        "orders",
        {
            "upload_id": "lpad(CAST(o_orderkey AS STRING), 12, '0')",
            "bucket": "concat('b', CAST(o_custkey % 8 AS STRING))",
            "key": "concat('y=', CAST(year(o_orderdate) AS STRING), '/m=', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/c=', CAST(o_custkey % 50 AS STRING))",
            "initiated_at": "o_orderdate",
        },
    ),
    "upload_parts": (
        "lineitem",
        {
            "upload_id": "lpad(CAST(l_orderkey AS STRING), 12, '0')",
            "part_number": "CAST(l_linenumber AS INT)",
            "size": "CAST(l_quantity * 400000 AS BIGINT)",
            "etag": "md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)))",
        },
    ),
    "asked_parts": (
        "lineitem",
        {
            "upload_id": "lpad(CAST(l_orderkey AS STRING), 12, '0')",
            "pos": "CAST(CASE WHEN l_orderkey % 23 = 0 THEN 100 - l_linenumber ELSE l_linenumber END AS INT)",
            "part_number": "CAST(CASE WHEN l_orderkey % 19 = 0 AND l_linenumber = 2 THEN 90 ELSE l_linenumber END AS INT)",
            "etag": "concat('\"', upper(md5(concat(CAST(l_orderkey AS STRING), '-', CAST(CASE WHEN l_orderkey % 17 = 0 AND l_linenumber = 1 THEN 0 ELSE l_linenumber END AS STRING)))), '\"')",
            "leave_out": "l_orderkey % 5 = 0 AND l_linenumber = 1",
        },
    ),
    "disks": (
        "supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
        {
            "disk_id": "s_suppkey",
            "node_id": "n_name",
            "fault_domain": "r_name",
            "pool_id": "concat('p', CAST(s_suppkey % 3 AS STRING))",
            "capacity_group": "CAST(floor(s_suppkey / 2) AS BIGINT)",
            "total_bytes": "CAST(1000000 + (s_suppkey % 7) * 100000 AS BIGINT)",
            "available_bytes": "CAST(greatest(0, floor(s_acctbal * 100)) AS BIGINT)",
            "disk_status": "CASE WHEN s_suppkey % 13 = 0 THEN 'Offline' ELSE 'Online' END",
            "node_status": "CASE WHEN n_nationkey % 9 = 0 THEN 'Offline' ELSE 'Online' END",
        },
    ),
    "heal_queue": (
        "orders",
        {
            "object_no": "o_orderkey",
            "bucket": "concat('b', CAST(o_custkey % 8 AS STRING))",
            "reason": "CASE o_orderkey % 3 WHEN 0 THEN 'ShardMissing' WHEN 1 THEN 'ManifestMissing' ELSE 'UnderReplicated' END",
            "attempts": "CAST(o_orderkey % 7 AS INT)",
            "status": "CASE WHEN o_orderkey % 7 = 6 THEN 'Failed' WHEN o_orderkey % 7 > 0 THEN 'RetryScheduled' ELSE 'Pending' END",
            "queued_at": "o_orderdate",
            "next_day": "CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 60 AS INT) END",
        },
    ),
    "mutations": (
        "events",
        {
            "seq": "event_id",
            "key": "concat('k:', lpad(CAST(user_id AS STRING), 5, '0'))",
            "value": "props",
            "deleted": "event_type = 'purchase'",
        },
    ),
    "parts": (
        "documents",
        {"doc_id": "doc_id", "key": "concat(lang, '/', source, '/', CAST(doc_id AS STRING))", "text": "text", "size": "CAST(length(text) AS BIGINT)"},
    ),
    "audit_log": (
        "conversations",
        {
            "id": "conv_id * 1000 + turn",
            "actor": "role",
            "action": "CASE WHEN turn % 2 = 0 THEN 'ask' ELSE 'answer' END",
            "resource": "concat('conv/', CAST(conv_id AS STRING))",
            "message": "text",
        },
    ),
    "urls": ("pages", {"page_id": "page_id", "url": "url"}),
}


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = ENTITIES[name]
    tables = source.split()
    df = spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet")
    if "JOIN" in tables:
        nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
        df = df.join(nation, df.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql(*names: str) -> str:
    """A WITH clause of the named entities for DuckDB."""
    one = lambda n: f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ENTITIES[n][1].items())} FROM {ENTITIES[n][0]})"
    return "WITH " + ", ".join(map(one, names)) + " "
