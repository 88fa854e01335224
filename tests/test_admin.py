"""Administration, on small inputs of our own."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bucketscope.operators import admin

T = datetime(2031, 5, 1)


def test_access_keys(spark):
    ops = [("root", "delete", None), ("a", "create", None), ("a", "create", "late"), ("b", "put", "early"), ("b", "create", None), ("c", "create", "x"), ("c", "drop", None), ("d", "create", None), ("d", "delete", None), ("e", "create", None), ("e", "put", "  "), ("f", "create", None), ("f", "put", "p"), ("f", "delete", None), ("f", "create", None)]
    rows = [(-1, T, "root", "create", None)] + [(i, T + timedelta(minutes=i), *o) for i, o in enumerate(ops)]
    frame = spark.createDataFrame(rows, "seq long, made_at timestamp_ntz, access_key string, op string, policy string")
    got = {r.access_key: (r.created_at, r.has_policy) for r in admin.access_keys(frame, "root").collect()}
    at = lambda i: T + timedelta(minutes=i)
    assert got == {"root": (T, False), "a": (at(1), False), "b": (at(4), False), "c": (at(5), False), "e": (at(9), False), "f": (at(14), False)}
    with_policy = spark.createDataFrame([*rows, (99, at(99), "f", "put", " q ")], frame.schema)
    assert admin.access_keys(with_policy, "root").filter("has_policy").select("access_key").collect() == [("f",)]
    assert admin.access_keys(frame.limit(0), "root").count() == 0


def test_coding_profiles(spark):
    log = spark.createDataFrame([(1, "z", '{"data_shards": 8, "parity_shards": 3, "enabled": true}'), (2, "y", '{"data_shards": 2, "parity_shards": 1, "enabled": false}'), (3, "z", None)], "seq long, profile_id string, doc string")
    assert [tuple(r) for r in admin.coding_profiles(log, ("own", 4, 2)).collect()] == [("y", 2, 1, False)]
    assert [tuple(r) for r in admin.coding_profiles(log.filter("profile_id = 'z'"), ("own", 4, 2)).collect()] == [("own", 4, 2, True)]
    assert [tuple(r) for r in admin.coding_profiles(log.limit(0), ("own", 4, 2)).collect()] == [("own", 4, 2, True)]


def test_rate_profiles(spark):
    rows = spark.createDataFrame([("/api/console/AUTH/login", True, None, None), ("/api/console", False, "", "1.1.1.1"), ("/api/consoles", False, "2.2.2.2", "1.1.1.1"), ("/q/k", True, " 3.3.3.3 ,4.4.4.4", None)], "path string, is_store boolean, forwarded string, address string")
    got = rows.select(admin.rate_profile("path", "is_store").alias("p"), admin.client("forwarded", "address").alias("c")).collect()
    assert [(r.p and r.p.profile, r.c) for r in got] == [("console-login", "unknown"), ("console-api", "1.1.1.1"), (None, "2.2.2.2"), ("s3", "3.3.3.3")]


def test_health_counters(spark):
    shards = [(1, 0, 0, "available"), (1, 0, 1, "available"), (2, 0, 0, "available"), (2, 0, 1, "missing"), (3, 0, 0, "missing"), (3, 1, 0, "available"), (5, 0, 0, "available"), (5, 0, 0, "available")]
    frame = spark.createDataFrame(shards, "object_no long, part_no int, set_index int, status string")
    objects = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "object_no long")
    r = admin.health_counters(objects, frame, 1, 2).first().asDict()
    assert r == {"objects": 5, "without_manifest": 1, "missing_objects": 3, "degraded": 2, "recoverable_degraded": 1, "unrecoverable": 2, "read_quorum_lost": 2, "write_quorum_lost": 3, "under_replicated": 3, "records": 8, "existing_files": 6, "missing_files": 2}
    assert admin.health_counters(objects, frame, 1, 2, data_shards=2).first().unrecoverable == 4  # one place twice is one place
    assert admin.health_counters(objects.limit(0), frame, 1, 2).first().records == 0


def test_alerts(spark):
    gauges = ["nodes_offline", "disks_offline", "files_missing", "read_quorum_lost", "recoverable_degraded", "under_replicated", "repair_pending", "repair_exhausted", "task_failures", "write_risk", "capacity_available", "capacity_total", "low_watermark_disks", "min_fault_domains", "pools_below"]
    quiet = spark.range(20).select((F.lit(T) + F.make_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("taken_at"), "id", *[F.lit(100 if g.startswith("capacity") else 0).alias(g) for g in gauges])
    assert admin.alerts(quiet).count() == 0
    broken = quiet.withColumn("nodes_offline", F.expr("int(id in (2, 3, 4, 8, 9, 15))")).withColumn("capacity_available", F.expr("if(id >= 8, 10, 100)")).withColumn("repair_pending", F.expr("if(id = 10, null, 1)"))
    got = {(r.alert, (r.since - T).seconds // 60, (r.until - T).seconds // 60) for r in admin.alerts(broken).collect()}
    assert got == {("NodeOffline", 2, 4), ("CapacityLow", 8, 19)}


def test_bucket_settings(spark):
    many = {f"k{i}": "v" for i in range(20)}
    cases = [
        (None, None, "ok"),
        ({"Expires": "2031-05-06T07:08:09Z", "content-language": " de "}, {"X-AMZ-meta-A": "1"}, "ok"),
        ({"Expires": "never"}, {}, "invalid date"),
        ({"x": "1"}, {}, "unsupported header"),
        ({"Cache-Control": "a\r\nb"}, {}, "invalid header value"),
        ({}, {"": "1"}, "invalid metadata name"),
        ({}, {"n" * 65: "1"}, "invalid metadata name"),
        ({}, {"n": "x" * 1025}, "invalid metadata value"),
        ({}, many, "ok"),
        ({}, {**many, "one-more": "v"}, "too many entries"),
        ({}, {**many, "one-more": " "}, "ok"),
    ]
    rows = spark.createDataFrame([(i, h, m) for i, (h, m, _) in enumerate(cases)], "i int, h map<string,string>, m map<string,string>")
    got = {r.i: r.s for r in rows.select("i", admin.bucket_settings("h", "m").alias("s")).collect()}
    assert [got[i].outcome for i in range(len(cases))] == [c[2] for c in cases]
    assert got[1].headers == {"Expires": "2031-05-06T07:08:09Z", "Content-Language": "de"} and got[1].metadata == {"a": "1"}
    assert got[0].metadata == {} and got[2].headers is None
    ordered = spark.range(1).selectExpr("map('x', '') as h", "map('X-AMZ-meta-A', '1', ' a ', '2', 'A', ' ') as m").withColumn("h", F.lit(None).cast("map<string,string>"))
    assert ordered.select(admin.bucket_settings("h", "m").alias("s")).first().s.metadata == {"a": "2"}  # the last that isn't blank


def test_bucket_settings_reads_each_map_once(spark, sf_dir):
    from bucketscope.plans import catalog

    plan = catalog.queries()["bucket_settings_p29"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_entries(") == 2
