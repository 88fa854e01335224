import datetime as dt
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from bucketscope.functions import erasure, scalar
from bucketscope.operators import cluster, integrity, metrics, multipart, namespace, policy
from bucketscope.streaming import requests


def test_prefix_paging(spark):
    """Pages of three over names with letters of several bytes; the last one is empty."""
    names = ["log/zürich/1", "log/zürich/10", "log/zürich/2", "log/øst/9", "log/a", "log", "lo", "m"]
    keys = spark.createDataFrame([(k, "v") for k in names], "key string, value string")
    pages, after = [], None
    while True:
        page = [r.key for r in namespace.scanned(keys, "log/", after, 3).collect()]
        pages.append(page)
        if not page:
            break
        after = page[-1]
    assert pages == [["log/a", "log/zürich/1", "log/zürich/10"], ["log/zürich/2", "log/øst/9"], []]


def test_delimiter_folding(spark):
    names = [f"in/box-{i % 7}/{i}" for i in range(50)] + ["in/box", "in/box-", "out/x", "in/"]
    rows = spark.createDataFrame([("b", k, 1) for k in names], "bucket string, key string, content_length long")
    listed = namespace.entries(rows, "in/", "/")
    page = namespace.page(listed, "in/box-2/", 3).orderBy("entry").collect()
    assert [(r.entry, r.is_prefix, r.truncated) for r in page] == [("in/box-3/", True, True), ("in/box-4/", True, True), ("in/box-5/", True, True)]
    assert sorted(r.entry for r in listed.collect()) == sorted(["in/", "in/box", "in/box-"] + [f"in/box-{i}/" for i in range(7)])


def test_versions(spark):
    t = lambda i: dt.datetime(2024, 1, i)
    rows = spark.createDataFrame([("b", "doc.txt", "v1", t(1), False), ("b", "doc.txt", "v2", t(2), False), ("b", "doc.txt", "v3", t(3), True)], "bucket string, key string, version_id string, last_modified timestamp_ntz, is_delete_marker boolean")
    assert namespace.current(rows).count() == 0
    assert [r.version_id for r in namespace.with_latest_flag(rows).filter("is_latest").collect()] == ["v3"]
    assert [r.version_id for r in namespace.version_page(rows, "b", "doc.txt", "v2", 2).collect()] == ["v1"]
    assert [r.version_id for r in namespace.current(rows.filter("not is_delete_marker")).collect()] == ["v2"]


def test_multipart_etag(spark):
    body = "a" * 2500
    parts = [body[i : i + 1000] for i in range(0, 2500, 1000)]
    rows = multipart.sliced(spark.createDataFrame([("k", body), ("empty", "")], "key string, text string"), 1000)
    got = {r.key: r.etag for r in multipart.etag(rows).collect()}
    assert got["k"] == hashlib.md5(b"".join(hashlib.md5(p.encode()).digest() for p in parts)).hexdigest() + "-3"
    assert got["empty"].endswith("-1")


def test_part_order(spark):
    rows = spark.createDataFrame([("a", 1, 1, 9), ("a", 2, 2, 1), ("b", 1, 2, 9), ("b", 2, 1, 9), ("c", 1, 1, 1), ("c", 2, 2, 9)], "key string, pos int, part_no int, size long")
    got = {r.key: (r.in_order, r.large_enough) for r in multipart.checked(rows, 5).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (True, False)}


def test_policy(spark):
    one = lambda **x: json.dumps({"Statement": x})
    get = {"Effect": "Allow", "Principal": "*", "Action": "s3:Get*", "Resource": "*"}
    deny = {"Effect": "Deny", "Principal": "*", "Action": "s3:GetObject", "Resource": "*"}
    cases = {
        "scalars": (one(**get), "Allow"),
        "arrays": (json.dumps({"Statement": [get | {"Action": ["s3:Get*", 5], "Resource": ["x", "arn:aws:s3:::arrays/k"]}]}), "Allow"),
        "deny by a scalar": (json.dumps({"Statement": [get, deny]}), "Deny"),
        "deny first": (json.dumps({"Statement": [deny, get]}), "Deny"),
        "deny for others": (json.dumps({"Statement": [get, deny | {"Principal": {"AWS": ["ben", "eve"]}}]}), "Allow"),
        "deny for ann": (json.dumps({"Statement": [get, deny | {"Principal": {"AWS": "ann"}}]}), "Deny"),
        "no principal": (one(Effect="Allow", Action="*", Resource="*"), "Neutral"),
        "bare name": (one(**get | {"Resource": "bare name/*"}), "Allow"),
        "bucket only": (one(**get | {"Resource": "arn:aws:s3:::bucket only"}), "Neutral"),
        "other action": (one(**get | {"Action": "s3:Put*"}), "Neutral"),
        "odd signs": (one(**get | {"Action": "s3:Get_bject%"}), "Neutral"),
        "no effect": (one(Principal="*", Action="*", Resource="*"), "Neutral"),
        "lower case": (one(**get | {"Effect": "allow"}), "Allow"),
        "unreadable": ("{", "Deny"),
        "blank": (" ", "Neutral"),
        "no statement": ("{}", "Neutral"),
        "none": (None, "Neutral"),
    }
    asked = spark.createDataFrame([(b, "k", "s3:GetObject", "ann") for b in cases], "bucket string, key string, action string, principal string")
    policies = spark.createDataFrame([(b, p) for b, (p, _) in cases.items() if p is not None], "bucket string, policy_json string")
    got = {r.bucket: r.decision for r in policy.decide(asked, policies).collect()}
    assert got == {b: d for b, (_, d) in cases.items()}


def test_authorization(spark):
    allow = '{"Statement": {"Effect": "Allow", "Principal": "*", "Action": "*", "Resource": "*"}}'
    policies = spark.createDataFrame([("open", allow), ("shut", allow.replace("Allow", "Deny"))], "bucket string, policy_json string")
    keys = spark.createDataFrame([("reader", '{"Statement": {"Effect": "Allow", "Action": "s3:Get*", "Resource": "*"}}'), ("free", "")], "access_key string, key_policy string")
    cases = [("open", "s3:GetObject", False, False, None, False, "ok"), ("open", "s3:PutObject", False, False, None, True, "key required"), ("plain", "s3:GetObject", False, False, None, False, "key required"), ("plain", "s3:GetObject", True, False, "free", False, "bad signature"), ("plain", "s3:GetObject", True, True, "free", False, "ok"), ("shut", "s3:GetObject", True, True, "free", False, "denied by bucket policy"), ("plain", "s3:PutObject", True, True, "reader", False, "denied by key policy"), ("plain", "s3:GetObject", True, True, "reader", False, "ok"), (None, "s3:ListAllMyBuckets", True, True, "free", True, "ok"), (None, "s3:ListAllMyBuckets", False, False, None, True, "key required")]
    asked = spark.createDataFrame([(i, c[0], None if c[0] is None else "k", *c[1:6]) for i, c in enumerate(cases)], "i int, bucket string, key string, action string, signed boolean, valid boolean, access_key string, needs_key boolean")
    got = {r.i: r.outcome for r in policy.authorize(asked, policies, keys).collect()}
    assert got == {i: c[6] for i, c in enumerate(cases)}


def test_ranges(spark):
    rows = spark.createDataFrame([("bytes=0-3", 10), ("bytes=5-", 10), ("bytes=-4", 10), ("bytes=10-", 10), ("bytes=5-2", 10), ("none", 10), ("bytes=0-99", 10), ("bytes=99999999999999999999-", 10)], "h string, n long")
    got = [(r.first_byte, r.last_byte) for r in policy.byte_range(rows, "h", "n").collect()]
    assert got == [(0, 3), (5, 9), (6, 9), (None, None), (None, None), (None, None), (0, 9), (None, None)]


def test_scalars(spark):
    row = spark.range(1).select(F.lit(1536).cast("long").alias("n"), F.lit('"AbC"').alias("e"), F.lit("a/b/c.txt").alias("k")).select(scalar.bytes_text("n").alias("b"), scalar.etag("e").alias("e"), scalar.file_name("k").alias("f")).first()
    assert (row.b, row.e, row.f) == ("1.5 KB", "abc", "c.txt")


def test_usage_falls_back_to_the_largest(spark):
    active = spark.createDataFrame([], "bucket string, request_count long")
    used = spark.createDataFrame([("a", 1, 5), ("b", 2, 9)], "bucket string, object_count long, total_bytes long")
    assert [r.bucket for r in metrics.with_usage(active, used, 1).collect()] == ["b"]


def test_backoff(spark):
    rows = spark.createDataFrame([(i,) for i in (1, 2, 7, 20)], "attempts int").select(F.expr(integrity.backoff()).alias("s"))
    assert [r.s for r in rows.collect()] == [15, 30, 900, 900]


def test_erasure_survives_any_two_losses():
    data = bytes(range(256)) * 3 + b"tail"
    shards = erasure.encoded(data, 4, 2)
    for i in range(6):
        for j in range(i):
            assert erasure.decoded([None if x in (i, j) else s for x, s in enumerate(shards)], 4, 2, len(data)) == data
    assert erasure.decoded([None] * 3 + shards[3:], 4, 2, len(data)) is None


def test_signature(spark):
    row = spark.range(1).select(erasure.signature(F.lit("secret"), F.lit("20240101"), F.lit("r"), F.lit("text")).alias("s")).first()
    key = b"AWS4secret"
    for part in ("20240101", "r", "s3", "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    assert row.s == hmac.new(key, b"text", hashlib.sha256).hexdigest()


def test_rate_limit(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    log = spark.createDataFrame([(1, at(s)) for s in (0, 1, 2, 59, 60, 61)] + [(2, at(5))], "user_id long, occurred_at timestamp_ntz")
    got = {r.user_id: (r.requests, r.allowed, r.rejected) for r in requests.limited(log, 2, 60.0).collect()}
    assert got == {1: (6, 4, 2), 2: (1, 1, 0)}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from bucketscope.sources.adapters import ENTITIES, entity

    log = entity(spark, sf_dir, "request_log")
    source, columns = ENTITIES["request_log"]
    raw = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    raw.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events")).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    q = requests.hourly_stream(stream, "60 days").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("request_count")).first()[0] == log.count()
    assert spark.table("hours").count() == metrics.hourly_by_bucket(log).count()


def best_disks(objects, disks, copies, domains=0, least=0, percent=0):
    """Placement by brute force: {version_id: list of (disk_id, score)}, None without a place. disks: (id, node, domain, pool, total, available)."""
    digest = lambda *x: hashlib.sha256("|".join(("seed", *map(str, x))).encode()).hexdigest()[:16]
    out = {}
    for bucket, key, version, size in objects:
        fit = [(d, n, (f or "").strip() or n, p) for d, n, f, p, t, a in disks if a - size >= max(0, least, -(-t * percent // 100))]
        pools = [p for p in {x[3] for x in fit} if sum(x[3] == p for x in fit) >= copies and len({x[2] for x in fit if x[3] == p}) >= domains]
        if not pools:
            out[version] = None
            continue
        pool = min(pools, key=lambda p: (digest(bucket, key, version, p, "pool"), p))
        ranked = sorted((digest(bucket, key, version, "", f, n, d), n, d, f) for d, n, f, p in fit if p == pool)
        chosen = []
        for rule in (lambda n, f: f not in {x[3] for x in chosen} and n not in {x[1] for x in chosen}, lambda n, f: n not in {x[1] for x in chosen}, lambda n, f: True):
            for x in ranked:
                if len(chosen) < copies and x not in chosen and rule(x[1], x[3]):
                    chosen.append(x)
        out[version] = [(x[2], x[0]) for x in chosen]
    return out


def placements(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.replica or 0):
        out.setdefault(r.version_id, None if r.replica is None else []) if r.replica is None else out.setdefault(r.version_id, []).append((r.disk_id, r.score))
    return out


def test_placement_passes_pools_and_refusals(spark):
    objects = [("b", f"k{i}", f"v{i}", 10 * i) for i in range(20)]
    disks = [(1, "n1", "f1", "p1", 200, 100), (2, "n1", "f1", "p1", 200, 150), (3, "n2", "f1", "p1", 200, 190), (4, "n3", "f2", "p1", 200, 200), (5, "n3", "f2", "p1", 200, 90), (6, "n4", " ", "p2", 300, 200), (7, "n5", None, "p2", 300, 250), (8, "n5", None, "p2", 300, 120)]
    schema = "disk_id long, node_id string, fault_domain string, pool_id string, total_bytes long, available_bytes long, disk_status string, node_status string"
    rows = spark.createDataFrame([(*d, "Online", "Online") for d in disks] + [(9, "n9", "f9", "p1", 900, 900, "Offline", "Online")], schema)
    asked = spark.createDataFrame(objects, "bucket string, key string, version_id string, content_length long")
    for copies, domains, least, percent in ((1, 0, 0, 0), (2, 2, 10, 15), (3, 2, 0, 0), (5, 1, 0, 10), (9, 0, 0, 0)):
        got = placements(cluster.placed(asked, rows, "seed", copies, domains, least, percent).collect())
        assert got == best_disks(objects, disks, copies, domains, least, percent)


def test_placement_covers_every_object(spark, sf_dir):
    from bucketscope.plans import catalog
    from bucketscope.sources.adapters import entity

    objects = [tuple(r) for r in entity(spark, sf_dir, "object_versions").select("bucket", "key", "version_id", "content_length").collect()]
    disks = [tuple(r) for r in entity(spark, sf_dir, "disks").filter(cluster.ONLINE).select("disk_id", "node_id", "fault_domain", "pool_id", "total_bytes", "available_bytes").collect()]
    got = placements(catalog.queries()["placement_w04_w06_j15_p25"](spark, sf_dir).collect())
    assert got == best_disks(objects, disks, 2, 2, catalog.LEAST, catalog.PERCENT) and None in got.values()


def test_completing_uploads(spark):
    stored = [("u", 1, "aa", 9), ("u", 2, "bb", 9), ("u", 4, "cc", 1), ("v", 1, "aa", 1), ("v", 2, "bb", 9)]
    asked = {
        "u": [(1, '"AA"'), (2, "bb"), (4, "cc")],
        "v": [(1, "aa"), (2, "bb")],
        "w": [(1, "aa")],
    }
    rows = spark.createDataFrame(stored, "upload_id string, part_number int, etag string, size long")
    requested = lambda a: spark.createDataFrame([(u, i, n, e) for u, ps in a.items() for i, (n, e) in enumerate(ps)], "upload_id string, pos int, part_number int, etag string")
    got = {r.upload_id: r for r in multipart.completed(requested(asked), rows, 5).collect()}
    assert {u: r.outcome for u, r in got.items()} == {"u": "ok", "v": "EntityTooSmall", "w": "InvalidPart"}
    assert got["u"].etag == hashlib.md5(bytes.fromhex("aabbcc")).hexdigest() + "-3" and got["u"].content_length == 19 and got["v"].etag is None
    for parts, outcome in (([(2, "bb"), (1, "aa")], "InvalidPartOrder"), ([(1, "aa"), (1, "aa")], "InvalidPartOrder"), ([(1, "aa"), (2, "xx")], "InvalidPart"), ([(2, "bb")], "ok"), ([(1, "aa"), (3, "cc"), (4, "cc")], "InvalidPart")):
        done = multipart.completed(requested({"u": parts}), rows, 5)
        assert done.first().outcome == outcome
    left = multipart.left_over(requested({"u": [(2, "bb")]}), rows, multipart.completed(requested({"u": [(2, "bb")]}), rows, 5)).collect()
    assert sorted(r.part_number for r in left) == [1, 4]
    page = multipart.part_pages(rows.filter("upload_id = 'u'"), 1, 1).collect()
    assert [(r.part_number, r.truncated, r.next_marker) for r in page] == [(2, True, 2)]


def test_deleting_by_versioning(spark):
    t = lambda i: dt.datetime(2024, 1, i)
    rows = [("b", k, v, t(i), False) for k in ("by id", "by old id", "marked", "off", "unknown") for i, v in ((1, "v1"), (2, "v2"))]
    versions = spark.createDataFrame(rows, "bucket string, key string, version_id string, last_modified timestamp_ntz, is_delete_marker boolean")
    asked = [("by id", "v2", "Enabled"), ("by old id", "v1", "Off"), ("marked", None, "Enabled"), ("off", None, "Off"), ("unknown", "v9", "Enabled"), ("absent", None, "Off")]
    requests = spark.createDataFrame([("b", k, v, s, "m-" + k) for k, v, s in asked], "bucket string, key string, version_id string, versioning string, marker_id string")
    outcome, after = namespace.delete_objects(versions, requests, "2024-02-01 00:00:00")
    got = {r.key: (r.version_id, r.is_delete_marker, r.found) for r in outcome.collect()}
    assert got == {"by id": ("v2", False, True), "by old id": ("v1", False, True), "marked": ("m-marked", True, True), "off": (None, False, True), "unknown": ("v9", False, False), "absent": (None, False, False)}
    left = {(r.key, r.version_id): r.is_current for r in after.collect()}
    assert left == {("by id", "v1"): True, ("by old id", "v2"): True, ("marked", "v1"): False, ("marked", "v2"): False, ("marked", "m-marked"): True, ("off", "v1"): False, ("unknown", "v1"): False, ("unknown", "v2"): True}


def test_copy_sources(spark):
    heads = {"/b/a%2Fc%20d+e?versionId=v1": ("b", "a/c d+e", "v1"), "b/k": ("b", "k", None), "b": (None, None, None), "b/": (None, None, None), "/b/%zz": (None, None, None)}
    got = {r.h: (r.source_bucket, r.source_key, r.source_version) for r in namespace.copy_source(spark.createDataFrame([(h,) for h in heads], "h string"), "h").collect()}
    assert got == heads
