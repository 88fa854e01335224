"""Records by key, on small inputs of our own."""

from pyspark.sql import functions as F

from bucketscope.operators import metrics, records


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first().out


def test_store_keys_go_there_and_back(spark):
    for text in ("", "a:b", "ключ/ü", "%00"):
        key = one(spark, records.store_key("o", "a", "b"), a="wide", b=text)
        assert key.count(":") == 2
        assert one(spark, records.key_part("k", 2), k=key) == text
    assert one(spark, records.key_part("k", 3), k="o:61:62") is None


def test_key_names(spark):
    cases = {"a": True, "": False, None: False, "é" * 512: True, "é" * 512 + "x": False, "a\u0085b": False, "a\x7f": False, "a\tb": False, "a b%": True}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "k string, want boolean")
    assert rows.filter(records.valid_key("k") != F.col("want")).count() == 0


def test_shard_paths(spark):
    cases = {
        "objects/q/1": "ok",
        "objects/..q/1": "ok",
        " objects/q/1 ": "ok",
        "objects/q/../1": "traversal",
        "/objects/q": "not relative",
        "": "not relative",
        "objects/q/xl.META": "not a data file",
        "objectsq/1": "not a data file",
    }
    for path, want in cases.items():
        assert one(spark, records.shard_path("p"), p=path) == want


def test_escapes(spark):
    assert one(spark, records.percent_encoded("x"), x="a b*~/ü+%") == "a%20b%2A~%2F%C3%BC%2B%25"
    assert one(spark, records.xml_unescaped("x"), x="&amp;lt;&lt;&quot;&apos;&gt;") == "&lt;<\"'>"
    pairs = "array(named_struct('name', 'b', 'value', '2'), named_struct('name', 'a b', 'value', ''), named_struct('name', 'b', 'value', '1'))"
    assert spark.range(1).select(F.expr(pairs).alias("p")).select(records.canonical_query("p").alias("q")).first().q == "a%20b=&b=1&b=2"


def test_lenient_json(spark):
    assert one(spark, records.json_long("d", 5, "N", "n"), d='{"n": "8"}') == 8
    assert one(spark, records.json_long("d", 5, "N", "n"), d='{"n": "99999999999999999999"}') == 5
    assert one(spark, records.json_long("d", 5, "N", "n"), d="{") == 5
    assert one(spark, records.heal_status("s", "n"), s=None, n=3) == "Pending"
    assert one(spark, records.heal_status("s", "n"), s="queued", n=3) == "RetryScheduled"


def test_lookup_of_markers_and_repeats(spark):
    versions = spark.createDataFrame([("b", "k", "1", "e1", False), ("b", "k", "2", "e2", True)], "bucket string, key string, version_id string, etag string, is_delete_marker boolean")
    asked = spark.createDataFrame([("b", "k", "1"), ("b", "k", "1"), ("b", "k", "2"), ("b", "k", None), ("b", "k", " ")], "bucket string, key string, asked string")
    got = records.found(asked, versions, versions.limit(0)).collect()
    assert sorted((r.asked or "", r.outcome) for r in got) == [("", "NoSuchKey"), (" ", "NoSuchKey"), ("1", "ok"), ("1", "ok"), ("2", "NoSuchVersion")]


def test_ranges_over_parts(spark):
    parts = spark.createDataFrame([("u", 1, 10), ("u", 2, 0), ("u", 3, 5)], "upload_id string, part_number int, size long")
    for first, last, want in ((0, 9, [(1, 0, 10)]), (9, 10, [(1, 9, 1), (3, 0, 1)]), (14, 99, [(3, 4, 1)]), (15, 20, [])):
        got = records.parts_of_range(parts, spark.createDataFrame([("u", first, last)], "upload_id string, first_byte long, last_byte long"))
        assert sorted((r.part_number, r.skip, r.length) for r in got.collect()) == want


def test_overlap_across_hours(spark):
    rows = [("b", f"2024-01-01 {t}", i) for i, t in enumerate(("00:55:00", "00:59:59", "01:00:30", "01:05:00", "03:00:00"))]
    log = spark.createDataFrame(rows, "bucket string, t string, event_id long").selectExpr("bucket", "cast(t as timestamp_ntz) as occurred_at", "event_id")
    assert [tuple(r) for r in metrics.peak_overlap(log, 600).collect()] == [("b", 3)]
