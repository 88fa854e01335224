"""Multipart uploads: splitting, order and size checks, offsets, combined ETag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split(objects: DataFrame, part: int) -> DataFrame:
    """key, part_no, offset, length of every part of objects (key, size)."""
    rows = objects.select("key", "size", F.explode(F.expr(f"sequence(1, cast(greatest(1, ceil(size / {part})) as int))")).alias("part_no"))
    return rows.select("key", "part_no", ((F.col("part_no") - 1) * F.lit(part)).cast("long").alias("offset"), F.expr(f"least({part}, size - (part_no - 1) * {part})").cast("long").alias("length"))


def sliced(objects: DataFrame, part: int) -> DataFrame:
    """key, part_no, md5, size of fixed slices of texts (key, text); slices are cut within the row, so a text travels once."""
    n = f"greatest(1, cast(ceil(length(text) / {part}) as int))"
    rows = objects.select("key", F.posexplode(F.expr(f"transform(sequence(1, {n}), i -> substring(text, (i - 1) * {part} + 1, {part}))")).alias("at", "body"))
    return rows.select("key", (F.col("at") + 1).alias("part_no"), F.md5("body").alias("md5"), F.length("body").cast("long").alias("size"))


def etag(parts: DataFrame) -> DataFrame:
    """md5 of the parts' binary digests in order, and their number."""
    rows = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part_no", "md5"))).alias("p"), F.sum("size").alias("content_length"))
    joined = F.md5(F.unhex(F.array_join(F.col("p.md5"), "")))
    return rows.select("key", F.concat(joined, F.lit("-"), F.size("p").cast("string")).alias("etag"), "content_length")


def offsets(parts: DataFrame) -> DataFrame:
    before = Window.partitionBy("key").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("key", "part_no", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


def checked(parts: DataFrame, least: int) -> DataFrame:
    """Is each upload's list strictly ascending, and all parts but the last large enough? parts: key, pos, part_no, size."""
    by = Window.partitionBy("key").orderBy("pos", "part_no", "size")
    rows = parts.withColumn("ok", F.coalesce(F.col("part_no") > F.lag("part_no").over(by), F.lit(True)))
    rows = rows.withColumn("last", F.row_number().over(by) == F.count(F.lit(1)).over(Window.partitionBy("key")))
    return rows.groupBy("key").agg(F.bool_and("ok").alias("in_order"), F.bool_and(F.col("last") | (F.col("size") >= least)).alias("large_enough"), F.count(F.lit(1)).alias("parts"))


def part_pages(parts: DataFrame, marker: int, most: int) -> DataFrame:
    """The page of each upload's parts behind a part number, with ``truncated`` and ``next_marker`` (0 on the last page). An upload has at most 10,000 parts by the protocol."""
    most = 1000 if most <= 0 else min(most, 1000)
    by = Window.partitionBy("upload_id").orderBy("part_number", "size")
    rows = parts.filter(F.col("part_number") > max(0, marker)).withColumn("rn", F.row_number().over(by)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("upload_id")))
    rows = rows.filter(F.col("rn") <= most).withColumn("truncated", F.col("n") > most)
    return rows.withColumn("next_marker", F.when(F.col("truncated"), F.max("part_number").over(Window.partitionBy("upload_id"))).otherwise(0)).drop("rn", "n")


def completed(requested: DataFrame, stored: DataFrame, least: int) -> DataFrame:
    """upload_id, outcome, etag, content_length, parts of requests to complete (upload_id, pos, part_number, etag) from stored parts (upload_id, part_number, etag, size).

    The first thing that is wrong, in the order asked, is the outcome: parts out of order before
    all else, then a part that is not stored with that etag, or one too small that is not the last.
    """
    given = stored.select("upload_id", "part_number", F.col("etag").alias("own"), "size")
    rows = requested.withColumn("etag", F.expr("lower(trim(both '\"' from trim(etag)))")).join(given, ["upload_id", "part_number"], "left")
    asked = rows.groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("pos", "part_number", "etag", "own", "size"))).alias("p"))
    ordered = "forall(sequence(1, size(p)), i -> i = 1 or p[i - 1].part_number > get(p, i - 2).part_number)"
    wrong = f"filter(transform(p, (x, i) -> case when x.own is null or lower(x.own) <> x.etag then 'InvalidPart' when i < size(p) - 1 and x.size < {least} then 'EntityTooSmall' end), e -> e is not null)"
    out = asked.withColumn("outcome", F.expr(f"case when not {ordered} then 'InvalidPartOrder' else coalesce(get({wrong}, 0), 'ok') end"))
    ok = F.col("outcome") == "ok"
    digest = F.concat(F.md5(F.unhex(F.array_join("p.own", ""))), F.lit("-"), F.size("p").cast("string"))
    total = F.expr("aggregate(p, 0L, (a, x) -> a + x.size)")
    return out.select("upload_id", "outcome", F.when(ok, digest).alias("etag"), F.when(ok, total).alias("content_length"), F.when(ok, F.size("p")).alias("parts"))


def left_over(requested: DataFrame, stored: DataFrame, done: DataFrame) -> DataFrame:
    """Stored parts of completed uploads that the request did not name: their files go."""
    ended = stored.join(done.filter("outcome = 'ok'").select("upload_id"), "upload_id", "left_semi")
    return ended.join(requested.select("upload_id", "part_number").distinct(), ["upload_id", "part_number"], "left_anti")


def abandoned(uploads: DataFrame, parts: DataFrame, before: str) -> DataFrame:
    """Uploads initiated before a time (strictly), with how many parts and bytes go with them."""
    old = uploads.filter(F.expr(f"initiated_at < timestamp_ntz'{before}'"))
    held = parts.groupBy("upload_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("bytes"))
    return old.join(held, "upload_id", "left").select(*[F.col(c) for c in uploads.columns], F.coalesce("parts", F.lit(0)).cast("long").alias("parts"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
