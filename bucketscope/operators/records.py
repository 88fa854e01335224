"""Records by key: lookups, keys of the store's namespaces, names and paths that are allowed, statuses, settings read leniently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.functions import scalar

#: The longest key in bytes of UTF-8, and the least and greatest limit of an upload.
KEY_BYTES = 1024
UPLOAD_LIMITS = (1 << 20, 5 << 40)
#: Response headers that a bucket may set.
HEADERS = ("cache-control", "content-disposition", "content-language", "expires")


def store_key(namespace: str, *parts: str) -> Column:
    """The namespace, then each part as lower-case hex of its UTF-8, joined by colons: keys sort by bytes, whatever they hold."""
    return F.concat_ws(":", F.lit(namespace), *map(scalar.hexed, parts))


def key_part(key: str, n: int) -> Column:
    """Part n of a store key (the namespace is part 0), as text again; null if there is none."""
    return F.expr(f"decode(unhex(get(split({key}, ':'), {n})), 'UTF-8')")


def found(requests: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """The requests (bucket, key, asked) with etag and outcome. A blank version asks for the current object; a delete marker is as good as nothing."""
    blank = F.expr("coalesce(trim(asked), '') = ''")
    own = versions.filter("not is_delete_marker").select("bucket", "key", F.col("version_id").alias("asked"), "etag")
    top = current.select("bucket", "key", "etag")
    by_version = requests.filter(~blank).join(own, ["bucket", "key", "asked"], "left").withColumn("none", F.lit("NoSuchVersion"))
    by_key = requests.filter(blank).join(top, ["bucket", "key"], "left").withColumn("none", F.lit("NoSuchKey"))
    return by_version.unionByName(by_key).withColumn("outcome", F.when(F.col("etag").isNull(), F.col("none")).otherwise("ok")).drop("none")


def created(requests: DataFrame, buckets: DataFrame) -> DataFrame:
    """bucket, outcome: a bucket that exists, or that an earlier request (least ``seq``) makes, is a conflict."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("bucket").orderBy("seq")) == 1
    known = buckets.select("bucket", F.lit(True).alias("known"))
    rows = requests.withColumn("first", first).join(known, "bucket", "left")
    return rows.select("seq", "bucket", F.when(F.col("known").isNull() & F.col("first"), "created").otherwise("BucketAlreadyExists").alias("outcome"))


def deleted(requests: DataFrame, buckets: DataFrame, versions: DataFrame, uploads: DataFrame) -> DataFrame:
    """bucket, outcome: versions, markers and unfinished uploads alike keep a bucket."""
    full = versions.select("bucket").unionByName(uploads.select("bucket")).distinct().withColumn("full", F.lit(True))
    rows = requests.join(buckets.select("bucket", F.lit(True).alias("known")), "bucket", "left").join(full, "bucket", "left")
    return rows.select("bucket", F.when(F.col("known").isNull(), "NoSuchBucket").when(F.col("full"), "BucketNotEmpty").otherwise("deleted").alias("outcome"))


def valid_key(key: str) -> Column:
    """Not empty, at most 1,024 bytes, no control characters."""
    return F.expr(rf"coalesce({key} <> '' and octet_length({key}) <= {KEY_BYTES} and not {key} rlike '[\\x00-\\x1F\\x7F-\\x9F]', false)")


def shard_path(path: str) -> Column:
    """'ok', or what is wrong with a data file's path."""
    p = f"trim(coalesce({path}, ''))"
    return F.expr(
        f"case when {p} = '' or startswith({p}, '/') then 'not relative' when array_contains(split({p}, '/'), '..') then 'traversal' "
        f"when not startswith({p}, 'objects/') or lower(element_at(split({p}, '/'), -1)) = 'xl.meta' then 'not a data file' else 'ok' end"
    )


def versioning_status(x: str) -> Column:
    return F.expr(f"case lower({x}) when 'enabled' then 'Enabled' when 'suspended' then 'Suspended' else 'Off' end")


def heal_status(status: str, attempts: str) -> Column:
    """An unknown status of an item that was tried counts as scheduled again."""
    return F.expr(f"case when lower({status}) = 'failed' then 'Failed' when lower({status}) = 'retryscheduled' then 'RetryScheduled' when {attempts} > 0 and trim(coalesce({status}, '')) <> '' then 'RetryScheduled' else 'Pending' end")


def json_field(doc: str, *names: str) -> Column:
    """The first of several names that a JSON document has, as text."""
    return F.coalesce(*[F.get_json_object(doc, f"$.{n}") for n in names])


def json_long(doc: str, default: int, *names: str) -> Column:
    """A whole number, given as one or as text; the default if it is neither."""
    return F.coalesce(json_field(doc, *names).try_cast("long"), F.lit(default))


def percent_encoded(x: str) -> Column:
    """Unreserved characters (letters, digits, - . _ ~) stay, all other bytes are percent-encoded."""
    return F.expr(f"replace(replace(replace(url_encode({x}), '+', '%20'), '*', '%2A'), '%7E', '~')")


def canonical_query(pairs: str) -> Column:
    """Pairs (an array of name, value) encoded, sorted by name and value, joined."""
    encoded = F.transform(F.col(pairs), lambda p: F.struct(percent_encoded_column(p["name"]).alias("name"), percent_encoded_column(p["value"]).alias("value")))
    return F.array_join(F.transform(F.array_sort(encoded), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")


def percent_encoded_column(x: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def xml_escaped(x: str) -> Column:
    return F.expr(f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")


def xml_unescaped(x: str) -> Column:
    """The ampersand last, so that nothing is read twice."""
    return F.expr(f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '\\''), '&amp;', '&')")


def parts_of_range(parts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Which bytes of which parts a range (first_byte, last_byte) of a composite object touches. parts: upload_id, part_number, size."""
    from pyspark.sql import Window

    before = Window.partitionBy("upload_id").orderBy("part_number", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = placed.join(ranges, "upload_id").filter("size > 0 and start <= last_byte and start + size > first_byte")
    return rows.select("upload_id", "part_number", F.expr("greatest(first_byte - start, 0)").alias("skip"), F.expr("least(last_byte, start + size - 1) - greatest(first_byte, start) + 1").alias("length"))
