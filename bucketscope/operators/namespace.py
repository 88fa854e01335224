"""The namespace: log replay, current objects, listings with prefix and delimiter, version pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replayed(mutations: DataFrame, *order: str) -> DataFrame:
    """key, value of the last mutation of each key that is not a delete; combines before the shuffle."""
    last = mutations.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), F.struct(*order)).alias("m"))
    return last.filter("not m.deleted").select("key", "m.value")


def scanned(state: DataFrame, prefix: str, after: str | None, limit: int) -> DataFrame:
    """Keys with a prefix behind a cursor, in order; the prefix reaches the scan as a filter."""
    rows = state.filter(F.col("key").startswith(prefix))
    if after is not None:
        rows = rows.filter(F.col("key") > after)
    return rows.orderBy("key").limit(max(1, limit))


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each key (ties: greatest id), delete markers included."""
    rest = [c for c in versions.columns if c not in ("bucket", "key")]
    last = versions.groupBy("bucket", "key").agg(F.max_by(F.struct(*rest), F.struct("last_modified", "version_id")).alias("v"))
    return last.select("bucket", "key", "v.*")


def current(versions: DataFrame) -> DataFrame:
    return latest(versions).filter("not is_delete_marker")


def entries(objects: DataFrame, prefix: str, delimiter: str) -> DataFrame:
    """A listing: keys, and the common prefixes that stand for all keys beyond the next delimiter."""
    rows = objects.filter(F.col("key").startswith(prefix)).withColumn("rest", F.expr(f"substr(key, {len(prefix) + 1})"))
    folded = F.col("rest").contains(delimiter) if delimiter else F.lit(False)
    name = F.when(folded, F.concat(F.lit(prefix), F.substring_index("rest", delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
    return rows.groupBy("bucket", name.alias("entry"), folded.alias("is_prefix")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("content_length").alias("total_bytes"))


def page(listed: DataFrame, after: str, most: int) -> DataFrame:
    """One page of entries behind a cursor, with a flag whether more follow; reads one entry more than it returns."""
    most = max(1, min(most, 1000))
    rows = listed.filter(F.col("entry") > after).orderBy("entry").limit(most + 1)
    numbered = rows.withColumn("rn", F.row_number().over(Window.orderBy("entry")))  # most + 1 rows
    return numbered.withColumn("truncated", F.max("rn").over(Window.partitionBy()) > most).filter(F.col("rn") <= most).drop("rn")


def with_latest_flag(versions: DataFrame) -> DataFrame:
    """Versions with is_latest, by a join with the latest of each key."""
    top = latest(versions).select("bucket", "key", F.col("version_id").alias("top"))
    return versions.join(top, ["bucket", "key"]).withColumn("is_latest", F.col("version_id") == F.col("top")).drop("top")


def version_rank(versions: DataFrame) -> DataFrame:
    """rn: place of a version within its key, the newest first."""
    order = Window.partitionBy("bucket", "key").orderBy(F.desc("last_modified"), "version_id")
    return versions.withColumn("rn", F.row_number().over(order))


def version_page(versions: DataFrame, bucket: str, key_marker: str, version_marker: str, most: int) -> DataFrame:
    """The page behind (key, version); an unknown version skips its key."""
    ranked = version_rank(versions.filter(F.col("bucket") == bucket).filter(F.col("key") >= key_marker))
    at = ranked.filter((F.col("key") == key_marker) & (F.col("version_id") == version_marker)).select(F.col("rn").alias("mark"))
    behind = ranked.join(F.broadcast(at.agg(F.max("mark").alias("mark"))), how="inner")  # one row
    rows = behind.filter((F.col("key") > key_marker) | ((F.col("key") == key_marker) & (F.col("rn") > F.col("mark"))))
    return rows.orderBy("key", F.desc("last_modified"), "version_id").limit(most).drop("mark")


def noncurrent(versions: DataFrame) -> DataFrame:
    return versions.join(current(versions).select("bucket", "key", "version_id"), ["bucket", "key", "version_id"], "left_anti")


def folded_page(rows: DataFrame, prefix: str, delimiter: str, most: int, *order: str) -> DataFrame:
    """One page of rows in order (its first column is the key), with folding: entry, is_prefix, the order's columns, truncated, next_*.

    Keys with the delimiter behind the prefix count once, as their common prefix, at the place of the
    first of them. The next markers are the last returned entry's, null on the last page.
    """
    most = 1000 if most <= 0 else min(most, 1000)
    rest = F.expr(f"substr(key, {len(prefix) + 1})")
    folded = rest.contains(delimiter) if delimiter else F.lit(False)
    entry = F.when(folded, F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
    kept = rows.filter(F.col("key").startswith(prefix)).withColumn("entry", entry).withColumn("is_prefix", folded)
    single = F.when(~F.col("is_prefix"), F.struct(*order))
    first = kept.groupBy("entry", "is_prefix", single.alias("own")).agg(F.min(F.struct(*order)).alias("at")).orderBy("at").limit(most + 1)
    by = Window.orderBy("at")  # most + 1 rows
    page = first.withColumn("rn", F.row_number().over(by)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > most).filter(F.col("rn") <= most)
    last = F.max("at").over(Window.partitionBy())
    return page.withColumn("last", F.when(F.col("truncated"), last)).select("entry", "is_prefix", *[F.col(f"at.{c}") for c in order], "truncated", *[F.col(f"last.{c}").alias(f"next_{c}") for c in order])


def delete_objects(versions: DataFrame, requests: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Outcome of deletions, at most one for each key, and the versions afterwards with ``is_current``.

    requests: bucket, key, version_id (null: the current one), versioning of the bucket, marker_id.
    With a version that version goes, and the newest of the rest becomes current if it was. Without
    one, where versioning is enabled, a marker becomes current; else the current version goes and
    the key has none, whatever older versions are left. What is not there counts as deleted.
    """
    key = ["bucket", "key"]
    top = latest(versions).select(*key, F.col("version_id").alias("top"))
    asked = requests.withColumnRenamed("version_id", "asked").join(top, key, "left")
    gone_id = F.when(F.col("asked").isNotNull(), F.col("asked")).when(F.col("versioning") != "Enabled", F.col("top"))
    asked = asked.withColumn("gone", gone_id).withColumn("marks", F.expr("asked is null and versioning = 'Enabled'"))
    there = versions.select(*key, F.col("version_id").alias("gone"), F.col("is_delete_marker").alias("was_marker"))
    found = asked.join(there, [*key, "gone"], "left")
    outcome = found.select(*key, "asked", F.when(F.col("marks"), F.col("marker_id")).otherwise(F.col("asked")).alias("version_id"), F.when(F.col("marks"), True).otherwise(F.col("asked").isNotNull() & F.coalesce("was_marker", F.lit(False))).alias("is_delete_marker"), (F.col("marks") | F.col("was_marker").isNotNull()).alias("found"))

    rest = versions.join(asked.filter("gone is not null").select(*key, F.col("gone").alias("version_id")), [*key, "version_id"], "left_anti")
    made = {"bucket": F.col("bucket"), "key": F.col("key"), "version_id": F.col("marker_id"), "last_modified": F.expr(f"timestamp_ntz'{now}'"), "is_delete_marker": F.lit(True)}
    markers = asked.filter("marks").select(*[(made[c] if c in made else F.lit(None).cast(t)).cast(t).alias(c) for c, t in versions.dtypes])
    after = rest.unionByName(markers)
    # Keys whose pointer went with the current version.
    none = asked.filter("asked is null and not marks and top is not null").select(*key)
    new = latest(after).select(*key, F.col("version_id").alias("top")).join(none, key, "left_anti")
    return outcome, after.join(new, key, "left").withColumn("is_current", F.coalesce(F.col("version_id") == F.col("top"), F.lit(False))).drop("top")


def copy_source(rows: DataFrame, header: str) -> DataFrame:
    """rows with source_bucket, source_key and source_version of a copy's source header; null where it names no key."""
    text = f"if(startswith({header}, '/'), substr({header}, 2), {header})"
    path, version = f"regexp_replace({text}, '[?]versionId=[^?]*$', '')", f"nullif(regexp_extract({header}, '[?]versionId=([^?]*)$', 1), '')"
    decoded = lambda x: F.expr(f"try_url_decode(replace({x}, '+', '%2B'))")
    out = rows.withColumn("source", decoded(path))
    at = F.instr("source", "/")
    ok = (at > 1) & (at < F.length("source"))
    key = F.when(ok, F.expr("substr(source, instr(source, '/') + 1)"))
    return out.select(*rows.columns, F.when(ok, F.substring_index("source", "/", 1)).alias("source_bucket"), key.alias("source_key"), F.when(ok, decoded(version)).alias("source_version"))
