"""Sharding by extendible hashing, with DataFrame functions only.

A document's key is 60 bits of md5(doc_id / md5(text)). A directory indexed by the first bits
of the key holds the buckets; only a bucket over the byte limit splits on another bit, until
every shard fits. One level of the directory is summed at a depth a little beyond what even
keys need and rolled up; the few cells that are still too large get a deeper directory of
their own, so a heavy spot never doubles the whole directory.

Rows that are equal in key cannot be told apart by any bit: beyond the last bit they are counted
and dealt out by number, as many to a shard as fit. A single document over the limit is a shard
by itself. Null ids and texts count as empty; empty texts have no bytes; an empty table gives an
empty table; repeated rows are rows like others; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.llm.tables import stored, table

#: Most bytes of text in a shard.
SHARD_BYTES = 1 << 20
BITS = 60
#: Bits beyond those that even keys need in the first level, and of each further level.
SPARE, STEP = 3, 6
#: Directory cells that are broadcast; a larger directory is joined by shuffle.
BROADCAST_CELLS = 200_000


def key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.expr(f"cast(conv(substr(md5(concat(coalesce(cast({doc_id} as string), ''), '/', md5(coalesce({text}, '')))), 1, 15), 16, 10) as bigint)")


def _prefix(depth: int | Column) -> Column:
    return F.expr(f"shiftrightunsigned(h, {BITS - depth})") if isinstance(depth, int) else F.shiftrightunsigned("h", depth)


def _bits(prefix: str, depth: str) -> Column:
    return F.expr(f"case when {depth} = 0 then '' else lpad(conv({prefix}, 10, 2), {depth}, '0') end")


def _level(rows: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """cell (key's first `depth` bits), leaf depth, bytes and docs of its bucket; depth is null where even the cell is too large."""
    cells = rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    nodes = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("d"))
    nodes = nodes.groupBy("d", F.expr(f"shiftrightunsigned(cell, {depth} - d)").alias("p")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    fits = nodes.filter((F.col("bytes") <= limit) | (F.col("docs") == 1))
    # The bucket of a cell is the least deep node above it that fits.
    above = cells.select("cell", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftrightunsigned(cell, {depth} - d)"))
    leaf = above.join(fits, ["d", "p"]).groupBy("cell").agg(F.min_by(F.struct("d", "p", "bytes", "docs"), "d").alias("leaf"))
    return cells.select("cell").join(leaf, "cell", "left").select("cell", F.col("leaf.d").alias("depth"), F.col("leaf.p").alias("p"), F.col("leaf.bytes").alias("shard_bytes"), F.col("leaf.docs").alias("shard_docs"))


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, h, shard, depth, shard_bytes, shard_docs: a row for each row of docs."""
    rows = stored(docs.select("doc_id", key().alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b")))
    total = rows.agg(F.sum("b")).first()[0] or 0
    top, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    done = None
    while True:
        cells = stored(_level(rows, top, depth, limit))
        # A directory of proven size is broadcast.
        lookup = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
        found = rows.withColumn("cell", _prefix(depth)).join(lookup, "cell")
        part = found.filter("depth is not null").select("doc_id", "h", _bits("p", "depth").alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")
        done = part if done is None else done.union(part)
        if not cells.filter("depth is null").limit(1).count():
            return done
        rows = found.filter("depth is null").select("doc_id", "h", "b")
        if depth == BITS:
            return done.union(_dealt(rows, limit))
        rows = stored(rows)
        top, depth = depth, min(BITS, depth + STEP)


def _dealt(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal keys, counted and numbered anew: equal rows can take each other's place."""
    same = rows.groupBy("doc_id", "h", "b").agg(F.count(F.lit(1)).alias("k")).withColumn("each", F.expr(f"greatest(1, {limit} div greatest(1, b))"))
    out = same.withColumn("piece", F.explode(F.expr("sequence(0, (k - 1) div each)"))).withColumn("shard_docs", F.expr("least(each, k - piece * each)"))
    out = out.withColumn("i", F.explode(F.expr("sequence(1, shard_docs)")))
    name = F.concat_ws("-", F.expr(f"lpad(conv(h, 10, 2), {BITS}, '0')"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string"))
    return out.select("doc_id", "h", name.alias("shard"), F.lit(BITS).alias("depth"), (F.col("b") * F.col("shard_docs")).alias("shard_bytes"), "shard_docs")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents")).drop("h")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS b,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
n AS (SELECT k.depth, d.h >> ({BITS} - k.depth) AS p, sum(b) AS bytes, count(*) AS docs
      FROM d, (SELECT unnest(range(0, 31)) AS depth) k GROUP BY 1, 2),
f AS (SELECT d.doc_id, d.h, n.depth, n.p, n.bytes, n.docs, row_number() OVER (PARTITION BY d.h, d.doc_id ORDER BY n.depth) AS r
      FROM d JOIN n ON n.p = d.h >> ({BITS} - n.depth) AND (n.bytes <= {SHARD_BYTES} OR n.docs = 1))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(bytes AS BIGINT) AS shard_bytes, CAST(docs AS BIGINT) AS shard_docs
FROM f WHERE r = 1
"""
