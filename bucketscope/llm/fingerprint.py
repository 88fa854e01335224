"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest 64-bit hashes of a document's distinct five-word shingles, so a
document of at most k shingles is kept exactly. Sketches of parts merge into the sketch of the
whole, and two sketches estimate resemblance, containment and the distinct shingle count.

Null and empty texts have the empty sketch; two empty sketches are alike (1), an empty one is
unlike any other (0). Texts of fewer than five words have one shingle. Very long texts are
hashed whole, piece by piece. Equal texts have equal sketches, repeated rows repeated results.
Extra columns pass through ``fingerprints``; a column named ``fingerprint`` is replaced. An
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketscope.llm.columnar import shingle_rows, slices
from bucketscope.llm.tables import table

#: Hashes kept; the standard error of a resemblance is at most 0.5 / sqrt(K).
K = 256


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(hashes)[:k]


def packed(sketch: np.ndarray) -> str:
    """Text form: base64 of the sorted hashes, little-endian."""
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def unpacked(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), "<u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index; exact if both sketches hold fewer than k hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)
    if len(a) >= k or len(b) >= k:  # beyond k of the union a full sketch says nothing
        union = union[:k]
        both = both[both <= union[-1]]
    return len(both) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct(merged(a, b, k), k) / distinct(a, k))


def sketches(column: pa.Array, k: int = K) -> list[np.ndarray]:
    return [bottom(h, k) for _, data, offsets in slices(column) for h in shingle_rows(data, offsets)]


def fingerprints(docs: DataFrame, k: int = K, text: str = "text") -> DataFrame:
    """docs with ``fingerprint string``."""

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([packed(s) for s in sketches(pa.array(column, pa.large_string()), k)])

    return docs.drop("fingerprint").withColumn("fingerprint", of(F.col(text)))


def merge_fingerprints(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """One fingerprint for each key (null is a key): the k smallest hashes of all its parts.

    Each task first merges what it holds, so that a key sends few sketches from a task; then
    the rows of a key follow each other and are merged one by one.
    """

    def combine(ordered: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[object, np.ndarray] = {}
            kind = None

            def out() -> pa.RecordBatch:
                rows = pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([packed(x) for x in held.values()], pa.string())], [key, "fingerprint"])
                held.clear()
                return rows

            for b in batches:
                kind = b.schema.field(0).type
                for x, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if len(held) >= 10_000 and (not ordered or x not in held):
                        yield out()
                    held[x] = merged(held.get(x, np.zeros(0, np.uint64)), unpacked(p), k)
            if held:
                yield out()

        return run

    schema = T.StructType([T.StructField(key, prints.schema[key].dataType), T.StructField("fingerprint", T.StringType())])
    parts = prints.select(key, "fingerprint").mapInArrow(combine(False), schema)
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(combine(True), schema)


def likeness(prints: DataFrame, a: str = "a", b: str = "b", k: int = K) -> DataFrame:
    """prints with ``resemblance``, ``containment`` (of a in b) and ``distinct`` (of a) from fingerprint columns a and b."""

    @F.pandas_udf("resemblance double, containment double, distinct double")
    def of(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(unpacked(p), unpacked(q)) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame({"resemblance": [resemblance(p, q, k) for p, q in rows], "containment": [containment(p, q, k) for p, q in rows], "distinct": [distinct(p, k) for p, _ in rows]})

    found = prints.select(F.struct("*").alias("row"), of(F.col(a), F.col(b)).alias("like"))
    return found.select(*[F.col(f"row.`{c}`") for c in prints.columns if c not in ("resemblance", "containment", "distinct")], "like.*")


_LEAST = -(1 << 63)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows (part, extra, doc_id, text): parts are runs of ids; the first row after a run comes again at its end, as extra.

    The bounds are at most one for each shuffle partition, so what the driver reads is small.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)] or [0.5], F.lit(10 * n))).first()[0]
    bounds = np.unique(np.array(cuts or [0], np.int64))

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(np.int64), "left").astype(np.int32))

    firsts = sorted((r["first"], r["part"]) for r in ids.groupBy(part_of("doc_id").alias("part")).agg(F.min("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][1] for i, (first, _) in enumerate(firsts)}
    known = np.array([f for f, _ in firsts] or [0], np.int64)
    behind = np.array([before.get(int(f), 0) for f in known], np.int32)

    @F.pandas_udf("array<int>")
    def homes(x: pd.Series) -> pd.Series:
        v = x.to_numpy(np.int64)
        own = np.searchsorted(bounds, v, "left").astype(np.int32)
        at = np.minimum(np.searchsorted(known, v), len(known) - 1)
        return pd.Series([[o, b] if f else [o] for o, b, f in zip(own.tolist(), behind[at].tolist(), (known[at] == v).tolist(), strict=True)])

    placed = docs.select("doc_id", "text").withColumn("order", F.coalesce("doc_id", F.lit(_LEAST)))
    rows = placed.select("doc_id", "order", "text", F.posexplode(homes("order")).alias("extra", "part"))
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", "order", "text")


def edited(own: str, following: str) -> str:
    """own with its last half replaced by as many code points of the start of following."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def neighbour_likeness(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document against an edited text of it and against the next document, by ascending doc_id (nulls first, ties by text).

    The last document's next is the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int, object, str, np.ndarray] | None = None  # part, id, text, sketch
        first: dict[int, tuple[str, np.ndarray]] = {}
        out: list[tuple] = []

        def pair(text: str, sketch: np.ndarray) -> None:
            _, doc_id, own, mine = waiting
            out.append((doc_id, own, mine, edited(own, text), resemblance(mine, sketch, k)))

        def emit() -> pa.RecordBatch:
            new = sketches(pa.array([x[3] for x in out], pa.large_string()), k)
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([len(x[1]) for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x[3].encode()).hexdigest() for x in out], pa.string()),
                    pa.array([packed(x[2]) for x in out], pa.string()),
                    pa.array([packed(s) for s in new], pa.string()),
                    pa.array([resemblance(x[2], s, k) for x, s in zip(out, new, strict=True)], pa.float64()),
                    pa.array([x[4] for x in out], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            out.clear()
            return rows

        for b in batches:
            for start, data, offsets in slices(b.column("text")):
                n = len(offsets) - 1
                few = b.slice(start, n)
                rows = zip(few.column("part").to_pylist(), few.column("extra").to_pylist(), few.column("doc_id").to_pylist(), few.column("text").to_pylist(), [bottom(h, k) for h in shingle_rows(data, offsets)], strict=True)
                for part, extra, doc_id, text, sketch in rows:
                    text = text or ""
                    if waiting is not None and waiting[0] == part:
                        pair(text, sketch)
                        waiting = None
                    if not extra:
                        waiting = (part, doc_id, text, sketch)
                if out:
                    yield emit()
        if out:
            yield emit()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _neighbours(docs).mapInArrow(run, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_likeness(table(spark, sf_dir, "documents"))
