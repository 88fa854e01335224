"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed byte n-grams predicts each
bit. A text gets the language of the codeword with the least loss, where each bit's loss is
weighted by how well its classifier knew that language in training. Where the runner-up is
nearly as close, the text is flagged as ambiguous.

The classifiers learn from a bounded sample of labelled documents outside the held-out fold
(``SAMPLE_DOCS`` in all, the same number of each of at most ``MOST_LANGS`` languages, chosen by a hash of the id); texts
are counted on the executors, so the driver holds n-gram counts of the sample only.

A null or empty text, or one without a letter, is ``und`` with score 0, as is every text when
nothing could be learned. Whole texts are read, however long. Equal texts and repeated rows get
equal results; ties go to the language first in the alphabet. Extra columns pass through
``identify``; columns named as its outputs are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketscope.llm.columnar import lowered, slices
from bucketscope.llm.tables import fold, table, worked_out

#: Labelled documents to learn from, in all.
SAMPLE_DOCS = 2_000
#: Most languages that are learned: the most frequent ones (ties in order of the alphabet).
MOST_LANGS = 200
#: Counters of hashed n-grams of two and of three bytes.
BITS = 11
#: Runner-up within this share of the score: ambiguous.
NEAR = 0.05
HELD_OUT_FOLDS = 5
_ROWS = 256


def _counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text; none crosses from text to text."""
    n, size = len(offsets) - 1, 1 << BITS
    out = np.zeros((n, 2 * size), np.float32)
    low = lowered(data).astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for k, (width, odd) in enumerate(((2, 0x9E3779B1), (3, 0x85EBCA6B))):
        if len(low) < width:
            continue
        code = low[: len(low) - width + 1].copy()
        for j in range(1, width):
            code = (code << np.uint32(8)) | low[j : len(low) - width + 1 + j]
        ok = left[: len(code)] >= width
        h = ((code[ok] * np.uint32(odd)) >> np.uint32(32 - BITS)).astype(np.int64) + row[: len(code)][ok] * size
        out[:, k * size : (k + 1) * size] = np.bincount(h, minlength=n * size).reshape(n, size)
    return out


def _features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts at length one, in place of the counts."""
    np.sqrt(counts, out=counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    return counts


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in slices(column):
        for a in range(0, len(offsets) - 1, _ROWS):
            own = offsets[a : a + _ROWS + 1]
            yield first + a, data[own[0] : own[-1]], own - own[0]


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Does each text have a letter?"""
    low = data | np.uint8(32)
    total = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of k languages: all splits of them up to seven, else random bits, well apart."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 7:
        splits = [[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for i in range(k)] for b in range(2 ** (k - 1) - 1)]
        return np.array(splits, np.float32).T
    rng, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], (k, int(np.ceil(10 * np.log2(k)))))
        gap = int(((m[:, None] != m[None]).sum(2) + np.eye(k, dtype=int) * 10**6).min())
        if gap > apart and (np.abs(m.sum(0)) < k).all():
            best, apart = m, gap
    return best.astype(np.float32)


class Coder:
    """Codewords, their binary classifiers, and decoding."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust

    @classmethod
    def fit(cls, counts: np.ndarray, labels: list[str], steps: int = 200) -> Coder:
        langs = sorted(set(labels))
        code = codewords(len(langs))
        y = np.array([langs.index(x) for x in labels])
        x, target = _features(counts), code[y]
        share = 1 / np.maximum(np.bincount(y, minlength=len(langs)), 1)[y]
        share = (share / share.sum()).astype(np.float32)[:, None]
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        moment, square = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
        for t in range(1, steps + 1):
            pull = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share
            for i, (p, g) in enumerate(((w, x.T @ pull + 1e-5 * w), (b, pull.sum(0)))):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                p -= 0.2 * (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-8)
        right = (np.sign(x @ w + b) == target).astype(np.float32)
        trust = np.stack([right[y == k].mean(0) for k in range(len(langs))]) + 1e-3
        return cls(langs, code, w, b, trust / trust.sum(1, keepdims=True))

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language, score and ambiguity of each text."""
        margin = _features(counts) @ self.weights + self.bias
        loss = np.log1p(np.exp(np.clip(-margin[:, None, :] * self.code[None], -30, 30)))
        total = -(loss * self.trust[None]).sum(2) * self.code.shape[1]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        second = np.partition(p, -2, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, score, score - second < NEAR


def _sample(docs: DataFrame) -> DataFrame:
    """doc_id, lang, grams, counts of the documents to learn from."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", HELD_OUT_FOLDS) != 0))
    known = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    langs = known.count()
    each = max(20, SAMPLE_DOCS // max(1, langs))
    # A language's share of hashes leaves about twice as many as are wanted, then the first of them are taken.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = labelled.select("doc_id", "lang").join(F.broadcast(known), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) * F.col("n") <= 2.0 * each)
    ids = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each)
    # At most SAMPLE_DOCS ids (or 20 for each language) are broadcast.
    chosen = labelled.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in _rows(b.column(2)):
                rows = _counted(data, offsets)
                at = [np.flatnonzero(r).astype(np.int32) for r in rows]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), b.column(1).slice(first, len(rows)), pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(rows, at, strict=True)], pa.list_(pa.float32()))], ["doc_id", "lang", "grams", "counts"])

    return chosen.mapInArrow(count, "doc_id long, lang string, grams array<int>, counts array<float>")


def _fitted(rows: pa.Table) -> Coder:
    rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    counts = np.zeros((len(rows), 2 << BITS), np.float32)
    grams, many = (rows[c].combine_chunks() for c in ("grams", "counts"))
    counts[np.repeat(np.arange(len(rows)), grams.value_lengths().to_numpy()), grams.flatten().to_numpy()] = many.flatten().to_numpy()
    return Coder.fit(counts, rows["lang"].to_pylist())


def learn(docs: DataFrame) -> Coder | None:
    return worked_out(_sample(docs), _fitted)


def identify(docs: DataFrame, coder: Coder | None, text: str = "text") -> DataFrame:
    """docs with ``lang_pred string``, ``score double`` and ``ambiguous boolean``."""
    model = docs.sparkSession.sparkContext.broadcast(coder)  # 4,096 weights for each bit

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def of(column: pa.Array) -> pa.Array:
        langs, scores, nears = [], [np.zeros(0)], [np.zeros(0, bool)]
        for _, data, offsets in _rows(column):
            known = _lettered(data, offsets)
            best, score, near = np.zeros(len(known), int), np.zeros(len(known)), np.ones(len(known), bool)
            if model.value is None:
                known[:] = False
            else:
                best, score, near = model.value.decode(_counted(data, offsets))
            langs += [model.value.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, score, 0.0))
            nears.append(np.where(known, near, True))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64()), pa.array(np.concatenate(nears))], ["lang_pred", "score", "ambiguous"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    found = docs.select(F.struct("*").alias("row"), of(F.col(text)).alias("found"))
    return found.select(*[F.col(f"row.`{c}`") for c in kept], "found.*")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", (fold("doc_id", HELD_OUT_FOLDS) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
