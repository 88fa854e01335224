"""Reed-Solomon over GF(256), as Arrow-batched functions of columns."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the field's polynomial.
POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 256:
            x ^= POLYNOMIAL
    return exp, log


EXP, LOG = _tables()


#: All products, one byte each.
PRODUCTS = np.where(np.arange(256)[:, None] * np.arange(256) == 0, 0, EXP[LOG[:, None] + LOG]).astype(np.uint8)


def times(a: int, b: np.ndarray) -> np.ndarray:
    return PRODUCTS[a][b]


def power(a: int, n: int) -> int:
    return 1 if n == 0 else int(EXP[LOG[a] * n % 255])


def rows_of(k: int, m: int) -> np.ndarray:
    """The identity above the parity coefficients (p + 1) ** d."""
    return np.array([[int(i == d) for d in range(k)] for i in range(k)] + [[power(p + 1, d) for d in range(k)] for p in range(m)], np.int64)


def inverse(a: np.ndarray) -> np.ndarray | None:
    n = len(a)
    w = np.concatenate([a.copy(), np.eye(n, dtype=np.int64)], 1)
    for c in range(n):
        pivot = next((r for r in range(c, n) if w[r, c]), None)
        if pivot is None:
            return None
        w[[c, pivot]] = w[[pivot, c]]
        w[c] = times(int(EXP[255 - LOG[w[c, c]]]), w[c])
        for r in range(n):
            if r != c and w[r, c]:
                w[r] ^= times(int(w[r, c]), w[c])
    return w[:, n:]


def encoded(data: bytes, k: int, m: int) -> list[bytes]:
    size = -(-max(1, len(data)) // k)
    grid = np.frombuffer(data.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    out = [grid[i] for i in range(k)]
    for row in rows_of(k, m)[k:]:
        total = np.zeros(size, np.uint8)
        for c, shard in zip(row.tolist(), grid, strict=True):
            total ^= times(c, shard)
        out.append(total)
    return [x.tobytes() for x in out]


def decoded(shards: list[bytes | None], k: int, m: int, length: int) -> bytes | None:
    """The data from any k shards whose rows can be inverted; the lowest such set."""
    from itertools import combinations

    there = [i for i, s in enumerate(shards) if s is not None]
    for chosen in combinations(there, k):
        back = inverse(rows_of(k, m)[list(chosen)])
        if back is None:
            continue
        have = [np.frombuffer(shards[i], np.uint8) for i in chosen]
        out = []
        for row in back.tolist():
            total = np.zeros_like(have[0])
            for c, shard in zip(row, have, strict=True):
                total ^= times(c, shard)
            out.append(total.tobytes())
        return b"".join(out)[:length]
    return None


def encode(content: Column, k: int, m: int) -> Column:
    @F.arrow_udf("array<binary>")
    def of(x: pa.Array) -> pa.Array:
        return pa.array((encoded(b.as_py(), k, m) if b.is_valid else None for b in x), pa.list_(pa.binary()), size=len(x))

    return of(content)


def decode(shards: Column, length: Column, k: int, m: int) -> Column:
    @F.arrow_udf("binary")
    def of(x: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array((decoded(s.as_py(), k, m, z.as_py()) if s.is_valid and z.is_valid else None for s, z in zip(x, n, strict=True)), pa.binary(), size=len(x))

    return of(shards, length)


def round_trips(rows: DataFrame, k: int, m: int) -> DataFrame:
    """doc_id, same, shards of rows (doc_id, content, lost): is content, encoded, the same when decoded without the shards of the lost places? Null content gives nulls.

    Shards never leave the task, which holds a batch of rows and the shards of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, n = [], []
            for content, lost in zip(b.column(1), b.column(2), strict=True):
                data, gone = content.as_py(), lost.as_py() or []
                shards = encoded(data, k, m) if data is not None else None
                n.append(None if shards is None else len(shards))
                same.append(None if shards is None else decoded([None if i in gone else x for i, x in enumerate(shards)], k, m, len(data)) == data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.bool_()), pa.array(n, pa.int32())], ["doc_id", "same", "shards"])

    return rows.select(F.col("doc_id").cast("long"), "content", "lost").mapInArrow(run, "doc_id long, same boolean, shards int")


def signature(secret: Column, day: Column, region: Column, text: Column) -> Column:
    """The request signature: a chain of HMAC-SHA256 keys, then the text."""

    @F.pandas_udf("string")
    def of(s: pd.Series, d: pd.Series, r: pd.Series, t: pd.Series) -> pd.Series:
        def one(*x: str) -> str:
            key = f"AWS4{x[0]}".encode()
            for part in (x[1], x[2], "s3", "aws4_request"):
                key = hmac.new(key, part.encode(), hashlib.sha256).digest()
            return hmac.new(key, x[3].encode(), hashlib.sha256).hexdigest()

        return pd.Series([one(*x) for x in zip(s, d, r, t, strict=True)])

    return of(secret, day, region, text)
