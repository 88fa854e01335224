"""Reading the corpus tables, and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(0))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests, one of our own, but on one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="checkpoint-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder as Parquet and read back: its lineage ends there."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def removed(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for frames that nothing will read again."""
    for df in frames:
        if at := getattr(df, "stored_at", None):
            delete(df.sparkSession, at)


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worked_out(rows: DataFrame, f: Callable[[pa.Table], object]) -> object:
    """f of rows, few ones (a sample of fixed size), in one task: of the work, the driver's Python holds the result alone. None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if len(b)]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(pa.Table.from_batches(held)))], pa.binary())], ["made"])

    made = rows.repartition(1).mapInArrow(run, "made binary").toArrow()["made"]
    return pickle.loads(made[0].as_buffer()) if len(made) else None
