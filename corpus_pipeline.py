"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.llm import benchmark, bpe, jaccard, language, lines
from bucketscope.llm.tables import delete, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: An ambiguous text goes if its language scores lower than this many times an even share of all languages.
LEAST_SCORE = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of one that is next to undecided, go.

    Null, empty and letterless texts have none, and nor has any text where no document has a lang
    to learn from. Rows are judged one by one: repeated rows fare alike, null ids don't matter.
    """
    coder = language.learn(docs)
    least = LEAST_SCORE / max(1, len(coder.langs)) if coder else 1.0
    found = language.identify(docs.select(F.struct("*").alias("doc"), "text"), coder)
    found = found.filter((F.col("lang_pred") != "und") & ~(F.col("ambiguous") & (F.col("score") < least)))
    return found.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and documents of which nothing but blanks is left; n_chars follows the text.

    Repeated rows and null ids are as in ``lines``: a line stays in the rows of the least doc_id.
    A text that had no line to lose stays as it is, null or blank.
    """
    kept = lines.without_repeats(docs.drop("n_lines", "n_dropped"))
    kept = kept.filter((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts link, directly or through others, one stays: see ``jaccard.without_near_duplicates``. It decides by row, so null ids and rows of one id are told apart; texts without words all stay."""
    return jaccard.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak a benchmark item go: each by its own text, so null ids and rows of one id are told apart. Null and empty texts stay."""
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    leaked = benchmark.leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), key.alias("key")).join(leaked, "key", "left_anti")
    return rows.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with n_tokens and token_ids (no ids for a null or empty text)."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("BPE encoding", encode)]
#: Learned and iterative stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            delete(spark, last)
        last = at
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
