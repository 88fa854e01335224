import os
import subprocess
import sys

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from bucketscope.llm import bpe


def test_odd_words_by_lookup_equal_the_pattern():
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    pattern = bpe.regex.compile(vocabulary.odd)
    rng = np.random.default_rng(4)
    odd, plain = ([chr(c) for c in np.flatnonzero(vocabulary.is_odd == k) if not 0xD800 <= c < 0xE000] for k in (1, 0))
    letter = lambda: (odd if rng.random() < 0.1 else plain if rng.random() < 0.5 else "abc")
    raw = list({"".join(x[int(rng.integers(len(x)))] for x in (letter() for _ in range(int(rng.integers(1, 7))))) for _ in range(2000)})
    want = [w for w in raw if pattern.search(w)]
    assert 100 < len(want) < len(raw) and bpe.odd_words(raw, vocabulary.is_odd) == want
    assert bpe.odd_words([], vocabulary.is_odd) == [] and bpe.odd_words(["a"], vocabulary.is_odd) == []


def test_choice_of_frequent_words_compares_once(spark):
    """The filter does not grow with the number of frequencies."""
    counts = spark.range(1, 3001).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") * F.col("id")).alias("n"))
    chosen = bpe.most_frequent(counts, 1000)
    assert chosen._jdf.queryExecution().optimizedPlan().toString().lower().count("log2") <= 2
    got = {int(r.word[1:]) for r in chosen.collect()}
    assert 900 < len(got) <= 1000 and set(range(2100, 3001)) <= got
    assert bpe.most_frequent(counts, 5000).count() == 3000


def test_driver_learns_and_compiles_nothing_itself(spark, sf_dir):
    """A task does both: the driver's Python, whose memory is scarce, holds only what they made."""
    code = f"""
import sys
import corpus_pipeline
from pyspark.sql import SparkSession
from bucketscope.llm import bpe, language
bpe.Vocabulary.parsed = bpe.Lexicon.compile = language.Coder.fit = None  # in this process alone
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "der Hund lief weg", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
import public_tokenizers
assert bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).filter("n_tokens > 0").count() == 40
assert language.learn(docs).langs == ["de", "en"]
assert bpe.encode(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0 and language.learn(docs.limit(0)) is None
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
