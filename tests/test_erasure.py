import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from bucketscope.functions import erasure


def test_work_memory_is_a_few_times_the_data():
    data = np.random.default_rng(1).integers(0, 256, 2_000_000, np.uint8).tobytes()
    tracemalloc.start()
    shards = erasure.encoded(data, 4, 2)
    assert erasure.decoded([None, None, *shards[2:]], 4, 2, len(data)) == data
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * len(data)


def test_round_trips_and_columns(spark):
    rows = [(1, "some text é" * 50, [1, 2]), (2, "", [0, 5]), (3, None, [0, 1]), (4, "x", [0, 1, 2]), (5, "yz", None), (6, "abc", [None, -1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lost array<int>").withColumn("content", F.encode("text", "UTF-8"))
    got = {r.doc_id: (r.same, r.shards) for r in erasure.round_trips(docs, 4, 2).collect()}
    assert got == {1: (True, 6), 2: (True, 6), 3: (None, None), 4: (False, 6), 5: (True, 6), 6: (True, 6)}
    back = docs.withColumn("s", erasure.encode(F.col("content"), 4, 2)).withColumn("b", erasure.decode(F.col("s"), F.octet_length("content"), 4, 2))
    for r in back.select("content", "s", "b").collect():
        assert r.b == r.content and (r.s is None if r.content is None else list(map(bytes, r.s)) == erasure.encoded(bytes(r.content), 4, 2))
