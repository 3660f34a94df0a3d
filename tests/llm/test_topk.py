import math
import random

from pyspark.sql import functions as F

from tallyspark.llm import topk


def test_as_by_brute_force(spark):
    rng = random.Random(8)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(400)]
    vectors += [(400 + i, vectors[i % 3][1]) for i in range(30)]  # ties
    vectors += [(900, None), (901, [None] * 20), (902, [float("nan")] + [1.0] * 19), (903, [float("inf")] + [1.0] * 19), (None, [1.0] * 20), (950, [-1e-9] * 20)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(4)
    stored = {r.vec_id: r.embedding for r in df.collect() if r.vec_id is not None}
    sound = {i: [math.floor(256 * x) for x in v] for i, v in stored.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in sound if i % 50 == 0):
        near = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=True)), i) for i, v in sound.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    for block in (4096, 3):
        got = topk.search(df, F.col("vec_id") % 50 == 0, 5, block_queries=block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 256 * 11)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
