"""Operators do not leave out large values, long pieces or pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import top_k


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=8) * 10.0 ** (i % 6)).tolist()) for i in range(120)]
    vectors += [(200, [1e7, *[0.0] * 7]), (201, [-1e7, *[0.0] * 7])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(2)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors}
    wanted = []
    for q in (i for i in whole if i % 7 == 0):
        ranked = sorted((-sum(x * y for x, y in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
        wanted += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    assert sorted(tuple(r) for r in top_k.search(table, F.col("vec_id") % 7 == 0).collect()) == sorted(wanted)
