import math

import numpy as np
import pytest

from tintframe.llm import topk_search

DDL = "vec_id long, embedding array<float>, score int"


def brute(vectors, queries, k):
    whole = lambda v: [math.floor(1024 * x) for x in v]
    sound = [(i, whole(v)) for i, v, _ in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sound:
        if q in queries:
            found = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in sound if i != q and len(w) == len(v))[:k]
            out += [(q, rank, i, -score) for rank, (score, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [50, 10_000])
def test_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(5)
    data = [(i, np.float32(rng.normal(size=6)).tolist(), 0) for i in range(400)]
    data += [(1000 + i, data[3][1], 0) for i in range(150)]  # many equal vectors: ties
    data += [(2000, None, 0), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2002, [float("nan")] * 6, 0), (2003, [float("inf")] * 6, 0), (2004, [1.0, 2.0], 0), (2005, [0.5, 1.5], 0), (2006, [], 0)]
    df = spark.createDataFrame(data, DDL).repartition(3)
    queries = {i for i, _, _ in data if i % 20 == 0}
    got = topk_search.top_k(df, df.filter("vec_id % 20 = 0"), k=7, shard_rows=shard_rows, block_rows=16, leaf=8)
    assert sorted(map(tuple, got.collect())) == brute(data, queries, 7)


def test_large_components_stay_exact(spark):
    data = [(0, [3e5, 1.0], 0), (1, [3e5, 1.0], 0), (2, [3e5, 1.001], 0), (3, [-1.0, 0.5], 0)]
    df = spark.createDataFrame(data, DDL)
    got = topk_search.top_k(df, df.filter("vec_id = 0"), k=10)
    assert sorted(map(tuple, got.collect())) == brute(data, {0}, 10)


def test_scores_beyond_64_bits_are_held(spark):
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in np.float32(rng.normal(size=3) * 10.0 ** rng.integers(0, 37))], 0) for i in range(120)]
    data += [(200 + i, [s * 1e15, 1.0, 0.0], 0) for i, s in enumerate((1, -1, 1, -1))]
    df = spark.createDataFrame(data, DDL).repartition(3)
    got = topk_search.top_k(df, df.filter("vec_id % 10 = 0"), k=9, shard_rows=40, block_rows=5, leaf=4)
    assert sorted(map(tuple, got.collect())) == brute([(i, np.float32(v).tolist(), s) for i, v, s in data], {i for i, *_ in data if i % 10 == 0}, 9)


def test_no_rows(spark):
    df = spark.createDataFrame([], DDL)
    assert topk_search.top_k(df, df).count() == 0


def test_repeated_ids_and_clashing_names(spark):
    data = [(0, [1.0, 0.0], 7), (0, [1.0, 0.0], 7), (5, [0.5, 0.5], 7), (5, [0.5, 0.5], 7), (6, [2.0, 0.0], 7), (6, [0.0, 2.0], 7)]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], DDL + ", shard int, rank int")
    got = [tuple(r) for r in topk_search.top_k(df, df.filter("vec_id = 0"), k=4).orderBy("rank").collect()]
    # each row but the query's own id counts; ties go to the smaller id
    assert got == [(0, 1, 6, 1024 * 2048), (0, 2, 5, 1024 * 512), (0, 3, 5, 1024 * 512), (0, 4, 6, 0)]
