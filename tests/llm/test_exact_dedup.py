import hashlib
from collections import defaultdict

import pytest

from tintframe.llm import exact_dedup


def brute(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[(text or "").encode().lower()].append(doc_id)
    return sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for d in g)


@pytest.mark.parametrize("key_bits", [62, 3, 0])
def test_against_brute_force(spark, key_bits):
    """Few key bits make texts collide, so that chains hold several texts."""
    docs = [(i, f"Text {i % 40} É") for i in range(400)] + [(1000 + i, "HOT") for i in range(300)] + [(2000, None), (2001, ""), (2002, "hot"), (2003, "é" * 50_000), (2004, "É" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_groups(df, capacity=4, key_bits=key_bits).collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(7, "a", 1)] * 3 + [(None, "A", 1)], "doc_id long, text string, kept int")
    got = exact_dedup.exact_groups(df).collect()
    assert [r.keep_id for r in got] == [7] * 4 and sum(r.kept for r in got) == 1


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    (row,) = exact_dedup.exact_groups(df).collect()
    assert row.keep_id is None and row.kept and row.group_size == 1
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4096).selectExpr("id * (1L << 40) as key")  # all in the low part of the range
    pages = exact_dedup.directory(keys, capacity=64, doublings=8).collect()
    assert len({p.bucket for p in pages}) > 1 and all(p.bucket <= p.leaf for p in pages)
