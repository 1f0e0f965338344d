import numpy as np
import pytest
from pyspark.sql import functions as F

from tintframe.llm import quality

GOOD = "The {} of a long sentence, which has {} words in it.\nAnother line follows here."
BAD = "BUY!! NOW!! {}!! {}!! | | | $$$ ### BUY!! NOW!!"


def corpus(spark, n=400):
    docs = [(i, (GOOD if i % 2 else BAD).format(f"w{i * 7919 % 1000}", i)) for i in range(n)]
    labels = [(i, i % 2) for i in range(n) if i % 3]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus(spark)
    docs += [(900, None), (901, ""), (902, "word " * 100_000), (None, "Some words here, as usual."), (903, "\udcff".encode("utf-8", "replace").decode())]
    docs += [docs[0]]
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, score double")
    rows = quality.quality_scores(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.fold == 0 and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held]) > 0.97
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    want = {r.doc_id for r in rows if r.score >= 0.3}
    assert {r.doc_id for r in kept.collect()} == want


def test_no_labels_no_rows(spark):
    docs, labels = corpus(spark, 10)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.score for r in quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), labels).count() == 0


def test_labels_do_not_leak_from_the_held_out_fold(spark):
    docs, labels = corpus(spark, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((r.doc_id, r.score) for r in quality.quality_scores(df, x).collect()) for x in (labels, turned))
    assert [d for d, _ in one] == [d for d, _ in two]
    assert [x for _, x in one] == pytest.approx([x for _, x in two], abs=1e-9)


def test_partition_sums_equal_one_ridge_fit(spark):
    docs, labels = corpus(spark, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    described = quality.describe(df).cache()
    scorer = quality.fit(described, labels, features=32, part_rows=20)
    rows = described.filter("fold not in (0, 4)").join(labels, "doc_id").collect()
    z, y = scorer.features(np.array([r.x for r in rows])), np.array([r.quality for r in rows])
    want = np.linalg.solve(z.T @ z + np.eye(33), z.T @ y)
    assert scorer.weights == pytest.approx(want, abs=1e-8)


def test_pool_violators():
    assert quality.pool_violators(np.array([1.0, 0.0, 2.0, 1.0]), np.array([1.0, 1.0, 1.0, 3.0])).tolist() == [0.5, 0.5, 1.25, 1.25]
