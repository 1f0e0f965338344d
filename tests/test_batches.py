import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tintframe.operators import batches, mixtures, palette, regions


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_groups_come_whole_however_the_batches_are_cut(size):
    rng = np.random.default_rng(size)
    key = np.sort(rng.integers(0, 9, 60))
    other = np.array([int(k) % 2 for k in key])
    table = pa.table({"k": key, "o": other, "v": np.arange(60)})
    cut = table.to_batches(max_chunksize=size)
    cut.insert(1, pa.RecordBatch.from_pylist([], schema=table.schema))
    got = list(batches.whole_groups(iter(cut), ["k", "o"]))
    assert pa.concat_tables(got).equals(table)
    seen = [set(t["k"].to_pylist()) for t in got]
    assert sum(map(len, seen)) == len(set().union(*seen))
    assert list(batches.whole_groups(iter([]), ["k"])) == []


def test_many_images_are_labelled_at_a_time(spark):
    df = spark.range(3000).select(F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"), F.col("id").alias("image_id")).selectExpr("image_id", "cast(i div 3 as int) y", "cast(i % 3 as int) x", "cast(pmod(hash(image_id, i), 2) as int) cand_idx")
    for work in (lambda d: regions.labels(d), lambda d: regions.labels_tiled(d, 2), lambda d: regions.merge_small(d, 2.0)):
        out = work(df)
        # a call a group is the cost of small images
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan
    grids = {}
    for r in df.collect():
        grids.setdefault(r.image_id, np.zeros((3, 3), int))[r.y, r.x] = r.cand_idx
    for r in regions.labels(df).filter("image_id % 10 = 0").collect():
        assert r.region_id == regions.label_grid(grids[r.image_id])[r.y, r.x]


def test_palettes_of_many_images_come_from_one_call(spark):
    cands = mixtures.with_argb_lab(spark.createDataFrame([(i, i * 0x0B0D11 % (1 << 24)) for i in range(60)], "cand_idx int, argb int"))
    df = spark.range(400).select(F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"), F.col("id").alias("image_id")).selectExpr("image_id", "cast(i div 4 as int) y", "cast(i % 4 as int) x", "cast(pmod(hash(image_id, i), 1 << 24) as int) argb")
    got = palette.image_palette(df, cands, 5)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, got.collect()))
    alone = palette.image_palette(df.filter("image_id = 37"), cands, 5).collect()
    assert sorted(map(tuple, alone)) == [r for r in rows if r[0] == 37]
    assert {r[0] for r in rows} == set(range(400))
