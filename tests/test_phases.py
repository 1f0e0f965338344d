import numpy as np

from tintframe.operators import mixtures
from tintframe.plans import phases, styles
from tintframe.sources import fixtures


def test_phases_tell_rows_and_keys(spark):
    taken = phases.Phases(spark)
    rng = np.random.default_rng(1)
    px = spark.createDataFrame([(i, y, x, int(rng.integers(0, 1 << 24)) - (1 << 24)) for i in range(2) for y in range(4) for x in range(4)], "image_id long, y int, x int, argb int")
    cands = mixtures.settled(mixtures.candidates(mixtures.palette(spark, [4, 9, 14])))
    style = styles.by_name("Tonalism")
    out = styles.render(px, style, cands, mark=2.0, phases=taken)
    told = taken.table().collect()
    assert [r.phase for r in told] == ["pre-map", "colour map", "post-map", "compose"]
    assert all(r.rows == 32 and r.seconds > 0 for r in told)
    assert told[0]["keys"] is None and told[2]["keys"] <= told[1]["keys"] <= 32
    plain = styles.render(px, style, cands, mark=2.0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))


def test_benchmark_of_a_gradient(spark):
    got = phases.benchmark(fixtures.noisy_gradient(spark, 6, 5), mixtures.palette(spark, [4, 9]), names=("Realism", "Abstract"), mark=2.0, runs=2).collect()
    by = {(r.style, r.phase): r for r in got}
    assert {p for s, p in by if s == "Realism"} == {"candidates", "cached", "pre-map", "colour map", "post-map", "compose", "total"}
    for name in ("Realism", "Abstract"):
        assert by[name, "cached"].seconds < by[name, "candidates"].seconds and by[name, "compose"].rows == 30 and by[name, "total"].runs == 2
