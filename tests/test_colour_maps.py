import numpy as np
import pytest

from tintframe.functions import color
from tintframe.operators import mixtures, nearest
from tintframe.operators.colour_maps import ColourMaps, map_name
from tintframe.plans import styles


@pytest.fixture(scope="module")
def cands(spark):
    return mixtures.settled(mixtures.candidates(mixtures.palette(spark, [4, 9, 14])))


def pixels(spark, seed, n=60):
    rng = np.random.default_rng(seed)
    rows = [(0, 0, x, int(rng.integers(0, 1 << 24)) - (1 << 24)) for x in range(n)]
    return spark.createDataFrame(rows + rows[:9], "image_id long, y int, x int, argb int")


def rows(df):
    return sorted(map(tuple, df.select("image_id", "y", "x", "argb", "cand_idx").collect()))


def test_a_map_is_solved_once(spark, cands, tmp_path):
    maps, name = ColourMaps(spark, f"file://{tmp_path}/maps"), map_name(cands)
    first, second = pixels(spark, 1), pixels(spark, 2)
    assert rows(maps.resolve(first, cands, name)) == rows(nearest.resolve_once(first, cands)) and maps.solved > 50
    assert rows(maps.resolve(first, cands, name)) == rows(nearest.resolve_once(first, cands)) and maps.solved == 0
    both = first.union(second)
    assert rows(maps.resolve(both, cands, name)) == rows(nearest.resolve_once(both, cands)) and 0 < maps.solved <= 60
    again = ColourMaps(spark, f"file://{tmp_path}/maps")  # as another job finds it
    assert rows(again.resolve(both, cands, name)) == rows(nearest.resolve_once(both, cands)) and again.solved == 0
    assert maps.resolve(first.limit(0), cands, name).count() == 0 and maps.solved == 0


def test_the_least_used_map_goes(spark, cands, tmp_path):
    maps, px = ColourMaps(spark, f"file://{tmp_path}/maps", room=2), pixels(spark, 3, 5)
    for name in ("a", "b", "a", "c"):
        maps.resolve(px, cands, name)
    assert maps.names() == ["c", "a"] and maps.known("b").count() == 0
    maps.resolve(px, cands, "a")
    assert maps.solved == 0
    maps.resolve(px, cands, "b")
    assert maps.solved > 0 and maps.names() == ["b", "a"]
    with pytest.raises(ValueError):
        ColourMaps(spark, "x", room=0)


def test_keys_appended_twice_are_one(spark, cands, tmp_path):
    maps, px = ColourMaps(spark, f"file://{tmp_path}/maps"), pixels(spark, 4, 8)
    want = rows(maps.resolve(px, cands, "m"))
    maps.known("m").write.mode("append").parquet(f"file://{tmp_path}/maps/maps/m")
    assert rows(maps.resolve(px, cands, "m")) == want


def test_names_tell_palettes_and_remaps_apart(spark, cands):
    other = mixtures.settled(mixtures.candidates(mixtures.palette(spark, [4, 9, 13])))
    names = [map_name(cands), map_name(other), map_name(cands, 1.0), map_name(cands, 1.0, 2.0), map_name(cands.filter("cand_idx > 0"))]
    assert len({*names}) == 5 and map_name(cands.orderBy("l"), 1.0) == names[2]


def test_renders_share_a_map_and_not_across_remaps(spark, cands, tmp_path):
    rng = np.random.default_rng(7)
    px = spark.createDataFrame([(i, y, x, int(rng.integers(0, 1 << 24)) - (1 << 24)) for i in range(2) for y in range(4) for x in range(4)], "image_id long, y int, x int, argb int")
    maps = ColourMaps(spark, f"file://{tmp_path}/maps")
    for name in ("Realism", "Tonalism"):
        style = styles.by_name(name)
        want = rows(styles.render(px, style, cands, mark=2.0))
        assert rows(styles.render(px, style, cands, mark=2.0, maps=maps)) == want and maps.solved > 0
        assert rows(styles.render(px, style, cands, mark=2.0, maps=maps)) == want and maps.solved == 0
        # a stronger blur changes the keys, not where they lead
        assert rows(styles.render(px, style, cands, mark=2.0, blur=3, maps=maps)) == rows(styles.render(px, style, cands, mark=2.0, blur=3))
    assert len(maps.names()) == 2
    assert color.LIGHTNESS_WEIGHT == 1.5
