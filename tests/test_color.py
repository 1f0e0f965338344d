import pytest
from pyspark.sql import functions as F

from tintframe.functions import color, pigments

# Pairs of Lab colours with their CIEDE2000 difference to four places, from the
# published test data of Sharma, Wu and Dalal (2005).
PAIRS = (
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
    (50.0, -0.001, 2.49, 50.0, 0.0009, -2.49, 4.8045),
    (50.0, -0.001, 2.49, 50.0, 0.0011, -2.49, 4.7461),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (50.0, 2.5, 0.0, 61.0, -5.0, 29.0, 22.8977),
    (50.0, 2.5, 0.0, 56.0, -27.0, -3.0, 31.9030),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (35.0831, -44.1164, 3.7933, 35.0232, -40.0716, 1.5901, 1.8645),
    (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373),
    (90.9257, -0.5406, -0.9208, 88.6381, -0.8985, -0.7239, 1.5381),
    (6.7747, -0.2908, -2.4247, 5.8714, -0.0985, -2.2286, 0.6377),
    (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
)


def test_published_differences(spark):
    df = spark.createDataFrame(PAIRS, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    x, y = (tuple(F.col(f"{c}{i}") for c in "lab") for i in (1, 2))
    for row in df.select("want", color.ciede2000(x, y).alias("de"), color.ciede2000(y, x).alias("back")).collect():
        assert row.de == pytest.approx(row.want, abs=5e-5) and row.back == pytest.approx(row.de, abs=1e-10)


def test_descriptions(spark):
    bands = spark.createDataFrame([(0.4,), (1.5,), (2.5,), (4.0,), (12.0,)], "de double")
    assert [r[0] for r in bands.select(color.describe_quality(F.col("de"))).collect()] == ["indistinguishable", "very close", "close", "noticeable", "clearly different"]
    mixes = spark.createDataFrame([(70.0, 30.0), (30.0, 30.0), (50.0, 10.0), (50.0, 60.0), (70.0, 10.0), (30.0, 60.0), (50.2, 30.2)], "l double, a double")
    told = mixes.select(color.describe_shift((F.lit(50.0), F.lit(30.0), F.lit(0.0)), (F.col("l"), F.col("a"), F.lit(0.0))))
    assert [r[0] for r in told.collect()] == ["lighter", "darker", "duller", "more intense", "lighter and duller", "darker and more intense", None]


def test_gamut_keeps_what_fits_and_brings_in_the_rest(spark):
    df = spark.createDataFrame([(0.2, 0.5, 0.9), (1.4, -0.2, 0.1), (2.0, 2.0, 2.0), (-0.5, -0.5, -0.5)], "r double, g double, b double")
    rows = df.select("r", "g", "b", color.compress(F.col("r"), F.col("g"), F.col("b")).alias("m")).collect()
    assert (rows[0].m.r, rows[0].m.g, rows[0].m.b, rows[0].m.chroma_lost) == (0.2, 0.5, 0.9, 0.0)
    assert rows[1].m.chroma_lost > 0
    for row in rows:
        assert all(0 <= row.m[c] <= 1 for c in "rgb")
    assert [round(rows[2].m[c], 6) for c in "rgb"] == [1, 1, 1]


def test_reflection_round_trips(spark):
    df = spark.createDataFrame([(r / 20,) for r in range(1, 20)], "r double")
    back = df.select("r", pigments.inverse_saunderson(pigments.saunderson(F.col("r"))).alias("same"), pigments.reflectance(pigments.absorption(pigments.saunderson(F.col("r"))), F.lit(1.0)).alias("again"), pigments.saunderson(F.col("r")).alias("seen"))
    for row in back.collect():
        assert row.same == pytest.approx(row.r) and row.again == pytest.approx(row.seen)


def test_resampling_holds_the_ends(spark):
    df = spark.createDataFrame([([0.10 + 0.01 * i for i in range(31)],)], "m array<double>")
    out = df.select(pigments.resample(F.col("m")).alias("r")).first().r
    assert len(out) == 38 and out[:3] == [out[2]] * 3 and out[32:] == [out[37]] * 6
    assert out[2] == pytest.approx(0.10) and out[32] == pytest.approx(0.40)


def test_packing_keeps_every_channel(spark):
    df = spark.createDataFrame([(255, 1, 2, 3), (0, 250, 128, 7)], "a int, r int, g int, b int")
    packed = df.withColumn("argb", color.pack(*(F.col(c) for c in "argb")))
    for row in packed.select("a", "r", "g", "b", *(c.alias(n) for c, n in zip(color.channels(F.col("argb")), ("a2", "r2", "g2", "b2"), strict=True))).collect():
        assert tuple(row)[:4] == tuple(row)[4:]
