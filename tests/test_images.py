import datetime as dt
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintframe.operators import filters, mixtures
from tintframe.plans import styles
from tintframe.sources import fixtures, images
from tintframe.streaming import requests


def bmp(argb: np.ndarray) -> bytes:
    height, width = argb.shape
    step = (width * 3 + 3) // 4 * 4
    body = b"".join(b"".join(struct.pack("<I", int(p) & 0xFFFFFF)[:3] for p in row).ljust(step, b"\0") for row in argb[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


@pytest.mark.parametrize(
    ("head", "name"),
    [(b"\x89PNG\r\n\x1a\n", "Png"), (b"\xff\xd8\xff\xe0", "Jpeg"), (b"GIF89a", "Gif"), (b"BM12", "Bmp"), (b"II*\0", "Tiff"), (b"8BPS", "Psd"), (b"RIFF1234WEBP", "Webp"), (b"\0\0\0\x18ftypavif", "Avif"), (b"\0\0\0\x18ftypheic", "Heif"), (b"\0\0\0\x18ftypmp42", "Unknown"), (b"BM", "Unknown"), (b"", "Unknown")],
)
def test_formats(spark, head, name):
    assert spark.createDataFrame([(bytearray(head),)], "content binary").select(images.image_format(F.col("content"))).first()[0] == name


def test_bmp_decodes_and_png_holds_the_pixels(spark):
    rng = np.random.default_rng(1)
    want = rng.integers(0, 1 << 24, (5, 3))
    px = images.decode(spark.createDataFrame([(7, bytearray(bmp(want)))], "image_id long, content binary"))
    got = {(r.y, r.x): r.argb & 0xFFFFFF for r in px.collect()}
    assert got == {(y, x): int(want[y, x]) for y, x in np.ndindex(want.shape)}
    png = bytes(images.encode_png(px).first().content)
    at = png.index(b"IDAT")
    raw = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and raw[1:4] == struct.pack(">I", int(want[0, 0]))[1:]


def test_rgba_round_trip(spark):
    px = fixtures.solid(spark, 3, 2, -0x7F00FF10).withColumn("argb", F.col("argb") + F.col("x"))
    rgba = images.to_rgba(px).withColumns({"width": F.lit(3), "height": F.lit(2)})
    assert sorted(map(tuple, images.from_rgba(rgba).collect())) == sorted(map(tuple, px.select("image_id", "y", "x", "argb").collect()))
    with pytest.raises(Exception, match="rgba has not"):
        images.from_rgba(rgba.withColumn("width", F.lit(4))).collect()


def test_checksum_depends_on_the_order(spark):
    a = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (1, 0, 0, 2), (1, 0, 1, 1)], "image_id long, y int, x int, argb int")
    one, two = (r.checksum for r in images.checksum(a).orderBy("image_id").collect())
    h = 14695981039346656037
    for p in (1, 2):
        h = (h ^ p) * 1099511628211 % 2**64
    assert one == f"{h:016x}" != two


def test_saved_palettes(spark):
    df = spark.createDataFrame([('["A","B"]',), ("[]",), ("{oops",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(images.palette_from_json(F.col("s"))).collect()] == [["A", "B"], None, None, None, None]


def test_spreadsheet_rows():
    book = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Paint</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c></row></sheetData></worksheet>')
    assert images.sheet_rows(book.getvalue()) == [["Paint", None, "1.5"]]


def test_derived_pigments_skip_known_and_broken_rows(spark):
    rows = [("New", ["50"] * 31), ("known", ["50"] * 31), ("Broken", ["50"] * 30 + ["x"]), (" ", ["50"] * 31)]
    out = images.derive_pigments(spark.createDataFrame(rows, "name string, pct array<string>"), spark.createDataFrame([("Known",)], "name string")).collect()
    assert [r.name for r in out] == ["New"] and len(out[0].k) == 38


def test_styles_hold_their_values():
    assert styles.by_name("Fauvism").with_values(strength=99).value("strength") == 5
    with pytest.raises(KeyError):
        styles.by_name("fauvism")
    assert [styles.default_mark(w, h) for w, h in ((10, 10), (1920, 1080), (90000, 90000))] == [2, 7, 128]
    assert [styles.scale_radius(r, (1000, 500), (100, 50)) for r in (0, 3, 40)] == [0, 1, 4]
    assert filters.preview_size(1920, 1080) == (384, 216) and filters.preview_size(100, 50) == (100, 50)


def test_compose_keeps_alpha(spark):
    px = fixtures.solid(spark, 2, 1, 0x10203040)
    cands = spark.createDataFrame([(0, -1)], "cand_idx int, argb int")
    out = styles.compose(px, px.select("image_id", "y", "x", F.lit(0).alias("cand_idx")), cands)
    assert {r.argb for r in out.collect()} == {0x10FFFFFF}


def at(second: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def test_bursts_close_after_the_gap(spark):
    rows = [(at(0), 1, "change", 1, 10.0), (at(1), 1, "change", 2, 20.0), (at(9), 1, "cancel", 3, 30.0), (at(0), 2, "change", 1, 5.0)]
    df = spark.createDataFrame(rows, "ts timestamp, key long, kind string, generation long, payload double")
    got = sorted((r.key, r.n, r.generation, r.payload) for r in requests.debounce(df, "3 seconds").collect())
    assert got == [(1, 1, 3, 30.0), (1, 2, 2, 20.0), (2, 1, 1, 5.0)]
    assert sorted((r.key, r.generation) for r in requests.live_bursts(df, "3 seconds").collect()) == [(1, 2), (2, 1)]


def test_streamed_bursts_match_the_table(spark, tmp_path):
    rows = [(at(i * 7 % 100 + 200 * (i % 3)), i % 4, "change", i, float(i)) for i in range(60)]
    ddl = "ts timestamp, key long, kind string, generation long, payload double"
    df = spark.createDataFrame(rows, ddl)
    want = sorted(map(tuple, requests.debounce(df, "20 seconds").select("key", "start", "n", "generation").collect()))
    last = spark.createDataFrame([(at(10_000_000), -1, "change", 0, 0.0)], ddl)
    df.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    last.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("ts", "1 second")
    q = requests.debounce(stream, "20 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("bursts").filter("key >= 0").select("key", "start", "n", "generation").collect()))
    assert got == want


def test_sliders():
    p = styles.PARAMETERS["key"]
    assert [styles.to_position(p, v) for v in (-20, 0, 20)] == [0, 50, 100] and styles.to_value(p, 75) == 10
    assert styles.caption(p, 2.5) == "Key shift: 2.5 L*" and styles.caption(styles.PARAMETERS["edge"], 0.1) == "Edge: 0.1"


def test_candidates_are_kept_by_what_builds_them(spark):
    cache = styles.Cache(room=2)
    two, three = (mixtures.palette(spark, i) for i in ([4, 9], [4, 9, 14]))
    realism, abstract = styles.by_name("Realism"), styles.by_name("Abstract")
    held = cache.candidates(realism, two)
    assert cache.candidates(styles.by_name("Fauvism"), two) is held
    assert cache.candidates(abstract, two) is not held and cache.candidates(realism, two) is held
    cache.candidates(realism, three)
    assert len(cache.held) == 2 and cache.candidates(realism, two) is held
