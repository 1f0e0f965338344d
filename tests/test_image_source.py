import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintframe.sources import decoders, image_source, images


def argb(rng, shape, alpha=True):
    px = rng.integers(0, 1 << 32, shape, dtype=np.uint32) | (np.uint32(0) if alpha else np.uint32(0xFF000000))
    return px.view(np.int32)


def channels(px):
    u = np.ascontiguousarray(px).view(np.uint32)
    return np.stack([(u >> s).astype(np.uint8) for s in (16, 8, 0, 24)], axis=-1)


def filtered(rows, step, kinds):
    """Bytes of rows with their filters, worked out byte by byte."""
    out = b""
    for y, kind in enumerate(kinds):
        line = bytearray([kind])
        for i, value in enumerate(rows[y]):
            a = int(rows[y][i - step]) if i >= step else 0
            b = int(rows[y - 1][i]) if y else 0
            c = int(rows[y - 1][i - step]) if y and i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(value) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes(line)
    return out


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, depth, colour, raw, *more, interlaced=0):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(more) + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


def test_png_of_every_filter_and_the_own_writer():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 5), (3, 11)):
        px = argb(rng, shape)
        assert (decoders.decode_png(images.png(px)) == px).all()
        rows = channels(px).reshape(shape[0], -1)
        for kinds in ([k] * shape[0] for k in range(5)):
            assert (decoders.decode_png(png(shape[1], shape[0], 8, 6, filtered(rows, 4, kinds))) == px).all()
        assert (decoders.decode_png(png(shape[1], shape[0], 8, 6, filtered(rows, 4, rng.integers(0, 5, shape[0]).tolist()))) == px).all()


def test_png_of_other_pixels():
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (4, 5, 3))
    want = decoders.packed(*(rgb[..., i] for i in range(3)))
    raw = filtered(rgb.reshape(4, -1), 3, [0, 1, 2, 4])
    assert (decoders.decode_png(png(5, 4, 8, 2, raw)) == want).all()
    clear = rgb[2, 3]
    shown = decoders.decode_png(png(5, 4, 8, 2, raw, chunk(b"tRNS", struct.pack(">3H", *clear))))
    assert (shown[(rgb == clear).all(axis=2)].view(np.uint32) >> 24 == 0).all() and shown[0, 0] == want[0, 0]
    deep = rng.integers(0, 65536, (3, 4, 1))
    got = decoders.decode_png(png(4, 3, 16, 0, filtered(deep.astype(">u2").view(np.uint8).reshape(3, -1), 2, [0, 3, 4])))
    assert (got == decoders.packed(*[deep[..., 0] >> 8] * 3)).all()
    for depth in (1, 2, 4):
        index = rng.integers(0, 1 << depth, (3, 7))
        bits = ((index[..., None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(3, -1)
        rows = np.packbits(bits, axis=1)
        table = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
        got = decoders.decode_png(png(7, 3, depth, 3, filtered(rows, 1, [0, 1, 2]), chunk(b"PLTE", table.tobytes()), chunk(b"tRNS", b"\x07")))
        assert (got == decoders.packed(*(table[index, i] for i in range(3)), np.where(index == 0, 7, 255))).all()
        grey = decoders.decode_png(png(7, 3, depth, 0, filtered(rows, 1, [4, 3, 2])))
        assert (grey == decoders.packed(*[index * (255 // ((1 << depth) - 1))] * 3)).all()


def test_interlaced_png():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (9, 10), (3, 2), (8, 17)):
        px = argb(rng, shape)
        raw = b""
        for top, left, down, across in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)):
            part = channels(px)[top::down, left::across]
            if part.size:
                raw += filtered(part.reshape(len(part), -1), 4, [y % 5 for y in range(len(part))])
        assert (decoders.decode_png(png(shape[1], shape[0], 8, 6, raw, interlaced=1)) == px).all()


def lzw(index, bits):
    """A GIF's compression with a table that starts anew when it is full."""
    out, held, count = bytearray(), 0, 0

    def put(code, size):
        nonlocal held, count
        held |= code << count
        count += size
        while count >= 8:
            out.append(held & 255)
            held >>= 8
            count -= 8

    def fresh():
        return {bytes([i]): i for i in range(1 << bits)}, bits + 1, (1 << bits) + 2

    put(1 << bits, bits + 1)
    table, size, following = fresh()
    word = b""
    for i in index:
        if word + bytes([i]) in table:
            word += bytes([i])
            continue
        put(table[word], size)
        if following < 4096:
            table[word + bytes([i])] = following
            following += 1
            if following > 1 << size and size < 12:
                size += 1
        else:
            put(1 << bits, size)
            table, size, following = fresh()
        word = bytes([i])
    put(table[word], size)
    put((1 << bits) + 1, size)
    put(0, 7)
    return bytes(out)


def gif(canvas, at, index, table, *, hidden=None, interlaced=False):
    h, w = index.shape
    bits = max(2, int(len(table) - 1).bit_length())
    rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(h)
    body = lzw(index[rows].reshape(-1).tolist(), bits)
    parts = b"".join(bytes([len(p)]) + p for p in (body[i : i + 200] for i in range(0, len(body), 200))) + b"\0"
    control = b"\x21\xf9\x04" + bytes([hidden is not None, 0, 0, hidden or 0]) + b"\0"
    comment = b"\x21\xfe\x03abc\0"
    screen = struct.pack("<HHBBB", canvas[1], canvas[0], 0x80 | (bits - 1), 0, 0)
    colours = table.tobytes().ljust(3 << bits, b"\0")
    return b"GIF89a" + screen + colours + comment + control + struct.pack("<BHHHHB", 0x2C, at[1], at[0], w, h, 0x40 if interlaced else 0) + bytes([bits]) + parts + b"\x3b"


@pytest.mark.parametrize(("shape", "colours"), [((1, 1), 2), ((6, 7), 4), ((40, 90), 16), ((120, 130), 200)])
def test_gif(shape, colours):
    rng = np.random.default_rng(colours)
    index, table = rng.integers(0, colours, shape), rng.integers(0, 256, (colours, 3), dtype=np.uint8)
    want = decoders.packed(*(table[index, i] for i in range(3)))
    assert (decoders.decode_gif(gif(shape, (0, 0), index, table)) == want).all()
    assert (decoders.decode_gif(gif(shape, (0, 0), index, table, interlaced=True)) == want).all()
    seen = decoders.decode_gif(gif((shape[0] + 3, shape[1] + 4), (1, 2), index, table, hidden=0))
    assert (seen[1 : 1 + shape[0], 2 : 2 + shape[1]] == np.where(index == 0, want & 0xFFFFFF, want)).all() and (seen[0] == 0).all()


def tiff(px, packing=1, order="<", differences=False):
    h, w, n = px.shape
    rows = px.astype(np.uint8)
    if differences:
        rows = np.diff(rows, axis=1, prepend=np.zeros((h, 1, n), np.uint8)).astype(np.uint8)
    cuts = [rows[: h // 2].tobytes(), rows[h // 2 :].tobytes()]
    pack = {1: bytes, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(p) - 1]) + p for p in (b[i : i + 100] for i in range(0, len(b), 100))) + b"\x80"}[packing]
    strips = [pack(c) for c in cuts]
    at = [8, 8 + len(strips[0])]
    body = b"".join(strips)
    extra = 8 + len(body)
    more = struct.pack(f"{order}{n}H", *[8] * n) + struct.pack(order + "4I", *at, *map(len, strips))
    tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, n, extra if n > 2 else None), (259, 3, 1, packing), (262, 3, 1, 2 if n > 2 else 1), (273, 4, 2, extra + 2 * n), (277, 3, 1, n), (279, 4, 2, extra + 2 * n + 8), (317, 3, 1, 2 if differences else 1)] + ([(338, 3, 1, 2)] if n in (2, 4) else [])
    entries = b""
    for tag, kind, count, value in tags:
        field = struct.pack(f"{order}{count}H", *[8] * count).ljust(4, b"\0") if value is None else struct.pack(order + "H2x", value) if kind == 3 and count == 1 else struct.pack(order + "I", value)
        entries += struct.pack(order + "HHI", tag, kind, count) + field
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", extra + len(more)) + body + more + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0)


@pytest.mark.parametrize("packing", [1, 8, 32773])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(packing, order):
    rng = np.random.default_rng(packing)
    for n in (1, 2, 3, 4):
        px = rng.integers(0, 256, (6, 9, n))
        for differences in (False, True):
            got = decoders.decode_tiff(tiff(px, packing, order, differences))
            rgb = [px[..., i if n > 2 else 0] for i in range(3)]
            assert (got == decoders.packed(*rgb, px[..., -1] if n in (2, 4) else 255)).all()


def bmp(px):
    body = channels(px)[::-1, :, [2, 1, 0, 3]].tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, px.shape[1], px.shape[0], 1, 32, 0, len(body), 0, 0, 0, 0) + body


def good_files(rng):
    px = argb(rng, (6, 5))
    index, table = rng.integers(0, 4, (6, 5)), rng.integers(0, 256, (4, 3), dtype=np.uint8)
    return {
        "a.png": (images.png(px), "Png", px),
        "camera": (bmp(px), "Bmp", px),
        "b.jpg": (gif((6, 5), (0, 0), index, table), "Gif", decoders.packed(*(table[index, i] for i in range(3)))),
        "c.tif": (tiff(channels(px)), "Tiff", px),
    }


BAD = {
    "empty.png": (b"", "Unknown", "unknown"),
    "text.png": (b"not an image at all", "Unknown", "unknown"),
    "photo.jpg": (b"\xff\xd8\xff\xe0 photo", "Jpeg", "unsupported"),
    "short.png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", "Png", "broken"),
    "short.gif": (b"GIF89a\x05", "Gif", "broken"),
    "short.tif": (b"II*\0\xff\xff\xff\x7f", "Tiff", "broken"),
    "short.bmp": (b"BM12345678", "Bmp", "broken"),
    "huge.png": (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 6, 0, 0, 0)) + chunk(b"IEND", b""), "Png", "broken"),
}


def test_damaged_files_raise_their_own_error():
    rng = np.random.default_rng(5)
    for data, name, _ in good_files(rng).values():
        for _ in range(120):
            broken = bytearray(data)
            for at in rng.integers(0, len(data), 3):
                broken[at] = rng.integers(0, 256)
            cut = bytes(broken[: rng.integers(1, len(data) + 1)])
            try:
                decoders.decode(cut, name)
            except decoders.ImageError as wrong:
                assert wrong.kind in ("broken", "unsupported")


def test_source_and_funnel(spark, tmp_path):
    good = good_files(np.random.default_rng(6))
    os.makedirs(f"{tmp_path}/in/deeper")
    for name, (data, *_) in (good | BAD).items():
        with open(f"{tmp_path}/in/{'deeper/' if name < 'c' else ''}{name}", "wb") as f:
            f.write(data)
    image_source.register(spark)
    read = spark.read.format("images").option("partitionBytes", 200).load(f"{tmp_path}/in")
    funnel = image_source.load(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/in"))
    empty = spark.createDataFrame([("x/empty.png", bytearray(b"")), ("x/null.png", None)], "path string, content binary")
    assert [(r.error_kind, r.error) for r in image_source.load(empty).collect()] == [("unknown", f"'{n}.png' is not a supported image.") for n in ("empty", "null")]
    for df in (read, funnel):
        rows = {os.path.basename(r.path): r for r in df.collect()}
        missing = {"empty.png"} if df is funnel else set()  # Spark's own source passes over files without bytes
        assert rows.keys() == (good | BAD).keys() - missing
        for name, (_, kind, px) in good.items():
            r = rows[name]
            assert (r.format, r.width, r.height, r.error) == (kind, 5, 6, None) and (np.frombuffer(r.argb, "<i4").reshape(6, 5) == px).all()
        for name, (_, kind, error) in BAD.items():
            if name in missing:
                continue
            r = rows[name]
            assert (r.format, r.error_kind, r.argb) == (kind, error, None) and name in r.error
    assert read.rdd.getNumPartitions() > 3
    px = image_source.pixels(read.filter("path like '%a.png'"))
    assert {(r.y, r.x): r.argb for r in px.collect()} == {at: int(v) for at, v in np.ndenumerate(good["a.png"][2])}
    assert image_source.pixels(read.filter("error is not null")).count() == 0


def test_sniffing_as_columns_do(spark):
    heads = [d for d, *_ in good_files(np.random.default_rng(7)).values()] + [d for d, *_ in BAD.values()] + [b"RIFF1234WEBP", b"8BPS", b"\0\0\0\x18ftypavif", b"\0\0\0\x18ftypheic", b"\0\0\0\x18ftypmp42", b"MM\0*", b"BM"]
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "content binary")
    assert [r[0] for r in df.select(images.image_format(F.col("content"))).collect()] == [decoders.sniff(h) for h in heads]


def test_sink_commits_all_or_nothing(spark, tmp_path):
    image_source.register(spark)
    rng = np.random.default_rng(8)
    px = spark.createDataFrame([(i, y, x, int(argb(rng, 1)[0])) for i in range(5) for y in range(3) for x in range(4)], "image_id long, y int, x int, argb int").cache()
    files = images.encode_png(px).select(F.concat("image_id", F.lit(".png")).alias("name"), "content")
    os.makedirs(f"{tmp_path}/out")
    files.repartition(3).write.format("images").mode("append").save(f"{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out")) == [f"{i}.png" for i in range(5)]
    again = image_source.pixels(spark.read.format("images").load(f"{tmp_path}/out"))
    assert sorted(r.argb for r in again.collect()) == sorted(r.argb for r in px.collect())
    os.makedirs(f"{tmp_path}/none")
    for wrong in (files.union(spark.createDataFrame([("a/b", bytearray(b"x"))], "name string, content binary")).repartition(6), files.union(files.limit(1))):
        with pytest.raises(Exception):
            wrong.write.format("images").mode("append").save(f"{tmp_path}/none")
        assert os.listdir(f"{tmp_path}/none") == []


def test_first_usable_content(spark):
    png_, text = images.png(np.zeros((1, 1), np.int32)), b"plain text"
    rows = [(1, png_, None), (2, text, png_), (3, None, None), (4, b"", png_), (5, text, text)]
    df = spark.createDataFrame([(i, *(None if x is None else bytearray(x) for x in c)) for i, *c in rows], "id int, a binary, b binary")
    got = {r.id: r.c for r in df.select("id", images.first_usable(F.col("a"), F.col("b")).alias("c")).collect()}
    assert {i: bytes(c) if c is not None else None for i, c in got.items()} == {1: png_, 2: png_, 3: None, 4: png_, 5: None}


def test_where_a_page_has_its_picture(spark):
    rows = [("http://x/a.html", "<img src='ftp://y/z.png'><IMG alt=q src=\"https://y/z.gif\">"), ("https://x/a.PNG?w=1", "<p>"), ("ftp://x/a.png", ""), ("http://x/a.png.html", None), (None, None)]
    df = spark.createDataFrame(rows, "url string, html string")
    assert [r[0] for r in df.select(images.page_source(F.col("url"), F.col("html"))).collect()] == ["https://y/z.gif", "https://x/a.PNG?w=1", None, None, None]
