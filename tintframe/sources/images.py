"""Reading and writing images, palettes and pigments: formats, pixels, checksums."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color, pigments
from . import decoders

NATIVE = ("Png", "Jpeg", "Gif", "Bmp", "Tiff")

def image_format(content: Column) -> Column:
    """Format of an encoded image by its first bytes."""
    n = F.octet_length(content)
    head = lambda at, size: F.hex(F.substring(content, at + 1, size))
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    iso = F.when(n < 12, "Unknown").when(brand.isin(*decoders.AVIF_BRANDS), "Avif").when(brand.isin(*decoders.HEIF_BRANDS), "Heif").otherwise("Unknown")
    return (
        F.when(content.isNull() | (n < 4), "Unknown")
        .when(head(0, 8) == "89504E470D0A1A0A", "Png")
        .when(head(0, 3) == "FFD8FF", "Jpeg")
        .when(head(0, 6).isin("474946383761", "474946383961"), "Gif")
        .when(head(0, 2) == "424D", "Bmp")
        .when(head(0, 4).isin("49492A00", "4D4D002A"), "Tiff")
        .when(head(0, 4) == "38425053", "Psd")
        .when((head(0, 4) == "52494646") & (head(8, 4) == "57454250"), "Webp")
        .when(head(4, 4) == "66747970", iso)
        .otherwise("Unknown")
    )


def natively_decodable(name: Column) -> Column:
    return name.isin(*NATIVE)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, format of the image files under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content", image_format(F.col("content")).alias("format"))


def decode(files: DataFrame) -> DataFrame:
    """``image_id, content`` to ``image_id, y, x, argb``; a file that cannot be decoded raises.

    ``image_source.load`` tells of such files instead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, content in zip(batch["image_id"], batch["content"], strict=True):
                argb = decoders.decode(content, decoders.sniff(content))
                y, x = np.indices(argb.shape, dtype=np.int32)
                yield pd.DataFrame({"image_id": image_id, "y": y.reshape(-1), "x": x.reshape(-1), "argb": argb.reshape(-1)})

    return files.select(F.col("image_id").cast("long"), "content").mapInPandas(run, "image_id long, y int, x int, argb int")


def from_rgba(images: DataFrame) -> DataFrame:
    """``image_id, width, height, rgba`` to pixels; a wrong length raises."""
    checked = F.when(F.octet_length("rgba") == F.col("width") * F.col("height") * 4, F.hex("rgba")).otherwise(F.raise_error(F.lit("rgba has not width * height * 4 bytes")))
    at = images.select("image_id", "width", checked.alias("h")).select("*", F.explode(F.sequence(F.lit(0), (F.length("h") / 8).cast("int") - 1)).alias("i"))
    byte = lambda k: F.conv(F.substring(F.col("h"), F.col("i") * 8 + 1 + 2 * k, F.lit(2)), 16, 10).cast("int")
    return at.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), color.pack(byte(3), byte(0), byte(1), byte(2)).alias("argb"))


def to_rgba(pixels: DataFrame) -> DataFrame:
    """image_id, rgba: an image's bytes in row order. An image is one row and has to fit it."""
    a, r, g, b = color.channels(F.col("argb"))
    four = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in (r, g, b, a)))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", four.alias("h"))))
    return pixels.groupBy("image_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda p: p["h"]), "")).alias("rgba"))


def png(argb: np.ndarray) -> bytes:
    """An 8-bit RGBA PNG of packed colours."""
    px = argb.view(np.uint32)
    rgba = np.stack([(px >> s).astype(np.uint8) for s in (16, 8, 0, 24)], axis=-1)
    raw = np.concatenate([np.zeros((len(px), 1), np.uint8), rgba.reshape(len(px), -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_png(pixels: DataFrame) -> DataFrame:
    """image_id, content: PNG bytes of each image."""

    def run(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values(["y", "x"])
        grid = image["argb"].to_numpy(np.int32).reshape(image["y"].nunique(), -1)
        return pd.DataFrame({"image_id": [image["image_id"].iloc[0]], "content": [png(grid)]})

    return pixels.select("image_id", "y", "x", "argb").groupBy("image_id").applyInPandas(run, "image_id long, content binary")


def checksum(pixels: DataFrame) -> DataFrame:
    """image_id, checksum: FNV-1a over the packed colours in row order, as 16 hex digits."""

    def run(image: pd.DataFrame) -> pd.DataFrame:
        h = 14695981039346656037
        for p in (image.sort_values(["y", "x"])["argb"].to_numpy(np.int64) & 0xFFFFFFFF).tolist():
            h = (h ^ p) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        return pd.DataFrame({"image_id": [image["image_id"].iloc[0]], "checksum": [f"{h:016x}"]})

    return pixels.select("image_id", "y", "x", "argb").groupBy("image_id").applyInPandas(run, "image_id long, checksum string")


def palette_from_json(saved: Column) -> Column:
    """Saved paint names; null where nothing usable was saved."""
    names = F.from_json(saved, "array<string>")
    return F.when(F.size(names) > 0, names)


def palette_to_json(names: Column) -> Column:
    return F.to_json(names)


def query_value(url: Column, name: str) -> Column:
    """A parameter of a URL's query, null if it is absent."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def autorun(url: Column) -> Column:
    """The style number 1 to 9 that a URL asks to run, else null."""
    n = query_value(url, "autorun")
    return F.when(n.rlike("^[1-9]$"), n.cast("int"))


def image_sources(html: Column) -> Column:
    """Addresses of the images in a page that http or https reaches."""
    return F.filter(F.regexp_extract_all(html, F.lit(r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']"""), 1), lambda u: u.rlike("(?i)^https?://"))


#: Fixed value: no larger content is taken.
MOST_BYTES = 64 << 20


def first_usable(*contents: Column) -> Column:
    """The first of several contents of an image, in the order given: one that has bytes, not too
    many, and a known format; null if none has."""
    usable = lambda c: F.when((F.octet_length(c) <= MOST_BYTES) & (image_format(c) != "Unknown"), c)
    return F.coalesce(*map(usable, contents))


def page_source(url: Column, html: Column) -> Column:
    """Where to load a page's picture from: its first image that http or https reaches, else the
    page's own address if that names an image file."""
    own = F.when(url.rlike(r"(?i)^https?://[^?#]*\.(png|jpe?g|jfif|bmp|gif|tiff?|webp|avif|hei[cf]|psd)([?#]|$)"), url)
    return F.coalesce(F.get(image_sources(html), 0), own)


def manifest_line(name: Column, index: Column, provenance: Column, lab: tuple[Column, Column, Column]) -> Column:
    return F.format_string("%s | %s | %s | %.2f | %.2f | %.2f", name, index, provenance, *lab)


def sheet_rows(data: bytes, member: str = "xl/worksheets/sheet1.xml") -> list[list[str | None]]:
    """Cells of a sheet of an xlsx file, sparse rows padded, shared strings looked up."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{{{ns['m']}}}t")) for item in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    rows = []
    for row in ET.fromstring(book.read(member)).iter(f"{{{ns['m']}}}row"):
        cells: list[str | None] = []
        for cell in row.findall("m:c", ns):
            letters = "".join(c for c in cell.get("r", "") if c.isalpha())
            at = 0
            for c in letters:
                at = at * 26 + ord(c) - 64
            cells += [None] * (at - 1 - len(cells))
            value = cell.find("m:v", ns)
            text = value.text if value is not None else None
            cells.append(shared[int(text)] if cell.get("t") == "s" and text is not None else text)
        rows.append(cells)
    return rows


def derive_pigments(spectra: DataFrame, known: DataFrame) -> DataFrame:
    """name, k, s of measured spectra ``name, pct`` (31 percentages as strings) not yet known.

    Names are compared without case; rows without a name or with a value that is no number
    are dropped; scattering is 1.
    """
    value = F.transform("pct", lambda p: p.try_cast("double") / 100)
    sound = spectra.filter(F.trim("name") != "").withColumn("r", value).filter((F.size("r") == 31) & F.forall("r", lambda x: x.isNotNull()))
    new = sound.join(known.select(F.lower("name").alias("low")).distinct(), F.lower(sound["name"]) == F.col("low"), "left_anti")
    ones = F.array_repeat(F.lit(1.0), pigments.BANDS)
    return new.select("name", F.transform(pigments.resample(F.col("r")), pigments.absorption).alias("k"), ones.alias("s"))


def by_name():
    """The order in which derived paints are added to a palette, a short list."""
    return W.orderBy("name")


def grid_segments(sizes: DataFrame, parts: int) -> DataFrame:
    """image_id, axis, at: the dividers of a grid of ``parts`` by ``parts``, borders included."""
    at = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("i"))
    return at.select("image_id", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), (F.col(n) * F.col("i") / parts).alias("at")) for a, n in (("x", "width"), ("y", "height"))))).alias("d")).select("image_id", "d.*")


def image_pixel(px: Column, py: Column, *, offset: tuple[float, float], scale: float, width: int, height: int) -> tuple[Column, Column]:
    """The image pixel under a point of the view, null outside."""
    x, y = (F.floor((p - o) / scale).cast("int") for p, o in zip((px, py), offset, strict=True))
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return F.when(inside, x), F.when(inside, y)


def median(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.percentile(column, 0.5).alias("median"))


def first_paints(paints: DataFrame, n: int) -> DataFrame:
    return paints.withColumn("at", F.row_number().over(W.orderBy("paint_idx"))).filter(F.col("at") <= n).drop("at")
