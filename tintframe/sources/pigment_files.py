"""Pigment files: a small binary format, its reader, writer and the ingest of spectra."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, pigments
from ..operators import mixtures
from . import images

# Fixed values of the format: its mark, version and how a measured paint is tagged.
MARK, VERSION = b"PGMT", 1
PROVENANCE = ("measured", "derived")
_HEAD = struct.Struct("<4s5i")
_BANDS = struct.Struct(f"<{pigments.BANDS}d")


def _name(text: str) -> bytes:
    """UTF-8 text after its length in groups of seven bits, the least first."""
    data, length = text.encode(), bytearray()
    n = len(data)
    while n >= 128:
        length.append(n & 127 | 128)
        n >>= 7
    length.append(n)
    return bytes(length) + data


def _read_name(stream: io.BytesIO) -> str:
    n = shift = 0
    while True:
        (byte,) = stream.read(1)
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return stream.read(n).decode()


def encode(paints: list) -> bytes:
    """A palette's rows, in their order; a derived paint's scattering is 1 and left out."""
    out = [_HEAD.pack(MARK, VERSION, pigments.START_NM, pigments.STEP_NM, pigments.BANDS, len(paints))]
    for p in paints:
        kind = PROVENANCE.index(p.provenance)
        out += [_name(p.name), _name(p.colour_index), bytes([kind]), _BANDS.pack(*p.k)]
        if kind == 0:
            out.append(_BANDS.pack(*p.s))
    return b"".join(out)


def decode(data: bytes) -> list[tuple]:
    """Rows of PIGMENT_DDL; a file of another kind, version or axis raises ValueError."""
    stream = io.BytesIO(data)
    try:
        mark, version, *axis, count = _HEAD.unpack(stream.read(_HEAD.size))
        if mark != MARK:
            raise ValueError("not a pigment file")
        if version != VERSION or axis != [pigments.START_NM, pigments.STEP_NM, pigments.BANDS]:
            raise ValueError(f"pigment file of version {version} on the axis {axis}")
        rows = []
        for at in range(count):
            name, index = _read_name(stream), _read_name(stream)
            kind = PROVENANCE[stream.read(1)[0]]
            k = list(_BANDS.unpack(stream.read(_BANDS.size)))
            s = list(_BANDS.unpack(stream.read(_BANDS.size))) if kind == "measured" else [1.0] * pigments.BANDS
            rows.append((at, name, index, kind, k, s))
        return rows
    except (struct.error, IndexError) as short:
        raise ValueError("a pigment file that ends too early") from short


def read(spark: SparkSession, path: str) -> DataFrame:
    """path and the columns of PIGMENT_DDL of the pigment files under ``path``."""
    names = [x.split()[0] for x in pigments.PIGMENT_DDL.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(decode(bytes(content)), columns=names).assign(path=at)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, pigments.PIGMENT_DDL + ", path string")


def write(paints: DataFrame, path: str) -> None:
    """One pigment file at ``path``, on any store that Spark writes. A palette is a short list."""
    spark = paints.sparkSession
    data = encode(paints.orderBy("paint_idx").collect())
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(data))
    stream.close()


def masstone(k: Column, s: Column) -> tuple[Column, Column, Column]:
    """XYZ of a paint by itself, from its arrays of absorption and scattering."""
    r = F.zip_with(k, s, pigments.reflectance)
    seen = lambda observer: F.aggregate(F.zip_with(r, F.array(*map(F.lit, observer)), lambda x, o: x * o), F.lit(0.0), lambda a, x: a + x) / pigments.NORM
    return tuple(map(seen, pigments.OBSERVERS))


def manifest(paints: DataFrame) -> DataFrame:
    """paint_idx, value: one text line a paint: name, colour index, provenance and masstone Lab."""
    seen = paints.select("*", *(c.alias(f"_{n}") for c, n in zip(masstone(F.col("k"), F.col("s")), "xyz", strict=True)))
    lab = color.xyz_to_lab(tuple(F.col(f"_{c}") for c in "xyz"))
    return seen.select("paint_idx", images.manifest_line(F.col("name"), F.col("colour_index"), F.col("provenance"), lab).alias("value"))


def write_manifest(paints: DataFrame, path: str) -> None:
    manifest(paints).coalesce(1).sortWithinPartitions("paint_idx").select("value").write.mode("overwrite").text(path)


def ingest(spectra: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Add the paints that measured ``spectra`` derive to the known ones; write file and manifest."""
    new = images.derive_pigments(spectra, known)
    last = known.agg(F.max("paint_idx")).first()[0]
    number = (F.row_number().over(images.by_name()) + F.lit(-1 if last is None else last)).cast("int")
    added = new.select(number.alias("paint_idx"), "name", F.lit("").alias("colour_index"), F.lit("derived").alias("provenance"), "k", "s")
    every = known.select(*added.columns).unionByName(added)
    write(every, f"{path}/pigments.bin")
    write_manifest(every, f"{path}/manifest")
    return every
