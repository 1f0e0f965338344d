import struct

import pytest

from tintframe.functions import pigments
from tintframe.operators import mixtures
from tintframe.sources import pigment_files


def paints(spark):
    derived = [(18, "Very long derived paint name " * 6, "D-1", "derived", [0.5] * pigments.BANDS, [1.0] * pigments.BANDS)]
    return mixtures.palette(spark).unionByName(spark.createDataFrame(derived, pigments.PIGMENT_DDL))


def test_files_hold_what_was_written(spark, tmp_path):
    rows = [tuple(r) for r in paints(spark).orderBy("paint_idx").collect()]
    pigment_files.write(paints(spark), f"{tmp_path}/set.bin")
    again = pigment_files.read(spark, f"{tmp_path}/set.bin")
    assert [tuple(r)[:-1] for r in again.orderBy("paint_idx").collect()] == rows
    assert again.first().path.endswith("set.bin")


def test_other_files_are_refused(spark):
    data = pigment_files.encode(paints(spark).orderBy("paint_idx").collect())
    for wrong in (b"PNGT" + data[4:], data[:4] + struct.pack("<i", 9) + data[8:], data[:8] + struct.pack("<i", 400) + data[12:], data[:-3], b"PG"):
        with pytest.raises(ValueError):
            pigment_files.decode(wrong)


def test_ingest_adds_new_paints(spark, tmp_path):
    spectra = spark.createDataFrame([("Slate", ["40"] * 31), ("mallow", ["50"] * 31), ("Ash", ["60"] * 31)], "name string, pct array<string>")
    pigment_files.ingest(spectra, mixtures.palette(spark), str(tmp_path))
    rows = pigment_files.read(spark, f"{tmp_path}/pigments.bin").orderBy("paint_idx").collect()
    assert [r.name for r in rows[17:]] == ["Coal", "Ash", "Slate"] and rows[18].provenance == "derived"
    lines = [r.value for r in spark.read.text(f"{tmp_path}/manifest").collect()]
    assert len(lines) == 20 and lines[0].startswith("Mallow | G500 | measured | ")
