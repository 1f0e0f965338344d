"""Nearest-candidate joins. The metric is an argument: the uses differ in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color

#: Candidates are built from a palette: singles, pairs and triples of 19 paints at most.
MOST_CANDIDATES = 112_537
#: A power of two above that; squared distances in Lab leave it room in a long.
INDEX_ROOM = 1 << 17
#: Edge of the cells that points and candidates are sorted into.
CELL = 6.0
#: Places of candidates that a task keeps for the last cells, 8 bytes each.
KNOWN_PLACES = 1 << 20
#: Pairs of a point and a candidate measured at a time.
PAIRS = 1 << 17


class CandidateGrid:
    """Candidates by cells of Lab, lightness scaled as the metric weighs it.

    The nearest candidate of any point of a cell is among those whose least distance from the
    cell is not above the least of all largest distances from it.
    """

    def __init__(self, index: np.ndarray, lab: np.ndarray, lightness: float = 1.0):
        self.scale = np.array([np.sqrt(lightness), 1.0, 1.0])
        self.lightness = lightness
        order = np.argsort(index, kind="stable")
        self.index, self.lab = index[order], lab[order]
        self.cells, owner = np.unique(self.cell(self.lab), axis=0, return_inverse=True)
        self.members = np.argsort(owner.reshape(-1), kind="stable")
        self.starts = np.searchsorted(owner.reshape(-1)[self.members], np.arange(len(self.cells) + 1))
        self.known: dict[tuple, np.ndarray] = {}
        self.kept = 0

    def cell(self, lab: np.ndarray) -> np.ndarray:
        return np.floor(lab * self.scale / CELL).astype(np.int64)

    def near(self, cell: np.ndarray) -> np.ndarray:
        """Places of the candidates that can be nearest to a point of the cell, in order.

        The last cells asked for are kept, as images of a task ask for much the same ones.
        """
        asked = tuple(cell.tolist())
        if asked not in self.known:
            self.known[asked] = self._near(cell)
            self.kept += len(self.known[asked])
            while self.kept > KNOWN_PLACES and len(self.known) > 1:
                self.kept -= len(self.known.pop(next(iter(self.known))))
        return self.known[asked]

    def _near(self, cell: np.ndarray) -> np.ndarray:
        apart = np.abs(self.cells - cell)
        least, most = np.maximum(apart - 1, 0) * CELL, (apart + 1) * CELL
        may = np.flatnonzero((least**2).sum(axis=1) <= (most**2).sum(axis=1).min())
        some = np.sort(np.concatenate([self.members[self.starts[i] : self.starts[i + 1]] for i in may]))
        lab, low = self.lab[some] * self.scale, cell * CELL
        least, most = np.maximum(np.maximum(low - lab, lab - low - CELL), 0), np.maximum(np.abs(lab - low), np.abs(lab - low - CELL))
        return some[(least**2).sum(axis=1) <= (most**2).sum(axis=1).min() + 1e-6]

    def search(self, lab: np.ndarray) -> np.ndarray:
        """Index of the nearest candidate of each point; distances count to eight decimals."""
        out = np.empty(len(lab), np.int64)
        if not len(lab):
            return out
        cells, owner = np.unique(self.cell(lab), axis=0, return_inverse=True)
        order = np.argsort(owner.reshape(-1), kind="stable")
        cuts = np.searchsorted(owner.reshape(-1)[order], np.arange(len(cells) + 1))
        for cell, lo, hi in zip(cells, cuts[:-1], cuts[1:], strict=True):
            some = self.near(cell)
            wide = max(1, PAIRS // len(some))
            for at in range(lo, hi, wide):
                mine = order[at : min(hi, at + wide)]
                d = lab[mine][:, None, :] - self.lab[some][None, :, :]
                squared = self.lightness * d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
                out[mine] = self.index[some[np.floor(squared * 1e8 + 0.5).argmin(axis=1)]]
        return out


def collected(cands: DataFrame) -> pa.Table:
    """The candidates, whose number is checked, in the driver."""
    table = cands.limit(MOST_CANDIDATES + 1).toArrow()
    if table.num_rows > MOST_CANDIDATES:
        raise ValueError(f"more than the {MOST_CANDIDATES} candidates that a palette gives at most")
    return table


def lab_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(table[c]) for c in "lab"], axis=1).astype(np.float64)


def nearest(points: DataFrame, cands: DataFrame, *, key: str, lightness: float = 1.0) -> DataFrame:
    """``key, cand_idx``: per point (``l, a, b``) the candidate of least squared distance.

    ``lightness`` weighs the squared lightness gap. Distances are compared to eight decimals,
    ties go to the least index. The candidates, after a check of their number, are sorted
    into cells of Lab and broadcast; points are dealt by their cells, so that a task works
    out a cell's few possible candidates once. Without candidates there are no rows.
    """
    table = collected(cands)
    index, lab = np.asarray(table["cand_idx"]).astype(np.int64), lab_of(table)
    spark = points.sparkSession
    grid = spark.sparkContext.broadcast(CandidateGrid(index, lab, lightness) if len(index) else None)
    cell = F.struct(*(F.floor(F.col(c) * s / CELL).alias(c) for c, s in zip("lab", (float(np.sqrt(lightness)), 1.0, 1.0), strict=True)))
    dealt = points.select(key, "l", "a", "b").repartition(spark.sparkContext.defaultParallelism, cell).sortWithinPartitions(cell)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if grid.value is not None:
                found = grid.value.search(lab_of(batch))
                yield pa.RecordBatch.from_arrays([batch[key], pa.array(found, pa.int32())], names=[key, "cand_idx"])

    return dealt.mapInArrow(search, T.StructType([points.schema[key], T.StructField("cand_idx", T.IntegerType())]))


def nearest_of_own(points: DataFrame, cands: DataFrame, *, key: str, lightness: float = 1.0) -> DataFrame:
    """``image_id, key, cand_idx``: the same where each image has its own few candidates."""
    side = cands.select("image_id", "cand_idx", *(F.col(c).alias(f"c{c}") for c in "lab"))
    met = points.select("image_id", key, "l", "a", "b").join(side, "image_id")
    d = color.squared_distance(tuple(F.col(c) for c in "lab"), tuple(F.col(f"c{c}") for c in "lab"), lightness)
    # one long of distance and index: a struct would make Spark sort all pairs to aggregate them
    packed = F.floor(d * 1e8 + 0.5) * INDEX_ROOM + F.col("cand_idx")
    return met.groupBy("image_id", key).agg(F.min(packed).alias("best")).select("image_id", key, F.pmod("best", F.lit(INDEX_ROOM)).cast("int").alias("cand_idx"))


def nearest_to(cands: DataFrame, light: float, a: float, b: float, lightness: float = 1.5) -> int:
    """Index of the candidate nearest to one colour."""
    d = color.squared_distance(tuple(F.col(c) for c in "lab"), (F.lit(light), F.lit(a), F.lit(b)), lightness)
    return cands.agg(F.min(F.struct(F.round(d, 9).alias("d"), "cand_idx"))["cand_idx"]).first()[0]


def key_points(keys: DataFrame, remap=None, *, by: tuple[str, ...] = ("colour_key",)) -> DataFrame:
    """Lab (``l, a, b``) of 18-bit colour keys, of their bins' centres, after a ``remap``."""
    lab = color.rgb_to_lab(*color.key_to_rgb(F.col("colour_key")))
    points = keys.select("*", *(c.alias(n) for c, n in zip(lab, "lab", strict=True)))
    if remap is None:
        return points
    moved = remap(tuple(F.col(c) for c in "lab"))
    return points.select(*by, *(c.alias(n) for c, n in zip(moved, "lab", strict=True)))


def with_key(pixels: DataFrame) -> DataFrame:
    """``pixels`` with the 18-bit ``colour_key`` of ``argb``."""
    _, r, g, b = color.channels(F.col("argb"))
    return pixels.withColumn("colour_key", color.quantise(r, g, b))


def resolve_once(pixels: DataFrame, cands: DataFrame, remap=None) -> DataFrame:
    """Pixels with ``cand_idx``, worked out once per 18-bit colour key and joined back.

    A key stands for its bin's centre; ``remap`` turns its Lab before the search. There are
    at most 262,144 keys whatever the number of pixels, so the join back is on a small side,
    which Spark broadcasts below its own threshold. Candidates with an ``image_id`` serve
    their own image only; keys are then worked out once an image. ``remap`` may use a column
    ``ceiling`` of such candidates, the same for all of an image.
    """
    own = "image_id" in cands.columns
    by = ["image_id", "colour_key"] if own else ["colour_key"]
    keyed = with_key(pixels)
    keys = keyed.select(*by).distinct()
    if own and remap is not None:
        keys = keys.join(cands.groupBy("image_id").agg(F.max("ceiling").alias("ceiling")), "image_id")
    points = key_points(keys, remap, by=tuple(by))
    found = (nearest_of_own if own else nearest)(points, cands, key="colour_key")
    return keyed.join(found, by).drop("colour_key")


def resolve_per_pixel(pixels: DataFrame, cands: DataFrame, remap=None, *, lightness: float = 1.0) -> DataFrame:
    """Pixels with ``cand_idx`` of their exact colours, not of their bins.

    Equal colours of 24 bits are searched once, which gives each pixel the same as a search
    of its own.
    """
    rgb = F.col("argb").bitwiseAND(F.lit(0xFFFFFF))
    keyed = pixels.withColumn("rgb", rgb)
    _, r, g, b = color.channels(F.col("rgb"))
    lab = color.rgb_to_lab(r, g, b)
    points = keyed.select("rgb").distinct().select("rgb", *(c.alias(n) for c, n in zip(lab, "lab", strict=True)))
    if remap is not None:
        moved = remap(tuple(F.col(c) for c in "lab"))
        points = points.select("rgb", *(c.alias(n) for c, n in zip(moved, "lab", strict=True)))
    return keyed.join(nearest(points, cands, key="rgb", lightness=lightness), "rgb").drop("rgb")


def map_colours(colours: DataFrame, cands: DataFrame) -> DataFrame:
    """id, argb: what single colours ``id, argb`` are drawn in, by their bins as pixels are; opaque."""
    found = resolve_once(colours.select("id", "argb"), cands).select("id", "cand_idx")
    return found.join(cands.select("cand_idx", F.col("argb").bitwiseOR(F.lit(-(1 << 24))).alias("argb")), "cand_idx").select("id", "argb")
