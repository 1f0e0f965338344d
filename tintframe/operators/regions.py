"""Regions of equal index: labels, areas, merging of small ones, ground fill, contours."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch
from . import batches, filters, graph
from .nearest import nearest, nearest_of_own, nearest_to


def _rooted(value: np.ndarray, width: np.ndarray, across: np.ndarray, along: np.ndarray) -> np.ndarray:
    """The first place of each place's 4-connected region of equal value.

    ``across`` and ``along`` tell which places have one to their right and, ``width`` on, below.
    """
    root = np.arange(value.size)
    right, below = np.flatnonzero(across), np.flatnonzero(along)
    edges = np.concatenate([np.stack([right + 1, right]), np.stack([below + width[below], below])], axis=1)
    edges = edges[:, value[edges[0]] == value[edges[1]]]
    while edges.size:
        low = np.minimum(root[edges[0]], root[edges[1]])
        before = root.copy()
        np.minimum.at(root, root[edges[0]], low)
        np.minimum.at(root, root[edges[1]], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root


def label_grid(index: np.ndarray) -> np.ndarray:
    """4-connected regions of equal value, numbered by their first pixel in row order."""
    height, width = index.shape
    place = np.arange(index.size)
    root = _rooted(index.reshape(-1), np.full(index.size, width), place % width < width - 1, place < index.size - width)
    return np.unique(root, return_inverse=True)[1].reshape(height, width)


class _Images:
    """Rectangles of pixels in one table, sorted by ``keys``, y and x."""

    def __init__(self, table: pa.Table, keys: list[str]):
        self.y, self.x, self.value = (table[c].to_numpy() for c in ("y", "x", "cand_idx"))
        self.starts = batches.starts_of(table, keys)
        lines = batches.starts_of(table, [*keys, "y"])
        sizes = np.diff(self.starts)
        self.image = np.repeat(np.arange(len(sizes)), sizes)
        self.width = np.repeat(np.diff(lines), np.diff(lines))
        if (self.width != self.width[self.starts[:-1]][self.image]).any():
            raise ValueError("an image's lines have the same number of pixels each")
        self.across = np.ones(len(self.y), bool)
        self.across[lines[1:] - 1] = False
        self.along = np.arange(len(self.y)) + self.width < self.starts[1:][self.image]

    def rooted(self) -> np.ndarray:
        return _rooted(self.value, self.width, self.across, self.along)


def labels(indexed: DataFrame) -> DataFrame:
    """``image_id, y, x, cand_idx, region_id`` of images given as ``cand_idx`` per pixel.

    One task labels an image, so an image has to fit a worker; small ones are labelled together.
    """

    def run(table: pa.Table) -> pa.Table:
        images = _Images(table, ["image_id"])
        number = np.unique(images.rooted(), return_inverse=True)[1].astype(np.int64)
        # an image's first pixel has its first region
        return table.append_column("region_id", pa.array(number - number[images.starts[:-1]][images.image]))

    cast = indexed.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("cand_idx").cast("int"))
    return batches.map_groups(cast, ["image_id"], ["y", "x"], run, "image_id long, y int, x int, cand_idx int, region_id long")


#: Bits of a pixel's place that are its column: places are ordered as rows are read.
_ROW = 31


def labels_tiled(indexed: DataFrame, tile: int = 1024) -> DataFrame:
    """The rows of :func:`labels` for images of any size: a task holds ``tile`` squared pixels.

    Regions are labelled tile by tile and named by their first pixel. Pixels on both sides of a
    tile's border that are alike make two names equal; connected components over these equalities
    give each name the least of its component, which is the first pixel of the whole region.
    Regions are then numbered in the order of their names.
    """
    if tile < 1:
        raise ValueError("a tile has a pixel")

    keys = ["image_id", "ty", "tx"]

    def run(table: pa.Table) -> pa.Table:
        place = (table["y"].to_numpy().astype(np.int64) << _ROW) | table["x"].to_numpy()
        return table.select(["image_id", "y", "x", "cand_idx"]).append_column("name", pa.array(place[_Images(table, keys).rooted()]))

    cast = indexed.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("cand_idx").cast("int"), F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    named = scratch.save(batches.map_groups(cast, keys, ["y", "x"], run, "image_id long, y int, x int, cand_idx int, name long"), "tiles")
    pairs = None
    for across, along in (("x", "y"), ("y", "x")):
        here = named.filter(F.col(across) % tile == 0).select("image_id", along, (F.col(across) - 1).alias(across), "cand_idx", F.col("name").alias("u"))
        there = named.filter(F.col(across) % tile == tile - 1).select("image_id", along, across, "cand_idx", F.col("name").alias("v"))
        met = here.join(there, ["image_id", along, across, "cand_idx"]).select(F.col("image_id").alias("graph"), "u", "v").distinct()
        pairs = met if pairs is None else pairs.union(met)
    same = graph.components(pairs)
    names = named.select("image_id", "name").distinct().join(same.select(F.col("graph").alias("image_id"), F.col("node").alias("name"), "root"), ["image_id", "name"], "left")
    rooted = names.withColumn("root", F.coalesce("root", "name"))
    number = F.dense_rank().over(W.partitionBy("image_id").orderBy("root")) - 1
    numbered = rooted.select("image_id", "name", number.cast("long").alias("region_id"))
    return named.join(numbered, ["image_id", "name"]).select("image_id", "y", "x", "cand_idx", "region_id")


def adjacency(labelled: DataFrame) -> DataFrame:
    """image_id, a, b: the pairs ``a < b`` of regions that touch along an edge, each once."""
    found = None
    for along, order in (("y", "x"), ("x", "y")):
        beside = F.lead("region_id").over(W.partitionBy("image_id", along).orderBy(order))
        met = labelled.select("image_id", F.col("region_id").alias("p"), beside.alias("q")).filter("p <> q")
        found = met if found is None else found.union(met)
    return found.select("image_id", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def areas(labelled: DataFrame) -> DataFrame:
    """image_id, region_id, cand_idx, area."""
    return labelled.groupBy("image_id", "region_id").agg(F.first("cand_idx").alias("cand_idx"), F.count("*").alias("area"))


def count_regions(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image_id").agg(F.countDistinct("region_id").alias("regions"))


def small_fraction(labelled: DataFrame, least: int) -> DataFrame:
    """Share of an image's pixels in regions of fewer than ``least``."""
    small = F.sum(F.when(F.col("area") < least, F.col("area")).otherwise(0))
    return areas(labelled).groupBy("image_id").agg((small / F.sum("area")).alias("fraction"))


def merge_graph(area: list[int], near: list[set[int]], least: int) -> np.ndarray:
    """Which region each one ends up in, when every one under ``least`` pixels joins a neighbour.

    The smallest region goes first, to its largest neighbour that is large enough, else to its
    largest neighbour; ties to the lowest region. A region that is still too small queues
    again. ``area`` and ``near`` are changed.
    """
    into = list(range(len(area)))

    def root(i: int) -> int:
        while into[i] != i:
            into[i] = i = into[into[i]]
        return i

    queue = [(n, i) for i, n in enumerate(area) if n < least]
    heapq.heapify(queue)
    while queue:
        n, i = heapq.heappop(queue)
        if into[i] != i or area[i] != n or n >= least:
            continue
        around = {root(j) for j in near[i]} - {i}
        if not around:
            continue
        target = min(around, key=lambda j: (area[j] < least, -area[j], j))
        into[i] = target
        area[target] += n
        near[target] |= near[i]
        if area[target] < least:
            heapq.heappush(queue, (area[target], target))
    return np.array([root(i) for i in range(len(area))], np.int64)


def merge_grid(grid: np.ndarray, least: int) -> np.ndarray:
    """A grid of values after its regions under ``least`` pixels are merged by :func:`merge_graph`."""
    width, place = grid.shape[1], np.arange(grid.size)
    return _merged(grid.reshape(-1), label_grid(grid).reshape(-1), np.full(grid.size, width), place % width < width - 1, place < grid.size - width, least).reshape(grid.shape)


def _merged(value: np.ndarray, region: np.ndarray, width: np.ndarray, across: np.ndarray, along: np.ndarray, least: int) -> np.ndarray:
    """The values after merging; places lie as in :func:`_rooted`. Images do not touch, so one graph holds them all."""
    count = int(region.max()) + 1
    area = np.bincount(region, minlength=count).tolist()
    own = np.empty(count, value.dtype)
    own[region] = value
    right, below = np.flatnonzero(across), np.flatnonzero(along)
    a = np.concatenate([region[right], region[below]])
    b = np.concatenate([region[right + 1], region[below + width[below]]])
    near: list[set[int]] = [set() for _ in range(count)]
    pair = np.unique((a * count + b)[a != b])
    for p, q in zip((pair // count).tolist(), (pair % count).tolist(), strict=True):
        near[p].add(q)
        near[q].add(p)
    return own[merge_graph(area, near, least)[region]]


def merge_regions(labelled: DataFrame, mark: float) -> DataFrame:
    """image_id, y, x, cand_idx of labelled pixels after regions under ``ceil(mark ** 2)`` pixels are merged.

    A task takes the graph of an image, its regions' areas and which of them touch, and never
    its pixels, which get the result by a join. With :func:`labels_tiled` before it an image
    may be of any size, if its regions fit a worker.
    """
    least = math.ceil(mark * mark)
    pixels = labelled.select("image_id", "y", "x", "cand_idx", "region_id")
    if least <= 1:
        return pixels.drop("region_id")

    def run(table: pa.Table) -> pa.Table:
        # an image's regions are numbered from 0 without gaps
        starts = batches.starts_of(table, ["image_id"])
        base = np.repeat(starts[:-1], np.diff(starts))
        beside = table["beside"].combine_chunks()
        of = pc.list_parent_indices(beside).to_numpy()
        near: list[set[int]] = [set() for _ in range(table.num_rows)]
        for p, q in zip(of.tolist(), (base[of] + pc.list_flatten(beside).to_numpy()).tolist(), strict=True):
            near[p].add(q)
            near[q].add(p)
        into = merge_graph(table["area"].to_pylist(), near, least)
        return pa.table({"image_id": table["image_id"], "region_id": table["region_id"], "cand_idx": pa.array(table["cand_idx"].to_numpy()[into], pa.int32())})

    sizes = areas(labelled)
    # an image without a small region has nothing to merge, and its graph goes nowhere
    open_images = sizes.groupBy("image_id").agg(F.min("area").alias("smallest")).filter(F.col("smallest") < least).select("image_id")
    beside = adjacency(labelled).groupBy("image_id", F.col("a").alias("region_id")).agg(F.collect_list("b").alias("beside"))
    graphs = sizes.join(open_images, "image_id", "left_semi").join(beside, ["image_id", "region_id"], "left")
    typed = graphs.select(F.col("image_id").cast("long"), "region_id", F.col("cand_idx").cast("int"), "area", F.coalesce("beside", F.array().cast("array<bigint>")).alias("beside"))
    merged = batches.map_groups(typed, ["image_id"], ["region_id"], run, "image_id long, region_id long, cand_idx int")
    met = pixels.join(merged.withColumnRenamed("cand_idx", "merged"), ["image_id", "region_id"], "left")
    return met.select("image_id", "y", "x", F.coalesce("merged", "cand_idx").alias("cand_idx"))


def merge_small(indexed: DataFrame, mark: float) -> DataFrame:
    """Pixels with ``cand_idx`` after regions under ``ceil(mark ** 2)`` pixels are merged."""
    least = math.ceil(mark * mark)
    if least <= 1:
        return indexed

    def run(table: pa.Table) -> pa.Table:
        images = _Images(table, ["image_id"])
        region = np.unique(images.rooted(), return_inverse=True)[1]
        merged = _merged(images.value, region, images.width, images.across, images.along, least)
        return table.set_column(table.schema.get_field_index("cand_idx"), "cand_idx", pa.array(merged, pa.int32()))

    typed = indexed.withColumn("cand_idx", F.col("cand_idx").cast("int"))
    return batches.map_groups(typed, ["image_id"], ["y", "x"], run, typed.schema)


def ground_fill(indexed: DataFrame, cands: DataFrame, mark: float) -> DataFrame:
    """Recolour each image's largest region at the border to a quiet ground of its hue.

    The region needs ``ceil(4 * mark ** 2)`` pixels; the first of equal ones is taken.
    Candidates with an ``image_id`` are those of their own image.
    """
    own = ["image_id"] if "image_id" in cands.columns else []
    labelled = labels(indexed)
    edge = labelled.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    border = labelled.join(edge, "image_id").filter("x = 0 or y = 0 or x = mx or y = my").select("image_id", "region_id").distinct()
    touching = areas(labelled).join(border, ["image_id", "region_id"], "left_semi").filter(F.col("area") >= max(1, math.ceil(4 * mark * mark)))
    field = touching.groupBy("image_id").agg(F.max_by(F.struct("region_id", "cand_idx"), F.struct("area", (-F.col("region_id")).alias("r"))).alias("f")).select("image_id", F.col("f.region_id").alias("field"), F.col("f.cand_idx").alias("field_idx"))
    source = cands.select(*own, F.col("cand_idx").alias("field_idx"), "a", "b")
    chroma = F.hypot("a", "b")
    scale = F.when(chroma <= 1e-9, 0.0).otherwise(F.least(0.35 * chroma, F.lit(25.0)) / chroma)
    wanted = field.select(*own, "field_idx").distinct().join(source, [*own, "field_idx"]).select(*own, "field_idx", F.lit(58.0).alias("l"), (F.col("a") * scale).alias("a"), (F.col("b") * scale).alias("b"))
    swap = (nearest_of_own if own else nearest)(wanted, cands, key="field_idx", lightness=1.5).withColumnRenamed("cand_idx", "ground_idx")
    filled = labelled.join(field.join(swap, [*own, "field_idx"]), "image_id", "left")
    return filled.select("image_id", "y", "x", F.when(F.col("region_id") == F.col("field"), F.col("ground_idx")).otherwise(F.col("cand_idx")).alias("cand_idx"))


def contour_lines(indexed: DataFrame, cands: DataFrame, mark: float) -> DataFrame:
    """Paint the widened strong boundaries with the candidate nearest to a dark violet."""
    radius = max(1, round(mark * 0.10))
    line = nearest_to(cands, 35.0, 5.0, -15.0)
    wide = filters.dilate(filters.contour_mask(indexed, cands), "boundary", radius)
    return wide.withColumn("cand_idx", F.when(F.col("boundary"), F.lit(line)).otherwise(F.col("cand_idx"))).drop("boundary")
