"""The view of an image: zoom about an anchor, pan and fit, each held so that the image stays in view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a view is magnified up to so many times the fitted scale.
MOST_ZOOM = 16.0
_VIEW_DDL = "key long, generation long, scale double, offset_x double, offset_y double"


def fit_scale(width: float, height: float, view_width: float, view_height: float) -> float:
    """The scale at which an image just fits; 1 where either has no size."""
    if min(width, height, view_width, view_height) <= 0:
        return 1.0
    return min(view_width / width, view_height / height)


def held(value: float, extent: float, room: float) -> float:
    """An offset along one axis: centred with room to spare, else covering the view."""
    return (room - extent) / 2 if extent <= room else min(0.0, max(room - extent, value))


class View:
    """One image in one view. It starts fitted."""

    def __init__(self, width: float, height: float, view_width: float, view_height: float):
        self.size, self.room = (width, height), (view_width, view_height)
        self.real = min(*self.size, *self.room) > 0
        self.fit()

    def _hold(self) -> None:
        self.offset = tuple(held(o, n * self.scale, r) for o, n, r in zip(self.offset, self.size, self.room, strict=True))

    def fit(self) -> None:
        self.scale, self.offset = fit_scale(*self.size, *self.room), (0.0, 0.0)
        self._hold()

    def zoom(self, factor: float, anchor: tuple[float, float]) -> None:
        """Scale by ``factor``; the image's point under the anchor stays there as far as it can."""
        if self.real:
            least = fit_scale(*self.size, *self.room)
            scale = min(max(self.scale * factor, least), least * MOST_ZOOM)
            self.offset = tuple(a - (a - o) / self.scale * scale for a, o in zip(anchor, self.offset, strict=True))
            self.scale = scale
            self._hold()

    def pan(self, by: tuple[float, float]) -> None:
        if self.real:
            self.offset = tuple(o + d for o, d in zip(self.offset, by, strict=True))
            self._hold()

    def resize(self, view_width: float, view_height: float) -> None:
        """A fitted view stays fitted; another keeps its scale as far as it can."""
        fitted = self.scale <= fit_scale(*self.size, *self.room)
        self.room = (view_width, view_height)
        self.real = min(*self.size, *self.room) > 0
        if fitted:
            self.fit()
        else:
            self.scale = max(self.scale, fit_scale(*self.size, *self.room))
            self._hold()


def views(gestures: DataFrame) -> DataFrame:
    """key, generation, scale, offset_x, offset_y: the view of each session after each gesture.

    ``gestures``: key, at, generation, kind, p, q, r, width, height, view_width, view_height.
    ``zoom`` scales by p about (q, r), ``pan`` moves by (p, q), ``resize`` makes the view p by q,
    ``fit`` fits; other kinds and nulls change nothing. The sizes are those of the session's
    first gesture. Sessions are sorted by at and generation within their tasks and read as a
    stream, so that a session of any length needs the memory of one view.
    """
    names = ("kind", "p", "q", "r", "width", "height", "view_width", "view_height")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, view = object(), None
        for batch in batches:
            out = np.empty((3, batch.num_rows))
            rows = zip(batch["key"].to_pylist(), *(batch[c].to_pylist() for c in names), strict=True)
            for i, (key, kind, p, q, r, *sizes) in enumerate(rows):
                if key != now:
                    now, view = key, View(*(x or 0.0 for x in sizes))
                p, q, r = p or 0.0, q or 0.0, r or 0.0
                if kind == "zoom" and p > 0:
                    view.zoom(p, (q, r))
                elif kind == "pan":
                    view.pan((p, q))
                elif kind == "resize":
                    view.resize(p, q)
                elif kind == "fit":
                    view.fit()
                out[:, i] = view.scale, *view.offset
            yield pa.RecordBatch.from_arrays([batch["key"], batch["generation"], *map(pa.array, out)], names=["key", "generation", "scale", "offset_x", "offset_y"])

    plain = gestures.select("key", "at", "generation", "kind", *(F.col(c).cast("double") for c in names[1:]))
    return plain.repartition("key").sortWithinPartitions("key", "at", "generation").mapInArrow(fold, _VIEW_DDL)


def bounds(width: Column, height: Column, scale: Column, offset_x: Column, offset_y: Column) -> tuple[Column, Column, Column, Column]:
    """Where a view shows its image: left, top, width, height."""
    return offset_x, offset_y, width * scale, height * scale


def pixel_under(px: Column, py: Column, width: Column, height: Column, scale: Column, offset_x: Column, offset_y: Column) -> tuple[Column, Column]:
    """The image's pixel under a point of the view, null outside the image."""
    left, top, across, down = bounds(width, height, scale, offset_x, offset_y)
    inside = (px >= left) & (px < left + across) & (py >= top) & (py < top + down)
    at = lambda p, o, n: F.when(inside, F.greatest(F.lit(0), F.least(n - 1, ((p - o) / scale).cast("int"))))
    return at(px, left, width), at(py, top, height)
