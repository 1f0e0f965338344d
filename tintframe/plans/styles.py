"""Painting styles as plans: pre-map, remap, candidates, quantise, post-map, compose."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color
from ..operators import filters, mixtures, nearest, palette, regions
from ..operators.colour_maps import ColourMaps, map_name
from ..sources import scratch

Stage = Callable[[DataFrame, DataFrame, float], DataFrame]


@dataclass(frozen=True)
class Parameter:
    """A stage's number; values are held to its range."""

    id: str
    label: str
    least: float
    most: float
    default: float
    unit: str = ""

    def hold(self, value: float) -> float:
        return min(max(value, self.least), self.most)


STEPS = 100


def to_position(p: Parameter, value: float) -> int:
    """The slider position, of ``STEPS``, that shows a value."""
    return round((value - p.least) / (p.most - p.least) * STEPS)


def to_value(p: Parameter, position: int) -> float:
    return p.least + position / STEPS * (p.most - p.least)


def caption(p: Parameter, value: float) -> str:
    """Label, the value with two decimals at most, and unit."""
    return f"{p.label}: {f'{value:.2f}'.rstrip('0').rstrip('.')} {p.unit}".rstrip()


# The stages' parameters.
PARAMETERS = {
    p.id: p
    for p in (
        Parameter("strength", "Strength", 1, 5, 1),
        Parameter("edge", "Edge", 0.01, 0.30, 0.10),
        Parameter("contrast", "Contrast", 0.3, 2.0, 1.0),
        Parameter("key", "Key shift", -20, 20, 0, "L*"),
        Parameter("chroma", "Chroma", 0, 3, 1),
        Parameter("blur", "Blur", 0, 20, 0, "px"),
        Parameter("colours", "Colours", 3, 12, 8),
        Parameter("mother", "Mother colour", 0, 0.5, 0),
    )
}


@dataclass(frozen=True)
class Style:
    """A plan. ``values`` override parameters; ``post`` stages run on candidate indices."""

    name: str
    mark_scale: float
    values: dict[str, float] = field(default_factory=dict)
    remaps: bool = True
    abstract: bool = False
    post: tuple[Stage, ...] = ()

    def value(self, name: str) -> float:
        p = PARAMETERS[name]
        return p.hold(self.values.get(name, p.default))

    def with_values(self, **values: float) -> Style:
        for name in values:
            PARAMETERS[name]  # an unknown name raises KeyError
        return replace(self, values=self.values | values)


def _merge(indexed: DataFrame, cands: DataFrame, mark: float) -> DataFrame:
    return regions.merge_small(indexed, mark)


# Each style's mark scale and what it sets the parameters to.
STYLES = {
    s.name: s
    for s in (
        Style("Realism", 1.0, {"strength": 1, "edge": 0.10}, remaps=False),
        Style("Tonalism", 1.2, {"strength": 2, "edge": 0.10, "contrast": 0.80, "key": -8, "chroma": 0.85}, post=(_merge,)),
        Style("Fauvism", 1.3, {"strength": 3, "edge": 0.05, "contrast": 0.95, "key": 0, "chroma": 1.8}, post=(regions.contour_lines, _merge)),
        Style("Post-Impressionism", 1.6, {"strength": 3, "edge": 0.05, "contrast": 1.0, "key": 0, "chroma": 1.45}, post=(_merge,)),
        Style("Abstract", 2.5, {"strength": 5, "edge": 0.05, "contrast": 1.1, "key": 0, "chroma": 1.0, "mother": 0.15, "colours": 8}, abstract=True, post=(regions.ground_fill, _merge)),
    )
}


def by_name(name: str) -> Style:
    """The style of exactly this name; an unknown one raises KeyError."""
    return STYLES[name]


def default_mark(width: int, height: int) -> float:
    return float(min(128, max(2, round(min(width, height) / 150))))


def scale_radius(pixels: int, source: tuple[int, int], preview: tuple[int, int]) -> int:
    """A radius given for the full image, for its preview."""
    if pixels <= 0:
        return 0
    return max(1, round(pixels * min(p / s for p, s in zip(preview, source, strict=True))))


def style_candidates(style: Style, paints: DataFrame) -> DataFrame:
    """The colours that the paints can mix to, as the style wants them."""
    share = style.value("mother")
    if style.abstract and share > 0:
        return mixtures.candidates(paints, mother=mixtures.most_neutral(paints), fraction=share)
    return mixtures.candidates(paints)


def render(pixels: DataFrame, style: Style, cands: DataFrame, *, mark: float, blur: int | None = None, maps: ColourMaps | None = None, phases=None) -> DataFrame:
    """image_id, y, x, cand_idx, argb of the images after the style; alpha is the source's.

    ``pixels`` has image_id, y, x, argb. An image-aware palette is made for each image, whose
    ``cand_idx`` then count its own candidates. ``mark`` is the base mark in pixels, which the
    style scales without rounding. ``maps`` keeps what keys lead to for later renders; palettes
    of single images are not kept. ``phases`` takes the phases ``pre-map``, ``colour map``,
    ``post-map`` and ``compose``.
    """
    take = phases.take if phases is not None else lambda name, df, key=None: df  # noqa: ARG005
    size = mark * style.mark_scale
    floor = filters.guided(pixels.select("image_id", "y", "x", "argb"), radius=max(round(size / 2), 1), edge=style.value("edge"), iterations=int(style.value("strength")))
    blurred = take("pre-map", filters.gaussian(floor, int(style.value("blur") if blur is None else PARAMETERS["blur"].hold(blur))))
    if style.abstract:
        # the palettes and the keys both stand on the filtered images, all later steps on the palettes
        blurred = scratch.save(blurred, "blurred")
        cands = scratch.save(palette.image_palette(blurred, cands, style.value("colours")), "palettes")
    remap, told = None, ()
    if style.remaps:
        if style.abstract:
            cands = cands.withColumn("ceiling", F.max(F.hypot("a", "b")).over(W.partitionBy("image_id")))
            ceiling = F.col("ceiling")
        else:
            ceiling = cands.agg(F.max(F.hypot("a", "b"))).first()[0] or 0.0
        told = tuple(style.value(name) for name in ("contrast", "key", "chroma"))
        remap = lambda lab: color.remap(lab, ceiling, contrast=told[0], key=told[1], gain=told[2])
    kept = maps is not None and not style.abstract
    resolved = maps.resolve(blurred, cands, map_name(cands, *told), remap) if kept else nearest.resolve_once(blurred, cands, remap)
    indexed = take("colour map", resolved.select("image_id", "y", "x", "cand_idx"), "cand_idx")
    for stage in style.post:
        indexed = stage(indexed, cands, size)
    return take("compose", compose(pixels, take("post-map", indexed, "cand_idx"), cands))


def compose(pixels: DataFrame, indexed: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidate colours under the source's alpha."""
    by = ["image_id", "cand_idx"] if "image_id" in cands.columns else ["cand_idx"]
    shown = indexed.join(cands.select(*by, F.col("argb").alias("paint")), by)
    source = pixels.select("image_id", "y", "x", F.col("argb").alias("source"))
    alpha = F.col("source").bitwiseAND(F.lit(-(1 << 24)))
    return source.join(shown, ["image_id", "y", "x"]).select("image_id", "y", "x", "cand_idx", alpha.bitwiseOR(F.col("paint").bitwiseAND(F.lit(0xFFFFFF))).alias("argb"))


class Cache:
    """The last few candidate sets, by paints and the style parameters that build them."""

    def __init__(self, room: int = 4):
        self.room, self.held = room, {}

    def candidates(self, style: Style, paints: DataFrame) -> DataFrame:
        rows = paints.orderBy("paint_idx").collect()
        key = (paints.sparkSession.sparkContext.applicationId, tuple((r.paint_idx, tuple(r.k), tuple(r.s)) for r in rows), style.value("mother") if style.abstract else 0.0)
        self.held[key] = self.held.pop(key) if key in self.held else mixtures.settled(style_candidates(style, paints))
        if len(self.held) > self.room:
            self.held.pop(next(iter(self.held)))
        return self.held[key]
