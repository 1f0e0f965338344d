"""Mixing recipes: the best one to three paints for a colour, percentages, readable lines."""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color, pigments
from ..sources import scratch
from . import mixtures

PAIR_SWEEP, TRIPLE_SWEEP, REFINE_STEPS, REFINEMENTS = 48, 10, 8, 2
LEAST_SHARE = 0.005
_MATCH_DDL = "l double, a double, b double, paints array<int>, shares array<double>, distance double"
_OBSERVERS = np.array(pigments.OBSERVERS) / pigments.NORM


def _lab_of(shares: np.ndarray, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Spectral Lab of rows of shares of the same few paints."""
    if len(shares) > 256:  # what stays in the cache is mixed several times as fast
        return np.concatenate([_lab_of(shares[lo : lo + 256], k, s) for lo in range(0, len(shares), 256)])
    ks, ss = shares @ k, shares @ s
    r = ks / np.maximum(ss, pigments.LEAST_SCATTER)
    t = r * r
    t += 2 * r
    r += 1
    r -= np.sqrt(t, out=t)
    np.multiply(r, pigments.SAUNDERSON_K2, out=t)
    r *= (1 - pigments.SAUNDERSON_K1) * (1 - pigments.SAUNDERSON_K2)
    r /= np.subtract(1, t, out=t)
    t = (r @ _OBSERVERS.T) / color.WHITE
    f = np.where(t > color.EPSILON, np.cbrt(t), (color.KAPPA * t + 16) / 116)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], axis=1)


def _distance(lab: np.ndarray, target: np.ndarray) -> np.ndarray:
    gap = lab - target
    return color.LIGHTNESS_WEIGHT * np.abs(gap[..., 0]) + np.hypot(gap[..., 1], gap[..., 2])


class _Sweep:
    """All subsets of one size (two or three paints) on a lattice of shares.

    A subset's coarse sweep, every fourth lattice point, is refined around its best point on
    the lattice itself, and then a quarter finer within a lattice step, on a finer lattice.
    How far such steps lead in Lab, and how far from their second-order form, is measured on all
    of that lattice, so that what is told of recipes before they are refined always holds.
    """

    #: Subsets whose finer lattices are kept, 0.3 MB each; when more come, it begins anew.
    KEPT = 1024
    #: Recipes from one coarse point that are refined together.
    TOGETHER = 6

    def __init__(self, k: np.ndarray, s: np.ndarray, size: int):
        self.size, self.k, self.s = size, k, s
        self.members = np.array(list(combinations(range(len(k)), size)), np.int64).reshape(-1, size)
        self.steps = REFINE_STEPS // 2 * (PAIR_SWEEP if size == 2 else TRIPLE_SWEEP)
        n = self.steps
        places = np.array([(u, n - u) for u in range(n + 1)] if size == 2 else [(u, v) for u in range(n + 1) for v in range(n + 1 - u)])
        number = {tuple(x): i for i, x in enumerate(places.tolist())}
        free = places[:, : size - 1]
        at = lambda x: number.get((x[0], n - x[0]) if size == 2 else tuple(x), -1) if min(x) >= 0 else -1
        moved = lambda i, by: at([a + b for a, b in zip(free[i].tolist(), by, strict=True)])
        self.shares = np.column_stack([free, n - free.sum(axis=1)]) / n
        half = REFINE_STEPS // 2
        self.coarse = np.flatnonzero((free % half == 0).all(axis=1))
        offsets = list(product(range(-half, half + 1), repeat=size - 1))
        self.near = np.array([[j if (j := moved(i, by)) >= 0 else i for by in offsets] for i in self.coarse])
        self.lab = np.stack([_lab_of(self.shares, k[m], s[m]) for m in self.members]) if len(self.members) else np.empty((0, len(self.shares), 3))
        here = np.arange(len(free))
        beside = lambda by: np.array([moved(i, by) for i in here])
        # a step along each free share to its second order, by the neighbours on both sides or
        # two on one
        self.terms: list[tuple[tuple[int, ...], np.ndarray]] = []
        for axis in range(size - 1):
            back2, back, on, on2 = (beside([step * (j == axis) for j in range(size - 1)]) for step in (-2, -1, 1, 2))
            at_ = lambda to: self.lab[:, to]
            rise, curve = np.zeros(self.lab.shape), np.zeros(self.lab.shape)
            inside = np.flatnonzero((back >= 0) & (on >= 0))
            rise[:, inside] = (at_(on[inside]) - at_(back[inside])) / 2
            curve[:, inside] = (at_(on[inside]) + at_(back[inside])) / 2 - at_(inside)
            for sign, one, two in ((1, on, on2), (-1, back, back2)):
                edge = np.flatnonzero((back < 0 if sign > 0 else on < 0) & (one >= 0))
                far = np.where(two[edge] >= 0, two[edge], one[edge])
                curve[:, edge] = np.where((two[edge] >= 0)[:, None], (at_(far) - 2 * at_(one[edge]) + at_(edge)) / 2, 0)
                rise[:, edge] = sign * (at_(one[edge]) - at_(edge) - curve[:, edge])
            self.terms += [((axis,), rise), ((axis, axis), curve)]
        if size == 3:
            signs = ((1, 1, 1), (-1, -1, 1), (1, -1, -1), (-1, 1, -1))
            corners = [beside(s_[:2]) for s_ in signs]
            cross, n_met = np.zeros(self.lab.shape), np.zeros(len(here))
            for (du, dv, sign), to in zip(signs, corners, strict=True):
                real = np.flatnonzero(to >= 0)
                straight = sum(math.prod((du, dv)[axis] for axis in axes) * x[:, real] for axes, x in self.terms)
                cross[:, real] += sign * (self.lab[:, to[real]] - self.lab[:, real] - straight)
                n_met[real] += 1
            self.terms.append(((0, 1), cross / np.maximum(n_met, 1)[:, None]))
        self.told = np.stack([x.astype(np.float32) for _, x in self.terms], axis=-1)
        self.terms = [(axes, self.told[..., i]) for i, (axes, _) in enumerate(self.terms)]
        # steps within a lattice step; those beyond a border lead nowhere
        by = [x for x in product(np.linspace(-1, 1, REFINE_STEPS + 1), repeat=size - 1) if any(x)]
        self.fine = np.array(by) / self.steps
        self.ring = np.rint(np.abs(by).max(axis=1) * (REFINE_STEPS // 2)).astype(np.int64) - 1
        self.moves = np.array([[math.prod(x[axis] for axis in axes) for x in by] for axes, _ in self.terms], np.float32)
        self.exist = self._steps(here)[1]
        self._finer(free)
        self.planes = [np.ascontiguousarray(self.lab[..., c]) for c in range(3)]
        self.swatch = [np.ascontiguousarray(self.lab[:, self.coarse, c]) for c in range(3)]
        self._bounds()

    def _finer(self, free: np.ndarray) -> None:
        """The finer lattice, and where in it the steps from each lattice point lead."""
        half = REFINE_STEPS // 2
        n = half * self.steps
        row = np.arange(n + 1) if self.size == 2 else np.cumsum([0, *range(n + 1, 1, -1)])
        at = lambda x: row[x[..., 0]] + (x[..., 1] if self.size == 3 else 0)
        to = half * free[:, None] + np.rint(self.fine * n).astype(np.int64)
        self.leads = np.where(self.exist, at(np.where(self.exist[..., None], to, 0)), 0)
        places = np.array([(u, n - u) for u in range(n + 1)] if self.size == 2 else [(u, v, n - u - v) for u in range(n + 1) for v in range(n + 1 - u)])
        self.finer = places / n
        self.kept = np.empty((min(len(self.members), self.KEPT), 3, len(places)))
        self.slot, self.used = np.full(len(self.members), -1), 0
        self.reach, self.off = np.zeros(self.lab.shape[:2]), np.zeros((*self.lab.shape[:2], half), np.float32)
        none = np.where(self.exist, np.float32(0), np.float32(-np.inf))
        for i in range(len(self.members)):
            fine = self.kept[self._slots(np.array([i]))[0]].astype(np.float32)
            told = np.moveaxis(self.told[i] @ self.moves, 1, 0)
            step = [x[self.leads] - y.astype(np.float32)[:, None] for x, y in zip(fine, self.lab[i].T, strict=True)]
            size = lambda x, y, z: np.float32(color.LIGHTNESS_WEIGHT) * np.abs(x) + np.sqrt(y * y + z * z)
            self.reach[i] = (size(*step) + none).max(axis=1)
            off = size(*(x - y for x, y in zip(step, told, strict=True))) + none
            self.off[i] = np.stack([off[:, self.ring == r].max(axis=1) for r in range(half)], axis=1)
        # more than what single precision can be off
        self.reach, self.off = np.maximum(self.reach, 0) + 1e-3, np.maximum(self.off, 0) + np.float32(1e-3)
        self.bend = self.off.max(axis=2).astype(np.float64)

    def _slots(self, subset: np.ndarray) -> np.ndarray:
        """Where in ``kept`` the finer lattices of some subsets are, ``KEPT`` different ones at most."""
        new = np.unique(subset[self.slot[subset] < 0])
        if self.used + len(new) > len(self.kept):
            self.slot[:], self.used = -1, 0
            new = np.unique(subset)
        for c in new.tolist():
            self.kept[self.used] = _lab_of(self.finer, self.k[self.members[c]], self.s[self.members[c]]).T
            self.slot[c], self.used = self.used, self.used + 1
        return self.slot[subset]

    def _bounds(self) -> None:
        """How far the refinements lead from a coarse point; a direction across each lattice point's surface.

        Along ``across`` a step of first order does not move the colour, so that only the
        second order and its error take from the distance measured that way, ``low`` to
        ``high``; squares do so on one side only. Its length is 1 in the dual of the
        distance's norm.
        """
        rises = [x for axes, x in self.terms if len(axes) == 1]
        across = np.cross(*rises) if self.size == 3 else np.zeros(self.lab.shape, np.float32)
        length = np.maximum(np.abs(across[..., 0]) / color.LIGHTNESS_WEIGHT, np.hypot(across[..., 1], across[..., 2]))
        self.across = (across / np.maximum(length, 1e-9)[..., None]).astype(np.float32)
        bent = [self._range(axes, (self.across * x).sum(axis=-1)) for axes, x in self.terms if len(axes) == 2]
        self.low, self.high = ((sum(x) + sign * (self.bend + 1e-3)).astype(np.float32) for x, sign in zip(zip(*bent, strict=True), (-1, 1), strict=True))
        # what the refinements of a coarse point can reach lies in a box along the axes and in
        # a slab along its own direction
        axes_ = np.eye(3, dtype=np.float32) / np.float32([color.LIGHTNESS_WEIGHT, 1, 1])
        self.within = np.empty((len(self.members), len(self.coarse), 4, 2))
        for i in range(len(self.members)):
            sides = np.concatenate([np.broadcast_to(axes_, (len(self.coarse), 3, 3)), self.across[i, self.coarse, None]], axis=1)
            across = lambda x: sides @ x[i].astype(np.float32)[self.near].transpose(0, 2, 1)  # noqa: B023, E731
            seen, play = across(self.lab), self.bend[i, self.near][:, None] + 2e-3
            down, up = zip(*(self._range(axes, across(x)) for axes, x in self.terms), strict=True)
            self.within[i] = np.stack([(seen + sum(down) - play).min(axis=2), (seen + sum(up) + play).max(axis=2)], axis=2)
        # and so no farther from the coarse point than the box's corners
        from_ = np.stack(self.swatch, axis=-1) / (color.LIGHTNESS_WEIGHT, 1, 1)
        side = np.abs(self.within[..., :3, :] - from_[..., None]).max(axis=-1)
        self.far = color.LIGHTNESS_WEIGHT**2 * side[..., 0] + np.hypot(side[..., 1], side[..., 2]) + 1e-6

    @staticmethod
    def _range(axes: tuple[int, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a term adds at least and at most within a step; a square does not change its sign."""
        if len(set(axes)) < len(axes):
            return np.minimum(x, 0), np.maximum(x, 0)
        return -np.abs(x), np.abs(x)

    def first(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each subset's best coarse point for each target, as its place in ``coarse``, and its distance.

        For targets close to each other these are among the few points about as near to the
        middle of the targets as the nearest. Subsets too far off to have the best recipe of
        any target are told to be infinitely far.
        """
        if not len(self.members) or len(targets) < 2:
            return self._first_of_all(targets)
        middle = (targets.min(axis=0) + targets.max(axis=0)) / 2
        gap = color.LIGHTNESS_WEIGHT * np.abs(self.swatch[0] - middle[0]) + np.hypot(self.swatch[1] - middle[1], self.swatch[2] - middle[2])
        off = _distance(targets, middle).max() + 1e-6
        near = gap <= gap.min(axis=1, keepdims=True) + 2 * off
        may = np.flatnonzero(np.where(near, gap - self.far, np.inf).min(axis=1) <= gap.min() + 2 * off)
        c, f = np.nonzero(near[may])
        if len(c) > gap.size / 3:
            return self._first_of_all(targets)
        starts = np.searchsorted(c, np.arange(len(may)))
        counts = np.diff(starts, append=len(c))
        light, a, b = (x[may[c], f] for x in self.swatch)
        at, d = np.zeros((len(targets), len(self.members)), np.int64), np.full((len(targets), len(self.members)), np.inf)
        every = np.arange(len(c))
        for lo in range(0, len(targets), 8):
            tl, ta, tb = targets[lo : lo + 8].T[..., None]
            gap = color.LIGHTNESS_WEIGHT * np.abs(light - tl) + np.sqrt((a - ta) ** 2 + (b - tb) ** 2)
            least = np.minimum.reduceat(gap, starts, axis=1)
            here = np.where(gap == np.repeat(least, counts, axis=1), every, len(c))
            at[lo : lo + 8, may], d[lo : lo + 8, may] = f[np.minimum.reduceat(here, starts, axis=1)], least
        return at, d

    def _first_of_all(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, d = np.empty((len(targets), len(self.members)), np.int64), np.empty((len(targets), len(self.members)))
        light, side = np.empty(self.swatch[0].shape), np.empty(self.swatch[0].shape)
        every = np.arange(len(self.members))
        for i, (tl, ta, tb) in enumerate(targets):
            # in two buffers, which stay in the cache
            np.subtract(self.swatch[1], ta, out=light)
            np.multiply(light, light, out=light)
            np.subtract(self.swatch[2], tb, out=side)
            np.multiply(side, side, out=side)
            np.add(light, side, out=side)
            np.sqrt(side, out=side)
            np.subtract(self.swatch[0], tl, out=light)
            np.abs(light, out=light)
            np.multiply(light, color.LIGHTNESS_WEIGHT, out=light)
            np.add(light, side, out=side)
            at[i] = side.argmin(axis=1)
            d[i] = side[every, at[i]]
        return at, d

    def swept(self, subset: np.ndarray, first: np.ndarray, own: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best lattice points of subsets after a refinement of their coarse points, and their distances."""
        at, d = self.coarse[first], own.copy()
        key = subset * len(self.coarse) + first
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
        many = np.diff(cuts) >= self.TOGETHER
        # recipes from the same coarse point meet the same lattice points
        for lo, hi in zip(cuts[:-1][many].tolist(), cuts[1:][many].tolist(), strict=True):
            mine = order[lo:hi]
            around, c = self.near[first[mine[0]]], subset[mine[0]]
            light, a, b = (self.planes[i][c, around] - target[mine, i, None] for i in range(3))
            a *= a
            b *= b
            a += b
            np.sqrt(a, out=a)
            np.abs(light, out=light)
            light *= color.LIGHTNESS_WEIGHT
            light += a
            to = light.argmin(axis=1)
            least = light[np.arange(len(to)), to]
            better = least < own[mine]
            at[mine[better]], d[mine[better]] = around[to[better]], least[better]
        rest = order[np.repeat(~many, np.diff(cuts))]
        for lo in range(0, len(rest), 256):
            some = rest[lo : lo + 256]
            around = self.near[first[some]]
            light, a, b = (x[subset[some, None], around] - target[some, c, None] for c, x in enumerate(self.planes))
            gap = color.LIGHTNESS_WEIGHT * np.abs(light) + np.sqrt(a * a + b * b)
            to = gap.argmin(axis=1)
            row = np.arange(len(to))
            better = gap[row, to] < own[some]
            at[some] = np.where(better, around[row, to], at[some])
            d[some] = np.where(better, gap[row, to], own[some])
        return at, d

    def may_come(self, subset: np.ndarray, first: np.ndarray, target: np.ndarray) -> np.ndarray:
        """A quick bound on what both refinements of coarse points can reach at best."""
        lo, hi = np.moveaxis(self.within[subset, first], 2, 0)
        across = (self.across[subset, self.coarse[first]] * target).sum(axis=1)
        seen = np.column_stack([target / (color.LIGHTNESS_WEIGHT, 1, 1), across])
        gap = np.maximum(np.maximum(lo - seen, seen - hi), 0)
        return np.maximum(color.LIGHTNESS_WEIGHT**2 * gap[:, 0] + np.hypot(gap[:, 1], gap[:, 2]), gap[:, 3])

    def may_reach(self, subset: np.ndarray, at: np.ndarray, d: np.ndarray, target: np.ndarray) -> np.ndarray:
        """A quick bound on what the second refinement of recipes can reach at best."""
        gap = target - self.lab[subset, at]
        seen = (gap * self.across[subset, at]).sum(axis=1)
        seen = np.maximum(seen - self.high[subset, at], self.low[subset, at] - seen)
        # the direction in which the distance is measured
        side = np.column_stack([color.LIGHTNESS_WEIGHT * np.sign(gap[:, 0]), gap[:, 1:] / np.maximum(np.hypot(gap[:, 1], gap[:, 2]), 1e-9)[:, None]])
        told = (side[:, None] @ self.told[subset, at])[:, 0]
        play = sum(self._range(axes, told[:, i])[1] for i, (axes, _) in enumerate(self.terms))
        return np.maximum(seen, d - np.minimum(play + self.bend[subset, at] + 1e-3, self.reach[subset, at]))

    def _steps(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the second refinement's steps from lattice points, and which of them exist."""
        free = self.shares[at, None, :-1] + self.fine
        rest = 1 - free.sum(axis=2)
        real = (free >= -1e-12).all(axis=2) & (free <= 1 + 1e-12).all(axis=2) & (rest >= -1e-12)
        return np.maximum(np.concatenate([np.minimum(free, 1), rest[..., None]], axis=2), 0), real

    def least(self, subset: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """What the second refinement of recipes can reach at best.

        That is the distance after steps of second order, less their error, by the length of
        the step.
        """
        out = np.empty(len(subset))
        for lo in range(0, len(subset), 256):
            c, i = subset[lo : lo + 256], at[lo : lo + 256]
            # in single precision, whose error here is far below what is taken off for it
            told = self.told[c, i].reshape(-1, self.told.shape[-1])
            gap = (told @ self.moves).reshape(len(c), 3, -1)
            gap += (self.lab[c, i] - target[lo : lo + 256]).astype(np.float32)[..., None]
            least, a, b = gap[:, 0], gap[:, 1], gap[:, 2]
            np.abs(least, out=least)
            least *= np.float32(color.LIGHTNESS_WEIGHT)
            a *= a
            b *= b
            a += b
            least += np.sqrt(a, out=a)
            least -= self.off[c, i][:, self.ring]
            out[lo : lo + 256] = np.where(self.exist[i], least, np.float32(np.inf)).min(axis=1)
        return out - 1e-3

    def refined(self, subset: np.ndarray, at: np.ndarray, d: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and shares of recipes after the second refinement."""
        best, shares = d.copy(), np.maximum(self.shares[at], 0)
        order, step = np.argsort(subset, kind="stable"), min(256, self.KEPT)
        for lo in range(0, len(subset), step):
            some = order[lo : lo + step]
            slot, leads = self._slots(subset[some])[:, None], self.leads[at[some]]
            light, a, b = (self.kept[slot, c, leads] - target[some, c, None] for c in range(3))
            gap = np.where(self.exist[at[some]], color.LIGHTNESS_WEIGHT * np.abs(light) + np.sqrt(a * a + b * b), np.inf)
            to = gap.argmin(axis=1)
            least = gap[np.arange(len(to)), to]
            better = least < best[some]
            won, free = some[better], self.shares[at[some[better]], :-1] + self.fine[to[better]]
            best[won] = least[better]
            shares[won] = np.maximum(np.concatenate([np.minimum(free, 1), 1 - free.sum(axis=1, keepdims=True)], axis=1), 0)
        return best, shares / shares.sum(axis=1, keepdims=True)


class Solver:
    """The best recipe of one to three paints for colours, a batch at a time.

    Every subset is swept on its lattice. The refinements are made of the most promising
    subsets first, and of the others only if what they can still gain suffices to beat the best
    recipe known. Colours solved together are close to each other, as far as those asked for
    together allow, so that they share much of this.
    """

    #: Colours solved at a time, and how many of a colour's recipes come first.
    COLOURS, FIRST = 256, 16
    #: Ranks of a colour's recipes, the most promising first, that are mixed at a time.
    TURNS = ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16), (16, 1 << 30))

    def __init__(self, paints: list[tuple[int, list[float], list[float]]]):
        self.index = [p[0] for p in paints]
        k, s = (np.array([p[i] for p in paints]) for i in (1, 2))
        self.single = _lab_of(np.eye(len(paints)), k, s)
        self.sweeps = [_Sweep(k, s, size) for size in (2, 3)]

    def match(self, targets: np.ndarray) -> list[tuple[list[int], list[float], float]]:
        """Paints, shares and distance for each target; ties go to fewer paints, then to library order."""
        out = [None] * len(targets)
        finite = np.isfinite(targets).all(axis=1)
        for some in self._close(targets, np.flatnonzero(finite)):
            for i, x in zip(some.tolist(), self._match(targets[some]), strict=True):
                out[i] = x
        for i in np.flatnonzero(~finite).tolist():  # as far from every paint as from the first
            out[i] = [self.index[0]], [1.0], float(_distance(self.single[0], targets[i]))
        return out

    def _close(self, targets: np.ndarray, some: np.ndarray) -> Iterator[np.ndarray]:
        """Halves of the targets along their widest side, and of these, down to a batch."""
        if len(some) <= self.COLOURS:
            if len(some):
                yield some
            return
        side = np.ptp(targets[some], axis=0) * (color.LIGHTNESS_WEIGHT, 1, 1)
        order = np.argpartition(targets[some, side.argmax()], len(some) // 2)
        for half in np.split(order, [len(some) // 2]):
            yield from self._close(targets, some[half])

    def _match(self, targets: np.ndarray) -> list[tuple[list[int], list[float], float]]:
        alone = _distance(self.single, targets[:, None])
        found = [[] for _ in targets]
        known = alone.min(axis=1)
        firsts = [sweep.first(targets) for sweep in self.sweeps]
        for _, d in firsts:
            known = np.minimum(known, d.min(axis=1, initial=np.inf))
        lattice = []
        for sweep, (first, own) in zip(self.sweeps, firsts, strict=True):
            rows = []
            if len(sweep.members):
                n = min(self.FIRST, len(sweep.members))
                early = np.zeros(own.shape, bool)
                np.put_along_axis(early, np.argpartition(own, n - 1, axis=1)[:, :n], True, axis=1)
                far = sweep.far[np.arange(own.shape[1]), first]
                for turn in (early, ~early):
                    c, t = np.nonzero((turn & (own - far <= known[:, None] + 1e-9)).T)  # a subset at a time, whose lattice stays in the cache
                    may = sweep.may_come(c, first[t, c], targets[t]) <= known[t] + 1e-9
                    c, t = c[may], t[may]
                    at, d = sweep.swept(c, first[t, c], own[t, c], targets[t])
                    np.minimum.at(known, t, d)
                    rows.append((t, c, at, d))
            lattice.append(rows)
        for sweep, rows in zip(self.sweeps, lattice, strict=True):
            if not rows:
                continue
            t, c, at, d = (np.concatenate(x) for x in zip(*rows, strict=True))
            may = np.flatnonzero(d - sweep.reach[c, at] <= known[t] + 1e-9)
            t, c, at, d = t[may], c[may], at[may], d[may]
            least = sweep.may_reach(c, at, d, targets[t])
            order = np.lexsort((least, t))
            t, c, at, d, least = t[order], c[order], at[order], d[order], least[order]
            best, how = d.copy(), np.maximum(sweep.shares[at], 0)
            place = np.arange(len(t)) - np.searchsorted(t, t)
            for turn in (place < self.FIRST, place >= self.FIRST):
                may = np.flatnonzero(turn & (least <= known[t] + 1e-9))
                low = sweep.least(c[may], at[may], targets[t[may]])
                may, low = may[low < d[may]], low[low < d[may]]  # the others stay as they are
                order = np.lexsort((low, t[may]))
                may, low = may[order], low[order]
                rank = np.arange(len(may)) - np.searchsorted(t[may], t[may])
                for lo, hi in self.TURNS:
                    some = may[(lo <= rank) & (rank < hi) & (low <= known[t[may]] + 1e-9)]
                    best[some], how[some] = sweep.refined(c[some], at[some], d[some], targets[t[some]])
                    np.minimum.at(known, t[some], best[some])
            rows[:] = t, c, best, how
        whole = np.ones(1)
        for t, i in zip(*(x.tolist() for x in np.nonzero(alone <= known[:, None] + 1e-9)), strict=True):
            found[t].append((float(alone[t, i]), (i,), whole))
        for sweep, rows in zip(self.sweeps, lattice, strict=True):
            if not rows:
                continue
            t, c, best, how = rows
            met = np.flatnonzero(best <= known[t] + 1e-9)
            for i in met[np.argsort(best[met], kind="stable")].tolist():
                found[t[i]].append((float(best[i]), tuple(sweep.members[c[i]].tolist()), how[i] / how[i].sum()))
        return [self._told(f) for f in found]

    def _told(self, found: list) -> tuple[list[int], list[float], float]:
        best = found[0]
        for f in found[1:]:  # some tens are left
            if f[0] < best[0] - 1e-12:
                best = f
        distance, subset, shares = best
        keep = [i for i in range(len(subset)) if shares[i] >= LEAST_SHARE] or [0]
        total = sum(shares[i] for i in keep)
        return [self.index[subset[i]] for i in keep], [float(shares[i] / total) for i in keep], distance


@functools.lru_cache(maxsize=4)
def _solver(palette: bytes) -> Solver:
    """One for each palette in a worker, however many tasks it runs."""
    return Solver(pickle.loads(palette))


def closest_blends(targets: DataFrame, paints: DataFrame) -> DataFrame:
    """id, paints, shares, distance: for each colour ``id, l, a, b`` its best recipe.

    The palette is a short list and travels with the tasks; distinct targets are dealt over
    all cores by where they lie in Lab, since those close to each other share work, solved in
    batches against all subsets of one to three paints, and joined back.
    """
    rows = [(r.paint_idx, r.k, r.s) for r in paints.orderBy("paint_idx").collect()]
    if not 0 < len(rows) <= 64:
        raise ValueError("a palette has 1 to 64 paints")

    told = pickle.dumps(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _solver(told).match(batch[["l", "a", "b"]].to_numpy())
            yield batch[["l", "a", "b"]].assign(paints=[f[0] for f in found], shares=[f[1] for f in found], distance=[f[2] for f in found])

    cells = [F.floor(F.col(c) / width) for width in (16, 4) for c in "lab"]
    colours = targets.select("l", "a", "b").distinct().repartitionByRange(4 * targets.sparkSession.sparkContext.defaultParallelism, *cells).sortWithinPartitions(*cells)
    found = colours.mapInPandas(run, _MATCH_DDL)
    return targets.select(F.col("id").cast("long"), "l", "a", "b").join(found, ["l", "a", "b"], "left").select("id", "paints", "shares", "distance")


def percentages(shares: Column) -> Column:
    """Whole percentages by largest remainder, first on ties, every share one point at least.

    Shares add up to 1; the points that lift a zero come off the largest, first on ties.
    """
    hundred = F.transform(shares, lambda x, i: F.struct(F.floor(x * 100).cast("int").alias("whole"), (x * 100 - F.floor(x * 100)).alias("rest"), i.alias("at")))
    missing = lambda a: 100 - F.aggregate(a, F.lit(0), lambda s, x: s + x["whole"])

    def raised(a: Column) -> Column:
        before = lambda x: F.size(F.filter(a, lambda y: (y["rest"] > x["rest"] + 1e-9) | ((F.abs(y["rest"] - x["rest"]) <= 1e-9) & (y["at"] < x["at"]))))
        return F.transform(a, lambda x: x["whole"] + F.when(before(x) < missing(a), 1).otherwise(0))

    def lifted(p: Column) -> Column:
        zeros = F.size(F.filter(p, lambda x: x < 1))
        largest = F.array_position(p, F.array_max(p)) - 1
        return F.transform(p, lambda x, i: F.when(x < 1, 1).otherwise(x - F.when(i == largest, zeros).otherwise(0)).cast("int"))

    step = lambda value, f: F.transform(F.array(value), f)[0]
    return step(step(hundred, raised), lifted)


def to_match(targets: DataFrame, paints: DataFrame) -> DataFrame:
    """The best recipes mixed again at the whole percentages that are shown.

    id, paints, percentages, exact, snapped, argb, chroma_lost: ``exact`` is the distance that
    the solver reached, ``snapped`` that of the shown recipe, whose colour the rest describes.
    """
    # read twice below, solved once
    found = scratch.save(closest_blends(targets, paints), "recipes").withColumn("percentages", percentages(F.col("shares")))
    whole = F.transform(F.arrays_zip("paints", "percentages"), lambda p: F.struct(p["paints"].alias("paint_idx"), (p["percentages"] / 100).alias("share")))
    # equal recipes are mixed once
    recipes = found.select(F.col("paints").alias("p"), F.col("percentages").alias("q"), whole.alias("parts")).distinct()
    keyed = recipes.select(F.struct("p", "q").alias("ordinal"), "parts")
    mixed = mixtures.render(mixtures.mix(keyed, paints)).select("ordinal.p", "ordinal.q", F.col("l").alias("ml"), F.col("a").alias("ma"), F.col("b").alias("mb"), "argb", "chroma_lost")
    met = targets.select(F.col("id").cast("long"), "l", "a", "b").join(found, "id").join(mixed, (F.col("paints") == F.col("p")) & (F.col("percentages") == F.col("q")))
    snapped = color.perceptual_distance((F.col("l"), F.col("a"), F.col("b")), (F.col("ml"), F.col("ma"), F.col("mb")))
    return met.select("id", "paints", "percentages", F.col("distance").alias("exact"), snapped.alias("snapped"), "argb", "chroma_lost")


def rgb_line(argb: Column) -> Column:
    return F.format_string("RGB: %d, %d, %d", *color.channels(argb)[1:])


def mix_lines(matches: DataFrame, paints: DataFrame) -> DataFrame:
    """id, lines: what is said of the closest mixes ``matches`` to the colours ``target``.

    ``matches`` are rows of :func:`to_match` with their packed ``target``.
    """
    shares = recipe_lines(matches.withColumn("shares", F.transform("percentages", lambda x: x / 100.0)), paints)
    lab = lambda argb: color.rgb_to_lab(*color.channels(argb)[1:])
    seen = matches.select("*", *(c.alias(f"t{n}") for c, n in zip(lab(F.col("target")), "lab", strict=True)), *(c.alias(f"m{n}") for c, n in zip(lab(F.col("argb")), "lab", strict=True)))
    target, mixed = (tuple(F.col(f"{k}{n}") for n in "lab") for k in "tm")
    de = color.ciede2000(target, mixed)
    quality = F.concat(F.lit("Match: "), color.describe_quality(de), F.lit(" (dE "), F.format_string("%.1f", de), F.lit(")"))
    shift = F.concat(F.lit("Mix reads "), color.describe_shift(target, mixed))
    vivid = F.when(F.col("chroma_lost") > 0.001, "More vivid than this screen can show")
    rounded = F.when(F.col("snapped") - F.col("exact") > 0.5, F.format_string("Rounded to whole percent: %.1f \u2192 %.1f", F.col("exact"), F.col("snapped")))
    told = seen.select("id", rgb_line(F.col("target")).alias("first"), F.array_compact(F.array(quality, shift, vivid, rounded)).alias("rest"))
    return told.join(shares, "id").select("id", F.concat(F.array("first", F.lit("Closest mix:")), "lines", "rest").alias("lines"))


def recipes_at(pixels: DataFrame, points: DataFrame, paints: DataFrame) -> DataFrame:
    """image_id, x, y, lines: the recipes of the pixels under some ``points(image_id, x, y)``.

    Points outside an image and fully transparent pixels have none; without paints only the
    colour is told. Each distinct colour is solved once.
    """
    asked = points.select("image_id", "x", "y").distinct().join(pixels.select("image_id", "x", "y", "argb"), ["image_id", "x", "y"])
    seen = asked.filter(F.shiftrightunsigned("argb", 24) != 0).withColumn("id", F.col("argb").bitwiseAND(F.lit(0xFFFFFF)).cast("long"))
    if not paints.limit(1).count():
        return seen.select("image_id", "x", "y", F.array(rgb_line(F.col("argb"))).alias("lines"))
    colours = seen.select("id").distinct()
    lab = color.rgb_to_lab(*color.channels(F.col("id").cast("int"))[1:])
    matches = to_match(colours.select("id", *(c.alias(n) for c, n in zip(lab, "lab", strict=True))), paints).withColumn("target", F.col("id").cast("int"))
    return seen.join(mix_lines(matches, paints), "id").select("image_id", "x", "y", "lines")


def recipe_lines(matches: DataFrame, paints: DataFrame) -> DataFrame:
    """id, lines: "60% Name" a paint, the largest first, ties in library order."""
    part = matches.select("id", F.posexplode(F.arrays_zip("paints", percentages(F.col("shares")).alias("pct"))).alias("at", "part"))
    named = part.select("id", F.col("part.paints").alias("paint_idx"), F.col("part.pct").alias("pct")).join(paints.select("paint_idx", "name"), "paint_idx")
    line = F.struct((-F.col("pct")).alias("k"), "paint_idx", F.concat(F.col("pct").cast("string"), F.lit("% "), F.col("name")).alias("line"))
    return named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))


def largest_lines(parts: Column, named: int = 5) -> Column:
    """Array of rank and line: the largest of ``parts(paint_idx, name, weight)`` by name, the rest summed up in a last line."""
    before = lambda p, q: F.when((p["weight"] > q["weight"]) | ((p["weight"] == q["weight"]) & (p["paint_idx"] < q["paint_idx"])), -1).otherwise(1)
    order = lambda p, q: F.when((p["weight"] == q["weight"]) & (p["paint_idx"] == q["paint_idx"]), 0).otherwise(before(p, q))
    ranked = F.array_sort(F.filter(parts, lambda p: p["weight"] > 0), order)
    percent = lambda w: F.concat(F.rint(w * 100).cast("int").cast("string"), F.lit("%"))
    shown = lambda p, i: (i < named) & (p["weight"] >= LEAST_SHARE)

    def told(of: Column) -> Column:
        line = lambda p, i: F.struct((i + 1).alias("rank"), F.concat(p["name"], F.lit(": "), percent(p["weight"])).alias("line"))
        top = F.transform(F.filter(of, shown), line)
        rest = F.filter(of, lambda p, i: ~shown(p, i))
        sum_ = F.aggregate(rest, F.lit(0.0), lambda s, p: s + p["weight"])
        last = F.struct(F.lit(named + 1).alias("rank"), F.concat(F.lit("+"), F.size(rest).cast("string"), F.lit(" more: "), percent(sum_)).alias("line"))
        return F.concat(top, F.filter(F.array(last), lambda _: sum_ >= LEAST_SHARE))

    return F.transform(F.array(ranked), told)[0]


def wheel_lines(weights: DataFrame, paints: DataFrame, named: int = 5) -> DataFrame:
    """id, rank, line: :func:`largest_lines` of the rows ``id, paint_idx, weight``."""
    met = weights.join(paints.select("paint_idx", "name"), "paint_idx")
    parts = met.groupBy("id").agg(F.collect_list(F.struct("paint_idx", "name", "weight")).alias("parts"))
    return parts.select("id", F.inline(largest_lines(F.col("parts"), named)))
