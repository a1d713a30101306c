"""Chroma caps: the largest chroma by lightness and hue, with gaps filled and smoothed, and lookups in it.

cap_grid(image_id, li, hi, cap) has n_l x n_h rows for each image, and cap_meta one.
The grid is built by one aggregation of the pixels; from there on an image is a
few thousand rows, and every step is a window over a row or a column of its grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CapBuilder, CapLookup
from ..errors import EmptySamples
from ..functions.backends import COLUMNS, EPS, TAU
from ..functions.numeric import clamp01, wrap_hue


def lightness_range(points: DataFrame) -> DataFrame:
    """(image_id, l_min, l_max); a range next to nothing is widened."""
    ends = points.groupBy("image_id").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    flat = F.abs(F.col("hi") - F.col("lo")) < 1e-6
    return ends.select("image_id", F.when(flat, F.greatest(F.col("lo") - 1e-3, F.lit(0.0))).otherwise(F.col("lo")).alias("l_min"), F.when(flat, F.least(F.col("hi") + 1e-3, F.lit(1.0))).otherwise(F.col("hi")).alias("l_max"))


def cap_bins(points: DataFrame, ranges: DataFrame, config: CapBuilder) -> DataFrame:
    """(image_id, li, hi, cap): the largest chroma of each cell that has a point."""
    raw = points.join(ranges, "image_id").select("image_id", "l", "l_min", "l_max", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("c"), F.atan2("b", "a").alias("angle"))
    polar = raw.withColumn("h", wrap_hue(F.col("angle")))
    li = F.floor(clamp01((F.col("l") - F.col("l_min")) / F.greatest(F.col("l_max") - F.col("l_min"), F.lit(EPS))) * (config.n_l - 1))
    hi = F.floor(F.col("h") / TAU * config.n_h) % config.n_h
    return polar.groupBy("image_id", li.cast("int").alias("li"), hi.cast("int").alias("hi")).agg(F.max("c").alias("cap"))


def dense_grid(bins: DataFrame, ranges: DataFrame, config: CapBuilder) -> DataFrame:
    cells = ranges.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(config.n_l * config.n_h - 1))).alias("cell"))
    cells = cells.select("image_id", F.floor(F.col("cell") / config.n_h).cast("int").alias("li"), (F.col("cell") % config.n_h).alias("hi"))
    return cells.join(bins, ["image_id", "li", "hi"], "left")


def _around(grid: DataFrame, n: int, times: int) -> DataFrame:
    """The grid repeated `times` over each end of the hue axis, with its place on the line as `at`."""
    turns = F.explode(F.sequence(F.lit(-times), F.lit(times))).alias("turn")
    return grid.select("*", turns).withColumn("at", F.col("hi") + F.col("turn") * n)


def _neighbours(order: W, at: str) -> dict[str, Column]:
    """Values and places of the nearest filled cells before and after along a line."""
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    place = F.when(F.col("cap").isNotNull(), F.col(at))
    return {
        "_before": F.last("cap", ignorenulls=True).over(before), "_before_at": F.last(place, ignorenulls=True).over(before),
        "_after": F.first("cap", ignorenulls=True).over(after), "_after_at": F.first(place, ignorenulls=True).over(after),
    }


def fill_hue(grid: DataFrame, config: CapBuilder) -> DataFrame:
    """Empty cells of a row that has any filled: the nearest on the hue circle, the mean of two as near."""
    near = _around(grid, config.n_h, 1).withColumns(_neighbours(W.partitionBy("image_id", "li").orderBy("at"), "at")).where("turn = 0")
    left, right = F.col("at") - F.col("_before_at"), F.col("_after_at") - F.col("at")
    filled = F.when(left < right, F.col("_before")).when(left > right, F.col("_after")).otherwise(0.5 * (F.col("_before") + F.col("_after")))
    return near.select("image_id", "li", "hi", F.coalesce("cap", filled).alias("cap"))


def fill_lightness(grid: DataFrame) -> DataFrame:
    """Cells still empty: the nearest of their column, the lower of two as near; 0 if there is none."""
    near = grid.withColumns(_neighbours(W.partitionBy("image_id", "hi").orderBy("li"), "li"))
    lower = F.col("_before_at").isNotNull() & (F.col("_after_at").isNull() | (F.col("li") - F.col("_before_at") <= F.col("_after_at") - F.col("li")))
    return near.select("image_id", "li", "hi", F.coalesce("cap", F.when(lower, F.col("_before")).otherwise(F.col("_after")), F.lit(0.0)).alias("cap"))


def smooth_hue(grid: DataFrame, config: CapBuilder) -> DataFrame:
    """Box mean around the hue circle."""
    r = config.smooth_h_radius
    if not r:
        return grid
    order = W.partitionBy("image_id", "li").orderBy("at").rowsBetween(-r, r)
    turned = _around(grid, config.n_h, -(-r // config.n_h)).withColumn("_s", F.sum("cap").over(order)).where("turn = 0")
    return turned.select("image_id", "li", "hi", (F.col("_s") / (2 * r + 1)).alias("cap"))


def smooth_lightness(grid: DataFrame, config: CapBuilder) -> DataFrame:
    """Box mean along lightness; the edge repeats beyond it."""
    r = config.smooth_l_radius
    if not r:
        return grid
    order = W.partitionBy("image_id", "hi").orderBy("li")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    below, above = F.greatest(r - F.col("li"), F.lit(0)), F.greatest(F.col("li") + r - (config.n_l - 1), F.lit(0))
    total = F.sum("cap").over(order.rowsBetween(-r, r)) + below * F.first("cap").over(whole) + above * F.last("cap").over(whole)
    return grid.withColumn("_s", total).select("image_id", "li", "hi", (F.col("_s") / (2 * r + 1)).alias("cap"))


def build_cap(points: DataFrame, config: CapBuilder | None = None) -> tuple[DataFrame, DataFrame]:
    """(cap_grid, cap_meta) from any table with image_id, l, a and b."""
    config = config or CapBuilder()
    config.validate()
    ranges = lightness_range(points)
    bins = cap_bins(points, ranges, config)
    filled = fill_lightness(fill_hue(dense_grid(bins, ranges, config), config))
    smooth = smooth_lightness(smooth_hue(filled, config), config).select("image_id", "li", "hi", F.greatest(F.col("cap") * config.relax, F.lit(0.0)).alias("cap"))
    stats = lambda grid, when: grid.groupBy("image_id").agg(F.avg("cap").alias(f"mean_{when}"), F.greatest(F.max("cap"), F.lit(0.0)).alias(f"max_{when}"))
    empty = bins.groupBy("image_id").agg((F.lit(config.n_l * config.n_h) - F.count("*")).alias("empty_cells"))
    meta = ranges.join(empty, "image_id").join(stats(filled, "before"), "image_id").join(stats(smooth, "after"), "image_id")
    return smooth, meta.select("image_id", F.lit(config.n_l).alias("n_l"), F.lit(config.n_h).alias("n_h"), "l_min", "l_max", "empty_cells", "mean_before", "max_before", "mean_after", "max_after")


@dataclass(frozen=True)
class Cap:
    """One cap on the driver: n_l x n_h numbers in row order."""

    n_l: int
    n_h: int
    l_min: float
    l_max: float
    grid: tuple[float, ...]

    def max_cap(self) -> float:
        return max(0.0, *self.grid)

    @staticmethod
    def collect(grid: DataFrame, meta: DataFrame, image_id: int) -> Cap:
        m = meta.where(F.col("image_id") == image_id).first()
        if m is None:
            raise EmptySamples(f"no cap of image {image_id}")
        cells = {(r["li"], r["hi"]): r["cap"] for r in grid.where(F.col("image_id") == image_id).collect()}
        return Cap(m["n_l"], m["n_h"], m["l_min"], m["l_max"], tuple(cells[i, j] for i in range(m["n_l"]) for j in range(m["n_h"])))

    def array(self) -> np.ndarray:
        return np.array(self.grid)


def lookup(l, h, n_l: int, n_h: int, l_min, l_max, mode: CapLookup, o=COLUMNS):
    """The cap at a lightness and hue, between the four nodes around it; o.cell reads a node."""
    lf = clamp01((l - l_min) / o.maximum(l_max - l_min, EPS), o) * float(n_l - 1)
    hf = wrap_hue(h, o) / TAU * float(n_h)
    l0, h0 = o.floor(lf), o.floor(hf) % n_h
    l1, h1 = o.where(l0 + 1 > n_l - 1, n_l - 1 + 0 * l0, l0 + 1), (h0 + 1) % n_h
    tl, th = lf - l0, hf - o.floor(hf)
    if mode.mode == "nearest":
        return o.maximum(o.cell(o.where(tl < 0.5, l0, l1) * n_h + o.where(th < 0.5, h0, h1)), 0.0)
    v00, v01, v10, v11 = (o.cell(x * n_h + y) for x in (l0, l1) for y in (h0, h1))
    value = (v00 * (1.0 - th) + v01 * th) * (1.0 - tl) + (v10 * (1.0 - th) + v11 * th) * tl
    if mode.mode == "biased":
        pick = o.maximum if mode.alpha >= 0 else o.minimum
        value = value + mode.amount() * (pick(pick(v00, v01), pick(v10, v11)) - value)
    return o.maximum(value, 0.0)


def query_cap(points: DataFrame, grid: DataFrame, meta: DataFrame, mode: CapLookup | None = None, *, shape: Sequence[int] = (24, 72), to: str = "cap") -> DataFrame:
    """`points` (image_id, l, h) with the cap of their image there.

    An image's grid comes as one array, so a lookup is four array reads in a projection.
    """
    from ..functions.backends import ColumnOps

    mode = mode or CapLookup()
    mode.validate()
    n_l, n_h = shape
    arrays = grid.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("li", "hi", "cap"))).alias("g")).select("image_id", F.transform("g", lambda c: c["cap"]).alias("_grid"))
    caps = arrays.join(meta.select("image_id", F.col("l_min").alias("_l_min"), F.col("l_max").alias("_l_max")), "image_id")
    joined = points.join(caps, "image_id")
    return joined.withColumn(to, lookup(F.col("l"), F.col("h"), n_l, n_h, F.col("_l_min"), F.col("_l_max"), mode, ColumnOps(grid="_grid"))).drop("_grid", "_l_min", "_l_max")
