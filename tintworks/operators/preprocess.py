"""RGBA pixels to prepared pixels: resize, linear light, compositing, Oklab, luminance, validity.

`rgba(image_id, width, height, idx, x, y, r, g, b, a)` becomes
`pixels(image_id, width, height, idx, x, y, lin_r, lin_g, lin_b, luminance, l, a, b, alpha, valid)`.
All but resizing is a projection, so it fuses with the scan; images are
independent, and nothing here shuffles but a resize, once by image.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PreprocessConfig
from ..errors import EmptyImage, NoValidPixels
from ..functions.color import cone_roots, relative_luminance, roots_to_oklab, srgb_to_linear
from .constants import linear_background

RGBA_SCHEMA = "image_id bigint, width int, height int, idx bigint, x int, y int, r int, g int, b int, a int"
PIXEL_COLUMNS = ("image_id", "width", "height", "idx", "x", "y", "lin_r", "lin_g", "lin_b", "luminance", "l", "a", "b", "alpha", "valid")


def working_size(width: int, height: int, limit: int | None) -> tuple[int, int]:
    """Size after down-scaling to `limit` for the longer side; never enlarged, never below 1."""
    longest = max(width, height)
    if limit is None or longest <= limit:
        return width, height
    scale = limit / longest
    fit = lambda n: max(1, math.floor(n * scale + 0.5))
    return fit(width), fit(height)


def _sinc(x):
    return np.sinc(x)


def _catmull_rom(x):
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


#: Kernel and its reach, by filter.
KERNELS = {
    "triangle": (lambda x: np.maximum(1 - np.abs(x), 0.0), 1.0),
    "catmull_rom": (_catmull_rom, 2.0),
    "gaussian": (lambda x: np.exp(-2.0 * x * x) * math.sqrt(2.0 / math.pi), 3.0),
    "lanczos3": (lambda x: np.where(np.abs(x) < 3, _sinc(x) * _sinc(x / 3), 0.0), 3.0),
}


def resample_weights(size: int, to: int, method: str) -> np.ndarray:
    """A `to` x `size` matrix that maps a line of `size` values to `to` values."""
    ratio = size / to
    centres = (np.arange(to) + 0.5) * ratio
    places = np.arange(size)[None, :]
    if method == "nearest":
        return (np.minimum(np.floor(centres), size - 1)[:, None] == places).astype(np.float64)
    kernel, reach = KERNELS[method]
    wide = max(ratio, 1.0)
    lo = np.clip(np.floor(centres - reach * wide), 0, size - 1)
    hi = np.clip(np.ceil(centres + reach * wide), lo + 1, size)
    weights = kernel((places + 0.5 - centres[:, None]) / wide) * ((places >= lo[:, None]) & (places < hi[:, None]))
    return weights / weights.sum(axis=1, keepdims=True)


def resample(image: np.ndarray, width: int, height: int, method: str) -> np.ndarray:
    """A height x width x channels byte image, by separable filtering of the straight-alpha bytes."""
    rows = resample_weights(image.shape[0], height, method)
    columns = resample_weights(image.shape[1], width, method)
    out = np.einsum("yh,hwc->ywc", rows, image.astype(np.float64))
    out = np.einsum("xw,ywc->yxc", columns, out)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def resize(rgba: DataFrame, config: PreprocessConfig) -> DataFrame:
    """Images with a side above the limit scaled down, one image to a task; others pass without a shuffle."""
    if config.max_working_dim is None:
        return rgba
    limit, method = config.max_working_dim, config.resize_filter

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        w, h = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        to_w, to_h = working_size(w, h, limit)
        small = resample(pdf[["r", "g", "b", "a"]].to_numpy(np.uint8).reshape(h, w, 4), to_w, to_h, method).reshape(-1, 4)
        idx = np.arange(to_w * to_h)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "width": to_w, "height": to_h, "idx": idx, "x": idx % to_w, "y": idx // to_w, **{c: small[:, k].astype(np.int32) for k, c in enumerate("rgba")}})

    large = F.greatest("width", "height") > limit
    shrunk = rgba.where(large).groupBy("image_id").applyInPandas(shrink, RGBA_SCHEMA)
    return rgba.where(~large).unionByName(shrunk)


def _channel(c: str) -> Column:
    return srgb_to_linear(F.col(c).cast("double") / 255.0)


def prepare(rgba: DataFrame, config: PreprocessConfig | None = None) -> DataFrame:
    """Prepared pixels; invalid pixels stay as rows with valid = false."""
    config = config or PreprocessConfig()
    config.validate()
    sized = resize(rgba, config)
    alpha = F.col("a").cast("double") / 255.0
    raw = sized.select("image_id", "width", "height", "idx", "x", "y", *[_channel(c).alias(f"fg_{c}") for c in "rgb"], alpha.alias("raw_alpha"))
    back = linear_background(config.background)
    lit = raw.withColumns({f"lin_{c}": F.col("raw_alpha") * F.col(f"fg_{c}") + (1.0 - F.col("raw_alpha")) * F.lit(back[k]) for k, c in enumerate("rgb")})
    rgb = (F.col("lin_r"), F.col("lin_g"), F.col("lin_b"))
    # cone responses as columns of their own: each of l, a and b reads all three
    lit = lit.withColumns({f"cone_{k}": v for k, v in enumerate(cone_roots(rgb))})
    lab = roots_to_oklab([F.col(f"cone_{k}") for k in range(3)])
    valid = F.col("raw_alpha") >= config.min_alpha
    mass = F.when(valid, F.col("raw_alpha") if config.alpha_into_weight else F.lit(1.0)).otherwise(0.0)
    named = {"luminance": relative_luminance(rgb), "l": lab[0], "a": lab[1], "b": lab[2], "alpha": mass, "valid": valid}
    return lit.select("image_id", "width", "height", "idx", "x", "y", "lin_r", "lin_g", "lin_b", *[v.alias(k) for k, v in named.items()])


def check_images(pixels: DataFrame) -> None:
    """Raise for images without area or without a valid pixel: one aggregation over all images."""
    bad = pixels.groupBy("image_id").agg(F.max(F.least("width", "height")).alias("side"), F.max(F.col("valid").cast("int")).alias("some")).where("side < 1 or some = 0")
    for row in bad.limit(1).collect():
        raise (EmptyImage if row["side"] < 1 else NoValidPixels)(f"image {row['image_id']}")
