"""Saliency of prepared pixels: global or local colour contrast, normalised within each image.

Local contrast is a masked separable box blur.  Each axis is one window over the
lines of an image (small partitions, all images in parallel), so a blur costs two
shuffles whatever the radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GlobalContrast, LocalContrast, NoSaliency
from ..errors import NumericInstability, raising
from ..functions.numeric import clamp01, distance2


def _axis_sum(value: Column, line: tuple[str, ...], at: str, size: str, radius: int) -> Column:
    """Sum of `value` over the positions at - radius to at + radius; positions beyond an edge repeat the edge."""
    order = W.partitionBy(*line).orderBy(at)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, after = F.greatest(radius - F.col(at), F.lit(0)), F.greatest(F.col(at) + radius - (F.col(size) - 1), F.lit(0))
    return F.sum(value).over(order.rowsBetween(-radius, radius)) + before * F.first(value).over(whole) + after * F.last(value).over(whole)


def box_blur(pixels: DataFrame, columns: dict[str, str], radius: int) -> DataFrame:
    """`pixels` with each column named in `columns` blurred into its value's name.

    Invalid pixels add nothing; a pixel without a valid neighbour keeps its own value.
    """
    if radius == 0:
        return pixels.withColumns({to: F.col(c) for c, to in columns.items()})
    masked = {f"_m_{c}": F.when(F.col("valid"), F.col(c)).otherwise(0.0) for c in columns} | {"_m": F.col("valid").cast("double")}
    out = pixels.withColumns(masked)
    out = out.withColumns({f"_h{k[2:]}": _axis_sum(F.col(k), ("image_id", "y"), "x", "width", radius) for k in masked})
    out = out.withColumns({f"_v{k[2:]}": _axis_sum(F.col(f"_h{k[2:]}"), ("image_id", "x"), "y", "height", radius) for k in masked})
    blurred = {to: F.when(F.col("_v") > 0, F.col(f"_v_{c}") / F.col("_v")).otherwise(F.col(c)) for c, to in columns.items()}
    return out.withColumns(blurred).drop(*masked, *[f"_h{k[2:]}" for k in masked], *[f"_v{k[2:]}" for k in masked])


def normalise(pixels: DataFrame, raw: str, robust: bool, to: str = "saliency") -> DataFrame:
    """`raw` scaled to 0..1 between the extremes (or 1st and 99th percentiles) of an image's valid pixels."""
    valid = pixels.where("valid").groupBy("image_id")
    if robust:
        ends = valid.agg(F.percentile(raw, F.array(F.lit(0.01), F.lit(0.99))).alias("p")).select("image_id", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    else:
        ends = valid.agg(F.min(raw).alias("lo"), F.max(raw).alias("hi"))
    span = F.col("hi") - F.col("lo")
    scaled = F.when(F.abs(span) <= 1e-12, F.lit(1.0)).otherwise(clamp01((F.col(raw) - F.col("lo")) / F.when(F.abs(span) <= 1e-12, 1.0).otherwise(span)))
    joined = pixels.join(ends, "image_id", "left")
    # a value that is no number makes an end of its image no number
    sound = (F.abs(F.col("lo")) < float("inf")) & (F.abs(F.col("hi")) < float("inf")) & (F.abs(F.col(raw)) < float("inf"))
    scaled = F.when(sound, scaled).otherwise(raising(NumericInstability, "saliency of image ", F.col("image_id"), " is not finite").cast("double"))
    return joined.withColumn(to, F.when(F.col("valid"), scaled).otherwise(0.0)).drop("lo", "hi")


def _with_mean(pixels: DataFrame) -> DataFrame:
    """Each row with the unweighted mean Oklab of its image's valid pixels."""
    mean = pixels.where("valid").groupBy("image_id").agg(*[F.avg(c).alias(f"_mean_{c}") for c in "lab"])
    return pixels.join(mean, "image_id", "left")


def _from_mean() -> Column:
    return F.sqrt(distance2([F.col(c) for c in "lab"], [F.col(f"_mean_{c}") for c in "lab"]))


def compute_saliency(pixels: DataFrame, method: NoSaliency | GlobalContrast | LocalContrast) -> DataFrame:
    """`pixels` with a column saliency in 0..1; 0 for invalid pixels, but 1 for all without a method."""
    if isinstance(method, NoSaliency):
        return pixels.withColumn("saliency", F.lit(1.0))
    if isinstance(method, GlobalContrast):
        raw = _with_mean(pixels).withColumn("_raw", F.when(F.col("valid"), _from_mean()).otherwise(0.0))
        return normalise(raw, "_raw", method.robust).drop("_raw", "_mean_l", "_mean_a", "_mean_b")
    method.validate()
    blurred = box_blur(pixels, {"l": "_bl", "a": "_ba", "b": "_bb", "luminance": "_by"}, method.radius)
    contrast = method.color_weight * F.sqrt(distance2([F.col(c) for c in "lab"], [F.col("_bl"), F.col("_ba"), F.col("_bb")])) + method.lightness_weight * F.abs(F.col("luminance") - F.col("_by"))
    if method.global_mix > 0:
        blurred = _with_mean(blurred)
        contrast = (1.0 - method.global_mix) * contrast + method.global_mix * _from_mean()
    raw = blurred.withColumn("_raw", F.when(F.col("valid"), F.greatest(contrast, F.lit(0.0))).otherwise(0.0))
    return normalise(raw, "_raw", method.robust).drop("_raw", "_bl", "_ba", "_bb", "_by", "_mean_l", "_mean_a", "_mean_b")


def saliency_stats(pixels: DataFrame) -> DataFrame:
    """Minimum, maximum and mean over the valid pixels of each image."""
    return pixels.where("valid").groupBy("image_id").agg(F.min("saliency").alias("saliency_min"), F.max("saliency").alias("saliency_max"), F.avg("saliency").alias("saliency_mean"))


def luma(pixels: DataFrame) -> DataFrame:
    """The saliency map as grey values 0..255."""
    return pixels.select("image_id", "width", "height", "idx", F.round(clamp01(F.col("saliency")) * 255.0).cast("int").alias("luma"))
