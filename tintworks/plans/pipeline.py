"""From images to support tables, and from a support table to a problem's samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..errors import translated
from ..operators.assignment import check_samples, export_samples
from ..operators.cap import build_cap
from ..operators.preprocess import check_images, prepare
from ..operators.saliency import compute_saliency, saliency_stats
from ..operators.sampling import check_representatives, select_representatives
from ..problem import weighted_samples
from ..sources.images import images_to_rgba, read_images


@dataclass(frozen=True)
class Support:
    """What a set of images gives: samples, caps (None unless asked for) and diagnostics, keyed by image_id.

    Pixels and samples are kept, on executors' disks if need be, until `close` or the end of a `with` block.
    """

    pixels: DataFrame
    reps: DataFrame
    samples: DataFrame
    cap_grid: DataFrame | None
    cap_meta: DataFrame | None
    diagnostics: DataFrame

    def close(self) -> None:
        """Free what is kept; the tables stay usable and are computed again."""
        self.samples.unpersist()
        self.pixels.unpersist()

    def __enter__(self) -> Support:
        return self

    def __exit__(self, *failure) -> None:
        self.close()


def support_from_rgba(rgba: DataFrame, config: PipelineConfig | None = None, *, strict: bool = True) -> Support:
    """Support tables of all images in `rgba`.

    Strict, the stages run at once and an image without area, valid pixels,
    representatives or samples raises the engine's error.  Otherwise nothing runs
    yet, and such an image has rows in `pixels` and `diagnostics` only.
    """
    config = config or PipelineConfig()
    # read by every later stage; a lost part is computed again from its image
    pixels = compute_saliency(prepare(rgba, config.preprocess), config.saliency).persist(StorageLevel.MEMORY_AND_DISK)
    reps = select_representatives(pixels, config.sampling)
    samples = export_samples(pixels, reps, config.export).persist(StorageLevel.MEMORY_AND_DISK)
    grid = meta = None
    if config.cap is not None:
        grid, meta = build_cap(samples if config.cap.from_samples else pixels.where("valid"), config.cap)
    support = Support(pixels, reps, samples, grid, meta, diagnostics(rgba, pixels, reps, samples))
    if strict:
        try:
            with translated():
                check_images(pixels)
                if isinstance(config.sampling, DataFrame):
                    check_representatives(pixels, reps)
                check_samples(samples, pixels)
        except BaseException:
            support.close()
            raise
    return support


def support_from_path(spark: SparkSession, path: str | list[str], config: PipelineConfig | None = None, *, strict: bool = True) -> Support:
    return support_from_rgba(images_to_rgba(read_images(spark, path)), config, strict=strict)


def diagnostics(rgba: DataFrame, pixels: DataFrame, reps: DataFrame, samples: DataFrame) -> DataFrame:
    """One row for each image: sizes, valid and invalid pixels, saliency, representatives, samples and their weight."""
    size = rgba.groupBy("image_id").agg(F.max("width").alias("original_width"), F.max("height").alias("original_height"))
    valid = F.col("valid").cast("bigint")
    work = pixels.groupBy("image_id").agg(F.max("width").alias("working_width"), F.max("height").alias("working_height"), F.sum(valid).alias("valid_pixels"), F.sum(1 - valid).alias("invalid_pixels"))
    n_reps = reps.groupBy("image_id").agg(F.count("*").alias("n_representatives"))
    n_samples = samples.groupBy("image_id").agg(F.count("*").alias("n_samples"), F.sum("weight").alias("total_weight"))
    out = size
    for part in (work, saliency_stats(pixels), n_reps, n_samples):
        out = out.join(part, "image_id", "left")
    return out


def problem_samples(samples: DataFrame, image_id: int) -> np.ndarray:
    """One image's samples on the driver: as many rows as its sampling method chose."""
    rows = samples.where(F.col("image_id") == image_id).orderBy("sample_ord").select("l", "a", "b", "weight", "saliency").collect()
    return weighted_samples(tuple(r) for r in rows)
