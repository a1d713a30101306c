"""Representatives of each image: grid, stratified, random and farthest-point sampling.

All return reps(image_id, rep_ord, pixel_index), in the order in which later ties
are resolved.  Choices that are random take the smallest keys of a hash of seed,
image and index, so that equal seeds give equal samples in any engine.  Without a
seed, one is drawn when the plan is made.
"""

from __future__ import annotations

import secrets

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FarthestPoint, RandomUniform, Stratified, UniformGrid
from ..errors import InvalidRepresentative, NoValidPixels, raising

REPS_SCHEMA = "image_id bigint, rep_ord int, pixel_index bigint"


def drawn(seed: int | None) -> int:
    """The seed given, or a new one."""
    return secrets.randbits(48) if seed is None else seed


def random_key(idx: Column, seed: int) -> Column:
    """A 60-bit number of seed, image and index; md5, so that SQL elsewhere can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("image_id").cast("string"), idx.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _smallest(keyed: DataFrame, group: list[str], most: int) -> DataFrame:
    """The `most` smallest keys of each group with their rank, and whether the group had more rows.

    One row beyond `most` is kept until it has told that, so that the ranks stay a
    top-k which tasks cut before they shuffle.
    """
    window = W.partitionBy(*group)
    ranked = keyed.withColumn("rank", F.row_number().over(window.orderBy("key", "idx"))).where(F.col("rank") <= most + 1)
    return ranked.withColumn("cut", F.max("rank").over(window) > most).where(F.col("rank") <= most)


def _ordered(chosen: DataFrame, *order: Column | str) -> DataFrame:
    position = F.row_number().over(W.partitionBy("image_id").orderBy(*order)) - 1
    return chosen.select("image_id", position.cast("int").alias("rep_ord"), F.col("idx").alias("pixel_index"))


def uniform_grid(pixels: DataFrame, config: UniformGrid) -> DataFrame:
    """The valid pixel next to the centre of each cell of step x step pixels; ties go to the lowest index."""
    config.validate()
    step = config.step
    cell = {"cy": F.floor(F.col("y") / step), "cx": F.floor(F.col("x") / step)}
    centre = lambda c, size: 0.5 * (F.col(c) * step + F.least(F.col(c) * step + step, F.col(size)) - 1)
    inside = pixels.where("valid").withColumns(cell)
    dx, dy = F.col("x") - centre("cx", "width"), F.col("y") - centre("cy", "height")
    best = inside.groupBy("image_id", "cy", "cx").agg(F.min_by("idx", F.struct((dx * dx + dy * dy).alias("d2"), "idx")).alias("idx"))
    return _ordered(best, "cy", "cx")


def tile_of(at: str, size: str, tiles: int) -> Column:
    """The tile whose bounds (t * size div tiles) hold the position."""
    return F.floor(((F.col(at).cast("bigint") + 1) * tiles - 1) / F.col(size))


def stratified(pixels: DataFrame, config: Stratified) -> DataFrame:
    """Up to per_tile valid pixels of each tile, at random where there are more."""
    config.validate()
    tiles = {"ty": tile_of("y", "height", config.tiles_y), "tx": tile_of("x", "width", config.tiles_x), "key": random_key(F.col("idx"), drawn(config.seed))}
    ranked = _smallest(pixels.where("valid").select("image_id", "idx", *[v.alias(k) for k, v in tiles.items()]), ["image_id", "ty", "tx"], config.per_tile)
    # a tile that isn't cut keeps its pixels in row order
    return _ordered(ranked, "ty", "tx", F.when(F.col("cut"), F.col("rank")).otherwise(F.col("idx")))


def random_uniform(pixels: DataFrame, config: RandomUniform) -> DataFrame:
    """`count` valid pixels of each image without replacement; all, in order, where there are no more."""
    config.validate()
    keyed = pixels.where("valid").select("image_id", "idx", random_key(F.col("idx"), drawn(config.seed)).alias("key"))
    ranked = _smallest(keyed, ["image_id"], config.count)
    return _ordered(ranked, F.when(F.col("cut"), F.col("rank")).otherwise(F.col("idx")))


def stride_candidates(pixels: DataFrame, stride: int) -> DataFrame:
    """Every stride-th valid pixel of each image, from the first."""
    rank = F.row_number().over(W.partitionBy("image_id").orderBy("idx")) - 1
    return pixels.where("valid").withColumn("_rank", rank).where(F.col("_rank") % stride == 0).drop("_rank")


def farthest_points(lab: np.ndarray, saliency: np.ndarray, idx: np.ndarray, config: FarthestPoint, entropy: list[int] | None = None) -> list[int]:
    """Positions of greedily farthest points; ties within 1e-12 go to the lowest index.

    Without a saliency bias the first is drawn, from `entropy` or the configuration's seed.
    """
    count = min(config.count, len(idx))
    order = np.argsort(idx, kind="stable")
    pick = lambda score: int(order[np.flatnonzero(score[order] >= score.max() - 1e-12)[0]])
    first = pick(saliency) if config.saliency_bias > 0 else int(np.random.default_rng(config.seed if entropy is None else entropy).integers(len(idx)))
    chosen, nearest = [first], ((lab - lab[first]) ** 2).sum(axis=1)
    free = np.ones(len(idx), dtype=bool)
    free[first] = False
    boost = 1.0 + config.saliency_bias * np.clip(saliency, 0.0, 1.0)
    while len(chosen) < count:
        at = pick(np.where(free, np.sqrt(nearest) * boost, -np.inf))
        chosen.append(at)
        free[at] = False
        nearest = np.minimum(nearest, ((lab - lab[at]) ** 2).sum(axis=1))
    return chosen


def farthest_point(pixels: DataFrame, config: FarthestPoint) -> DataFrame:
    """Farthest-point samples in Oklab.  Each pick depends on all before, so an image is one task; images are parallel."""
    config.validate()
    seed = drawn(config.seed)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").iloc[:: config.candidate_stride]
        idx = pdf["idx"].to_numpy()
        picked = farthest_points(pdf[["l", "a", "b"]].to_numpy(), pdf["saliency"].to_numpy(), idx, config, [seed, int(pdf["image_id"].iloc[0]) % 2**64])
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "rep_ord": np.arange(len(picked), dtype=np.int32), "pixel_index": idx[picked]})

    return pixels.where("valid").select("image_id", "idx", "l", "a", "b", "saliency").groupBy("image_id").applyInPandas(choose, REPS_SCHEMA)


def keep_first(reps: DataFrame) -> DataFrame:
    """Repeated pixels dropped but for their first place."""
    first = F.row_number().over(W.partitionBy("image_id", "pixel_index").orderBy("rep_ord"))
    return reps.withColumn("_n", first).where("_n = 1").drop("_n")


def given_representatives(pixels: DataFrame, reps: DataFrame) -> DataFrame:
    """Pixels chosen elsewhere, repeats dropped but for their first place; one that isn't a valid pixel is an error."""
    known = pixels.where("valid").select("image_id", F.col("idx").alias("pixel_index"), F.lit(True).alias("_known"))
    joined = keep_first(reps.select("image_id", "rep_ord", "pixel_index")).join(known, ["image_id", "pixel_index"], "left")
    bad = raising(InvalidRepresentative, "pixel ", F.col("pixel_index"), " of image ", F.col("image_id"), " is not a valid pixel")
    # in the column that later joins go by, so that none drops the row unseen
    return joined.select("image_id", "rep_ord", F.when(F.col("_known"), F.col("pixel_index")).otherwise(bad.cast("bigint")).alias("pixel_index"))


def select_representatives(pixels: DataFrame, config: UniformGrid | Stratified | RandomUniform | FarthestPoint | DataFrame) -> DataFrame:
    """Representatives by the method of the configuration's type, or a table of chosen ones.

    The methods take each pixel once and valid pixels only, so only a table given is
    checked; that no image is left without any is for `check_representatives`.
    """
    if isinstance(config, DataFrame):
        return given_representatives(pixels, config)
    method = {UniformGrid: uniform_grid, Stratified: stratified, RandomUniform: random_uniform, FarthestPoint: farthest_point}[type(config)]
    return method(pixels, config)


def check_representatives(pixels: DataFrame, reps: DataFrame) -> None:
    """Raise if an image is left without representatives."""
    for row in pixels.select("image_id").distinct().join(reps, "image_id", "left_anti").limit(1).collect():
        raise NoValidPixels(f"image {row['image_id']} has no representative")
