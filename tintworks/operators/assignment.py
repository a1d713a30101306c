"""Pixels to their nearest representative, and clusters to weighted samples.

An image's representatives travel as one array beside its pixels (a sampling
method bounds their number), so assignment is a fold inside a projection; the
clusters are one partial and final aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ExportConfig
from ..errors import InvalidConfig
from ..functions.numeric import clamp01, distance2


def assign_nearest(pixels: DataFrame, reps: DataFrame) -> DataFrame:
    """Valid pixels with the rep_ord of their nearest representative; a later one must be nearer by more than 1e-12."""
    labs = reps.join(pixels.select("image_id", F.col("idx").alias("pixel_index"), "l", "a", "b"), ["image_id", "pixel_index"])
    arrays = labs.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rep_ord", "l", "a", "b"))).alias("_reps"))
    here = tuple(F.col(c) for c in "lab")
    start = F.struct(F.lit(float("inf")).alias("d2"), F.lit(-1).alias("rep_ord"))

    def nearer(best, rep):
        d2 = distance2(here, (rep["l"], rep["a"], rep["b"]))
        return F.when(d2 < best["d2"] - 1e-12, F.struct(d2.alias("d2"), rep["rep_ord"].alias("rep_ord"))).otherwise(best)

    return pixels.where("valid").join(arrays, "image_id").withColumn("rep_ord", F.aggregate("_reps", start, nearer)["rep_ord"]).drop("_reps")


def clusters(assigned: DataFrame) -> DataFrame:
    """Mass, mean saliency, count and mass-weighted mean colour for each representative with mass."""
    sums = assigned.groupBy("image_id", "rep_ord").agg(
        F.sum("alpha").alias("mass"), F.sum("saliency").alias("sal_sum"), F.count("*").alias("pixel_count"), *[F.sum(F.col("alpha") * F.col(c)).alias(f"sum_{c}") for c in "lab"]
    )
    return sums.where("mass > 0").select("image_id", "rep_ord", "mass", "pixel_count", clamp01(F.col("sal_sum") / F.col("pixel_count")).alias("mean_saliency"), *[(F.col(f"sum_{c}") / F.col("mass")).alias(c) for c in "lab"])


def medoids(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """`found` with each colour replaced by that of the member next to it, ties to the lowest index."""
    centre = found.select("image_id", "rep_ord", *[F.col(c).alias(f"c_{c}") for c in "lab"])
    members = assigned.select("image_id", "rep_ord", "idx", "l", "a", "b").join(centre, ["image_id", "rep_ord"])
    d2 = distance2([F.col(c) for c in "lab"], [F.col(f"c_{c}") for c in "lab"])
    nearest = members.groupBy("image_id", "rep_ord").agg(F.min_by(F.struct("l", "a", "b"), F.struct(d2.alias("d2"), "idx")).alias("m"))
    return found.drop("l", "a", "b").join(nearest, ["image_id", "rep_ord"]).select(*[c for c in found.columns if c not in ("l", "a", "b")], "m.l", "m.a", "m.b")


def export_samples(pixels: DataFrame, reps: DataFrame, config: ExportConfig | None = None) -> DataFrame:
    """samples(image_id, sample_ord, l, a, b, weight, saliency), in the order of representatives.

    Weights are normalised before the threshold, so a filtered image's may sum to less than 1.
    """
    config = config or ExportConfig()
    config.validate()
    assigned = assign_nearest(pixels, reps)
    found = clusters(assigned)
    if config.medoid:
        found = medoids(assigned, found)
    weight = F.pow("mass", F.lit(config.frequency_gamma))
    if config.saliency_to_weight_mix > 0:
        mix = config.saliency_to_weight_mix
        weight = weight * ((1.0 - mix) + mix * F.pow("mean_saliency", F.lit(config.saliency_weight_gamma)))
    weighted = found.withColumn("weight", weight)
    if config.normalize_weights:
        weighted = weighted.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy("image_id")))
    kept = weighted.where(F.col("weight") >= config.min_cluster_weight)
    order = F.row_number().over(W.partitionBy("image_id").orderBy("rep_ord")) - 1
    return kept.select("image_id", order.cast("int").alias("sample_ord"), "l", "a", "b", "weight", F.col("mean_saliency").alias("saliency"))


def check_samples(samples: DataFrame, images: DataFrame) -> None:
    """Raise if an image is left without samples: all its clusters were below the threshold."""
    for row in images.select("image_id").distinct().join(samples, "image_id", "left_anti").limit(1).collect():
        raise InvalidConfig(f"all clusters of image {row['image_id']} were filtered out")
