"""Deterministic pixel tables made from the driver's business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 32
IMAGE_PIXELS = 1024


def rgba_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for every 1,024 event ids, 32 pixels wide; a last line that isn't full ends in transparent black.

    `rgba` is a projection of the scan but for one small aggregation that gives each
    image its height, and the padding made from it.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "event_type")
    image, idx = F.floor(F.col("event_id") / IMAGE_PIXELS), F.col("event_id") % IMAGE_PIXELS
    sizes = events.groupBy(image.alias("image_id")).agg((F.max(idx) + 1).alias("filled")).withColumn("height", F.ceil(F.col("filled") / WIDTH).cast("int"))
    alpha = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 128).otherwise(255)
    pixels = events.select(
        image.alias("image_id"), idx.alias("idx"),
        (F.round(F.col("value") * 100).cast("bigint") % 256).cast("int").alias("r"), ((F.col("event_id") * 91 + 7) % 256).cast("int").alias("g"), ((F.col("event_id") * 13 + 101) % 256).cast("int").alias("b"), alpha.alias("a"),
    ).join(sizes.drop("filled"), "image_id")
    short = sizes.where(F.col("filled") < F.col("height") * WIDTH)
    padding = short.select("image_id", F.explode(F.sequence(F.col("filled"), F.col("height").cast("bigint") * WIDTH - 1)).alias("idx"), *[F.lit(0).alias(c) for c in "rgba"], "height")
    rows = pixels.unionByName(padding)
    return rows.select("image_id", F.lit(WIDTH).alias("width"), "height", "idx", (F.col("idx") % WIDTH).cast("int").alias("x"), F.floor(F.col("idx") / WIDTH).cast("int").alias("y"), "r", "g", "b", "a")


def lab_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, l, a, b): the first three components of each vector, scaled into the Oklab range."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    e = lambda k: F.col("embedding")[k].cast("double")
    return vectors.select("vec_id", (0.5 + e(0) * 0.4).alias("l"), (e(1) * 0.3).alias("a"), (e(2) * 0.3).alias("b"))
