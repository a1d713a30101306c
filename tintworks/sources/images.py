"""Image sources and sinks.

Files are read by Spark's own image source (any store Spark reads, one task for a
group of files), once; decoded bytes become pixel rows in an Arrow kernel, some
rows of an image at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyImage, ImageDecode, raising
from ..operators.preprocess import RGBA_SCHEMA

SAMPLES_SCHEMA = "image_id bigint, sample_ord int, l double, a double, b double, weight double, saliency double"


#: Pixels of one Arrow batch; a line of an image is never split.
BATCH_PIXELS = 1 << 18


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decoded images; a file that can't be decoded fails the job that meets it (ImageDecode), and is never dropped."""
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    readable = (F.col("nChannels") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    # the check decides a column that every reader needs, so it is not optimised away
    return images.withColumn("nChannels", F.when(readable, F.col("nChannels")).otherwise(raising(ImageDecode, F.col("origin")).cast("int")))


def _pixel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            image_id, width, height, channels = (batch.column(k)[at].as_py() for k in range(4))
            data = np.frombuffer(batch.column(4)[at].as_buffer(), np.uint8).reshape(height, width, channels)
            lines = max(1, BATCH_PIXELS // width)
            for y in range(0, height, lines):
                part = data[y : y + lines].reshape(-1, channels).astype(np.int32)
                idx = np.arange(y * width, y * width + len(part), dtype=np.int64)
                grey = part[:, 0]
                r, g, b = (grey, grey, grey) if channels == 1 else (part[:, 2], part[:, 1], grey)
                a = part[:, 3] if channels == 4 else np.full(len(part), 255, np.int32)
                same = lambda v, t: pa.array(np.full(len(part), v), t)  # noqa: B023, E731
                columns = [same(image_id, pa.int64()), same(width, pa.int32()), same(height, pa.int32()), pa.array(idx), pa.array((idx % width).astype(np.int32)), pa.array((idx // width).astype(np.int32)), *map(pa.array, (r, g, b, a))]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "width", "height", "idx", "x", "y", "r", "g", "b", "a"])


def images_to_rgba(images: DataFrame) -> DataFrame:
    """rgba rows from image source rows (grey, BGR or BGRA bytes); image_id is a hash of the origin."""
    return images.select(F.xxhash64("origin").alias("image_id"), "width", "height", "nChannels", "data").mapInArrow(_pixel_rows, RGBA_SCHEMA)


def rgba_from_pixels(spark: SparkSession, images: Iterable[tuple[int, int, int, Sequence]]) -> DataFrame:
    """rgba rows of small images in memory: (image_id, width, height, [(r, g, b[, a]), ...]) in row order."""
    rows = []
    for image_id, width, height, pixels in images:
        if width < 1 or height < 1 or len(pixels) != width * height:
            raise EmptyImage(f"image {image_id}")
        for i, p in enumerate(pixels):
            r, g, b, a = (*p, 255)[:4]
            rows.append((image_id, width, height, i, i % width, i // width, r, g, b, a))
    return spark.createDataFrame(rows, RGBA_SCHEMA)


def samples_from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """samples rows from (image_id, sample_ord, l, a, b, weight, saliency), saliency clamped to 0..1."""
    made = spark.createDataFrame(list(rows), SAMPLES_SCHEMA)
    return made.withColumn("saliency", F.greatest(F.least("saliency", F.lit(1.0)), F.lit(0.0)))


def pgm_images(luma: DataFrame) -> DataFrame:
    """(image_id, pgm): each grey image as the bytes of a binary PGM file, from (image_id, width, height, idx, luma)."""
    rows = luma.groupBy("image_id").agg(F.max("width").alias("w"), F.max("height").alias("h"), F.sort_array(F.collect_list(F.struct("idx", "luma"))).alias("p"))
    digits = F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x["luma"]), 2, "0")), "")
    head = F.encode(F.concat(F.lit("P5\n"), F.col("w").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit("\n255\n")), "US-ASCII")
    return rows.select("image_id", F.concat(head, F.unhex(digits)).alias("pgm"))
