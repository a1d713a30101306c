"""Small things that the operators share: column names, checkpoints, table reading."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of `documents`, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Up to so many rows or items of a few numbers are broadcast, once they are counted; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, also where it has dots or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def given(docs: DataFrame, *added: str, **changed: Column) -> Column:
    """All columns of `docs` as one struct, but those named like a result's (Spark compares without case).

    Operators carry what they were given in this struct, so that none of its names
    meets one of theirs; select("given.*") unfolds it.  `changed` replaces columns.
    """
    drop = {a.lower() for a in added}
    return F.struct(*[changed.get(c, column(c)).alias(c) for c in docs.columns if c.lower() not in drop])


def row_key(doc_id: Column, text: Column) -> Column:
    """A 128-bit digest of id and text, nulls told from values: what ties a row to what is known of it."""
    key = F.concat(F.coalesce(F.concat(doc_id.cast("string"), F.lit(":")), F.lit("?")), F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(key.cast("binary")))


def small(frame: DataFrame, items: str | None = None) -> DataFrame:
    """`frame`, cut from its lineage, marked for a broadcast if it is counted to be of few rows, and few items in its array."""
    rows, inside = frame.agg(F.count("*"), F.coalesce(F.sum(F.size(items)), F.lit(0)) if items else F.lit(0)).first()
    return F.broadcast(frame) if max(rows, inside) <= BROADCAST_ROWS else frame


def thin(frame: DataFrame) -> DataFrame:
    """A frame of pairs or labels in a quarter of the shuffle's partitions, which are so many for the sake of the texts."""
    return frame.coalesce(-(-int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def durable(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that the cluster names.

    Only a session of one process (local[n], as in tests) may have none; it gets its own.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tintworks-checkpoints-"))
    return frame.checkpoint(eager=True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of durable frames that nothing reads again."""
    for frame in frames:
        context, stored = frame.sparkSession.sparkContext, frame._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if stored.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(stored.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of lineages that were cut go now: Spark removes them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names like `names` that no column in `taken` has (Spark compares without case)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
