"""MinHash near-dedup of documents: one-permutation hashing, banded buckets, star-shaped candidates.

Words are runs of anything but ASCII white space, with A-Z lower-cased.  A
document's set is its distinct word shingles of the whole text; with fewer words
than a shingle, all its words are the one shingle; without words it is empty and
linked with nothing.  Documents of equal sets form a class (by a 128-bit digest of
the set), classes are bucketed by bands of their signatures, and candidates are
confirmed on the full sets.  The bands find a pair at the threshold itself with
probability 0.99999, so hardly any link is missed.

Edge cases: null and empty texts have 0 shingles and stand alone, kept; rows that
repeat an id and its text are one class and get the same result; component_id is
the smallest id that is not null, and null where all are; a row with a null id is
kept only where its component_id is null; an empty table gives an empty result;
columns of any name pass through where rows are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, durable, given, release, row_key, small, thin
from .links import bucket_members, linked_components, set_column
from .minhash import Bands, band_keys, signatures
from .textkernel import Chunk, chunks, lower_ascii, mix64, row_shingles, span_hashes


@dataclass(frozen=True)
class NearDupConfig:
    width: int = 5
    percent: int = 80
    bands: Bands = Bands(40, 6)


def _chunk_shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    low = lower_ascii(chunk.data)
    starts, ends, rows = chunk.words()
    return row_shingles(span_hashes(low, starts, ends), rows, chunk.rows, width)


def _set_sums(hashes: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix64(hashes ^ np.uint64(salt)), out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _described(text: Column, config: NearDupConfig) -> Column:
    """struct(n, h1, h2, keys): size and digest of the set of each text, and its band keys."""
    shape = config.bands

    @F.arrow_udf("struct<n:bigint,h1:bigint,h2:bigint,keys:array<bigint>>")
    def kernel(column: pa.Array) -> pa.Array:
        n, h1, h2, keys, some = [], [], [], [], []
        for chunk in chunks(column):
            hashes, bounds = _chunk_shingles(chunk, config.width)
            sizes = np.diff(bounds)
            owners = np.repeat(np.arange(chunk.rows), sizes)
            n.append(sizes)
            h1.append(_set_sums(hashes, bounds, 0x51ED270B7D3C1A4D).view(np.int64))
            h2.append(_set_sums(hashes, bounds, 0x2545F4914F6CDD1D).view(np.int64))
            keys.append(band_keys(signatures(hashes, owners, chunk.rows, shape.bins), shape)[sizes > 0].ravel())
            some.append(sizes > 0)
        cat = lambda x, t: np.concatenate([np.zeros(0, dtype=t), *x])
        offsets = np.concatenate([[0], np.cumsum(cat(some, bool) * shape.bands)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cat(keys, np.int64)))
        return pa.StructArray.from_arrays([*(pa.array(cat(x, np.int64)) for x in (n, h1, h2)), lists], ["n", "h1", "h2", "keys"])

    return kernel.asNondeterministic()(text)


def _sets(text: Column, config: NearDupConfig) -> Column:
    """The set of each text, as sorted hashes."""

    @F.arrow_udf("binary")
    def kernel(column: pa.Array) -> pa.Array:
        out = []
        for chunk in chunks(column):
            hashes, bounds = _chunk_shingles(chunk, config.width)
            out += [hashes[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        return set_column(out)

    return kernel.asNondeterministic()(text)


def near_duplicates(docs: DataFrame, config: NearDupConfig | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row_key, first) for each row of `docs`.

    component_id is the smallest id among the documents reachable over links, and
    kept tells whether it is the row's own.  row_key identifies id and text; first
    is the row_key of the component's first row: the smallest id (null last), then
    the smallest row_key; a row without a set is its own first.
    """
    config = config or NearDupConfig()
    rows_in = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    rows = durable(rows_in.select("doc_id", "row_key", F.monotonically_increasing_id().alias("row"), _described(F.col("text"), config).alias("s")).select("doc_id", "row_key", "row", "s.*"))
    # equal sets are one unit, the first row of it stands for all
    classes = durable(rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("row").alias("node"), F.min(F.struct(F.isnull("doc_id"), "doc_id", "row_key")).alias("least")))
    heads = rows.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi")
    members = durable(bucket_members(heads.select(F.col("row").alias("node"), F.explode("keys").alias("key"))))
    release(docs.sparkSession)
    nodes = members.select("node")
    wanted = durable(thin(rows.select("row", F.col("row_key").alias("wanted")).join(nodes, F.col("row") == F.col("node")).select("node", "wanted")))
    # rows that repeat an id and its text share a row_key, and any of them will do
    found = rows_in.join(small(wanted), F.col("row_key") == F.col("wanted")).select("node", _sets(F.col("text"), config).alias("items"))
    sets = durable(found.dropDuplicates(["node"]))

    labels = linked_components(members, sets, config.percent)
    discard(members, sets, wanted)
    comp = F.coalesce(F.col("comp"), F.col("node"))
    labelled = classes.join(labels.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("h1", "h2", F.col("n").alias("xn"), "least", comp.alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("least").alias("of")).select(F.col("comp").alias("c"), "of")
    known = labelled.join(least, F.col("comp") == F.col("c")).select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), "xn", "of")
    joined = rows.join(known, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")) & (F.col("n") == F.col("xn")), "left")
    own = F.when(F.col("xn").isNull(), F.col("doc_id")).otherwise(F.col("of.doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "row_key", F.coalesce("of.row_key", "row_key").alias("first"))


def drop_near_duplicates(docs: DataFrame, config: NearDupConfig | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each group: the one of the smallest id, then of the smallest digest of id and text.

    Null ids come last.  Rows that repeat an id and its text are one document, of
    which one row stays; rows without a word are no one's duplicates but their own.
    """
    found = near_duplicates(docs, config, doc_id=doc_id, text=text)
    firsts = found.where("row_key = first").groupBy("row_key").agg(F.count("*").alias("copies")).withColumnRenamed("row_key", "first")
    joined = docs.select(given(docs).alias("given"), row_key(column(doc_id), column(text)).alias("row_key")).join(firsts, F.col("row_key") == F.col("first"))
    # only rows that occur twice need a comparison
    single = joined.where("copies = 1").select("given", "row_key")
    return single.unionByName(joined.where("copies > 1").select("given", "row_key").dropDuplicates(["row_key"])).select("given.*")
