"""Line dedup: fuzzy copies of lines across all documents, by MinHash.

Lines are what \\n separates.  They are compared with A-Z lower-cased, runs of
ASCII white space as one space, and none at the ends.  A line's set is its distinct
character shingles; a line of fewer characters is its own only shingle.  Equal
lines (by a 128-bit digest of the compared form) are one unit; units of four
shingles or more are bucketed by bands of their signatures (with fewer, similarity
0.8 means equal sets, and so equal lines unless a line repeats itself), candidates
are verified by exact Jaccard similarity of the full sets, and a distributed
union-find joins links to components.  Of each component only one line stays: the
first by doc_id, then by place in the document.

Lines without a word are never compared and always stay; any other line, however
short, is compared.  A document keeps its other lines in order.

Edge cases: a null text stays null, an empty text empty; null ids come after all
others; rows that repeat an id and its text are one document and keep the same
lines; an empty table gives an empty result.  Other columns of any name pass
through, unless they have a result's name.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, durable, given, release, row_key, small, thin
from .links import bucket_members, linked_components
from .minhash import Bands, band_keys, signatures
from .textkernel import lower_ascii, mix64, span_hashes, utf8_views


@dataclass(frozen=True)
class LineConfig:
    width: int = 8
    percent: int = 80
    bands: Bands = Bands(12, 4)
    min_words: int = 1
    least_shingles: int = 4


#: Texts with none of these have one space between words, if not at the ends of lines.
_UNEVEN = (b"  ", b"\t", b"\v", b"\f", b"\r")


def _compared_lines(view: np.ndarray, min_words: int) -> tuple[list[int], list[bytes]]:
    """Places and compared forms of a text's lines that have enough words."""
    text = lower_ascii(view).tobytes()
    if any(mark in text for mark in _UNEVEN):
        forms = [b" ".join(line.split()) for line in text.split(b"\n")]
    else:
        forms = [line.strip(b" ") for line in text.split(b"\n")]
    places = [place for place, form in enumerate(forms) if form and (min_words < 2 or form.count(b" ") + 1 >= min_words)]
    return places, [forms[place] for place in places]


def _may_link(form: bytes, config: LineConfig) -> bool:
    """Whether another line than an equal one can be similar: always from `least_shingles` shingles on.

    Fewer shingles have to be the same set.  Two lines of one such set go around a cycle
    of its shingles, so that a window repeats itself within fewer characters than there
    are shingles; all other characters are outside of that window.
    """
    if len(form) >= config.width + config.least_shingles - 1:  # bytes, so characters or more
        return True
    return len(form) >= config.width and len(set(form.decode("utf-8", "replace"))) <= 2 * config.least_shingles - 3


def _form_chunks(forms: list[bytes], limit: int = 1 << 18):
    """(bytes, starts, ends) of consecutive forms, a line feed after each."""
    at = 0
    while at < len(forms):
        size, to = 0, at
        while to < len(forms) and (to == at or size + len(forms[to]) < limit):
            size += len(forms[to]) + 1
            to += 1
        data = np.frombuffer(b"\n".join([*forms[at:to], b""]), dtype=np.uint8)
        ends = np.cumsum([len(f) + 1 for f in forms[at:to]]) - 1
        yield data, np.concatenate([[0], ends[:-1] + 1]), ends
        at = to


#: Codes of the characters below U+3000; others are mixed one by one.
_CODES = mix64(np.arange(1, 0x3001, dtype=np.uint64))


def _windows(code: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every `width` consecutive codes, from windows of half the width."""
    if width == 1:
        return code
    half = width // 2
    part = _windows(code, half)
    out = part[: len(part) - half] * np.uint64(pow(0x9E3779B97F4A7C15, half, 1 << 64)) + part[half:]
    return out if width == 2 * half else out[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[width - 1 :]


def _char_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of each form, with repeats and form by form, and how many each has."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    stops = np.flatnonzero(points == 0x0A)
    sizes = np.diff(stops, prepend=-1) - 1
    code = _CODES[points] if len(points) and points.max() < len(_CODES) else mix64(points.astype(np.uint64) + np.uint64(1))
    counts = np.maximum(sizes - width + 1, 0)
    short = np.flatnonzero(counts == 0)
    hashes = np.zeros(0, dtype=np.uint64)
    if len(points) >= width:
        windows = _windows(code, width)
        inside = np.ones(len(points), dtype=bool)
        for k in range(width):
            inside[np.maximum(stops - k, 0)] = False  # a form's end would be within
        if sizes[0] >= width:
            inside[0] = True
        hashes = windows[inside[: len(windows)]]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xFF51AFD7ED558CCD)
        hashes ^= hashes >> np.uint64(29)
    # shorter forms are their own only shingle
    hashes = np.insert(hashes, np.cumsum(counts)[short], span_hashes(data, starts[short], ends[short]))
    counts[short] = 1
    return hashes, counts


def _coded_lines(text: Column, config: LineConfig) -> Column:
    """struct(places, h1, h2, banded, keys): what is compared of each text.

    places, h1 and h2 have an item for each compared line; `banded` has the positions
    among them of lines that may link to others, and `keys` their band keys, one
    after the other.  Lines that a batch has had already say nothing new there.
    """
    shape = config.bands

    @F.arrow_udf("struct<places:array<int>,h1:array<bigint>,h2:array<bigint>,banded:array<int>,keys:array<bigint>>")
    def kernel(column: pa.Array) -> pa.Array:
        places, digests, banded, forms, known = [], [], [], [], set()
        n_lines, n_banded = [0], [0]
        for view in utf8_views(column):
            own_places, own = _compared_lines(view, config.min_words)
            for at, form in enumerate(own):
                digest = blake2b(form, digest_size=16).digest()
                digests.append(digest)
                if _may_link(form, config) and digest not in known:
                    known.add(digest)
                    banded.append(at)
                    forms.append(form)
            places += own_places
            n_lines.append(len(places))
            n_banded.append(len(banded))
        keys = [np.zeros((0, shape.bands), dtype=np.int64)]
        for data, starts, ends in _form_chunks(forms):
            hashes, counts = _char_shingles(data, starts, ends, config.width)
            keys.append(band_keys(signatures(hashes, np.repeat(np.arange(len(counts)), counts), len(counts), shape.bins), shape))
        table = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), values)
        columns = [lists(n_lines, pa.array(places, pa.int32())), *(lists(n_lines, pa.array(np.ascontiguousarray(table[:, k]))) for k in range(2)), lists(n_banded, pa.array(banded, pa.int32()))]
        columns.append(lists(np.array(n_banded) * shape.bands, pa.array(np.concatenate(keys).ravel())))
        return pa.StructArray.from_arrays(columns, ["places", "h1", "h2", "banded", "keys"])

    return kernel.asNondeterministic()(text)


def _line_forms(text: Column, places: Column, config: LineConfig) -> Column:
    """The compared forms of the lines of each text at `places`."""

    @F.arrow_udf("array<string>")
    def kernel(column: pa.Array, wanted: pa.Array) -> pa.Array:
        forms, counts = [], [0]
        for view, some in zip(utf8_views(column), wanted.to_pylist()):
            lines = lower_ascii(view).tobytes().split(b"\n")
            forms += [b" ".join(lines[p].split()) for p in some]
            counts.append(len(forms))
        return pa.ListArray.from_arrays(pa.array(np.array(counts, dtype=np.int32)), pa.array(forms, pa.binary()).cast(pa.string()))

    return kernel.asNondeterministic()(text, places)


def _form_sets(items: pa.Array, width: int) -> list[np.ndarray]:
    """The character shingle set of each compared form, as sorted hashes."""
    out: list[np.ndarray] = []
    for data, starts, ends in _form_chunks([v.tobytes() for v in utf8_views(items)]):
        hashes, counts = _char_shingles(data, starts, ends, width)
        to = 0
        for count in counts.tolist():
            own = np.sort(hashes[to : to + count])
            to += count
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out


def _line_components(coded: DataFrame, texts: DataFrame, config: LineConfig) -> DataFrame:
    """(h1, h2, comp) for the distinct lines that have a link to a different line."""
    n, spark = config.bands.bands, coded.sparkSession
    names = [f"k{i}" for i in range(n)]
    banded = coded.select("row", "h1", "h2", "places", "keys", F.posexplode("banded").alias("j", "at"))
    banded = banded.select(F.get("h1", "at").alias("h1"), F.get("h2", "at").alias("h2"), "row", F.get("places", "at").alias("place"), *[F.get("keys", F.col("j") * n + i).alias(k) for i, k in enumerate(names)])
    # equal lines have equal keys: one row for each line before rows are dealt by key
    units = banded.groupBy("h1", "h2").agg(F.first("row").alias("row"), F.first("place").alias("place"), *[F.min(k).alias(k) for k in names])
    units = durable(units.withColumn("node", F.monotonically_increasing_id()))
    release(spark)
    members = durable(bucket_members(units.select("node", F.explode(F.array(*names)).alias("key"))))
    release(spark)
    nodes = members.select(F.col("node").alias("x"))
    met = durable(thin(units.select("node", "row", "place", "h1", "h2").join(small(nodes), F.col("node") == F.col("x"), "left_semi")))
    discard(units)
    wanted = met.groupBy("row").agg(F.collect_list(F.struct("node", "place")).alias("lines")).withColumnRenamed("row", "r")
    wanted = durable(thin(coded.select("row", "row_key").join(wanted, F.col("row") == F.col("r")).select(F.col("row_key").alias("wanted"), "lines")))
    # rows that repeat an id and its text share a row_key, and any of them will do
    found = texts.join(small(wanted, "lines"), F.col("row_key") == F.col("wanted")).select("lines", _line_forms(F.col("text"), F.col("lines.place"), config).alias("items"))
    forms = found.select(F.explode(F.arrays_zip(F.col("lines.node").alias("node"), "items")).alias("s")).select("s.node", "s.items")
    repeated = not coded.groupBy("row_key").count().where("count > 1").isEmpty()
    forms = durable(forms.dropDuplicates(["node"]) if repeated else forms)
    release(spark)
    labels = linked_components(members, forms, config.percent, lambda items: _form_sets(items, config.width))
    found = durable(thin(met.select("h1", "h2", "node").join(labels.withColumnRenamed("node", "x"), F.col("node") == F.col("x")).select("h1", "h2", "comp")))
    discard(met, members, forms, wanted)
    return found


def _without(text: Column, places: Column) -> Column:
    """The text without the lines at `places` (null: none)."""

    @F.arrow_udf("string")
    def kernel(column: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for row, some in zip(column, gone):
            if some.is_valid:
                lines = row.as_buffer().to_pybytes().split(b"\n")
                away = set(some.values.to_pylist())
                out.append(b"\n".join([line for place, line in enumerate(lines) if place not in away]))
            else:
                out.append(row.as_buffer().to_pybytes() if row.is_valid else None)
        return pa.array(out, pa.binary()).cast(pa.string())

    return kernel.asNondeterministic()(text, places)


def dedup_lines(docs: DataFrame, config: LineConfig | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `text` cut to the lines that stay, n_lines (before) and n_removed.

    One pass of Python codes all lines; a second looks at those in buckets only.  A
    hot line (in a third of all documents, say) is summed up by partial aggregates;
    the join back by line splits it (adaptive skew join).
    """
    config = config or LineConfig()
    texts = docs.select(column(text).alias("text"), row_key(column(doc_id), column(text)).alias("row_key"))
    coded = docs.select(column(doc_id).alias("d"), row_key(column(doc_id), column(text)).alias("row_key"), F.monotonically_increasing_id().alias("row"), _coded_lines(column(text), config).alias("c")).select("d", "row_key", "row", "c.*")
    coded = durable(coded)
    comps = _line_components(coded, texts, config)
    lines = coded.select("d", "row_key", "places", "h1", "h2", F.posexplode("places").alias("i", "place"))
    lines = lines.select("d", "row_key", "place", F.get("h1", "i").alias("h1"), F.get("h2", "i").alias("h2"))
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    linked = comps.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "comp")
    # a component is named by its number, or by its only line's digest; lines that stand alone are settled
    repeated = counted.join(linked, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").where("n > 1 or comp is not null")
    repeated = durable(thin(repeated).select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.coalesce("comp", "h1").alias("c1"), F.when(F.col("comp").isNull(), F.col("h2")).alias("c2")))
    copies = durable(lines.join(repeated, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))).select("d", "row_key", "place", "c1", "c2"))
    discard(coded, repeated)
    # the first line of each component; of rows that repeat an id and its text, each keeps it
    stay = copies.groupBy("c1", "c2").agg(F.min(F.struct(F.isnull("d"), "d", "place", "row_key")).alias("s")).select(F.col("s.row_key").alias("k"), F.col("s.place").alias("p"))
    gone = copies.join(stay, (F.col("row_key") == F.col("k")) & (F.col("place") == F.col("p")), "left_anti")
    by_doc = gone.groupBy("row_key").agg(F.collect_set("place").alias("gone")).withColumnRenamed("row_key", "k")
    whole = docs.select(given(docs, "n_lines", "n_removed", text).alias("given"), column(text).alias("text"), row_key(column(doc_id), column(text)).alias("row_key"))
    joined = whole.join(by_doc, F.col("row_key") == F.col("k"), "left")
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(breaks + 1, F.lit(0)).cast("bigint")
    cut = joined.select("given", _without(F.col("text"), F.col("gone")).alias("left"), n_lines.alias("n"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("away"))
    return cut.select("given.*", F.col("left").alias(text), F.col("n").alias("n_lines"), F.col("away").alias("n_removed"))
