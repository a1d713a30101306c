"""Quality rules: base counts, then the divergence of a document's histograms from its language.

For each document two histograms are taken from its whole text: one of character
classes and one of common words of the four reference languages.  The references
are the summed histograms of all documents of a language (documents of other or
unknown languages pool into one more reference).  A document diverges when the
Jensen-Shannon distance (base 2, so 0 to 1) between its histogram and the
reference exceeds a limit.  Histograms of short documents say little, so each
comparison has a minimum length below which it doesn't count.

The word distance has a second limit, from the spread of the distances themselves:
within a reference, documents of similar length (a factor of two) differ from it
about equally, and one that stands out by `word_spread` robust deviations above
their median diverges.  Texts that repeat exactly count once in the spread, and it
is no less than what drawing so few words brings.

Edge cases: a null or empty text has no words and fails the base rule; a null or
unknown language is held against the pooled reference; with no reference mass a
comparison doesn't count; repeated rows give repeated results; an empty table
gives an empty result.  Other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, given
from .textkernel import Chunk, chunks, lower_ascii, mix64, span_hashes, window_hashes

# Frequent function words of the reference languages.
COMMON_WORDS = {
    "en": "a and are as at be by for from had he her his in is it not of on or that the this to was were which with you".split(),
    "de": "auch auf das dem den der des die ein eine für ist im in mit nicht sich sie und von zu".split(),
    "fr": "au avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une".split(),
    "es": "al como con de del el en es la las lo los más no para por que se su un una y".split(),
}

#: Character classes, in the order of the histogram.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "wide")
SYMBOLS = b"#*$%&|<>"

WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
_SLOT_OF = np.full(256, CLASSES.index("other_ascii"), dtype=np.int64)
for _class, _bytes in (
    ("lower", bytes(range(97, 123))),
    ("upper", bytes(range(65, 91))),
    ("digit", bytes(range(48, 58))),
    ("space", bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])),
    ("stop", b".,;:?!'\"()-"),
    ("symbol", SYMBOLS),
    ("wide", bytes(range(0xC0, 0x100))),
):
    _SLOT_OF[list(_bytes)] = CLASSES.index(_class)
_SLOT_OF[0x80:0xC0] = len(CLASSES)  # continuation bytes: no character of their own


@dataclass(frozen=True)
class QualityConfig:
    """Limits; the distances lie well above those of ordinary prose of a language."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    class_distance: float = 0.33
    word_distance: float = 0.47
    min_class_chars: int = 200
    min_hist_words: int = 60
    word_spread: float = 3.5
    min_spread_docs: int = 30


_FEATURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,classes:array<bigint>,words:array<bigint>>"


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans of up to 8 bytes as integers, 0 for longer ones."""
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(8):
        out |= np.where(k < sizes, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
    return np.where(sizes <= 8, out, np.uint64(0))


def _word_keys() -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([int.from_bytes(w.encode(), "little") for w in WORDS], dtype=np.uint64)
    order = np.argsort(keys)
    return keys[order], order


def _repeated_words(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """For each row, the words inside windows that occur in it twice or more, first occurrences included."""
    windows = window_hashes(words, width)
    if not len(windows):
        return np.zeros(n_rows, dtype=np.int64)
    whole = np.flatnonzero(rows[: len(windows)] == rows[width - 1 :])
    own = windows[whole] ^ mix64(rows[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(own)
    ranked = own[order]
    same = np.zeros(len(ranked) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    again = whole[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[: len(words)] += np.bincount(again, minlength=len(words))
    edge += np.bincount(again + width, minlength=len(words) + 1)[: len(words) + 1] * -1
    return np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n_rows)


def _duplicate_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
    return again


def measure(chunk: Chunk, window: int, keys: np.ndarray, slots: np.ndarray) -> tuple:
    """The features of a chunk's rows: five counts, and two histograms with a row of bins each."""
    n, data = chunk.rows, chunk.data
    starts, ends, rows = chunk.words()
    n_class, n_word = len(CLASSES), len(WORDS) + 1
    owner = np.repeat(np.arange(n), chunk.ends - chunk.starts + 1)
    classes = np.bincount(_SLOT_OF[data] + owner * (n_class + 1), minlength=n * (n_class + 1)).reshape(n, n_class + 1)[:, :n_class]
    classes[:, CLASSES.index("space")] -= 1  # the line feed after each text
    n_words = np.bincount(rows, minlength=n)
    word_chars = classes.sum(axis=1) - classes[:, CLASSES.index("space")]
    repeated = _repeated_words(span_hashes(data, starts, ends), rows, n, window)
    # a full stop or comma after a common word isn't part of it
    last = data[ends - 1]
    cut = np.where(((last == 0x2E) | (last == 0x2C)) & (ends - starts > 1), ends - 1, ends)
    packed = _packed(lower_ascii(data), starts, cut)
    at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
    slot = np.where(keys[at] == packed, slots[at], n_word - 1)
    words = np.bincount(slot + rows * n_word, minlength=n * n_word).reshape(n, n_word)
    lines = np.array([_duplicate_lines(data[a:b].tobytes()) for a, b in zip(chunk.starts, chunk.ends)], dtype=np.int64)
    return n_words, word_chars, classes[:, CLASSES.index("symbol")], lines, repeated, classes, words


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "words"]


def features(text: Column, window: int = 5) -> Column:
    """A struct column of the counts and histograms of each whole text."""

    @F.arrow_udf(_FEATURES)
    def kernel(column: pa.Array) -> pa.Array:
        keys, slots = _word_keys()
        parts = [measure(chunk, window, keys, slots) for chunk in chunks(column)]
        arrays = []
        for k in range(len(_FIELDS)):
            values = np.concatenate([p[k] for p in parts]) if parts else np.zeros((0, 1), dtype=np.int64)
            flat = pa.array(values.ravel().astype(np.int64))
            width = values.shape[1] if values.ndim == 2 else 0
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), flat) if k > 4 else flat)
        return pa.StructArray.from_arrays(arrays, _FIELDS)

    return kernel.asNondeterministic()(text)


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(""))


def language_references(docs: DataFrame, config: QualityConfig | None = None, *, text: str = "text", lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Class and word shares for each reference language and for the pool of the others ("").

    Sums over every document that is long enough; the result is one row for each of
    the fixed reference languages, whatever the size of the table.
    """
    config = config or QualityConfig()
    n_class, n_word = len(CLASSES), len(WORDS) + 1
    measured = docs.select(_language(column(lang)).alias("k"), features(column(text), config.window).alias("f")).where(F.col("f.n_words") >= config.min_hist_words)
    sums = [F.sum(F.col("f.classes")[i]).alias(f"c{i}") for i in range(n_class)] + [F.sum(F.col("f.words")[i]).alias(f"w{i}") for i in range(n_word)]
    rows = measured.groupBy("k").agg(*sums).collect()
    totals = {r["k"]: np.array(r[1:], dtype=np.float64) for r in rows}
    totals[""] = sum(totals.values(), np.zeros(n_class + n_word))
    shares = lambda x: (x / x.sum() if x.sum() else x).tolist()
    return {k: (shares(v[:n_class]), shares(v[n_class:])) for k, v in totals.items()}


def _distance(counts: Column, reference: Column, mass: Column) -> Column:
    """Jensen-Shannon distance (base 2) between counts and reference shares; null without mass."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(counts, reference, lambda c, q: part(c / mass, (c / mass + q) / 2) + part(q, (c / mass + q) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when((mass > 0) & (F.aggregate(reference, F.lit(0.0), lambda a, x: a + x) > 0), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def _length_class(n_words: Column, config: QualityConfig) -> Column:
    """0 from min_hist_words words on, 1 from twice as many, and so on."""
    return F.floor(F.log2(n_words / config.min_hist_words)).cast("int")


def _spread_limit(counts: np.ndarray, n_words: float, config: QualityConfig) -> float | None:
    """Median plus robust deviations of a histogram of distances; None of too few texts."""
    if counts.sum() < config.min_spread_docs:
        return None
    values = (np.arange(len(counts)) + 0.5) / (len(counts) - 1)
    middle = lambda x, c: x[np.searchsorted(np.cumsum(c), c.sum() / 2)]
    median = middle(values, counts)
    order = np.argsort(np.abs(values - median), kind="stable")
    deviation = 1.4826 * middle(np.abs(values - median)[order], counts[order])
    # a distance between n words' shares and those they are drawn from deviates by 0.3 / sqrt(n)
    return float(median + config.word_spread * max(deviation, 0.3 / n_words**0.5))


def _reference_of(key: Column, references: dict, which: int) -> Column:
    return F.coalesce(
        *[F.when(key == k, F.array(*map(F.lit, v[which]))) for k, v in sorted(references.items()) if k and sum(v[which])],
        F.array(*map(F.lit, references[""][which])),
    )


def word_limits(docs: DataFrame, references: dict, config: QualityConfig | None = None, *, text: str = "text", lang: str = "lang") -> dict[tuple[str, int], float]:
    """The limit of the word distance by reference and length class, where there are enough texts.

    A class of too few texts takes the limit of the next shorter one of its reference.
    Shuffles a few numbers for each document; the result is a histogram of 1,001
    bins for each reference and length class, whatever the size of the table.
    """
    config = config or QualityConfig()
    bins = 1000
    measured = docs.select(_language(column(lang)).alias("k"), F.xxhash64(column(text)).alias("text_hash"), features(column(text), config.window).alias("f")).where(F.col("f.n_words") >= config.min_hist_words)
    distance = _distance(F.col("f.words"), _reference_of(F.col("k"), references, 1), F.col("f.n_words"))
    placed = measured.select("k", _length_class(F.col("f.n_words"), config).alias("z"), F.floor(distance * bins).cast("int").alias("bin"), "text_hash").where("bin is not null").distinct()
    histograms: dict[tuple[str, int], np.ndarray] = {}
    for k, z, at, n in placed.groupBy("k", "z", "bin").agg(F.count("*").alias("n")).collect():
        histograms.setdefault((k, z), np.zeros(bins + 1, dtype=np.int64))[at] += n
    limits: dict[tuple[str, int], float] = {}
    for k, z in sorted(histograms):
        limit = _spread_limit(histograms[k, z], config.min_hist_words * 2.0**z, config)
        shorter = [limits[k, y] for y in range(z) if (k, y) in limits]
        if limit is not None or shorter:
            limits[k, z] = limit if limit is not None else shorter[-1]
    return limits


def quality_rules(docs: DataFrame, config: QualityConfig | None = None, references: dict | None = None, *, text: str = "text", lang: str = "lang", result: str = "quality") -> DataFrame:
    """`docs` with a struct column `result`: the base counts, base_failed, both distances, kept.

    No shuffle but the sums of the references and the histograms of the spread; every
    row is judged on its own text.
    A distance is null where its guard says the document is too short.
    """
    config = config or QualityConfig()
    references = references or language_references(docs, config, text=text, lang=lang)
    limits = word_limits(docs, references, config, text=text, lang=lang)
    lookup = lambda which: _reference_of(F.col("k"), references, which)
    counts = F.col("f")
    n_words, repeated = counts["n_words"], counts["n_repeat_words"]
    chars = F.aggregate(counts["classes"], F.lit(0).cast("bigint"), lambda a, x: a + x)
    by_class = F.when(chars >= config.min_class_chars, _distance(counts["classes"], lookup(0), chars))
    by_word = F.when(n_words >= config.min_hist_words, _distance(counts["words"], lookup(1), n_words))
    failed = (n_words < config.min_words) | (100 * repeated > config.max_repeat_percent * n_words)
    judged = docs.select(given(docs, result).alias("given"), features(column(text), config.window).alias("f"), _language(column(lang)).alias("k"))
    with_distances = judged.withColumns({"f": F.struct("f.*", failed.alias("base_failed"), by_class.alias("class_distance"), by_word.alias("word_distance"))})
    length = _length_class(counts["n_words"], config)
    by_spread = F.coalesce(*[F.when((F.col("k") == k) & (length == z), F.lit(x)) for (k, z), x in limits.items()], F.lit(config.word_distance))
    word_limit = F.least(by_spread, F.lit(config.word_distance))
    verdict = ~counts["base_failed"] & (F.coalesce(counts["class_distance"], F.lit(0.0)) <= config.class_distance) & (F.coalesce(counts["word_distance"], F.lit(0.0)) <= word_limit)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance")
    return with_distances.select("given.*", F.struct(*[counts[b].alias(b) for b in base], verdict.alias("kept")).alias(result))
