"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its share of a budget, by weight, but no more than
`most_epochs` times its size; what is over is shared again among the others until
none is above.  Whole epochs of a source are taken by multiplication.  For the
rest of its target each document gets a 60-bit hash of its id: sizes are summed by
source and leading hash bits, the bucket where the running sum passes the rest is
the boundary, and only documents of boundary buckets are looked at again, by the
next bits, until a boundary holds one hash.  A document below the threshold is
taken once more, the boundary's documents if that comes nearer to the target.
Nothing is sorted but at most 1024 sums for each source.  Smaller budgets choose
subsets of larger ones, as the hash order is fixed.

Edge cases: a null text has size 0; a null source is a source of its own, the
last; rows that repeat an id share a hash, and where they are the boundary
together the words that are left are dealt evenly among them; null ids likewise;
sizes of 0 are taken 0 times; an empty table gives an empty result.  Other
columns of any name pass through, unless they have a result's name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, durable, given, small, thin

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    weights: Sequence[int] = (3, 1, 2)
    budget_percent: int = 150
    most_epochs: int = 2
    seed: int = 11
    bits_per_level: int = 10
    levels: int = 6


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash60(doc_id: Column, seed: int) -> Column:
    """A 60-bit hash of the seed and the id as text; md5, so that SQL elsewhere can repeat it."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """(source, source_size, target) from (source, size); one row for each source."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    # From here on there is one row for each source, as in the definition of the mix itself.
    weight = F.element_at(F.array(*map(F.lit, config.weights)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(config.weights) + 1).cast("int"))
    ranked = totals.withColumn("w", weight.cast("bigint"))
    cap = F.col("source_size") * config.most_epochs
    # A source is capped where its cap is below the level that caps of smaller ratio leave for its weight.
    everyone, before = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("ratio", "source").rowsBetween(W.unboundedPreceding, -1)
    with_ratio = ranked.withColumns({"cap": cap, "ratio": cap / F.col("w")})
    summed = with_ratio.withColumns({
        "all": F.sum("source_size").over(everyone), "all_w": F.sum("w").over(everyone),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    left = (F.col("all") * config.budget_percent).cast("double") / 100.0 - F.col("cap_before")
    capped = F.col("cap").cast("double") * (F.col("all_w") - F.col("w_before")) < left * F.col("w")
    marked = summed.withColumn("capped", capped)
    over = marked.withColumns({"cap_sum": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0)), "w_sum": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))).over(everyone), F.lit(0))})
    share = ((F.col("all") * config.budget_percent).cast("double") / 100.0 - F.col("cap_sum")) * F.col("w") / F.col("w_sum")
    return over.select("source", "source_size", F.when(F.col("capped") | (F.col("w_sum") == 0), F.col("cap").cast("double")).otherwise(F.least(share, F.col("cap").cast("double"))).alias("target"))


def _thresholds(rows: DataFrame, targets: DataFrame, config: MixConfig) -> DataFrame:
    """(source, epochs, cut, edge): hashes up to `cut` are taken once more; `edge` words for each row at cut + 1.

    Level by level, with `rows` as (source, size, h).  A level's histogram covers
    only documents in the boundary bucket of their source.
    """
    step, top = config.bits_per_level, config.bits_per_level * config.levels
    goal = targets.select("source", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("epochs"), "source_size", "target")
    open_ = goal.select("source", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"), F.lit(0).cast("bigint").alias("prefix"))
    for level in range(config.levels):
        down = top - step * (level + 1)
        inside = rows if not level else rows.join(open_.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", down + step) == F.col("prefix"))).select("source", "size", "h")
        histogram = inside.groupBy("source", F.shiftright("h", down).alias("bucket")).agg(F.sum("size").cast("bigint").alias("words"), F.count("*").alias("n"))
        running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        placed = histogram.withColumn("below", F.coalesce(F.sum("words").over(running), F.lit(0)))
        # the boundary: the bucket where the running sum comes to exceed the rest; none where the rest is everything
        edge = placed.join(open_.select(F.col("source").alias("s"), "epochs", "rest"), F.col("source").eqNullSafe(F.col("s"))).where((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("words") > F.col("rest")))
        open_ = edge.select("source", "epochs", (F.col("rest") - F.col("below")).alias("rest"), F.col("bucket").alias("prefix"), "words", "n")
        if level + 1 < config.levels:
            open_ = durable(thin(open_))  # a row for each source
    at_edge = F.when(F.col("n") > 1, F.floor(F.col("rest") / F.col("n"))).when(2 * F.col("rest") >= F.col("words"), F.col("words")).otherwise(0)
    cuts = open_.select(F.col("source").alias("s"), (F.col("prefix") - 1).alias("cut"), at_edge.cast("bigint").alias("edge"))
    # a source without a boundary has no rest, so no hash is below its cut
    return goal.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "epochs", F.coalesce("cut", F.lit(-1)).cast("bigint").alias("cut"), F.coalesce("edge", F.lit(0)).cast("bigint").alias("edge"))


def mix(docs: DataFrame, config: MixConfig | None = None, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` with size, source_size, target and taken: the words that the mix takes of each row, repeats counted.

    Reads the texts once for the histograms and once for the result.  The joins
    bring one row for each source: broadcast where they are counted to be few, as
    sources are, and else shuffled with splits of hot sources (adaptive skew join).
    """
    config = config or MixConfig()
    told = docs.select(given(docs, "size", "source_size", "target", "taken").alias("given"), column(source).alias("source"), size_in_words(column(text)).alias("size"), hash60(column(doc_id), config.seed).alias("h"))
    rows = durable(told.select("source", "size", "h"))
    targets = durable(thin(source_targets(rows, config)))
    cuts = _thresholds(rows, targets, config)
    plan = targets.join(cuts.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))).select(F.col("source").alias("s"), "source_size", "target", "epochs", "cut", "edge")
    joined = told.join(small(durable(thin(plan))), F.col("source").eqNullSafe(F.col("s")))
    more = F.when(F.col("h") <= F.col("cut"), F.col("size")).when(F.col("h") == F.col("cut") + 1, F.least("edge", "size")).otherwise(0)
    return joined.select("given.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("bigint").alias("taken"))


def oracle_sql(config: MixConfig | None = None) -> str:
    """The same over `documents` in DuckDB SQL, with a sort in place of the histograms."""
    config = config or MixConfig()
    weights = ", ".join(map(str, config.weights))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5('{config.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([{weights}])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(config.weights)}) + 1]::BIGINT AS w, source_size * {config.most_epochs} AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
  coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(w) OVER b, 0)::BIGINT AS w_before
  FROM r WINDOW b AS (ORDER BY cap::DOUBLE / w, source ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap::DOUBLE * (all_w - w_before) < ((total * {config.budget_percent})::DOUBLE / 100::DOUBLE - cap_before) * w AS capped FROM o),
u AS (SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0)::BIGINT AS cap_sum, coalesce(sum(w) FILTER (NOT capped) OVER (), 0)::BIGINT AS w_sum FROM c),
t AS (SELECT source, source_size, CASE WHEN capped OR w_sum = 0 THEN cap::DOUBLE
  ELSE least(((total * {config.budget_percent})::DOUBLE / 100::DOUBLE - cap_sum) * w / w_sum, cap::DOUBLE) END AS target FROM u),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
j AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(size) OVER (PARTITION BY d.source, h) AS same, count(*) OVER (PARTITION BY d.source, h) AS n
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - same > rest THEN 0
  WHEN n > 1 THEN least(floor((rest - (upto - same)) / n)::BIGINT, size) WHEN 2 * (rest - (upto - same)) >= same THEN size ELSE 0 END)::BIGINT AS taken FROM j"""
