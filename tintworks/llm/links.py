"""Links between units that share buckets, and their connected components, without all-pairs joins.

Candidates are star-shaped: a bucket's centre is its most central unit (the one
with the largest buckets, as the original of a group of copies has), and each unit
is held against the centres of its buckets.  What remains are pairs of units x, y
that share a centre c; where both are linked with c they are of one component.

With D(x) for the elements that only one of x and c has, x and y differ in the
elements that only one of D(x) and D(y) has.  At a similarity of p percent,
(100 + p) * |x differs y| <= (100 - p) * (|x| + |y|), so a link needs

    2 * (100 + p) * |D(x) & D(y)|  >=  e(x) + e(y),   e(x) = (100 + p) * |D(x)| - (100 - p) * |x|,

and the right side is above 0 where x or y is not linked with c.  (If y isn't,
(100 + p) * |D(y)| > (100 - p) * (|y| + |c|), and |D(x)| >= ||x| - |c||, so the sum
exceeds (100 + p) * |D(x)| + (100 - p) * (|c| - |x|) >= 0.)  Hence the two share an
element of their differences.  These are few beside a near centre, and a prefix
filter finds the pairs: two units with so many common elements have one among the
first of each D, in any order that all of a star keep to, and only those are joined.
In stars of more than MANY units the order is by how many of them have an element,
the rarest first, so that what many copies have comes last and joins none of them.
In smaller ones, where a unit has few partners anyway, what x has besides c comes
first, then what it lacks of c, each by hash; so only the first have to be told.

So every two members of a bucket are joined already, compared, or excluded by their
bound: no link is lost, and pairs don't grow with the square of a group of copies.
A distributed union-find joins the links that are confirmed to components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, durable, thin


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of (a, b) edges; comp is its component's smallest node.

    Alternates large-star and small-star steps, each a partial aggregation and a
    join, until the edges are stars around their smallest nodes.
    """
    now = durable(thin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.sum(F.when(F.col("b") < F.col("a"), 1).otherwise(0)).alias("below"))
        # a star's leaf has one neighbour, below it; its centre none below
        if around.where("below > 1 or (below = 1 and most > a)").isEmpty():
            break
        low = around.select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["x"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        inner = large.join(least.withColumnRenamed("a", "x"), F.col("a") == F.col("x")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, durable(thin(inner.unionByName(least.select("a", F.col("m").alias("b"))).distinct()))
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def bucket_members(postings: DataFrame) -> DataFrame:
    """(node, rank, keys): the buckets with two nodes or more of each node, and their sizes' sum, from distinct (key, node).

    One shuffle by key serves the counts and the members.
    """
    dealt = postings.repartition("key")
    # both need key and node, so that Spark deals them once
    several = dealt.groupBy("key").agg(F.max("node").alias("any"), F.count("*").alias("held")).where("held > 1 and any is not null").select(F.col("key").alias("k"), "held")
    members = dealt.join(several.hint("shuffle_hash"), F.col("key") == F.col("k"))
    return members.groupBy("node").agg(F.sum("held").alias("rank"), F.collect_list("key").alias("keys"))  # a node has a key for each band


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of each node a and the other centres b of its buckets."""
    ranked = members.select("node", "rank", F.explode("keys").alias("key"))
    # the largest rank, then the smallest node of that rank
    best = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("node")).alias("back"))).alias("best")).select(F.col("key").alias("k"), (-F.col("best.back")).alias("c"))
    return durable(thin(ranked.join(best, F.col("key") == F.col("k")).where("node <> c").select(F.col("node").alias("a"), F.col("c").alias("b")).distinct()))


#: Stars of more units have their elements counted.
MANY = 16

#: Turns a column of units' items into their sets, as sorted arrays of element hashes.
Decode = Callable[[pa.Array], list[np.ndarray]]


def set_column(sets: list[np.ndarray]) -> pa.Array:
    """Sets as binary values, which `stored_sets` reads."""
    return pa.array([np.ascontiguousarray(s, dtype=np.uint64).tobytes() for s in sets], pa.binary())


def stored_sets(items: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in items]


def _paired(decode: Decode, left: pa.Array, right: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of each row's two items; a hot centre's is worked out once in a batch."""
    (xs, x_at), (ys, y_at) = ((decode(d.dictionary), d.indices.to_numpy()) for d in (left.dictionary_encode(), right.dictionary_encode()))
    return ((xs[i], ys[j]) for i, j in zip(x_at, y_at))


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y, both sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), dtype=bool)


def _measures(decode: Decode):
    """A function of two columns of items: the sizes of their sets and of the intersection."""

    @F.arrow_udf("struct<n_a:bigint,n_b:bigint,common:bigint>")
    def kernel(left: pa.Array, right: pa.Array) -> pa.Array:
        counts = [(len(x), len(y), np.count_nonzero(_inside(x, y))) for x, y in _paired(decode, left, right)]
        table = np.array(counts, dtype=np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(3)], ["n_a", "n_b", "common"])

    return kernel.asNondeterministic()


def _prefixes(decode: Decode):
    """A function of units' items, their centres' and a number: so many elements that only one has, those of the unit first."""

    @F.arrow_udf("array<bigint>")
    def kernel(left: pa.Array, right: pa.Array, sizes: pa.Array) -> pa.Array:
        first = []
        for (x, y), size in zip(_paired(decode, left, right), sizes.to_numpy()):
            own = x[~_inside(x, y)][:size]
            first.append(own if len(own) == size else np.concatenate([own, y[~_inside(y, x)][: size - len(own)]]))
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *first]).view(np.int64)))

    return kernel.asNondeterministic()


def _with_items(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b) pairs with the items of both; the side of the hot centres comes last, where adaptive splitting deals it anew."""
    a, b = units.select(F.col("node").alias("a"), F.col("items").alias("items_a")), units.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return pairs.join(a, "a").join(b, "b")


def measured(pairs: DataFrame, units: DataFrame, decode: Decode) -> DataFrame:
    """(a, b, n_a, n_b, common) of the full sets of (a, b) pairs, with (node, items) for every node."""
    return _with_items(pairs, units).select("a", "b", _measures(decode)("items_a", "items_b").alias("m")).select("a", "b", "m.*")


def is_link(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


def _open_stars(stars: DataFrame, percent: int) -> DataFrame:
    """(centre, node, group, inside, many, n, d, e, outer, mixed): the units of stars that may have more links.

    `inside` tells whether the unit is linked with the centre; units of one group
    are of one component.  Of a unit and its partner one is outside; outer and
    mixed are the least numbers of elements that their differences have in common,
    where both are and where one of them is.
    """
    w, v = 100 + percent, 100 - percent
    d, n = F.col("n_a") + F.col("n_b") - 2 * F.col("common"), F.col("n_a")
    placed = stars.select(F.col("b").alias("centre"), F.col("a").alias("node"), is_link(percent).alias("inside"), n.alias("n"), d.alias("d"), (w * d - v * n).alias("e"))
    own = placed.where("inside").groupBy("node").agg(F.min("centre").alias("first"))
    # one step further, from the centre to what it is linked with
    next_ = own.select(F.col("node").alias("y"), F.col("first").alias("second"))
    of = own.join(next_, F.col("first") == F.col("y"), "left").select(F.col("node").alias("x"), F.least("first", F.coalesce("second", "first")).alias("group"))
    placed = placed.join(of, F.col("node") == F.col("x"), "left").withColumn("group", F.coalesce("group", "node"))
    inner, outer = F.when(F.col("inside"), F.col("e")), F.when(~F.col("inside"), F.col("e"))
    least = placed.groupBy("centre").agg(F.min("group").alias("low"), F.max("group").alias("high"), (F.count("*") > MANY).alias("many"), F.min(inner).alias("m_in"), F.min(outer).alias("m_out")).where("low < high and m_out is not null").select(F.col("centre").alias("c"), "many", "m_in", "m_out")
    met = placed.join(least, F.col("centre") == F.col("c"))
    # no link differs from the unit in more than v / p of its elements, so the rest of D is common
    rest = F.col("d") - F.floor(v * F.col("n") / percent)
    need = lambda m: F.greatest(F.ceil((F.col("e") + m) / (2 * w)), rest, F.lit(1))
    needs = met.withColumns({"outer": F.when(~F.col("inside"), need(F.col("m_out"))), "mixed": F.when(F.col("inside"), need(F.col("m_out"))).when(F.col("m_in").isNotNull(), need(F.col("m_in")))})
    return needs.where("outer <= d or mixed <= d").select("centre", "node", "group", "inside", "many", "n", "d", "e", "outer", "mixed")


def _crossing_pairs(stars: DataFrame, units: DataFrame, decode: Decode, percent: int) -> DataFrame:
    """(a, b) of one star and different groups that share an element within their prefixes."""
    open_ = durable(thin(_open_stars(stars, percent)))
    if open_.isEmpty():
        return durable(open_.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    told_of = F.when(F.col("many"), F.col("d")).otherwise(F.col("d") - F.least("outer", "mixed") + 1).cast("int")
    told = _with_items(open_.withColumnsRenamed({"node": "a", "centre": "b"}), units).withColumn("elements", _prefixes(decode)("items_a", "items_b", told_of))
    told = durable(thin(told).withColumnsRenamed({"a": "node", "b": "centre"}).drop("items_a", "items_b").withColumn("unit", F.monotonically_increasing_id()))
    rest = ("unit", "centre", "node", "group", "inside", "n", "e", "outer", "mixed")
    # one number for centre and element: by chance equal ones are candidates more, not less
    key = F.xxhash64("centre", "element").alias("key")
    few = told.where("not many").select(*rest, "d", F.posexplode("elements").alias("at", "element")).select(*rest, key, (F.col("d") - F.col("at")).alias("after"))
    # elements that one group has alone join nothing: they count as if they came first
    each = told.where("many").select("centre", "unit", "group", F.explode("elements").alias("element")).select("unit", "group", key)
    counted = each.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("held")).where("low < high").select(F.col("key").alias("k"), "held")
    own = W.partitionBy("u")
    left = each.join(counted, F.col("key") == F.col("k")).select(F.col("unit").alias("u"), "key", "held")
    left = left.select("u", "key", (F.count("*").over(own) - F.row_number().over(own.orderBy("held", "key")) + 1).alias("after"))
    several = told.where("many").join(left.withColumnRenamed("u", "unit"), "unit").select(*rest, "key", "after")
    # `after` elements of the unit come from this one on
    one = few.unionByName(several).where("after >= outer or after >= mixed")
    one = durable(thin(one).select("key", "node", "group", "inside", "n", "e", "after", F.coalesce(F.col("after") >= F.col("outer"), F.lit(False)).alias("outer"), F.coalesce(F.col("after") >= F.col("mixed"), F.lit(False)).alias("mixed")))
    two = one.select(*[F.col(c).alias(f"{c}_") for c in one.columns])
    met = (F.col("key") == F.col("key_")) & (F.col("group") != F.col("group_"))
    fits = (2 * (100 + percent) * F.least("after", "after_") >= F.col("e") + F.col("e_")) & (100 * F.col("n") >= percent * F.col("n_")) & (100 * F.col("n_") >= percent * F.col("n"))
    sides = (F.col("outer") & F.col("outer_") & (F.col("node") > F.col("node_"))) | (F.col("inside") & ~F.col("inside_") & F.col("mixed") & F.col("mixed_"))
    pairs = durable(thin(one.join(two, met & fits & sides).select(F.greatest("node", "node_").alias("a"), F.least("node", "node_").alias("b")).distinct()))
    discard(open_, told, one)
    return pairs


def linked_components(members: DataFrame, units: DataFrame, percent: int, decode: Decode = stored_sets) -> DataFrame:
    """(node, comp) of the nodes with a link, from `bucket_members` and (node, items) of each.

    Both must be cut from their lineage.  A hot centre's units are split by AQE where
    items are joined; a hot element is joined only where it is within both prefixes.
    """
    pairs = star_pairs(members)
    stars = durable(thin(measured(pairs, units, decode)))
    crossing = _crossing_pairs(stars, units, decode, percent)
    tested = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = measured(crossing.join(tested, ["a", "b"], "left_anti"), units, decode)
    labels = durable(connected_components(stars.unionByName(more).where(is_link(percent)).select("a", "b")))
    discard(pairs, stars, crossing)
    return labels
