"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table, given by an
offset and a step from hashes of its name.  Shards take turns (a shard of weight w
takes w turns a round) and each claims the first free slot of its permutation,
until the table is full.  A key goes to the shard at slot hash(key) mod prime: one
lookup, nearly even loads, and few keys move when a shard joins or leaves.

The table has `prime` rows whatever the size of the data, so its broadcast is
bounded.  Placement is a map over rows: no shuffle, and a hot key costs nothing
more.  Rows that repeat a key go together; `keys` may name more columns where one
key holds too many rows for a shard.

Edge cases: nulls in a key are a value of their own; an empty table gives an empty
result; other columns pass through, unless they have a result's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, given

PRIME = 65537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: Mapping[str, int], prime: int = PRIME) -> list[int]:
    """The shard's position (in `shards`) for each slot."""
    names = list(shards)
    if not names or any(w < 1 for w in shards.values()):
        raise ValueError("every shard needs a weight of 1 or more")
    if prime < 2 or any(prime % d == 0 for d in range(2, int(prime**0.5) + 1)):
        raise ValueError(f"{prime} is no prime")
    place = [_number(n, "offset") % prime for n in names]
    step = [_number(n, "step") % (prime - 1) + 1 for n in names] if prime > 2 else [1] * len(names)
    table, free = [-1] * prime, prime
    while free:
        for shard, name in enumerate(names):
            for _ in range(min(shards[name], free)):
                while table[place[shard]] >= 0:
                    place[shard] = (place[shard] + step[shard]) % prime
                table[place[shard]] = shard
                free -= 1
    return table


def slot(keys: Sequence[Column], prime: int = PRIME) -> Column:
    """A stable slot of the key columns, from their text; the same in every run and Spark release."""
    parts = [F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys]
    sized = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
    return (F.conv(F.substring(F.md5(F.concat(*sized).cast("binary")), 1, 15), 16, 10).cast("bigint") % prime).cast("int")


def assign_shards(docs: DataFrame, shards: Mapping[str, int] | int, *, keys: Sequence[str] = ("doc_id",), prime: int = PRIME) -> DataFrame:
    """`docs` with `slot` and `shard` (the shard's name)."""
    if isinstance(shards, int):
        shards = {f"shard-{n:05d}": 1 for n in range(shards)}
    names = list(shards)
    table = docs.sparkSession.createDataFrame([(i, names[t]) for i, t in enumerate(fill_table(shards, prime))], "s int, shard string")
    placed = docs.select(given(docs, "slot", "shard").alias("given"), slot([column(k) for k in keys], prime).alias("slot"))
    # `prime` rows whatever the input
    return placed.join(F.broadcast(table), F.col("slot") == F.col("s"), "left").select("given.*", "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: Mapping[str, int] | int, *, keys: Sequence[str] = ("doc_id",), prime: int = PRIME, files_per_shard: int = 1) -> None:
    """Write one folder for each shard; slots spread a shard's rows over `files_per_shard` files."""
    placed = assign_shards(docs, shards, keys=keys, prime=prime)
    n = shards if isinstance(shards, int) else len(shards)
    (part,) = fresh(placed.columns, "part")
    spread = placed.withColumn(part, F.pmod(F.xxhash64("slot"), F.lit(files_per_shard)))
    spread.repartition(n * files_per_shard, "shard", part).drop(part).write.mode("overwrite").partitionBy("shard").parquet(path)
