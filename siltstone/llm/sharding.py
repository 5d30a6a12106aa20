"""Permutation-filled lookup table sharding; DataFrame and SQL functions only.

Each shard orders the slots of a prime-sized table by its own permutation, (offset + k * skip)
mod size.  The shards take turns; at its turn a shard claims the first slot of its order that is
still free, until all slots are taken.  A key's slot is a hash mod the table's size, so placement
is one lookup.  Shares differ by one slot at most, and adding or removing a shard moves few keys.

The table, ``size`` rows whatever the data, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SHARDS, SIZE = 16, 2053
#: A lookup table has at most this many slots, which bounds what is broadcast.
MAX_SIZE = 16_411


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def hash32(text: str) -> str:
    """SQL: the first 32 bits of a string's MD5."""
    return f"cast(conv(substr(md5({text}), 1, 8), 16, 10) as bigint)"


def lookup_table(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """-> (slot, shard): the filled table, by a fold over the turns."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named and distinct")
    if not is_prime(size) or not len(shards) <= size <= MAX_SIZE:
        raise ValueError(f"size must be a prime of {len(shards)} to {MAX_SIZE}")
    names = F.array(*map(F.lit, shards))
    n = len(shards)
    order = (
        spark.range(1).select(names.alias("names"))
        .selectExpr(
            "names",
            f"transform(names, s -> {hash32('concat(s, chr(35), 1)')} % {size}) as base",
            f"transform(names, s -> {hash32('concat(s, chr(35), 2)')} % {size - 1} + 1) as skip",
        )
    )
    slot = f"cast((base[t % {n}] + k * skip[t % {n}]) % {size} as int)"
    full = f"filter(sequence(a.at[t % {n}], {size - 1}), k -> a.owner[{slot}] < 0)[0]"
    fold = f"""aggregate(sequence(0, {size - 1}),
        named_struct('owner', array_repeat(-1, {size}), 'at', array_repeat(0, {n})),
        (a, t) -> transform(array({full}), k -> named_struct(
            'owner', concat(slice(a.owner, 1, {slot}), array(t % {n}), slice(a.owner, {slot} + 2, {size})),
            'at', concat(slice(a.at, 1, t % {n}), array(k + 1), slice(a.at, t % {n} + 2, {n}))))[0],
        a -> a.owner)"""
    return order.selectExpr("names", f"posexplode({fold}) as (slot, own)").selectExpr("slot", "names[own] as shard")


def assign(rows: DataFrame, table: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``.  The key's string form is hashed, a null key's as that
    of a string of one NUL.  Equal keys share a shard; every row is returned; no shuffle.  Columns
    named slot or shard are replaced."""
    base = rows.drop("slot", "shard").withColumn("slot", F.expr(f"cast({hash32(f'coalesce(cast(`{key}` as string), chr(0))')} % {size} as int)"))
    return base.join(F.broadcast(table), "slot").select(*base.columns, "shard")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return assign(docs, lookup_table(spark, [f"shard-{i:03d}" for i in range(SHARDS)]))
