"""Sharding by a permutation-filled lookup table.

Every shard ranks all slots of a prime-sized table by its own permutation
(offset + turn * skip, modulo the prime). The shards take turns, each claiming
its best slot still free, until the table is full. The table's size is a
parameter and never grows with the data, so it is broadcast; placing a row is
one hash, one modulo and one lookup. Removing a shard moves few of the slots
that the others hold.

Defined cases: null keys hash like any other value and share one slot unless
``spread`` names columns to deal them by; equal keys always get one shard
(hot keys, one per ``spread`` bucket); an empty table gives an empty result;
input columns called slot or shard are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

TABLE_SIZE = 65537


def _digest(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{purpose}:{name}".encode(), digest_size=8).digest(), "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] | Mapping[str, int], table_size: int = TABLE_SIZE) -> list[str]:
    """Shard of every slot. With a mapping, a shard takes as many turns a round as its weight."""
    weights = dict(shards) if isinstance(shards, Mapping) else {s: 1 for s in shards}
    if not weights or min(weights.values()) < 1:
        raise ValueError("shards are needed, each with a weight of at least 1")
    if not is_prime(table_size) or table_size < sum(weights.values()):
        raise ValueError("table_size must be a prime that is not less than the shards' total weight")
    names = sorted(weights)
    offset = [_digest(s, "offset") % table_size for s in names]
    skip = [_digest(s, "skip") % (table_size - 1) + 1 for s in names]
    turn = [0] * len(names)
    owner: list[str | None] = [None] * table_size
    free = table_size
    while True:
        for i, name in enumerate(names):
            for _ in range(weights[name]):
                slot = (offset[i] + turn[i] * skip[i]) % table_size
                while owner[slot] is not None:
                    turn[i] += 1
                    slot = (offset[i] + turn[i] * skip[i]) % table_size
                owner[slot] = name
                turn[i] += 1
                free -= 1
                if not free:
                    return owner  # type: ignore[return-value]


def hot_keys(df: DataFrame, key: Sequence[str], share: float) -> DataFrame:
    """Keys with more than ``share`` of all rows: fewer than 1/share of them, whatever the input."""
    n = fresh("n", key)
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    return counts.where(F.col(n) > share * df.count()).select(*key)


def assign(
    df: DataFrame,
    key: Sequence[str],
    shards: Sequence[str] | Mapping[str, int],
    table_size: int = TABLE_SIZE,
    spread: Sequence[str] = (),
    hot_share: float = 0.01,
    fanout: int = 64,
) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row.

    With ``spread``, a key that holds more than ``hot_share`` of the rows, or
    a null key, is dealt over up to ``fanout`` slots by the columns named.
    """
    spark, key = df.sparkSession, list(key)
    owner = lookup_table(shards, table_size)
    slots = spark.createDataFrame([(i, s) for i, s in enumerate(owner)], "slot long, shard string")
    base = df.drop("slot", "shard")
    placed = F.pmod(F.xxhash64(*key), F.lit(table_size)).cast("long")
    if spread:
        flag, other = fresh("hot", base.columns), {k: fresh(f"k_{k}", base.columns) for k in key}
        hot = hot_keys(base, key, hot_share).withColumn(flag, F.lit(True))
        renamed = hot.select(*[F.col(k).alias(other[k]) for k in key], flag)
        same = [F.col(k).eqNullSafe(F.col(other[k])) for k in key]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        base = base.join(F.broadcast(renamed), cond, "left").drop(*other.values())
        none = F.lit(False)
        for k in key:
            none = none | F.col(k).isNull()
        deal = F.pmod(F.xxhash64(*spread), F.lit(fanout))
        placed = F.when(
            F.col(flag).isNotNull() | none, F.pmod(F.xxhash64(*key, deal), F.lit(table_size))
        ).otherwise(placed).cast("long")
        base = base.withColumn("slot", placed).drop(flag)
    else:
        base = base.withColumn("slot", placed)
    return base.join(F.broadcast(slots), "slot")
