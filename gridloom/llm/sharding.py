"""Sharding by a permutation-filled lookup table (consistent hashing with even shares)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh

#: Largest table that is broadcast: 8 bytes a slot.
MAX_TABLE = 4_000_037


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], size: int = 65_537, turns: Sequence[int] | None = None) -> np.ndarray:
    """The shard number in each of ``size`` slots.

    Every shard has a permutation of the slots, its order of preference: ``(offset + i * skip) mod size``.  The shards
    take turns, and in its turn each claims the first slot of its order that is free, until none is left.  Shares
    differ by one slot at most, and when a shard comes or goes few slots change hands but its own.
    turns: claims that each shard makes in a turn (its weight; 1 each by default).
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE}")
    claims = list(turns or [1] * len(shards))
    if len(claims) != len(shards) or min(claims) < 1:
        raise ValueError("turns must be one positive number for each shard")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = np.full(size, -1, np.int32), size
    owner = table.tolist()
    while free:
        for shard, n in enumerate(claims):
            for _ in range(min(n, free)):
                while owner[at[shard]] >= 0:
                    at[shard] = (at[shard] + skip[shard]) % size
                owner[at[shard]] = shard
                free -= 1
    return np.array(owner, np.int32)


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("bigint") % size


def assign(rows: DataFrame, key: str, shards: Sequence[str], size: int = 65_537, turns: Sequence[int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``rows`` with the columns slot and shard (columns of these names are replaced).

    A row's slot is the first 60 bits of the MD5 of its key's text modulo the table's size; the table (at most MAX_TABLE rows) is
    broadcast, so placement takes one look-up and no row moves.  Equal keys share a shard; a null key counts as the
    empty text and a very long one is hashed whole; repeated rows are kept; an empty table gives no rows.  There are no ties: a
    slot has one shard.
    """
    table = lookup_table(shards, size, turns)
    at, no = fresh(rows.columns, "at", "no")
    slots = pa.table({at: pa.array(np.arange(size, dtype=np.int64)), no: pa.array(table)})
    frame = rows.sparkSession.createDataFrame(slots)
    keep = [c for c in rows.columns if c.lower() not in (slot.lower(), shard.lower())]
    placed = rows.select("*", slot_of(F.col(key), size).alias(at))
    return placed.join(F.broadcast(frame), at).select(*keep, F.col(at).alias(slot), F.col(no).alias(shard))
