"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. Shards take turns claiming
their best free slot until the table is full, so shares differ by one slot at most (in proportion to weights), and
adding or removing a shard moves few keys. The table has as many rows as the prime, whatever the data, and is
broadcast; a key's slot is its hash modulo the prime.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import uniform63

SLOTS = 6007  # a prime of about a hundred slots a shard
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Where a shard begins and how far it steps: slots (begin + j * step) mod prime, all of them once."""
    digits = hashlib.md5(name.encode()).hexdigest()
    return int(digits[:15], 16) % slots, int(digits[15:30], 16) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The shard's index of each slot. A shard with weight k claims k slots in each turn (default 1)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, at least one")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, and no smaller than the number of shards")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("each shard needs a weight of 0 or more, and one more than 0")
    prefer = [preference(s, slots) for s in shards]
    owner, at, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for i, (begin, step) in enumerate(prefer):
            for _ in range(min(weights[i], free)):
                while owner[slot := (begin + at[i] * step) % slots] >= 0:
                    at[i] += 1
                owner[slot] = i
                free -= 1
    return owner


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    """A key's slot. A null part counts as the text \\N, so rows without a key have one slot."""
    return (uniform63(*[F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys]) % slots).cast("int")


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, weights: list[int] | None = None, spread: list[str] | None = None) -> DataFrame:
    """df with columns slot and shard (int, index into shards); columns of these names in df are replaced.

    Each row is placed by its keys' text alone: repeated rows go to one shard, nulls count as the text \\N. For a
    key that holds a large part of the rows, name further columns in `spread`: they join the key, which scatters
    its rows. No shuffle: the table is broadcast, and its size is the prime. An empty table stays empty.
    """
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots, weights))), "slot int, shard int")
    rows = df.drop("slot", "shard").withColumn("slot", slot_of([F.col(k) for k in [*keys, *(spread or [])]], slots))
    return rows.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_each: int = 1) -> None:
    """Writes one folder a shard, each of files_each files: a shard of any size is spread by slot over its files."""
    placed.repartition(F.col("shard"), F.col("slot") % files_each).write.mode("overwrite").partitionBy("shard").parquet(path)
