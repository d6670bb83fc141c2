"""Sharding by a permutation-filled lookup table, in DataFrame functions only on the data path.

Every shard has its own preference order over the slots of a prime-sized table (offset and step from a hash of
its name, so the order is a permutation). The shards take turns: each claims its next preferred free slot until the table
is full. A key goes to slot ``hash(key) mod size`` and to the shard that owns the slot. Adding or removing a
shard moves little more than that shard's share. The table has a fixed size, set by the number of shards and not by
the data, so broadcasting it is safe at any input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots per shard; with 128, shares differ by under one per cent of a shard's share.
SLOTS_PER_SHARD = 128
MAX_SLOTS = 2_000_003
DEFAULT_SHARDS = [f"shard-{i:03d}" for i in range(32)]


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int | None = None) -> list[int]:
    """The owner (index into ``shards``) of every slot. Shard names must be distinct and not empty."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and at least one")
    size = next_prime(size or SLOTS_PER_SHARD * len(shards))
    if not len(shards) <= size <= MAX_SLOTS:
        raise ValueError(f"{len(shards)} shards do not fit a table of at most {MAX_SLOTS} slots")
    place = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    left = size
    while left:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return owner


def key_slot(key: Column, size: int) -> Column:
    """First 15 hex digits of the key's md5, modulo the size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int | None = None) -> tuple[DataFrame, int]:
    """(slot, shard) rows of the lookup table, and its size."""
    owner = lookup_table(shards, size)
    slots = F.split(F.lit(",".join(map(str, owner))), ",").cast("array<int>")
    names = F.split(F.lit("\n".join(shards)), "\n")
    one = spark.range(1, numPartitions=1).select(F.posexplode(slots).alias("slot", "owner"))
    return one.select("slot", F.element_at(names, F.col("owner") + 1).alias("shard")), len(owner)


def assign_shards(df: DataFrame, key_col: str, shards: list[str] = DEFAULT_SHARDS, size: int | None = None) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (string) added, or replaced where columns of these names exist.

    No shuffle: the table is broadcast. Equal keys share a shard. Null keys have no identity to keep together and are
    placed by a hash of the whole row, so that they spread; ties and repeated rows keep their places, an empty
    table stays empty.
    """
    table, size = table_frame(df.sparkSession, shards, size)
    kept = df.drop("slot", "shard")
    row_key = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept.columns)]), {"ignoreNullFields": "false"})) if kept.columns else F.lit("")
    placed = kept.withColumn("slot", key_slot(F.coalesce(F.col(key_col).cast("string"), row_key), size))
    return placed.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in kept.columns], "slot", "shard")


def write_shards(df: DataFrame, path: str, key_col: str, shards: list[str] = DEFAULT_SHARDS, files_per_shard: int = 4) -> None:
    """Write one folder ``shard=...`` per shard; a shard's rows are dealt over several tasks, however large it is."""
    salted = assign_shards(df, key_col, shards).withColumn("_deal", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard)))
    salted.repartition(len(shards) * files_per_shard, "shard", "_deal").drop("_deal", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(documents, "doc_id")


def _oracle() -> str:
    owner = lookup_table(DEFAULT_SHARDS)
    return f"""
with t as (select [{', '.join(map(str, owner))}] o),
placed as (select doc_id, (('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint % {len(owner)})::int slot from documents)
select doc_id, slot, 'shard-' || lpad(o[slot + 1]::varchar, 3, '0') shard from placed, t"""


QUERIES = {"op7_sharding": op7_sharding}
ORACLES = {"op7_sharding": _oracle()}
