"""Two-pass external shuffle of a table into shards, with DataFrame functions only.

Pass one scatters the rows into buckets that fit in memory.  A row's shard is the one
with the highest seeded hash of (id, shard), so that the id and the number of shards
decide it alone and one more shard takes rows only into itself (law ``key``).  Within
its shard a row goes to one of equally many buckets by another seeded hash; their
number follows from the bytes of the largest shard.  Pass two gathers each bucket in
one row, orders it, applies Spark's ``shuffle`` (a seeded Fisher-Yates shuffle) and
numbers the rows on from the buckets before it in the shard.

Buckets are dealt one to a partition, so a bucket's order depends on the seed and on
its rows alone: a task that is run again after a lost executor gives the same order.

Defined results: a null text has no bytes and CRC-32 0; a null id is an id like any
other; rows with one id share a shard, as the law wants it, and are spread over its
buckets by their text; equal rows take places of their own; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_of, table

SHARDS = 40
SEED = 20_240_607
#: Bytes of text and fixed costs that a bucket holds on average.
BUCKET_BYTES = 32 << 20
#: The table of bucket offsets is broadcast, 12 bytes each; larger inputs need larger buckets.
MOST_BUCKETS = 4_000_000
ROW_BYTES = 16


def shard_of(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """The shard of 0 .. n_shards - 1 with the highest hash for the key."""
    scored = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda k: F.struct(F.xxhash64(F.lit(seed), k, key).alias("h"), k.alias("k")))
    return F.array_max(scored)["k"].cast("int")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shuffle_into_shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with its own columns in a struct ``record``, and shard, slot: a row's place, from 0 without gaps."""
    columns = docs.columns
    placed = docs.select(
        F.struct(*(F.col(c) for c in columns)).alias("record"),
        shard_of(F.col(id_col), n_shards, seed).alias("shard"),
        text_bytes(F.col(text_col)).alias("bytes"),
        F.xxhash64(F.lit(~seed), F.col(id_col), F.col(text_col)).alias("tie"),
    )
    largest = placed.groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0] or 0
    per_shard = max(1, -(-int(largest) // bucket_bytes))
    if n_shards * per_shard > MOST_BUCKETS:
        raise ValueError(f"{n_shards * per_shard} buckets; at most {MOST_BUCKETS}: raise bucket_bytes")
    bucketed = placed.withColumn("bucket", (F.col("shard") * per_shard + F.pmod("tie", F.lit(per_shard))).cast("int")).drop("shard", "bytes")

    counts = bucketed.groupBy("bucket").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy(F.expr(f"bucket div {per_shard}")).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("bucket"), before.alias("offset"))

    scattered = bucketed.repartitionById(n_shards * per_shard, F.col("bucket"))
    gathered = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("tie", "record"))).alias("rows")) if not _has_map(docs) else scattered.groupBy("bucket").agg(F.collect_list(F.struct("tie", "record")).alias("rows"))
    shuffled = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    places = shuffled.select("bucket", F.posexplode("rows").alias("pos", "row"))
    # no more offsets than MOST_BUCKETS
    placed_rows = places.join(F.broadcast(offsets), "bucket")
    return placed_rows.select(F.col("row.record").alias("record"), F.expr(f"cast(bucket div {per_shard} as int)").alias("shard"), (F.col("offset") + F.col("pos")).cast("long").alias("slot"))


def _has_map(docs: DataFrame) -> bool:
    return "map<" in docs.schema.simpleString()


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled rows as Parquet, a folder for each shard and a file for each bucket in slot order."""
    shuffle_into_shards(docs, **options).select("record.*", "shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op1: the place of every document in 40 shards."""
    found = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("record.doc_id").alias("doc_id"),
        text_bytes(F.col("record.text")).alias("size"),
        F.coalesce(crc32_of(F.col("record.text")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("record.doc_id"), SHARDS + 1).alias("grown_shard"),
    )
