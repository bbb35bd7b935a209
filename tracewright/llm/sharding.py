"""Sharding: a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the records by seeded hashes into buckets of a size that fits in memory; pass two does a
Fisher-Yates shuffle of each bucket (Spark's shuffle() on an array is one) and writes it. A record's shard depends on
its key and the number of shards alone (rendezvous hashing: the shard with the highest hash wins), so one more shard
takes records only into itself.

Rows that agree on key and text share a bucket, unless they repeat so often that they would fill a good part of it:
these are scattered one by one.

Defined results: a null text counts as empty (size 1, crc32 0); a null key hashes like any other value; rows that
repeat get a slot each; an empty table gives an empty table; input columns named like an
added one (size, text_crc32, shard, bucket, slot, grown_shard) become in_<name>. Columns of map type pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import parts_for, shared_dir, text_bytes, unclash

#: What a record takes besides its text.
ROW_BYTES = 100
ADDED = ["size", "text_crc32", "shard", "bucket", "slot", "grown_shard"]


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard from 0 whose seeded hash of the key is the highest."""
    votes = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), key) for s in range(shards)])
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("int")


def shuffled_shards(docs: DataFrame, shards: int = 8, *, key: str = "doc_id", seed: int = 20_240_601, bucket_bytes: int = 16 << 20, out: str | None = None) -> DataFrame:
    """Write docs into shards at `out` (shard=S/bucket=B/ folders, rows in slot order) and return the table.

    Adds size (UTF-8 bytes of the text plus 1), text_crc32, shard, bucket, slot (place in the shard, gapless from 0)
    and grown_shard (the shard if there were one more).
    """
    spark = docs.sparkSession
    docs = unclash(docs, ADDED)
    n_bytes = int(docs.agg(F.sum(text_bytes() + ROW_BYTES)).first()[0] or 0)
    per_shard = parts_for(n_bytes, bucket_bytes * shards)
    payload = docs.columns
    same = F.xxhash64(F.lit(seed + 1), F.col(key), F.col("text"))
    counts = docs.groupBy(same.alias("_draw")).agg(F.count("*").alias("_copies"), F.max(text_bytes()).alias("_bytes"))
    # Rows that repeat so often that they would fill a good part of a bucket: at most as many as a few for each bucket.
    often = counts.where((F.col("_copies") > 1) & (F.col("_copies") * (F.col("_bytes") + ROW_BYTES) * 4 > bucket_bytes)).select("_draw")
    draw = same.alias("_draw")
    if not often.isEmpty():
        docs = docs.withColumn("_draw", same).join(often.withColumn("_often", F.lit(True)), "_draw", "left")
        draw = F.when(F.col("_often"), F.xxhash64("_draw", F.monotonically_increasing_id())).otherwise(F.col("_draw")).alias("_draw")
    placed = docs.select(draw, rendezvous(F.col(key), shards, seed).alias("shard"), F.struct(*payload).alias("_row")).withColumn("bucket", F.pmod("_draw", F.lit(per_shard)).cast("int"))
    in_order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("_n")).select("shard", "bucket", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_start"))
    scattered = placed.select("shard", "bucket", F.struct("_draw", "_row").alias("_item")).repartition(shards * per_shard, "shard", "bucket")
    # The order in which a bucket's records arrive may differ between attempts; the draw order is the same in each.
    by_draw = lambda a, b: F.when(a["_draw"] < b["_draw"], -1).when(a["_draw"] > b["_draw"], 1).otherwise(0)
    mixed = scattered.groupBy("shard", "bucket").agg(F.collect_list("_item").alias("_items")).sortWithinPartitions("shard", "bucket").withColumn("_items", F.shuffle(F.array_sort("_items", by_draw), F.lit(seed)))
    rows = mixed.join(starts, ["shard", "bucket"]).select("shard", "bucket", "_start", F.posexplode("_items").alias("_pos", "_item"))
    result = rows.select(
        *[F.col("_item._row")[c].alias(c) for c in payload],
        (text_bytes("_item._row.text") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("_item._row.text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        (F.col("_start") + F.col("_pos")).cast("long").alias("slot"),
        rendezvous(F.col("_item._row")[key], shards + 1, seed).alias("grown_shard"),
        "shard",
        "bucket",
    )
    out = out or shared_dir(spark)
    result.write.partitionBy("shard", "bucket").parquet(out)
    return spark.read.schema(result.schema).parquet(out)
