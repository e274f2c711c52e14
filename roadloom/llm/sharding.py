"""Sharding by a two-pass external shuffle, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.session import checkpointed

#: UTF-8 bytes of text that a bucket holds on average; buckets for each shuffle partition at least.
BUCKET_BYTES, BUCKETS_PER_PARTITION = 4 << 20, 4
#: Shuffle partitions at most: the driver keeps their sizes for every map task. A task then takes more buckets in turn.
MOST_PARTITIONS = 20_000
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


#: Buckets whose counts are added up in one window.
COUNT_GROUP = 4096


def rows_before(counts: DataFrame) -> DataFrame:
    """(bucket, before): the rows of all lower buckets, from (bucket, n). Counts are summed by groups of buckets, then over
    the groups, so that no window sees more than COUNT_GROUP buckets, or the groups."""
    group = F.floor(F.col("bucket") / COUNT_GROUP).alias("part")
    own = counts.select("bucket", "n", group)
    parts = own.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("bucket")) - F.col("n")
    return own.withColumn("inside", inside).join(parts, "part").select("bucket", (F.col("base") + F.col("inside")).alias("before"))


def shuffled_shards(docs: DataFrame, shards: int = 40, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, size, shard, slot): all rows of ``docs`` in random order, dealt into ``shards`` shards.

    Pass one scatters the rows by a seeded hash of doc_id, text and place in the table into buckets that fit in memory;
    their number follows the bytes of the corpus. Pass two puts each bucket into the order of the hash, so that it does
    not matter how its rows arrived, and Fisher-Yates shuffles it. Row p of the buckets' concatenation is slot p / shards
    of shard p mod shards, so shards differ by at most one row and slots have no gaps. The place in the table scatters
    rows that repeat a doc_id and its text, however many; ``docs`` is read once, and its rows are written with their keys,
    so that counts and buckets are of the same rows whatever order ``docs`` comes in. Null texts have no bytes. Ties of the
    hash are broken by doc_id and text. No rows: no rows. A text longer than a bucket has a bucket as large as itself.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES
    key = F.xxhash64(F.lit(seed), "doc_id", "text", "row").alias("key")
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).select("doc_id", "text", size.alias("size"), key)
    keyed = checkpointed(keyed)
    total = keyed.agg(F.sum("size")).first()[0] or 0
    buckets = max(-(-total // bucket_bytes), BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = keyed.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(buckets)))
    before = rows_before(checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("n"))))
    # F.shuffle draws from one generator for a whole partition: a task that is run again must meet its buckets in the
    # same order, or it would deal rows anew that others have read.
    dealt = rows.repartition(min(max(1, buckets // BUCKETS_PER_PARTITION), MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    scattered = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "doc_id", "text", "size"))).alias("own"))
    mixed = scattered.join(before, "bucket").select("before", F.shuffle("own", seed).alias("own"))
    out = mixed.select("before", F.posexplode("own").alias("at", "r"))
    p = F.col("before") + F.col("at")
    return out.select("r.doc_id", "r.text", "r.size", F.pmod(p, F.lit(shards)).cast("int").alias("shard"), F.floor(p / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20) -> None:
    """The shards as Parquet folders ``shard=N`` whose rows carry their slot, in the order of the slots.

    Repeated rows are written as often as they occur, null texts as nulls. No rows: no folders. A folder that is there is
    replaced. Each shard is one sorted file, so choose ``shards`` by the size that a file should have.
    """
    shuffled_shards(docs, shards, seed).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
