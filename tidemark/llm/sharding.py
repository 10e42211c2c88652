"""Shards of a table in random order, by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import query, staged, table

SHARDS = 40
SEED = 20
#: What one task shuffles in memory.
BUCKET_BYTES = 16 << 20
#: Up to so many buckets their offsets (24 bytes each) are broadcast; beyond, they are joined.
BROADCAST_BUCKETS = 1_000_000


def by_uid(x: Column, y: Column) -> Column:
    return F.when(x["uid"] < y["uid"], -1).when(x["uid"] > y["uid"], 1).otherwise(0)


def shuffled(df: DataFrame, size: Column, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> tuple[DataFrame, int, int]:
    """All rows as (bucket, pos, row) in random order, with the number of rows and of buckets; `size` is a row's bytes.

    First pass: rows get a number and are written; a seeded hash of the number deals them evenly to buckets, whatever
    their content, and, as the number is in a file, deals them alike if a task is repeated. Second pass: each
    bucket is put in order of the numbers, shuffled by Fisher-Yates (Spark's shuffle()) and written. There are as many
    partitions as buckets, so a task holds a bucket or a few however many rows there are. A very long text is in one bucket, whole.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    numbered = staged(df.select(row.alias("row"), F.monotonically_increasing_id().alias("uid"), size.alias("size")), "numbered")
    n, total = numbered.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    dealt = numbered.select(F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(buckets)).alias("bucket"), F.struct("uid", "row").alias("r"))
    lists = dealt.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list("r").alias("rs"))
    mixed = lists.select("bucket", F.posexplode(F.shuffle(F.array_sort("rs", by_uid), seed)).alias("pos", "r"))
    return staged(mixed.select("bucket", F.col("pos").cast("bigint").alias("pos"), F.col("r.row").alias("row")), "shuffled"), n, buckets


def shard(df: DataFrame, size: Column, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED,
          into: str = "place") -> DataFrame:
    """Every row of `df` with a struct `into`: shard (from 0) and slot (from 0, without gaps, within the shard).

    The law is `rows`: the shuffled rows are cut into `shards` pieces whose counts differ by one at most. Content plays
    no part, so null, empty, very long and repeated rows are dealt like others, a large group of equal rows spreads over
    all shards, and columns may have any name but `into`. An empty table gives no rows; with fewer rows than shards some
    shards are empty. A null size counts as 0 bytes.
    """
    rows, n, buckets = shuffled(df, F.coalesce(size.cast("bigint"), F.lit(0)), bucket_bytes, seed)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    at = rows.join(offsets, "bucket").withColumn("at", F.col("base") + F.col("pos"))
    cut = at.withColumn("shard", F.expr(f"at * {shards} div {max(n, 1)}").cast("int"))
    first = F.expr(f"(shard * bigint({n}) + {shards - 1}) div {shards}")
    return cut.select("row.*", F.struct("shard", (F.col("at") - first).alias("slot")).alias(into))


def write_shards(df: DataFrame, path: str, size: Column, shards: int = SHARDS) -> None:
    """One folder shard=<n> per shard; rows keep their slot, the order within the shard."""
    placed = shard(df, size, shards, into="__place")
    placed.select("*", "__place.*").drop("__place").write.partitionBy("shard").parquet(path)


@query("op1_sharding")
def op1(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard(docs, F.octet_length(text) + 16)
    return placed.select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "place.shard", "place.slot", F.lit(None).cast("int").alias("grown_shard"),
    )
