"""Settings, written stages and connected components shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import session

RUNTIME_CONF = {
    # batches for Python are small, whatever the length of a text
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # shuffle files go when the job that wrote a stage has ended
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # in Spark 4.1 a union of bucketed tables passes for bucketed although its partitions are not
    "spark.sql.unionOutputPartitioning": "false",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# characters of [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\f\r"


def configure(spark: SparkSession) -> SparkSession:
    session.configure(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under `name`, with its DuckDB twin if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run in the place that all executors share."""
    return f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as Parquet into the shared folder and read it back: the lineage ends in files."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    for scope in SCOPES[-1:]:
        scope.append(out)
    return out


SCOPES: list[list[DataFrame]] = []  # stages written within `scratch`, by the block they belong to


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stages written in the block are removed at its end, but for those given to the function it yields; these
    belong to the block around it, if there is one."""
    kept: list[DataFrame] = []
    SCOPES.append([])

    def keep(stage: DataFrame) -> DataFrame:
        kept.append(stage)
        return stage

    try:
        yield keep
    finally:
        for stage in SCOPES.pop():
            if not any(stage is k for k in kept):
                release(stage)
            elif SCOPES:
                SCOPES[-1].append(stage)


def release(stage: DataFrame) -> None:
    """Remove the files of a written stage that nothing reads any more."""
    spark = stage.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stage.stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def identity(*columns: str):
    """128 bits that tell apart rows with different values in the columns; equal rows share them."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long, b long): node, root (the smallest node reachable).

    Alternates two star steps, each one minimum per node and one join: after a logarithmic number of rounds
    every node points at the smallest one of its component. Each round is a written stage, and so are the minima before they are
    joined: Spark then splits the links of a hub among tasks. Nodes without an edge to another node do not appear.
    """
    links = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        # every neighbour that is larger than a node, and the node, point at the smallest neighbour
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "links")
        # of its smaller neighbours and itself, all point at the smallest one
        lowest = staged(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.*").where("a <> b").distinct()
        read, links = [links, low, large, lowest], staged(small, "links")
        for stage in read:
            release(stage)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
