"""Near-duplicates by SimHash fingerprints, linked with tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import components, query, scratch, staged, table

SHINGLE = 4
DISTANCE = 4
#: Reference fingerprints of a distance table.
PIVOTS = 24
#: Fingerprints that one task compares at a time; a larger bucket is compared chunk by chunk.
CHUNK = 4_096
#: Mean number of fingerprints in a bucket beyond which more bits are compared.
MEAN_BUCKET = 64

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, as a signed number: bit i is set if it is in over half of the shingles' hashes."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:])] or [digest(joined, 42)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


@F.arrow_udf(LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([fingerprint(t or b"") for t in batch.cast(pa.binary()).to_pylist()], pa.int64())


def near(fps: np.ndarray, distance: int, pivots: int = PIVOTS) -> np.ndarray:
    """For each of some distinct fingerprints, the position of the first one it is connected to by near pairs.

    The table holds every fingerprint's distances to the pivots. Two near fingerprints differ by `distance` at most
    in every column, so a pair with a larger difference in one is discarded; the others are verified.
    """
    m = len(fps)
    refs = np.random.default_rng(8).integers(0, 2**64, pivots, dtype=np.uint64)
    far = np.bitwise_count(fps[None, :] ^ refs[:, None]).astype(np.int16)
    root = np.arange(m)
    for low in range(0, m, 256):
        block = np.abs(far[0][low:low + 256, None] - far[0][None, :]) <= distance
        i, j = np.nonzero(np.triu(block, low + 1))
        i += low
        for column in far[1:]:
            keep = np.abs(column[i] - column[j]) <= distance
            i, j = i[keep], j[keep]
            if not len(i):
                break
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= distance
        i, j = i[keep], j[keep]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, shorter := root[root]):
                root = shorter
    return root


def linker(distance: int):
    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def link_buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            out = []
            for k in range(len(batch)):
                fps = batch[k].values.to_numpy()
                root = near(fps.view(np.uint64), distance)
                out.append([{"a": int(fps[x]), "b": int(fps[root[x]])} for x in np.flatnonzero(root != np.arange(len(fps)))])
            yield pa.array(out, kind)

    return link_buckets


def masks(n: int, distance: int) -> list[int]:
    """Every choice of `distance` of n bit blocks to leave out: two near fingerprints agree on the rest of one choice."""
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(kept) for kept in combinations(blocks, n - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `fps` (fp) whose connected components are those of all near pairs.

    A pivot table compares all pairs it is given, and distances to pivots alone hardly part random fingerprints. So
    pairs come from buckets first, without loss: with the bits in n blocks, near ones agree on some n - distance
    blocks. n grows with the number of fingerprints, so that buckets of unrelated ones stay small. Within a
    bucket the table decides. Buckets beyond CHUNK are compared chunk with chunk in separate tasks.
    """
    n_fps, n = fps.count(), distance + 1
    while n < 64 and n_fps > MEAN_BUCKET << (64 * (n - distance) // n):
        n += 1
    tables = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                       for k, m in enumerate(masks(n, distance))])
    keyed = fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.choice", "t.key")
    full = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1") \
        .select("choice", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks").cast("bigint")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                        lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")))
    met = keyed.join(full, ["choice", "key"]).select("choice", "key", "fp", F.explode(pairs).alias("p"))
    buckets = met.groupBy("choice", "key", "p").agg(F.collect_list("fp").alias("fps"))
    return buckets.select(F.explode(linker(distance)("fps")).alias("l")).select("l.a", "l.b")


def mark_near_copies(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", into: str = "near",
                     distance: int = DISTANCE) -> DataFrame:
    """The columns `carry` of every row with a struct `into`: fp (64 bits as a signed number), component_id, kept.

    Words are cut at white space, A-Z in lower case; shingles are SHINGLE words, repeats included, or all words
    if there are fewer. Null, empty and blank texts have the fingerprint 0 and are linked like any other. A
    component is what near pairs connect; its id is the smallest doc_id in it (null if there is none). One row of
    each stays: that with the smallest id (null last), one of them if rows repeat it. An empty table gives
    no rows. Columns of `docs` may have any name but `into`.

    Fingerprints are written once with their rows. Everything on pairs works on distinct fingerprints, so copies
    never meet; the joins back have one row per fingerprint on one side, and Spark splits the other where skewed.
    Whole texts count: a text takes about 150 bytes a word while it is cut. Two written stages stay, for the result reads them.
    """
    with scratch() as keep:
        rows = keep(staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(doc_id).alias("id"),
                                       F.monotonically_increasing_id().alias("uid"),
                                       fingerprints(F.coalesce(F.col(text), F.lit(""))).alias("fp")), "fingerprints"))
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("uid"))).alias("first")
        heads = staged(rows.groupBy("fp").agg(first), "heads")
        roots = components(near_links(heads.select("fp"), distance)).withColumnRenamed("node", "fp")
        heads = heads.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        # written before it is joined: Spark then splits the rows of a large component among tasks
        of_root = staged(heads.groupBy("root").agg(F.min("first").alias("best")), "roots")
        decided = keep(staged(heads.join(of_root, "root").select("fp", "best"), "decided"))
    mark = F.struct("fp", F.col("best.id").alias("component_id"), (F.col("uid") == F.col("best.uid")).alias("kept"))
    return rows.join(decided, "fp").select("row.*", mark.alias(into))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with its columns."""
    return mark_near_copies(docs, docs.columns, into="__near").where("__near.kept").drop("__near")


@query("op8_simhash")
def op8(spark, sf_dir):
    return mark_near_copies(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", F.lpad(F.lower(F.hex("near.fp")), 16, "0").alias("fingerprint"), "near.component_id"
    )
