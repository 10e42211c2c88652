"""Near-duplicates by the Jaccard similarity of word shingles: met in MinHash bands, decided there by the exact shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import components, scratch, staged

SHINGLE = 5
SIMILARITY = 0.8
#: A sketch has BANDS x ROWS minima. Two sets of similarity s share a band with 1 - (1 - s^ROWS)^BANDS: all but 5e-8 at 0.8.
BANDS, ROWS = 32, 4
#: Bytes of shingle sets in a part of a bucket; a larger bucket is compared part by part, each pair of parts in a group of its own.
PART_BYTES = 4_000_000

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
MIX = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:])] or [digest(joined, 42)]
    return np.unique(np.array(hashes, np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """The smallest value under each of BANDS x ROWS mixing functions, 32 bits each; nothing for an empty set."""
    if not len(hashes):
        return b""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(low, ((hashes[k:k + 512, None] ^ MIX[0]) * MIX[1]).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def sketcher(shingle: int):
    @F.arrow_udf("struct<fp:bigint,size:int,sketch:binary>")
    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())])
        for batch in batches:
            out = []
            for text in batch.cast(pa.binary()).to_pylist():
                s = shingles(text or b"", shingle)
                fp = xxhash.xxh64_intdigest(s.tobytes(), 7)
                out.append({"fp": fp - (1 << 64) if fp >> 63 else fp, "size": len(s), "sketch": sketch(s)})
            yield pa.array(out, kind)

    return sketches


def verifier(shingle: int, similarity: float):
    @F.arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sets = lru_cache(64)(lambda text: shingles(text, shingle))
        for left, right in batches:
            out = []
            for a, b in zip(left.cast(pa.binary()), right.cast(pa.binary())):
                a, b = sets(a.as_py()), sets(b.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both / (len(a) + len(b) - both) >= similarity)
            yield pa.array(out, pa.bool_())

    return similar


def hasher(shingle: int):
    @F.arrow_udf("binary")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(t or b"", shingle).tobytes() for t in batch.cast(pa.binary()).to_pylist()], pa.binary())

    return hashes


def connecting(sets: list[np.ndarray], roots: list[int], left: range, right: range, similarity: float) -> list[tuple[int, int]]:
    """Similar pairs (i of `left`, j of `right`, i < j if these are the same) that connect what is not connected yet.

    `roots` are names of what is connected before. A set is held against all that are apart from it at once: its
    shingles are marked, and the marks of every other set are summed up. Memory grows with the sets, not with pairs.
    """
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    ids = np.unique(flat, return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)])
    root, out = np.unique(np.array(roots, np.int64), return_inverse=True)[1], []
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    for i in left:
        other = np.arange(max(right.start, i + 1 if left == right else 0), right.stop)
        other = other[root[other] != root[i]]
        other = other[np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i]) - 1e-6]
        if not len(other):
            continue
        own = ids[starts[i]:starts[i + 1]]
        mark[own] = 1
        ends = np.cumsum(size[other])
        within = np.arange(int(ends[-1])) + np.repeat(starts[other] - (ends - size[other]), size[other])
        both = np.add.reduceat(mark[ids[within]], ends - size[other])
        mark[own] = 0
        for j in other[both / (size[other] + size[i] - both) >= similarity].tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def connector(similarity: float):
    def connect(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """The links of one pair of parts of a bucket."""
        rows = rows.sort_by([("part", "ascending"), ("fp", "ascending")])
        fps, parts = rows["fp"].to_pylist(), rows["part"].to_pylist()
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist()]
        x, y = key[-2].as_py(), key[-1].as_py()
        cut = parts.count(x)
        left, right = range(cut), range(cut, len(parts)) if x != y else range(cut)
        links = connecting(sets, rows["root"].to_pylist(), left, right, similarity)
        return pa.table({"a": pa.array([fps[i] for i, _ in links], pa.int64()), "b": pa.array([fps[j] for _, j in links], pa.int64())})

    return connect


def similar_links(sets: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between the distinct sets of `sets` (fp, size, sketch, uid) whose connected components are those of all
    similar pairs. `texts` (uid, text) has a text for every uid.

    Sets meet in buckets of equal bands. At first every set of a bucket is held against the smallest fp there, so a
    large group of copies needs few pairs. Where a bucket's sets are not all connected then, the sets themselves (hashes of shingles,
    not texts) come into the bucket, and its task holds them against each other. Only links that connect what was apart leave the
    task: less than one for each set of a pair of parts.
    """
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    part = F.expr(f"xxhash64(substring(sketch, band * {4 * ROWS} + 1, {4 * ROWS}))")
    keyed = sets.where("size > 0").select("fp", "size", "sketch", band).withColumn("key", part).drop("sketch")
    hub = F.min(F.struct("fp", "size")).alias("hub")
    full = staged(keyed.groupBy("band", "key").agg(hub, F.count("*").alias("n")).where("n > 1").drop("n"), "bands")
    can = F.least("size", "hub.size") >= F.greatest("size", "hub.size") * (similarity - 1e-9)
    met = staged(keyed.join(full, ["band", "key"]), "members")
    stars = met.where(can).where(F.col("fp") != F.col("hub.fp")).select(F.col("hub.fp").alias("a"), F.col("fp").alias("b"))
    stars = staged(stars.distinct(), "stars")

    def with_texts(fps: DataFrame) -> DataFrame:
        return fps.distinct().join(sets.select("fp", "uid"), "fp").join(texts, "uid").select("fp", "text")

    needed = staged(with_texts(stars.select(F.col("a").alias("fp")).union(stars.select(F.col("b").alias("fp")))), "texts")
    left = needed.select(F.col("fp").alias("a"), F.col("text").alias("x"))
    right = needed.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    held = stars.join(left, "a").join(right, "b")
    links = staged(held.where(verifier(shingle, similarity)("x", "y")).select("a", "b"), "similar")

    roots = staged(components(links), "roots").withColumnRenamed("node", "fp")
    labelled = staged(met.select("band", "key", "fp", "size").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "labelled")
    parts = F.ceil(F.sum(F.col("size").cast("long") * 8) / PART_BYTES).cast("int").alias("parts")
    apart = staged(labelled.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y"), parts)
                   .where("x <> y").select("band", "key", "parts"), "apart")
    members = staged(labelled.join(apart, ["band", "key"]), "apart-members")
    hashes = staged(with_texts(members.select("fp")).select("fp", hasher(shingle)("text").alias("hashes")), "hashes")
    own = F.pmod(F.xxhash64("fp"), F.col("parts").cast("bigint")).cast("int")
    sides = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")))
    met = members.select("band", "key", "fp", "root", own.alias("part"), F.explode(sides).alias("p")).join(hashes, "fp")
    pairs = met.select("band", "key", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "fp", "root", "part", "hashes")
    found = pairs.groupBy("band", "key", "x", "y").applyInArrow(connector(similarity), "a long, b long")
    return links.union(staged(found.distinct(), "found"))


def mark_similar(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", into: str = "near",
                 shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The columns `carry` of every row with a struct `into`: component_id, kept.

    Words are cut at white space, A-Z in lower case; the set of a text holds its shingles of `shingle` words, or all
    words as one if there are fewer. Two texts are linked if their sets have the `similarity` or more; null, empty and
    blank texts have the empty set and are linked to each other. A component is what links connect; its id is the
    smallest doc_id in it (null if there is none). One row of each stays: that with the smallest id (null last), one of
    them if rows repeat it. An empty table gives no rows. Columns of `docs` may have any name but `into`.

    Everything on pairs works on distinct sets, so copies never meet; texts are read again only for sets that share a band with
    others. Whole texts count: a text takes about 100 bytes a word while it is cut. Two written stages stay, for the result reads them.
    """
    own = [] if text in carry else [F.col(text).alias("text")]  # a text is written once
    with scratch() as keep:
        rows = keep(staged(docs.select(
            F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(doc_id).alias("id"), *own, F.monotonically_increasing_id().alias("uid"),
            sketcher(shingle)(F.coalesce(F.col(text), F.lit(""))).alias("s")), "sketches"))
        texts = rows.select("uid", (F.col("text") if own else F.col("row")[text]).alias("text"))
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("uid"))).alias("first")
        sketches = rows.select("id", "uid", "s.fp", "s.size", "s.sketch").groupBy("fp")
        sets = staged(sketches.agg(first, F.min("size").alias("size"), F.min("sketch").alias("sketch")).withColumn("uid", F.col("first.uid")), "sets")
        roots = components(similar_links(sets, texts, shingle, similarity)).withColumnRenamed("node", "fp")
        heads = sets.select("fp", "first").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        # written before it is joined: Spark then splits the rows of a large component among tasks
        of_root = staged(heads.groupBy("root").agg(F.min("first").alias("best")), "roots")
        decided = keep(staged(heads.join(of_root, "root").select("fp", "best"), "decided"))
    mark = F.struct(F.col("best.id").alias("component_id"), (F.col("uid") == F.col("best.uid")).alias("kept"))
    return rows.select("row", "uid", "s.fp").join(decided, "fp").select("row.*", mark.alias(into))


def drop_similar(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with its columns."""
    return mark_similar(docs, docs.columns, into="__near").where("__near.kept").drop("__near")
