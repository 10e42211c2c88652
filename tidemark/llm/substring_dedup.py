"""Repeated byte strings across and within documents, by sampled suffixes and bucket-pointer refinement.

A string of LENGTH bytes is repeated if it starts at two places. Suffixes are not sorted at every byte: of all
GRAM-byte strings in a string of LENGTH bytes, the ones with the smallest hash are its anchors, so equal strings
have equal anchors at equal offsets, and about one place in 60 is one. Anchors are put into buckets by their q-gram; what
is alone in its bucket is in no repeated string. A bucket is then refined by what follows and precedes the
anchors: names of 2k bytes are pairs of names of k bytes, the one at a place and the one k bytes later, and
names of a level serve for all places of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import query, release, staged, table

LENGTH = 200
GRAM = 64
#: Contexts of a bucket that one task refines in memory; larger buckets are refined window by window as rows.
BUCKET = 50_000
#: Bytes of a text hashed at a time.
BLOCK = 1 << 20

SPREAD = LENGTH - GRAM  # an anchor lies up to so many bytes after the start of its string
HALO = 2 * LENGTH


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """best (np.minimum or np.maximum) of every `width` neighbours."""
    have = 1
    while 2 * have <= width:
        values, have = best(values[:-have], values[have:]), 2 * have
    return best(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


class Hasher:
    """Hashes of any substrings of a block, from prefix sums modulo 2**64."""

    def __init__(self):
        rng = np.random.default_rng(2)
        self.byte = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base, size = 0x9E3779B97F4A7C15, BLOCK + 2 * HALO + 1
        self.power = np.cumprod(np.full(size, base, np.uint64)) * np.uint64(pow(base, -1, 2**64))
        self.inverse = np.cumprod(np.full(size, pow(base, -1, 2**64), np.uint64)) * np.uint64(base)

    def read(self, block: np.ndarray) -> None:
        self.sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(self.byte[block] * self.power[:len(block)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(text: bytes, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, hashes of their q-grams, hashes of all their strings' bytes together (the context)."""
    data = np.frombuffer(text, np.uint8)
    size, found = len(data), []
    for low in range(0, size if size >= LENGTH else 0, BLOCK):
        first, last = max(0, low - HALO), min(size, low + BLOCK + HALO)
        if last - first < LENGTH:
            continue
        hasher.read(data[first:last])
        places = np.arange(last - first - GRAM + 1)
        grams = hasher.of(places, places + GRAM)
        least = sliding(np.minimum, grams, SPREAD + 1)  # of each string of LENGTH bytes
        pad = np.zeros(SPREAD, np.uint64)
        at = np.flatnonzero(grams == sliding(np.maximum, np.concatenate([pad, least, pad]), SPREAD + 1))
        at = at[(at + first >= low) & (at + first < low + BLOCK)]
        left, right = np.maximum(at - SPREAD, 0), np.minimum(at + LENGTH, last - first)
        sizes = ((at - left) * 512 + (right - at)).astype(np.uint64)
        found.append((at + first, grams[at], mix(hasher.of(left, right) + sizes * np.uint64(0xC2B2AE3D27D4EB4F))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(part) for part in zip(*found))


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        per_row = [anchors(t, hasher) for t in batch.column("data").to_pylist()]
        rows = np.repeat(np.arange(len(per_row)), [len(p[0]) for p in per_row])
        if len(rows):
            place, gram, context = (np.concatenate(part) for part in zip(*per_row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), batch.column("h").take(pa.array(rows)), pa.array(place.astype(np.int32)),
                 pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], names=["id", "h", "at", "q", "c"])


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each anchor, SPREAD before and LENGTH from it on, as far as the text goes."""
    for batch in batches:
        ids, hs, data, lists = (batch.column(n) for n in ("id", "h", "data", "anchors"))
        for k in range(len(batch)):
            text, found = data[k].as_py(), lists[k].as_py()
            left = [min(a["at"], SPREAD) for a in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a["q"] for a in found], pa.int64()), pa.array([a["n"] for a in found], pa.int64()),
                 ids.take(pa.array([k] * len(found))), hs.take(pa.array([k] * len(found))),
                 pa.array([a["at"] for a in found], pa.int32()), pa.array(left, pa.int32()),
                 pa.array([text[a["at"] - m:a["at"] + LENGTH] for a, m in zip(found, left)], pa.binary())],
                names=["q", "n", "id", "h", "at", "left", "bytes"])


def window_names(left: list[int], contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the LENGTH-byte strings at every offset of contexts, one row for each, and which of them exist."""
    width = SPREAD + LENGTH
    raw = b"".join(b"\0" * (SPREAD - m) + c + b"\0" * (width - (SPREAD - m) - len(c)) for m, c in zip(left, contexts))
    names, size = mix(np.frombuffer(raw, np.uint8).reshape(-1, width).astype(np.uint64) + np.uint64(1)), 1
    while size < LENGTH:
        step = min(size, LENGTH - size)  # the last pair overlaps
        names = mix(names[:, :-step] * np.uint64(0x9E3779B97F4A7C15) + names[:, step:])
        size += step
    start = np.arange(SPREAD + 1)
    first = SPREAD - np.array(left)
    return names, (start >= first[:, None]) & (start + LENGTH <= (first + [len(c) for c in contexts])[:, None])


def spans_of(repeated: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated strings in rows as (row, start, end) of the bytes they cover."""
    edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return row, at[row] - SPREAD + first, at[row] - SPREAD + last + LENGTH


def refine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: the spans of contexts that stand alone (n = 1) but share strings with others of their bucket."""
    held: list[pa.RecordBatch] = []

    def refine(rows: pa.Table) -> pa.RecordBatch:
        at, n, q = (rows.column(c).to_numpy() for c in ("at", "n", "q"))
        names, real = window_names(rows.column("left").to_pylist(), rows.column("bytes").to_pylist())
        offset = np.arange(SPREAD + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys = mix(names + offset) + mix(q.view(np.uint64))[:, None]
        row, column = np.nonzero(real)
        _, group = np.unique(keys[row, column], return_inverse=True)
        times = np.bincount(group, n[row])
        repeated = np.zeros(real.shape, bool)
        repeated[row, column] = (times[group] >= 2) & (n[row] == 1)
        row, start, end = spans_of(repeated, at)
        table = rows.take(pa.array(row))
        return pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), table.column("h").combine_chunks(),
                                           pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["id", "h", "start", "end"])

    n_held = 0
    for batch in batches:
        held.append(batch)
        n_held += len(batch)
        if n_held >= 5_000:
            rows = pa.Table.from_batches(held)
            q = rows.column("q").to_numpy()
            whole = int(np.flatnonzero(q != q[-1])[-1]) + 1 if (q != q[-1]).any() else 0  # up to the last bucket
            if whole:
                yield refine(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
            n_held = len(rows) - whole
    if n_held:
        yield refine(pa.Table.from_batches(held))


def window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of contexts as a row: its name within the bucket, how often its context occurs, its place."""
    for batch in batches:
        for low in range(0, len(batch), 100):
            rows = batch.slice(low, 100)
            names, real = window_names(rows.column("left").to_pylist(), rows.column("bytes").to_pylist())
            row, column = np.nonzero(real)
            taken = rows.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [taken.column("q"), pa.array(column.astype(np.int32)), pa.array(names[row, column].view(np.int64)), taken.column("n"),
                 taken.column("id"), taken.column("h"), pa.array((rows.column("at").to_numpy()[row] - SPREAD + column).astype(np.int32))],
                names=["q", "o", "w", "n", "id", "h", "start"])


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
    for batch in batches:
        out = []
        for text, found in zip(batch.column("data").to_pylist(), batch.column("found").to_pylist()):
            spans: list[dict] = []
            for s in sorted(found or [], key=lambda s: s["start"]):
                start, end = max(0, s["start"]), min(len(text), s["end"])
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], end)
                else:
                    spans.append({"start": start, "end": end})
            ends = [0, *[s["end"] for s in spans]]
            kept = b"".join(text[a:b] for a, b in zip(ends, [*[s["start"] for s in spans], len(text)]))
            out.append({"n_bytes": len(text), "n_removed": len(text) - len(kept), "spans": spans, "kept": kept})
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], names=["row", "cut"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Spans (id, h, start, end) that cover all repeated strings of texts (id, h, data: bytes); ends may exceed a text.

    Anchors in no other bucket than their own go first; an anchor whose whole context occurs again has all its strings
    repeated, without a look at bytes. Only contexts that occur once, in buckets with others, are compared byte
    by byte, each with one row per different context of the bucket, however often it occurs.
    """
    spark, key = texts.sparkSession, f"id {texts.schema['id'].dataType.simpleString()}, h bigint"
    every = staged(texts.mapInArrow(anchor_batches, f"{key}, at int, q bigint, c bigint"), "anchors")
    # sums are written before they are joined: Spark then splits the rows of a frequent bucket among tasks
    shared = staged(every.groupBy("q").agg(F.count("*").alias("n")).where("n > 1").select("q"), "shared")
    met = staged(every.join(shared, "q", "left_semi"), "buckets")
    release(every)
    release(shared)
    times = staged(met.groupBy("q", "c").agg(F.count("*").alias("n")).where("n > 1"), "times")
    found = staged(met.join(times, ["q", "c"], "left").na.fill(1, ["n"]), "contexts")
    release(met)
    release(times)
    whole = found.where("n > 1").select("id", "h", (F.col("at") - F.least(F.col("at"), F.lit(SPREAD))).alias("start"),
                                        (F.col("at") + LENGTH).alias("end"))

    open_buckets = staged(found.where("n = 1").select("q").distinct(), "open")
    ones = found.join(open_buckets, "q", "left_semi").groupBy("q", "c") \
        .agg(F.min(F.struct("id", "h", "at")).alias("one"), F.max("n").alias("n"))
    ones = staged(ones.select("q", "n", "one.*"), "ones")
    sizes = ones.groupBy("q").agg(F.count("*").alias("size")).where("size > 1")
    large = sizes.where(F.col("size") > BUCKET).select("q")

    def contexts(buckets: DataFrame) -> DataFrame:
        per_text = ones.join(buckets, "q", "left_semi").groupBy("id", "h").agg(F.collect_list(F.struct("at", "q", "n")).alias("anchors"))
        of_text = texts.join(per_text.withColumnRenamed("id", "pid").withColumnRenamed("h", "ph"),
                             F.col("id").eqNullSafe(F.col("pid")) & (F.col("h") == F.col("ph"))).drop("pid", "ph")
        return of_text.mapInArrow(context_batches, f"q bigint, n bigint, {key}, at int, left int, bytes binary")

    spans = f"{key}, start int, end int"
    usual = contexts(sizes.where(F.col("size") <= BUCKET).select("q")).repartition("q").sortWithinPartitions("q")
    out = whole.union(usual.mapInArrow(refine_batches, spans))
    if large.take(1):
        rows = staged(contexts(large).mapInArrow(window_batches, f"q bigint, o int, w bigint, n bigint, {key}, start int"), "windows")
        again = rows.groupBy("q", "o", "w").agg(F.sum("n").alias("times")).where("times > 1").select("q", "o", "w")
        again = rows.where("n = 1").join(again, ["q", "o", "w"], "left_semi")
        out = out.union(again.select("id", "h", "start", (F.col("start") + LENGTH).alias("end")))
    return out


def cut_repeats(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", into: str = "cut") -> DataFrame:
    """The columns `carry` of every row with a struct `into`: n_bytes, n_removed, spans (maximal runs removed), kept (bytes).

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in another row or the same;
    all strings are those of the input. Bytes are UTF-8, so a cut may part a character. Null and empty texts are
    zero bytes; texts under LENGTH bytes lose nothing; repeated rows lose all if they are longer. Very long texts are
    hashed block by block. An empty table gives no rows. Columns of `docs` may have any name but `into`.
    """
    data = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(doc_id).alias("id"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    spans = repeated_spans(data.select("id", "h", "data"))
    per_text = spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    met = data.join(per_text.withColumnRenamed("id", "pid").withColumnRenamed("h", "ph"),
                    F.col("id").eqNullSafe(F.col("pid")) & (F.col("h") == F.col("ph")), "left").select("row", "data", "found")
    row = met.schema["row"].dataType.simpleString()
    cut = "struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<start:int,end:int>>,kept:binary>"
    return met.mapInArrow(cut_batches, f"row {row}, cut {cut}").select("row.*", F.col("cut").alias(into))


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    cut = cut_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return cut.select("doc_id", "cut.n_bytes", "cut.n_removed", F.size("cut.spans").cast("bigint").alias("n_spans"),
                      F.sha2("cut.kept", 256).alias("kept_sha256"))
