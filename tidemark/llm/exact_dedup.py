"""Exact duplicates by digest, found with cuckoo-filter indexes that Spark spreads over the digests."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import BLANKS, query, staged, table

#: Copies of one text are added up in at most so many parts before they meet in one index.
PARTS = 32
#: Changes that one index gets, on average, at most.
INDEX_ROWS = 1_000_000

DIGEST = "digest string, n bigint, first struct<minus_chars:bigint,no_id:boolean,id:{id},uid:bigint>"


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    return reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


class CuckooIndex:
    """Live digests behind a cuckoo filter; what the filter reports is verified against the bucketed content.

    A digest has two buckets of four one-byte-pair fingerprints. A lookup that finds its fingerprint in neither is
    a sure miss. The content (digest and its payload) lies in buckets by the first position. If an insertion finds
    no room after MAX_KICKS moves, the filter is rebuilt at twice the size from the digests stored there.
    """

    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.rng = random.Random(7)
        self.live = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[dict[str, list]] = [{} for _ in range(buckets)]

    def _places(self, digest: str) -> tuple[int, int]:
        h = int(digest[:16], 16)
        return (h & 0xFFFF) or 1, (h >> 16) & self.mask

    def _other(self, mark: int, place: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: str) -> list | None:
        """The stored entry [digest, payload], or None."""
        mark, place = self._places(digest)
        if mark not in self.slots[place] and mark not in self.slots[self._other(mark, place)]:
            return None
        return self.content[place].get(digest)

    def insert(self, digest: str, payload) -> list:
        """Store a digest that is not live yet."""
        entry = [digest, payload]
        self.live += 1
        self._store(entry)
        return entry

    def _store(self, entry: list) -> None:
        mark, place = self._places(entry[0])
        self.content[place][entry[0]] = entry
        for _ in range(self.MAX_KICKS):
            for at in (place, self._other(mark, place)):
                if len(self.slots[at]) < self.SLOTS:
                    self.slots[at].append(mark)
                    return
            k = self.rng.randrange(self.SLOTS)  # move another fingerprint to its other place
            self.slots[at][k], mark = mark, self.slots[at][k]
            place = at
        self._resize()

    def _resize(self) -> None:
        stored = list(self.entries())
        self._clear(2 * (self.mask + 1))
        for entry in stored:
            self._store(entry)

    def delete(self, digest: str) -> bool:
        if self.find(digest) is None:
            return False
        mark, place = self._places(digest)
        del self.content[place][digest]
        at = place if mark in self.slots[place] else self._other(mark, place)
        self.slots[at].remove(mark)
        self.live -= 1
        return True

    def entries(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket.values()


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, n, first) of one partition into one row per live digest; n < 0 withdraws copies."""
    index, schema = CuckooIndex(), None
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            entry = index.find(row["digest"])
            if entry is None:
                index.insert(row["digest"], [row["n"], row["first"]])
                continue
            n, first = entry[1]
            entry[1] = [n + row["n"], min((f for f in (first, row["first"]) if f), key=place, default=None)]
    if schema is None:
        return
    for entry in [e for e in index.entries() if e[1][0] <= 0]:
        index.delete(entry[0])
    rows: list[dict] = []
    for digest, (n, first) in index.entries():
        rows.append({"digest": digest, "n": n, "first": first})
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def place(first: dict) -> tuple:
    return first["minus_chars"], first["no_id"], first["id"] or 0 if not first["no_id"] else 0, first["uid"]


def update_index(changes: DataFrame, index: DataFrame | None = None, n_rows: int = 0) -> DataFrame:
    """The live digests after `changes`, both with columns digest, n (copies; below 0: withdrawn) and first.

    `first` describes the copy that stays: more characters before fewer, then the smaller id (null last), then uid.
    It stays while any copy of its digest is live. Changes with one digest may come in any order. With about `n_rows` of them there
    are so many indexes that each gets INDEX_ROWS at most, however many partitions the session takes for a shuffle.
    """
    rows = changes if index is None else index.unionByName(changes)
    kind = rows.schema["first"].dataType["id"].dataType.simpleString()
    spark = rows.sparkSession
    indexes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // INDEX_ROWS))
    return rows.select("digest", "n", "first").repartition(indexes, "digest").mapInArrow(fold, DIGEST.format(id=kind))


def mark_copies(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", into: str = "copy") -> DataFrame:
    """The columns `carry` of every row with a struct `into`: digest, keep_id, group_size, kept.

    Texts are equal if they are the same without white space; null is the empty text, which has copies like any
    other. Of equal texts the row with the most code points stays, then that with the smallest id (a null id
    comes last); of repeated rows with one id and length, one stays. An empty table gives no rows. Columns of
    `docs` may have any name but `into`.

    Rows with digests are written once. Copies are summed up in PARTS parts per digest before the shuffle to the
    indexes, so a text with a third of all rows gives an index PARTS rows; the join of the decisions back to the
    rows has one row per digest on one side, and Spark splits the other one where it is skewed. Texts are hashed whole, whatever
    their length, and only their digests move.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = staged(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("uid"),
        F.length(t).cast("bigint").alias("chars"), F.sha2(normalised(t).cast("binary"), 256).alias("digest"),
    ), "digests")
    first = F.struct((-F.col("chars")).alias("minus_chars"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("uid"))
    parts = rows.groupBy("digest", F.pmod(F.xxhash64("uid"), F.lit(PARTS)).alias("part")) \
        .agg(F.count("*").alias("n"), F.min(first).alias("first"))
    groups = update_index(parts.select("digest", "n", "first"), n_rows=rows.count())  # the rows by the files' footers
    copy = F.struct("digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
                    (F.col("uid") == F.col("first.uid")).alias("kept"))
    return rows.join(groups, "digest").select("row.*", copy.alias(into))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with its columns."""
    return mark_copies(docs, docs.columns, into="__copy").where("__copy.kept").drop("__copy")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


@query("op3_exact_dedup", SQL)
def op3(spark, sf_dir):
    return mark_copies(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "copy.keep_id", "copy.group_size", "copy.kept", F.col("copy.digest").alias("text_sha256")
    )
