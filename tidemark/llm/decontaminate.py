"""Find passages of benchmark items in documents with an Aho-Corasick automaton over the items' word windows."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import query, table

WINDOW = 10
#: Patterns of one automaton; a larger benchmark is cut into blocks of items, each with its own automaton.
BLOCK_BYTES = 8_000_000

# Byte by byte on UTF-8: A-Z in lower case, digits, letters and all of non-ASCII stay, the rest separates words.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    """All windows of an item; one shorter than a window is a window itself."""
    if not words:
        return set()
    return {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}


def automaton(items: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton | None:
    """Patterns are windows between blanks, so that they start and end with whole words."""
    owners: dict[bytes, list[str]] = {}
    for item, text in items:
        for pattern in windows_of(words_of(text), window):
            owners.setdefault(pattern, []).append(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for pattern, ids in owners.items():
        found.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, ids))
    found.make_automaton()
    return found


def scan(text: bytes, machine: ahocorasick.Automaton | None) -> tuple[int, list[dict], list[str]]:
    """Number of words; hit words with their place among the words and in the text (characters); items found."""
    words = words_of(text)
    if not words or machine is None:
        return len(words), [], []
    joined = b" " + b" ".join(words) + b" "
    found = list(machine.iter(joined.decode("latin-1")))
    if not found:
        return len(words), [], []
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    last = np.searchsorted(blanks, [end for end, _ in found])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - [n for _, (n, _) in found], 1)
    np.add.at(change, last, -1)
    hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    # offsets: words again as runs of word bytes in the original, characters as bytes that start one
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts, ends = chars[edges[0::2][hit]], chars[edges[1::2][hit]]
    spans = [{"word": int(w), "start": int(s), "end": int(e)} for w, s, e in zip(hit, starts, ends)]
    return len(words), spans, sorted({i for _, (_, ids) in found for i in ids})


FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
    ("items", pa.list_(pa.string())),
])


def scanner(spark, items: list[tuple[str, bytes]], window: int):
    shared = spark.sparkContext.broadcast(items)

    @F.arrow_udf("struct<n_words:bigint,hits:array<struct<word:int,start:int,end:int>>,items:array<string>>")
    def scan_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(shared.value, window)
        for batch in batches:
            rows = [scan(t or b"", machine) for t in batch.cast(pa.binary()).to_pylist()]
            yield pa.array([dict(zip(("n_words", "hits", "items"), r)) for r in rows], FOUND)

    return scan_batches


def blocks_of(items: DataFrame, text: str, item_id: str, window: int, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The items in blocks whose patterns stay below the bound; each block is read on its own."""
    rows = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    # a window starts at every word and has `window` words: that many times the text at most
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size * window // block_bytes))
    part = F.pmod(F.xxhash64("id", "t"), F.lit(n))
    return [[(r.id, r.t.encode()) for r in rows.where(part == b).collect()] for b in range(n)]


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "found") -> DataFrame:
    """`docs` with a struct column `into`: n_words; hits (place of each hit word among the words, and its start
    and end in the original text in characters); items (ids as strings, sorted, of items with a window in the text).

    A word is a run of letters, digits and non-ASCII characters, A-Z in lower case. A window is `window`
    consecutive words of an item, or the whole item if it is shorter. Each text is scanned once per automaton;
    there is one unless the benchmark's patterns exceed `block_bytes`. Rows of docs stay as they are and keep
    every column, whatever its name but `into`. Null and empty texts have no words; null and empty items have no window;
    a null item_id counts as the empty string; repeated items are one if their ids are equal; an empty
    table of items finds nothing.
    """
    spark = docs.sparkSession
    blocks = blocks_of(items, item_text, item_id, window, block_bytes)
    found: list[Column] = [scanner(spark, block, window)(F.col(text)) for block in blocks]
    if len(found) == 1:
        return docs.withColumn(into, found[0])
    names = [f"__{into}_{i}" for i in range(len(found))]
    out = docs.select("*", *[c.alias(n) for c, n in zip(found, names)])
    return out.withColumn(into, F.struct(
        F.col(f"{names[0]}.n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.hits") for n in names])))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names])))).alias("items"),
    )).drop(*names)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a window of any item, with their columns."""
    return find_passages(docs, items, into="__found").where(F.size("__found.hits") == 0).drop("__found")


WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + least(len(w), 10) - 1 AS BIGINT)), ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
gram AS (
  SELECT r, i, k, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + k - 1 AS BIGINT)), ' ') AS p
  FROM (SELECT r, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS i FROM doc, (SELECT DISTINCT k FROM pattern))),
match AS (SELECT r, i, gram.k AS k, item FROM gram JOIN pattern USING (p) WHERE gram.k = pattern.k),
hit AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(i, i + k)) AS word FROM (SELECT DISTINCT r, i, k FROM match)) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM match GROUP BY r)
SELECT doc.doc_id AS doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query("op4_decontamination", SQL)
def op4(spark, sf_dir):
    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), F.size("found.hits").cast("bigint").alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.hits") > 0).alias("contaminated"),
    )
