"""Runs of words that repeat with a period: suffix trees of the words and of their reversal answer how far a Lyndon root extends."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import query, table
from tidemark.llm.merkle import sql_crc32

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words that are cut from a text at a time, bytes of text that are looked through together, and words of pieces that share
#: a pair of trees. They only batch the work: a longer text or piece is taken whole.
CHUNK_WORDS, CHUNK_BYTES, TREE_WORDS = 1 << 16, 4_000_000, 100_000


# --- suffix tree


def ukkonen(s: list[int], letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree of `s` (numbers below `letters`; the last one occurs once) as its edges, ordered by parent and letter:
    parent, child, length. A child below 0 is a leaf: -1 - k for the suffix that begins at k. The fourth: letters."""
    n = len(s)
    begin, end, link = array("q", [0]), array("q", [0]), array("q", [0])  # of inner nodes; the root is 0
    leaf_begin = array("q")
    edges: dict[int, int] = {}
    node = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        fresh = 0
        while rest:
            if not length:
                edge = i
            key = node * letters + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = -1 - len(leaf_begin)
                leaf_begin.append(i)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                first = begin[child] if child > 0 else leaf_begin[-1 - child]
                if child > 0 and length >= (size := end[child] - first):
                    edge += size
                    length -= size
                    node = child
                    continue
                if s[first + length] == c:
                    if fresh and node:
                        link[fresh] = node
                    length += 1
                    break
                new = len(begin)
                begin.append(first)
                end.append(first + length)
                link.append(0)
                edges[key] = new
                edges[new * letters + c] = -1 - len(leaf_begin)
                leaf_begin.append(i)
                edges[new * letters + s[first + length]] = child
                if child > 0:
                    begin[child] = first + length
                else:
                    leaf_begin[-1 - child] = first + length
                if fresh:
                    link[fresh] = new
                fresh = new
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    order = np.argsort(keys)
    keys = keys[order]
    child = np.fromiter(edges.values(), np.int64, len(edges))[order]
    sizes = np.frombuffer(end, np.int64) - np.frombuffer(begin, np.int64)
    length_of = np.where(child > 0, sizes[np.maximum(child, 0)], n)
    return keys // letters, child, length_of, keys % letters


def tour(parent: np.ndarray, child: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The Euler tour of a tree whose edges come by parent, kept where it gets to a leaf: the suffixes in the order of the tour, and
    for each the depth of the highest node on the way from the leaf before, which is their lowest common ancestor."""
    inner = int(parent[-1]) + 1
    first = np.searchsorted(parent, np.arange(inner + 1)).tolist()
    child, length = child.tolist(), length.tolist()
    depth = [0] * inner
    order, low = array("q"), array("q")
    cursor = first[:-1]
    path, node, at, high = [], 0, 0, 0
    stop = first[1]
    e = first[0]
    while True:
        if e < stop:
            c = child[e]
            if c < 0:
                order.append(-1 - c)
                low.append(high)
                high = at
                e += 1
            else:
                cursor[node] = e + 1
                path.append(node)
                at = depth[c] = at + length[e]
                node, e, stop = c, first[c], first[c + 1]
        else:
            if not path:
                break
            node = path.pop()
            at = depth[node]
            high = min(high, at)
            e, stop = cursor[node], first[node + 1]
    return np.frombuffer(order, np.int64), np.frombuffer(low, np.int64)


class CommonPrefixes:
    """Length of the common prefix of two suffixes in constant time: the depth of their lowest common ancestor, as the
    least depth between their places in the tour, from a table of least values over powers of two."""

    def __init__(self, order: np.ndarray, low: np.ndarray):
        n = len(order)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.table = [low.astype(np.int32)]
        while (half := 1 << (len(self.table) - 1)) * 2 <= n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For every suffix the next one that is smaller: up to there goes the longest Lyndon word that begins with it."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(pieces: list[np.ndarray], min_length: int, min_exponent: int) -> np.ndarray:
    """All runs of the pieces (words as numbers): rows (piece, start, length, period), by piece, start and period.

    The pieces stand one after the other with a letter of its own after each, smaller than any word. Every run has a
    Lyndon root, for the order of the words or for the reverse one, that begins somewhere in it and is the longest Lyndon word
    there; each of these is extended as far as its period goes, to the right and to the left.
    """
    m = len(pieces)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1) - 1
    words, ids = np.unique(np.concatenate(pieces), return_inverse=True)
    s = np.empty(int(ends[-1]) + 1, np.int64)
    within = np.ones(len(s), bool)
    within[ends] = False
    s[within] = ids + m
    s[ends] = np.arange(m)
    n, letters = len(s), m + len(words)
    parent, child, length, letter = ukkonen(s.tolist(), letters)
    order, low = tour(parent, child, length, n)
    ahead = CommonPrefixes(order, low)
    ends_first = np.where(letter < m, letter, 2 * letters - letter)  # the words in reverse order
    other = np.lexsort((ends_first, parent))
    order, _ = tour(parent, child[other], length[other], n)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    roots = [np.stack([np.arange(n), np.array(next_smaller(r.tolist()))]) for r in (ahead.rank, rank)]
    i, j = np.unique(np.concatenate(roots, axis=1), axis=1)
    piece = np.searchsorted(ends, i)
    # a root starts on a word and is short enough for its piece
    fit = within[i] & (j < n) & ((j - i) * min_exponent <= sizes[piece])
    i, j, piece = i[fit], j[fit], piece[fit]
    if not len(i):
        return np.empty((0, 4), np.int64)
    # reversed, every piece has its end letter before it; one more letter ends the whole
    back = s[::-1].tolist() + [letters]
    parent, child, length, _ = ukkonen(back[1:], letters + 1)
    behind = CommonPrefixes(*tour(parent, child, length, n))
    # s[x] stands at n - 2 - x of the reversal without the last letter of s; what ends before i starts at n - 1 - i
    start = i - behind(n - 1 - i, n - 1 - j)
    period, size = j - i, j + ahead(i, j) - start
    long = size >= np.maximum(min_length, min_exponent * period)
    first = (ends - sizes)[piece]
    return np.unique(np.stack([piece, start - first, period, size], axis=1)[long], axis=0)[:, [0, 1, 3, 2]]


# --- documents


def gram_size(min_length: int, min_exponent: int) -> int:
    """Longest gram of which every place in a run has an equal one a period away within the run."""
    return min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, max(min_length, 2) + 1))


MIX = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(3)]


def periodic_places(ids: np.ndarray, segment: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Places of the words that may be in a run. Nothing is lost: within a run every gram stands again at most a period away, and
    that is the segment's length by `min_exponent` at most. What is left falls into smaller segments, which are looked at again."""
    gram = gram_size(min_length, min_exponent)
    place = np.arange(len(ids))
    while len(place):
        cut = np.flatnonzero((np.diff(segment) != 0) | (np.diff(place) != 1)) + 1
        bounds = np.concatenate([[0], cut, [len(place)]])
        number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        size = np.diff(bounds)[number]
        code = number.astype(np.uint64) * np.uint64(MIX[1])
        usable = len(place) - gram + 1
        if usable <= 0:
            return place[:0]
        code = code[:usable]
        for k in range(gram):
            code = (code ^ ids[place[k:k + usable]].astype(np.uint64)) * np.uint64(MIX[0])
            code ^= code >> np.uint64(29)
        whole = np.flatnonzero((number[:usable] == number[gram - 1:]) & (size[:usable] >= min_length))
        order = whole[np.argsort(code[whole], kind="stable")]
        again = (code[order[1:]] == code[order[:-1]]) & (order[1:] - order[:-1] <= size[order[1:]] // min_exponent)
        again &= number[order[1:]] == number[order[:-1]]
        covered = np.zeros(len(place) + 1, np.int64)
        for at in (order[1:][again], order[:-1][again]):
            np.add.at(covered, at, 1)
            np.add.at(covered, at + gram, -1)
        keep = np.cumsum(covered[:-1]) > 0
        kept = int(keep.sum())
        segment = number[keep]
        place = place[keep]
        if kept == len(keep):
            break
    return place


def words_in(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    while True:
        words = text.split(None, CHUNK_WORDS)
        if len(words) <= CHUNK_WORDS:
            yield words
            return
        text = words.pop()
        yield words


def analyse(texts: list[bytes], min_length: int, min_exponent: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs (start, length, period) and collapsed text of each of some texts."""
    number: dict[bytes, int] = {}
    ids, counts = array("q"), []
    for text in texts:
        before = len(ids)
        for words in words_in(text):
            ids.extend([number.setdefault(w, len(number)) for w in words])
        counts.append(len(ids) - before)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ids = np.frombuffer(ids, np.int64) if len(ids) else np.empty(0, np.int64)
    document = np.repeat(np.arange(len(texts)), counts)
    place = periodic_places(ids, document, min_length, min_exponent)
    found = []
    if len(place):
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(document[place]) != 0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])
        share = (np.cumsum(ends - starts) - 1) // TREE_WORDS
        for group in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(share)) + 1):
            at = place[starts[group]]
            runs = runs_of([ids[a:a + n] for a, n in zip(at.tolist(), (ends - starts)[group].tolist())], min_length, min_exponent)
            runs[:, 1] += at[runs[:, 0]]
            found.append(runs[:, 1:])
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    of = np.searchsorted(runs[:, 0], bounds)  # runs come by place, so by document
    for k, text in enumerate(texts):
        own = runs[of[k]:of[k + 1]] - [bounds[k], 0, 0]
        stays = kept[bounds[k]:bounds[k + 1]]
        done, parts = 0, []
        for words in words_in(text):
            parts += compress(words, stays[done:done + len(words)]) if len(own) else words
            done += len(words)
        yield counts[k], own, b" ".join(parts)


def finder(min_length: int, min_exponent: int):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"

    @F.arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, texts, size = [], [], 0
            for text in batch.cast(pa.binary()).to_pylist():
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    rows += analyse(texts, min_length, min_exponent)
                    texts, size = [], 0
            rows += analyse(texts, min_length, min_exponent) if texts else []
            runs = np.concatenate([r for _, r, _ in rows] or [np.empty((0, 3), np.int64)])
            flat = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(run))
            offsets = np.concatenate([[0], np.cumsum([len(r) for _, r, _ in rows])]).astype(np.int32)
            yield pa.StructArray.from_arrays(
                [pa.array([n for n, _, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                 pa.array([t for _, _, t in rows], pa.binary()).cast(pa.string())],
                names=["n_words", "runs", "collapsed"],
            )

    return find


def find_runs(docs: DataFrame, text: str = "text", into: str = "periodic", min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """`docs` with a struct column `into`: n_words; runs (start, length, period in words, by start and period); collapsed.

    Words are cut at white space and compared byte by byte. A run is a stretch of words with smallest period q (words q
    apart are equal) and at least `min_length` words and `min_exponent` (2 or more) periods, which no neighbouring word extends. `collapsed`
    is the text without the words that some run contains after its first period, words joined by one blank.

    Whole texts are searched, whatever their length. Words that no run can hold (see `periodic_places`) are set aside first; the
    trees are built for the other pieces. Memory is bounded by the longest text: about 150 bytes a word of its, and
    about 600 more a word of its longest periodic piece. Null, empty and blank texts have no words and no runs.
    Rows are independent and stay where they are: repeated rows get equal results, an empty table gives no rows, columns may have any
    name but `into`.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    return docs.withColumn(into, finder(min_length, min_exponent)(F.coalesce(F.col(text), F.lit(""))))


# --- the query: some documents get periodic ends first


def with_periodic_ends(text: Column, doc_id: Column) -> Column:
    """An array with the text; one document in ten, by its id, gets the words from some place on replaced by the first ones from
    there, again and again."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.when(n > 0, g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(w, F.when(i > a, a + (i - 1 - a) % p + 1).otherwise(i))), " ")

    # bound once, as the only element of an array
    once = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))
    return F.when(h % 10 == 0, once).otherwise(F.array(text))


SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {sql_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
spot AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM doc),
ends AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM spot),
text AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(len(w))] END AS w FROM ends),
word AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i, len(w) AS n FROM text),
pair AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pair),
stretch AS (SELECT r, min(i) AS s, count(*) + q AS l, q FROM isle GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, l, min(q) AS q FROM stretch GROUP BY r, s, l),
summary AS (SELECT r, count(*) AS n_runs, min({{'l': -l, 's': s, 'q': q}}) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS collapsed FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(-best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * -best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM text LEFT JOIN summary USING (r) LEFT JOIN kept USING (r)
"""


@query("op11_periodic_runs", SQL)
def op11(spark, sf_dir):
    # exploded: Spark takes no function with a lambda as the argument of a Python function
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(with_periodic_ends(F.col("text"), F.col("doc_id"))).alias("text"))
    found = find_runs(docs)
    runs = F.col("periodic.runs")
    listed = F.transform(runs, lambda r: F.concat(*[x for f in ("start", "length", "period") for x in (r[f].cast("string"), F.lit("," if f != "period" else "\n"))]))
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"), best.alias("best"),
    ).select("doc_id", "n_runs", "best.start", (-F.col("best.less")).alias("length"), "best.period",
             F.floor(1000 * -F.col("best.less") / F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
