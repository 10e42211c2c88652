"""Repeated lines across documents, by levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import BLANKS, identity, new_folder, query, staged, table

MIN_CHARS = 20
MIN_DOCS = 3
#: Batches the documents arrive in, and runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 4, 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; the built-in lower() does that for ASCII lines."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class Runs:
    """Sorted runs of (h, n_docs, keeper), one row per hash in each, in levels.

    `keeper` is set in the run in which a hash was new; later runs only add to its n_docs. Runs are tables
    bucketed and sorted by hash, so neither an anti-join with a run nor its compaction shuffles the run.
    """

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "run")
        name = "run_" + path.rsplit("-", 1)[1]
        rows.select("ha", "hb", "n_docs", "keeper").repartition(self.buckets, "ha").sortWithinPartitions("ha", "hb") \
            .write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, "ha").sortBy("ha", "hb").saveAsTable(name)
        return self.spark.table(name)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch (ha, hb, n_docs, keeper), a row per hash; returns the rows whose hash no earlier batch had."""
        runs = [r.select("ha", "hb") for r in self.all()]
        fresh = reduce(lambda left, run: left.join(run.hint("merge"), ["ha", "hb"], "left_anti"), runs, batch)
        own = fresh
        if runs:
            seen = reduce(DataFrame.union, runs)
            known = batch.join(seen.hint("merge"), ["ha", "hb"], "left_semi")
            own = fresh.unionByName(known.withColumn("keeper", F.lit(None).cast(batch.schema["keeper"].dataType)))
        run, level = self._write(own), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return fresh
            run, self.levels[level] = self._write(self.merged(self.levels[level])), []
            level += 1

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("ha", "hb") \
            .agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def with_batches(lines: DataFrame, batches: int) -> DataFrame:
    """Batch 0 has the largest ids and the last one the smallest and null: the first batch with a hash has its keeper."""
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(lines.agg(F.percentile_approx("id", shares)).first()[0] or []) if shares else [], reverse=True)
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("id") >= F.lit(cut), F.lit(i)).otherwise(batch)
    return lines.withColumn("batch", batch)


def without(lines: Column, drops: Column) -> Column:
    """The lines but those at the sorted positions `drops`: the slices between them."""
    def piece(i):
        start = F.coalesce(F.get(drops, i - 1) + 1, F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(F.get(drops, i), F.size(lines)) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), piece))


def drop_repeated_lines(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", into: str = "lines",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The columns `carry` of every row with a struct `into`: text (the lines that stay, joined by \\n), n_lines, n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of `min_chars` code points
    found in `min_docs` documents lose their lines in all documents but that with the largest id; there all of
    them stay. Rows with one id are one document, also if the id is null, which is smaller than any other. Null
    and empty texts are one empty line. Repeated rows lose the same lines. An empty table gives no rows. Columns of
    `docs` may have any name but `into`. doc_id must be a number.

    Lines are 128-bit hashes, written once with their documents' 128 bits. Batches, largest ids first, pass through
    the runs; a frequent line is summed up before each shuffle. Only small rows are exploded: texts meet the
    positions they lose in one join, whose sides Spark splits where a line or document is frequent.
    """
    own = identity(doc_id, text)
    lines = docs.select(own.alias("doc"), F.col(doc_id).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")))
    lines = lines.select("doc", "id", "pos", line_key(F.col("col")).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("doc", "id", "pos", F.xxhash64(F.lit(1), "key").alias("ha"), F.xxhash64(F.lit(2), "key").alias("hb"))
    lines = staged(lines, "lines")
    runs, batched = Runs(docs.sparkSession), with_batches(lines, batches)
    for b in range(batches):
        held = batched.where(F.col("batch") == b).select("ha", "hb", "id").distinct()
        runs.add(held.groupBy("ha", "hb").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")))
    # sums are written before they are joined: Spark then splits the rows of a frequent line or document among tasks
    frequent = staged(Runs.merged(runs.all()).where(F.col("n_docs") >= min_docs).select("ha", "hb", "keeper"), "frequent")
    drops = staged(lines.join(frequent, ["ha", "hb"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
                   .groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("drops")), "drops")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), own.alias("doc"),
                       F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("all"))
    kept = F.when(F.col("drops").isNull(), F.col("all")).otherwise(without(F.col("all"), F.col("drops")))
    return rows.join(drops, "doc", "left").select("row.*", F.struct(
        F.array_join(kept, "\n").alias("text"), F.size("all").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    ).alias(into))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT r, k.doc_id AS doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


@query("op10_line_dedup", SQL)
def op10(spark, sf_dir):
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return kept.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))
