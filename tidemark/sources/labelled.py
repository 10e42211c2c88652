"""Labelled post titles with comments, predictions of offline models, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.scores import fixed, risk_level
from tidemark.functions.text import collapse_spaces, strip_space
from tidemark.sources.posts import read_lines

# Required columns.
POST_COLUMNS = ["id", "clean_title", "title", "2_way_label", "subreddit", "score", "num_comments", "upvote_ratio", "hasImage"]
COMMENT_COLUMNS = ["submission_id", "body", "ups"]


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated files with a header; lines with fewer or more fields than the header are dropped, whatever columns are read later."""
    found = spark.read.csv(path, sep="\t", header=True, quote="").drop(*_partitions(spark, path)).columns
    missing = sorted(set(columns) - set(found))
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    kind = ", ".join(f"`{c}` string" for c in found)
    lines = spark.read.text(path).select("value").where(F.col("value") != "\t".join(found))
    fields = F.from_csv("value", f"{kind}, __broken string", {"sep": "\t", "quote": "\u0000", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    whole = lines.where(F.regexp_count("value", F.lit("\t")) == len(found) - 1).select(fields.alias("f"))
    return whole.where("f.__broken IS NULL").select(*[F.col(f"f.`{c}`").alias(c) for c in columns])


def _partitions(spark: SparkSession, path: str) -> list[str]:
    """Names of folders `name=value` below the path: columns that stand in no line."""
    return [c for c in spark.read.text(path).columns if c != "value"]


def labelled_posts(rows: DataFrame, positive_label: int = 0) -> DataFrame:
    """Rows with a numeric label and a title; the cleaned title goes before the raw one."""
    clean = lambda c: strip_space(F.coalesce(c, F.lit("")))
    text = F.when(clean("clean_title") != "", clean("clean_title")).otherwise(clean("title"))
    raw = F.col("2_way_label").try_cast("double").cast("int")
    out = rows.withColumns({"text": text, "label_raw": raw}).where(F.col("label_raw").isNotNull() & (F.col("text") != ""))
    return out.withColumn("label", (F.col("label_raw") == positive_label).cast("int")).drop("clean_title", "title", "2_way_label")


def top_comments(comments: DataFrame, posts: DataFrame, k: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Comments of each wanted post by votes, with spaces collapsed: all of them or the first k, whole or cut to `max_chars`.

    Votes that are no number count as 0. The row-number filter works before the shuffle.
    """
    body = collapse_spaces(F.coalesce("body", F.lit("")))
    own = comments.select(
        F.trim("submission_id").alias("id"), F.coalesce(F.col("ups").try_cast("double"), F.lit(0.0)).alias("ups"), body.alias("body"),
    ).where(F.col("body") != "")
    if max_chars is not None:
        own = own.withColumn("body", F.substring("body", 1, max_chars))
    own = own.join(posts.select("id"), "id", "left_semi")
    w = Window.partitionBy("id").orderBy(F.desc("ups"), F.asc("body"))
    ranked = own.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def attach_comments(posts: DataFrame, top: DataFrame) -> DataFrame:
    """Title and its best comments as one text. The collected list has at most k entries."""
    lists = top.groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "body"))), lambda c: c["body"]), " ").alias("comments_text"),
        F.count("*").alias("comment_count_used"))
    joined = posts.join(lists, "id", "left").na.fill({"comments_text": "", "comment_count_used": 0})
    return joined.withColumn("text_with_comments", F.when(
        F.col("comments_text") != "", F.concat("text", F.lit(" [COMMENTS] "), "comments_text")).otherwise(F.col("text")))


def summary_of(posts: DataFrame, by: str | None = None) -> DataFrame:
    """Rows, positives, subreddits and comment coverage; distinct subreddits by a first sum per subreddit."""
    keys = [by] if by else []
    used = F.col("comment_count_used") if "comment_count_used" in posts.columns else F.lit(0)
    per = posts.groupBy(*keys, F.coalesce("subreddit", F.lit("")).alias("subreddit")).agg(
        F.count("*").alias("n"), F.sum("label").alias("pos"), F.count_if(used > 0).alias("covered"), F.sum(used).alias("used"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("positive_rows"), (F.sum("pos") / F.sum("n")).alias("positive_rate"),
        F.count("*").alias("subreddit_count"), (F.sum("covered") / F.sum("n")).alias("comment_coverage_rate"),
        (F.sum("used") / F.sum("n")).alias("mean_comment_count_used"))


def sample_posts(posts: DataFrame, max_rows: int, balanced: bool, seed: int = 42) -> DataFrame:
    """At most `max_rows`, by a hash of the id; balanced takes half per class and fills up from the rest."""
    pick = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    ordered = posts.withColumn("__pick", pick)
    if not balanced:
        return ordered.orderBy("__pick", "id").limit(max_rows).drop("__pick")
    half = max_rows // 2
    w = Window.partitionBy("label").orderBy("__pick", "id")
    # no class can contribute more than max_rows, so the row-number filter bounds each class before the shuffle
    near = ordered.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_rows)
    return near.orderBy(F.when(F.col("__rn") <= half, 0).otherwise(1), "__pick", "id").limit(max_rows).drop("__pick", "__rn")


# -- predictions ----------------------------------------------------------------------------------


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, and a column `place` that orders their lines as they stand."""
    columns = [c for c in spark.read.csv(path, header=True).columns if c not in _partitions(spark, path)]
    lines = read_lines(spark, path).where("line_no > 1")
    fields = F.from_csv("value", ", ".join(f"`{c}` string" for c in columns)).alias("f")
    return lines.select(fields, F.struct("file", "line_no").alias("place")).select("f.*", "place")


def import_predictions(
    rows: DataFrame, cases: DataFrame, scorer_key: str, model_version: str, threshold: float = 0.5,
    probability: str = "oof_probability", order: str = "line_no", pipeline_hash: Column | None = None,
) -> DataFrame:
    """Predictions of known cases as rows of the table of model scores; the last line of a case wins."""
    missing = {"case_id", probability} - set(rows.columns)
    if missing:
        raise ValueError(f"predictions lack columns {sorted(missing)}")
    p = F.col(probability).try_cast("double")
    valid = rows.withColumns({"case_id": F.col("case_id").try_cast("bigint"), "__p": p}).where("case_id IS NOT NULL AND __p IS NOT NULL")
    last = valid.groupBy("case_id").agg(F.max_by(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__p")), order).alias("risk_score"))
    known = last.join(cases.select("case_id"), "case_id", "left_semi")
    s = F.col("risk_score")
    evidence = F.array(
        F.lit(f"Offline OOF probability imported for {model_version}."),
        F.concat(F.lit("Score="), fixed(s, 4), F.lit("; threshold="), fixed(F.lit(threshold), 4), F.lit(".")))
    return known.select(
        "case_id", F.lit(scorer_key).alias("scorer_key"), F.lit(model_version).alias("model_version"), "risk_score",
        risk_level(s).alias("risk_level"), F.greatest(s, 1 - s).alias("confidence_score"), evidence.alias("evidence"),
        (pipeline_hash if pipeline_hash is not None else F.sha2(F.lit(f"{scorer_key}|{model_version}|{threshold}"), 256)).alias("pipeline_hash"),
        F.lit("offline_oof_import").alias("source_endpoint"),
    )


def unknown_predictions(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Ids in the predictions that no case has; a strict import stops when there are any."""
    ids = rows.select(F.col("case_id").try_cast("bigint").alias("case_id")).where("case_id IS NOT NULL").distinct()
    return ids.join(cases.select("case_id"), "case_id", "left_anti")


# -- exports --------------------------------------------------------------------------------------


def write_predictions(rows: DataFrame, path: str, score: str = "probability") -> None:
    """CSV ordered by score. The order is a range over files, not one sorted file."""
    rows.orderBy(F.desc(score)).write.csv(path, header=True)


def preview(rows: DataFrame, n: int, score: str = "probability", text: str = "text", key: str = "id") -> DataFrame:
    """The n best rows with the text cut for display."""
    top = rows.orderBy(F.desc(score), F.asc(key)).limit(n)
    return top.withColumn(text, F.substring(text, 1, 240))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
