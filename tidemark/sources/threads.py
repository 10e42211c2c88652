"""Unpacked thread archives: one JSON file per tweet, the folders name event, label and case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.text import first_non_blank, host_name, title_of
from tidemark.functions.times import parse_tweet_time
from tidemark.schema import TWEET

# The two folder layouts.
_FLAT = r"(?:^|/)pheme-rnr-dataset/([^/]+)/([^/]+)/([^/]+)/(source-tweet|reactions)/([^/]+)"
_NESTED = r"(?:^|/)all-rnr-annotated-threads/([^/]+)/([^/]+)/([^/]+)/(annotation\.json|structure\.json|(?:source-tweets|reactions)/[^/]+)"
CASE = ["archive_type", "event_name", "label", "external_case_id"]


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def _label(raw: Column) -> Column:
    clean = F.lower(F.trim(raw))
    return (
        F.when(clean.isin("rumours", "rumour"), "rumour")
        .when(clean.isin("non-rumours", "nonrumour", "non-rumour", "non_rumour"), "non_rumour").otherwise(clean)
    )


def thread_entries(files: DataFrame, events: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Files with what their path says about them; junk and unknown files are left out."""
    path = F.col("path")
    flat = F.regexp_extract(path, _FLAT, 1) != ""
    part = lambda i: F.when(flat, F.regexp_extract(path, _FLAT, i)).otherwise(F.regexp_extract(path, _NESTED, i))
    leaf = part(4)
    junk = F.contains(path, F.lit("._")) | F.contains(path, F.lit(".DS_Store"))
    rows = files.where(~junk).select(
        "path", "value", F.when(flat, "rnr").otherwise("veracity").alias("archive_type"),
        F.regexp_replace(part(1), "-all-rnr-threads$", "").alias("event_name"), _label(part(2)).alias("label"),
        part(3).alias("external_case_id"),
        F.when(leaf.startswith("source-tweet"), "source").when(leaf.startswith("reactions"), "reaction")
        .when(leaf == "annotation.json", "annotation").when(leaf == "structure.json", "structure").alias("entry_type"),
    ).where(F.col("entry_type").isNotNull())
    if events:
        rows = rows.where(F.col("event_name").isin(events))
    if labels:
        rows = rows.where(F.col("label").isin(labels))
    return rows


def thread_cases(entries: DataFrame, as_of: Column, limit: int = 0) -> DataFrame:
    """One row per case with a source tweet: times, title, counts, annotation and structure."""
    kind = F.col("entry_type")
    tweet = F.from_json("value", TWEET)
    is_tweet = kind.isin("source", "reaction")
    rows = entries.select(
        *CASE, "entry_type", "path", F.when(kind.isin("annotation", "structure", "source"), F.col("value")).alias("value"),
        F.when(is_tweet, parse_tweet_time(tweet["created_at"], as_of)).alias("at"))
    newest = lambda k: F.max_by(F.when(kind == k, F.col("value")), F.when(kind == k, F.col("path"))).alias(k)
    grouped = rows.groupBy(*CASE).agg(
        newest("source"), newest("annotation"), newest("structure"), F.count_if(kind == "reaction").alias("reaction_count"),
        F.min("at").alias("first_event_at"), F.max("at").alias("last_event_at"),
    ).where(F.col("source").isNotNull())
    if limit > 0:
        grouped = grouped.orderBy(*CASE).limit(limit)
    root = F.from_json("source", TWEET)
    return grouped.select(
        *CASE, title_of(root["text"]).alias("title"), root["id_str"].alias("root_post_external_id"), F.lit("closed").alias("status"),
        F.col("first_event_at").alias("opened_at"), F.col("last_event_at").alias("closed_at"), "first_event_at", "last_event_at",
        "reaction_count", "annotation", "structure",
    )


def thread_posts(entries: DataFrame, cases: DataFrame, as_of: Column, dataset: str = "threads", split: str = "", source_id: int = 1) -> DataFrame:
    """Tweets of kept cases as canonical posts, with tags and links as arrays."""
    tweets = entries.where(F.col("entry_type").isin("source", "reaction")).join(cases.select(*CASE), CASE, "left_semi")
    t = F.from_json("value", TWEET)
    user = t["user"]
    account = first_non_blank(F.trim(user["id_str"]), F.concat(F.lit("author:"), t["id_str"]))
    username = first_non_blank(F.trim(user["screen_name"]), F.concat(F.lit("user_"), account))
    tags = F.filter(F.transform(t["entities"]["hashtags"], lambda h: h["text"]), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    links = F.transform(
        F.filter(t["entities"]["urls"], lambda u: (clean(u["url"]) != "") | (clean(u["expanded_url"]) != "")),
        lambda u: F.struct(
            first_non_blank(clean(u["url"]), clean(u["expanded_url"])).alias("url"), clean(u["expanded_url"]).alias("expanded_url"),
            host_name(first_non_blank(clean(u["expanded_url"]), clean(u["url"]))).alias("domain")))
    zero = F.lit(0)
    return tweets.select(
        *CASE, F.lit(source_id).alias("source_id"), t["id_str"].alias("external_id"), account.alias("account_external_id"),
        username.alias("username"), first_non_blank(F.trim(user["name"]), username).alias("display_name"),
        F.coalesce(t["text"], F.lit("")).alias("content"), F.coalesce(t["lang"], F.lit("")).alias("language"),
        parse_tweet_time(t["created_at"], as_of).alias("published_at"),
        F.coalesce(t["favorite_count"], zero).alias("likes_count"), F.coalesce(t["retweet_count"], zero).alias("reposts_count"),
        F.lit(0).alias("replies_count"), F.coalesce(user["followers_count"], zero).alias("followers_count"),
        F.coalesce(user["friends_count"], zero).alias("following_count"), F.coalesce(user["verified"], F.lit(False)).alias("is_verified"),
        (F.col("entry_type") == "source").alias("is_case_root"), clean(t["in_reply_to_status_id_str"]).alias("reply_to_external_id"),
        F.concat_ws(":", F.lit(dataset), "event_name", "label", "external_case_id", t["id_str"]).alias("raw_payload_ref"),
        F.sha2("value", 256).alias("raw_payload_hash"), F.lit(dataset).alias("dataset_name"), F.lit(split).alias("dataset_split"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), links.alias("links"),
    )
