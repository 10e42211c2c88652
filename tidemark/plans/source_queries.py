"""Sources, sinks and streams by name. Their input is derived from the given tables by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import case_features as C, reports as R
from tidemark.operators import upsert as U
from tidemark.operators.case_text import case_texts
from tidemark.plans.post_queries import LEX_COLS, lexicon_sql
from tidemark.plans.registry import big, query, r6, stamp
from tidemark.plans.tables import SCORERS, Tables
from tidemark.plans.tables_sql import STAMP
from tidemark.session import shared_folder
from tidemark.sources import accounts as A, labelled as B, live, posts as P, threads as H
from tidemark.streaming import jobs as J

S = STAMP
AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# -- JSON lines -------------------------------------------------------------------------------------


def json_lines(t: Tables):
    """One line per post; every kind of post uses other field names, one kind is broken JSON."""
    c = F.col
    at = lambda pattern: F.date_format("published_at", pattern)
    user = F.concat(F.lit("u"), c("account_id").cast("string"))
    shapes = {
        "purchase": F.to_json(F.struct(
            c("post_id").alias("id"), user.alias("username"), c("content").alias("text"), at("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
            c("likes_count"), c("reposts_count"), c("replies_count"), c("language").alias("lang"))),
        "click": F.to_json(F.struct(
            F.lit(" ").alias("id"), c("external_id"), user.alias("author"), c("content"), at("yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            c("likes_count").cast("string").alias("likes"), (c("reposts_count") + 0.75).alias("reposts"), F.lit("many").alias("replies"), c("language"))),
        "view": F.to_json(F.struct(
            c("external_id").alias("post_id"), user.alias("user"), c("content").alias("body"), at("yyyy-MM-dd").alias("created_at"),
            c("reposts_count").alias("retweets"), F.lit("x").alias("display_name"))),
        "signup": F.to_json(F.struct(F.lit("").alias("id"), c("content"), F.lit("yesterday").alias("published_at"), F.lit(True).alias("likes"))),
        "error": F.concat(F.lit('{"id": "'), c("external_id")),
    }
    line = F.lit(None).cast("string")
    for kind, shape in shapes.items():
        line = F.when(c("kind") == kind, shape).otherwise(line)
    return t.posts().select((c("post_id") + 1).alias("line_no"), line.alias("value"))


@query("s1_s3_json_lines", views="posts", sql=f"""
SELECT post_id + 1 AS line_no, CASE kind WHEN 'purchase' THEN '' || post_id WHEN 'signup' THEN 'dataset-row-' || (post_id + 1) ELSE external_id END AS external_id,
  CASE WHEN kind = 'signup' THEN 'dataset_actor' ELSE 'u' || account_id END AS username, CASE WHEN kind = 'view' THEN 'x' ELSE '' END AS display_name,
  md5(content) AS content_md5, CASE WHEN kind IN ('purchase', 'click') THEN language ELSE '' END AS language,
  strftime(CASE kind WHEN 'signup' THEN TIMESTAMP '{AS_OF}' WHEN 'view' THEN date_trunc('day', published_at) ELSE date_trunc('second', published_at) END, {S}) AS published_at,
  CASE WHEN kind IN ('purchase', 'click') THEN likes_count ELSE 0 END AS likes_count, CASE WHEN kind = 'signup' THEN 0 ELSE reposts_count END AS reposts_count,
  CASE WHEN kind = 'purchase' THEN replies_count ELSE 0 END AS replies_count, 'demo:train:line=' || (post_id + 1) AS raw_payload_ref FROM posts WHERE kind <> 'error'""")
def s1(t: Tables):
    out = P.posts_from_lines(json_lines(t), "demo", "train", as_of())
    return out.select(big("line_no").alias("line_no"), "external_id", "username", "display_name", F.md5("content").alias("content_md5"), "language",
                      stamp("published_at").alias("published_at"), "likes_count", "reposts_count", "replies_count", "raw_payload_ref")


@query("s1_line_counts", views="posts", sql="SELECT count(*) FILTER (WHERE kind <> 'error') AS processed, count(*) FILTER (WHERE kind = 'error') AS failed FROM posts")
def s1_counts(t: Tables):
    return P.line_counts(json_lines(t))


# -- thread archive ---------------------------------------------------------------------------------


def archive_files(t: Tables):
    """Unpacked archive: tweets of every case in one of the two layouts, with annotations and junk."""
    c = F.col
    when = F.concat(F.date_format("published_at", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("published_at", "yyyy"))
    parent = F.concat(F.lit("p"), c("reply_to_post_id").cast("string"))
    tweet = F.to_json(F.struct(
        c("external_id").alias("id_str"), when.alias("created_at"), c("content").alias("text"), c("language").alias("lang"),
        F.coalesce(parent, F.lit("")).alias("in_reply_to_status_id_str"), c("reposts_count").alias("retweet_count"), c("likes_count").alias("favorite_count"),
        F.struct(F.when(c("kind") != "error", c("account_id").cast("string")).alias("id_str"), F.lit("").alias("name"),
                 c("replies_count").alias("followers_count"), (c("kind") == "click").alias("verified")).alias("user"),
        F.struct(F.array(F.struct(c("kind").alias("text")), F.struct(F.lit(" ").alias("text"))).alias("hashtags")).alias("entities")))
    cases = t.cases().select("case_id", "event_name", "label")
    posts = t.posts(meet=lambda p: R.salted_join(p, cases, ["case_id"], "post_id").where(c("label") != ""))
    rows = posts.withColumn("tweet", tweet)
    folder = F.when(c("label") == "rumour", "rumours").otherwise("non-rumours")
    flat = c("case_id") % 2 == 0
    kind = F.when(c("is_case_root"), "source-tweet").otherwise("reactions")
    nested = F.when(c("is_case_root"), "source-tweets").otherwise("reactions")
    path = F.when(flat, F.concat_ws("/", F.lit("x/pheme-rnr-dataset"), "event_name", folder, c("case_id").cast("string"), kind, F.concat("external_id", F.lit(".json")))).otherwise(
        F.concat_ws("/", F.lit("x/all-rnr-annotated-threads"), F.concat("event_name", F.lit("-all-rnr-threads")), folder, c("case_id").cast("string"), nested,
                    F.concat("external_id", F.lit(".json"))))
    tweets = rows.select(path.alias("path"), c("tweet").alias("value"))
    base = F.regexp_replace(path, "/source-tweets?/.*$", "")
    extra = rows.where("is_case_root").select(F.explode(F.array(
        F.struct(F.concat(base, F.lit("/annotation.json")).alias("path"), F.lit('{"is_rumour": "x"}').alias("value")),
        F.struct(F.concat(base, F.lit("/source-tweet/._junk.json")).alias("path"), F.lit("junk").alias("value")),
    )).alias("f")).select("f.*")
    return tweets.unionByName(extra)


def threads(t: Tables):
    entries = H.thread_entries(archive_files(t))
    return entries, H.thread_cases(entries, as_of())


@query("s4_s5_thread_cases", views="posts cases", sql=f"""
SELECT c.case_id::VARCHAR AS external_case_id, CASE WHEN c.case_id % 2 = 0 THEN 'rnr' ELSE 'veracity' END AS archive_type, c.event_name,
  CASE WHEN c.label = 'rumour' THEN 'rumour' ELSE 'non_rumour' END AS label, 'p' || (c.case_id * 25) AS root_post_external_id, count(*) - 1 AS reaction_count,
  strftime(date_trunc('second', c.first_event_at), {S}) AS first_event_at, strftime(date_trunc('second', c.last_event_at), {S}) AS last_event_at,
  substring(trim(any_value(content) FILTER (WHERE is_case_root), E' \\t\\n\\r'), 1, 240) AS title, c.case_id % 2 <> 0 AS annotated
FROM posts p JOIN cases c USING (case_id) WHERE c.label <> '' GROUP BY c.case_id, c.event_name, c.label, c.first_event_at, c.last_event_at""")
def s4(t: Tables):
    _, cases = threads(t)
    return cases.select("external_case_id", "archive_type", "event_name", "label", "root_post_external_id", "reaction_count",
                        stamp("first_event_at").alias("first_event_at"), stamp("last_event_at").alias("last_event_at"), "title",
                        F.col("annotation").isNotNull().alias("annotated"))


@query("s6_s7_thread_posts", views="posts cases", sql=f"""
SELECT p.external_id, c.case_id::VARCHAR AS external_case_id, CASE WHEN kind <> 'error' THEN '' || account_id ELSE 'author:' || p.external_id END AS account_external_id,
  'user_' || CASE WHEN kind <> 'error' THEN '' || account_id ELSE 'author:' || p.external_id END AS display_name, md5(content) AS content_md5,
  strftime(date_trunc('second', published_at), {S}) AS published_at, likes_count::INT AS likes_count, reposts_count::INT AS reposts_count, replies_count::INT AS followers_count,
  kind = 'click' AS is_verified, is_case_root, coalesce('p' || reply_to_post_id, '') AS reply_to_external_id, kind AS tags
FROM posts p JOIN cases c USING (case_id) WHERE c.label <> ''""")
def s6(t: Tables):
    entries, cases = threads(t)
    out = H.thread_posts(entries, cases, as_of())
    return out.select("external_id", "external_case_id", "account_external_id", "display_name", F.md5("content").alias("content_md5"),
                      stamp("published_at").alias("published_at"), "likes_count", "reposts_count", "followers_count", "is_verified", "is_case_root",
                      "reply_to_external_id", F.array_join("tags", ",").alias("tags"))


# -- accounts ---------------------------------------------------------------------------------------


@query("s9_nested_accounts", views="posts", sql="""
SELECT '' || post_id AS id, CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS label, source_type AS subset_name, 'u' || account_id AS description,
  2::BIGINT AS tweets, 1.0::DOUBLE AS hashtags FROM posts WHERE kind IN ('purchase', 'click')""")
def s9(t: Tables):
    return nested_summary(nested_lines(t).select(F.from_json("value", A.NESTED).alias("r")).select("r.*"))


def nested_lines(t: Tables):
    """A record per post as a JSON line."""
    c = F.col
    label = F.when(c("kind") == "purchase", " Bot ").when(c("kind") == "click", "human").otherwise("unsure")
    user = F.struct(F.concat(F.lit("u"), c("account_id").cast("string")).alias("description"))
    tweet = lambda profile, tags: F.struct(
        profile.alias("user"), c("kind").alias("full_text"), c("external_id").alias("text"),
        F.struct(tags.alias("hashtags")).alias("entities"))
    no_user, mark = F.lit(None).cast("struct<description:string>"), F.array(F.struct(F.array(F.lit(1)).alias("indices")))
    line = F.to_json(F.struct(
        c("post_id").cast("string").alias("user_id"), label.alias("label"), c("source_type").alias("dataset"),
        F.array(tweet(no_user, mark), tweet(user, F.array().cast("array<struct<indices:array<int>>>"))).alias("user_tweets")))
    return t.posts(False).select(line.alias("value"))


def nested_summary(records):
    users, tweets = A.accounts_from_nested(records)
    counts = tweets.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("tweets"), F.sum("num_hashtags").alias("hashtags"))
    return users.join(counts, "id").select("id", "label", "subset_name", "description", "tweets", "hashtags")


@query("s8_x2_account_dataset", views="posts accounts", sql="""
SELECT subset_name, count(*) AS users, sum(tweets)::BIGINT AS tweets FROM (
  SELECT CASE WHEN is_bot THEN 'fake_followers' ELSE 'genuine_accounts' END AS subset_name, account_id, count(*) AS tweets
  FROM accounts JOIN posts USING (account_id) GROUP BY ALL) GROUP BY 1""")
def s8(t: Tables):
    users, tweets = account_dataset(t)
    unique, own = A.dataset_of(A.concat_datasets([users, users.drop("protected")]), tweets)
    per_user = own.groupBy("subset_name", "user_id").agg(F.count("*").alias("tweets"))
    joined = unique.join(per_user, (unique.id == per_user.user_id) & (unique.subset_name == per_user.subset_name), "left").drop(per_user.subset_name)
    return joined.groupBy("subset_name").agg(F.count("*").alias("users"), F.sum(F.coalesce("tweets", F.lit(0))).alias("tweets"))


def account_dataset(t: Tables):
    """Accounts and their posts in the columns of the labelled account datasets."""
    c = F.col
    subset = F.when(c("is_bot"), "fake_followers").otherwise("genuine_accounts")
    people = t.accounts()
    users = people.select(
        c("account_id").cast("string").alias("id"), c("posts_count").alias("statuses_count"), "followers_count", c("following_count").alias("friends_count"),
        (c("account_id") % 23).alias("favourites_count"), (c("account_id") % 5).alias("listed_count"),
        F.when(c("account_id") % 3 == 0, "1").otherwise("").alias("default_profile"), F.lit("").alias("default_profile_image"), F.lit("").alias("geo_enabled"),
        c("is_verified").cast("string").alias("verified"), F.lit("").alias("protected"), c("display_name").alias("description"), F.lit("").alias("url"),
        F.lit("x").alias("location"), F.when(c("account_id") % 11 != 0, c("created_at").cast("string")).alias("created_at"),
        F.lit(AS_OF).alias("updated"), subset.alias("subset_name"), c("is_bot").cast("int").alias("label"))
    marks = people.select("account_id", subset.alias("subset_name"))
    linked = t.post_links().select("post_id", F.lit(1).alias("num_urls"))
    rows = t.posts(meet=lambda posts: R.salted_join(posts, marks, ["account_id"], "post_id").join(linked, "post_id", "left"))
    tweets = rows.select(
        "subset_name", c("account_id").cast("string").alias("user_id"), c("content").alias("text"), c("kind").alias("source"),
        c("reply_to_post_id").cast("string").alias("in_reply_to_status_id"), F.when(c("kind") == "click", "7").otherwise("0").alias("retweeted_status_id"),
        c("reposts_count").alias("retweet_count"), c("replies_count").alias("reply_count"), c("likes_count").alias("favorite_count"),
        F.lit(1).alias("num_hashtags"), "num_urls", (c("kind") == "click").cast("int").alias("num_mentions"))
    return users, tweets


# -- labelled posts and predictions -----------------------------------------------------------------


def raw_labelled(t: Tables):
    c = F.col
    raw = t.raw("labels").join(t.raw("documents"), "doc_id").select(
        c("doc_id").cast("string").alias("id"), F.when(c("lang") == "en", " ").otherwise(c("text")).alias("clean_title"),
        F.concat(F.lit("title "), c("text")).alias("title"), c("toxic").cast("string").alias("2_way_label"),
        c("source").alias("subreddit"), F.lit("1").alias("score"), F.lit("2").alias("num_comments"), F.lit("0.5").alias("upvote_ratio"), F.lit("True").alias("hasImage"))
    # three more rows have a label that is none
    broken = raw.where(c("id").isin("0", "1", "2")).withColumns({"id": F.concat(F.lit("broken"), "id"), "2_way_label": F.lit("n/a")})
    return raw.unionByName(broken)


def labelled_rows(t: Tables):
    return B.labelled_posts(raw_labelled(t))


def comment_rows(t: Tables):
    ups = F.when(F.col("turn") % 5 == 4, "n/a").otherwise((F.col("turn") * 7 % 10).cast("string"))
    return t.raw("conversations").select(F.col("conv_id").cast("string").alias("submission_id"), F.col("text").alias("body"), ups.alias("ups"))


WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
LABELLED = rf"""posts AS (SELECT doc_id::VARCHAR AS id, toxic AS label_raw, (toxic = 0)::INT AS label, source AS subreddit,
  trim(regexp_replace(CASE WHEN lang = 'en' THEN 'title ' || text ELSE text END, '^{WS}|{WS}$', '', 'g')) AS text FROM labels JOIN documents USING (doc_id))"""
COMMENTS = rf"""c0 AS (SELECT conv_id::VARCHAR AS id, CASE WHEN turn % 5 = 4 THEN 0.0::DOUBLE ELSE (turn * 7 % 10)::DOUBLE END AS ups,
  substring(trim(regexp_replace(text, '{WS}', ' ', 'g')), 1, 220) AS body FROM conversations),
c1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ups DESC, body) AS rank FROM c0 WHERE body <> '' AND id IN (SELECT id FROM posts))"""


@query("s10_labelled_posts", sql=f"WITH {LABELLED} SELECT id, label_raw, label, subreddit, md5(text) AS text_md5 FROM posts")
def s10(t: Tables):
    return labelled_rows(t).select("id", "label_raw", "label", "subreddit", F.md5("text").alias("text_md5"))


@query("w9_top_comments", sql=f"WITH {LABELLED}, {COMMENTS} SELECT id, rank::INTEGER AS rank, ups, body FROM c1 WHERE rank <= 3")
def w9(t: Tables):
    return B.top_comments(comment_rows(t), labelled_rows(t), 3, 220).select("id", "rank", "ups", "body")


@query("w9_text_with_comments", sql=f"""WITH {LABELLED}, {COMMENTS}, j AS (SELECT id, string_agg(body, ' ' ORDER BY rank) AS b, count(*) AS n FROM c1 WHERE rank <= 3 GROUP BY 1)
SELECT id, md5(CASE WHEN b <> '' THEN text || ' [COMMENTS] ' || b ELSE text END) AS text_md5, coalesce(n, 0) AS comment_count_used FROM posts LEFT JOIN j USING (id)""")
def w9_text(t: Tables):
    out = B.attach_comments(labelled_rows(t), B.top_comments(comment_rows(t), labelled_rows(t), 3, 220))
    return out.select("id", F.md5("text_with_comments").alias("text_md5"), big("comment_count_used").alias("comment_count_used"))


@query("a23_dataset_summary", sql=f"""WITH {LABELLED}, {COMMENTS}, j AS (SELECT id, count(*) AS n FROM c1 WHERE rank <= 3 GROUP BY 1)
SELECT label_raw, count(*) AS rows, sum(label)::BIGINT AS positive_rows, round(avg(label), 6) AS positive_rate, count(DISTINCT subreddit) AS subreddit_count,
  round(avg((coalesce(n, 0) > 0)::INT), 6) AS comment_coverage_rate, round(avg(coalesce(n, 0)), 6) AS mean_comment_count_used FROM posts LEFT JOIN j USING (id) GROUP BY 1""")
def a23(t: Tables):
    posts = B.attach_comments(labelled_rows(t), B.top_comments(comment_rows(t), labelled_rows(t), 3, 220))
    out = B.summary_of(posts, "label_raw")
    return out.select("label_raw", "rows", "positive_rows", "subreddit_count", *[r6(c).alias(c) for c in ("positive_rate", "comment_coverage_rate", "mean_comment_count_used")])


@query("m10_balanced_sample", sql=f"""WITH {LABELLED}, r AS (SELECT *, md5('42:' || id) AS pick, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rn FROM posts)
SELECT id, label FROM r ORDER BY CASE WHEN rn <= 30 THEN 0 ELSE 1 END, pick, id LIMIT 60""")
def m10(t: Tables):
    return B.sample_posts(labelled_rows(t), 60, balanced=True).select("id", "label")


def prediction_rows(t: Tables):
    s = t.case_model_scores().where(F.col("scorer_key") != SCORERS[0])
    later = F.col("scorer_key") == SCORERS[2]
    return s.select(F.col("case_id").cast("string").alias("case_id"), (F.col("case_id") * 2 + later.cast("int")).alias("line_no"),
                    F.when(later & (F.col("case_id") % 5 == 0), "broken").otherwise((F.col("risk_score") * 1.25 - 0.1).cast("string")).alias("oof_probability"))


@query("s11_imported_predictions", views="cases case_model_scores", sql="""
WITH p AS (SELECT case_id, scorer_key, least(1.0, greatest(0.0, risk_score * 1.25::DOUBLE - 0.1::DOUBLE)) AS p FROM case_model_scores
  WHERE scorer_key <> 'case_logreg_oof' AND NOT (scorer_key = 'case_text_oof' AND case_id % 5 = 0)),
l AS (SELECT case_id, arg_max(p, scorer_key = 'case_text_oof') AS s FROM p WHERE case_id IN (SELECT case_id FROM cases WHERE status <> 'open') GROUP BY 1)
SELECT case_id, 'imported' AS scorer_key, round(s, 6) AS risk_score, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
  round(greatest(s, 1 - s), 6) AS confidence_score FROM l""")
def s11(t: Tables):
    known = t.cases().where(F.col("status") != "open")
    out = B.import_predictions(prediction_rows(t), known, "imported", "v9")
    return out.select("case_id", "scorer_key", r6("risk_score").alias("risk_score"), "risk_level", r6("confidence_score").alias("confidence_score"))


@query("s11_unknown_predictions", views="cases case_model_scores", sql="""
SELECT DISTINCT case_id FROM case_model_scores WHERE scorer_key <> 'case_logreg_oof' AND case_id IN (SELECT case_id FROM cases WHERE status = 'open')""")
def s11_unknown(t: Tables):
    return B.unknown_predictions(prediction_rows(t), t.cases().where(F.col("status") != "open"))


@query("s14_prediction_preview", sql=f"""WITH {LABELLED} SELECT id, label, round(length(text) % 997 / 997.0::DOUBLE, 6) AS probability, substring(text, 1, 240) AS text
FROM posts p ORDER BY length(p.text) % 997 DESC, id LIMIT 25""")
def s14(t: Tables):
    scored = labelled_rows(t).withColumn("probability", F.length("text") % 997 / F.lit(997.0))
    return B.preview(scored, 25).select("id", "label", r6("probability").alias("probability"), "text")


@query("s12_training_slice", views="cases case_scores posts", sql="""
SELECT c.case_id, c.event_name, (c.label = 'rumour')::INT AS label, n.event_count, round(s.temporal_score, 6) AS temporal_score
FROM cases c JOIN case_scores s USING (case_id) JOIN (SELECT case_id, count(*) AS event_count FROM posts GROUP BY 1) n USING (case_id)
WHERE c.label <> '' AND c.dataset_name = 'demo' AND c.dataset_split = 'train'""")
def s12(t: Tables):
    from tidemark.plans.model_queries import training_slice
    features = R.posts_per_case(t.posts(False)).withColumnRenamed("post_count", "event_count")
    out = training_slice(t.cases(), features, t.case_scores(), dataset_split="train")
    return out.select("case_id", "event_name", "label", "event_count", r6("temporal_score").alias("temporal_score"))


@query("schema_violations", views="case_model_scores", sql="""
WITH m AS (SELECT case_id, scorer_key, risk_score * 1.25::DOUBLE AS r, risk_level FROM case_model_scores)
SELECT case_id::VARCHAR AS key, 'risk_score is outside 0..1' AS rule FROM m WHERE r > 1 UNION ALL SELECT case_id::VARCHAR, 'risk_level is not allowed' FROM m WHERE risk_level = 'medium'""")
def violations(t: Tables):
    rows = t.case_model_scores().withColumn("risk_score", F.col("risk_score") * 1.25)
    return schema.violations(rows, "case_id", {"risk_level": ["low", "high"]}).select("key", "rule")


# -- live payloads and streams ----------------------------------------------------------------------


def statuses(t: Tables, posts=None, tags: str = "kind"):
    c = F.col
    account = F.struct(
        c("account_id").cast("string").alias("id"), F.concat(F.lit("user_"), c("account_id").cast("string")).alias("username"),
        c("likes_count").cast("int").alias("followers_count"), c("reposts_count").cast("int").alias("following_count"))
    return (t.posts() if posts is None else posts).select(
        c("external_id").alias("id"), c("published_at").alias("created_at"), c("content"), c("language"),
        F.concat(F.lit("https://live.example/"), "external_id").alias("url"), account.alias("account"), c("likes_count").cast("int").alias("favourites_count"),
        c("reposts_count").cast("int").alias("reblogs_count"), c("replies_count").cast("int").alias("replies_count"),
        F.array(F.struct(c(tags).alias("name")), F.struct(F.lit("").alias("name")), F.struct(c(tags).alias("name"))).alias("tags"))


def land(t: Tables, rows, folder: str = "") -> str:
    folder = folder or f"{shared_folder(t.spark)}/landed-{uuid.uuid4().hex}"
    rows.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").json(folder, compression="gzip")
    return folder


def streamed(t: Tables, rows, count, measure: str):
    """The newer half lands and is worked off, then the older one; the counts of all batches, summed."""
    table = f"{shared_folder(t.spark)}/windows-{uuid.uuid4().hex}"
    newer = F.coalesce(F.col("created_at") >= F.lit("2024-01-16 00:00:00").cast("timestamp"), F.lit(False))
    folder = ""
    for half in (rows.where(newer), rows.where(~newer)):
        folder = land(t, half, folder)
        posts = live.posts_of(J.landed(t.spark, folder))
        posts = posts.withColumn("case_id", F.expr("cast(substring(external_id, 2) as bigint) div 25"))
        J.run_available(posts, J.append_counts(table, count), f"{table}-checkpoint")
    return J.summed(t.spark.read.parquet(table), measure)


@query("s15_live_posts", views="posts", sql=f"""
SELECT external_id, '' || account_id AS account_external_id, md5(content) AS content_md5, strftime(published_at, {S}) AS published_at,
  likes_count::INT AS likes_count, 'https://live.example/' || external_id AS post_url, kind AS tags FROM posts""")
def s15(t: Tables):
    out = live.posts_of(statuses(t).withColumn("tags", F.transform("tags", lambda x: F.struct(x["name"].alias("name"), F.lit(None).cast("string").alias("url")))))
    return out.select("external_id", "account_external_id", F.md5("content").alias("content_md5"), stamp("published_at").alias("published_at"),
                      "likes_count", "post_url", F.array_join("tags", ",").alias("tags"))


@query("s15_live_accounts", views="posts", sql="""
SELECT '' || account_id AS external_id, 'user_' || account_id AS username, arg_max(likes_count, published_at)::INT AS followers_count,
  arg_max(reposts_count, published_at)::INT AS following_count FROM posts GROUP BY account_id""")
def s15_accounts(t: Tables):
    """Authors of the landed statuses; of several payloads the newest counts."""
    rows = statuses(t, t.posts(False).withColumns({"content": F.lit(""), "language": F.lit("")}))
    landed = t.spark.read.schema(schema.STATUS).json(land(t, rows))
    authors = live.accounts_of(landed).drop("account_url")
    out = U.collapse_batch(authors, ["source_id", "external_id"], U.LIVE_ACCOUNT_RULES, "collected_at")
    return out.select("external_id", "username", "followers_count", "following_count")


@query("r1_landed_posts", views="posts", sql=f"""
SELECT external_id, '' || account_id AS account_external_id, md5(content) AS content_md5, strftime(published_at, {S}) AS published_at, likes_count::INT AS likes_count FROM posts""")
def r1(t: Tables):
    """Three batches: the newer half, then the older one, then all once more as of the next day; each post is kept as it first came."""
    rows = statuses(t)
    middle = F.lit("2024-01-16 00:00:00").cast("timestamp")
    again = rows.withColumn("created_at", F.col("created_at") + F.expr("interval 1 day")).withColumn("content", F.lit("later"))
    table = f"{shared_folder(t.spark)}/posts-{uuid.uuid4().hex}"
    folder = ""
    for batch in (rows.where(F.col("created_at") >= middle), rows.where(F.coalesce(F.col("created_at") < middle, F.lit(True))), again):
        folder = land(t, batch, folder)
        J.run_available(J.new_posts(J.landed(t.spark, folder)), J.append_new(table), f"{table}-checkpoint")
    return t.spark.read.parquet(table).select(
        "external_id", "account_external_id", F.md5("content").alias("content_md5"), stamp("published_at").alias("published_at"), "likes_count")


@query("r2_streamed_scores", views="posts", sql="WITH src AS (SELECT post_id, content AS txt FROM posts)," + lexicon_sql("src") + f"""
SELECT p.external_id, {', '.join(LEX_COLS)}, CASE WHEN manipulation_score > 0.7 AND confidence_score > 0.7 THEN 1 WHEN manipulation_score > 0.4 THEN 2 ELSE 3 END AS escalation_priority
FROM lex JOIN posts p USING (post_id)""")
def r2(t: Tables):
    """Posts of one kind with another text first, then all as they are: the log is compacted and holds the last score of each."""
    table = f"{shared_folder(t.spark)}/results-{uuid.uuid4().hex}"
    folder, rows = "", statuses(t)
    for batch in (rows.where(F.col("tags")[0]["name"] == "purchase").withColumn("content", F.lit("срочно")), rows):
        folder = land(t, batch, folder)
        scored = J.score_posts(live.posts_of(J.landed(t.spark, folder))).drop("content", "clean_text")  # the log holds scores, not texts
        J.run_available(scored, J.append_batch(table), f"{table}-checkpoint")
    J.compact(t.spark, table)
    return t.spark.read.parquet(table).select("external_id", *LEX_COLS, "escalation_priority")


@query("r3_bursts", views="posts", sql=f"""
WITH w AS (SELECT case_id, time_bucket(INTERVAL 15 MINUTE, published_at) - to_minutes(15 * CAST(g.i AS INTEGER)) AS s FROM posts CROSS JOIN range(2) g(i))
SELECT case_id, strftime(s, {S}) AS window_start, strftime(s + INTERVAL 30 MINUTE, {S}) AS window_end, count(*) AS posts FROM w GROUP BY 1, s""")
def r3(t: Tables):
    rows = statuses(t, t.posts(False).withColumns({"content": F.lit(""), "language": F.lit("")}))
    out = streamed(t, rows, lambda posts: J.bursts(posts, "30 minutes", "15 minutes"), "posts")
    return out.select("case_id", stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "posts")


@query("r4_trending_tags_per_hour", views="posts post_tags", sql=f"""
WITH h AS (SELECT date_trunc('hour', published_at) AS hour, tag, count(*) AS uses FROM posts JOIN post_tags USING (post_id) GROUP BY 1, 2)
SELECT strftime(hour, {S}) AS hour, tag, uses, row_number() OVER (PARTITION BY h.hour ORDER BY uses DESC, tag)::INTEGER AS rank FROM h QUALIFY rank <= 3""")
def r4(t: Tables):
    tagged = t.posts(False).withColumns({"content": F.lit(""), "language": F.lit("")}).join(t.post_tags(), "post_id")
    out = J.ranked_tags(streamed(t, statuses(t, tagged, "tag"), J.tags_per_hour, "uses"), 3)
    return out.select(stamp("hour").alias("hour"), "tag", "uses", "rank")


# -- texts of cases ---------------------------------------------------------------------------------


@query("w10_case_texts", views="posts cases", sql=rf"""
WITH p AS (SELECT case_id, post_id, published_at, is_case_root, trim(regexp_replace(content, '{WS}', ' ', 'g')) AS t FROM posts),
r AS (SELECT case_id, arg_min(t, post_id) AS root FROM p WHERE is_case_root GROUP BY 1),
k AS (SELECT p.case_id, substring(t, 1, 220) AS cut, row_number() OVER (PARTITION BY p.case_id ORDER BY is_case_root DESC, published_at, post_id) AS rn
  FROM p JOIN r USING (case_id) WHERE t <> '' AND t <> root),
l AS (SELECT case_id, string_agg(cut, ' ' ORDER BY rn) AS b, count(*) AS n, sum(length(cut))::BIGINT AS ch FROM k WHERE rn <= 8 GROUP BY 1)
SELECT case_id, coalesce(n, 0) AS reaction_count, coalesce(ch, 0) AS reaction_chars,
  md5(CASE WHEN n > 0 THEN 'Root tweet: ' || root || ' Reactions: ' || b ELSE 'Root tweet: ' || root END) AS text_md5 FROM r LEFT JOIN l USING (case_id)""")
def w10(t: Tables):
    out = case_texts(t.posts_table(), t.cases(), 8, 220)  # what the text models of the published figures read
    return out.select("case_id", "reaction_count", "reaction_chars", F.md5("text").alias("text_md5"))


@query("c21_bot_profile", views="posts", sql="""
WITH s AS (SELECT DISTINCT case_id, account_id, ((account_id * 37 + case_id) % 1024) / 1024.0::DOUBLE AS b FROM posts),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY b DESC, account_id) AS rn FROM s),
f AS (SELECT case_id, count(*) AS n, avg(b) AS mean, max(b) AS top, avg((b >= 0.5)::INT) AS high, coalesce(max(b) FILTER (WHERE rn = 2), 0) AS b2,
  coalesce(max(b) FILTER (WHERE rn = 3), 0) AS b3 FROM k GROUP BY 1),
r AS (SELECT s.case_id, s.b FROM s JOIN posts p ON p.case_id = s.case_id AND p.account_id = s.account_id AND p.is_case_root)
SELECT case_id, n::DOUBLE AS bot_account_count, format('{:.6f}', mean)::DOUBLE AS bot_score_mean, format('{:.6f}', top)::DOUBLE AS bot_score_max,
  format('{:.6f}', high)::DOUBLE AS bot_high_share, format('{:.6f}', top)::DOUBLE AS bot_top_score_1, format('{:.6f}', b2)::DOUBLE AS bot_top_score_2,
  format('{:.6f}', b3)::DOUBLE AS bot_top_score_3, format('{:.6f}', r.b)::DOUBLE AS root_author_bot_score FROM f JOIN r USING (case_id)""")
def c21(t: Tables):
    posts = t.posts(False)
    scores = posts.select("case_id", "account_id").distinct().withColumn("bot_score", (F.col("account_id") * 37 + F.col("case_id")) % 1024 / F.lit(1024.0))
    return C.bot_profile(C.root_posts(posts), scores).select("case_id", *C.BOT_FEATURES)
